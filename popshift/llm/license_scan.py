"""Licence notices in documents, paragraph by paragraph. DataFrame functions only on the executors.

A paragraph (a line) is classified by multinomial logistic regression over its distinct word bigrams. Weights are sparse:
a bit mask over hashed bigrams drops all that the model doesn't know, inside the row and without a shuffle, and only
what is left is looked up. A softmax with an `unknown` class, a temperature and a threshold calibrated on held-out
sentences names a family, and comparison with the family's notices confirms it: the share of the paragraph's bigrams that occur
in them must reach CONFIRMED. The model is fitted on the driver, from a fixed list of notices and sentences.

Defined results: null and empty texts have no notice; a document without any has family null and families ''; long texts
are whole; repeated rows get one row each.
"""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from popshift.llm.common import read
from popshift.llm.license_texts import NOTICES, OTHERS

UNKNOWN = "unknown"
VARIANTS, STEPS, RATE, DECAY, SEED = 6, 400, 0.5, 0.003, 3
CONFIRMED, PRECISION = 0.5, 0.99
MASK_BITS = 1 << 16

_WORD = re.compile(r"[a-z0-9]+")


def bigrams(text: str) -> list[str]:
    words = _WORD.findall(text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


class Model:
    """Families, weights by bigram, bias, temperature, threshold, and the families whose notices hold a bigram."""

    def __init__(self, families, weights, bias, temperature, threshold, within):
        self.families, self.weights, self.bias, self.temperature, self.threshold, self.within = families, weights, bias, temperature, threshold, within


def _examples(rng: random.Random) -> list[tuple[str, str]]:
    """Notices and variants of them with words before or after, cut or left out; no-notices, also of shuffled words."""
    out = []
    plain = [w for s in OTHERS for w in s.split()]
    for family, texts in NOTICES.items():
        for text in texts:
            out.append((family, text))
            for _ in range(VARIANTS):
                words = text.split()
                if len(words) > 12 and rng.random() < 0.5:
                    words = words[: rng.randint(10, len(words))]
                if len(words) > 6 and rng.random() < 0.5:
                    words.pop(rng.randrange(len(words)))
                before, after = (rng.choices(plain, k=rng.randint(0, 4)) for _ in range(2))
                out.append((family, " ".join(before + words + after)))
    notice_words = [w for texts in NOTICES.values() for t in texts for w in t.split()]
    for text in OTHERS:
        out += [(UNKNOWN, text)] * 3
    for _ in range(150):
        out.append((UNKNOWN, " ".join(rng.choices(notice_words + plain, k=rng.randint(2, 25)))))
    for _ in range(100):  # a stray bigram of a notice makes no notice
        w = rng.choice(rng.choice(list(NOTICES.values()))[0].split() + ["the"])
        out.append((UNKNOWN, " ".join([*rng.choices(plain, k=rng.randint(3, 15)), w, *rng.choices(plain, k=3)])))
    rng.shuffle(out)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@lru_cache(maxsize=1)
def fit() -> Model:
    examples = _examples(random.Random(SEED))
    families = [*NOTICES, UNKNOWN]
    grams = [bigrams(t) for _, t in examples]
    known = {g: i for i, g in enumerate(sorted({g for texts in NOTICES.values() for t in texts for g in bigrams(t)} | {g for t in OTHERS for g in bigrams(t)}))}
    x = np.zeros((len(examples), len(known)))
    for i, gs in enumerate(grams):
        x[i, [known[g] for g in gs if g in known]] = 1
    y = np.array([families.index(f) for f, _ in examples])
    held = np.arange(len(y)) % 4 == 3
    w, b = np.zeros((len(known), len(families))), np.zeros(len(families))
    for _ in range(STEPS):
        p = _softmax(x[~held] @ w + b)
        p[np.arange(len(p)), y[~held]] -= 1
        w -= RATE * (x[~held].T @ p / len(p) * 20 + DECAY * w)
        b -= RATE * p.mean(axis=0)
    b[:-1] = np.minimum(b[:-1], b[-1])  # with no known bigram a paragraph is unknown
    z, right = x[held] @ w + b, y[held]
    temperature = float(min(np.geomspace(0.2, 5, 50), key=lambda t: -np.log(_softmax(z / t)[np.arange(len(right)), right] + 1e-12).mean()))
    p = _softmax(z / temperature)
    top, said = p.max(axis=1), p.argmax(axis=1)
    named = said != len(families) - 1
    threshold = next((t for t in np.arange(0.3, 0.96, 0.05) if (ok := named & (top >= t)).any() and (said[ok] == right[ok]).mean() >= PRECISION), 0.95)
    within = {g: [i for i, texts in enumerate(NOTICES.values()) if any(g in bigrams(t) for t in texts)] for g in known}
    return Model(families, {g: w[i] for g, i in known.items()}, b, temperature, float(threshold), within)


def _mask(model: Model, spark: SparkSession) -> bytes:
    """A byte for each hash value, 1 where the model knows a bigram of it."""
    known = spark.createDataFrame([(g,) for g in model.weights], "g string")
    bits = bytearray(MASK_BITS)
    for r in known.select(F.pmod(F.hash("g"), F.lit(MASK_BITS)).alias("h")).collect():
        bits[r["h"]] = 1
    return bytes(bits)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per document: doc_id, family (of the surest notice), score, n_notices, families (sorted, comma-joined)."""
    model = model or fit()
    spark = docs.sparkSession
    mask = F.lit(_mask(model, spark))
    n = len(model.families)
    table = F.from_json(F.lit(json.dumps({g: [round(float(v), 6) for v in w] for g, w in model.weights.items()})), "map<string,array<double>>")
    within = F.from_json(F.lit(json.dumps(model.within)), "map<string,array<int>>")
    bias = F.array(*[F.lit(float(v)) for v in model.bias])
    names = F.array(*[F.lit(f) for f in model.families])

    def parts(paragraph: Column) -> Column:
        """Words of the paragraph, then its bigrams, then how many there are and which the model may know."""
        words = F.filter(F.split(F.lower(paragraph), r"[^a-z0-9]+"), lambda w: w != "")
        grams = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 1, F.array_distinct(F.zip_with(F.slice(ws, 1, F.size(ws) - 1), F.slice(ws, 2, F.size(ws) - 1), lambda a, b: F.concat_ws(" ", a, b)))).otherwise(F.array().cast("array<string>")))
        return F.get(F.transform(grams, lambda gs: F.struct(F.size(gs).alias("n"), F.filter(gs, lambda g: F.substring(mask, F.pmod(F.hash(g), F.lit(MASK_BITS)) + 1, 1) == F.lit(b"\x01")).alias("known"))), 0)

    # Only paragraphs with at least CONFIRMED of their bigrams known can be confirmed.
    found = F.filter(F.transform(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n"), parts), lambda p: (p["n"] > 0) & (F.size(p["known"]) >= CONFIRMED * p["n"]))
    rows = docs.select("doc_id", found.alias("_found"))

    def logits(known: Column) -> Column:
        none = F.array_repeat(F.lit(0.0), n)
        total = F.aggregate(known, bias, lambda acc, g: F.zip_with(acc, F.coalesce(F.get(F.array(table[g]), 0), none), lambda a, w: a + w))
        return F.transform(total, lambda z: z / F.lit(model.temperature))

    def verdict(p: Column) -> Column:
        z = F.array(logits(p["known"]))
        best = F.transform(z, lambda v: F.struct(F.array_max(v).alias("top"), F.array_position(v, F.array_max(v)).cast("int").alias("at"), F.aggregate(v, F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max(v))).alias("sum")))
        return F.get(
            F.transform(
                best,
                lambda b: F.struct(
                    F.get(names, b["at"] - 1).alias("family"),
                    (F.lit(1.0) / b["sum"]).alias("score"),
                    (F.size(F.filter(p["known"], lambda g: F.coalesce(F.array_contains(within[g], b["at"] - 1), F.lit(False)))) / p["n"]).alias("share"),
                ),
            ),
            0,
        )

    sure = F.filter(F.transform("_found", verdict), lambda v: (v["family"] != UNKNOWN) & (v["score"] >= model.threshold) & (v["share"] >= CONFIRMED))
    rows = rows.select("doc_id", F.when(F.size("_found") > 0, sure).alias("_sure"))
    first = F.get(F.array_sort("_sure", lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["family"] < b["family"], -1).when(a["family"] > b["family"], 1).otherwise(0)), 0)
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("_sure", lambda v: v["family"]))), ",")
    return rows.select("doc_id", first["family"].alias("family"), first["score"].alias("score"), F.coalesce(F.size("_sure"), F.lit(0)).cast("long").alias("n_notices"), F.coalesce(families, F.lit("")).alias("families"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
