"""Language identification: averaged hashed subword embeddings and a linear softmax, trained by SGD in numpy.

A text is the average of the embeddings of its hashed byte n-grams; a linear layer gives the classes. As both maps are
linear, prediction uses their product, one row of class weights for each bucket. The softmax's temperature is calibrated on
labelled texts that training didn't see.

Rejection is calibrated on what lies outside the learned languages. A text's evidence is how far its best class's logit lies
above the next one: n-grams that training never saw carry none. Foreign texts for the calibration are those of each language
under a model trained without it (leave one language out), texts with their characters shuffled, and texts written over in
random scripts, all from documents of the learning folds. The threshold lies midway between the evidence that one in a hundred
foreign texts reaches and that which all but REJECTED of the own texts reach; where these overlap, half of the latter decides, so
that clean texts stay, also such as mix two languages. The score is the softmax's probability among the learned languages; evidence alone decides on rejection.

Training is bounded: about PER_LANG labelled documents of each language, and IN_ALL over all languages, drawn by a hash of their
doc_id from those whose crc32(doc_id) mod 5 is not 0; a quarter of them calibrates, and LEFT_OUT languages at most are left out
in turn. Features are counted on the executors from whole texts.

Defined results: a null or empty text, or one with no letter, is `und` with score 0 and is rejected; documents without a doc_id
or lang are never learned from; with no learnable document at all every text is `und`; of equal logits the language that comes
first in code-point order wins; repeated rows get one row each; an empty table gives an empty table; very long texts are whole.
Other columns aren't read, or pass as they are (accepted), so clashing names don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from popshift.llm.common import column, read, small_batches

BUCKETS, DIM = 1 << 15, 16
ORDERS = (2, 3, 4)
PER_LANG, IN_ALL, EPOCHS, RATE, SEED = 400, 2_000, 6, 2.0, 11
#: Share of calibration texts, right or wrong, that the threshold may reject; languages that are left out in turn.
REJECTED, LEFT_OUT = 0.002, 4
#: One in so many of the drawn documents is also shuffled and written over.
FOREIGN = 8
# First letters of scripts, from which foreign texts take thirty each (Greek, Cyrillic, Armenian, Hebrew, Arabic,
# Devanagari, Bengali, Tamil, Thai, Georgian, Hangul, Hiragana, Katakana, Han).
SCRIPTS = (0x3B1, 0x430, 0x561, 0x5D0, 0x627, 0x905, 0x985, 0xB85, 0xE01, 0x10D0, 0xAC00, 0x3042, 0x30A2, 0x4E00)
FOLDS = 5

_MAYBE = re.compile(r"[^\W\d_]")
_KEPT = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], dtype=np.uint32)


def fold(doc_id) -> F.Column:
    return F.crc32(doc_id.cast("string")) % FOLDS


def has_letter(text: str) -> bool:
    """Digits such as one half or a squared two are word characters, but no letters."""
    return any(m[0].isalpha() for m in _MAYBE.finditer(text))


def buckets_of(text: str) -> np.ndarray | None:
    """Bucket of each n-gram of the lower-cased text, where all but letters count as a space; None if no letter."""
    if not text or not has_letter(text):
        return None
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_KEPT).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        b = np.pad(b, (0, 3 - len(b)), constant_values=32)
    gram, out = b, []
    for n, k in zip(ORDERS, _MULTIPLIERS, strict=True):
        gram = (gram[:-1] << np.uint32(8)) | b[n - 1 :] if len(b) >= n else gram[:0]
        out.append((gram * k) >> np.uint32(17))
    return np.concatenate(out).astype(np.int32)


class Model:
    """Class weights by bucket, bias, temperature, and the evidence below which a text is rejected."""

    def __init__(self, langs: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.langs, self.weights, self.bias, self.temperature, self.threshold = langs, weights, bias, temperature, threshold

    def logits(self, text: str | None) -> np.ndarray | None:
        """None for a text without a letter, and where nothing was learned."""
        b = buckets_of(text or "")
        if b is None or not self.langs:
            return None
        total = np.zeros(len(self.langs))
        for i in range(0, len(b), 1 << 18):  # a very long text needs little memory
            total += self.weights[b[i : i + (1 << 18)]].sum(axis=0, dtype=np.float64)
        return total / len(b) + self.bias

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, whether it is rejected)."""
        z = self.logits(text)
        if z is None:
            return "und", 0.0, True
        best = int(z.argmax())
        return self.langs[best], float(softmax(z / self.temperature)[best]), bool(evidence(z) < self.threshold)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge(text)[:2]


def evidence(z: np.ndarray) -> np.ndarray:
    """How far the best logit lies above the next one; with one class, its logit."""
    top = np.sort(z, axis=-1)
    return top[..., -1] - (top[..., -2] if z.shape[-1] > 1 else 0.0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


Sample = tuple[str, np.ndarray, np.ndarray]  #: (language, bucket numbers, their shares of the text's n-grams)


def _fitted(samples: list[Sample], langs: list[str], seed: int) -> Model:
    rng = np.random.default_rng(seed)
    y = [langs.index(s[0]) for s in samples]
    embed = rng.normal(0, 0.1, (BUCKETS, DIM))
    out = rng.normal(0, 0.1, (DIM, len(langs)))
    bias = np.zeros(len(langs))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(samples)):
            _, b, share = samples[i]
            hidden = share @ embed[b]
            error = softmax(hidden @ out + bias)
            error[y[i]] -= 1
            back = out @ error
            out -= rate * np.outer(hidden, error)
            bias -= 0.1 * rate * error
            embed[b] -= rate * 5 * np.outer(share, back)
    return Model(langs, (embed @ out).astype(np.float32), bias)


def _logits(model: Model, samples: list[Sample]) -> np.ndarray:
    return np.array([share @ model.weights[b] + model.bias for _, b, share in samples]).reshape(-1, len(model.langs))


def train(samples: list[Sample], foreign: list[Sample] = (), seed: int = SEED) -> Model:
    """Every fourth sample of a language calibrates; foreign: texts of no language, which calibrate the rejection."""
    langs = sorted({s[0] for s in samples})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    seen = dict.fromkeys(langs, 0)
    fit, held = [], []
    for s in samples:
        seen[s[0]] += 1
        (held if seen[s[0]] % 4 == 0 else fit).append(s)
    held = held or fit
    model = _fitted(fit, langs, seed)
    logits = _logits(model, held)
    right = np.array([langs.index(s[0]) for s in held])
    # By the rule of succession a text is never more certain than those that were seen allow; so the best temperature is not zero.
    doubt = 1 / (len(held) + 2)

    def loss(t: float) -> float:
        p = softmax(logits / t) + 1e-300
        own = np.log(p[np.arange(len(right)), right])
        return -((1 - doubt) * own + doubt * (np.log(p).sum(axis=1) - own) / max(1, len(langs) - 1)).mean()

    model.temperature = float(min(np.geomspace(0.01, 100, 200), key=loss))
    own = np.sort(evidence(logits))
    outside = [evidence(_logits(model, list(foreign)))] if foreign else []
    for lang in sorted(langs, key=lambda x: (-seen[x], x))[: LEFT_OUT if len(langs) > 2 else 0]:
        without = _fitted([s for s in fit if s[0] != lang], [x for x in langs if x != lang], seed)
        outside.append(evidence(_logits(without, [s for s in held if s[0] == lang])))
    low = float(own[int(REJECTED * len(own))])
    high = float(np.quantile(np.concatenate(outside), 0.99)) if outside else low
    model.threshold = (low + high) / 2 if high < low else low / 2
    return model


def _shuffled(text: str, rng: np.random.Generator) -> str:
    return "".join(np.array(list(text))[rng.permutation(len(text))])


def _written_over(text: str, rng: np.random.Generator) -> str:
    """The text with its letters in another script, each by one of thirty letters."""
    first = int(rng.choice(SCRIPTS))
    letters = sorted(set(c for c in text if c.isalpha()))
    return text.translate({ord(c): chr(first + int(k)) for c, k in zip(letters, rng.integers(0, 30, len(letters)), strict=True)})


def _sample(docs: DataFrame) -> tuple[list[Sample], list[Sample]]:
    """(labelled samples, foreign ones)."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 0))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, min(PER_LANG, IN_ALL / len(counts)) / n))])
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, langs, kinds, which, shares = [], [], [], [], []
            for doc, lang, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "lang").to_pylist(), column(batch, "text"), strict=True):
                text, name = text.as_py(), str(doc)
                h = zlib.crc32(name.encode())
                made = [text, *([change(text, np.random.default_rng(h)) for change in (_shuffled, _written_over)] if h // FOLDS % FOREIGN == 0 else [])]
                for kind, t in enumerate(made):
                    b = buckets_of(t)
                    if b is not None:
                        u, n = np.unique(b, return_counts=True)
                        ids.append(name), langs.append(lang), kinds.append(kind), which.append(u.astype("<i4").tobytes()), shares.append((n / n.sum()).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(langs, pa.string()), pa.array(kinds, pa.int32()), pa.array(which, pa.binary()), pa.array(shares, pa.binary())], names=["doc_id", "lang", "kind", "b", "s"])

    found = drawn.mapInArrow(count, "doc_id string, lang string, kind int, b binary, s binary").collect()
    found.sort(key=lambda r: (r["lang"], len(r["doc_id"]), r["doc_id"], r["b"]))
    own, foreign = ([(r["lang"], np.frombuffer(r["b"], "<i4"), np.frombuffer(r["s"], "<f4")) for r in found if (r["kind"] > 0) == is_foreign] for is_foreign in (False, True))
    return own, foreign


def fit(docs: DataFrame) -> Model:
    small_batches(docs.sparkSession)
    return train(*_sample(docs))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    df = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), F.col("text").alias("_t"))

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            found = [m.judge(x.as_py()) for x in column(batch, "_t")]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), column(batch, "held_out"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return df.mapInArrow(predict, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns as they are, whose text the model doesn't reject."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            yield batch.filter(pa.array([not m.judge(x.as_py())[2] for x in column(batch, "text")], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
