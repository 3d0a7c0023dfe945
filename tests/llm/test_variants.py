"""Spelling variants: counts, neighbours and roots against plain versions."""

import random
import re
import zlib
from collections import Counter

import pytest

from popshift.llm import variants


def plain_counts(rows, noise=199):
    seen = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % noise == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(counts):
    out = {}
    for w, n in counts.items():
        near = [u for u in counts if one_edit(w, u)]
        best = min(near, key=lambda u: (-counts[u], u), default=None)
        out[w] = (n, len(near), best if best and counts[best] >= 5 * n else None)
    rows = {}
    for w, (n, n_near, form) in out.items():
        root = w
        while out[root][2]:
            root = out[root][2]
        rows[w] = (root, n, n_near, form, counts[form] if form else None)
    return rows


def grouped(words):
    return {r["word"]: (r["root"], r["n"], r["n_near"], r["form"], r["form_n"]) for r in variants.group_variants(words).collect()}


def test_counts_of_edge_rows(spark, make_docs, edge_rows):
    rng = random.Random(3)
    words = ["Straße", "ÀÉÎÕÜß×÷", "dolors", "LOREMS", "x" * 40, "abc", "naïveté", "日本語日本語日本語"]
    rows = [*edge_rows, *[(100 + i, " ".join(rng.choices(words, k=40))) for i in range(60)]]
    for noise in (199, 3):
        got = {r["word"]: r["n"] for r in variants.word_counts(make_docs(rows), noise).collect()}
        assert got == plain_counts(rows, noise)
    assert variants.word_counts(make_docs([])).count() == 0


@pytest.mark.parametrize("letters,sizes,count", [("ab", (6, 9), 250), ("abcéÿ", (6, 7), 500)])
def test_groups_equal_brute_force(spark, letters, sizes, count):
    rng = random.Random(len(letters))
    words = {"".join(rng.choices(letters, k=rng.randint(*sizes))) for _ in range(count)}
    base = sorted(words)[:20]
    for w in base:  # chains of forms, ties, a very long word beside its variant
        words |= {w[:-1] + "q", w + "q", "q" + w, w[1:] + "qq"}
    words |= {"y" * 3000, "y" * 2999, "y" * 1500 + "z" + "y" * 1499, "abcdef" * 50}
    counts = {w: rng.choice([5, 5, 25, 26, 125, 700, 4000]) for w in words}
    assert grouped(spark.createDataFrame(list(counts.items()), "word string, n long")) == plain_groups(counts)


def test_nothing_and_one_word(spark):
    assert grouped(spark.createDataFrame([], "word string, n long")) == {}
    assert grouped(spark.createDataFrame([("lonely", 5)], "word string, n long")) == {"lonely": ("lonely", 5, 0, None, None)}


def test_a_hub_shared_by_a_third_of_all_words(spark):
    """One prefix holds all words, and one word is near to hundreds."""
    alphabet = [chr(c) for c in range(0xC0, 0x100)]
    counts = {"common": 10_000} | {f"comm{c}n": 5 for c in alphabet} | {f"commo{c}": 6 for c in alphabet} | {f"common{c}": 7 for c in alphabet}
    got = grouped(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert got == plain_groups(counts)
    assert got["common"][2] == 3 * 64 and all(r[0] == "common" for r in got.values())


def test_no_table_is_broadcast(spark, monkeypatch):
    """Sizes are those of files or of rows before they are exploded, so a broadcast would be far larger than Spark thinks."""
    plans, write = [], variants.staged
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def watched(df, tag):
        out = write(df, tag)
        plans.append((tag, plan(df)))
        return out

    monkeypatch.setattr(variants, "staged", watched)
    words = spark.createDataFrame([("lorems", 500), ("lorem", 4), ("lorexs", 7), ("dolors", 9), ("dolorss", 90)], "word string, n long")
    out = variants.group_variants(words)
    assert out.count() == 5
    plans.append(("out", plan(out)))
    assert {"variants-nodes", "variants-pairs", "variants-forms", "variants-roots", "out"} <= {tag for tag, _ in plans}
    assert all("Join" in text for tag, text in plans if tag != "variants-edges") and not [tag for tag, text in plans if "Broadcast" in text]
