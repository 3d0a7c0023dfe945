"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of WINDOW consecutive item words (an item of fewer, but not none, is one window). For patterns of
one length m, a shift table over hashed blocks of BLOCK words says how far a search may jump when a block ends at the current
word; where the shift is 0, the bucket of that suffix block holds the candidates, those with the pattern's first block are
selected, and their words are compared directly. Texts of fewer words than m hold no occurrence.

The tables are compiled once, on the driver, into flat arrays (about ten bytes for each byte of the items), sent to each
executor as a file and mapped there by all its tasks. A larger benchmark goes through in blocks of items, a pass each.

Defined results: a null or empty text has no words, no hit and is not contaminated; null or empty items have no windows;
items without an id count nowhere; repeated items count once; equal windows of several items count for each of them; repeated
documents get one row each. Without documents there are no rows, without items no hits. Very long texts are whole. Other
columns aren't read, or pass as they are (clean), so clashing names don't matter.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from popshift.llm.common import column, discard, mapped_arrays, read, share_arrays, small_batches, staged, text_bytes

WINDOW, BLOCK = 10, 2
#: Bytes of the items of one block; a larger benchmark is searched block by block, each in a further narrow pass.
CHARS_PER_BLOCK = 20_000_000

_SPACES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text after A-Z are lower-cased."""
    return text.translate(_SPACES).split()


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hash(*words: np.ndarray) -> np.ndarray:
    """64-bit hash of a block, by its words' numbers."""
    out = np.zeros(len(words[0]), np.uint64)
    for w in words:
        out = (out ^ w.astype(np.uint64)) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _hash_block(words: list[int]) -> int:
    """The same of one block."""
    out = 0
    for w in words:
        out = ((out ^ w) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
        out ^= out >> 29
    return out


def compile_items(items: Iterable[tuple[int, bytes]], window: int = WINDOW) -> dict[str, np.ndarray]:
    """The items' tables as arrays: words by number, their text for the comparison, and of each pattern length m the shift table
    (m/shift), buckets (m/buckets) of patterns by suffix block, ordered by first block (m/first, m/at), and each pattern's items."""
    numbers: dict[bytes, int] = {}
    ids, sizes, texts, names = [], [], [], []
    for item, text in items:
        words = words_of(text or b"")
        if item is None or not words:
            continue
        ids.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
        sizes.append(len(words)), names.append(item), texts.append(b" ".join(words) + b" ")
    text = np.frombuffer(b"".join(texts), np.uint8)
    del texts
    word = np.concatenate(ids or [np.zeros(0, np.int32)])
    del ids
    size = np.array(sizes, np.int64)
    seed = 0
    while True:  # a seed under which no two of the words share a hash
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in numbers), np.uint64, len(numbers))
        order = np.argsort(hashes)
        if not (np.diff(hashes[order]) == 0).any():
            break
        seed += 1
    ends = np.flatnonzero(text == 32) + 1
    out = {"seed": np.array([seed]), "hashes": hashes[order], "numbers": order.astype(np.int32), "word": word, "text": text, "place": np.concatenate([[0], ends]).astype(np.int64), "item": np.array(names, np.int64)}
    begin = np.cumsum(size) - size
    lengths = np.minimum(window, size)
    for m in sorted(set(lengths.tolist())):
        own = np.flatnonzero(lengths == m)
        many = size[own] - m + 1
        start = np.repeat(begin[own], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        of = np.repeat(own, many)
        b = min(BLOCK, m)
        block = lambda at, b=b: _hash(*[word[at + k] for k in range(b)])
        bits = max(4, int(2 * len(start) - 1).bit_length())
        slot = lambda h, bits=bits: (h >> np.uint64(64 - bits)).astype(np.int64)
        shift = np.full(1 << bits, m - b + 1, np.uint8)
        for end in range(b, m + 1):  # smaller shifts come later and stay
            shift[slot(block(start + end - b))] = m - end
        bucket, first = slot(block(start + m - b)), (block(start) >> np.uint64(32)).astype(np.uint32)
        whole = _hash(*[word[start + k] for k in range(m)])
        order = np.lexsort((of, whole, first, bucket))
        start, of, bucket, first, whole = start[order], of[order], bucket[order], first[order], whole[order]
        same = (np.diff(whole) == 0) & (np.diff(bucket) == 0) & (np.diff(first) == 0) if len(start) else np.zeros(0, bool)
        for k in range(m):  # equal hashes of unequal windows stay apart
            same &= word[start[1:] + k] == word[start[:-1] + k]
        new = np.flatnonzero(np.concatenate([[True], ~same])) if len(start) else np.zeros(0, np.int64)
        rank = np.zeros(len(start), np.int64)
        rank[new] = 1
        rank = np.cumsum(rank)
        fresh = np.concatenate([[True], (np.diff(rank) != 0) | (np.diff(of) != 0)]) if len(start) else np.zeros(0, bool)
        out |= {
            f"{m}/shift": shift, f"{m}/buckets": np.searchsorted(bucket[new], np.arange((1 << bits) + 1)).astype(np.int32), f"{m}/first": first[new],
            f"{m}/at": start[new].astype(np.int32), f"{m}/of": of[fresh].astype(np.int32), f"{m}/items": np.searchsorted(rank[fresh], np.arange(1, len(new) + 2)).astype(np.int32),
        }
    return out


class WuManber:
    """Search for many word sequences of one length."""

    def __init__(self, tables: dict[str, np.ndarray], length: int):
        self.m, self.b = length, min(BLOCK, length)
        self.shift, self.buckets, self.first, self.at, self.of, self.items = (memoryview(tables[f"{length}/{k}"]) for k in ("shift", "buckets", "first", "at", "of", "items"))
        self.down = 64 - (len(self.shift) - 1).bit_length()
        self.text, self.place, self.item = tables["text"], memoryview(tables["place"]), memoryview(tables["item"])

    def find(self, words: list[bytes], numbers: list[int]) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of each occurrence, in order. numbers: the words' numbers, -1 for words that no item has."""
        m, b, shift, down = self.m, self.b, self.shift, self.down
        at, n = m - 1, len(words)
        while at < n:
            if numbers[at] < 0:  # no pattern lies over this word
                at += m
                continue
            if b == 2 and numbers[at - 1] < 0:
                at += m - 1
                continue
            h = _hash_block(numbers[at - b + 1 : at + 1])
            jump = shift[h >> down]
            if jump:
                at += jump
                continue
            start = at - m + 1
            lo, hi = self.buckets[h >> down], self.buckets[(h >> down) + 1]
            if lo < hi and min(numbers[start : start + b]) >= 0:
                key = _hash_block(numbers[start : start + b]) >> 32
                k = bisect_left(self.first, key, lo, hi)
                while k < hi and self.first[k] == key:
                    w = self.at[k]
                    if self.text[self.place[w] : self.place[w + m] - 1].tobytes() == b" ".join(words[start : at + 1]):
                        yield start, [self.item[i] for i in self.of[self.items[k] : self.items[k + 1]]]
                    k += 1
            at += 1


#: Words that a task remembers.
REMEMBERED = 300_000


class Search:
    """All pattern lengths of a block of items, over compiled tables."""

    def __init__(self, tables: dict[str, np.ndarray]):
        self.tables, self.known = tables, {}
        self.seed = int(tables["seed"][0])
        self.matchers = [WuManber(tables, m) for m in sorted(int(k.split("/")[0]) for k in tables if k.endswith("/shift"))]

    def numbers(self, words: list[bytes]) -> list[int]:
        """Of each word its number among the items' words, or -1; what the comparison says in the end holds."""
        known = self.known
        new = list({w for w in words if w not in known})
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = list(set(words))
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, self.seed) for w in new), np.uint64, len(new))
            all_ = self.tables["hashes"]
            if len(all_):
                at = np.minimum(np.searchsorted(all_, hashes), len(all_) - 1)
                found = np.where(all_[at] == hashes, self.tables["numbers"][at], -1).tolist()
            else:
                found = [-1] * len(new)
            known.update(zip(new, found, strict=True))
        return [known[w] for w in words]

    def find(self, words: list[bytes]) -> Iterator[tuple[int, int, list[int]]]:
        """(start, end, items) of each occurrence."""
        if not self.matchers:
            return
        numbers = self.numbers(words)
        for matcher in self.matchers:
            for start, of in matcher.find(words, numbers):
                yield start, start + matcher.m, of


def scan(words: list[bytes], search: Search) -> tuple[list[tuple[int, int]], set[int]]:
    """Maximal runs [start, end) of hit words, and the items with occurring windows."""
    found, items = [], set()
    for start, end, of in search.find(words):
        found.append((start, end))
        items.update(of)
    return merge(found), items


def merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(runs):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items by a hash of their id in blocks of about CHARS_PER_BLOCK bytes; one block at a time is on the driver.

    An empty benchmark is one empty block.
    """
    items = text_bytes(benchmark, "item_id").where("item_id is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.octet_length("_b"))).first()[0] or 0) // CHARS_PER_BLOCK))
    for k in range(blocks):
        here = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        yield [(r["item_id"], bytes(r["_b"])) for r in here.collect()]


def _passes(df: DataFrame, benchmark: DataFrame, step, tag: str, window: int) -> DataFrame:
    """df through one step for each block of items: step(search, batches). Results of a pass are written before the next,
    so there is one worker and one block's tables at a time, however large the benchmark is."""
    spark, before = df.sparkSession, None
    for i, block in enumerate(_item_blocks(benchmark)):
        if i:
            df, done = staged(df, tag), before
            before = df
            if done is not None:
                discard(done)
        name = share_arrays(spark, compile_items(block, window), "items")
        df = df.mapInArrow(lambda batches, name=name: step(Search(mapped_arrays(SparkFiles.get(name))), batches), df.schema)
    return df


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans (runs of hit words)."""
    spark = docs.sparkSession
    small_batches(spark)
    none = {"_spans": F.array().cast("array<array<int>>"), "_items": F.array().cast("array<long>"), "_n": F.lit(0).cast("long")}

    def search(tables: Search, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, items, n = [], [], []
            for text, had, of in zip(column(batch, "_b"), column(batch, "_spans").to_pylist(), column(batch, "_items").to_pylist(), strict=True):
                words = words_of(text.as_py())
                more, which = scan(words, tables)
                spans.append(merge([tuple(x) for x in had] + more) if had else more)
                items.append(sorted(which.union(of)))
                n.append(len(words))
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "_b"), pa.array([[list(x) for x in s] for s in spans], pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.int64())), pa.array(n, pa.int64())], names=["doc_id", "_b", "_spans", "_items", "_n"])

    found = _passes(text_bytes(docs, "doc_id").withColumns(none), benchmark, search, "decontam", window)
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    digest = F.sha2(F.array_join(F.array_sort(F.transform("_items", lambda i: i.cast("string"))), ","), 256)
    return found.select("doc_id", F.col("_n").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"), digest.alias("items_sha256"), (hit > 0).alias("contaminated"), F.col("_items").alias("items"), F.col("_spans").alias("spans"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns as they are, in which no item's window occurs.

    Null and empty texts stay, as do rows without a doc_id and repeated rows; an empty table stays empty; without items all
    rows stay.
    """
    small_batches(docs.sparkSession)

    def keep(tables: Search, batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [any(True for _ in tables.find(words)) for words in (words_of((x.as_py() or "").encode()) for x in column(batch, "text"))]
            yield batch.filter(pa.array([not h for h in hit], pa.bool_()))

    return _passes(docs, benchmark, keep, "decontam", window)


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items", "spans")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10_SQL = f"""
WITH iw AS (SELECT DISTINCT item_id, w FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0 AND item_id IS NOT NULL),
pat AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, list_aggregate(w[i:i + least(10, len(w)) - 1], 'string_agg', ' ') AS p
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw)),
lens AS (SELECT DISTINCT m FROM pat),
dw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dg AS (SELECT r, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM dw, lens WHERE len(w) >= m),
hit AS (SELECT DISTINCT r, i, dg.m, item_id FROM (SELECT r, m, i, list_aggregate(w[i:i + m - 1], 'string_agg', ' ') AS p FROM dg) dg JOIN pat USING (m, p)),
cov AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (r) LEFT JOIN its USING (r)
"""
