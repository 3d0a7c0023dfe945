"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared 64 at a time: the block's bit planes are stored vertically (word b holds bit b of 64
fingerprints), a query's bit turns each plane into a plane of differences, and carry-save bitwise counters add it to 64
distances at once. A block whose lanes have all overflowed the radius is abandoned.

Which blocks to compare: with at most 3 differing bits, two of five bit groups agree, so each of the ten pairs of groups
gives a bucket key and every link shows up in some bucket. Only distinct fingerprints are compared. A bucket larger than
BUCKET is split by further groups of its remaining bits, and what is still too large is compared chunk against chunk,
so no task holds an unbounded bucket. Buckets emit spanning links only (at most one for each member), and components
come from alternating large-star and small-star steps over Spark tables.

Defined results: a null or empty text has fingerprint zero, which links like any other; rows without a doc_id get a
fingerprint, no component, and link nothing; repeated rows get one row each.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from popshift.llm.common import column, discard, read, small_batches, staged, text_bytes

SHINGLE, SEED, RADIUS = 3, 42, 3
GROUPS = (13, 13, 13, 13, 12)
BUCKET = 2048
#: Comparisons (row, word) that are counted together; surviving ones of which the pairs are given out together.
TASKS, SURVIVORS = 1 << 18, 1 << 16
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes) -> int:
    """64 bits: those set in over half the hashes of 3-word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        digest, join = xxhash.xxh64_intdigest, b" ".join
        hashes = [digest(join(s), SEED) for s in zip(words, words[1:], words[2:], strict=False)]
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.array(hashes[i : i + 65536], dtype="<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""
    small_batches(docs.sparkSession)
    df = text_bytes(docs, "doc_id")

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py()) for x in column(batch, "_b")], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(fps)], names=["doc_id", "fp"])

    return df.mapInArrow(of, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, fp long")


def close_pairs(fps: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers (a < b) in the same bucket, with at most radius differing bits.

    fps: rows sorted by bucket; starts: first row of each bucket.
    """
    n = len(fps)
    sizes = np.diff(np.append(starts, n))
    bucket = np.repeat(np.arange(len(starts)), sizes)
    local = np.arange(n) - starts[bucket]
    words = -(-sizes // 64)
    first_word = np.cumsum(words) - words
    word = first_word[bucket] + local // 64
    lane = (local % 64).astype(np.uint64)
    word_starts = np.flatnonzero(np.diff(word, prepend=-1))
    planes = [np.bitwise_or.reduceat(((fps >> np.uint64(b)) & np.uint64(1)) << lane, word_starts) for b in range(64)]
    unused = ~np.bitwise_or.reduceat(np.uint64(1) << lane, word_starts)
    # Each row against its own word and the later words of its bucket.
    todo = words[bucket] - local // 64
    ends = np.cumsum(todo)
    done = 0
    while done < n:
        upto = max(int(np.searchsorted(ends, (ends[done - 1] if done else 0) + TASKS, "right")), done + 1)
        q = np.repeat(np.arange(done, upto), todo[done:upto])
        w = word[q] + np.arange(len(q)) - np.repeat(np.cumsum(todo[done:upto]) - todo[done:upto], todo[done:upto])
        done = upto
        counters = _start(len(q), radius)
        over, query = unused[w].copy(), fps[q]
        for b in range(64):
            carry = planes[b][w] ^ (np.uint64(0) - ((query >> np.uint64(b)) & np.uint64(1)))
            for i, c in enumerate(counters):
                counters[i], carry = c ^ carry, c & carry
            over |= carry
            if b % 8 == 7:
                alive = over != FULL
                if not alive.all():
                    q, w, over, query = q[alive], w[alive], over[alive], query[alive]
                    counters = [c[alive] for c in counters]
                    if not len(q):
                        break
        if len(q):
            for i in range(0, len(q), SURVIVORS):
                near = np.unpackbits((~over[i : i + SURVIVORS]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                t, l = np.nonzero(near)
                a, b_ = q[i + t], word_starts[w[i + t]] + l
                keep = b_ > a
                if keep.any():
                    yield a[keep], b_[keep]


def _start(n: int, radius: int) -> list[np.ndarray]:
    """Counters set so that they overflow at radius + 1 differences."""
    bits = radius.bit_length()
    offset = (1 << bits) - 1 - radius
    return [np.full(n, FULL if offset >> i & 1 else 0, dtype=np.uint64) for i in range(bits)]


def spanning_links(nodes: np.ndarray, fps: np.ndarray, starts: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For each row that isn't the first of its local component, a link to that first row.

    label is flat, so a row's label is its root. Only roots are hooked, each to its smallest partner; its other ties stay as
    pairs and are looked at again from the new roots.
    """
    label = np.arange(len(fps))
    for a, b in close_pairs(fps, starts, radius):
        while True:
            a, b = label[a], label[b]
            apart = a != b
            if not apart.any():
                break
            a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
            np.minimum.at(label, a, b)
            while not np.array_equal(label, flat := label[label]):
                label = flat
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return nodes[moved], nodes[label[moved]]


_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("t", pa.int32()), ("key", pa.int64()), ("fp", pa.int64()), ("node", pa.int64())])


def _compare(batches: Iterable[pa.RecordBatch], limit: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (t, key, fp, node) sorted by key: links (a, b) of buckets up to limit, and the rows of larger ones as they are."""
    held: list[np.ndarray] = []  # whole buckets and the open one: rows of (key, fp, node, t)
    passing = None  # the key of a bucket over the limit

    def links(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        sizes = np.diff(np.append(starts, len(rows)))
        kept = np.repeat(sizes > 1, sizes)
        rows = rows[kept]
        if not len(rows):
            return
        starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        a, b = spanning_links(rows[:, 2], rows[:, 1].view(np.uint64), starts)
        if len(a):
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none.cast(pa.int32()), none, none, none], schema=_OUT)

    def over(rows: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(rows[:, 3].astype(np.int32)), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in (0, 1, 2))], schema=_OUT)

    for batch in batches:
        rows = np.column_stack([column(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "fp", "node", "t")])
        if not len(rows):
            continue
        if passing is not None:
            same = rows[:, 0] == passing
            if same.any():
                yield over(rows[same])
                rows = rows[~same]
            if not len(rows):
                continue
            passing = None
        rows = np.concatenate([*held, rows])
        last = rows[-1, 0]
        whole = int(np.searchsorted(rows[:, 0], last)) if (rows[:-1, 0] <= rows[1:, 0]).all() else int(np.flatnonzero(rows[:, 0] != last)[-1]) + 1
        full, held = rows[:whole], [rows[whole:]]
        if len(full):
            if limit:
                starts = np.flatnonzero(np.r_[True, full[1:, 0] != full[:-1, 0]])
                sizes = np.diff(np.append(starts, len(full)))
                large = np.repeat(sizes > limit, sizes)
                if large.any():
                    yield over(full[large])
                    full = full[~large]
            if len(full):
                yield from links(full)
        if limit and len(held[0]) > limit:
            yield over(held[0])
            passing, held = last, []
    if held and len(held[0]):
        yield from links(held[0])


def _masks() -> tuple[list[int], list[list[int]]]:
    """The ten pairs of groups as masks, and for each the twenty triples of six groups of its other bits."""
    edges = np.cumsum((0, *GROUPS))
    group = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(len(GROUPS))]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pairs, finer = [], []
    for i, j in combinations(range(len(GROUPS)), 2):
        mask = group[i] | group[j]
        other = [b for b in range(64) if not mask >> b & 1]
        sixths = [sum(1 << int(b) for b in part) for part in np.array_split(other, 6)]
        pairs.append(signed(mask))
        finer.append([signed(a | b | c) for a, b, c in combinations(sixths, 3)])
    return pairs, finer


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between nodes that span every component of fingerprints at most RADIUS bits apart.

    distinct: (fp, node), each fingerprint once.
    """
    pairs, finer = _masks()
    schema = "a long, b long, t int, key long, fp long, node long"

    def compared(keyed: DataFrame, limit: int | None) -> DataFrame:
        return staged(keyed.select("t", "key", "fp", "node").repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _compare(it, limit), schema), "simhash-links")

    table = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).alias("m")) for t, m in enumerate(pairs)])).alias("g")
    keyed = distinct.select("fp", "node", table).select(F.col("g.t").alias("t"), F.xxhash64("g.t", F.col("fp").bitwiseAND(F.col("g.m"))).alias("key"), "fp", "node")
    out = [compared(keyed, BUCKET)]
    large = out[0].where("node is not null")
    if not large.isEmpty():
        of_table = F.element_at(F.array(*[F.array(*[F.lit(m) for m in row]) for row in finer]), F.col("t") + 1)
        split = large.select("t", "key", "fp", "node", F.explode(of_table).alias("m")).select("t", F.xxhash64("key", "m", F.col("fp").bitwiseAND(F.col("m"))).alias("key"), "fp", "node")
        out.append(compared(split, BUCKET))
        large = out[1].where("node is not null")
        if not large.isEmpty():
            sizes = large.groupBy("key").agg(F.ceil(F.count("*") / BUCKET).alias("k"))
            chunk = F.pmod(F.xxhash64("fp"), F.col("k"))
            against = large.join(sizes, "key").withColumn("c", chunk).select("t", "key", "fp", "node", "c", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("d"))
            out.append(compared(against.select("t", F.xxhash64("key", F.least("c", "d"), F.greatest("c", "d")).alias("key"), "fp", "node"), None))
    found = [x.where("a is not null").select("a", "b") for x in out]
    for x in found[1:]:
        found[0] = found[0].unionByName(x)
    return found[0]


#: Parts that a hub's links are dealt in.
SALTS = 1024


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (a, b) with m, the smallest b of their a.

    A hub's links are reduced where they are, then by (a, part), and meet their minimum part by part: no task ever holds all of
    them, and a node has at most SALTS parts.
    """
    dealt = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    parts = dealt.groupBy("a", "salt").agg(F.min("b").alias("m"))
    least = parts.groupBy("a").agg(F.min("m").alias("m"), F.collect_list("salt").alias("salts")).select("a", "m", F.explode("salts").alias("salt"))
    return dealt.join(least, ["a", "salt"]).drop("salt")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node on a link, the smallest node that it reaches. Nodes may be any orderable type."""
    def oriented(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    edges = staged(oriented(edges), "components")
    seen = None
    while True:
        both = _with_least(edges.union(edges.select("b", "a")))
        large = oriented(both.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")))
        small = _with_least(large)
        ends = F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")
        before, edges = edges, staged(oriented(small.select(ends).select("e.a", "e.b")), "components")
        discard(before)
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 1))")).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, fingerprint, component_id. An empty table gives an empty table.

    A fingerprint that very many documents have is dealt in parts by document, like a hub's links.
    """
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).alias("salt")
    by_doc = staged(fingerprints(docs).withColumn("salt", salt), "simhash-docs")
    parts = by_doc.where("doc_id is not null").groupBy("fp", "salt").agg(F.min("doc_id").cast("long").alias("node"))
    distinct = staged(parts.groupBy("fp").agg(F.min("node").alias("node"), F.collect_list("salt").alias("salts")), "simhash-distinct")
    found = links(distinct.select("fp", "node"))
    star = components(found)
    named = distinct.join(star, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"), F.explode("salts").alias("salt"))
    named = staged(named, "simhash-components")
    joined = by_doc.join(named, ["fp", "salt"], "left")
    return joined.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns as they are, without those that follow another document of their component.

    Of rows that repeat a doc_id and its text one stays; rows without a doc_id stay.
    """
    found = near_duplicates(docs)
    gone = staged(found.where("doc_id <> component_id").select("doc_id").distinct(), "simhash-gone")
    out = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeats = staged(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "simhash-repeats")
    if not repeats.isEmpty():
        once = out.join(repeats, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        out = out.join(repeats, "doc_id", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))
    return out


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
