"""Suffix-array dedup: bytes covered by a WINDOW-byte string that also starts in a document with a smaller doc_id go.

A suffix array of the whole corpus doesn't fit any shard, so suffixes that may match are brought together first, in two
cuts. Each window has an anchor, the GRAM-byte string in it with the smallest hash (the leftmost on ties). It depends on the
window's bytes alone, so equal windows have equal anchors at equal offsets. Neighbouring windows with one anchor form a
region. Regions meet by anchor: of those whose bytes are all the same only the first document's stands for all (the others
are covered where it isn't theirs), and a region whose anchor no other document has holds no match. What is left is open.

An open region's windows reach either SIDE bytes or more to the left of the anchor or SIDE + 1 to the right of its end, so
they are dealt in two parts by the longer string that all windows of a part share. A part whose string only one document
has is dropped; all others are sorted, a shard of parts at a time, by external induced sorting (suffix_sort): neighbours
in suffix order with a common prefix of a whole window are equal windows, and the smallest doc_id among them decides.

Hot keys: a task reduces equal regions before they are shuffled. Anchors that hold over 1 in HOT of a sample's regions
(which only decides how rows are dealt) are keyed by whole windows from the start, and an anchor that over CROWD open
regions share is dealt out by window later, of equal ones a task sends the first only. Repeats within a document follow the
first of them. So no text's popularity fills a task; and a shard that outgrows memory is sorted on disk.

Defined results: null and empty texts keep nothing and lose nothing; texts under WINDOW bytes are kept whole; rows without
a doc_id neither cover nor lose bytes; rows that repeat a doc_id don't cover each other. If they differ in text, each loses
its own spans (they are told apart by a 64-bit hash of the text). An empty table gives an empty table; extra columns stay
out of the way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from popshift.llm.common import column, read, small_batches, staged, text_bytes
from popshift.llm.suffix_sort import Memory, suffixes

WINDOW, GRAM = 50, 16
SIDE = (WINDOW - GRAM) // 2
#: Bytes of a text that are hashed together, also of many short ones; regions that a task reduces together; bytes of a shard.
PIECE, SLICE, REDUCED, SORTED = 1 << 22, 1 << 16, 1 << 18, 1 << 20
#: Share of the regions (one in so many) beyond which an anchor is hot, and documents of the sample; open regions of one
#: anchor beyond which it is dealt out by window.
HOT, SAMPLE, CROWD = 4096, 5_000, 100_000
#: Tuples a sort's queues keep in memory: fewer than a shard has, so shards of any size go the same way through files.
QUEUED = 1 << 17
#: A range of bytes has this bit in its size, a region has its number of windows and its anchor's offset.
BYTES, LONGEST = 1 << 15, 32_000

_POSITION = np.uint64((1 << 24) - 1)
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = [np.uint64(x | 1) for x in np.random.default_rng(21).integers(1 << 61, 1 << 62, 4)]
_SPREAD = [np.uint64(x | 1) for x in np.random.default_rng(22).integers(1 << 61, 1 << 62, 6)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _grams(data: np.ndarray) -> np.ndarray:
    gram, size = _BYTE[data], 1
    for k in _FOLD:
        gram = gram[:-size] * k + gram[size:]
        size *= 2
    return _mix(gram)


def _spread(gram: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes [first, end): GRAM-byte pieces from the front, the last ones moved back to end with the range."""
    out = (end - first).astype(np.uint64)
    for j, k in enumerate(_SPREAD):
        out = _mix(out * k + gram[np.minimum(first + GRAM * j, end - GRAM)])
    return out.view(np.int64)


def _slice_regions(data: np.ndarray, begin: np.ndarray, size: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """regions() of texts that lie one behind another in data."""
    long = size >= WINDOW
    if not long.any():
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    gram = _grams(data)
    low = (gram & ~_POSITION) | np.arange(len(gram), dtype=np.uint64)
    width, covered = WINDOW - GRAM + 1, 1
    while covered < width:
        step = min(covered, width - covered)
        low = np.minimum(low[:-step], low[step:])
        covered += step
    at = (low & _POSITION).astype(np.int32)
    new = np.empty(len(at) + 1, bool)  # the place after the last window ends the last region
    new[0], new[-1] = True, True
    np.not_equal(at[1:], at[:-1], out=new[1:-1])
    stop = np.where(long, begin + size - WINDOW + 1, begin)  # where a text's windows end
    for a, b in zip(stop.tolist(), (begin + size).tolist(), strict=True):
        new[a:b] = False
    new[stop[stop < len(new)]] = True
    new[begin[long]] = True
    first = np.flatnonzero(new)
    n = np.diff(first, append=len(at))
    inside = np.ones(len(new), bool)
    inside[stop[stop < len(new)]] = False
    inside[begin[long]] = True
    real = inside[first] & (first < len(at))
    first, n = first[real], n[real]
    text = np.searchsorted(begin, first, "right") - 1
    anchor = at[first].astype(np.int64)
    h = gram[anchor].view(np.int64)
    c = _spread(gram, first, first + n - 1 + WINDOW)
    offset = anchor - first
    if len(hot):
        k = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
        is_hot = hot[k] == h
        if is_hot.any():  # each window is a region of its own, keyed by all its bytes
            m = n[is_hot]
            windows = np.repeat(first[is_hot], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            own = _spread(gram, windows, windows + WINDOW)
            cold = ~is_hot
            h, c, first, n, offset, text = (
                np.concatenate(x) for x in ((h[cold], own ^ 1), (c[cold], own), (first[cold], windows), (n[cold], np.ones(len(own), np.int64)), (offset[cold], at[windows] - windows), (text[cold], np.repeat(text[is_hot], m)))
            )
    return h, c, first - begin[text], n, offset, text


def regions(data: np.ndarray, begin: np.ndarray, size: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """Regions of texts, one behind another in data: (anchor hash, hash of the region's bytes, first window, number of
    windows, anchor's place in the region, text number)."""
    parts, i = [], 0
    while i < len(size):
        if size[i] > PIECE + WINDOW:
            for a in range(0, int(size[i]) - WINDOW + 1, PIECE):
                n = min(PIECE + WINDOW - 1, int(size[i]) - a)
                h, c, first, n, offset, _ = _slice_regions(data[begin[i] + a : begin[i] + a + n], np.zeros(1, np.int64), np.array([n]), hot)
                parts.append((h, c, first + a, n, offset, np.full(len(h), i)))
            i += 1
            continue
        j, total = i, 0
        while j < len(size) and size[j] <= PIECE + WINDOW and (j == i or total + size[j] <= SLICE):
            total += int(size[j])
            j += 1
        here = slice(i, j)
        *found, text = _slice_regions(data[begin[i] : begin[i] + total], begin[here] - begin[i], size[here], hot)
        parts.append((*found, text + i))
        i = j
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, np.int64) for _ in range(6))


_ROWS = "h long, c long, doc long, tag long, span long"


def _texts(batch: pa.RecordBatch, name: str = "_b") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins, its size) of a binary column."""
    array = column(batch, name)
    wide = pa.types.is_large_binary(array.type)
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at[:-1], np.diff(at)


def _spans(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    """Byte ranges, joined where they meet, as rows of their own key; pieces of at least WINDOW bytes."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order], end[order]
    at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > end[:-1])])  # ends grow with starts
    start, size = start[at], np.maximum.reduceat(end, at) - start[at]
    parts = np.maximum(1, -(-(size - WINDOW) // (LONGEST - WINDOW)))
    k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    doc, tag, start, size = (np.repeat(x, parts) for x in (doc[at], tag[at], start, size))
    start, size = start + k * (LONGEST - WINDOW), np.minimum(LONGEST, size - k * (LONGEST - WINDOW))
    key = _mix(doc.view(np.uint64) * np.uint64(31) + start.view(np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (key, np.zeros(len(key), np.int64), doc, tag, start << 16 | size | BYTES)], names=["h", "c", "doc", "tag", "span"])


def _find(batches: Iterable[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Regions of all texts as (h, c, doc, tag, span): the first document's of a task's equal ones; the others as ranges to
    remove. span: offset, and 16 bits for a region's windows (6) and anchor (6), or for a range's size (BYTES set)."""
    held: list[tuple] = []
    count = 0

    def reduced() -> Iterator[pa.RecordBatch]:
        h, c, span, doc, tag = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((doc, c, h))
        h, c, span, doc, tag = (x[order] for x in (h, c, span, doc, tag))
        new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])]
        again = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        if again.any():
            first = span[again] >> 16
            yield _spans(doc[again], tag[again], first, first + (span[again] & 63) - 1 + WINDOW)
        yield pa.RecordBatch.from_arrays([pa.array(x[~again]) for x in (h, c, doc, tag, span)], names=["h", "c", "doc", "tag", "span"])

    for batch in batches:
        doc, tag = (column(batch, x).to_numpy(zero_copy_only=False) for x in ("doc_id", "_tag"))
        h, c, first, n, offset, text = regions(*_texts(batch), hot)
        held.append((h, c, first << 16 | offset << 6 | n, doc[text], tag[text]))
        count += len(text)
        if count >= REDUCED:
            yield from reduced()
            count = 0
    if count:
        yield from reduced()


_CUT = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("tag", pa.int64()), ("first", pa.int64()), ("bytes", pa.binary()), ("lead", pa.int64())])
_FOUND = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("size", pa.int64()), ("lead", pa.int64())])


def _word_hash(words: np.ndarray, first: np.ndarray, places: list[int]) -> np.ndarray:
    out = np.full(len(first), len(places), np.uint64)
    for k, p in enumerate(places):
        out = _mix(out * _SPREAD[k % 6] + words[first + p])
    return out.view(np.int64)


def _cut_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, tag, bytes, asked) to the parts of the regions asked for: (key, doc, tag, first, bytes, lead).

    Of equal parts a task sends the first of the smallest document. Parts of larger documents are covered: rows without
    bytes and lead. Repeats in the same document follow the one that was sent: rows without bytes that name its first
    window as lead; lead is set in the row that is followed, too.
    """
    for batch in batches:
        data, begin, size = _texts(batch)
        data = np.append(data, np.zeros(8, np.uint8))
        words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        asked = column(batch, "_asked")
        per = np.diff(np.asarray(asked.offsets))
        flat = asked.flatten()
        c, first, n, offset, crowded = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("c", "first", "n", "offset", "crowded"))
        row = np.repeat(np.arange(len(per)), per)
        base = begin[row] + first
        anchor = base + offset
        plain = crowded == 0
        left = np.where(plain, np.clip(offset - SIDE + 1, 0, n), 0)
        # (row, first window's place in data, windows, key, what tells equal parts)
        i = np.flatnonzero(plain & (left > 0))
        j = np.flatnonzero(plain & (left < n))
        x = np.flatnonzero(~plain)
        key_i = _word_hash(words, anchor[i] - SIDE, [0, 8, 16, 24, SIDE + GRAM - 8])
        key_j = _word_hash(words, anchor[j], [0, 8, 16, 24, SIDE + 1 + GRAM - 8])
        windows = np.repeat(base[x], n[x]) + np.arange(n[x].sum()) - np.repeat(np.cumsum(n[x]) - n[x], n[x])
        key_x = _word_hash(words, windows, [0, 8, 16, 24, 32, 40, WINDOW - 8])
        of = np.concatenate([row[i], row[j], np.repeat(row[x], n[x])])
        at = np.concatenate([base[i], base[j] + left[j], windows])
        count = np.concatenate([left[i], n[j] - left[j], np.ones(len(windows), np.int64)])
        key = np.concatenate([key_i, key_j, key_x])
        same = np.concatenate([c[i] ^ key_i, c[j] ^ key_j, key_x])
        doc, tag = (column(batch, y).to_numpy()[of].astype(np.int64) for y in ("doc_id", "_tag"))
        yield from _folded(key, same, doc, tag, at - begin[of], at, count, data)


def _folded(key, same, doc, tag, first, at, count, data) -> Iterator[pa.RecordBatch]:
    order = np.lexsort((first, tag, doc, same))
    new = np.r_[True, same[order][1:] != same[order][:-1]] if len(order) else np.zeros(0, bool)
    heads = np.flatnonzero(new)[np.cumsum(new) - 1]
    over = doc[order] > doc[order[heads]] if len(order) else new
    whose = new | np.r_[True, tag[order][1:] != tag[order][:-1]] if len(order) else new  # rows that repeat a doc_id lead their own
    leader = np.flatnonzero(whose)[np.cumsum(whose) - 1]
    follows = ~over & ~whose
    sent = order[~over & whose]
    led = np.zeros(len(key), bool)
    led[order[leader[follows]]] = True
    rest = order[over | follows]
    lead = np.full(len(key), -1, np.int64)
    lead[order[follows]] = first[order[leader[follows]]]
    lead[led] = first[led]
    for a in range(0, len(sent), 50_000):
        k = sent[a : a + 50_000]
        length = count[k] - 1 + WINDOW
        edges = np.append(0, np.cumsum(length))
        picked = data[np.repeat(at[k] - edges[:-1], length) + np.arange(edges[-1])]
        cut = pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(picked)])
        yield pa.RecordBatch.from_arrays([pa.array(key[k]), pa.array(doc[k]), pa.array(tag[k]), pa.array(first[k]), cut, pa.array(lead[k], mask=~led[k])], schema=_CUT)
    for a in range(0, len(rest), 50_000):
        k = rest[a : a + 50_000]
        # The key spreads rows that aren't sorted; count goes in its place, as they have no bytes.
        yield pa.RecordBatch.from_arrays([pa.array(key[k] ^ first[k]), pa.array(doc[k]), pa.array(tag[k]), pa.array(first[k] << 16 | count[k]), pa.nulls(len(k), pa.binary()), pa.array(lead[k], mask=lead[k] < 0)], schema=_CUT)


class _Shard:
    """Parts that are sorted together, kept in pieces until then."""

    def __init__(self):
        self.pieces: list[tuple] = []
        self.bytes = 0

    def add(self, rows: pa.RecordBatch | pa.Table) -> None:
        data, begin, size = _texts(rows, "bytes")
        ends = begin - begin[0] + size + np.arange(1, len(size) + 1)
        t = np.zeros(int(size.sum()) + len(size), np.uint16)
        letter = np.ones(len(t), bool)
        letter[ends - 1] = False
        t[letter] = data[begin[0] : begin[0] + int(size.sum())].astype(np.uint16) + 1
        doc, tag, first = (column(rows, x).to_numpy().astype(np.int64) for x in ("doc", "tag", "first"))
        self.pieces.append((t, size + 1, doc, tag, first, column(rows, "lead").is_valid().to_numpy(zero_copy_only=False)))
        self.bytes += len(t)

    def covered(self, mem: Memory) -> Iterator[pa.RecordBatch]:
        """Ranges (doc, tag, start, size) that a smaller doc_id covers; once more with lead for parts that others follow."""
        def joined(i: int, kind: type) -> np.ndarray:
            out, done = mem.empty(sum(len(p[i]) for p in self.pieces), kind), 0
            for p in self.pieces:
                out[done : done + len(p[i])] = p[i]
                done += len(p[i])
            return out

        t, size, doc, tag, first, led = (joined(i, kind) for i, kind in enumerate((np.uint16, np.int64, np.int64, np.int64, np.int64, bool)))
        self.pieces, self.bytes = [], 0
        ends = np.cumsum(size)
        row_of = mem.empty(len(t), np.int32)
        for at in mem.blocks(len(size)):
            a = int(ends[at.start] - size[at.start])
            row_of[a : int(ends[at.stop - 1])] = np.repeat(np.arange(at.start, at.stop, dtype=np.int32), size[at])
        order, least = mem.empty(len(t), np.int64), mem.empty(len(t), np.int64)
        fresh = mem.empty(len(t), bool)
        done, classes = 0, 0
        for pos, shared in suffixes(t, mem, WINDOW):
            row = row_of[pos]
            fits = pos + WINDOW < ends[row]
            pos, row, new = pos[fits], row[fits], shared[fits] < WINDOW
            if not len(pos):
                continue
            new[0] |= not classes
            docs = doc[row]
            begins = np.flatnonzero(np.r_[True, new[1:]])
            smallest = np.minimum.reduceat(docs, begins)
            if not new[0]:
                least[classes - 1] = min(least[classes - 1], smallest[0])
                begins, smallest = begins[1:], smallest[1:]
            least[classes : classes + len(begins)] = smallest
            classes += len(begins)
            order[done : done + len(pos)], fresh[done : done + len(pos)] = pos, new
            done += len(pos)
        gone = mem.empty(len(t), bool)
        for at in mem.blocks(len(t)):
            gone[at] = False
        before = -1
        for at in mem.blocks(done):
            numbers = before + np.cumsum(fresh[at])
            before = int(numbers[-1])
            pos = order[at]
            gone[pos[doc[row_of[pos]] > least[numbers]]] = True
        for at in mem.blocks(len(t)):
            pos = np.flatnonzero(gone[at]) + at.start
            if not len(pos):
                continue
            row = row_of[pos]
            begins = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (pos[1:] > pos[:-1] + WINDOW)])
            row, a, b = row[begins], pos[begins], np.append(pos[begins[1:] - 1], pos[-1])
            start = first[row] + a - (ends[row] - size[row])
            parts = [pa.array(x) for x in (doc[row], tag[row], start, b - a + WINDOW)]
            yield pa.RecordBatch.from_arrays([*parts, pa.nulls(len(row), pa.int64())], schema=_FOUND)
            if led[row].any():
                keep = pa.array(led[row])
                yield pa.RecordBatch.from_arrays([*parts, pa.array(first[row])], schema=_FOUND).filter(keep)


def _sort_shard(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _cut_out sorted by key to ranges (doc, tag, start, size) that a smaller doc_id covers, and to followers.

    A follower has its first window as start, its number of windows as -size, and its leader's first window as lead. Keys
    of one document are dropped. A shard is closed between keys, so all parts that may match are in it.
    """
    shard, mem = _Shard(), Memory(queues=QUEUED)
    waiting: list[pa.RecordBatch] = []  # rows of the last key so far
    several = False  # whether the last key has more than one document and its earlier rows are in the shard
    last_key = None

    def settle(table: pa.Table, last_open: bool) -> pa.Table | None:
        """Adds the parts of keys with several documents to the shard; the last key's rows come back while it's open."""
        nonlocal several
        table = table.combine_chunks()
        rows = table.to_batches()[0]
        key, doc = column(rows, "key").to_numpy(), column(rows, "doc").to_numpy()
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        mixed = np.minimum.reduceat(doc, begins) != np.maximum.reduceat(doc, begins)
        mixed[0] |= several
        keep = np.repeat(mixed, np.diff(begins, append=len(key)))
        rest = None
        several = bool(mixed[-1]) and last_open
        if last_open and not mixed[-1]:
            keep[begins[-1] :] = False
            rest = rows.slice(int(begins[-1]))
        if keep.any():
            shard.add(rows.filter(pa.array(keep)))
        return rest

    for batch in batches:
        plain = column(batch, "bytes").is_null()
        rest = batch.filter(plain)
        if rest.num_rows:
            packed = column(rest, "first").to_numpy()
            start, n, led = packed >> 16, packed & 0xFFFF, column(rest, "lead").is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([column(rest, "doc"), column(rest, "tag"), pa.array(start), pa.array(np.where(led, -n, n - 1 + WINDOW)), column(rest, "lead")], schema=_FOUND)
            batch = batch.filter(column(batch, "bytes").is_valid())
        if not batch.num_rows:
            continue
        keys = column(batch, "key").to_numpy()
        if keys[0] != last_key:
            waiting, several = [], False
        if shard.bytes >= SORTED:
            if keys[0] == last_key and keys[-1] != last_key:  # what belongs to the open key goes with this shard
                cut = int(np.flatnonzero(keys != last_key)[0])
                settle(pa.Table.from_batches([*waiting, batch.slice(0, cut)]), False)
                waiting, several, batch, last_key = [], False, batch.slice(cut), None
            if keys[0] != last_key:
                yield from shard.covered(mem)
        last_key = keys[-1]
        back = settle(pa.Table.from_batches([*waiting, batch]), True)
        waiting = [back] if back is not None else []
    if shard.bytes:
        yield from shard.covered(mem)


def _twins(docs: DataFrame) -> DataFrame | None:
    """doc_ids whose rows differ in text; None if there are none."""
    hashed = text_bytes(docs, "doc_id").where("doc_id is not null").select("doc_id", F.xxhash64("_b").alias("_hash"))
    found = hashed.groupBy("doc_id").agg(F.min("_hash").alias("a"), F.max("_hash").alias("b")).where("a != b")
    found = staged(found.select("doc_id", F.lit(True).alias("_twin")), "suffix-twins")
    return None if found.isEmpty() else found


def _tagged(rows: DataFrame, twins: DataFrame | None, text: str) -> DataFrame:
    """rows with _tag: 0, or a hash of the text where rows of one doc_id differ in text."""
    if twins is None:
        return rows.withColumn("_tag", F.lit(0).cast("long"))
    return rows.join(twins, "doc_id", "left").withColumn("_tag", F.when(F.col("_twin"), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))).drop("_twin")


def hot_anchors(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of anchors that hold over 1 in HOT of the regions of about SAMPLE documents, so at most HOT of them."""
    total = texts.count()
    if not total:
        return np.zeros(0, np.int64)
    drawn = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / total)))
    none = np.zeros(0, np.int64)
    counted = drawn.mapInArrow(lambda batches: _find(batches, none), _ROWS).where(F.col("span").bitwiseAND(F.lit(BYTES)) == 0).groupBy("h").agg(F.count("*").alias("n"))
    rows = counted.agg(F.sum("n")).first()[0] or 0
    return np.sort(np.array([r["h"] for r in counted.where(F.col("n") > max(rows / HOT, 64)).select("h").collect()], np.int64))


def covered(tagged: DataFrame) -> DataFrame:
    """Ranges (doc, tag, start, size) of bytes that windows of documents with smaller ids cover; ranges may overlap."""
    small_batches(tagged.sparkSession)
    texts = tagged.where("doc_id is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    hot = hot_anchors(texts)
    found = texts.mapInArrow(lambda batches: _find(batches, hot), _ROWS)
    equal, anchor = Window.partitionBy("h", "c"), Window.partitionBy("h")
    low = F.col("span").bitwiseAND(F.lit(0xFFFF))
    met = found.withColumn("least", F.min("doc").over(equal))
    met = met.withColumns({"c0": F.min("c").over(anchor), "c1": F.max("c").over(anchor), "d0": F.min("doc").over(anchor), "d1": F.max("doc").over(anchor), "crowd": F.count("*").over(anchor)})
    known = (low >= BYTES) | (F.col("doc") > F.col("least"))
    met = met.where(known | ((F.col("c0") != F.col("c1")) & (F.col("d0") != F.col("d1"))))
    size = F.when(low >= BYTES, low - BYTES).otherwise(low.bitwiseAND(F.lit(63)) - 1 + WINDOW)
    met = met.select("doc", "tag", F.shiftright("span", 16).alias("start"), size.alias("size"), F.when(~known, F.col("c")).alias("c"), F.when(~known, F.shiftright(low, 6)).alias("offset"), (F.col("crowd") > CROWD).alias("crowded"))
    met = staged(met, "suffix-regions")
    open_ = met.where("c is not null").groupBy("doc", "tag").agg(F.collect_list(F.struct("c", F.col("start").alias("first"), (F.col("size") + 1 - WINDOW).alias("n"), "offset", "crowded")).alias("_asked"))
    asked = texts.join(open_, (texts["doc_id"] == open_["doc"]) & (texts["_tag"] == open_["tag"])).select("doc_id", "_tag", "_b", "_asked")
    cut = asked.mapInArrow(_cut_out, "key long, doc long, tag long, first long, bytes binary, lead long")
    shards = cut.repartition("key").sortWithinPartitions("key").mapInArrow(_sort_shard, "doc long, tag long, start long, size long, lead long")
    sorted_ = staged(shards, "suffix-sorted")
    leaders = sorted_.where("size > 0 and lead is not null").select("doc", "tag", "lead", (F.col("start") - F.col("lead")).alias("by"), F.col("size").alias("bytes"))
    following = sorted_.where("size < 0").drop("size").join(leaders, ["doc", "tag", "lead"]).select("doc", "tag", (F.col("start") + F.col("by")).alias("start"), F.col("bytes").alias("size"))
    parts = [met.where("c is null"), sorted_.where("size > 0 and lead is null"), following]
    return reduce(DataFrame.unionByName, [x.select("doc", "tag", "start", "size") for x in parts])


def _with_ranges(tagged: DataFrame, rows: DataFrame) -> DataFrame:
    """rows (doc_id, _tag, ...) with the ranges to remove from each row's text, or null, as _gone."""
    gone = covered(tagged).groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "size")).alias("_gone"))
    return rows.join(gone, (rows["doc_id"] == gone["doc"]) & (rows["_tag"] == gone["tag"]), "left")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs with the covered bytes cut from text (characters cut in half go), n_chars as it is then.

    Null texts stay null, empty ones empty; rows without a doc_id stay as they are; repeated rows stay one row each and
    don't cut each other; an empty table stays empty; all columns of docs, whatever their names, come back.
    """
    twins = _twins(docs)
    texts = _tagged(text_bytes(docs, "doc_id"), twins, "_b")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_b"), F.struct(*docs.columns).alias("_row"))
    joined = _with_ranges(texts, _tagged(rows, twins, "_b")).select("_row", "_gone")
    schema = docs.schema

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = list(column(batch, "_row").flatten())
            texts = []
            i = schema.names.index("text")
            for text, gone in zip(arrays[i].to_pylist(), column(batch, "_gone"), strict=True):
                runs = _joined(gone)
                if runs:
                    raw, edges = text.encode(), [0, *(x for run in runs for x in run), None]
                    text = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode("utf-8", "ignore")
                texts.append(text)
            arrays[i] = pa.array(texts, arrays[i].type)
            if "n_chars" in schema.names:
                k = schema.names.index("n_chars")
                arrays[k] = pa.array([None if t is None else len(t) for t in texts], arrays[k].type)
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return joined.mapInArrow(apply, schema)


def dedup(docs: DataFrame, keep: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with keep, also kept (the remaining bytes)."""
    tagged = _tagged(text_bytes(docs, "doc_id"), _twins(docs), "_b")
    joined = _with_ranges(tagged, tagged).select("doc_id", "_b", "_gone")

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, spans, sha, kept_ = [], [], [], [], []
            for text, gone_ in zip(column(batch, "_b").to_pylist(), column(batch, "_gone"), strict=True):
                kept, cuts, at = [], 0, 0
                for a, b in _joined(gone_):
                    kept.append(text[at:a])
                    cuts, at = cuts + 1, b
                kept.append(text[at:])
                left = b"".join(kept)
                n.append(len(text)), removed.append(len(text) - len(left)), spans.append(cuts), sha.append(hashlib.sha256(left).hexdigest())
                if keep:
                    kept_.append(left)
            arrays = [column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep:
                arrays, names = [*arrays, pa.array(kept_, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return joined.mapInArrow(apply, f"doc_id {joined.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep)


def _joined(gone: pa.Scalar) -> list[tuple[int, int]]:
    if not gone.is_valid:
        return []
    of = gone.values
    start = of.field("start").to_numpy().astype(np.int64)
    end = start + of.field("size").to_numpy()
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    at = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
    return list(zip(start[at].tolist(), np.maximum.reduceat(end, at).tolist(), strict=True))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(read(spark, sf_dir, "documents"))
