"""Cross-tokenizer alignment with external spill counting.

Two tokenizers cut the same bytes; where tokens of both end at one offset a group ends, and all token occurrences of the two
sides in a group are linked. A linked id pair counts the documents that hold it. The counting is external:

1. `spill`: a task encodes documents until it holds RECORDS (pair, document) records, a portion. It sorts them by pair and
   document, parts them by the radix of their A id's hash, and writes each part as a zstd run: the pairs with their number of
   documents, apart from the documents and multiplicities behind them. Runs are rows of a table in the shared folder.
2. `totals`: the runs' pairs (the other columns aren't read) are merged by a k-way heap merge of at most FAN_IN runs a time, in
   rounds until a radix is one run. A portion holds a pair once, however many documents have it, so a pair that everyone has is
   no larger than any other. The order is side-major, all pairs of an A id together, so the last merge also sees each A id's
   highest count.
3. `contributions`: runs meet their radix's totals, at most FAN_IN runs a time, and stream back for each document of their
   portion the sum of counts and the number of best links. A portion's contributions are added up beside its documents.

Text is encoded by chunks: white space and what follows it, and signs behind a word. Neither tokenizer joins bytes across a
chunk's start (pieces of B are checked for it), so groups don't either, and what was found for a chunk is remembered.

Defined results: texts that are null, empty, or don't come back from both tokenizers byte by byte have no tokens: zeros and an
empty groups_sha256. Each row is a document of its own, so repeated rows, ties and rows without a doc_id count each and get one
row each. An empty table gives an empty table. A very long text is one document, whose records are its distinct pairs. Other
columns aren't read.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from popshift.llm.bpe import byte_characters
from popshift.llm.common import column, discard, read, small_batches, staged

#: Records of a portion; a document's own are never parted, so a portion may be larger by one document.
RECORDS = 1 << 20
#: Parts of a portion by A id. A radix's totals are in memory together: 1/RADIX of all distinct pairs that occur.
RADIX = 64
#: Runs that are merged at once.
FAN_IN = 256
#: Chunks that a worker remembers, and their characters.
REMEMBERED, CHARACTERS = 700_000, 32_000_000
#: Links of a group beyond which its distinct pairs are counted instead of all being written out.
LARGE = 4096
#: Letters behind which a sign starts a chunk.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A pair is A id << SHIFT | B id.
SHIFT = 20
#: Bits of a document's number in its portion; records of a portion have 36.
PER_PORTION = 16
_BLOCK = 1 << 14


# --- encoding ---


class Aligner:
    """Both tokenizers, and what they made of each chunk."""

    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        chars = {c: k for k, c in enumerate(byte_characters())}
        a_bytes = {i: bytes(chars[c] for c in t) if all(c in chars for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in of], np.int64) for of in (self.a_bytes, self.b_bytes))
        if any("\n" in p for p in pieces):
            raise ValueError("a piece of the second tokenizer holds a line feed")
        self.lead = [self.b.piece_to_id("▁"), self.b.piece_to_id("<0x0A>")]
        # A chunk starts at white space behind something else, or at a sign behind a letter, where no piece goes on.
        plain = [p for i, p in enumerate(pieces) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        spaces = "".join(c for c in " \n\t" if not any(re.search(rf"[^\s▁]{'▁' if c == ' ' else c}", p) for p in pieces))
        signs = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and not any(re.search(f"[{LETTERS}]{re.escape(c)}", p) for p in plain))
        sign = f"(?![{re.escape(signs)}])" if signs else ""
        body = rf"(?:[^\s{LETTERS}]*+[{LETTERS}]++{sign})*+[^\s{LETTERS}]*+[{LETTERS}]*+"
        self.chunks = re.compile(rf"(?:\s+|(?=\S)){body}(?:[^\S{spaces}]\s*{body})*").findall
        self.a_names, self.b_names = [f"{i}|" for i in range(len(self.a_bytes))], [str(i) for i in range(len(self.b_bytes))]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.size = 0
        #: Of each chunk n_a, n_b, n_groups, n_links, whether both tokenizers give it back, and where its pairs start and end.
        self.stats = _Rows(7)
        self.pairs = _Rows(2)  #: (pair, times)

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The chunks of each text, by number."""
        if len(self.known) > REMEMBERED or self.size > CHARACTERS:
            self.forget()
        split = [self.chunks(" " + t) for t in texts]
        new = list({c: None for parts in split for c in parts if c not in self.known})
        for k in range(0, len(new), 20_000):
            self._learn(new[k : k + 20_000])
        get = self.known.__getitem__
        return [np.fromiter(map(get, parts), np.int64, len(parts)) for parts in split]

    def _learn(self, chunks: list[str]) -> None:
        n = len(chunks)
        raw = [c.encode() for c in chunks]
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        # B puts a space before what it is given; other chunks are given behind a line feed, and both go again.
        spaced = [c[0] == " " and len(c) > 1 for c in chunks]
        b = self.b.encode([c[1:] if has else "\n" + c for c, has in zip(chunks, spaced, strict=True)], num_threads=1)
        for k, has in enumerate(spaced):
            if not has:
                if b[k][:2] != self.lead:
                    raise ValueError("the second tokenizer joins something with a line feed")
                del b[k][:2]
        counts_a, counts_b, sizes = (np.fromiter(map(len, x), np.int64, n) for x in (a, b, raw))
        flat_a, flat_b = (np.fromiter(chain.from_iterable(x), np.int64, int(many.sum())) for x, many in ((a, counts_a), (b, counts_b)))
        of_a, of_b = np.repeat(np.arange(n), counts_a), np.repeat(np.arange(n), counts_b)
        fine, whole = np.ones(n, bool), b"".join(raw)
        for ids, of, many, names, size in ((flat_a, of_a, counts_a, self.a_bytes, self.a_size), (flat_b, of_b, counts_b, self.b_bytes, self.b_size)):
            fine &= np.bincount(of, size[ids], n).astype(np.int64) == sizes
            if b"".join([names[i] for i in ids.tolist()]) != whole:
                ends = np.cumsum(many)
                for k in range(n):
                    fine[k] &= b"".join([names[i] for i in ids[ends[k] - many[k] : ends[k]].tolist()]) == raw[k]
        keep_a, keep_b = fine[of_a], fine[of_b]
        flat_a, of_a, flat_b, of_b = flat_a[keep_a], of_a[keep_a], flat_b[keep_b], of_b[keep_b]
        # Offsets in the row of all chunks that are fine; each chunk's last offset ends a token of both.
        ends_a, ends_b = np.cumsum(self.a_size[flat_a]), np.cumsum(self.b_size[flat_b])
        cuts = ends_a[np.isin(ends_a, ends_b, assume_unique=True)]
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        in_a, in_b = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
        chunk_of = np.zeros(len(cuts), np.int64)
        chunk_of[group_a] = of_a
        links = in_a * in_b
        from_a, from_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        self._texts(n, flat_a.tolist(), flat_b.tolist(), in_a, in_b, from_a, from_b, chunk_of)
        # All pairs of a group; of a very large group, a long row of tokens without a common end, the few distinct ones.
        large = links > LARGE
        made = np.where(large, 0, links)
        g = np.repeat(np.arange(len(cuts)), made)
        at = np.arange(len(g)) - np.repeat(np.cumsum(made) - made, made)
        pairs = flat_a[from_a[g] + at // in_b[g]] << SHIFT | flat_b[from_b[g] + at % in_b[g]]
        times, of = np.ones(len(pairs), np.int64), chunk_of[g]
        for k in np.flatnonzero(large):
            (xs, cx), (ys, cy) = (np.unique(flat[lo : lo + many], return_counts=True) for flat, lo, many in ((flat_a, from_a[k], in_a[k]), (flat_b, from_b[k], in_b[k])))
            pairs = np.concatenate([pairs, (xs[:, None] << SHIFT | ys[None]).ravel()])
            times = np.concatenate([times, (cx[:, None] * cy[None]).ravel()])
            of = np.concatenate([of, np.full(len(xs) * len(ys), chunk_of[k])])
        if large.any():
            order = np.argsort(of, kind="stable")
            pairs, times, of = pairs[order], times[order], of[order]
        each = np.bincount(of, minlength=n)
        first = self.pairs.n + np.cumsum(each) - each
        self.known.update(zip(chunks, range(len(self.known), len(self.known) + n), strict=True))
        self.size += sum(map(len, chunks))
        self.stats.add(np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n), np.bincount(chunk_of, minlength=n), np.bincount(chunk_of, links, n).astype(np.int64), fine, first, first + each)
        self.pairs.add(pairs, times)

    def _texts(self, n: int, ids_a: list[int], ids_b: list[int], in_a: np.ndarray, in_b: np.ndarray, from_a: np.ndarray, from_b: np.ndarray, chunk_of: np.ndarray) -> None:
        """The groups of each chunk, written out."""
        name_a, name_b = self.a_names, self.b_names
        said = []
        for k, m, x, y in zip(in_a.tolist(), in_b.tolist(), from_a.tolist(), from_b.tolist(), strict=True):
            if k == 1:
                left = name_a[ids_a[x]]
            else:
                left = ",".join(map(str, ids_a[x : x + k])) + "|"
            said.append(left + name_b[ids_b[y]] if m == 1 else left + ",".join([name_b[i] for i in ids_b[y : y + m]]))
        bounds = np.searchsorted(chunk_of, np.arange(n + 1)).tolist()
        self.texts += [";".join(said[lo:hi]) for lo, hi in zip(bounds, bounds[1:], strict=False)]


class _Rows:
    """Columns of whole numbers that grow."""

    def __init__(self, width: int):
        self.data, self.n = np.zeros((width, 1 << 10), np.int64), 0

    def add(self, *columns: np.ndarray) -> None:
        more = len(columns[0])
        if self.n + more > self.data.shape[1]:
            self.data = np.concatenate([self.data, np.zeros((len(self.data), max(more, self.data.shape[1] // 2)), np.int64)], axis=1)
        for row, column in zip(self.data, columns, strict=True):
            row[self.n : self.n + more] = column
        self.n += more


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_file: str, b_file: str) -> Aligner:
    """One for each worker process, with what it remembers."""
    key = (a_file, b_file)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


# --- runs ---


def pack(values: np.ndarray, kind: str, delta: bool = False) -> bytes:
    values = np.diff(values, prepend=0) if delta else values
    return zstandard.ZstdCompressor(level=1).compress(values.astype(kind).tobytes())


def unpack(data: bytes, kind: str, delta: bool = False) -> np.ndarray:
    values = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind).astype(np.int64)
    return np.cumsum(values) if delta else values


def radix_of(pairs: np.ndarray, radix: int) -> np.ndarray:
    """By a hash of the A id, so that all pairs of one are in one radix."""
    return ((pairs >> SHIFT) * 2654435761 % (1 << 32)) * radix >> 32


def runs_of(docs: np.ndarray, pairs: np.ndarray, times: np.ndarray, radix: int) -> Iterator[tuple[int, bytes, bytes, bytes, bytes]]:
    """A portion's records as one run for each radix that has some: (radix, pairs, documents of each pair, documents, times)."""
    groups, where = np.unique(pairs, return_inverse=True)  # by number, pair and document fit one word
    order = np.argsort(radix_of(groups, radix)[where] << 52 | where << PER_PORTION | docs)
    docs, pairs, times = docs[order], pairs[order], times[order]
    new = np.flatnonzero((np.diff(pairs, prepend=-1) != 0) | (np.diff(docs, prepend=-1) != 0))
    docs, pairs, times = docs[new], pairs[new], np.add.reduceat(times, new) if len(new) else times[:0]
    which = radix_of(pairs, radix)
    bounds = np.searchsorted(which, np.arange(radix + 1))
    for k in range(radix):
        lo, hi = bounds[k], bounds[k + 1]
        if lo == hi:
            continue
        first = np.flatnonzero(np.diff(pairs[lo:hi], prepend=-1))
        each = np.diff(first, append=hi - lo)
        # times below 2^63 need 8 bytes at the most; zstd makes little of the zeros
        yield k, pack(pairs[lo:hi][first], "<i8", True), pack(each, "<i8"), pack(docs[lo:hi], "<i4", True), pack(times[lo:hi], "<i8")


class Run:
    """A sorted run of (pair, count), read block by block."""

    def __init__(self, pairs: bytes, counts: bytes):
        self.readers, self.last = [zstandard.ZstdDecompressor().stream_reader(x) for x in (pairs, counts)], 0
        self.pairs = self.counts = np.zeros(0, np.int64)

    def more(self) -> bool:
        """Reads the next block; whether there is one."""
        size = 8 * _BLOCK
        steps, counts = (np.frombuffer(r.read(size) or b"", "<i8") for r in self.readers)
        if not len(steps):
            return False
        self.pairs, self.counts = self.last + np.cumsum(steps), counts
        self.last = int(self.pairs[-1])
        return True

    def take(self, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """What is not above the bound goes out of the block."""
        k = int(np.searchsorted(self.pairs, bound, "right"))
        out = self.pairs[:k], self.counts[:k]
        self.pairs, self.counts = self.pairs[k:], self.counts[k:]
        return out


def merged(runs: Iterable[tuple[bytes, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """K-way merge: (pairs, summed counts) in order, a portion a time. The heap holds the last pair of each run's block; the
    smallest of them bounds what is complete in all blocks, so one block of each run is in memory."""
    open_: dict[int, Run] = {k: run for k, run in enumerate(Run(*r) for r in runs) if run.more()}
    heap = [(int(run.pairs[-1]), k) for k, run in open_.items()]
    heapq.heapify(heap)
    while heap:
        bound = heap[0][0]
        parts = [run.take(bound) for run in open_.values()]
        while heap and heap[0][0] == bound:
            _, k = heapq.heappop(heap)
            if open_[k].more():
                heapq.heappush(heap, (int(open_[k].pairs[-1]), k))
            else:
                del open_[k]
        pairs, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, where, np.concatenate([c for _, c in parts]))
        yield pairs, counts


def best_of(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which pairs have their A id's highest count: pairs are side-major, so an A id's are neighbours."""
    if not len(pairs):
        return np.zeros(0, bool)
    first = np.flatnonzero(np.diff(pairs >> SHIFT, prepend=-1))
    return counts == np.repeat(np.maximum.reduceat(counts, first), np.diff(first, append=len(pairs)))


# --- the three steps ---

_KINDS = {"portion": "long", "radix": "int", "pairs": "binary", "each": "binary", "docs": "binary", "times": "binary", "n_a": "binary", "n_b": "binary", "n_groups": "binary", "n_links": "binary"}


def spill(docs: DataFrame, a_file: str, b_file: str, radix: int = RADIX, records: int = RECORDS) -> DataFrame:
    """Rows of a portion: its runs, by radix, and one of radix -1 with its documents' ids, numbers and digests."""
    small_batches(docs.sparkSession)
    df = docs.select("doc_id", F.col("text").alias("_t"))
    id_kind = df.schema["doc_id"].dataType.simpleString()
    names = [*_KINDS, "ids", "shas"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        known = aligner(a_file, b_file)
        ids: list[pa.Array] = []
        stats: list[tuple[int, int, int, int]] = []
        shas: list[str] = []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            portion = task << 32 | number
            docs_, pairs, times = (np.concatenate([h[k] for h in held]) if held else np.zeros(0, np.int64) for k in range(3))
            whole = pa.concat_arrays(ids)
            rows = [{"portion": portion, "radix": -1, "shas": shas, "ids": None} | {n: pack(np.array([s[k] for s in stats]), "<i8") for k, n in enumerate(("n_a", "n_b", "n_groups", "n_links"))}]
            rows += [dict(zip(("radix", "pairs", "each", "docs", "times"), r, strict=True)) | {"portion": portion} for r in runs_of(docs_, pairs, times, radix)]
            arrays = [pa.array([r.get(n) for r in rows], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[kind]) for n, kind in _KINDS.items()]
            offsets = pa.array([0] + [len(whole)] * len(rows), pa.int32())
            id_lists = pa.ListArray.from_arrays(offsets, whole)
            yield pa.RecordBatch.from_arrays([*arrays, id_lists, pa.array([r.get("shas") for r in rows], pa.list_(pa.string()))], names=names)

        for batch in batches:
            given = column(batch, "doc_id")
            texts = column(batch, "_t")
            for lo in range(0, len(batch), 64):
                some = [t.as_py() for t in texts[lo : lo + 64]]
                split = iter(known.numbers([t for t in some if t]))
                for k, t in enumerate(some):
                    doc = len(stats)
                    ids.append(given[lo + k : lo + k + 1])
                    found = _document(known, next(split)) if t else None
                    if found is None:
                        stats.append((0, 0, 0, 0)), shas.append("")
                        continue
                    stats.append(found[0]), shas.append(found[1])
                    held.append((np.full(len(found[2]), doc, np.int64), found[2], found[3]))
                    size += len(found[2])
                if size >= records or len(stats) >= (1 << PER_PORTION) - 64:
                    yield from out()
                    number, size, ids, stats, shas, held = number + 1, 0, [], [], [], []
        if stats:
            yield from out()

    schema = ", ".join(f"{n} {kind}" for n, kind in _KINDS.items()) + f", ids array<{id_kind}>, shas array<string>"
    return df.mapInArrow(run, schema)


def _document(known: Aligner, chunks: np.ndarray) -> tuple[tuple[int, ...], str, np.ndarray, np.ndarray] | None:
    """((n_a, n_b, n_groups, n_links), digest of the groups, pairs, times); a pair may stand there several times."""
    numbers, counts = np.unique(chunks, return_counts=True)
    stats = known.stats.data[:, numbers]
    if not stats[4].all():
        return None
    texts = known.texts
    sha = hashlib.sha256(";".join([texts[c] for c in chunks.tolist()]).encode()).hexdigest()
    each = stats[6] - stats[5]
    at = np.arange(each.sum()) + np.repeat(stats[5] - (np.cumsum(each) - each), each)
    return tuple((stats[:4] @ counts).tolist()), sha, known.pairs.data[0, at], known.pairs.data[1, at] * np.repeat(counts, each)


def _merge_group(table: pa.Table, last: bool) -> tuple[bytes, bytes, bytes | None]:
    runs = [(p.as_py(), c.as_py()) for p, c in zip(table["pairs"], table["each"], strict=True)]
    parts = list(merged(runs))
    pairs, counts = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(2))
    return pack(pairs, "<i8", True), pack(counts, "<i8"), pack(best_of(pairs, counts), "<i1") if last else None


def totals(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(radix, pairs, each, best): of each radix one run with the pairs' numbers of documents, and whether it is the A id's
    highest."""
    df = runs.where("radix >= 0").select("radix", F.xxhash64("portion").alias("at"), "pairs", "each")
    most = df.groupBy("radix").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = -(-most // fan_in)
    written = None
    while parts > 1:
        df = df.withColumn("part", F.pmod("at", F.lit(parts)).cast("long"))

        def some(key: tuple, table: pa.Table) -> pa.Table:
            pairs, each, _ = _merge_group(table, False)
            return pa.table({"radix": pa.array([key[0].as_py()], pa.int32()), "at": pa.array([key[1].as_py()], pa.int64()), "pairs": pa.array([pairs], pa.binary()), "each": pa.array([each], pa.binary())})

        before, written = written, staged(df.groupBy("radix", "part").applyInArrow(some, "radix int, at long, pairs binary, each binary"), "align-merged")
        if before is not None:
            discard(before)
        df, parts = written, -(-parts // fan_in) if parts > fan_in else 1

    def all_(key: tuple, table: pa.Table) -> pa.Table:
        pairs, each, best = _merge_group(table, True)
        return pa.table({"radix": pa.array([key[0].as_py()], pa.int32()), "pairs": pa.array([pairs], pa.binary()), "each": pa.array([each], pa.binary()), "best": pa.array([best], pa.binary())})

    out = staged(df.groupBy("radix").applyInArrow(all_, "radix int, pairs binary, each binary, best binary"), "align-totals")
    if written is not None:
        discard(written)
    return out


def contributions(runs: DataFrame, sums: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(portion, first document's number, n_best, count_sum), a row for each run."""
    df = runs.where("radix >= 0").select("radix", "portion", "pairs", "each", "docs", "times")
    most = df.groupBy("radix").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    parts = max(1, -(-most // fan_in))
    left = df.withColumn("part", F.pmod(F.xxhash64("portion"), F.lit(parts)).cast("int"))
    right = sums.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def back(key: tuple, table: pa.Table, total: pa.Table) -> pa.Table:
        pairs, counts, best = unpack(total["pairs"][0].as_py(), "<i8", True), unpack(total["each"][0].as_py(), "<i8"), unpack(total["best"][0].as_py(), "<i1")
        out: dict[str, list] = {"portion": [], "n_best": [], "count_sum": []}
        for k in range(table.num_rows):
            at = np.searchsorted(pairs, unpack(table["pairs"][k].as_py(), "<i8", True))
            where = np.repeat(at, unpack(table["each"][k].as_py(), "<i8"))
            docs, times = unpack(table["docs"][k].as_py(), "<i4", True), unpack(table["times"][k].as_py(), "<i8")
            sums_, best_ = np.zeros(docs.max() + 1, np.int64), np.zeros(docs.max() + 1, np.int64)
            np.add.at(sums_, docs, counts[where] * times)
            np.add.at(best_, docs, best[where] * times)
            out["portion"].append(table["portion"][k].as_py())
            out["n_best"].append(pack(best_, "<i8")), out["count_sum"].append(pack(sums_, "<i8"))
        kinds = (pa.int64(), pa.binary(), pa.binary())
        return pa.table({n: pa.array(v, kind) for (n, v), kind in zip(out.items(), kinds, strict=True)})

    return left.groupBy("radix", "part").cogroup(right.groupBy("radix", "part")).applyInArrow(back, "portion long, n_best binary, count_sum binary")


_OUT = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def align(docs: DataFrame, a_file: str, b_file: str, radix: int = RADIX, records: int = RECORDS, fan_in: int = FAN_IN) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    runs = staged(spill(docs, a_file, b_file, radix, records), "align-runs")
    sums = totals(runs, fan_in)
    added = staged(contributions(runs, sums, fan_in), "align-back")
    heads = runs.where("radix = -1").select("portion", "n_a", "n_b", "n_groups", "n_links", F.lit(None).cast("binary").alias("n_best"), F.lit(None).cast("binary").alias("count_sum"), "ids", "shas")
    none = {"n_a": F.lit(None).cast("binary"), "n_b": F.lit(None).cast("binary"), "n_groups": F.lit(None).cast("binary"), "n_links": F.lit(None).cast("binary"), "ids": F.lit(None).cast(heads.schema["ids"].dataType), "shas": F.lit(None).cast("array<string>")}
    both = heads.unionByName(added.withColumns(none))

    def gather(key: tuple, table: pa.Table) -> pa.Table:
        head = next(k for k in range(table.num_rows) if table["n_a"][k].is_valid)
        ids = table["ids"].combine_chunks()
        ids = ids.slice(head, 1).flatten()
        n = len(ids)
        out = {name: unpack(table[name][head].as_py(), "<i8") for name in _OUT[:4]}
        for name in _OUT[4:]:
            out[name] = np.zeros(n, np.int64)
            for k in range(table.num_rows):
                if k != head:
                    some = unpack(table[name][k].as_py(), "<i8")
                    out[name][: len(some)] += some
        return pa.table({"doc_id": ids, **{name: pa.array(v, pa.int64()) for name, v in out.items()}, "groups_sha256": pa.array(table["shas"][head].as_py(), pa.string())})

    out = staged(both.groupBy("portion").applyInArrow(gather, f"doc_id {id_kind}, " + ", ".join(f"{n} long" for n in _OUT) + ", groups_sha256 string"), "align")
    for table in (runs, sums, added):
        discard(table)
    return out


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
