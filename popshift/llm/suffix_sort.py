"""External induced sorting of one shard: suffixes in order, each with the length of its common prefix with its neighbour.

Suffixes are classed as smaller (S) or larger (L) than the next one; a letter is stored with its suffix's class in the
lowest bit, so a look at a place gives both. Sorting the leftmost S suffix of each run (LMS) is enough: buckets scanned
upward induce the L suffixes, buckets scanned downward the S suffixes. The priority queue keyed by (first letter, rank of
the next suffix) is a row of queues, one a letter, as tuples arrive in order of rank. A tuple is (position, common prefix
with the tuple before it); what exceeds a budget of tuples is in a file. LMS substrings are sorted by the same induction
and named, and the string of names is sorted in turn: by recursion into the same procedure while names exceed their
budget, in memory by ranks of ever more names below it.

Common prefixes: those of LMS suffixes come from comparing neighbours, those of all others by induction: two suffixes
that follow each other in a bucket share one letter more than the suffixes behind them, whose common prefix is the least
over the tuples in between. Prefixes are counted up to `depth`.

Texts, ranks and orders beyond Memory.array bytes are memory-mapped scratch files, and every pass goes block by block; so a
shard may be far larger than memory.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


@dataclass
class Memory:
    """Tuples that queues keep in memory, bytes of an array beyond which it is a file, entries of a block, names that are
    sorted in memory. spilled counts tuples that went to disk."""

    queues: int = 1 << 20
    array: int = 1 << 24
    block: int = 1 << 17
    names: int = 1 << 21
    spilled: int = 0

    def empty(self, n: int, kind: type | np.dtype) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if size <= self.array:
            return np.empty(n, kind)
        file = scratch_file()
        file.truncate(size)
        return np.memmap(file, kind, "r+", shape=(n,))

    def blocks(self, n: int) -> Iterator[slice]:
        for a in range(0, n, self.block):
            yield slice(a, min(n, a + self.block))


def scratch_file():
    """An anonymous file beside Spark's own spills; it is gone when it is closed."""
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=folder if folder and os.path.isdir(folder) else None)


_LETTERS = np.uint64(0xFFFEFFFEFFFEFFFE)


class Text:
    """Letters of a string with classes, its LMS positions and its distinct letters."""

    def __init__(self, t: np.ndarray, mem: Memory):
        n, top = len(t), 0
        letters: list[np.ndarray] = []
        for at in mem.blocks(n):
            found = np.unique(t[at])
            letters = [np.union1d(letters[0], found) if letters else found]
        self.letters = letters[0].astype(np.int64) if letters else np.zeros(0, np.int64)
        top = int(self.letters[-1]) if n else 0
        self.position = np.dtype(np.int32 if n < 1 << 31 else np.int64)
        padded = mem.empty(n + 4, np.uint16 if top < 1 << 15 else np.int64)
        padded[n:] = 0
        self.v = v = padded[:n]
        #: Four letters from each place on, classes masked out where they are used.
        self.words = np.ndarray(n, "<u8", padded, strides=(2,)) if padded.itemsize == 2 else None
        following, smaller = -1, -1  # the empty suffix comes first
        for at in reversed(list(mem.blocks(n))):
            x = t[at].astype(np.int64)
            d = np.sign(np.append(x[1:], following) - x)
            known = np.where(d != 0, np.arange(len(d)), len(d))
            s = np.append(d, smaller)[np.minimum.accumulate(known[::-1])[::-1]] > 0
            v[at] = x * 2 + s
            following, smaller = x[0], 1 if s[0] else -1
        places = [self._lms(at) for at in mem.blocks(n)]
        self.lms = mem.empty(sum(map(len, places)), self.position)
        done = 0
        for p in places:
            self.lms[done : done + len(p)] = p
            done += len(p)

    def _lms(self, at: slice) -> np.ndarray:
        s = self.v[max(at.start - 1, 0) : at.stop] & 1
        found = np.flatnonzero(s[1:] > s[:-1]) + max(at.start - 1, 0) + 1
        return found.astype(self.position)

    def is_lms(self, p: np.ndarray) -> np.ndarray:
        return (p > 0) & (self.v[p] & 1 > self.v[np.maximum(p - 1, 0)] & 1)

    def common(self, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
        """Letters, at most depth, that the suffixes at a and b share."""
        n = len(self.v)
        out = np.full(len(a), depth, np.int64)
        open_, x, y = np.arange(len(a)), a, b
        for k in range(0, depth, 4 if self.words is not None else 1):
            x, y = a[open_] + k, b[open_] + k
            if self.words is not None:
                d = (self.words[np.minimum(x, n - 1)] ^ self.words[np.minimum(y, n - 1)]) & _LETTERS
                differ = d != 0
                low = d[differ] & (~d[differ] + np.uint64(1))
                out[open_[differ]] = k + np.log2(low.astype(np.float64)).astype(np.int64) // 16
            else:
                differ = (np.maximum(x, y) >= n) | (self.v[np.minimum(x, n - 1)] >> 1 != self.v[np.minimum(y, n - 1)] >> 1)
                out[open_[differ]] = k
            open_ = open_[~differ & (np.maximum(x, y) < n)]
            if not len(open_):
                break
        return np.minimum(np.minimum(out, n - np.maximum(a, b)), depth).astype(np.uint8)


class Queues:
    """A queue of tuples for each letter, first in first out, in chunks; beyond the budget, chunks are in one file."""

    def __init__(self, mem: Memory, kind: np.dtype):
        self.mem, self.kind, self.free = mem, kind, mem.queues
        self.chunks: dict[int, list] = {}
        self.file, self.end = None, 0

    def push(self, letter: int, pos: np.ndarray, lcp: np.ndarray | None) -> None:
        row = self.chunks.setdefault(letter, [])
        if len(pos) <= self.free:
            self.free -= len(pos)
            row.append((pos, lcp))
            return
        self.file = self.file or scratch_file()
        data = pos.astype(self.kind).tobytes() + (lcp.tobytes() if lcp is not None else b"")
        os.pwrite(self.file.fileno(), data, self.end)
        row.append((self.end, len(pos), lcp is not None))
        self.end += len(data)
        self.mem.spilled += len(pos)

    def _read(self, chunk: tuple) -> tuple[np.ndarray, np.ndarray | None]:
        if len(chunk) == 2:
            return chunk
        at, n, has = chunk
        size = n * self.kind.itemsize
        data = os.pread(self.file.fileno(), size + n * has, at)
        return np.frombuffer(data, self.kind, n), np.frombuffer(data, np.uint8, n, size) if has else None

    @staticmethod
    def _size(chunk: tuple) -> int:
        return len(chunk[0]) if len(chunk) == 2 else chunk[1]

    def _joined(self, parts: list[tuple]) -> tuple[np.ndarray, np.ndarray | None]:
        read = [self._read(x) for x in parts]
        if len(read) == 1:
            return read[0]
        return np.concatenate([x[0] for x in read]), None if read[0][1] is None else np.concatenate([x[1] for x in read])

    def blocks(self, letter: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """The letter's tuples in order, those included that are pushed meanwhile."""
        row, i = self.chunks.get(letter, ()), 0
        while i < len(row := self.chunks.get(letter, ())):
            j, n = i, 0
            while j < len(row) and (j == i or n + self._size(row[j]) <= self.mem.block):
                n += self._size(row[j])
                j += 1
            yield self._joined(row[i:j])
            i = j

    def backward(self, letter: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        row = self.chunks.get(letter, ())
        i = len(row)
        while i:
            j, n = i, 0
            while j and (j == i or n + self._size(row[j - 1]) <= self.mem.block):
                j -= 1
                n += self._size(row[j])
            yield self._joined(row[j:i])
            i = j

    def last(self, letter: int) -> int | None:
        row = self.chunks.get(letter)
        return int(self._read(row[-1])[0][-1]) if row else None

    def drop(self, letter: int) -> None:
        self.free += sum(self._size(x) for x in self.chunks.pop(letter, ()) if len(x) == 2)


class Induction:
    """All suffixes of a text, largest first, from its LMS suffixes in order (or LMS substrings from LMS positions)."""

    def __init__(self, text: Text, mem: Memory, depth: int | None = None):
        self.text, self.mem, self.depth = text, mem, depth
        if depth:
            size = int(text.letters[-1]) + 1
            #: For each letter the least common prefix since its last tuple; -1 before its first one.
            self.since = np.full(size, -1, np.int16)
            self.log = np.zeros(mem.block + 2, np.uint8)
            for i in range(1, 20):
                self.log[1 << i :] = i

    def _least(self, lcp: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least of lcp[a..b] for each pair."""
        if not len(a):
            return np.zeros(0, np.uint8)
        h = self.log[b - a + 1]
        table = np.empty((int(h.max()) + 1, len(lcp)), np.uint8)
        table[0] = lcp
        for i in range(1, len(table)):
            half = 1 << (i - 1)
            np.minimum(table[i - 1, :-half], table[i - 1, half:], out=table[i, : len(lcp) - half])
        return np.minimum(table[h, a], table[h, b + 1 - (1 << h.astype(np.int64))])

    def _deal(self, pos: np.ndarray, lcp: np.ndarray | None, s: int, queues: Queues) -> None:
        """The suffixes of class s one place before the given ones, to the queues of their letters."""
        if not len(pos):
            return
        v = self.text.v[np.maximum(pos - 1, 0)]
        keep = np.flatnonzero((v & 1 == s) & (pos > 0))
        letter = v[keep] >> 1
        order = np.argsort(letter, kind="stable")
        k, letter = keep[order], letter[order]
        target = pos[k] - 1
        begin = np.flatnonzero(np.r_[True, letter[1:] != letter[:-1]]) if len(k) else np.zeros(0, np.int64)
        heads = letter[begin].astype(np.int64)
        shared = None
        if self.depth:
            lcp = np.asarray(lcp)
            before = np.minimum.accumulate(lcp)
            after = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint8(255))
            shared = np.empty(len(k), np.uint8)
            rest = np.ones(len(k), bool)
            rest[begin] = False
            inner = np.flatnonzero(rest)
            shared[inner] = np.minimum(self._least(lcp, k[inner - 1] + 1, k[inner]), self.depth - 1) + 1
            shared[begin] = np.minimum(np.minimum(self.since[heads], before[k[begin]]) + 1, self.depth)
            self.since = np.minimum(self.since, before[-1].astype(np.int16))
            self.since[heads] = after[k[np.append(begin[1:], len(k))[: len(begin)] - 1] + 1]
        edges = [*begin.tolist(), len(k)]
        for c, a, b in zip(heads.tolist(), edges, edges[1:], strict=False):
            queues.push(c, target[a:b], None if shared is None else shared[a:b])

    def run(self, seeds: np.ndarray, shared: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """(positions, common prefixes with the next larger suffix), largest first; shared: common prefixes of seeds."""
        text, mem = self.text, self.mem
        lower, upper, waiting = (Queues(mem, text.position) for _ in range(3))
        for at in mem.blocks(len(seeds)):
            pos = np.asarray(seeds[at])
            letter = text.v[pos] >> 1
            order = np.argsort(letter, kind="stable")
            letter = letter[order]
            edges = [*np.flatnonzero(np.r_[True, letter[1:] != letter[:-1]]).tolist(), len(pos)]
            for a, b in zip(edges, edges[1:], strict=False):
                waiting.push(int(letter[a]), pos[order[a:b]], None if shared is None else np.asarray(shared[at])[order[a:b]])
        n = len(text.v)
        last = int(text.v[n - 1])
        if not last & 1:
            lower.push(last >> 1, np.array([n - 1], text.position), np.zeros(1, np.uint8) if self.depth else None)
            if self.depth:
                self.since[last >> 1] = 0
        for c in text.letters.tolist():
            for pos, lcp in lower.blocks(c):
                self._deal(pos, lcp, 0, lower)
            first = True
            for pos, lcp in waiting.blocks(c):
                if first and self.depth:
                    lcp, below = np.array(lcp), lower.last(c)
                    lcp[0] = 0 if below is None else self._pair(below, pos[0])
                first = False
                self._deal(pos, lcp, 0, lower)
            waiting.drop(c)
        if self.depth:
            self.since[:] = -1
        for c in text.letters[::-1].tolist():
            least = None
            for pos, lcp in upper.blocks(c):
                self._deal(pos, lcp, 1, upper)
                yield pos, lcp
                least = pos[-1]
            carried = None
            for pos, lcp in lower.backward(c):
                pos = pos[::-1]
                if self.depth:
                    if carried is None:
                        carried = 0 if least is None else self._pair(least, pos[0])
                    lcp, carried = np.append(np.uint8(carried), lcp[:0:-1]), int(lcp[0])
                self._deal(pos, lcp, 1, upper)
                yield pos, lcp
            lower.drop(c), upper.drop(c)

    def _pair(self, a: int, b: int) -> int:
        return int(self.text.common(np.array([a], np.int64), np.array([b], np.int64), self.depth)[0])


def _names(text: Text, ordered: np.ndarray, mem: Memory) -> tuple[np.ndarray, int]:
    """(a number for each LMS substring in text order, equal for equal ones; how many numbers), from their order."""
    lms, n = text.lms, len(text.v)
    index = mem.empty(n, text.position)
    for at in mem.blocks(len(lms)):
        index[lms[at]] = np.arange(at.start, at.stop)
    names = mem.empty(len(lms), np.int64)
    name, before = -1, None
    for at in mem.blocks(len(lms)):
        here = np.asarray(ordered[at])
        p = here if before is None else np.append(before, here)
        k = index[p].astype(np.int64)
        length = np.where(k + 1 < len(lms), lms[np.minimum(k + 1, len(lms) - 1)] - p + 1, 0)  # the last one equals no other
        differ = (length[1:] != length[:-1]) | (length[1:] == 0)
        open_, step = np.flatnonzero(~differ), 0
        while len(open_):
            same = text.v[p[open_] + step] == text.v[p[open_ + 1] + step]
            differ[open_[~same]] = True
            step += 1
            open_ = open_[same]
            open_ = open_[length[open_ + 1] > step]
        if before is None:
            differ = np.append(True, differ)
            mine = k
        else:
            mine = k[1:]
        numbers = name + np.cumsum(differ)
        names[mine] = numbers
        name, before = int(numbers[-1]), here[-1]
    return names, name + 1


def _ranked(t: np.ndarray, enough: int) -> np.ndarray:
    """Suffix order by ranks of three times (or twice) as many letters each round, as far as `enough` letters."""
    rank, step = np.unique(t, return_inverse=True)[1].astype(np.int64), 1
    order = np.argsort(rank)
    while rank[order[-1]] < len(t) - 1 and step < enough:
        width = int(rank[order[-1]] + 2).bit_length()
        key = rank + 1
        parts = 3 if 3 * width < 64 else 2
        for k in range(1, parts):
            key <<= width
            key[: -k * step] += rank[k * step :] + 1
        order = np.argsort(key)
        ordered = key[order]
        rank = np.empty(len(t), np.int64)
        rank[order] = np.r_[0, np.cumsum(ordered[1:] != ordered[:-1])]
        step *= parts
    return order


def _filled(stream: Iterator[np.ndarray], n: int, kind: np.dtype, mem: Memory) -> np.ndarray:
    """A stream of positions, largest suffix first, as an array, smallest first."""
    out, done = mem.empty(n, kind), n
    for pos in stream:
        out[done - len(pos) : done] = pos[::-1]
        done -= len(pos)
    return out


def _lms_order(text: Text, mem: Memory, depth: int | None) -> np.ndarray:
    """LMS positions by their suffixes; with depth, those that agree on so many letters may be in any order."""
    lms = text.lms
    if len(lms) < 2:
        return lms
    stream = Induction(text, mem).run(lms)
    ordered = _filled((p[text.is_lms(p)] for p, _ in stream), len(lms), text.position, mem)
    names, n = _names(text, ordered, mem)
    if n == len(lms):
        return ordered
    if len(lms) > mem.names:
        order = suffix_array(names, mem)
    else:  # each name stands for two letters at least
        order = _ranked(names, depth // 2 + 2 if depth else len(names))
    out = mem.empty(len(lms), text.position)
    for at in mem.blocks(len(lms)):
        out[at] = lms[order[at]]
    return out


def suffixes(t: np.ndarray, mem: Memory, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, common prefixes with the next larger suffix) of all suffixes of t, largest first, in blocks.

    Common prefixes count up to depth (at most 254); suffixes that agree on depth letters may be in any order. t holds
    non-negative integers; a suffix that is a prefix of another one is the smaller.
    """
    if not len(t):
        return
    text = Text(t, mem)
    seeds = _lms_order(text, mem, depth)
    shared = mem.empty(len(seeds), np.uint8)
    for at in mem.blocks(len(seeds)):
        here = np.asarray(seeds[max(at.start - 1, 0) : at.stop]).astype(np.int64)
        found = text.common(here[:-1], here[1:], depth)
        shared[at] = found if at.start else np.append(np.uint8(0), found)
    yield from Induction(text, mem, depth).run(seeds, shared)


def suffix_array(t: np.ndarray, mem: Memory | None = None) -> np.ndarray:
    """Positions of all suffixes of t in order."""
    t, mem = np.asarray(t), mem or Memory()
    if len(t) < 2:
        return np.arange(len(t))
    text = Text(t, mem)
    return _filled((p for p, _ in Induction(text, mem).run(_lms_order(text, mem, None))), len(t), text.position, mem)
