"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon of frequent words.

The corpus's frequent pre-tokens are compiled, with their ids as outputs, into the minimal acyclic automaton: states with
the same continuations are one (shared suffixes), and each arc counts the words that it skips, so that walking a word
gives its number and with it its ids. The automaton is a few flat arrays, sent once to each executor and memory-mapped
there; all distinct words of a batch walk it together. Words outside it are merged exactly, lowest rank first and the
leftmost on ties. The lexicon only saves work: any lexicon gives the same ids.

Handles tokenizers files of the kind "BPE with word ends": NFC, white space, lower case by code point; a split pattern;
bytes as characters; merges with an end-of-word suffix; special tokens found in the raw text.

Defined results: a null or empty text has no ids and decodes to the empty text; white space alone as well; long texts are
whole; repeated rows get one row each.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import os
import re
import struct
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from popshift.llm.common import column, discard, read, small_batches, staged

#: Words that are compiled, at most; the rest is merged. They are the most frequent ones of all texts.
LEXICON = 50_000
#: Entries that a task keeps at once.
COUNTED, REMEMBERED = 400_000, 500_000
#: Characters of texts whose chunks a counting task holds at once, at most, but for the last text.
HELD = 16 << 20
#: Bytes of the longest word that is compiled.
LONGEST = 24
#: Words that are merged together, so that their arrays stay in a core's cache.
BLOCK = 4_096
_ODD = re.compile("[\x1c-\x1f]")

_SPACE = r"\t-\r \x85\xa0  -     　"


@contextmanager
def uncollected() -> Iterator[None]:
    """Without cyclic garbage collection: tasks hold many small tuples and lists, none in a cycle, and scanning them is slow."""
    enabled = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if enabled:
            gc.enable()


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]


class Tokenizer:
    """What a tokenizers file says, as far as this kind needs it."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {(self.vocab[a], self.vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made, self.never = [self.vocab[a + b] for a, b in pairs], len(pairs)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.splits = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split.replace(r"[^\s", f"[^{_SPACE}"))
        chars = byte_characters()
        self.inner = [self.vocab.get(c) for c in chars]
        self.last = [self.vocab.get(c + self.suffix) for c in chars]
        # The same for many words at once; `absent` is no token's id, and a pair with it has no rank.
        self.absent = max(self.tokens, default=0) + 1
        self._first, self._final = (np.array([self.absent if i is None else i for i in x]) for x in (self.inner, self.last))
        pairs = np.array([a * (self.absent + 1) + b for a, b in self.ranks] or [-1])
        order = np.argsort(pairs)
        self._pairs, self._rank_of = pairs[order], np.array(list(self.ranks.values()) or [self.never])[order]
        self._made = np.array(self.made or [0])

    def words(self, text: str) -> list[str | int]:
        """Pre-tokens in order; a special token is its id."""
        if "<" not in text or not self.splits.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.splits.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + self._plain(text[at:])

    def chunks(self, text: str) -> list[str] | None:
        """The text between white space, in order: no pre-token spans white space, so each stands for itself. None if a
        special token, or a character that only Python takes for white space, asks for the whole text."""
        if _ODD.search(text) or ("<" in text and self.splits.search(text)):
            return None
        return unicodedata.normalize("NFC", text).split()

    def _plain(self, text: str) -> list[str]:
        lower = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # by code point: no final sigma
        return self.pattern.findall(lower)

    def merge(self, word: bytes) -> list[int]:
        """The word's ids by its bytes."""
        if not word:
            return []
        ids = [i for i in [*(self.inner[b] for b in word[:-1]), self.last[word[-1]]] if i is not None]
        return self._by_heap(ids) if len(ids) > 40 else self._by_scan(ids)

    def merge_all(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each of many words of 1 to LONGEST bytes: every round makes each word's next merge."""
        return [ids for at in range(0, len(words), BLOCK) for ids in self._block(words[at : at + BLOCK])]

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * (self.absent + 1) + b
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where(self._pairs[at] == key, self._rank_of[at], self.never)

    def _block(self, words: list[bytes]) -> list[list[int]]:
        sizes, n = np.array([len(w) for w in words]), len(words)
        end, every = int(sizes.max()), np.arange(n)
        # A row a position, a column a word; row `end` stands for what is before the first and after the last one.
        letters = np.frombuffer(b"".join(w.ljust(end, b"\0") for w in words), np.uint8).reshape(n, end).T
        place = np.arange(end + 1)[:, None]
        ids = np.full((end + 1, n), self.absent)
        ids[:end] = np.where(place[:end] < sizes, self._first[letters], self.absent)
        ids[sizes - 1, every] = self._final[letters[sizes - 1, every]]
        after = np.where(place + 1 < sizes, place + 1, end)
        before = np.where(place > 0, place - 1, end) + np.zeros((1, n), np.int64)
        # (rank, position) of each pair as one number: the least is the lowest rank, the leftmost on ties.
        never = self.never * (LONGEST + 1)
        pairs = np.full((end + 1, n), never)
        at, word = np.nonzero(place + 1 < sizes)
        rank = self._ranks(ids[at, word], ids[at + 1, word])
        pairs[at, word] = np.where(rank < self.never, rank * (LONGEST + 1) + at, never)
        while True:
            best = pairs.min(axis=0)
            word = np.flatnonzero(best < never)
            if not len(word):
                break
            rank, at = np.divmod(best[word], LONGEST + 1)
            gone = after[at, word]
            right, left = after[gone, word], before[at, word]
            ids[at, word], ids[gone, word] = self._made[rank], self.absent
            after[at, word], before[right, word] = right, at
            pairs[gone, word] = never
            for x, y in ((left, at), (at, right)):
                rank = self._ranks(ids[x, word], ids[y, word])
                pairs[x, word] = np.where(rank < self.never, rank * (LONGEST + 1) + x, never)
        word, at = np.nonzero((ids != self.absent).T)
        ends = np.cumsum(np.bincount(word, minlength=n)).tolist()
        flat = ids[at, word].tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _by_scan(self, ids: list[int]) -> list[int]:
        get, never = self.ranks.get, self.never
        ranks = [get(pair, never) for pair in zip(ids, ids[1:], strict=False)]
        while ranks and (best := min(ranks)) < never:
            k = ranks.index(best)
            ids[k : k + 2] = [self.made[best]]
            del ranks[k]
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), never)
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), never)
        return ids

    def _by_heap(self, ids: list[int]) -> list[int]:
        n, get = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found, k, ids[k], ids[k + 1]) for k in range(n - 1) if (found := get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            r = after[k]
            if r >= n or ids[k] != a or ids[r] != b:
                continue
            ids[k], ids[r] = self.made[rank], -1
            after[k] = after[r]
            if after[k] < n:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y < n and (found := get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (found, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def entry(self, word: str | int, ids: list[int] | None = None) -> tuple[bytes, str]:
        """(ids as little-endian 32-bit integers, decoded text) of a pre-token."""
        if isinstance(word, int):
            ids = [word]
        elif ids is None:
            ids = self.merge(word.encode("utf-8", "replace"))
        return struct.pack(f"<{len(ids)}I", *ids), " ".join([self.tokens[i] for i in ids])


class Lexicon:
    """Minimal acyclic automaton of words; arcs sorted by (state, byte), with their target and the words they skip."""

    FIELDS = ("keys", "targets", "skips", "finals", "starts", "ids")

    def __init__(self, **arrays: np.ndarray):
        self.__dict__.update(arrays)

    @classmethod
    def build(cls, words: dict[bytes, list[int]]) -> Lexicon:
        ordered = sorted(words)
        register: dict[tuple, int] = {}
        arcs: list[dict[int, int]] = [{}]
        final = [False]
        path, previous = [0], b""

        def settle(down_to: int) -> None:
            """Replace the path's states below down_to by equal ones that exist."""
            for depth in range(len(path) - 1, down_to, -1):
                state = path.pop()
                shape = (final[state], tuple(arcs[state].items()))
                arcs[path[-1]][previous[depth - 1]] = register.setdefault(shape, state)

        for word in ordered:
            same = len(os.path.commonprefix([previous, word]))
            settle(same)
            previous = word
            for byte in word[same:]:
                arcs.append({})
                final.append(False)
                arcs[path[-1]][byte] = len(arcs) - 1
                path.append(len(arcs) - 1)
            final[path[-1]] = True
        settle(0)
        number, order, stack = {0: 0}, [0], [0]
        while stack:
            for target in arcs[stack.pop()].values():
                if target not in number:
                    number[target] = len(order)
                    order.append(target)
                    stack.append(target)
        below: dict[int, int] = {}

        def count(state: int) -> int:
            if state not in below:
                below[state] = final[state] + sum(count(t) for t in arcs[state].values())
            return below[state]

        rows = []
        for state in order:
            skip = int(final[state])
            for byte in sorted(arcs[state]):
                target = arcs[state][byte]
                rows.append((number[state] << 8 | byte, number[target], skip))
                skip += count(target)
        rows.sort()
        table = np.array(rows or [(-1, 0, 0)], dtype=np.int64)
        sizes = [len(words[w]) for w in ordered]
        return cls(keys=table[:, 0].copy(), targets=table[:, 1].astype(np.int32), skips=table[:, 2].astype(np.int32), finals=np.array([final[s] for s in order], np.uint8), starts=np.cumsum([0, *sizes]).astype(np.int32), ids=np.array([i for w in ordered for i in words[w]], np.uint32))

    def dump(self) -> bytes:
        arrays = [getattr(self, f) for f in self.FIELDS]
        head, at, parts = [], 0, []
        for a in arrays:
            head.append((a.dtype.str, len(a), at))
            parts.append(a.tobytes().ljust(-(-a.nbytes // 16) * 16, b"\0"))
            at += len(parts[-1])
        said = json.dumps(head).encode().ljust(1024)
        return said + b"".join(parts)

    def share(self, spark: SparkSession) -> str:
        """Sends the lexicon to each executor once, as a file; the name under which tasks find it."""
        sc, name = spark.sparkContext, f"lexicon-{uuid.uuid4().hex}"
        with open(path := os.path.join(sc._temp_dir, name), "wb") as f:  # the driver's own folder, from which Spark serves the file until the session ends
            f.write(self.dump())
        sc.addFile(path)
        return name

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        """A view of the executor's file: all its tasks map the same pages."""
        whole = np.memmap(path, np.uint8, "r").view(np.ndarray)
        head = json.loads(whole[:1024].tobytes())
        return cls(**{name: whole[1024 + at : 1024 + at + n * np.dtype(kind).itemsize].view(kind) for name, (kind, n, at) in zip(cls.FIELDS, head, strict=True)})

    def find(self, words: list[bytes]) -> list[np.ndarray | None]:
        """The ids of each word, or None: all words walk together, a byte a step."""
        out: list[np.ndarray | None] = [None] * len(words)
        short = [k for k, w in enumerate(words) if 0 < len(w) <= LONGEST]
        if not short:
            return out
        sizes = np.array([len(words[k]) for k in short])
        table = np.frombuffer(b"".join(words[k].ljust(LONGEST, b"\0") for k in short), np.uint8).reshape(-1, LONGEST)
        state, number, alive = np.zeros(len(short), np.int64), np.zeros(len(short), np.int64), np.arange(len(short))
        for depth in range(int(sizes.max())):
            alive = alive[sizes[alive] > depth]
            key = state[alive] << 8 | table[alive, depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            sizes[alive[~hit]] = -1
            alive, arc = alive[hit], arc[hit]
            state[alive] = self.targets[arc]
            number[alive] += self.skips[arc]
        for k in np.flatnonzero((sizes > 0) & (self.finals[state] == 1)):
            out[short[k]] = self.ids[self.starts[number[k]] : self.starts[number[k] + 1]]
        return out


def word_counts(docs: DataFrame, tokenizer_json: str) -> DataFrame:
    """(word, n) of the pre-tokens of all texts, as far as they fit the lexicon (LONGEST bytes)."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer_json)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, seen, chunks, held = Tokenizer(sent.value), {}, Counter(), 0

        def add(words: list[str | int], n: int) -> None:
            for w in words:
                if isinstance(w, str) and len(w) <= LONGEST:
                    seen[w] = seen.get(w, 0) + n

        def split() -> None:
            for chunk, n in chunks.items():
                add(t.words(chunk), n)
            chunks.clear()

        def out() -> pa.RecordBatch:
            words = [w.encode("utf-8", "replace") for w in seen]
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return batch

        with uncollected():
            for batch in batches:
                for text in column(batch, "text").to_pylist():
                    found = t.chunks(text or "")
                    if found is None:
                        add(t.words(text), 1)
                    else:
                        chunks.update(found)
                        held += len(text or "")
                    if len(chunks) > COUNTED or held > HELD:
                        split()
                        held = 0
                    if len(seen) > COUNTED:
                        yield out()
            split()
            yield out()

    parts = docs.select("text").mapInArrow(count, "word binary, n long").where(F.octet_length("word") <= LONGEST)
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, tokenizer_json: str, size: int = LEXICON) -> Lexicon:
    """From the most frequent words of all texts, at most `size`; of words that are equally frequent all or none.

    The least frequency is found from how many words have which frequency, of which `size` + 1 always suffice, so only words of
    the lexicon and as many numbers reach the driver.
    """
    counted = staged(word_counts(docs, tokenizer_json), "bpe-words")
    least, words = 1, 0
    for r in counted.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(size + 1).collect():
        words += r["words"]
        if words > size:
            least = r["n"] + 1
            break
    t = Tokenizer(tokenizer_json)
    top = counted.where(F.col("n") >= least).select("word").collect()
    discard(counted)
    return Lexicon.build({bytes(r["word"]): t.merge(bytes(r["word"])) for r in top})


class Encoder:
    """Remembers the entries of words and of chunks between white space; what it forgets is made again."""

    def __init__(self, tokenizer: Tokenizer, lexicon: Lexicon):
        self.tokenizer, self.lexicon = tokenizer, lexicon
        self.known: dict[str | int, tuple[bytes, str]] = {}
        self.chunks: dict[str, tuple[bytes, str]] = {}

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids, decoded text) of each text."""
        split = [self.tokenizer.chunks(t) if t else [] for t in texts]
        new = {c: self.tokenizer.words(c) for c in {c for parts in split if parts for c in parts if c not in self.chunks}}
        odd = {i: self.tokenizer.words(texts[i]) for i, parts in enumerate(split) if parts is None}
        self._learn({w for words in (*new.values(), *odd.values()) for w in words})
        self.chunks.update((c, self._joined(words)) for c, words in new.items())
        out = []
        for i, parts in enumerate(split):
            entries = [self.chunks[c] for c in parts] if parts is not None else [self._joined(odd[i])]
            out.append((b"".join([e[0] for e in entries]), " ".join([e[1] for e in entries if e[1]])))
        for memory in (self.chunks, self.known):
            if len(memory) > REMEMBERED:
                memory.clear()
        return out

    def _learn(self, words: set[str | int]) -> None:
        new = [w for w in words if w not in self.known]
        coded = [_bytes(w) for w in new]
        found = [None if ids is None else ids.tolist() for ids in self.lexicon.find(coded)]
        rest = [k for k, ids in enumerate(found) if ids is None and 0 < len(coded[k]) <= LONGEST]
        for k, ids in zip(rest, self.tokenizer.merge_all([coded[k] for k in rest]), strict=True):
            found[k] = ids
        for w, ids in zip(new, found, strict=True):
            self.known[w] = self.tokenizer.entry(w, ids)

    def _joined(self, words: list[str | int]) -> tuple[bytes, str]:
        if len(words) == 1:
            return self.known[words[0]]
        entries = [self.known[w] for w in words]
        return (b"".join([e[0] for e in entries]), " ".join([e[1] for e in entries if e[1]]))


def _bytes(word: str | int) -> bytes:
    return b"" if isinstance(word, int) else word.encode("utf-8", "replace")


def encode(docs: DataFrame, tokenizer_json: str, lexicon: Lexicon | None = None, keep: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with keep, also ids (packed) and decoded."""
    lexicon = lexicon or compile_lexicon(docs, tokenizer_json)
    small_batches(docs.sparkSession)
    sent, name = docs.sparkSession.sparkContext.broadcast(tokenizer_json), lexicon.share(docs.sparkSession)
    df = docs.select("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Tokenizer(sent.value), Lexicon.mapped(SparkFiles.get(name)))
        with uncollected():
            for batch in batches:
                n, ids_sha, text_sha, ids_, texts = [], [], [], [], []
                for ids, decoded in encoder.encode(column(batch, "text").to_pylist()):
                    n.append(len(ids) // 4)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
                    if keep:
                        ids_.append(ids), texts.append(decoded)
                arrays = [column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep:
                    arrays, names = [*arrays, pa.array(ids_, pa.binary()), pa.array(texts, pa.string())], [*names, "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep
    return df.mapInArrow(run, schema)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read()


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"), tokenizer_file())
