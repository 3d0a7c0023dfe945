"""Compiled benchmark tables: size, memory, and searches against plain ones."""

import random
import subprocess
import sys

from popshift.llm import decontam

WORDS = "abcdefghijklmnopqrstuvwxyz"


def plain(words, items, window=10):
    hits, found = set(), set()
    for item, text in items:
        own = decontam.words_of(text)
        m = min(window, len(own))
        windows = {tuple(own[i : i + m]) for i in range(len(own) - m + 1)} if own else ()
        for i in range(len(words) - m + 1):
            if m and tuple(words[i : i + m]) in windows:
                hits.update(range(i, i + m))
                found.add(item)
    return hits, found


def test_search_equals_plain_search_on_small_alphabets():
    rng = random.Random(8)
    for round_ in range(150):
        letters = WORDS[: rng.randint(1, 4)]
        line = lambda n: " ".join(rng.choices(letters, k=n)).encode()
        items = [(k, line(rng.randint(0, 25))) for k in range(rng.randint(0, 6))]
        items += items[:1]
        search = decontam.Search(decontam.compile_items(items, window := rng.choice([1, 2, 3, 10])))
        for _ in range(5):
            words = decontam.words_of(line(rng.randint(0, 60)) + rng.choice([b"", b" zz ", b" a b"]))
            runs, found = decontam.scan(words, search)
            hits, want = plain(words, items, window)
            assert found == want and {k for a, b in runs for k in range(a, b)} == hits, (round_, items)


def test_remembered_words_are_forgotten_and_found_again(monkeypatch):
    monkeypatch.setattr(decontam, "REMEMBERED", 3)
    search = decontam.Search(decontam.compile_items([(1, b"a b c d e f g")]))
    for words in (b"x a b c d e f g y", b"q r s t u v", b"a b c d e f g"):
        assert decontam.scan(words.split(), search)[1] == plain(words.split(), [(1, b"a b c d e f g")])[1]


def test_a_large_benchmark_needs_little_memory():
    code = """
import resource, random, numpy as np, sys
from popshift.llm import decontam
base = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
rng = np.random.default_rng(1)
words = [("w%x" % k).encode() for k in rng.integers(0, 1 << 18, 3_400_000)]
items = [(k, b" ".join(words[100 * k : 100 * k + 100])) for k in range(34_000)]
size = sum(len(t) for _, t in items)
del words
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
tables = decontam.compile_items(items)
after = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
bytes_ = sum(a.nbytes for a in tables.values())
search = decontam.Search(tables)
assert decontam.scan(decontam.words_of(items[777][1]), search)[1] == {777}
print(size, bytes_, (after - base) // 1024)
"""
    size, table, peak = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=decontam.__file__.rsplit("/", 3)[0]).stdout.split())
    assert size > 19_000_000 and table <= 15 * size and peak < 1200, (size, table, peak)
