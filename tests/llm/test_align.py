"""Cross-tokenizer alignment against the libraries on whole texts and a plain count of pairs."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from popshift.llm import align
from popshift.llm.bpe import byte_characters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: k for k, c in enumerate(byte_characters())}

    def tokens(text):
        """[(id, bytes)] of both sides, or None."""
        if not text:
            return None
        raw = (" " + text).encode()
        xs = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        ys = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        return (xs, ys) if b"".join(t for _, t in xs) == raw == b"".join(t for _, t in ys) else None

    def groups(text):
        both = tokens(text)
        if both is None:
            return None, 0, 0
        ends = [np.cumsum([len(t) for _, t in side]).tolist() for side in both]
        cuts, out, at = sorted(set(ends[0]) & set(ends[1])), [], [0, 0]
        for cut in cuts:
            group = []
            for k in range(2):
                stop = ends[k].index(cut) + 1
                group.append([i for i, _ in both[k][at[k] : stop]])
                at[k] = stop
            out.append(group)
        return out, len(both[0]), len(both[1])

    def rows(docs):
        found = [(d, *groups(t)) for d, t in docs]
        held = [Counter((x, y) for xs, ys in g or () for x in xs for y in ys) for _, g, _, _ in found]
        count = Counter(pair for links in held for pair in links)
        most = defaultdict(int)
        for (x, _), n in count.items():
            most[x] = max(most[x], n)
        out = []
        for (d, g, n_a, n_b), links in zip(found, held, strict=True):
            said = ";".join(f"{','.join(map(str, xs))}|{','.join(map(str, ys))}" for xs, ys in g or ())
            out.append((d, n_a, n_b, len(g or ()), sum(links.values()), sum(n for (x, y), n in links.items() if count[x, y] == most[x]), sum(n * count[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if g is not None else ""))
        return sorted(out, key=repr)

    return rows


def got(df):
    return sorted([(r["doc_id"], *(r[n] for n in align._OUT), r["groups_sha256"]) for r in df.collect()], key=repr)


ODD = ["  two  spaces ", " ", "\n", "\t", " \t\n x", "a\r\nb\tc", "word\n\n\tword", "<|endoftext|> <s></s><unk>", "日本語のテキスト", "ünïcödé ßtraße", "\U0001f642\U0001f642 ok", "x▁y", "a\x00b", "\xa0nbsp\xa0 x", "it's we'll 12345 67,8", "=" * 300, "-=" * 100, "   " * 50 + "end", "();\r\n}\r", "é   　z", "trailing ", "\x1c \x1d x", "'s 't", "<0x0A>"]


def test_edge_rows_and_odd_texts(plain, make_docs, edge_rows):
    docs = [(r[0], r[1]) for r in edge_rows] + [(100 + k, t) for k, t in enumerate(ODD)] + [(500, ODD[7]), (500, ODD[7])]
    assert got(align.align(make_docs(docs), A, B)) == plain(docs)
    assert align.align(make_docs([]), A, B).count() == 0


def test_random_texts_in_many_portions_and_rounds(plain, make_docs):
    """Tiny portions and a fan-in of two: several rounds of merging, hot pairs that every document has."""
    rng = random.Random(4)
    bits = ["the", " the", " ", "  ", "\n", "\t", "\r", ".", "thing", "ß", "é", "日", "'s", "99", "<s>", "\xa0", "}", ")", ";", "a" * 30, "\x85", "▁", "\U0001f642"]
    docs = [(k, "the " + "".join(rng.choices(bits[:-2] if k % 9 else bits, k=rng.randint(0, 60)))) for k in range(300)]
    assert got(align.align(make_docs(docs), A, B, radix=4, records=200, fan_in=2)) == plain(docs)


def test_table_of_the_query(spark, plain, sf):
    from popshift.llm.common import read

    docs = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert got(align.op12_cross_tokenizer_alignment(spark, sf)) == plain([(r["doc_id"], r["text"]) for r in docs])
    assert read(spark, sf, "documents").count() == len(docs)


def test_merge_is_whole_and_side_major():
    rng = np.random.default_rng(2)
    runs, all_ = [], Counter()
    for size in (0, 1, 10, 70_000, 50_000):
        pairs = np.unique(rng.integers(0, 1 << 20, size) << 7)
        counts = rng.integers(1, 9, len(pairs))
        all_.update(dict(zip(pairs.tolist(), counts.tolist(), strict=True)))
        runs.append((align.pack(pairs, "<i8", True), align.pack(counts, "<i8")))
    parts = list(align.merged(runs))
    pairs, counts = (np.concatenate([p[k] for p in parts]) for k in range(2))
    assert (np.diff(pairs) > 0).all() and dict(zip(pairs.tolist(), counts.tolist(), strict=True)) == all_
    best = align.best_of(pairs, counts)
    most = defaultdict(int)
    for p, n in all_.items():
        most[p >> align.SHIFT] = max(most[p >> align.SHIFT], n)
    assert best.tolist() == [all_[p] == most[p >> align.SHIFT] for p in pairs.tolist()]
