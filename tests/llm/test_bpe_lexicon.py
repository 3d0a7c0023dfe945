"""The BPE lexicon comes from the words of all texts."""

from collections import Counter
from random import Random

from pyspark.sql import functions as F

from popshift.llm import bpe


def all_words(tokenizer, texts):
    return Counter(w.encode() for t in texts for w in tokenizer.words(t or "") if isinstance(w, str) and len(w.encode()) <= bpe.LONGEST)


def held(lexicon):
    return len(lexicon.starts) - 1


def test_words_of_every_text_are_compiled(spark):
    """40,000 texts in which 20,000 words occur twice each: more texts than were drawn before, and every word is needed."""
    letters = F.translate(F.format_string("%05d", F.floor(F.col("id") / 2)), "0123456789", "abcdefghij")
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), letters).alias("text"))
    lexicon, tokenizer = bpe.compile_lexicon(docs, bpe.tokenizer_file()), bpe.Tokenizer(bpe.tokenizer_file())
    words = [b"w" + bytes(97 + int(d) for d in f"{k:05d}") for k in range(20_000)]
    assert held(lexicon) == len(words)
    assert [None if ids is None else ids.tolist() for ids in lexicon.find(words)] == [tokenizer.merge(w) for w in words]


def test_word_counts_equal_brute_force(spark, sf, make_docs, edge_rows, monkeypatch):
    tokenizer = bpe.Tokenizer(bpe.tokenizer_file())
    odd = [(50, "<|startoftext|>hi<|endoftext|> it's It's"), (51, "q\x1fr q\x1fr"), (52, "日本語 日本語 İstanbul ſ x²"), (53, "b" * 25 + " " + "é" * 13 + " " + "é" * 12)]
    some = spark.read.parquet(f"{sf}/documents.parquet")
    for docs in (make_docs([*edge_rows, *odd]), some, make_docs([])):
        want = all_words(tokenizer, [r.text for r in docs.select("text").collect()])
        for counted, kept in ((bpe.COUNTED, bpe.HELD), (3, bpe.HELD), (bpe.COUNTED, 40)):
            with monkeypatch.context() as m:
                m.setattr(bpe, "COUNTED", counted), m.setattr(bpe, "HELD", kept)
                assert {bytes(r["word"]): r["n"] for r in bpe.word_counts(docs, bpe.tokenizer_file()).collect()} == want


def test_most_frequent_words_fill_the_lexicon(make_docs):
    docs = make_docs([(k, "aa bb cc dd"[: 3 * n - 1]) for k, n in enumerate([1, 2, 4, 4])])  # aa 4, bb 3, cc and dd 2
    for size, want in ((1, [b"aa"]), (2, [b"aa", b"bb"]), (3, [b"aa", b"bb"]), (4, [b"aa", b"bb", b"cc", b"dd"]), (0, [])):
        lexicon = bpe.compile_lexicon(docs, bpe.tokenizer_file(), size)
        assert held(lexicon) == len(want) and all(ids is not None for ids in lexicon.find(want))


def test_words_merged_together_equal_single_ones(monkeypatch):
    tokenizer, random = bpe.Tokenizer(bpe.tokenizer_file()), Random(5)
    words = [bytes(random.choice(letters) for _ in range(random.randint(1, bpe.LONGEST))) for letters in (b"aab", b"ethinos", "éßth日".encode(), bytes(range(256))) for _ in range(400)]
    words += [b"a", b"a" * bpe.LONGEST, b"the", b"tionthtion"]
    want = [tokenizer.merge(w) for w in words]
    for block in (bpe.BLOCK, 7, 1):
        monkeypatch.setattr(bpe, "BLOCK", block)
        assert tokenizer.merge_all(words) == want
    assert tokenizer.merge_all([]) == []
