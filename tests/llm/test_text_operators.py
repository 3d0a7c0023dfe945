"""BPE, language ID, media and decontamination against the library, brute force and held-out rows."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from popshift.llm import bpe, decontam, langid, media
from popshift.llm.queries import QUERIES

TRICKY = ["", "  ", "a" * 500, "!!!" * 300, "<|startoftext|>hi<|endoftext|> yo", "ΣΑΣ ΟΔΟΣ İstanbul ſ ﬁ Ⅷ ½ x²", "\0abc \0 \x01", "it's we'll I'D don't", "日本語 テスト　한국어 🙂👍🏽 é", "x\u200by z\x85w\x1cq\x1f", "<|startoftext|", "123 45.6%", "e\u0301 \u0301a"]


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_str(bpe.tokenizer_file())


def expected_bpe(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_equals_library(spark, sf, tokenizer, make_docs, edge_rows):
    docs = make_docs([*edge_rows, *[(100 + i, t) for i, t in enumerate(TRICKY)]])
    some = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (docs, some):
        rows = [(-1 if r.doc_id is None else r.doc_id, r.text or "") for r in df.collect()]
        got = sorted(tuple(x if x is not None else -1 for x in r) for r in bpe.encode(df, bpe.tokenizer_file()).collect())
        assert got == sorted((d, *expected_bpe(tokenizer, t)) for d, t in rows)


def test_bpe_any_lexicon_gives_the_same_ids(tokenizer, tmp_path):
    t = bpe.Tokenizer(bpe.tokenizer_file())
    texts = ["the quick brown fox thndrionings " * 3, "thndrioning the"]
    for words in ([], [b"the", b"quick", b"thndrionings", b"thndrioning"]):
        (tmp_path / "lexicon").write_bytes(bpe.Lexicon.build({w: t.merge(w) for w in words}).dump())
        lexicon = bpe.Lexicon.mapped(str(tmp_path / "lexicon"))
        for (ids, text), source in zip(bpe.Encoder(t, lexicon).encode(texts), texts, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(source, add_special_tokens=False).ids
            assert text == tokenizer.decode(tokenizer.encode(source, add_special_tokens=False).ids, skip_special_tokens=False)


def test_bpe_automaton_is_minimal_and_exact():
    words = {w.encode(): [i, i + 1] for i, w in enumerate("tap taps top tops stop stops".split())}
    lexicon = bpe.Lexicon.build(words)
    assert len(lexicon.finals) == 7  # shared suffixes: fewer states than letters
    found = lexicon.find([*words, b"to", b"topss", b"x", b"", b"y" * 60])
    assert [x.tolist() for x in found[:6]] == list(words.values()) and found[6:] == [None] * 5


def test_bpe_heap_equals_scan():
    t = bpe.Tokenizer(bpe.tokenizer_file())
    for word in (b"thethethethe" * 5, b"aaaaaaaabaaaaaaa" * 4, bytes(range(97, 123)) * 3):
        ids = [*(t.inner[b] for b in word[:-1]), t.last[word[-1]]]
        assert t._by_heap(list(ids)) == t._by_scan(list(ids))


def test_bpe_empty_table(make_docs):
    assert bpe.encode(make_docs([]), bpe.tokenizer_file()).collect() == []


def test_language_id_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pred = QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in pred if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in pred)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in pred) and sum(r.rejected for r in pred) / len(pred) < 0.02


def test_language_id_edges(spark, make_docs, edge_rows):
    training = [(1000 + i, t, lang) for i in range(40) for t, lang in (("the and of to in that is was " * 3, "en"), ("der die und das nicht ist ein zu " * 3, "de"), ("text without a label", None))]
    model = langid.fit(make_docs(training))
    got = {r.doc_id: r for r in langid.identify(make_docs(edge_rows), model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == got[8].lang_pred == "und"
    assert got[6].lang_pred in ("en", "de") and got[7].lang_pred in ("en", "de") and got[9].lang_pred in ("en", "de")
    assert not got[None].held_out and langid.identify(make_docs([]), model).count() == 0
    nothing = langid.fit(make_docs([]))
    assert {r.lang_pred for r in langid.identify(make_docs(edge_rows), nothing).collect()} == {"und"}
    kept = langid.accepted(make_docs(edge_rows), model)
    assert kept.columns == make_docs([]).columns and 2 not in {r.doc_id for r in kept.collect()}


def test_language_prediction_equals_a_plain_version(make_docs):
    """Averages of class weights over every n-gram, one at a time; digits that are word characters are no letters."""
    training = [(1000 + i, t, lang) for i in range(40) for t, lang in (("the and of to in that is was", "en"), ("der die und das nicht ist ein zu", "de"))]
    m = langid.fit(make_docs(training))
    texts = ["The cat IS on the mat, 12 times!", "die Katze", "x", "é", "a" * 300, "½ ² ① 12", "¹a"]
    got = {r.doc_id: r for r in langid.identify(make_docs(list(enumerate(texts))), m).collect()}
    for i, text in enumerate(texts):
        if not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        letters = "".join(c if "a" <= c <= "z" or ord(c) >= 128 else " " for c in text.lower())
        raw = (" " + " ".join(x for x in letters.split(" ") if x) + " ").encode()
        raw = raw.ljust(3)
        total, n = np.zeros(2), 0
        for size, k in zip(langid.ORDERS, langid._MULTIPLIERS.tolist(), strict=True):
            for j in range(len(raw) - size + 1):
                gram = int.from_bytes(raw[j : j + size], "big")
                total += m.weights[(gram * k & 0xFFFFFFFF) >> 17]
                n += 1
        z = (total / n + m.bias) / m.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert got[i].lang_pred == m.langs[int(p.argmax())] and abs(got[i].score - p.max()) < 1e-6


def brute_stats(samples):
    """The figures of sound at twice its rate, a sample at a time."""
    n = len(samples)
    x = lambda i: int(samples[min(max(i, 0), n - 1)])
    out = []
    for i in range(n):
        out += [x(i), max(-32768, min(32767, (9 * (x(i) + x(i + 1)) - x(i - 1) - x(i + 2) + 8) >> 4))]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(out, out[1:], strict=False))
    return f"n={len(out)},mean={sum(out) // len(out)},power={sum(v * v for v in out) // len(out)},peak={max(map(abs, out))},crossings={crossings}"


def test_media_features_and_stored_pcm_equal_a_sample_at_a_time(make_docs):
    texts = ["", "hello telephone", "ÿþ\x01" * 50, "q" * 129]
    for r in media.resampled(make_docs(list(enumerate(texts)))).collect():
        payload = media.pad(texts[r.doc_id].encode())
        ima = media.decode_ima(np.frombuffer(payload, np.uint8).reshape(-1, 64)).ravel()
        by = {"mulaw": [int(media.MULAW[b]) for b in payload], "alaw": [int(media.ALAW[b]) for b in payload], "ima": ima.tolist()}
        assert r.feature == ";".join(f"{k}:{brute_stats(v)}" for k, v in by.items())
        x = lambda i, v=by["mulaw"]: v[min(max(i, 0), len(v) - 1)]
        want = []
        for i in range(0, len(payload), 2):
            half = (16 * x(i) + 9 * (x(i - 1) + x(i + 1)) - x(i - 3) - x(i + 3) + 16) >> 5
            want.append(max(-128, min(127, (max(-32768, min(32767, half)) + 128) >> 8)) + 128)
        assert list(r.pcm) == want


def test_media_rows_are_decoded_in_portions(make_docs, monkeypatch):
    docs = make_docs([(i, chr(97 + i) * (100 * i)) for i in range(9)])
    whole = sorted(map(tuple, media.features(media.store(docs)).collect()))
    monkeypatch.setattr(media, "PORTION", 300)
    assert sorted(map(tuple, media.features(media.store(docs)).collect())) == whole


def test_media_round_trip(spark, make_docs, edge_rows):
    docs = make_docs(edge_rows)
    texts = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    for codec in ("mulaw", "alaw", "ima"):
        stored = media.store(docs, codec)
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) for r in media.features(stored).collect())
        want = []
        for d, b in texts:
            p = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
            want.append((-1 if d is None else d, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(media.to_wave(p, codec))))
        assert got == sorted(want)
    features = {}
    for r in media.features(media.store(docs)).collect():
        features.setdefault(r.payload_sha256, set()).add((r.feature, r.media_sha256))
    assert all(len(v) == 1 for v in features.values())
    assert media.features(media.store(make_docs([]))).collect() == []


def test_adpcm_equals_a_sample_at_a_time():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (7, 64), dtype=np.uint8)
    got = media.decode_ima(blocks)
    for block, out in zip(blocks, got, strict=True):
        value = int(np.array([int(block[0]) | int(block[1]) << 8], np.uint16).view(np.int16)[0])
        index, want = min(int(block[2]), 88), [value]
        for byte in block[4:]:
            for code in (int(byte) & 15, int(byte) >> 4):
                step = int(media.STEPS[index])
                diff = step >> 3
                diff += step if code & 4 else 0
                diff += step >> 1 if code & 2 else 0
                diff += step >> 2 if code & 1 else 0
                value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
                index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
                want.append(value)
        assert out.tolist() == want


def test_companding_tables():
    assert media.MULAW[0xFF] == 0 and media.MULAW[0x00] == -32124 and media.MULAW[0x80] == 32124
    assert media.ALAW[0xD5] == 8 and media.ALAW[0x55] == -8 and abs(int(media.ALAW[0x2A])) == 32256
    with pytest.raises(ValueError):
        media.from_wave(b"RIFF....WAVX")


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_decontamination(docs, items):
    words = lambda t: WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    windows = {}
    for item, text in items:
        w = words(text)
        m = min(10, len(w))
        for i in range(len(w) - m + 1) if w and item is not None else ():
            windows.setdefault(tuple(w[i : i + m]), set()).add(item)
    out = []
    for d, text in docs:
        w, hit, which = words(text), set(), set()
        for i in range(len(w)):
            for m in range(1, 11):
                found = windows.get(tuple(w[i : i + m])) if i + m <= len(w) else None
                if found:
                    hit |= set(range(i, i + m))
                    which |= found
        out.append((d if d is not None else -1, len(w), len(hit), len(which), hashlib.sha256(",".join(sorted(map(str, which))).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_decontamination_equals_brute_force(spark, make_docs, edge_rows):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    items = [(1, item), (2, "Short Item here"), (3, "x9"), (4, None), (5, ""), (None, "nine"), (10, item), (10, item), (6, "the the the the the the the the the the the")]
    docs = [*edge_rows, (20, f"before {item} after"), (21, "Alpha, beta; GAMMA delta epsilon zeta eta theta iota kappa"), (22, "a short item here and x9 x9"), (23, "the " * 30), (24, f"{item} {item}"), (25, "alpha beta gamma delta epsilon zeta eta theta iota")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(-1 if x is None else x for x in r) for r in decontam.decontaminate(make_docs(docs), bench).drop("items", "spans").collect())
    assert got == brute_decontamination(docs, items)
    kept = {r.doc_id for r in decontam.clean(make_docs(docs), bench).collect()}
    assert not kept & {20, 21, 22, 23, 24} and {25, 1, 2, 6} <= kept
    assert decontam.decontaminate(make_docs([]), bench).collect() == []
    assert not any(r.contaminated for r in decontam.decontaminate(make_docs(docs), bench.limit(0)).collect())


def test_decontamination_in_blocks(spark, make_docs, monkeypatch):
    items = [(i, f"w{i} a b c d e f g h i{i} tail{i}") for i in range(7)]
    docs = [(i, f"x w{i} a b c d e f g h i{i} y") for i in range(9)] + [(50, "w1 a b c d e f g h i1 w2 a b c d e f g h i2")]
    monkeypatch.setattr(decontam, "CHARS_PER_BLOCK", 300)
    got = sorted(tuple(r) for r in decontam.decontaminate(make_docs(docs), spark.createDataFrame(items, "item_id long, text string")).drop("items", "spans").collect())
    assert got == brute_decontamination(docs, items)
