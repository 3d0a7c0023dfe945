"""SimHash and suffix-array dedup against brute force, and the pipeline's stages."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from test_text_operators import brute_decontamination

from popshift.llm import common, simhash, suffix_dedup, suffix_sort


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    rows = [(d, brute_fingerprint(t)) for d, t in rows]
    ids = [(d, f) for d, f in rows if d is not None]
    parent = list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(ids[i][1] ^ ids[j][1]).count("1") <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    comp = {d: least[find(i)] for i, (d, _) in enumerate(ids)}
    return sorted((d if d is not None else -1, f"{f:016x}", comp.get(d, -1)) for d, f in rows)


def near_texts(n, seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(vocab, k=150)) for _ in range(6)]
    out = []
    for i in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 5, 40])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        out.append((rng.randrange(10_000), " ".join(words)))
    return list({d: (d, t) for d, t in out}.values())


def collected(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id if r.component_id is not None else -1) for r in df.collect())


@pytest.mark.parametrize("bucket", [2048, 4])
def test_simhash_equals_brute_force(make_docs, edge_rows, monkeypatch, bucket):
    """With small buckets the finer groups and the chunk pairs do the work."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rows = [*edge_rows, *near_texts(150)]
    assert collected(simhash.near_duplicates(make_docs(rows))) == brute_components(rows)


def test_spanning_links_over_several_yields(monkeypatch):
    """Ties of a root to several smaller ones, found at different times, all hold."""
    def linked(fps, starts):
        a, b = simhash.spanning_links(np.arange(len(fps)), fps, starts)
        return dict(zip(a.tolist(), b.tolist(), strict=True))

    with monkeypatch.context() as m:
        m.setattr(simhash, "close_pairs", lambda *_: iter([(np.array([5]), np.array([9])), (np.array([1, 2]), np.array([5, 9]))]))
        assert linked(np.zeros(10, np.uint64), np.array([0])) == {2: 1, 5: 1, 9: 1}
    rng = np.random.default_rng(4)
    for survivors in (1, 2, 1 << 16):
        monkeypatch.setattr(simhash, "SURVIVORS", survivors)
        for _ in range(20):
            fps = np.unique(rng.integers(0, 1 << 14, 300, dtype=np.uint64) << np.uint64(9))
            rng.shuffle(fps)
            want = np.arange(len(fps))
            near = np.array([[bin(int(x ^ y)).count("1") <= 2 for y in fps] for x in fps])
            while not np.array_equal(want, now := np.array([want[row].min() for row in near])):
                want = now
            with monkeypatch.context() as m:
                m.setattr(simhash, "close_pairs", lambda f, s, _, real=simhash.close_pairs: real(f, s, 2))
                got = linked(fps, np.array([0]))
            assert got == {i: int(w) for i, w in enumerate(want) if w != i}


def test_simhash_empty_and_representatives(make_docs, edge_rows):
    assert simhash.near_duplicates(make_docs([])).collect() == []
    rows = [*edge_rows, *near_texts(60, 3)]
    comp = {d: c for d, _, c in brute_components(rows)}
    kept = simhash.representatives(make_docs(rows))
    assert kept.columns == make_docs([]).columns
    got = Counter(r.doc_id for r in kept.collect())
    assert got == Counter({d for d, c in comp.items() if d == c and d >= 0} | {None})


def test_close_pairs_and_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    f = np.concatenate([base, base[:50] ^ np.uint64(7), base[:50] ^ np.uint64(15), base[:30] ^ np.uint64(1 << 60 | 1 << 3)])
    bucket = rng.integers(0, 3, len(f))
    order = np.argsort(bucket, kind="stable")
    f, bucket = f[order], bucket[order]
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for radius in (1, 3, 4):
        got = {(int(x), int(y)) for a, b in simhash.close_pairs(f, starts, radius) for x, y in zip(a, b, strict=True)}
        assert got == {(i, j) for i in range(len(f)) for j in range(i + 1, len(f)) if bucket[i] == bucket[j] and bin(int(f[i] ^ f[j])).count("1") <= radius}


def test_components_of_chains(spark):
    edges = [(i + 1, i) for i in range(100, 160)] + [(500, 510), (520, 510), (7, 7)]
    got = {r.node: r.component for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(101, 161)) and got[510] == got[520] == 500 and 7 not in got


def test_suffixes_and_common_prefixes_equal_sorting():
    """Whatever stays in memory: nothing, a little, all; the smaller budgets recurse, spill and map files."""
    rng = random.Random(3)
    for _ in range(150):
        t = np.array([rng.randint(0, rng.choice([1, 2, 3, 26])) for _ in range(rng.randint(1, 120))])
        want = sorted(range(len(t)), key=lambda i: t[i:].tolist())
        for mem in (suffix_sort.Memory(0, 0, 3, 2), suffix_sort.Memory(5, 64, 7, 10), suffix_sort.Memory()):
            assert suffix_sort.suffix_array(t, mem).tolist() == want
            for depth in (4, 200):
                found = list(suffix_sort.suffixes(t, mem, depth))
                order, shared = (np.concatenate(x).tolist() for x in zip(*found, strict=True))
                assert sorted(order) == sorted(want) and [t[i : i + depth].tolist() for i in order] == [t[i : i + depth].tolist() for i in want[::-1]]
                for a, b, n in zip(order, order[1:], shared[1:], strict=False):
                    x, y = t[a : a + depth].tolist(), t[b : b + depth].tolist()
                    assert n == next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))


def test_a_shard_larger_than_memory_is_sorted_on_disk():
    rng = np.random.default_rng(4)
    t = np.concatenate([np.append(rng.integers(1, 5, 60), 0) for _ in range(1500)])
    mem = suffix_sort.Memory(queues=1000, array=4096, block=2048, names=4000)
    order = np.concatenate([p for p, _ in suffix_sort.suffixes(t, mem, 50)])
    assert mem.spilled > len(t) and isinstance(mem.empty(5000, np.int32), np.memmap)
    assert [t[i : i + 50].tolist() for i in order[::-1]] == sorted(t[i : i + 50].tolist() for i in range(len(t)))


def brute_suffix(rows):
    first = {}
    for d, b in rows:
        for i in range(len(b) - 49):
            w = b[i : i + 50]
            if d is not None and (w not in first or d < first[w]):
                first[w] = d
    out = []
    for d, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if d is not None and first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d if d is not None else -1, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def passages(seed):
    rng = random.Random(seed)
    shared = ["".join(rng.choices("abcdefgh é\n", k=rng.randint(30, 220))) for _ in range(8)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 5)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts += [s[a : a + rng.randint(20, 200)], "".join(rng.choices("ijklmnop ", k=rng.randint(0, 60)))]
        rows.append((rng.randrange(1000), "".join(parts)))
    return list({d: (d, t) for d, t in rows}.values())


@pytest.mark.parametrize(("crowd", "hot"), [(100_000, 4096), (1, 4096), (100_000, 1 << 40)])
def test_suffix_dedup_equals_brute_force(make_docs, edge_rows, monkeypatch, crowd, hot):
    """With a crowd of one every contested anchor is dealt out by window; the last setting has many hot anchors, and small shards."""
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    if hot != 4096:
        monkeypatch.setattr(suffix_dedup, "hot_anchors", lambda texts: np.unique(np.concatenate([suffix_dedup.regions(np.frombuffer(r["_b"], np.uint8), np.zeros(1, np.int64), np.array([len(r["_b"])]), np.zeros(0, np.int64))[0] for r in texts.collect()]))[::2])
        monkeypatch.setattr(suffix_dedup, "SORTED", 300)
    rows = [*edge_rows[:7], (6, "lorem ipsum dolor sit amet " * 300), (6, "z" * 90), (6, "y" + "ab" * 90), *passages(1), (2000, "z" * 200), (2001, "z" * 130), (2002, "ab" * 100), (2003, "b" + "ab" * 80)]
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in map(tuple, suffix_dedup.dedup(make_docs(rows)).collect()))
    assert got == brute_suffix([(d, (t or "").encode()) for d, t in rows])


def test_regions_do_not_depend_on_neighbours_or_pieces(monkeypatch):
    """Texts hashed together give what each gives alone; windows that are equal have equal anchors at equal offsets."""
    texts = [t.encode() for _, t in passages(2)] + [b"", b"short", b"z" * 120]
    data, size = np.frombuffer(b"".join(texts), np.uint8), np.array([len(t) for t in texts])
    none = np.zeros(0, np.int64)
    together = np.array(suffix_dedup.regions(data, np.cumsum(size) - size, size, none)).T.tolist()
    alone = [[*r[:5], i] for i, t in enumerate(texts) for r in np.array(suffix_dedup.regions(np.frombuffer(t, np.uint8), np.zeros(1, np.int64), np.array([len(t)]), none)).T.tolist()]
    assert together == alone and sum(r[3] for r in alone) == sum(max(0, len(t) - 49) for t in texts)
    seen = {}
    for h, _, first, n, offset, i in alone:
        for k in range(n):
            assert seen.setdefault(texts[i][first + k : first + k + 50], (h, offset - k)) == (h, offset - k)
    monkeypatch.setattr(suffix_dedup, "PIECE", 64)
    pieces = suffix_dedup.regions(data, np.cumsum(size) - size, size, none)
    assert sum(pieces[3]) == sum(r[3] for r in alone)
    assert all(seen[texts[i][f + k : f + k + 50]] == (h, o - k) for h, _, f, n, o, i in np.array(pieces).T.tolist() for k in range(n))


def test_hot_anchors_are_found_and_split(make_docs):
    """A passage in every document with other bytes around it: its anchors are hot, and no key is in many rows."""
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefgh", k=90))
    docs = make_docs([(i, "".join(rng.choices("ABCDEFGHIJ", k=60)) + passage + "".join(rng.choices("ABCDEFGHIJ", k=60))) for i in range(400)])
    texts = suffix_dedup._tagged(suffix_dedup.text_bytes(docs, "doc_id"), None, "_b")
    hot = suffix_dedup.hot_anchors(texts)
    assert len(hot) >= 2
    rows = pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*[(r["doc_id"], r["_tag"], bytes(r["_b"])) for r in texts.collect()], strict=True)], names=["doc_id", "_tag", "_b"])])
    found = [r for b in suffix_dedup._find(rows.to_batches(), hot) for r in b.to_pylist() if not r["span"] & suffix_dedup.BYTES]
    assert max(Counter(r["h"] for r in found).values()) <= 64  # hot is what more than 64 rows of the sample share


def test_crowded_windows_are_folded_before_the_sort():
    """A passage with other bytes around it in each document, and a text of one character: a row a window and task goes to the sort."""
    rng = random.Random(5)
    passage = "".join(rng.choices("abcdefgh", k=90)).encode()
    texts = [bytes(rng.choices(range(65, 90), k=20)) + passage + bytes(rng.choices(range(65, 90), k=20)) for _ in range(500)] + [b"z" * 5000]
    asked = [[{"c": 1, "first": 0, "n": len(t) - 49, "offset": 0, "crowded": True}] for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts, pa.binary()), pa.array(asked)], names=["doc_id", "_tag", "_b", "_asked"])
    out = pa.Table.from_batches(suffix_dedup._cut_out([batch])).to_pylist()
    sent = Counter(r["bytes"] for r in out if r["bytes"] is not None)
    assert max(sent.values()) == 1 and set(sent) == {t[i : i + 50] for t in texts for i in range(len(t) - 49)}
    assert all(r["lead"] == 0 for r in out if r["bytes"] is None and r["doc"] == 500)


def test_clashing_columns_survive_suffix_dedup(spark):
    """Columns named like the operator's own come back untouched; so do null texts; an empty table stays empty."""
    names = ["doc_id", "text", "_gone", "_row", "doc", "tag", "_tag", "_twin", "h", "n_chars"]
    rows = [(i, ("x%d " % i) * 5 + "a passage that is long enough to be found in both of the documents" if i < 2 else None, 1, "r", 2, 3, 4, True, 5, 9) for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _gone int, _row string, doc int, tag int, _tag int, _twin boolean, h int, n_chars long")
    out = sorted(suffix_dedup.deduplicated(docs).collect())
    assert [r[2:9] for r in out] == [(1, "r", 2, 3, 4, True, 5)] * 3 and out[0].text == rows[0][1] and out[1].text == "x1 " * 4 + "x1" and out[2].text is None
    assert out[1].n_chars == len(out[1].text) and suffix_dedup.deduplicated(docs.limit(0)).collect() == [] and docs.columns == names


@pytest.mark.parametrize("rows", [2, 10_000])
def test_folded_windows_equal_brute_force(make_docs, monkeypatch, rows):
    """Windows that recur within a document (close by and far apart) follow the one that was sent, whichever task decides."""
    monkeypatch.setattr(suffix_dedup, "CROWD", 1)
    monkeypatch.setattr(common, "BATCH_ROWS", rows)
    line = "".join(random.Random(6).choices("abcdefgh ", k=83)) + "\n"
    rows = [(9, line * 6 + "y" * 120), (3, "x" + line * 4), (7, "y" * 90 + line + "q" * 70 + line), (1, line[10:75] + "end"), (8, "end" + line * 3 + "y" * 60), *passages(2)]
    rows = list({d: (d, t) for d, t in rows}.values())
    got = sorted(map(tuple, suffix_dedup.dedup(make_docs(rows)).collect()))
    assert got == brute_suffix([(d, t.encode()) for d, t in rows])


def test_suffix_dedup_table(make_docs, edge_rows):
    rows = [*edge_rows[:7], *passages(2)]
    docs = make_docs(rows)
    out = suffix_dedup.deduplicated(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    want = {d: b for d, b in ((r[0], r[4]) for r in brute_suffix([(d, (t or "").encode()) for d, t in rows]))}
    for r in out.collect():
        if r.doc_id is not None and r.text is not None and "é" not in dict(rows)[r.doc_id]:
            assert hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id] and r.n_chars == len(r.text)
    assert suffix_dedup.dedup(make_docs([])).collect() == []


def test_pipeline_as_a_whole(spark):
    """run() gives what the stages give one after another."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, docs.collect()))


def test_pipeline_stages_take_edges_and_empty_tables(spark, make_docs, edge_rows):
    import corpus_pipeline

    for rows in ([*edge_rows[:7], *edge_rows[8:]], []):
        for name, stage in corpus_pipeline.STAGES:
            docs = make_docs(rows)
            out = stage(spark, docs, "/root/testdata/sf0.001")
            assert (out.columns == docs.columns or name == "bpe_encoding") and out.count() <= len(rows)
            if name in ("suffix_array_dedup", "bpe_encoding"):
                assert out.count() == len(rows)


def test_pipeline_stages(spark, make_docs):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, sf)
        rows = out.collect()
        if name == "language_id":
            assert len(rows) >= 0.97 * n
        if name == "simhash_near_dedup":
            assert sorted(r.doc_id for r in rows) == sorted({c for _, _, c in brute_components(before)})
        if name == "suffix_array_dedup":
            want = {r[0]: r[2] for r in brute_suffix([(d, t.encode()) for d, t in before])}
            texts = dict(before)
            assert all((r.text == texts[r.doc_id]) == (want[r.doc_id] == 0) for r in rows) and len(rows) == len(before)
        if name == "benchmark_decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            assert {r.doc_id for r in rows} == {r[0] for r in brute_decontamination(before, items) if not r[5]}
        if name == "bpe_encoding":
            assert {r.doc_id for r in rows} == {d for d, _ in before}
        docs = out if name == "bpe_encoding" else spark.createDataFrame(rows, docs.schema)
    assert [s for s, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "suffix_array_dedup", "benchmark_decontamination", "bpe_encoding"]
