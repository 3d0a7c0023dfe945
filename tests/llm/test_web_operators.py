"""HTML extraction, WARC, licence scan and URL filters."""

import base64
import hashlib
import html
import math
import re
import sys

import pytest

from popshift.llm import html_extract, html_tree, license_scan, urlfilter, warc
from popshift.llm.html_labels import labelled_pages
from popshift.llm.html_tree import parse


@pytest.fixture(scope="module")
def model():
    return html_extract.default_model()


def article(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", body))).split())


def test_html_pages_of_the_table(spark, sf, model):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert html_extract.extract_pages([p.html for p in pages], model) == [article(p.html) for p in pages]


def test_html_held_out_layouts(model):
    import numpy as np

    wrong = total = 0
    for page in labelled_pages(60, 99):
        nodes = parse(page)[0]
        own = np.array([n.own for n in nodes]) > 0
        p = html_extract.Batch([nodes]).marginals(*model)[0] > 0.5
        wrong, total = wrong + int(((p != np.array(html_extract.labels(nodes))) & own).sum()), total + int(own.sum())
    assert wrong / total < 0.03


def test_html_messages_equal_enumeration():
    """Marginals of a small tree by summing over all assignments."""
    from itertools import product

    import numpy as np

    nodes = parse("<div class='a'><p>x<b>y</b></p><ul><li>z</li></ul></div>")[0]
    rng = np.random.default_rng(0)
    nw, ew = rng.normal(size=html_extract.FEATURES), rng.normal(size=(4, 2, 2))
    batch = html_extract.Batch([nodes])
    f = html_extract.features(nodes)
    own = [sum(nw[k] for k in x) for x in f]
    p, z = np.zeros(len(nodes)), 0.0
    for y in product((0, 1), repeat=len(nodes)):
        w = np.exp(sum(o for o, v in zip(own, y, strict=True) if v) + sum(ew[html_extract.kind(n.name), y[n.parent], y[i]] for i, n in enumerate(nodes) if n.parent >= 0))
        z += w
        p += w * np.array(y)
    assert np.allclose(batch.marginals(nw, ew)[0], p / z)


def test_html_edges(spark, model):
    main = "<html><body><nav><a href='/'>Home</a></nav><div id='content'><h1>T</h1><p>a&nbsp;b &amp;amp; c<p>d<!-- x --><script>if (a</p>b) {}</script><table><tr><td>1<td>2</table></div><div class='comments'><p>nice</p></div><footer>f</footer></body></html>"
    long = "<article><h1>T</h1>" + "<p>word one two</p>" * 20_000 + "</article>"
    rows = [(1, "u", None), (2, None, ""), (3, "u", main), (3, "u", main), (None, "u", "<article>x</article>"), (4, "u", long), (5, "u", "<<<>>>< a <p"), (6, "u", "<div " * 5000)]
    got = [(r.page_id, r.text, r.n_chars) for r in html_extract.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int"), model).collect()]
    by = {g[0]: g[1] for g in got}
    assert by[1] == by[2] == "" and by[3] == "T a b &amp; c d 1 2" and by[None] == "x" and len(got) == len(rows)
    assert by[4] == "T" + " word one two" * 20_000 and all(len(t) == n for _, t, n in got)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).collect() == []


def test_deep_pages_take_linear_time():
    """Unclosed, wrongly closed and paragraph-ending tags in great depth: four times the page, no more than about four times the work."""
    def steps(n):
        pages = ["<div>" * n + "</b>" * n, "<p><span>" * n, "<b>" * n + "<p>" * n, "<table><tr><td>" * n + "</x>" * n, "<ul><li>" * n + "</li>" * n, "<dl><dt>" * n]
        counted = 0

        def tick(frame, event, arg):
            nonlocal counted
            counted += event == "line"
            return tick

        for page in pages:
            sys.settrace(tick)
            nodes, _ = html_tree.parse(page)
            sys.settrace(None)
            assert len(nodes) > n
        return counted

    assert steps(2000) < 5 * steps(500)


def test_end_tags_stop_at_scopes():
    nodes, pieces = html_tree.parse("<div>a<table><tr><td>b</div>c</td></tr></table>d</div>e<li>f<ul><li>g<li>h</ul>i<li>j")
    at = {t: nodes[i].name for i, t in pieces if i >= 0}
    assert at["c"] == "td" and at["d"] == "div" and at["e"] == "#page"
    path = lambda i: [] if i <= 0 else [*path(nodes[i].parent), nodes[i].name]
    of = {t: path(i) for i, t in pieces if i >= 0}
    assert of["g"] == of["h"] == ["li", "ul", "li"] and of["i"] == ["li"] == of["j"]


def expected_warc(rows, least=0):
    payload = lambda h: (h or "").encode()
    best = {}
    for p, _, h in rows:
        if p is not None:
            best[payload(h)] = max(best.get(payload(h), p), p)
    out = []
    for p, _, h in rows:
        b = payload(h)
        top = best.get(b) if len(b) >= least else None
        refers = top if top is not None and top != p else None
        out.append((p if p is not None else -1, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if refers is None else "revisit", -1 if refers is None else refers))
    return sorted(out)


@pytest.mark.parametrize(("segment", "least"), [(16384, 0), (70, 0), (120, 3)])
def test_warc_round_trip(spark, tmp_path, segment, least):
    rows = [(1, "http://a/", "same"), (2, None, "same"), (9, "x\r\ny", "same"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 3000 + "\r\n\r\nWARC/1.1\r\n"), (6, "u", "<p>0\r\n\r\n" * 900), (7, "u", "x"), (7, "u", "x"), (None, "u", "same"), (None, "u", "alone")]
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, record string"), path, least, segment)
    got = sorted(tuple(-1 if v is None else v for v in r) for r in warc.read_back(spark, path).collect())
    assert got == expected_warc(rows, least)


def test_warc_empty_and_broken(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_back(spark, path).count() == 0
    (record,) = warc.records("r", 1, "u", b"payload", None)
    good = record + b"\r\n\r\n"
    ((fields, block),) = warc.parse(good)
    assert warc.payload_of(block) == b"payload" and fields["warc-type"] == "response"
    for bad in (good[:-6], good.replace(b"Content-Length: ", b"Content-Length: 9"), b"x" + good):
        with pytest.raises(ValueError):
            list(warc.parse(bad))
    with pytest.raises(ValueError):
        warc.dechunk(b"5\r\nabc\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        warc.reassemble([(1, None, b"a"), (3, 2, b"b")])
    with pytest.raises(ValueError):
        warc.reassemble([(1, None, b"a"), (2, 3, b"b")])
    assert warc.reassemble([(2, 2, b"b"), (1, None, b"a")]) == b"ab"


def test_license_lines(spark, make_docs, edge_rows):
    lines = {"Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under the Apache License, Version 2.0.": "apache", "Released under the MIT License.": "mit", "All rights reserved.": "proprietary"}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.families for r in license_scan.scan(docs).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == ",".join(sorted({f for line, f in lines.items() if line in r.text.split("\n")})), r.doc_id
    rows = [*edge_rows, (30, "intro\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0."), (31, "The license of the driver was lost under the general public.")]
    out = {r.doc_id: r for r in license_scan.scan(make_docs(rows)).collect()}
    assert out[30].families == "apache,mit" and out[30].n_notices == 2 and out[31].family is None and out[1].families == out[2].families == ""
    assert license_scan.scan(make_docs([])).collect() == []


def plain_scan(text, m):
    """The model over each line, a bigram at a time."""
    sure = []
    for line in (text or "").split("\n"):
        words = [w for w in re.split(r"[^a-z0-9]+", line.lower()) if w]
        grams = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))
        if not grams:
            continue
        z = [(b + sum(round(float(m.weights[g][i]), 6) for g in grams if g in m.weights)) / m.temperature for i, b in enumerate(m.bias)]
        e = [math.exp(v - max(z)) for v in z]
        best = z.index(max(z))
        share = sum(best in m.within.get(g, ()) for g in grams) / len(grams)
        if m.families[best] != license_scan.UNKNOWN and 1 / sum(e) >= m.threshold and share >= license_scan.CONFIRMED:
            sure.append((-1 / sum(e), m.families[best]))
    return (min(sure)[1], -min(sure)[0], len(sure), ",".join(sorted({f for _, f in sure}))) if sure else (None, None, 0, "")


def test_license_scan_equals_a_plain_version(spark):
    m = license_scan.fit()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in license_scan.scan(docs, m).collect()}
    for r in docs.collect():
        family, score, n, families = plain_scan(r.text, m)
        found = got[r.doc_id]
        assert (found.family, found.n_notices, found.families) == (family, n, families)
        assert found.score == (pytest.approx(score) if score is not None else None)


def brute_judge(rows):
    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        return host.translate({c: c + 32 for c in range(65, 91)}), path

    judged = []
    for p, u in rows:
        host, path = parts(u)
        fits = [(len(h + q), w, h + q) for w, h, q in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(q)]
        judged.append((p, host, path, *(max(fits)[2:0:-1] if fits else (None, None))))
    listed = {j[1] for j in judged if j[4] == "block"}
    return sorted((-1 if p is None else p, h, q, r or "", v or ("block" if h in listed else "allow")) for p, h, q, r, v in judged)


@pytest.mark.parametrize("bits", [1 << 28, 100])
def test_url_filters_equal_brute_force(spark, monkeypatch, bits):
    """With few bits for a filter the list is dealt to several cascades."""
    monkeypatch.setattr(urlfilter, "MAX_FILTER_BITS", bits)
    urls = ["http://A.example.COM/en/1", "https://www.example.com/en/x", "http://b.net/es/", "http://b.net/de/", "http://b.net", "ftp://net/fr/1?x#y", None, "", "no scheme", "http://x.com?a=/en/", "http://notexample.com/en/", "http://h\n.org/p\nq?z", "x://y://z/es/", "http://q.com/", "http://deep.www.example.com/en/", "http://U:80/ESS", "http://b.net/de/"]
    rows = [*enumerate(urls), (None, "http://b.net/de/"), *[(1000 + i, f"http://h{i % 150}.{'net' if i % 3 else 'org'}/{'es' if i % 150 < 40 and i < 150 else 'de'}/") for i in range(400)]]
    pages = spark.createDataFrame([(*r, "k", True) for r in rows], "page_id long, url string, key string, listed boolean")
    got = sorted((-1 if r.page_id is None else r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in urlfilter.judge(pages).collect())
    assert got == brute_judge(rows)


def test_url_filters_empty(spark):
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string")).collect() == []
