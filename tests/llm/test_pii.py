"""Personal data: base spans against the plain patterns, disguises, offsets, edge rows."""

import hashlib
import random
import re

from popshift.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        d = int(c)
        total += d if k % 2 == 0 else (2 * d if 2 * d < 10 else 2 * d - 9)
    return total % 10 == 0


def holds(kind, s):
    digits = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]


def plain(text):
    return sorted((m.start(), list(PLAIN).index(kind), m.end()) for kind, p in PLAIN.items() for m in p.finditer(text or "") if holds(kind, m[0]))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(5)
    parts = ["@", ".", "-", " ", "a", "b1", "4", "11", "+", "(", ")", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "x@y.zz", "+1 (017) 555-7713", "é", "\n", "%"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 30)))
        assert pii.spans_of(text)[0] == plain(text), text


def test_disguises_lead_back_to_the_source():
    cases = {
        "write john [at] example [dot] com now": ("email", "john [at] example [dot] com"),
        "or ann dot lee at mail dot co dot uk today": ("email", "ann dot lee at mail dot co dot uk"),
        "by jоhn@exаmple.com here": ("email", "jоhn@exаmple.com"),
        "by user＠example．com here": ("email", "user＠example．com"),
        "jan.k at mail.example.org": ("email", "jan.k at mail.example.org"),
        "me @ example . com": ("email", "me @ example . com"),
        "x_at_example_dot_com": ("email", "x_at_example_dot_com"),
        "a​b@example.com": ("email", "a​b@example.com"),
        "call plus four nine one seven one two three four five six seven": ("phone", "plus four nine one seven one two three four five six seven"),
        "host one two seven dot zero dot zero dot one is": ("ip", "one two seven dot zero dot zero dot one"),
        "host 192[.]168[.]0[.]1 is": ("ip", "192[.]168[.]0[.]1"),
        "host 10 dot 0 dot 0 dot 1 is": ("ip", "10 dot 0 dot 0 dot 1"),
        "pay ４１１１ 1111 1111 1111": ("card", "４１１１ 1111 1111 1111"),
        "pay 4111-1111-1111-11l1": ("card", "4111-1111-1111-11l1"),
        "pay vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins": ("card", "vier eins eins eins eins eins eins eins eins eins eins eins eins eins eins eins"),
        "\U0001f642 pay ٤111 1111 1111 1111": ("card", "٤111 1111 1111 1111"),
    }
    for text, (kind, what) in cases.items():
        base, added = pii.spans_of(text)
        assert (kind, what) in [(pii.KINDS[k], text[s:e]) for s, k, e in added], text
        assert base == plain(text)


def test_prose_is_left_alone():
    for text in ("meet us at example.com", "look at the dot on it", "erin at ntreou. Thnd, dot", "un deux trois quatre cinq", "f(at) = x[dot]", "version 1.2.3 of 4.5.6", "the 55S5 B2B l0l", "fIve five fİve five İ"):
        assert pii.spans_of(text) == ([], []), text


def test_every_span_of_random_texts_is_detected_in_the_rewritten_text():
    rng = random.Random(9)
    parts = ["one ", "four ", "[at]", " at ", " dot ", "(dot)", "x", "com", "о", "​", "1", "l", " ", ".", "@", "+", "１", "plus ", "-", "½"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 40)))
        base, added = pii.spans_of(text)
        assert base == plain(text)
        new = pii.Rewritten(text)
        known = {(*new.span(s, e), kind) for s, kind, e in plain(new.text)}
        for s, kind, e in added:
            assert 0 <= s < e <= len(text) and (s, e, kind) in known


def test_query_rows_of_edge_cases(spark, make_docs, edge_rows):
    rows = [*edge_rows, (20, "x@y.zz 1.2.3.4; 4111 1111 1111 1111 +1 (017) 555-7713"), (21, "9" * 200_000), (22, "a.b-" * 50_000 + "@x.y")]
    out = {(r["doc_id"]): r for r in pii.scan(make_docs(rows)).collect()}
    assert pii.scan(make_docs(rows)).count() == len(rows)
    for doc_id, text in rows:
        base, r = plain(text) if doc_id not in (21, 22) else None, out[doc_id]
        if base is not None:
            assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(1 for x in base if x[1] == k) for k in range(4)]
            assert r["base_sha256"] == hashlib.sha256(pii.written(base).encode()).hexdigest()
    assert out[20]["spans"] == "email:0:6,ip:7:14,card:16:35,phone:36:53"
    assert out[22]["n_email"] == 1 and out[21]["n_card"] == 0
    assert pii.scan(make_docs([])).count() == 0


def test_masked_keeps_columns_and_nulls(make_docs):
    docs = make_docs([(1, None), (2, "to x@y.zz or john [at] example [dot] com."), (3, "")])
    out = pii.masked(docs)
    assert out.schema == docs.schema
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: None, 2: "to <email> or <email>.", 3: ""}
