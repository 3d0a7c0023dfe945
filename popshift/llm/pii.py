"""Personal data by offset-preserving deobfuscation.

Four detectors (email, ip, card, phone) run over the text as it is; these are the base spans. Then transducers rewrite the
text: look-alike characters become the ASCII they imitate, at and dot disguises become `@` and `.`, spelled digits become
digits. Each transducer keeps what it replaced, so a span of the rewritten text leads back through all of them to the source
characters. The same detectors run over the rewritten text, and what they find where something was rewritten is added, unless
a base span of its kind covers it. Base spans stay as they are.

Detectors take a match and go on behind it, whether or not the match holds (no retries). All of them, and all transducers, are
linear in the text, so very long texts are whole.

Defined results: a null or empty text has no spans; repeated rows, ties and rows without a doc_id get one row each, judged by
their text; an empty table gives an empty table; only doc_id and text are read, so other columns can't clash. Spans of equal
start are ordered by kind, then end.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from popshift.llm.common import column, read, small_batches

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  #: (start, number of the kind, end)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Whole runs of digits and single dots: the matches in one are its parts by four from the left.
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGITS = {ord(c): None for c in " ().+-"}


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each match holds one @, so the @ are visited in turn: the characters before it back to the last match, then the domain."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            last = domain.end()
            yield start, last
        at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".") if m.end() - m.start() >= 7 else ()
        at = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (part.lstrip("0") for part in four)):
                yield at, end
            at = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """All matches that hold, by start, then kind."""
    found = [(s, 0, e) for s, e in emails(text)]
    found += [(s, 1, e) for s, e in addresses(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].translate(_NO_DIGITS)) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(m[0].translate(_NO_DIGITS)) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


# Letters of other scripts that look like an ASCII character, each beside what it imitates.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    # Greek
    "ο": "o", "α": "a", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # Latin
    "ı": "i", "ɡ": "g", "ɑ": "a", "ʟ": "L", "ᴏ": "o",
    # signs
    "。": ".", "·": ".", "․": ".", "‧": ".", "•": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "―": "-", "−": "-", "⁃": "-",
}
# Digits as words of English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
# Letters that stand for a digit inside a number.
DIGIT_LETTERS = {"O": "0", "o": "0", "I": "1", "l": "1", "S": "5", "B": "8"}
# Top domains that end a spelled address; those that are words of prose (in, it, me, us) are left out.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz io dev app ai co uk de fr es eu ch pl ru jp cn br au ca nl se dk xyz online example test invalid".split())
DIGIT_WORDS |= {form: d for w, d in DIGIT_WORDS.items() for form in (w.title(), w.upper())}
#: Digit words that a chain of digits must hold, within so many words, before any of them is rewritten.
LEAST_WORDS, WITHIN = 4, 24

Edit = tuple[int, int, str]  #: (start, end, what stands there instead)


@lru_cache(maxsize=1 << 16)
def imitated(c: str) -> str | None:
    """The ASCII that a character imitates, the empty string for invisible ones, None if it is itself."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    kind = unicodedata.category(c)
    if kind == "Cf":
        return ""
    if kind == "Zs":
        return " "
    if kind == "Nd":
        return str(unicodedata.decimal(c))
    plain = unicodedata.normalize("NFKC", c)
    return plain if plain != c and plain.isascii() and plain.isprintable() else None


_ODD = re.compile("[^\x00-\x7f\xc0-\xff]")


def characters(text: str) -> list[Edit]:
    if text.isascii():
        return []
    return [(m.start(), m.end(), to) for m in _ODD.finditer(text) if (to := imitated(m[0])) is not None]


_DOT_NAMES = "dot|DOT|Dot|punkt|PUNKT|Punkt|punto|PUNTO|point|POINT"
_BOXED_AT = re.compile(r"(?<=[A-Za-z0-9]) {0,2}[\[({<] {0,2}(?:at|AT|At|@|arroba|ARROBA|ät|ÄT) {0,2}[\])}>] {0,2}(?=[A-Za-z0-9])")
_BOXED_DOT = re.compile(rf"(?<=[A-Za-z0-9]) {{0,2}}[\[({{<] {{0,2}}(?:{_DOT_NAMES}|\.) {{0,2}}[\])}}>] {{0,2}}(?=[A-Za-z0-9])")
_BARE_AT = re.compile(r"(?: (?:at|AT|At|arroba|ARROBA) |_(?:at|AT)_|-(?:at|AT)-| ?@ ?)(?=[A-Za-z0-9])")
_BARE_DOT = re.compile(rf" (?:{_DOT_NAMES}) |_(?:dot|DOT)_|-(?:dot|DOT)-| \. |\.")
_DOT_BEFORE = re.compile(rf"(?: (?:{_DOT_NAMES}) |_(?:dot|DOT)_|-(?:dot|DOT)-)$")
_LABEL = re.compile(r"[A-Za-z0-9]+(?:-(?!dot-|DOT-)[A-Za-z0-9]+)*")
_BETWEEN_DIGITS = re.compile(rf"[0-9] (?:{_DOT_NAMES}|\.) (?=[0-9])")


def boxes(text: str) -> list[Edit]:
    """`[at]`, `(dot)` and the like, between letters or digits."""
    if not any(c in text for c in "[({<"):
        return []
    return sorted([(m.start(), m.end(), "@") for m in _BOXED_AT.finditer(text)] + [(m.start(), m.end(), ".") for m in _BOXED_DOT.finditer(text)])


def bare_addresses(text: str) -> list[Edit]:
    """`name at host dot com`: an at and a domain with a spelled or spaced dot; with plain dots only behind an `@`, or where the
    name has a digit or sign in it, as `meet at example.com` is prose. The last label is a top domain, behind an `@` any letters."""
    edits: list[Edit] = []
    floor = 0
    for at in _BARE_AT.finditer(text):
        if at.start() <= floor or not (text[at.start() - 1].isascii() and text[at.start() - 1].isalnum()):
            continue
        labels, dots, end = [], [], at.end()
        while label := _LABEL.match(text, end):
            labels.append(label[0])
            dot = _BARE_DOT.match(text, label.end())
            if not dot:
                break
            dots.append((dot.start(), dot.end(), "."))
            end = dot.end()
        sure = "@" in at[0]
        while labels and not (labels[-1].lower() in TOP_DOMAINS or sure and len(labels[-1]) >= 2 and labels[-1].isalpha()):
            labels.pop()
        dots = dots[: len(labels) - 1] if labels else []
        if not dots:
            continue
        start, inner = at.start(), []
        while True:
            while start > floor and text[start - 1] in _LOCAL:
                start -= 1
            before = _DOT_BEFORE.search(text, max(floor, start - 8), start)
            if not before or before.start() == floor or text[before.start() - 1] not in _LOCAL:
                break
            inner.append((before.start(), before.end(), "."))
            start = before.start()
        spelled = any(text[s:e] != "." for s, e, _ in dots)
        name = text[start : at.start()]
        if spelled or sure or inner or any(c.isdigit() or c in "._%+" for c in name):
            edits += [*reversed(inner), (at.start(), at.end(), "@"), *dots]
            floor = dots[-1][1]
    taken = [(s, e) for s, e, _ in edits]
    for m in _BETWEEN_DIGITS.finditer(text):
        s, e = m.start() + 1, m.end()
        k = bisect_right(taken, (s, len(text)))
        if not (k and taken[k - 1][1] > s) and not (k < len(taken) and taken[k][0] < e):
            edits.append((s, e, "."))
    return sorted(edits)


_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_ITEM = rf"(?:{_WORD}|[0-9]+)(?![^\W_])"
_SEP = rf" (?:{_DOT_NAMES}) | ?\. ?|,? |-"
_PLUS = "(?:plus|Plus|PLUS|más|mas) "
_CHAIN = re.compile(rf"(?<![^\W_])(?:{_PLUS}|\+ ?)?(?:{_ITEM})(?:(?:{_SEP})(?:{_ITEM}))+")
_PIECE = re.compile(rf"(?P<plus>{_PLUS}|\+ )|(?P<word>{_WORD})(?![^\W_])|(?P<digits>[0-9]+)|(?P<dot> (?:{_DOT_NAMES}) | ?\. ?)|(?P<sep>,? |-|\+)")
_MIXED = re.compile(r"(?<![A-Za-z0-9])[OoIlSB]?[0-9][0-9OoIlSB]*(?![A-Za-z0-9])")


def _dense(spelled: Iterable[bool]) -> bool:
    """Whether LEAST_WORDS of the words are spelled digits somewhere within WITHIN words."""
    at = [k for k, is_digit in enumerate(spelled) if is_digit]
    return any(b - a < WITHIN for a, b in zip(at, at[LEAST_WORDS - 1 :], strict=False))


def spelled_digits(text: str) -> list[Edit]:
    """Chains of spelled and plain digits, LEAST_WORDS spelled ones within WITHIN. What parts two spelled digits goes."""
    edits: list[Edit] = []
    if not _dense(map(DIGIT_WORDS.__contains__, text.replace("-", " ").replace(",", " ").replace(".", " ").split())):
        return edits
    for chain in _CHAIN.finditer(text):
        pieces = list(_PIECE.finditer(text, chain.start(), chain.end()))
        words = [p.lastgroup == "word" for p in pieces]
        if not _dense(w for p, w in zip(pieces, words, strict=True) if p.lastgroup != "sep"):
            continue
        for k, p in enumerate(pieces):
            if p.lastgroup == "plus":
                edits.append((p.start(), p.end(), "+"))
            elif p.lastgroup == "word":
                edits.append((p.start(), p.end(), DIGIT_WORDS[p[0]]))
            elif p.lastgroup == "dot":
                edits.append((p.start(), p.end(), "."))
            elif p.lastgroup == "sep" and p[0] != "+" and 0 < k < len(pieces) - 1 and words[k - 1] and words[k + 1]:
                edits.append((p.start(), p.end(), ""))
            elif p.lastgroup == "sep" and p[0] == ", ":
                edits.append((p.start(), p.end(), " "))
    return edits


def mixed_digits(text: str) -> list[Edit]:
    """Letters that stand for digits, in tokens of which half or more are digits."""
    edits: list[Edit] = []
    for m in _MIXED.finditer(text):
        letters = [k for k, c in enumerate(m[0], m.start()) if not c.isdigit()]
        if letters and 2 * len(letters) <= len(m[0]):
            edits += [(k, k + 1, DIGIT_LETTERS[text[k]]) for k in letters]
    return edits


TRANSDUCERS = (characters, boxes, bare_addresses, spelled_digits, mixed_digits)


class Rewritten:
    """A text after the transducers, with the way back from its offsets to those of the source."""

    def __init__(self, text: str):
        self.source = self.text = text
        self.steps: list[tuple[list[Edit], list[int]]] = []
        for transducer in TRANSDUCERS:
            if edits := transducer(self.text):
                parts, starts, at, size = [], [], 0, 0
                for s, e, to in edits:
                    parts += [self.text[at:s], to]
                    size += s - at
                    starts.append(size)
                    size += len(to)
                    at = e
                self.text = "".join(parts) + self.text[at:]
                self.steps.append((edits, starts))

    def _back(self, at: int, last: bool) -> int:
        """Source offset of the character at `at`: its first one, or the last one that it stands for."""
        for edits, starts in reversed(self.steps):
            # of edits that start here, those that left nothing stand before this character
            k = bisect_right(starts, at) - 1
            if k < 0:
                continue
            s, e, to = edits[k]
            inside = at - starts[k]
            at = (e - 1 if last else s) if inside < len(to) else e + inside - len(to)
        return at

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self._back(start, False), self._back(end - 1, True) + 1


def spans_of(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans), each by start, kind and end; offsets are code points of the text, ends exclusive."""
    if not text:
        return [], []
    base = detect(text)
    new = Rewritten(text)
    if not new.steps:
        return base, []
    held: dict[int, tuple[list[int], list[int]]] = {}
    for s, kind, e in base:
        starts, ends = held.setdefault(kind, ([], []))
        starts.append(s), ends.append(e)
    added = set()
    for ns, kind, ne in detect(new.text):
        s, e = new.span(ns, ne)
        if text[s:e] == new.text[ns:ne]:
            continue
        starts, ends = held.get(kind, ([], []))
        k = bisect_right(starts, s) - 1
        if not (k >= 0 and ends[k] >= e):
            added.add((s, kind, e))
    return base, sorted(added)


def written(spans: list[Span]) -> str:
    return ",".join([f"{KINDS[kind]}:{s}:{e}" for s, kind, e in spans])


_SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the number of base spans of each kind, the digest of the base spans, all spans, and how many of
    them the transducers added."""
    small_batches(docs.sparkSession)
    df = docs.select("doc_id", F.col("text").alias("_t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans, more = [[] for _ in KINDS], [], [], []
            for text in column(batch, "_t"):
                base, added = spans_of(text.as_py())
                for kind, out in enumerate(counts):
                    out.append(sum(1 for x in base if x[1] == kind))
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(sorted(base + added)))
                more.append(len(added))
            arrays = [column(batch, "doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}")


def masked(docs: DataFrame) -> DataFrame:
    """docs, all columns as they are, with each span of the text replaced by its kind in angle brackets; overlapping spans
    are one, named by the first. Null texts stay null."""
    small_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for value in column(batch, "text"):
                text = value.as_py()
                base, added = spans_of(text)
                out, at = [], 0
                for s, kind, e in sorted(base + added):
                    if s >= at:
                        out += [text[at:s], f"<{KINDS[kind]}>"]
                    at = max(at, e)
                texts.append(text if not out else "".join(out) + text[at:])
            k = batch.schema.get_field_index("text")
            yield batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))

    return docs.mapInArrow(run, docs.schema)


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))
