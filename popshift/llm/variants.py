"""Spelling variants by a relational trie frontier.

The words' prefixes form a trie. Its edge table is distributed and path-compressed: only nodes where words part, end or start
their search stay, and an edge carries the letters between two of them. States (word, position, node, edits) are joined with
the edges of their node, level by level, until all words are spelled; a state that has spelled its whole word with one edit
and stands on a word's end makes the two neighbours.

Three facts keep the frontier small. One edit lies in the word's second half, then the first half is a prefix of both words,
or in the first half, then the rest is a suffix of both: so a search starts at its word's half, in a trie of the words and in a
trie of the reversed words. And as being near is mutual, states replace or skip a letter of their word, but never insert one:
that pair is found from its longer word. After its edit a state follows one edge at most.

Nodes are 64-bit hashes of prefixes; a collision can only add states, and every pair is compared letter by letter in the end.

A node has at most as many edges as there are letters (90), so a join makes no more than that for a state; a node that many
words share is a skewed key of a join with few rows on the other side, which adaptive execution splits. No table is broadcast:
Spark takes a table's size for that of its files or of the rows before they are exploded, a small part of what the driver would
hold.

Defined results: null texts have no words; a document without a doc_id has its runs counted as they are; repeated documents
count each time; ties of the largest n go to the smallest word in code-point order; an empty table gives an empty table. Very
long texts are whole, and a very long word has only as many levels as nodes on its path. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from popshift.llm.common import column, discard, lower_ascii, read, small_batches, staged

LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Code points of a word at least, and its occurrences; a word's form occurs so many times as often.
LEAST_LENGTH, LEAST_COUNT, FACTOR = 6, 5, 5
#: A letter is lost where this divides the hash of document and run.
NOISE = 199


def word_counts(docs: DataFrame, noise: int | None = NOISE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z lower-cased. With noise, a run loses the letter h % length where noise
    divides h, the CRC-32 of `<doc_id>:<run>`."""
    runs = docs.select(F.col("doc_id").cast("string").alias("doc"), F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(f"([{LETTERS}]{{{least_length},}})"))).alias("run"))
    if noise:
        h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
        at = F.pmod(h, F.char_length("run")).cast("int")
        cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
        runs = runs.select(F.when(F.pmod(h, F.lit(noise)) == 0, cut).otherwise(F.col("run")).alias("run"))
    words = runs.groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n"))
    return words.where((F.col("n") >= least_count) & (F.char_length("word") >= least_length))


def _joined(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Joined by a shuffle on both sides, whatever Spark takes their sizes for."""
    return left.join(right.hint("merge"), on, how)


def _spell(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For both directions of each word, the nodes of its prefixes from the half where its search starts."""
    for batch in batches:
        out: dict[str, list] = {"word": [], "n": [], "spelled": [], "side": [], "start": [], "nodes": []}
        for word, n in zip(column(batch, "word").to_pylist(), column(batch, "n").to_pylist(), strict=True):
            half = len(word) // 2
            for side, spelled, start in ((0, word, half), (1, word[::-1], len(word) - half)):
                digest = xxhash.xxh64(spelled[:start].encode(), seed=side)
                nodes = [digest.intdigest()]
                for c in spelled[start:]:
                    digest.update(c.encode())
                    nodes.append(digest.intdigest())
                for name, value in zip(out, (word, n, spelled, side, start, np.array(nodes, np.uint64).view(np.int64)), strict=True):
                    out[name].append(value)
        kinds = {"n": pa.int64(), "side": pa.int32(), "start": pa.int32(), "nodes": pa.list_(pa.int64())}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()})


def _explicit(paths: DataFrame) -> DataFrame:
    """Per word and direction its explicit nodes, in order: (word, n, spelled, side, at array<struct<pos, node>>)."""
    steps = paths.select("word", "n", "spelled", "side", "start", F.posexplode("nodes").alias("k", "node"))
    steps = steps.select("word", "n", "spelled", "side", "node", (F.col("start") + F.col("k")).alias("pos"), (F.col("k") == 0).alias("first"))
    next_letter = F.substring("spelled", F.col("pos") + 1, F.lit(1))  # empty at the word's end
    kept = steps.groupBy("node").agg(F.min(next_letter).alias("a"), F.max(next_letter).alias("b"), F.max("first").alias("first"))
    kept = kept.where(F.col("first") | (F.col("a") != F.col("b")) | (F.col("a") == "")).select("node")
    found = _joined(steps, kept, "node").groupBy("word", "n", "spelled", "side").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("at"))
    return found


def _edges(explicit: DataFrame) -> DataFrame:
    """(node, label, child), each once."""
    pairs = explicit.select("spelled", F.explode(F.arrays_zip(F.slice("at", F.lit(1), F.size("at") - 1).alias("a"), F.slice("at", F.lit(2), F.size("at") - 1).alias("b"))).alias("e"))
    label = F.substring("spelled", F.col("e.a.pos") + 1, F.col("e.b.pos") - F.col("e.a.pos"))
    return pairs.select(F.col("e.a.node").alias("node"), label.alias("label"), F.col("e.b.node").alias("child")).distinct()


def _level(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """The states one edge on. A state without an edit spells the label, replaces one of its letters, or skips a letter of its
    word on the way; a state with one spells it."""
    f, e = frontier.alias("f"), edges.alias("e")
    size = F.char_length("label")
    here, more = F.substring("spelled", F.col("pos") + 1, size), F.substring("spelled", F.col("pos") + 1, size + 1)
    same = here == F.col("label")
    replaced = (F.col("edits") == 0) & (F.char_length(here) == size) & (F.levenshtein(here, F.col("label"), 1) == 1)
    skipped = (F.col("edits") == 0) & (F.char_length(more) == size + 1) & (F.levenshtein(more, F.col("label"), 1) == 1)
    joined = _joined(f, e, (F.col("f.node") == F.col("e.node")) & (same | replaced | skipped))
    on = lambda step, edits: F.struct(step.cast("int").alias("pos"), edits.cast("int").alias("edits"))
    moves = F.array_compact(F.array(F.when(same, on(F.col("pos") + size, F.col("edits"))), F.when(replaced, on(F.col("pos") + size, F.lit(1))), F.when(skipped, on(F.col("pos") + size + 1, F.lit(1)))))
    moved = joined.select("word", "n", "spelled", F.col("child").alias("node"), F.explode(moves).alias("m"))
    return moved.select("word", "n", "spelled", "node", "m.pos", "m.edits")


def _near(words: DataFrame, levels: int, explicit: DataFrame, tag: str) -> tuple[DataFrame, list[DataFrame]]:
    """(word, n, near, near_n) as found from one of the two words, and the staged tables that it reads."""
    edges = staged(_edges(explicit), f"{tag}-edges")
    frontier = explicit.select("word", "n", "spelled", F.col("at")[0]["node"].alias("node"), F.col("at")[0]["pos"].alias("pos"), F.lit(0).alias("edits"))
    kept, ends = [edges], []
    end = F.char_length("spelled")
    for k in range(levels + 1):
        # The last letter is skipped on the spot; states without an edit have nowhere to go from the end.
        last = frontier.where((F.col("edits") == 0) & (F.col("pos") == end - 1)).select("word", "n", "node")
        ends += [frontier.where((F.col("edits") == 1) & (F.col("pos") == end)).select("word", "n", "node"), last]
        if k < levels:
            frontier = staged(_level(frontier.where(F.col("pos") < end), edges), f"{tag}-{k}")
            kept.append(frontier)
    spelled = explicit.select(F.col("at")[F.size("at") - 1]["node"].alias("node"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = ends[0]
    for more in ends[1:]:
        met = met.unionByName(more)
    pairs = _joined(met, spelled, "node").where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
    return pairs.select("word", "n", "near", "near_n"), kept


def near_words(words: DataFrame, tag: str = "variants") -> DataFrame:
    """(word, near, near_n): all pairs of words that differ by exactly one inserted, deleted or replaced code point, both ways
    round and once. words: (word, n), each word once, of two code points or more."""
    small_batches(words.sparkSession)
    paths = words.select("word", "n").mapInArrow(_spell, "word string, n long, spelled string, side int, start int, nodes array<long>")
    explicit = staged(_explicit(paths), f"{tag}-nodes")
    levels = explicit.agg(F.max(F.size("at"))).first()[0]
    if levels is None:
        discard(explicit)
        return words.select("word", F.col("word").alias("near"), F.col("n").alias("near_n")).limit(0)
    found, kept = _near(words, levels - 1, explicit, tag)
    both = found.select("word", "near", "near_n").unionByName(found.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    out = staged(both.distinct(), f"{tag}-pairs")
    for table in [explicit, *kept]:
        discard(table)
    return out


def group_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """words (word, n) with n_near, form, form_n and root.

    A form occurs `factor` times as often as its word at least, so a chain of forms has log n steps; roots are found by
    doubling: what a word points to is replaced by what that points to.
    """
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("b"))
    table = _joined(words.select("word", "n"), best, "word", "left")
    has = -F.col("b.m") >= factor * F.col("n")
    table = staged(table.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("b.near")).alias("form"), F.when(has, -F.col("b.m")).alias("form_n")), "variants-forms")
    discard(near)
    most = table.agg(F.max("n")).first()[0] or 0
    links, steps = table.where("form is not null").select("word", F.col("form").alias("to")), 1
    while factor**steps <= most:  # no chain of forms is longer
        on = links.select(F.col("word").alias("to"), F.col("to").alias("further"))
        links, steps = staged(_joined(links, on, "to", "left").select("word", F.coalesce("further", "to").alias("to")), "variants-roots"), 2 * steps
    return _joined(table, links, "word", "left").select("word", F.coalesce("to", "word").alias("root"), "n", "n_near", "form", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = staged(word_counts(read(spark, sf_dir, "documents")), "variants-words")
    return group_variants(words)


# CRC-32 bit by bit: DuckDB has no function for it.
_BITS = "flatten(list_transform(range(octet_length(encode(k))), lambda i: list_transform(range(8), lambda j: (CAST('0x' || hex(encode(k))[2 * i + 1:2 * i + 2] AS BIGINT) >> j) & 1)))"
OP11_SQL = rf"""
WITH RECURSIVE runs AS (SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
keyed AS (SELECT run, c, CAST(doc_id AS VARCHAR) || ':' || run AS k FROM runs),
hashed AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, {_BITS}), lambda a, b: xor(a >> 1, CASE WHEN (xor(a, b) & 1) = 1 THEN 3988292384 ELSE 0 END)), 4294967295) AS h FROM keyed),
words AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
cuts AS MATERIALIZED (SELECT word, n, i, word[1:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b USING (i, rest) WHERE a.word <> b.word
    UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.rest
    UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.rest),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS r, count(*) OVER (PARTITION BY word) AS n_near FROM near),
forms AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
    FROM words LEFT JOIN (SELECT * FROM ranked WHERE r = 1) USING (word)),
walk AS (SELECT word, word AS reached, form AS further FROM forms UNION ALL SELECT walk.word, walk.further, forms.form FROM walk JOIN forms ON forms.word = walk.further)
SELECT word, reached AS root, n, n_near, form, form_n FROM walk JOIN forms USING (word) WHERE further IS NULL
"""
