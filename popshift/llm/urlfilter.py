"""URL filters: host and path rules first, then a Bloom filter cascade over all hosts of the corpus. DataFrame functions only.

A rule (verdict, host, path) fits its host and all subdomains if the URL's path starts with the rule's; the longest rule
wins. URLs that no rule fits are judged by their host's membership in a list. Level 0 of the cascade is a Bloom filter of
the listed keys, level 1 one of the keys outside the list that level 0 lets through, level 2 one of the listed keys
that level 1 lets through, and so on until none is left. As the levels are built from the complete key universe, walking
them gives exact membership, and a row needs no join: the bit arrays come in as scalar subqueries.

Defined results: a null URL, or one without "://", has empty host and path, fits no rule and is judged by the empty key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from popshift.llm.common import lower_ascii, new_path, read, staged

RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
BITS_PER_KEY, HASHES = 8, 4
#: About so many bits a filter has at most; keys of a longer list are dealt by hash to several cascades.
MAX_FILTER_BITS = 1 << 28


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; null if none."""
    rule = verdict = None
    for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    """HASHES bit positions by double hashing; each level hashes with a seed of its own."""
    a, b = (F.pmod(F.xxhash64(key, F.lit(2 * level + i)), F.lit(bits)) for i in (0, 1))
    return [F.pmod(a + F.lit(i) * b, F.lit(bits)) for i in range(HASHES)]


def _filter_words(keys: DataFrame, level: int, bits: int) -> DataFrame:
    """One row: the level's bits as an array of 64-bit words."""
    spark = keys.sparkSession
    set_bits = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits))).alias("bit"))
    words = set_bits.groupBy(F.floor(F.col("bit") / 64).cast("long").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))).alias("v"))
    dense = spark.range(bits // 64).withColumnRenamed("id", "w").join(words, "w", "left").select("w", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("words"))


def _let_through(words: Column, key: Column, level: int, bits: int) -> Column:
    set_ = [F.call_function("getbit", F.get(words, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1 for p in _positions(key, level, bits)]
    return reduce(lambda a, b: a & b, set_)


class Cascade:
    """Built from a table (key, listed) that holds each key of the universe once."""

    def __init__(self, universe: DataFrame):
        self.levels: list[tuple[DataFrame, int]] = []
        self.universe, rest = universe, universe
        n = rest.where("listed").count()
        while n:
            level, bits = len(self.levels), 64 * -(-n * BITS_PER_KEY // 64)
            side = F.col("listed") == F.lit(level % 2 == 0)
            words = staged(_filter_words(rest.where(side), level, bits), "cascade-level")
            self.levels.append((words, bits))
            # What goes on: this level's keys, and the other side's keys that it lets through, to be encoded next.
            rest = rest.where(side | _let_through(words.select("words").scalar(), F.col("key"), level, bits))
            rest = staged(rest, "cascade-rest")
            n = rest.where(~side).count()

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe."""
        verdict = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            words, bits = self.levels[level]
            verdict = F.when(~_let_through(words.select("words").scalar(), key, level, bits), F.lit(level % 2 == 1)).otherwise(verdict)
        return verdict


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict. Listed: the hosts of which a block rule hits some URL of the corpus."""
    spark = pages.sparkSession
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    urls = urls.withColumns({"rule": rule, "by_rule": verdict})
    hit = F.coalesce(F.max(F.col("by_rule") == "block"), F.lit(False))
    universe = staged(urls.groupBy(F.col("host").alias("key")).agg(hit.alias("listed")), "url-keys")
    parts = max(1, -(-universe.where("listed").count() * BITS_PER_KEY // MAX_FILTER_BITS))
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("key")), F.lit(parts))
    if parts > 1:  # rows lie by part, so that a part's tasks read its rows and carry its cascade only
        path = new_path(spark, "url-parts")
        urls.withColumn("part", F.pmod(F.xxhash64(F.lit("part"), F.col("host")), F.lit(parts))).write.partitionBy("part").parquet(path)
        rows = spark.read.schema(T.StructType([*urls.schema, T.StructField("part", T.LongType())])).parquet(path)
    out = []
    for k in range(parts):
        here, mine = (urls, universe) if parts == 1 else (rows.where(F.col("part") == k), universe.where(part == k))
        listed = Cascade(mine).contains(F.col("host"))
        out.append(here.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(listed, "block").otherwise("allow")).alias("verdict")))
    return reduce(DataFrame.unionByName, out)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))


def _sql_rules(then) -> str:
    return " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{then(w, h, p)}'" for w, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))


OP9_SQL = f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r AS (SELECT *, CASE {_sql_rules(lambda w, h, p: h + p)} END AS rule, CASE {_sql_rules(lambda w, h, p: w)} END AS by_rule FROM u)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN host IN (SELECT host FROM r WHERE by_rule = 'block') THEN 'block' ELSE 'allow' END) AS verdict FROM r
"""
