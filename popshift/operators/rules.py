"""Candidate segments as rules: predicates, their columns, their WHERE text, their labels."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from popshift.functions.buckets import quantiles

MISSING = "__MISSING__"


def format_number(value: float) -> str:
    """For display only: two decimals at most, thousands commas."""
    if not math.isfinite(value):
        return str(value)
    r = round(float(value), 2)
    return f"{int(r):,}" if r == int(r) else f"{r:,.2f}".rstrip("0").rstrip(".")


@dataclass(frozen=True)
class Predicate:
    """kind: N [lower, upper), B (lower, upper], C equals, X differs, I in values, M missing. Categories compare as text."""

    feature: str
    kind: str
    lower: float = -math.inf
    upper: float = math.inf
    values: tuple[str, ...] = ()

    def column(self) -> Column:
        c = F.col(self.feature)
        if self.kind == "M":
            return c.isNull()
        if self.kind in "NB":
            out = c.isNotNull()
            if self.lower > -math.inf:
                out &= (c >= self.lower) if self.kind == "N" else (c > self.lower)
            if self.upper < math.inf:
                out &= (c < self.upper) if self.kind == "N" else (c <= self.upper)
            return out
        text = c.cast("string")
        if self.kind == "C":
            return F.coalesce(text == self.values[0], F.lit(False))
        if self.kind == "X":
            return ~text.eqNullSafe(self.values[0])
        return F.coalesce(text, F.lit(MISSING)).isin(list(self.values))

    def where(self, exact: bool = False) -> str:
        """Executable SQL text of the same condition; exact: names quoted and bounds typed, as expressions need it."""
        f, quote = f"`{self.feature.replace('`', '``')}`" if exact else self.feature, lambda v: "'" + (v.replace("\\", "\\\\").replace("'", "\\'") if exact else v.replace("'", "''")) + "'"
        if self.kind == "M":
            return f"{f} IS NULL"
        if self.kind in "NB":
            lo, hi = (">=", "<") if self.kind == "N" else (">", "<=")
            number = lambda x: repr(float(x)) + "D" if exact else repr(x)
            parts = [f"{f} IS NOT NULL"]
            if self.lower > -math.inf:
                parts.append(f"{f} {lo} {number(self.lower)}")
            if self.upper < math.inf:
                parts.append(f"{f} {hi} {number(self.upper)}")
            return " AND ".join(parts)
        if self.kind == "C":
            return f"coalesce(CAST({f} AS STRING) = {quote(self.values[0])}, false)"
        if self.kind == "X":
            return f"NOT (CAST({f} AS STRING) <=> {quote(self.values[0])})"
        return f"coalesce(CAST({f} AS STRING), '{MISSING}') IN ({', '.join(map(quote, self.values))})"

    def label(self) -> str:
        f = self.feature
        if self.kind == "M":
            return f"{f} is Missing"
        if self.kind == "C":
            return f"{f} = {self.values[0]}"
        if self.kind == "X":
            return f"{f} != {self.values[0]}"
        if self.kind == "I":
            return f"{f} IN ({', '.join(self.values)})"
        lo, hi = (format_number(self.lower), format_number(self.upper)) if self.kind == "N" else (f"{round(self.lower, 3)}", f"{round(self.upper, 3)}")
        below, above = ("<", ">=") if self.kind == "N" else ("<=", ">")
        if self.lower == -math.inf:
            return f"{f} {below} {hi}"
        if self.upper == math.inf:
            return f"{f} {above} {lo}"
        return f"{lo} <= {f} < {hi}" if self.kind == "N" else f"{lo} < {f} <= {hi}"


@dataclass(frozen=True)
class Rule:
    """A conjunction. cand_id is its place in the order of evaluation, which breaks ties."""

    technique: str
    cand_id: int
    parts: tuple[Predicate, ...]
    text: str | None = None

    def column(self) -> Column:
        return reduce(lambda a, b: a & b, [p.column() for p in self.parts], F.lit(True))

    def where(self, exact: bool = False) -> str:
        return " AND ".join(f"({p.where(exact)})" for p in self.parts) or "true"

    def label(self) -> str:
        return self.text or " AND ".join(p.label() for p in self.parts) or "All Customers (Root)"


def rule_table(spark, rules: list[Rule]) -> DataFrame:
    """One row per predicate: the rules that everything computes from, and each rule's WHERE text."""
    rows = [(r.technique, r.cand_id, p.feature, p.kind, p.lower, p.upper, p.kind == "N", p.kind == "B", ", ".join(p.values) or None, r.where()) for r in rules for p in r.parts]
    return spark.createDataFrame(rows, "technique string, cand_id int, feature string, ptype string, lower double, upper double, lower_closed boolean, upper_closed boolean, value string, where_text string")


def atomic_predicates(dev: DataFrame, numeric: list[str], categorical: list[str], bins: int = 4, max_levels: int = 20) -> dict[str, list[Predicate]]:
    """Quantile intervals of numeric features, and a predicate for each level of features with 2 to max_levels levels.

    Two aggregates over the data; only edges and at most max_levels + 1 levels a feature come to the driver.
    """
    points = [i / bins for i in range(bins + 1)]
    aggs = [quantiles(F.col(c).cast("double"), points).alias(f"q_{c}") for c in numeric]
    row = dev.agg(*aggs).first() if aggs else None
    out: dict[str, list[Predicate]] = {}
    for c in numeric:
        edges = sorted(set(row[f"q_{c}"] or []))
        if len(edges) >= 2:
            edges = [-math.inf, *edges[1:-1], math.inf]
            out[c] = [Predicate(c, "N", a, b) for a, b in zip(edges, edges[1:], strict=False)]
    if categorical:
        levels = dev.select(*[F.col(c).cast("string").alias(c) for c in categorical]).unpivot([], categorical, "name", "v").where("v is not null").distinct()
        some = levels.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n").between(2, max_levels)).select("name")
        found: dict[str, list[str]] = {}
        for r in levels.join(some, "name", "left_semi").collect():
            found.setdefault(r["name"], []).append(r["v"])
        out |= {c: [Predicate(c, "C", values=(v,)) for v in sorted(found[c])] for c in categorical if c in found}
    return out


def atomic_rules(predicates: dict[str, list[Predicate]], technique: str = "atomic") -> list[Rule]:
    return [Rule(technique, i, (p,)) for i, p in enumerate(p for ps in predicates.values() for p in ps)]


#: Candidates whose conditions go into one projection; more are split, to keep generated methods small.
BATCH = 150


def hits_of(conditions: list[tuple[int, str]]) -> Column:
    """Array of the numbers whose condition holds, as one expression text: hundreds of conditions are quickly sent."""
    return F.array_compact(F.expr("array(" + ", ".join(f"CASE WHEN {text} THEN {k} END" for k, text in conditions) + ")")) if conditions else F.array().cast("array<int>")


def hits(rules: list[Rule]) -> Column:
    return hits_of([(r.cand_id, r.where(exact=True)) for r in rules])


def members(df: DataFrame, rules: list[Rule], columns: list[str]) -> DataFrame:
    """A row for each row and rule that it fits: cand_id and the columns. One scan for each BATCH of rules."""
    out = None
    for i in range(0, len(rules), BATCH):
        part = df.select(*columns, F.explode(hits(rules[i : i + BATCH])).alias("cand_id"))
        out = part if out is None else out.unionByName(part)
    return out


def with_hits(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """df with hits: the cand_ids of the rules that a row fits, BATCH of them in a projection."""
    parts = []
    for i in range(0, len(rules), BATCH):
        df = df.withColumn(f"_hits{i}", hits(rules[i : i + BATCH]))
        parts.append(f"_hits{i}")
    return df.withColumn("hits", F.concat(*parts) if parts else F.array().cast("array<int>")).drop(*parts)


def overlaps(mon: DataFrame, rules: list[Rule]) -> DataFrame:
    """(a, b, n) for a <= b: rows that fit both rules. The pairs are made within a row, so nothing is joined."""
    rows = mon.select(hits(rules).alias("h")).where("size(h) > 0").groupBy("h").agg(F.count("*").alias("n"))
    pairs = rows.select("h", "n", F.explode("h").alias("a")).select("a", "n", F.explode(F.filter("h", lambda x: x >= F.col("a"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


#: Rules whose overlaps are counted in one scan.
TOGETHER = 64


def shared_rows(mon: DataFrame, rules: list[Rule]) -> dict[tuple[int, int], int]:
    """Rows that two of the rules share, by their places a <= b. A task multiplies its rows' memberships; what it sends is a
    number for each pair, whatever its rows."""
    import numpy as np
    import pyarrow as pa

    def count(batches):
        total = np.zeros((len(rules), len(rules)))
        for batch in batches:
            fits = np.stack([x.to_numpy(zero_copy_only=False) for x in batch.columns]).astype(np.float32)
            for at in range(0, fits.shape[1], 1 << 20):  # whole numbers of single precision are exact below 2^24
                part = fits[:, at : at + (1 << 20)]
                total += part @ part.T
        a, b = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(total[a, b].astype(np.int64))], names=["a", "b", "n"])

    fits = [F.expr(f"coalesce({r.where(exact=True)}, false)").alias(f"r{k}") for k, r in enumerate(rules)]
    found = mon.select(*fits).mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return {(r["a"], r["b"]): r["n"] for r in found.collect()}


def deduplicated(mon: DataFrame, rules: list[Rule], pool_size: int = 30, jaccard: float = 0.70, containment: float = 0.90) -> list[Rule]:
    """Rules in the given order without those that nearly repeat an earlier kept one; overlaps are counted on mon, of TOGETHER
    rules and those kept so far at a time, until the pool is full."""
    kept: list[Rule] = []
    for at in range(0, len(rules), TOGETHER):
        some = [*kept, *rules[at : at + TOGETHER]]
        n = shared_rows(mon, some)
        size = lambda k: n.get((k, k), 0)
        places = list(range(len(kept)))
        for j in range(len(kept), len(some)):
            for i in places:
                both = n.get((i, j), 0)
                union = size(i) + size(j) - both
                if union and (both / union >= jaccard or (size(j) and both / size(j) >= containment) or (size(i) and both / size(i) >= containment)):
                    break
            else:
                kept.append(some[j])
                places.append(j)
                if len(kept) == pool_size:
                    return kept
    return kept
