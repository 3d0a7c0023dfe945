"""All measures of candidate segments, for many candidates in one go.

Rows are exploded to the candidates that they fit. One aggregate by (candidate, score) gives counts, rates, exposure,
discrimination and the score shift; a second one by (candidate, feature, value) gives feature and attribution drift.
Windows run over these histograms, never over rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from popshift.functions.buckets import EPS, interior, psi_floored, psi_term, right_closed
from popshift.functions.special import ks_survival, normal_two_sided
from popshift.operators import ranks
from popshift.operators.rules import Rule, members, with_hits
from popshift.sources.staging import staged


@dataclass(frozen=True)
class Roles:
    target: str = "y"
    score: str = "s"
    weight: str | None = "w"
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    shap: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return ["side", self.target, self.score, *([self.weight] if self.weight else []), *self.numeric, *self.categorical, *self.shap]


@dataclass(frozen=True)
class Gates:
    min_abs: int
    min_support: float
    max_pct: float = 0.35
    min_events: int = 30


@dataclass(frozen=True)
class Totals:
    n0: int
    n1: int
    w0: float
    w1: float
    rate0: float

    @classmethod
    def of(cls, df: DataFrame, roles: Roles) -> Totals:
        w = F.col(roles.weight) if roles.weight else F.lit(0.0)
        on = lambda s, c: F.when(F.col("side") == s, c)
        r = df.agg(F.count(on(0, F.lit(1))), F.count(on(1, F.lit(1))), F.coalesce(F.sum(on(0, w)), F.lit(0.0)), F.coalesce(F.sum(on(1, w)), F.lit(0.0)), F.coalesce(F.avg(on(0, F.col(roles.target))), F.lit(0.0))).first()
        return cls(*r)

    def gates(self, min_events: int = 30, min_abs: int | None = None, min_support: float | None = None, max_pct: float = 0.35) -> Gates:
        """Floors from the event rate where they aren't given."""
        floor = min_abs if min_abs is not None else max(50, math.ceil(min_events / max(self.rate0, 1e-4)))
        support = min_support if min_support is not None else min(0.30, max(0.02, floor / max(1, min(self.n0, self.n1))))
        return Gates(floor, support, max_pct, min_events)


def gated(n0: int, x0: int, n1: int, x1: int, totals: Totals, gates: Gates) -> bool:
    """Whether counts of rows and events on both sides pass the support and event gates."""
    shares = (n0 / max(1, totals.n0), n1 / max(1, totals.n1))
    return min(n0, n1) >= gates.min_abs and min(shares) >= gates.min_support and max(shares) <= gates.max_pct and min(x0 or 0, x1 or 0) >= gates.min_events


def gate_counts(df: DataFrame, rules: list[Rule], roles: Roles, totals: Totals, gates: Gates) -> list[int]:
    """cand_ids that pass the gates: rows are dealt to the candidates that they fit and counted, one scan for all."""
    on = lambda s, v: F.sum(F.when(F.col("side") == s, v).otherwise(0)).cast("long")
    m = members(df, rules, ["side", roles.target])
    sums = [on(s, v).alias(f"{k}{s}") for s in (0, 1) for k, v in (("n", F.lit(1)), ("x", F.col(roles.target)))]
    found = {r["cand_id"]: r for r in m.groupBy("cand_id").agg(*sums).collect()}
    return [r.cand_id for r in rules if (q := found.get(r.cand_id)) and gated(q["n0"], q["x0"], q["n1"], q["x1"], totals, gates)]


def passes(metrics: DataFrame, gates: Gates) -> DataFrame:
    """The same gates over evaluated rows."""
    return metrics.where((F.least("n_dev", "n_mon") >= gates.min_abs) & (F.least("pct_dev", "pct_mon") >= gates.min_support) & (F.greatest("pct_dev", "pct_mon") <= gates.max_pct) & (F.least("x_dev", "x_mon") >= gates.min_events))


def score_histogram(m: DataFrame, roles: Roles, key: str = "cand_id") -> DataFrame:
    """Per candidate and score: bad and good rows and exposure on each side."""
    y, w = F.col(roles.target), F.col(roles.weight) if roles.weight else F.lit(0.0)
    on = lambda s, c: F.sum(F.when(F.col("side") == s, c).otherwise(F.lit(0)))
    return m.groupBy(key, F.col(roles.score).alias("s")).agg(on(0, y).alias("b0"), on(0, 1 - y).alias("g0"), on(1, y).alias("b1"), on(1, 1 - y).alias("g1"), on(0, w).alias("w0"), on(1, w).alias("w1"))


#: Cells of a unit of score.
CELLS = 1024


def performance(hist: DataFrame, key: str = "cand_id") -> DataFrame:
    """Counts, AUC (ties count half), KS at the ends of tie blocks, and the two-sample distance of the scores."""
    # Cumulated in two steps, so no task holds all scores of a candidate: within cells of the score's range, and over cells.
    names = ("b0", "g0", "b1", "g1")
    h = hist.withColumn("cell", F.floor(F.col("s") * CELLS))
    cells = h.groupBy(key, "cell").agg(*[F.sum(x).alias(f"p{x}") for x in names])
    over, below = Window.partitionBy(key), Window.partitionBy(key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(key, "cell", *[F.coalesce(F.sum(f"p{x}").over(below), F.lit(0)).alias(f"p{x}") for x in names], *[F.sum(f"p{x}").over(over).alias(f"t{x}") for x in names])
    up = Window.partitionBy(key, "cell").orderBy("s")
    h = h.join(cells, [key, "cell"]).withColumns({f"c{x}": F.col(f"p{x}") + F.sum(x).over(up) for x in names})
    gap = lambda i: F.max(F.abs(F.col(f"cb{i}") / F.col(f"tb{i}") - F.col(f"cg{i}") / F.col(f"tg{i}")))
    auc = lambda i: F.sum(F.col(f"b{i}") * (F.col(f"cg{i}") - F.col(f"g{i}") / 2)) / (F.max(f"tb{i}") * F.max(f"tg{i}"))
    # A ratio with an empty class is null, not an error.
    h = h.withColumns({f"t{c}": F.when(F.col(f"t{c}") > 0, F.col(f"t{c}")) for c in ("b0", "g0", "b1", "g1")})
    zero = lambda c: F.coalesce(F.max(c), F.lit(0))
    n = lambda i: (zero(f"tb{i}") + zero(f"tg{i}")).cast("long")
    shift = F.max(F.abs((F.col("cb0") + F.col("cg0")) / (F.coalesce("tb0", F.lit(0)) + F.coalesce("tg0", F.lit(0))) - (F.col("cb1") + F.col("cg1")) / (F.coalesce("tb1", F.lit(0)) + F.coalesce("tg1", F.lit(0)))))
    present = (F.coalesce("tb0", F.lit(0)) + F.coalesce("tg0", F.lit(0)) > 0) & (F.coalesce("tb1", F.lit(0)) + F.coalesce("tg1", F.lit(0)) > 0)
    return (
        h.where(present)
        .groupBy(key)
        .agg(
            n(0).alias("n_dev"), n(1).alias("n_mon"), zero("tb0").cast("long").alias("x_dev"), zero("tb1").cast("long").alias("x_mon"),
            F.sum("w0").alias("weight_dev"), F.sum("w1").alias("weight_mon"), F.sum(F.col("s") * (F.col("b0") + F.col("g0"))).alias("s_dev"), F.sum(F.col("s") * (F.col("b1") + F.col("g1"))).alias("s_mon"),
            auc(0).alias("auc_dev"), auc(1).alias("auc_mon"), gap(0).alias("ks_dev"), gap(1).alias("ks_mon"), shift.alias("ks_shift"),
        )
    )


def value_counts(m: DataFrame, roles: Roles, key: str = "cand_id") -> DataFrame:
    """(candidate, kind, name, v, t, n0, n1) of features and attributions: N numeric, T text, A attribution."""
    on = lambda s: F.count_if(F.col("side") == s)
    parts = []
    numbers = [*roles.numeric, *roles.shap]
    if numbers:
        long = m.select(key, "side", *[F.col(c).cast("double").alias(c) for c in numbers]).unpivot([key, "side"], numbers, "name", "v").where("v is not null")
        kind = F.when(F.col("name").isin(list(roles.shap)), "A").otherwise("N") if roles.shap else F.lit("N")
        parts.append(long.groupBy(key, "name", "v").agg(on(0).alias("n0"), on(1).alias("n1")).withColumns({"kind": kind, "t": F.lit(None).cast("string")}))
    if roles.categorical:
        names = list(roles.categorical)
        long = m.select(key, "side", *[F.col(c).cast("string").alias(c) for c in names]).unpivot([key, "side"], names, "name", "t").where("t is not null")
        parts.append(long.groupBy(key, "name", "t").agg(on(0).alias("n0"), on(1).alias("n1")).withColumns({"kind": F.lit("T"), "v": F.lit(None).cast("double")}))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_drift(counts: DataFrame, key: str = "cand_id", max_levels: int = 20) -> DataFrame:
    """(candidate, kind, name, psi, delta): deciles of both sides together for numbers, levels for text.

    counts are read several times: a written table. Attributions with few values are treated as levels. Features with under five values on a side are skipped.
    """
    by = [key, "kind", "name"]
    some = F.col("n0") + F.col("n1")
    stats = counts.groupBy(by).agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.count("v").alias("card"), F.sum(F.col("v") * F.col("n0")).alias("s0"), F.sum(F.col("v") * F.col("n1")).alias("s1"))
    q = ranks.quantiles_of(counts.select(*by, "v", some.alias("n")), by, [round(0.1 * i, 1) for i in range(11)]).select(*by, "q")
    stats = stats.join(q, by, "left").withColumns({"levels": (F.col("kind") == "T") | ((F.col("kind") == "A") & (F.col("card") <= max_levels)), "edges": interior(F.col("q"))}).drop("q", "card")
    j = counts.join(stats, by)
    bucket = F.when(F.col("levels"), F.coalesce("t", F.col("v").cast("string"))).otherwise(right_closed(F.col("v"), F.col("edges")).cast("string"))
    g = j.groupBy(*by, bucket.alias("bucket")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), *[F.first(c).alias(c) for c in ("t0", "t1", "levels", "s0", "s1")], F.first(F.size("edges") + 1).alias("k"))
    share = lambda i: (F.col(f"n{i}") + EPS) / (F.col(f"t{i}") + F.when(F.col("levels"), EPS).otherwise(EPS * F.col("k")))
    out = g.groupBy(by).agg(F.greatest(F.lit(0.0), F.sum(psi_term(share(0), share(1)))).alias("psi"), F.first("t0").alias("t0"), F.first("t1").alias("t1"), F.first("s0").alias("s0"), F.first("s1").alias("s1"))
    empty = (F.col("t0") == 0) | (F.col("t1") == 0)
    delta = F.when(~empty, F.col("s1") / F.nullif("t1", F.lit(0)) - F.col("s0") / F.nullif("t0", F.lit(0)))
    return out.where((F.col("kind") == "A") | (F.least("t0", "t1") >= 5)).select(*by, F.when(empty, 0.0).otherwise(F.col("psi")).alias("psi"), F.when(F.col("kind") == "A", delta).alias("delta"))


def top_drift(drifts: DataFrame, key: str = "cand_id") -> DataFrame:
    """Per candidate: mean and top feature PSI, mean attribution shift, and the attribution with the largest PSI."""
    feature, shap = F.col("kind") != "A", F.col("kind") == "A"
    order = lambda k: F.max(F.when(k, F.struct("psi", F.translate("name", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba").alias("z"), "name")))  # noqa: E731  ties: the smaller name
    return drifts.groupBy(key).agg(
        F.coalesce(F.avg(F.when(feature, F.col("psi"))), F.lit(0.0)).alias("mean_feature_psi"), order(feature).alias("f"), F.coalesce(F.avg(F.when(shap, F.abs("delta"))), F.lit(0.0)).alias("mean_shap_shift"), order(shap).alias("a")
    ).select(key, "mean_feature_psi", "mean_shap_shift", F.col("f.name").alias("top_drift_feature"), F.coalesce("f.psi", F.lit(0.0)).alias("top_drift_psi"), F.col("a.name").alias("top_shap_shift_feature"), F.coalesce("a.psi", F.lit(0.0)).alias("top_shap_shift_psi"))


def derived(perf: DataFrame, totals: Totals) -> DataFrame:
    """Shares, rates, differences (monitoring less baseline) and p-values from counts."""
    c = F.col
    p = perf.withColumns({
        "pct_dev": c("n_dev") / F.lit(max(1, totals.n0)), "pct_mon": c("n_mon") / F.lit(max(1, totals.n1)), "br_dev": c("x_dev") / c("n_dev"), "br_mon": c("x_mon") / c("n_mon"),
        "gini_dev": 2 * c("auc_dev") - 1, "gini_mon": 2 * c("auc_mon") - 1, "dev_weight_pct": c("weight_dev") / totals.w0 if totals.w0 else F.lit(0.0), "mon_weight_pct": c("weight_mon") / totals.w1 if totals.w1 else F.lit(0.0),
    })
    pooled = (c("x_dev") + c("x_mon")) / (c("n_dev") + c("n_mon"))
    variance = pooled * (1 - pooled) * (1 / c("n_dev") + 1 / c("n_mon"))
    z = F.when(variance > 0, (c("br_mon") - c("br_dev")) / F.sqrt(variance))
    return p.withColumns({
        "psi": psi_floored(c("pct_dev"), c("pct_mon")), "delta_br": c("br_mon") - c("br_dev"), "br_pvalue": normal_two_sided(z), "delta_auc": c("auc_mon") - c("auc_dev"), "delta_gini": c("gini_mon") - c("gini_dev"), "delta_ks": c("ks_mon") - c("ks_dev"),
        "score_shift_pvalue": ks_survival(c("ks_shift"), c("n_dev"), c("n_mon")), "exposure_drift": c("mon_weight_pct") - c("dev_weight_pct"),
        "calibration_drift": c("x_mon") / F.greatest(c("s_mon"), F.lit(EPS)) - c("x_dev") / F.greatest(c("s_dev"), F.lit(EPS)),
    })


METRICS = ["n_dev", "n_mon", "pct_dev", "pct_mon", "x_dev", "x_mon", "psi", "br_dev", "br_mon", "delta_br", "br_pvalue", "auc_dev", "auc_mon", "delta_auc", "gini_dev", "gini_mon", "delta_gini", "ks_dev", "ks_mon", "delta_ks", "score_shift_pvalue", "weight_dev", "weight_mon", "dev_weight_pct", "mon_weight_pct", "exposure_drift", "calibration_drift", "mean_feature_psi", "mean_shap_shift", "top_drift_feature", "top_drift_psi", "top_shap_shift_feature", "top_shap_shift_psi"]


#: Rows whose histograms a task makes together.
TOGETHER = 100_000

_HISTOGRAM = "kind string, name string, v double, t string, n0 long, n1 long, b0 long, b1 long, w0 double, w1 double"


@dataclass(frozen=True)
class Finder:
    """Which candidates a row fits, found in the task: of(arrays) takes the columns by name, and gives places of rows and the
    candidates beside them. each: candidates that a row fits at most."""

    columns: dict[str, Column]
    of: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]
    each: int = 1


#: Pairs of rows and candidates that are found together, and cells (candidate, value) that are counted together: what bounds a
#: task's memory, whatever the number of candidates and values.
PAIRS, COUNTED = 1_000_000, 1_000_000


def histograms(rows: DataFrame, roles: Roles, key: str = "cand_id", finder: Finder | None = None) -> tuple[DataFrame, DataFrame]:
    """(score_histogram, value_counts) in one scan of rows with `hits`, the candidates that a row fits, or with a finder.

    A task counts its rows by (candidate, value) in arrays, a column at a time, so no row is multiplied; what it sends is
    added up in a shuffle and written once, as both tables are read several times. Candidates are counted in turns of COUNTED
    cells at most (one candidate at least).
    """
    numbers, texts = [*roles.numeric, *roles.shap], list(roles.categorical)
    w = F.coalesce(F.col(roles.weight).cast("double"), F.lit(0.0)) if roles.weight else F.lit(0.0)
    found_by, of_rows = (list(finder.columns), finder.of) if finder else ([], None)
    finds = [finder.columns[name].alias(f"f_{name}") for name in found_by]
    df = rows.select("hits" if finder is None else F.lit(0).alias("hits"), F.col("side").cast("int").alias("side"), F.col(roles.target).cast("int").alias("y"), F.col(roles.score).cast("double").alias("s"), w.alias("w"), *[F.col(c).cast("double").alias(f"n_{c}") for c in numbers], *[F.col(c).cast("string").alias(f"t_{c}") for c in texts], *finds)
    together = TOGETHER if finder is None else max(1, min(TOGETHER, PAIRS // finder.each))
    shap = set(roles.shap)

    def count(batches):
        import pyarrow as pa

        schema = pa.schema([(key, pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("v", pa.float64()), ("t", pa.string()), *[(c, pa.int64()) for c in ("n0", "n1", "b0", "b1")], ("w0", pa.float64()), ("w1", pa.float64())])

        def made(held: list):
            table = pa.Table.from_batches(held).combine_chunks()
            if of_rows is None:
                hits = table.column("hits").chunk(0)
                cands, cand = np.unique(hits.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
                row = np.repeat(np.arange(len(hits)), np.diff(np.asarray(hits.offsets)))
            else:
                row, cand = of_rows({name: table.column(f"f_{name}").to_numpy() for name in found_by})
                if not len(cand):
                    return
                cands = np.flatnonzero(np.bincount(cand))
                cand = np.searchsorted(cands, cand)
                table = table.select(table.column_names[: table.num_columns - len(found_by)])
            order = np.argsort(cand, kind="stable")
            row, cand = row[order], cand[order]
            begins = np.searchsorted(cand, np.arange(len(cands) + 1))
            side, y = (table.column(c).to_numpy() for c in ("side", "y"))
            for name in ["s", *table.column_names[5:]]:
                column = table.column(name).chunk(0)
                text = name.startswith("t_")
                if text:
                    coded = column.dictionary_encode()
                    labels, code, ok = coded.dictionary, coded.indices.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
                else:
                    ok = column.is_valid().to_numpy(zero_copy_only=False)
                    labels, code = np.unique(column.fill_null(0.0).to_numpy(), return_inverse=True)
                n_labels, step = max(1, len(labels)), max(1, COUNTED // max(1, len(labels)))
                for first in range(0, len(cands), step):
                    n_cands, some = min(step, len(cands) - first), slice(begins[first], begins[min(first + step, len(cands))])
                    at = row[some]
                    here = ok[at]
                    at = at[here]
                    of = (cand[some][here] - first) * n_labels + code[at]
                    total = lambda mask, weights=None: np.bincount(of[mask], None if weights is None else weights[at[mask]], n_cands * n_labels)  # noqa: E731,B023
                    on = [side[at] == i for i in (0, 1)]
                    n = [total(m) for m in on]
                    keep = np.flatnonzero(n[0] + n[1])
                    if not len(keep):
                        continue
                    zero = np.zeros(len(keep))
                    b, weight = ([total(m, v)[keep] for m in on] for v in (y.astype(float), table.column("w").to_numpy())) if name == "s" else ([zero, zero], [zero, zero])
                    of_cand, value = first + keep // n_labels, keep % n_labels
                    kind = "S" if name == "s" else "T" if text else "A" if name[2:] in shap else "N"
                    v, t = (pa.nulls(len(keep), pa.float64()), labels.take(pa.array(value))) if text else (pa.array(labels[value]), pa.nulls(len(keep), pa.string()))
                    yield pa.RecordBatch.from_arrays([pa.array(cands[of_cand], pa.int32()), pa.repeat(pa.scalar(kind), len(keep)), pa.repeat(pa.scalar(name if name == "s" else name[2:]), len(keep)), v, t, *(pa.array(x[keep], pa.int64()) for x in n), *(pa.array(x.astype(np.int64)) for x in b), *map(pa.array, weight)], schema=schema)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= together:
                yield from made(held)
                held, size = [], 0
        if size:
            yield from made(held)

    sums = [F.sum(c).alias(c) for c in ("n0", "n1", "b0", "b1", "w0", "w1")]
    df = df.where("size(hits) > 0") if finder is None else df
    both = staged(df.mapInArrow(count, f"{key} int, {_HISTOGRAM}").groupBy(key, "kind", "name", "v", "t").agg(*sums), "histograms")
    scores = both.where("kind = 'S'").select(key, F.col("v").alias("s"), "b0", (F.col("n0") - F.col("b0")).alias("g0"), "b1", (F.col("n1") - F.col("b1")).alias("g1"), "w0", "w1")
    return scores, both.where("kind <> 'S'").select(key, "name", "v", "n0", "n1", "kind", "t")


def measured(scores: DataFrame, counts: DataFrame, roles: Roles, totals: Totals, key: str = "cand_id") -> DataFrame:
    """METRICS from a score histogram and value counts."""
    out = derived(performance(scores, key), totals)
    if roles.numeric or roles.categorical or roles.shap:
        out = out.join(top_drift(feature_drift(counts, key), key), key, "left")
    else:
        out = out.withColumns({"mean_feature_psi": F.lit(0.0), "mean_shap_shift": F.lit(0.0), "top_drift_feature": F.lit(None).cast("string"), "top_drift_psi": F.lit(0.0), "top_shap_shift_feature": F.lit(None).cast("string"), "top_shap_shift_psi": F.lit(0.0)})
    return out.select(key, *METRICS)


def evaluate_hits(rows: DataFrame, roles: Roles, totals: Totals, key: str = "cand_id", finder: Finder | None = None) -> DataFrame:
    """Measures of the candidates in `hits`, or of those that the finder finds."""
    return measured(*histograms(rows, roles, key, finder), roles, totals, key)


def evaluate_members(m: DataFrame, roles: Roles, totals: Totals, key: str = "cand_id") -> DataFrame:
    """Measures of the groups that a column of any type names, a row for each member."""
    return measured(score_histogram(m, roles, key), staged(value_counts(m, roles, key), "counts"), roles, totals, key)


def evaluate(df: DataFrame, rules: list[Rule], roles: Roles, totals: Totals) -> DataFrame:
    """One row per rule: technique, cand_id, segment_definition and METRICS. Rules with an empty side have no row."""
    spark = df.sparkSession
    named = spark.createDataFrame([(r.cand_id, r.technique, r.label()) for r in rules], "cand_id int, technique string, segment_definition string")
    return F.broadcast(named).join(evaluate_hits(with_hits(df, rules), roles, totals), "cand_id").select("technique", "cand_id", "segment_definition", *METRICS)
