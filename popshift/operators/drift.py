"""Baseline against monitoring, column by column: schema, completeness, PSI, distribution, entropy, KS, target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from popshift.functions.buckets import psi_floored, psi_term, right_closed, suite_label
from popshift.operators import ranks
from popshift.operators.quality import numeric_long, profile, text_long

TINY = 1e-6


def kind(data_type: T.DataType) -> str:
    return "numeric" if isinstance(data_type, T.NumericType) else "char"


def schema_drift(spark: SparkSession, dev: T.StructType, mon: T.StructType) -> DataFrame:
    """added, dropped, type_changed or unchanged for each column, names compared without case. A full outer join."""
    shape = "key string, name string, type string"
    rows = lambda s: spark.createDataFrame([(f.name.upper(), f.name, kind(f.dataType)) for f in s], shape)
    d, m = rows(dev).alias("d"), rows(mon).alias("m")
    change = F.when(F.col("d.name").isNull(), "added").when(F.col("m.name").isNull(), "dropped").when(F.col("d.type") != F.col("m.type"), "type_changed").otherwise("unchanged")
    return d.join(m, F.col("d.key") == F.col("m.key"), "full").select(F.coalesce("d.name", "m.name").alias("name"), change.alias("change_type"), F.col("d.type").alias("dev_type"), F.col("m.type").alias("mon_type"))


def on(side: int, value: Column) -> Column:
    return F.when(F.col("side") == side, value)


def completeness(df: DataFrame, columns: list[str], alert: float = 5.0) -> DataFrame:
    long = text_long(df, columns)
    pct = lambda s: 100.0 * F.count(on(s, F.col("v"))) / F.count(on(s, F.lit(1)))
    out = long.groupBy("name").agg(pct(0).alias("dev_completeness_pct"), pct(1).alias("mon_completeness_pct"))
    delta = F.col("mon_completeness_pct") - F.col("dev_completeness_pct")
    return out.withColumns({"delta_pp": delta, "pattern": F.when(delta <= -alert, "growing_missing").when(delta >= alert, "recovering").otherwise("stable_missing")})


def _share(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Shares of n0 and n1 within the keys."""
    w = Window.partitionBy(*keys)
    return counts.withColumns({"p0": F.col("n0") / F.sum("n0").over(w), "p1": F.col("n1") / F.sum("n1").over(w)})


def _counts(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(on(0, F.lit(1))).alias("n0"), F.count(on(1, F.lit(1))).alias("n1"))


def csi(df: DataFrame, columns: list[str], stable: float = 0.10, shift: float = 0.25) -> DataFrame:
    """PSI over the baseline's nine decile cuts; an empty bucket counts as 1e-6."""
    hist = ranks.histogram(numeric_long(df, columns).where("v is not null"), ["side", "name"])
    cuts = ranks.quantiles_of(hist.where("side = 0"), ["name"], [round(0.1 * i, 1) for i in range(1, 10)]).select("name", F.col("q").alias("cuts"))
    binned = hist.join(F.broadcast(cuts), "name").withColumn("bucket", right_closed(F.col("v"), F.col("cuts")))
    total = lambda s: F.coalesce(F.sum(on(s, F.col("n"))), F.lit(0)).alias(f"n{s}")
    shares = _share(binned.groupBy("name", "bucket").agg(total(0), total(1)), ["name"])
    tiny = lambda c: F.when(F.col(c) > 0, F.col(c)).otherwise(TINY)
    psi = F.round(F.sum(psi_term(tiny("p0"), tiny("p1"))), 4)
    return shares.groupBy(F.col("name").alias("feature")).agg(psi.alias("csi")).withColumn("label", suite_label(F.col("csi"), stable, shift))


def categorical_psi(df: DataFrame, columns: list[str], stable: float = 0.10, shift: float = 0.25) -> DataFrame:
    """PSI over the levels of both sides, shares floored at 1e-6."""
    shares = _share(_counts(text_long(df, columns).where("v is not null"), "name", "v"), ["name"])
    psi = F.round(F.sum(psi_floored(F.col("p0"), F.col("p1"))), 4)
    return shares.groupBy(F.col("name").alias("feature")).agg(psi.alias("psi")).withColumn("label", suite_label(F.col("psi"), stable, shift))


def entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """Shannon entropy in bits of each side's levels, nulls excluded."""
    shares = _share(_counts(text_long(df, columns).where("v is not null"), "name", "v"), ["name"])
    bits = lambda p: F.coalesce(-F.sum(F.when(F.col(p) > 0, F.col(p) * F.log2(p))), F.lit(0.0))
    out = shares.groupBy(F.col("name").alias("feature")).agg(bits("p0").alias("h0"), bits("p1").alias("h1"))
    return out.select("feature", F.round("h0", 4).alias("dev_entropy"), F.round("h1", 4).alias("mon_entropy"), F.round(F.col("h1") - F.col("h0"), 4).alias("entropy_delta"))


def five_point_ks(df: DataFrame, columns: list[str], stable: float = 0.10, shift: float = 0.20) -> DataFrame:
    """Largest gap between the cumulative shares at the baseline's minimum, quartiles and maximum."""
    points = [0.0, 0.25, 0.5, 0.75, 1.0]
    hist = ranks.histogram(numeric_long(df, columns).where("v is not null"), ["side", "name"])
    q = ranks.quantiles_of(hist, ["side", "name"], points).groupBy("name").agg(F.max(on(0, F.col("q"))).alias("d"), F.max(on(1, F.col("q"))).alias("m"))

    def monitored(x: Column) -> Column:
        j = F.size(F.filter("m", lambda e: e <= x))
        lo, hi = F.get("m", j - 1), F.get("m", j)
        return F.when(j == 0, 0.0).when(j == 5, 1.0).otherwise(0.25 * (j - 1) + 0.25 * (x - lo) / (hi - lo))

    ks = F.greatest(*[F.abs(monitored(F.get("d", i)) - p) for i, p in enumerate(points)])
    return q.select(F.col("name").alias("feature"), F.round(ks, 4).alias("ks_statistic"), suite_label(ks, stable, shift).alias("label"))


def target_drift(df: DataFrame, target: str, notable: float = 3.0, critical: float = 8.0) -> DataFrame:
    rates = df.agg((100 * F.avg(on(0, F.col(target)))).alias("r0"), (100 * F.avg(on(1, F.col(target)))).alias("r1"))
    gap = F.abs(F.col("r1") - F.col("r0"))
    label = F.when(gap < notable, "stable").when(gap < critical, "notable").otherwise("critical")
    return rates.select(F.lit(target).alias("target"), F.round("r0", 2).alias("dev_event_rate_pct"), F.round("r1", 2).alias("mon_event_rate_pct"), F.round(F.col("r1") - F.col("r0"), 2).alias("delta_pp"), label.alias("label"))


def distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """Moments side by side, and relative changes of cardinality, spread and location."""
    p = profile(df, columns, columns[:1]).where("type = 1")
    d, m = p.where("side = 0").alias("d"), p.where("side = 1").alias("m")
    j = d.join(F.broadcast(m), F.upper("d.name") == F.upper("m.name"))
    col = lambda s, c: F.col(f"{s}.{c}")
    r = lambda x, k: F.round(x, k)
    cv = lambda s: F.when(col(s, "mean") != 0, r(col(s, "std") / col(s, "mean"), 4))
    iqr = col("d", "q75") - col("d", "q25")
    pairs = [r(col(s, c), 4).alias(f"{n}_{c}") for c in ("mean", "std", "skewness") for s, n in (("d", "dev"), ("m", "mon"))]
    ends = [col(s, c).alias(f"{n}_{c}") for c in ("min", "max") for s, n in (("d", "dev"), ("m", "mon"))]
    return j.select(
        col("d", "name").alias("name"), *pairs, *ends,
        r((col("m", "cardinality_count") - col("d", "cardinality_count")) / col("d", "cardinality_count"), 3).alias("cardinality_pct_change"),
        F.when(col("d", "std") > 0, r((col("m", "std") - col("d", "std")) / col("d", "std"), 3)).alias("std_drift_pct"),
        cv("d").alias("dev_cv"), cv("m").alias("mon_cv"),
        F.when(cv("d") != 0, r((cv("m") - cv("d")) / cv("d"), 3)).alias("cv_drift_pct"),
        r(col("m", "kurtosis") - col("d", "kurtosis"), 4).alias("kurtosis_delta"),
        F.when(iqr > 0, r((col("m", "q50") - col("d", "q50")) / iqr, 4)).alias("median_shift_iqr"),
    )


def overall_status(labels: DataFrame) -> DataFrame:
    """(label) of all sections to the worst as Stable, Monitor or Shift."""
    rank = F.max(F.when(F.col("label").isin("shift", "critical"), 2).when(F.col("label").isin("monitor", "notable"), 1).otherwise(0))
    return labels.agg(F.element_at(F.array(F.lit("Stable"), F.lit("Monitor"), F.lit("Shift")), rank.cast("int") + 1).alias("overall_status"), F.count_if(F.col("label").isin("shift", "critical")).alias("n_shift"), F.count_if(F.col("label").isin("monitor", "notable")).alias("n_monitor"))


def run_suite(df: DataFrame, target: str | None = None, score: str | None = None, features: list[str] = [], categories: list[str] = [], columns: list[str] | None = None) -> dict[str, DataFrame]:
    """The sections that the given columns allow."""
    out = {"completeness": completeness(df, columns or [c for c in df.columns if c != "side"])}
    if features:
        out |= {"csi": csi(df, features), "distribution": distribution(df, features), "ks": five_point_ks(df, features)}
    if score:
        out["score_psi"] = csi(df, [score]).select(F.col("feature").alias("score_column"), F.col("csi").alias("psi"), "label")
    if target:
        out["target"] = target_drift(df, target)
    if categories:
        out |= {"entropy": entropy(df, categories), "categorical_psi": categorical_psi(df, categories)}
    return out
