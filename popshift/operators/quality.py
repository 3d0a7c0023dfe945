"""Data quality: column profiles, blockers, governance flags, health scores."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from popshift.operators import ranks


def numeric_long(df: DataFrame, columns: Iterable[str], ids: Iterable[str] = ("side",)) -> DataFrame:
    """A row for each row and numeric column: ids, name, v (double; NaN is null)."""
    columns, ids = list(columns), list(ids)
    wide = df.select(*ids, *[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in columns])
    return wide.unpivot(ids, columns, "name", "v")


def text_long(df: DataFrame, columns: Iterable[str], ids: Iterable[str] = ("side",)) -> DataFrame:
    columns, ids = list(columns), list(ids)
    return df.select(*ids, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(ids, columns, "name", "v")


def _corrected(n: Column, skew: Column, kurt: Column) -> tuple[Column, Column]:
    """Bias-corrected G1 and G2 of population moments, for more than three values."""
    g1 = skew * F.sqrt(n * (n - 1)) / (n - 2)
    g2 = ((n + 1) * kurt + 6) * (n - 1) / ((n - 2) * (n - 3))
    return F.when(n > 3, g1), F.when(n > 3, g2)


def profile(df: DataFrame, numeric: list[str], text: list[str], ids: tuple[str, ...] = ("side",)) -> DataFrame:
    """One row per column (and side): counts, completeness, uniqueness, moments, quartiles, values beyond 1.5 IQR.

    The rows are read once, for counts by distinct value; everything else comes from those. What is broadcast is a row for each
    column and side.
    """
    keys = [*ids, "name"]
    rows = F.sum("n")
    valid = F.coalesce(F.sum(F.when(F.col("v").isNotNull(), F.col("n"))), F.lit(0))
    shared = [F.count("v").alias("cardinality_count"), (rows - valid).alias("missing_count"), (100.0 * valid / rows).alias("completeness_pct"), (100.0 * F.count("v") / F.greatest(valid, F.lit(1))).alias("uniqueness_pct")]
    hist = ranks.histogram(numeric_long(df, numeric, ids), keys)
    num = hist.groupBy(keys).agg(*shared, valid.cast("double").alias("_n"), (F.sum(F.col("v") * F.col("n")) / F.nullif(valid, F.lit(0))).alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"))
    gap = F.col("v") - F.col("mean")
    moments = hist.where("v is not null").join(F.broadcast(num.select(*keys, "mean")), keys).groupBy(keys).agg(*[F.sum(F.col("n") * F.pow(gap, F.lit(k))).alias(f"_m{k}") for k in (2, 3, 4)])
    q = ranks.quantiles_of(hist, keys, [0.25, 0.5, 0.75]).select(*keys, *[F.get("q", i).alias(k) for i, k in enumerate(("q25", "q50", "q75"))])
    fences = q.select(*keys, (F.col("q25") - 1.5 * (F.col("q75") - F.col("q25"))).alias("lo"), (F.col("q75") + 1.5 * (F.col("q75") - F.col("q25"))).alias("hi"))
    beyond = hist.join(F.broadcast(fences), keys).groupBy(keys).agg(F.coalesce(F.sum(F.when((F.col("v") < F.col("lo")) | (F.col("v") > F.col("hi")), F.col("n"))), F.lit(0)).alias("n_outliers"))
    n, m2 = F.col("_n"), F.nullif("_m2", F.lit(0.0))
    g1, g2 = _corrected(n, F.sqrt(n) * F.col("_m3") / F.pow(m2, F.lit(1.5)), n * F.col("_m4") / (m2 * m2) - 3.0)
    num = num.join(F.broadcast(moments), keys, "left").join(F.broadcast(q), keys, "left").join(F.broadcast(beyond), keys, "left")
    num = num.select(*keys, F.lit(1).alias("type"), "cardinality_count", "missing_count", "completeness_pct", "uniqueness_pct", "mean", F.when(n > 1, F.sqrt(F.col("_m2") / (n - 1))).alias("std"), "min", "max", g1.alias("skewness"), g2.alias("kurtosis"), "q25", "q50", "q75", F.coalesce("n_outliers", F.lit(0)).alias("n_outliers"))
    counted = text_long(df, text, ids).groupBy(*keys, "v").agg(F.count("*").alias("n"))
    txt = counted.groupBy(keys).agg(*shared).withColumn("type", F.lit(2)).withColumn("n_outliers", F.lit(0).cast("long"))
    return num.unionByName(txt, allowMissingColumns=True)


def blockers(prof: DataFrame, missing_threshold: float = 50.0) -> DataFrame:
    """(…, name, rule): columns that are mostly missing, or have at most one value."""
    missing = prof.where(F.col("completeness_pct") < missing_threshold).withColumn("rule", F.lit("high_missing"))
    constant = prof.where("cardinality_count <= 1").withColumn("rule", F.lit("zero_variance"))
    return missing.unionByName(constant)


def governance(prof: DataFrame, id_cols: list[str] = [], private_cols: list[str] = [], target: str | None = None, id_uniqueness: float = 99.9, leakage_card: int = 50) -> DataFrame:
    """(…, name, risk_type): identifiers, columns that look like a model's output, columns listed as private."""
    upper = F.upper("name")
    listed = lambda names: upper.isin([x.upper() for x in names]) if names else F.lit(False)
    risks = F.array_compact(
        F.array(
            F.when((F.col("uniqueness_pct") >= id_uniqueness) | listed(id_cols), "IDENTIFIER"),
            F.when((F.col("type") == 1) & (F.col("min") >= 0) & (F.col("max") <= 1) & (F.col("cardinality_count") >= leakage_card) & ~listed([target] if target else []), "LEAKAGE"),
            F.when(listed(private_cols), "PRIVACY"),
        )
    )
    return prof.withColumn("risk_type", F.explode(risks))


def health(prof: DataFrame, blocked: DataFrame, governed: DataFrame, ids: tuple[str, ...] = ("side",), weights=(0.35, 0.25, 0.25, 0.15)) -> DataFrame:
    """Score 0-100 and status of each column; a blocked column scores 0 and is dropped."""
    keys = [*ids, "name"]
    flags = lambda df, name: F.broadcast(df.select(*keys).distinct().withColumn(name, F.lit(True)))
    p = prof.join(flags(blocked, "is_blocked"), keys, "left").join(flags(governed, "is_governed"), keys, "left")
    p = p.withColumns({"is_blocked": F.coalesce("is_blocked", F.lit(False)), "is_governed": F.coalesce("is_governed", F.lit(False))})
    c = F.col("completeness_pct") / 100.0
    v = F.when(F.col("cardinality_count") > 1, 1.0).otherwise(0.0)
    g = F.when(F.col("is_governed"), 0.4).otherwise(1.0)
    d = F.when((F.col("type") != 1) | (F.abs(F.coalesce("skewness", F.lit(0.0))) < 1), 1.0).otherwise(0.0)
    score = F.when(F.col("is_blocked"), 0.0).otherwise(F.bround(100.0 * (weights[0] * c + weights[1] * v + weights[2] * g + weights[3] * d), 1))
    status = F.when(F.col("is_blocked"), "drop").when(F.col("is_governed"), "caution").otherwise("ready")
    return p.select(*keys, c.alias("completeness_score"), v.alias("variance_score"), g.alias("governance_score"), d.alias("distribution_score"), score.alias("health_score"), status.alias("status"))


def readiness(scores: DataFrame, ids: tuple[str, ...] = ("side",)) -> DataFrame:
    return scores.groupBy(*ids).agg(F.bround(F.avg("health_score"), 1).alias("readiness_score"))
