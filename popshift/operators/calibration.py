"""Unregularised logistic calibration of a score, for many groups at once: grouped sums per Newton step, no gathered group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from popshift.operators import evaluate as ev

c = F.col
STEPS, TOLERANCE = 25, 1e-10


def logistic(m: DataFrame, roles: ev.Roles, keys: list[str]) -> DataFrame:
    """(keys, intercept, slope) of y ~ clipped score; null where only one class is there.

    Rows are first summed to (keys, score); each step is one grouped aggregate over that histogram, and its result, a row for
    each group, is joined to the next step as a broadcast table.
    """
    s = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), c(roles.score)))
    h = m.groupBy(*keys, s.alias("x")).agg(F.count("*").alias("n"), F.sum(roles.target).alias("k")).persist()
    fit = h.groupBy(keys).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    rate = c("k") / c("n")
    fit = fit.select(*keys, F.when((c("k") > 0) & (c("k") < c("n")), F.ln(rate / (1 - rate))).alias("a"), F.lit(0.0).alias("b"))
    spark = m.sparkSession
    for _ in range(STEPS):
        p = 1 / (1 + F.exp(-(c("a") + c("b") * c("x"))))
        w = c("n") * p * (1 - p)
        total = lambda e, name: F.sum(e).alias(name)
        g = h.join(F.broadcast(fit), keys).groupBy(*keys, "a", "b").agg(total(c("k") - c("n") * p, "g0"), total((c("k") - c("n") * p) * c("x"), "g1"), total(w, "h00"), total(w * c("x"), "h01"), total(w * c("x") * c("x"), "h11"))
        det = c("h00") * c("h11") - c("h01") * c("h01")
        da: Column = F.when(det > 1e-12, (c("h11") * c("g0") - c("h01") * c("g1")) / det).otherwise(0.0)
        db: Column = F.when(det > 1e-12, (c("h00") * c("g1") - c("h01") * c("g0")) / det).otherwise(0.0)
        rows = g.select(*keys, (c("a") + da).alias("a"), (c("b") + db).alias("b"), F.greatest(F.abs(da), F.abs(db)).alias("move")).collect()  # a row for each group
        fit = spark.createDataFrame([tuple(r)[:-1] for r in rows], fit.schema)
        if max((r["move"] or 0.0 for r in rows), default=0.0) < TOLERANCE:
            break
    h.unpersist()
    return fit.select(*keys, F.when(c("a").isNotNull(), c("a")).alias("intercept"), F.when(c("a").isNotNull(), c("b")).alias("slope"))


def calibration_shift(df: DataFrame, roles: ev.Roles, segment: str) -> DataFrame:
    """(segment, intercepts and slopes of both sides, their changes)."""
    f = logistic(df, roles, [segment, "side"])
    d, m = f.where("side = 0").alias("d"), f.where("side = 1").alias("m")
    j = d.join(m, c(f"d.{segment}") == c(f"m.{segment}"))
    return j.select(c(f"d.{segment}").alias(segment), *[c(f"{s}.{k}").alias(f"{n}_{k}") for k in ("intercept", "slope") for s, n in (("d", "dev"), ("m", "mon"))], (c("m.intercept") - c("d.intercept")).alias("delta_intercept"), (c("m.slope") - c("d.slope")).alias("delta_slope"))
