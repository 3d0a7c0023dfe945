"""Several periods: appearances, recurrence, trend scores, time series, forecast."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from popshift.functions.special import t_quantile_column, t_two_sided_column
from popshift.operators.scoring import blend, worst

c = F.col


@dataclass(frozen=True)
class TrendConfig:
    n_worst: int = 10
    half_life: float = 2.0
    w_frequency: float = 0.4
    w_recency: float = 0.3
    w_consistency: float = 0.3
    trend_weight: float = 0.5
    alert: float = 0.5
    horizon: int = 6


KEYS = ["technique", "segment_definition"]


def period_index(df: DataFrame) -> DataFrame:
    """df with period_index: periods numbered in order from 0. Periods are few, so the numbering is a broadcast join."""
    periods = df.select("period").distinct()
    numbered = periods.withColumn("period_index", F.dense_rank().over(Window.orderBy("period")) - 1)
    return df.join(F.broadcast(numbered), "period")


def appearances(history: DataFrame, n_worst: int = 10) -> DataFrame:
    """Rows among the worst of their technique in their period. history: period, period_index, technique, scores."""
    return worst(history, n_worst, ("period", "technique"))


def recurrence(history: DataFrame, n_worst: int = 10) -> DataFrame:
    """How often a segment is among the worst of a whole period."""
    w = worst(history, n_worst, ("period",))
    total = w.agg(F.count_distinct("period").alias("total_periods"))
    g = w.groupBy(KEYS).agg(F.count_distinct("period").alias("periods_appeared"), F.avg("severity_score").alias("avg_severity_score"))
    return g.join(F.broadcast(total), how="cross").withColumn("recurrence_pct", F.bround(100 * c("periods_appeared") / c("total_periods"), 1))


def trend(appeared: DataFrame, total_periods: int, cfg: TrendConfig = TrendConfig()) -> DataFrame:
    """One row per segment: frequency, recency and consistency (longest run of periods), its latest scores, boosted."""
    runs = appeared.select(*KEYS, "period_index").distinct().withColumn("island", c("period_index") - F.row_number().over(Window.partitionBy(*KEYS).orderBy("period_index")))
    longest = runs.groupBy(*KEYS, "island").agg(F.count("*").alias("run")).groupBy(KEYS).agg(F.max("run").alias("longest"))
    latest = F.max_by(F.struct("sis_raw", "dis_raw", "mean_feature_psi", "mean_shap_shift"), "period_index").alias("l")
    names = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("period_index", "period"))), lambda x: x["period"]), ", ")
    g = appeared.groupBy(KEYS).agg(F.count_distinct("period_index").alias("periods_appeared"), F.max("period_index").alias("last"), names.alias("appeared_in"), latest).join(longest, KEYS)
    frequency, consistency = c("periods_appeared") / F.lit(total_periods), c("longest") / F.lit(total_periods)
    recency = F.pow(F.lit(0.5), (F.lit(total_periods - 1) - c("last")) / cfg.half_life)
    tis = cfg.w_frequency * frequency + cfg.w_recency * recency + cfg.w_consistency * consistency
    g = g.select(*KEYS, "periods_appeared", F.lit(total_periods).alias("total_periods"), "appeared_in", F.bround(frequency, 4).alias("frequency"), F.bround(recency, 4).alias("recency_factor"), F.bround(consistency, 4).alias("consistency_score"), tis.alias("tis"), F.bround(tis, 4).alias("trend_impact_score"), *[F.coalesce(f"l.{k}", F.lit(0.0)).alias(k) for k in ("sis_raw", "dis_raw", "mean_feature_psi", "mean_shap_shift")])
    g = g.withColumn("sis_trend", c("sis_raw") * (1 + cfg.trend_weight * c("tis")))
    base = blend("sis_raw", "dis_raw", "mean_feature_psi", "mean_shap_shift")
    g = g.withColumn("root_cause_score_trend", F.least(F.lit(1.0), base * (1 + cfg.trend_weight * c("trend_impact_score"))))
    return g.withColumn("severity_score_trend", 20 * c("root_cause_score_trend")).drop("tis")


def time_series(appeared: DataFrame, metrics: list[str]) -> DataFrame:
    return appeared.select(*KEYS, "period", "period_index", *metrics).orderBy(*KEYS, "period_index")


def with_gaps(series: DataFrame, periods: DataFrame) -> DataFrame:
    """A row for each segment and period; metrics are null where the segment wasn't among the worst."""
    segments = series.select(*KEYS).distinct()
    scaffold = segments.join(F.broadcast(periods.select("period", "period_index").distinct()), how="cross")
    return scaffold.join(series, [*KEYS, "period", "period_index"], "left")


def forecast(series: DataFrame, cfg: TrendConfig = TrendConfig()) -> DataFrame:
    """Ordinary least squares of the root-cause score on the period, one period ahead, for segments with two or more."""
    x, y = c("period_index").cast("double"), c("root_cause_score").cast("double")
    g = series.groupBy(KEYS).agg(
        F.count("*").alias("n"), F.count(y).alias("valid"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"), F.regr_sxy(y, x).alias("sxy"), F.avg(x).alias("mean_x"),
        F.max(x).alias("last"), F.max_by(y, x).alias("current"), F.max_by("period", x).alias("last_period"),
    ).where("n >= 2 and valid = n")
    clip = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    dof = c("n") - 2
    g = g.withColumns({"next": c("last") + 1, "sse": F.greatest(F.lit(0.0), c("syy") - c("slope") * c("sxy"))}).withColumn("predicted", clip(c("slope") * c("next") + c("intercept")))
    g = g.withColumns({"se": F.when(dof > 0, F.sqrt(c("sse") / dof)), "t": F.when((dof > 0) & (c("sse") > 1e-30), c("slope") / F.sqrt(c("sse") / dof / c("sxx")))})
    margin = t_quantile_column(F.lit(0.975), F.when(dof > 0, dof).otherwise(0)) * c("se") * F.sqrt(1 + 1 / c("n") + (c("next") - c("mean_x")) ** 2 / c("sxx"))
    p = F.when(dof > 0, F.when(c("t").isNotNull(), t_two_sided_column(c("t"), F.when(dof > 0, dof).otherwise(0))).otherwise(F.when(c("slope") == 0, 1.0).otherwise(0.0)))
    g = g.withColumns({"margin": margin, "p": p})
    out = F.ceil(F.bround((cfg.alert - c("intercept")) / c("slope") - c("last"), 6))
    breach = F.when((c("slope") > 0) & (c("current") < cfg.alert), F.when((out > 0) & (out <= cfg.horizon), out))
    return g.select(
        *KEYS, c("n").alias("periods_used"), c("last_period").alias("last_appeared_period"), F.bround("current", 4).alias("current_root_cause_score"), F.bround("predicted", 4).alias("predicted_next_root_cause_score"), F.when(c("margin").isNotNull(), F.bround(clip(c("predicted") - c("margin")), 4)).alias("predicted_next_lower95"), F.when(c("margin").isNotNull(), F.bround(clip(c("predicted") + c("margin")), 4)).alias("predicted_next_upper95"),
        F.bround("slope", 5).alias("trend_slope"), F.when(dof > 0, F.bround("r2", 4)).alias("r_squared"), F.bround("p", 4).alias("trend_p_value"), breach.cast("int").alias("months_to_breach"), F.when(c("n") == 2, "Low (2 points)").otherwise("Medium (3+ points)").alias("confidence"), breach.isNotNull().alias("early_warning"),
    )
