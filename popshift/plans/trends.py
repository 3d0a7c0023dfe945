"""Queries over monitoring periods: appearances, trend scores, forecast, KPIs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from popshift.functions.buckets import psi_floored
from popshift.operators import report, trend
from popshift.operators.scoring import blend
from popshift.plans.registry import query, rounded
from popshift.plans.segments import _mm_sql
from popshift.sources.population import POP_SQL, population

FEATURES = {"segment": "c_mktsegment", "priority": "o_orderpriority"}
CFG = trend.TrendConfig(n_worst=3)
c = F.col


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of categorical segments in each monitoring period against the whole baseline: one scan, grouped twice."""
    pop = population(spark, sf_dir)
    rows = pop.select("side", "period", "y", "shap_quantity", F.explode(F.array(*[F.struct(F.lit(t).alias("technique"), F.concat(F.lit(f"{f} = "), c(f)).alias("segment_definition")) for t, f in FEATURES.items()])).alias("g")).select("side", "period", "y", "shap_quantity", "g.*")
    keys = ["technique", "segment_definition"]
    g = rows.groupBy("side", *keys, F.when(c("side") == 1, c("period")).alias("period")).agg(F.count("*").alias("n"), F.avg("y").alias("br"), F.avg("shap_quantity").alias("sh"))
    totals = F.sum("n").over(trend.Window.partitionBy("side", "technique", "period"))
    g = g.withColumn("pct", c("n") / totals)
    d = g.where("side = 0").select(*keys, c("pct").alias("pct0"), c("br").alias("br0"), c("sh").alias("sh0"))
    m = g.where("side = 1").join(F.broadcast(d), keys)
    gap = F.abs(c("br") - c("br0"))
    m = m.select("period", *keys, (gap * c("pct")).alias("sis_raw"), (F.greatest(F.lit(0.0), c("pct") - c("pct0")) * gap).alias("dis_raw"), psi_floored(c("pct0"), c("pct")).alias("mean_feature_psi"), F.abs(c("sh") - c("sh0")).alias("mean_shap_shift"))
    m = m.withColumn("by", F.concat_ws("/", "technique", "period")).withColumn("root_cause_score", F.round(blend("sis_raw", "dis_raw", "mean_feature_psi", "mean_shap_shift", "by"), 6))
    return trend.period_index(m.drop("by")).withColumns({"severity_score": F.round(20 * c("root_cause_score"), 4), "cand_id": c("segment_definition")})


_ROWS = " UNION ALL ".join(f"SELECT side, CASE WHEN side = 1 THEN period END AS period, y, shap_quantity, '{t}' AS technique, '{f} = ' || {f} AS segment_definition FROM pop" for t, f in FEATURES.items())
_BY = "PARTITION BY technique, period"
HISTORY_SQL = f"""WITH {POP_SQL}, hr AS ({_ROWS}), hg AS (SELECT side, technique, segment_definition, period, count(*) AS n, avg(y) AS br, avg(shap_quantity) AS sh FROM hr GROUP BY ALL), hp AS (SELECT *, n / sum(n) OVER (PARTITION BY side, technique, period) AS pct FROM hg),
hm AS (SELECT m.period, m.technique, m.segment_definition, abs(m.br - d.br) * m.pct AS sis_raw, greatest(0.0, m.pct - d.pct) * abs(m.br - d.br) AS dis_raw, (greatest(m.pct, 1e-6) - greatest(d.pct, 1e-6)) * ln(greatest(m.pct, 1e-6) / greatest(d.pct, 1e-6)) AS mean_feature_psi, abs(m.sh - d.sh) AS mean_shap_shift FROM hp m JOIN hp d ON m.side = 1 AND d.side = 0 AND m.technique = d.technique AND m.segment_definition = d.segment_definition),
hs AS (SELECT *, round(0.35 * ({_mm_sql("sis_raw", _BY)}) + 0.30 * ({_mm_sql("dis_raw", _BY)}) + 0.20 * ({_mm_sql("mean_feature_psi", _BY)}) + 0.15 * ({_mm_sql("mean_shap_shift", _BY)}), 6) AS root_cause_score, dense_rank() OVER (ORDER BY period) - 1 AS period_index FROM hm),
hist AS (SELECT *, round(20 * root_cause_score, 4) AS severity_score FROM hs), tp AS (SELECT count(DISTINCT period) AS np FROM hist),
app AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period, technique ORDER BY severity_score DESC, segment_definition) AS rn FROM hist) WHERE rn <= 3)"""


def _appeared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    h = history(spark, sf_dir)
    return h, trend.appearances(h, CFG.n_worst)


@query("trend_appearances", HISTORY_SQL + " SELECT technique, segment_definition, period, period_index, severity_score FROM app")
def trend_appearances(spark, sf_dir):
    return _appeared(spark, sf_dir)[1].select("technique", "segment_definition", "period", F.col("period_index").cast("long").alias("period_index"), "severity_score")


@query("trend_recurrence", HISTORY_SQL + ", w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY period ORDER BY severity_score DESC, segment_definition) AS rw FROM hist) WHERE rw <= 3) SELECT technique, segment_definition, count(DISTINCT period) AS periods_appeared, round(avg(severity_score), 6) AS avg_severity_score, (SELECT count(DISTINCT period) FROM w) AS total_periods, round_even(100 * count(DISTINCT period) / (SELECT count(DISTINCT period) FROM w), 1) AS recurrence_pct FROM w GROUP BY ALL")
def trend_recurrence(spark, sf_dir):
    return rounded(trend.recurrence(history(spark, sf_dir), CFG.n_worst))


TREND_SQL = f"""ap AS (SELECT DISTINCT technique, segment_definition, period_index, period FROM app), isl AS (SELECT *, period_index - row_number() OVER (PARTITION BY technique, segment_definition ORDER BY period_index) AS island FROM ap), lon AS (SELECT technique, segment_definition, max(k) AS longest FROM (SELECT technique, segment_definition, island, count(*) AS k FROM isl GROUP BY ALL) GROUP BY ALL),
tg AS (SELECT technique, segment_definition, count(DISTINCT period_index) AS pa, max(period_index) AS last, string_agg(period, ', ' ORDER BY period_index) AS appeared_in, arg_max(sis_raw, period_index) AS sis_raw, arg_max(dis_raw, period_index) AS dis_raw, arg_max(mean_feature_psi, period_index) AS mean_feature_psi, arg_max(mean_shap_shift, period_index) AS mean_shap_shift FROM app GROUP BY ALL),
tf AS (SELECT *, pa / np AS fr, pow(0.5::DOUBLE, (np - 1 - last) / 2.0) AS re, longest / np AS co FROM tg JOIN lon USING (technique, segment_definition), tp), tt AS (SELECT *, 0.4 * fr + 0.3 * re + 0.3 * co AS tis FROM tf),
tb AS (SELECT *, 0.35 * ({_mm_sql("sis_raw")}) + 0.30 * ({_mm_sql("dis_raw")}) + 0.20 * ({_mm_sql("mean_feature_psi")}) + 0.15 * ({_mm_sql("mean_shap_shift")}) AS base FROM tt),
ts AS (SELECT technique, segment_definition, pa AS periods_appeared, np AS total_periods, appeared_in, round_even(fr, 4) AS frequency, round_even(re, 4) AS recency_factor, round_even(co, 4) AS consistency_score, round_even(tis, 4) AS trend_impact_score, sis_raw, dis_raw, mean_feature_psi, mean_shap_shift, sis_raw * (1 + 0.5 * tis) AS sis_trend, least(1.0, base * (1 + 0.5 * round_even(tis, 4))) AS root_cause_score_trend FROM tb)"""


def _summary(h: DataFrame, appeared: DataFrame) -> DataFrame:
    n = h.agg(F.count_distinct("period")).first()[0]
    return trend.trend(appeared, n, CFG)


@query("trend_summary", HISTORY_SQL + ", " + TREND_SQL + " SELECT technique, segment_definition, periods_appeared, total_periods, appeared_in, frequency, recency_factor, consistency_score, trend_impact_score, round(sis_raw, 6) AS sis_raw, round(dis_raw, 6) AS dis_raw, round(mean_feature_psi, 6) AS mean_feature_psi, round(mean_shap_shift, 6) AS mean_shap_shift, round(sis_trend, 6) AS sis_trend, round(root_cause_score_trend, 6) AS root_cause_score_trend, round(20 * root_cause_score_trend, 6) AS severity_score_trend FROM ts")
def trend_summary(spark, sf_dir):
    return rounded(_summary(*_appeared(spark, sf_dir)))


@query("trend_series", HISTORY_SQL + " SELECT g.technique, g.segment_definition, p.period, p.period_index, a.root_cause_score, round(a.sis_raw, 6) AS sis_raw FROM (SELECT DISTINCT technique, segment_definition FROM app) g CROSS JOIN (SELECT DISTINCT period, period_index FROM hist) p LEFT JOIN app a ON a.technique = g.technique AND a.segment_definition = g.segment_definition AND a.period = p.period")
def trend_series(spark, sf_dir):
    h, a = _appeared(spark, sf_dir)
    out = trend.with_gaps(trend.time_series(a, ["root_cause_score", "sis_raw"]), h)
    return rounded(out.withColumn("period_index", c("period_index").cast("long")).select("technique", "segment_definition", "period", "period_index", "root_cause_score", "sis_raw"))


def forecast_sql(alert: float, horizon: int) -> str:
    return FORECAST_SQL.replace("0.5 - ic", f"{alert} - ic").replace("cur < 0.5", f"cur < {alert}").replace("mo <= 6", f"mo <= {horizon}")


FORECAST_SQL = """fg AS (SELECT technique, segment_definition, count(*) AS n, regr_slope(root_cause_score, period_index) AS sl, regr_intercept(root_cause_score, period_index) AS ic, regr_r2(root_cause_score, period_index) AS r2, max(period_index) AS last, arg_max(root_cause_score, period_index) AS cur, arg_max(period, period_index) AS lp FROM app GROUP BY ALL HAVING count(*) >= 2),
fb AS (SELECT *, ceil(round_even((0.5 - ic) / nullif(sl, 0) - last, 6)) AS mo FROM fg),
fo AS (SELECT technique, segment_definition, n AS periods_used, lp AS last_appeared_period, round_even(cur, 4) AS current_root_cause_score, round_even(least(1.0, greatest(0.0, sl * (last + 1) + ic)), 4) AS predicted_next_root_cause_score, round_even(sl, 5) AS trend_slope, CASE WHEN n > 2 THEN round_even(r2, 4) END AS r_squared, CASE WHEN sl > 0 AND cur < 0.5 AND mo > 0 AND mo <= 6 THEN CAST(mo AS INTEGER) END AS months_to_breach, CASE WHEN n = 2 THEN 'Low (2 points)' ELSE 'Medium (3+ points)' END AS confidence FROM fb)"""


@query("trend_forecast", HISTORY_SQL + ", " + FORECAST_SQL + " SELECT *, months_to_breach IS NOT NULL AS early_warning FROM fo")
def trend_forecast(spark, sf_dir):
    return trend.forecast(_appeared(spark, sf_dir)[1], CFG).drop("predicted_next_lower95", "predicted_next_upper95", "trend_p_value")


@query("trend_forecast_intervals")
def trend_forecast_intervals(spark, sf_dir):
    """With p-values and 95 % prediction intervals, whose t quantiles SQL doesn't have."""
    return trend.forecast(_appeared(spark, sf_dir)[1], CFG)


@query("early_warnings", HISTORY_SQL + ", " + FORECAST_SQL + " SELECT technique, segment_definition, months_to_breach, predicted_next_root_cause_score FROM fo WHERE months_to_breach IS NOT NULL ORDER BY months_to_breach, predicted_next_root_cause_score DESC, technique, segment_definition LIMIT 10")
def early_warnings(spark, sf_dir):
    return report.early_warnings(trend.forecast(_appeared(spark, sf_dir)[1], CFG)).select("technique", "segment_definition", "months_to_breach", "predicted_next_root_cause_score")


#: The highest score as the alert and a horizon without end: every segment whose score rises is a warning.
SENSITIVE = replace(CFG, alert=1.0, horizon=1200)


@query("early_warnings_sensitive", HISTORY_SQL + ", " + forecast_sql(SENSITIVE.alert, SENSITIVE.horizon) + " SELECT technique, segment_definition, months_to_breach, predicted_next_root_cause_score FROM fo WHERE months_to_breach IS NOT NULL ORDER BY months_to_breach, predicted_next_root_cause_score DESC, technique, segment_definition LIMIT 10")
def early_warnings_sensitive(spark, sf_dir):
    return report.early_warnings(trend.forecast(_appeared(spark, sf_dir)[1], SENSITIVE)).select("technique", "segment_definition", "months_to_breach", "predicted_next_root_cause_score")


@query("trend_kpis", HISTORY_SQL + ", " + TREND_SQL + ", " + FORECAST_SQL + " SELECT 'rca_max_trend_impact' AS kpi_id, CAST(coalesce(max(trend_impact_score), 0) AS DOUBLE) AS kpi_value FROM ts UNION ALL SELECT 'rca_n_early_warning', CAST(count(months_to_breach) AS DOUBLE) FROM fo UNION ALL SELECT 'rca_max_trend_slope', greatest(0.0, coalesce(max(trend_slope), 0)) FROM fo UNION ALL SELECT 'rca_min_months_to_breach', CAST(coalesce(min(months_to_breach), 6) AS DOUBLE) FROM fo")
def trend_kpis(spark, sf_dir):
    h, a = _appeared(spark, sf_dir)
    return rounded(report.trend_kpis(_summary(h, a), trend.forecast(a, CFG)))
