"""Data quality and data drift queries over the scored population."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from popshift.operators import drift, quality
from popshift.plans.registry import query, rounded, rounded_sql
from popshift.sources.population import CATEGORICAL, LOW_CARD, NUMERIC, POP_SQL, population
from popshift.sources.tables import table

NUM = [*NUMERIC, *LOW_CARD, "s", "w", "y"]
TEXT = [*CATEGORICAL, "period"]
FEATURES = [*NUMERIC, *LOW_CARD]


def long_sql(columns: list[str], cast: str) -> str:
    return " UNION ALL ".join(f"SELECT side, '{c}' AS name, CAST({c} AS {cast}) AS v FROM pop" for c in columns)


PROFILE_SQL = f"""numlong AS ({long_sql(NUM, "DOUBLE")}), txtlong AS ({long_sql(TEXT, "VARCHAR")}),
num AS (SELECT side, name, 1 AS type, count(DISTINCT v) AS cardinality_count, count(*) - count(v) AS missing_count, 100.0::DOUBLE * count(v) / count(*) AS completeness_pct,
 100.0::DOUBLE * count(DISTINCT v) / greatest(count(v), 1) AS uniqueness_pct, avg(v) AS mean, stddev_samp(v) AS std, min(v) AS min, max(v) AS max, skewness(v) AS skewness, kurtosis(v) AS kurtosis,
 quantile_cont(v, 0.25::DOUBLE) AS q25, quantile_cont(v, 0.5::DOUBLE) AS q50, quantile_cont(v, 0.75::DOUBLE) AS q75 FROM numlong GROUP BY ALL),
outl AS (SELECT l.side, l.name, count(*) FILTER (WHERE v < q25 - 1.5 * (q75 - q25) OR v > q75 + 1.5 * (q75 - q25)) AS n_outliers FROM numlong l JOIN num USING (side, name) GROUP BY ALL),
txt AS (SELECT side, name, 2 AS type, count(DISTINCT v) AS cardinality_count, count(*) - count(v) AS missing_count, 100.0::DOUBLE * count(v) / count(*) AS completeness_pct, 100.0::DOUBLE * count(DISTINCT v) / greatest(count(v), 1) AS uniqueness_pct FROM txtlong GROUP BY ALL),
prof AS (SELECT num.*, n_outliers FROM num JOIN outl USING (side, name) UNION ALL BY NAME SELECT *, CAST(0 AS BIGINT) AS n_outliers FROM txt)"""
PROFILE_COLUMNS = dict(side="", name="", type="", cardinality_count="", missing_count="", completeness_pct="d", uniqueness_pct="d", mean="d", std="d", min="d", max="d", skewness="d", kurtosis="d", q25="d", q50="d", q75="d", n_outliers="")


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.profile(population(spark, sf_dir), NUM, TEXT)


@query("column_profile", f"WITH {POP_SQL}, {PROFILE_SQL} " + rounded_sql("SELECT * FROM prof", PROFILE_COLUMNS))
def column_profile(spark, sf_dir):
    return rounded(_profile(spark, sf_dir).select(*PROFILE_COLUMNS))


BLOCKERS_SQL = "blk AS (SELECT side, name, 'high_missing' AS rule, completeness_pct, cardinality_count FROM prof WHERE completeness_pct < 97 UNION ALL SELECT side, name, 'zero_variance', completeness_pct, cardinality_count FROM prof WHERE cardinality_count <= 1)"


@query("dq_blockers", f"WITH {POP_SQL}, {PROFILE_SQL}, {BLOCKERS_SQL} SELECT side, name, rule, round(completeness_pct, 6) AS completeness_pct, cardinality_count FROM blk")
def dq_blockers(spark, sf_dir):
    return rounded(quality.blockers(_profile(spark, sf_dir), 97.0).select("side", "name", "rule", "completeness_pct", "cardinality_count"))


GOVERNANCE_SQL = """gov AS (SELECT side, name, 'IDENTIFIER' AS risk_type FROM prof WHERE uniqueness_pct >= 99.9 OR upper(name) IN ('PERIOD')
 UNION ALL SELECT side, name, 'LEAKAGE' FROM prof WHERE type = 1 AND min >= 0 AND max <= 1 AND cardinality_count >= 50 AND upper(name) <> 'Y' UNION ALL SELECT side, name, 'PRIVACY' FROM prof WHERE upper(name) IN ('N_NAME'))"""


def _governance(prof: DataFrame) -> DataFrame:
    return quality.governance(prof, ["period"], ["n_name"], "y")


@query("dq_governance", f"WITH {POP_SQL}, {PROFILE_SQL}, {GOVERNANCE_SQL} SELECT * FROM gov")
def dq_governance(spark, sf_dir):
    return _governance(_profile(spark, sf_dir)).select("side", "name", "risk_type")


HEALTH_SQL = """hs AS (SELECT side, name, completeness_pct / 100.0::DOUBLE AS c, CASE WHEN cardinality_count > 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS v,
 CASE WHEN (side, name) IN (SELECT (side, name) FROM gov) THEN 0.4 ELSE 1.0 END::DOUBLE AS g, CASE WHEN type <> 1 OR abs(coalesce(skewness, 0)) < 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS d, (side, name) IN (SELECT (side, name) FROM blk) AS b FROM prof),
health AS (SELECT side, name, round(c, 6) AS completeness_score, v AS variance_score, g AS governance_score, d AS distribution_score, CASE WHEN b THEN 0.0 ELSE round_even(100 * (0.35::DOUBLE * c + 0.25::DOUBLE * v + 0.25::DOUBLE * g + 0.15::DOUBLE * d), 1) END::DOUBLE AS health_score,
 CASE WHEN b THEN 'drop' WHEN g < 1 THEN 'caution' ELSE 'ready' END AS status FROM hs)"""


def _health(spark, sf_dir):
    prof = _profile(spark, sf_dir)
    return quality.health(prof, quality.blockers(prof, 97.0), _governance(prof))


@query("dq_health", f"WITH {POP_SQL}, {PROFILE_SQL}, {BLOCKERS_SQL}, {GOVERNANCE_SQL}, {HEALTH_SQL} SELECT * FROM health")
def dq_health(spark, sf_dir):
    return rounded(_health(spark, sf_dir))


@query("dq_readiness", f"WITH {POP_SQL}, {PROFILE_SQL}, {BLOCKERS_SQL}, {GOVERNANCE_SQL}, {HEALTH_SQL} SELECT side, round_even(avg(health_score), 1) AS readiness_score FROM health GROUP BY side")
def dq_readiness(spark, sf_dir):
    return quality.readiness(_health(spark, sf_dir))


def _columns_sql(name: str) -> str:
    return f"SELECT upper(column_name) AS key, column_name AS name, CASE WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'SMALLINT', 'FLOAT') THEN 'numeric' ELSE 'char' END AS type FROM information_schema.columns WHERE table_name = '{name}'"


@query(
    "drift_schema",
    f"""WITH d AS (SELECT replace(key, 'S_', '') AS key, replace(name, 's_', '') AS name, type FROM ({_columns_sql("supplier")})), m AS (SELECT replace(key, 'C_', '') AS key, replace(name, 'c_', '') AS name, type FROM ({_columns_sql("customer")}))
SELECT coalesce(d.name, m.name) AS name, CASE WHEN d.name IS NULL THEN 'added' WHEN m.name IS NULL THEN 'dropped' WHEN d.type <> m.type THEN 'type_changed' ELSE 'unchanged' END AS change_type, d.type AS dev_type, m.type AS mon_type FROM d FULL JOIN m USING (key)""",
)
def drift_schema(spark, sf_dir):
    bare = lambda t, p: table(spark, sf_dir, t).withColumnsRenamed({c: c.replace(p, "") for c in table(spark, sf_dir, t).columns}).schema
    return drift.schema_drift(spark, bare("supplier", "s_"), bare("customer", "c_"))


@query(
    "drift_completeness",
    f"""WITH {POP_SQL}, l AS ({long_sql([*FEATURES, *CATEGORICAL], "VARCHAR")}), c AS (SELECT name, 100.0::DOUBLE * count(v) FILTER (WHERE side = 0) / count(*) FILTER (WHERE side = 0) AS d, 100.0::DOUBLE * count(v) FILTER (WHERE side = 1) / count(*) FILTER (WHERE side = 1) AS m FROM l GROUP BY name)
SELECT name, round(d, 6) AS dev_completeness_pct, round(m, 6) AS mon_completeness_pct, round(m - d, 6) AS delta_pp, CASE WHEN m - d <= -5 THEN 'growing_missing' WHEN m - d >= 5 THEN 'recovering' ELSE 'stable_missing' END AS pattern FROM c""",
)
def drift_completeness(spark, sf_dir):
    return rounded(drift.completeness(population(spark, sf_dir), [*FEATURES, *CATEGORICAL]))


def _csi_sql(columns: list[str]) -> str:
    points = "[" + ", ".join(f"{i / 10}::DOUBLE" for i in range(1, 10)) + "]"
    return f"""l AS (SELECT * FROM ({long_sql(columns, "DOUBLE")}) WHERE v IS NOT NULL), cuts AS (SELECT name, quantile_cont(v, {points}) AS cuts FROM l WHERE side = 0 GROUP BY name),
b AS (SELECT name, side, len(list_filter(cuts, lambda e: e < v)) AS bucket FROM l JOIN cuts USING (name)),
n AS (SELECT name, bucket, count(*) FILTER (WHERE side = 0) AS n0, count(*) FILTER (WHERE side = 1) AS n1 FROM b GROUP BY ALL),
p AS (SELECT name, n0 / sum(n0) OVER (PARTITION BY name) AS p0, n1 / sum(n1) OVER (PARTITION BY name) AS p1 FROM n),
q AS (SELECT name, CASE WHEN p0 > 0 THEN p0 ELSE 1e-6 END AS p0, CASE WHEN p1 > 0 THEN p1 ELSE 1e-6 END AS p1 FROM p),
r AS (SELECT name AS feature, round(sum((p1 - p0) * ln(p1 / p0)), 4) AS csi FROM q GROUP BY name)"""


LABEL = "CASE WHEN {0} < 0.1 THEN 'stable' WHEN {0} < {1} THEN 'monitor' ELSE 'shift' END AS label"


@query("drift_csi", f"WITH {POP_SQL}, {_csi_sql(FEATURES)} SELECT feature, csi, {LABEL.format('csi', 0.25)} FROM r")
def drift_csi(spark, sf_dir):
    return drift.csi(population(spark, sf_dir), FEATURES)


@query("drift_score_psi", f"WITH {POP_SQL}, {_csi_sql(['s'])} SELECT feature AS score_column, csi AS psi, {LABEL.format('csi', 0.25)} FROM r")
def drift_score_psi(spark, sf_dir):
    return drift.csi(population(spark, sf_dir), ["s"]).select(F.col("feature").alias("score_column"), F.col("csi").alias("psi"), "label")


_SHARES = f"""l AS (SELECT * FROM ({long_sql(CATEGORICAL, "VARCHAR")}) WHERE v IS NOT NULL), n AS (SELECT name, v, count(*) FILTER (WHERE side = 0) AS n0, count(*) FILTER (WHERE side = 1) AS n1 FROM l GROUP BY ALL),
p AS (SELECT name, n0 / sum(n0) OVER (PARTITION BY name) AS p0, n1 / sum(n1) OVER (PARTITION BY name) AS p1 FROM n)"""


@query("drift_categorical_psi", f"WITH {POP_SQL}, {_SHARES}, f AS (SELECT name, greatest(p0, 1e-6) AS p0, greatest(p1, 1e-6) AS p1 FROM p), r AS (SELECT name AS feature, round(sum((p1 - p0) * ln(p1 / p0)), 4) AS psi FROM f GROUP BY name) SELECT feature, psi, {LABEL.format('psi', 0.25)} FROM r")
def drift_categorical_psi(spark, sf_dir):
    return drift.categorical_psi(population(spark, sf_dir), CATEGORICAL)


@query("drift_entropy", f"WITH {POP_SQL}, {_SHARES}, h AS (SELECT name AS feature, coalesce(-sum(p0 * log2(p0)) FILTER (WHERE p0 > 0), 0) AS h0, coalesce(-sum(p1 * log2(p1)) FILTER (WHERE p1 > 0), 0) AS h1 FROM p GROUP BY name) SELECT feature, round(h0, 4) AS dev_entropy, round(h1, 4) AS mon_entropy, round(h1 - h0, 4) AS entropy_delta FROM h")
def drift_entropy(spark, sf_dir):
    return drift.entropy(population(spark, sf_dir), CATEGORICAL)


_AT = "CASE WHEN j = 0 THEN 0.0 WHEN j = 5 THEN 1.0 ELSE 0.25 * (j - 1) + 0.25 * (x - m[j]) / (m[j + 1] - m[j]) END"


@query(
    "drift_ks",
    f"""WITH {POP_SQL}, l AS (SELECT * FROM ({long_sql([*FEATURES, 's'], "DOUBLE")}) WHERE v IS NOT NULL),
q AS (SELECT name, quantile_cont(v, [0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]) FILTER (WHERE side = 0) AS d, quantile_cont(v, [0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0]) FILTER (WHERE side = 1) AS m FROM l GROUP BY name),
x AS (SELECT name, m, unnest(d) AS x, unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS p FROM q), j AS (SELECT *, len(list_filter(m, lambda e: e <= x)) AS j FROM x),
k AS (SELECT name, max(abs({_AT} - p)) AS ks FROM j GROUP BY name) SELECT name AS feature, round(ks, 4) AS ks_statistic, {LABEL.format('ks', 0.2)} FROM k""",
)
def drift_ks(spark, sf_dir):
    return drift.five_point_ks(population(spark, sf_dir), [*FEATURES, "s"])


_TARGET_SQL = "r AS (SELECT 100 * avg(y) FILTER (WHERE side = 0) AS r0, 100 * avg(y) FILTER (WHERE side = 1) AS r1 FROM pop), t AS (SELECT 'y' AS target, round(r0, 2) AS dev_event_rate_pct, round(r1, 2) AS mon_event_rate_pct, round(r1 - r0, 2) AS delta_pp, CASE WHEN abs(r1 - r0) < 3 THEN 'stable' WHEN abs(r1 - r0) < 8 THEN 'notable' ELSE 'critical' END AS label FROM r)"


@query("drift_target", f"WITH {POP_SQL}, {_TARGET_SQL} SELECT * FROM t")
def drift_target(spark, sf_dir):
    return drift.target_drift(population(spark, sf_dir), "y")


def _distribution_sql() -> str:
    cv = "CASE WHEN {0}.mean <> 0 THEN round({0}.std / {0}.mean, 4) END"
    cols = [f"round({s}.{c}, 4) AS {n}_{c}" for c in ("mean", "std", "skewness") for s, n in (("d", "dev"), ("m", "mon"))] + [f"{s}.{c} AS {n}_{c}" for c in ("min", "max") for s, n in (("d", "dev"), ("m", "mon"))]
    return f"""SELECT d.name, {", ".join(cols)}, round((m.cardinality_count - d.cardinality_count) / d.cardinality_count, 3) AS cardinality_pct_change, CASE WHEN d.std > 0 THEN round((m.std - d.std) / d.std, 3) END AS std_drift_pct,
 {cv.format("d")} AS dev_cv, {cv.format("m")} AS mon_cv, CASE WHEN {cv.format("d")} <> 0 THEN round(({cv.format("m")} - {cv.format("d")}) / {cv.format("d")}, 3) END AS cv_drift_pct,
 round(m.kurtosis - d.kurtosis, 4) AS kurtosis_delta, CASE WHEN d.q75 - d.q25 > 0 THEN round((m.q50 - d.q50) / (d.q75 - d.q25), 4) END AS median_shift_iqr
 FROM prof d JOIN prof m ON upper(d.name) = upper(m.name) AND d.side = 0 AND m.side = 1 AND d.type = 1 WHERE d.name IN ({", ".join(f"'{c}'" for c in FEATURES)})"""


@query("drift_distribution", f"WITH {POP_SQL}, {PROFILE_SQL} {_distribution_sql()}")
def drift_distribution(spark, sf_dir):
    return drift.distribution(population(spark, sf_dir), FEATURES)


@query(
    "drift_overall",
    f"""WITH {POP_SQL}, {_TARGET_SQL}, a AS (WITH {_csi_sql(FEATURES)} SELECT {LABEL.format('csi', 0.25)} FROM r), b AS (SELECT label FROM t),
c AS (WITH {_SHARES}, f AS (SELECT name, greatest(p0, 1e-6) AS p0, greatest(p1, 1e-6) AS p1 FROM p), r AS (SELECT round(sum((p1 - p0) * ln(p1 / p0)), 4) AS psi FROM f GROUP BY name) SELECT {LABEL.format('psi', 0.25)} FROM r),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
SELECT CASE max(CASE WHEN label IN ('shift', 'critical') THEN 2 WHEN label IN ('monitor', 'notable') THEN 1 ELSE 0 END) WHEN 2 THEN 'Shift' WHEN 1 THEN 'Monitor' ELSE 'Stable' END AS overall_status,
 count(*) FILTER (WHERE label IN ('shift', 'critical')) AS n_shift, count(*) FILTER (WHERE label IN ('monitor', 'notable')) AS n_monitor FROM u""",
)
def drift_overall(spark, sf_dir):
    pop = population(spark, sf_dir)
    labels = drift.csi(pop, FEATURES).select("label").unionByName(drift.target_drift(pop, "y").select("label")).unionByName(drift.categorical_psi(pop, CATEGORICAL).select("label"))
    return drift.overall_status(labels)


@query("missing_view", f"WITH {POP_SQL}, {PROFILE_SQL} SELECT side, name, round_even(100 - completeness_pct, 2) AS missing_pct FROM prof")
def missing_view(spark, sf_dir):
    return _profile(spark, sf_dir).select("side", "name", F.bround(100 - F.col("completeness_pct"), 2).alias("missing_pct"))


_ROLE_COLUMNS = ["y", "s", "w", *FEATURES, *CATEGORICAL, "period", "shap_quantity", "shap_discount", "shap_segment"]


@query(
    "column_roles",
    f"""WITH {POP_SQL}, d AS (SELECT * FROM pop WHERE side = 0), st AS ({" UNION ALL ".join(f"SELECT '{c}' AS name, count(*) AS n, count({c}) AS n_valid, count(DISTINCT {c}) AS card FROM d" for c in _ROLE_COLUMNS)})
SELECT name, n_valid, card, CASE WHEN name = 'y' THEN 'target' WHEN name = 's' THEN 'score' WHEN name = 'w' THEN 'weight' WHEN name = 'period' THEN 'time' WHEN name LIKE 'shap%' THEN 'shap' WHEN name IN ({", ".join(f"'{c}'" for c in CATEGORICAL)}) OR card <= 20 THEN 'categorical' ELSE 'numeric' END AS role FROM st""",
)
def column_roles(spark, sf_dir):
    from popshift.operators import roles

    dev = population(spark, sf_dir).where("side = 0").select(*_ROLE_COLUMNS)
    found = spark.createDataFrame([(k, v[0]) for k, v in roles.detect(dev).items()], "name string, role string")
    return roles.column_stats(dev).join(F.broadcast(found), "name").select("name", "n_valid", "card", "role")
