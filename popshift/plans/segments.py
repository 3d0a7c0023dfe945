"""Segment queries: candidates, their measures, scores and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from popshift.functions.special import NORMAL_SQL, ks_survival_sql
from popshift.operators import evaluate as ev, rules as rl, scoring
from popshift.plans.registry import query, rounded, rounded_sql
from popshift.sources.population import CATEGORICAL, LOW_CARD, NUMERIC, POP_SQL, SHAP, population

ROLES = ev.Roles(numeric=tuple(NUMERIC), categorical=(*CATEGORICAL, *LOW_CARD), shap=tuple(SHAP))
PLAIN = ev.Roles()


def technique_rules(pop: DataFrame, bins: int = 4) -> list[rl.Rule]:
    """Two simple techniques: levels of categories, quantile intervals of numbers."""
    preds = rl.atomic_predicates(pop.where("side = 0"), NUMERIC, CATEGORICAL, bins)
    out: list[rl.Rule] = []
    for f, ps in preds.items():
        for i, p in enumerate(ps):
            out.append(rl.Rule("categorical" if p.kind == "C" else "numeric", len(out), (p,), p.label() if p.kind == "C" else f"{f} bin {i}"))
    return out


_CAT = " UNION ALL ".join(f"SELECT 'categorical' AS technique, '{f} = ' || {f} AS seg, * FROM pop WHERE {f} IS NOT NULL AND (SELECT count(DISTINCT {f}) FROM pop WHERE side = 0) BETWEEN 2 AND 20 AND {f} IN (SELECT {f} FROM pop WHERE side = 0)" for f in CATEGORICAL)
_BINS = " UNION ALL ".join(f"SELECT 'numeric' AS technique, '{f} bin ' || len(list_filter((SELECT list_sort(list_distinct(quantile_cont({f}, [0.0::DOUBLE, 0.25, 0.5, 0.75, 1.0])))[2:-2] FROM pop WHERE side = 0), lambda e: e <= {f})) AS seg, * FROM pop WHERE {f} IS NOT NULL" for f in NUMERIC)
MEMBERS_SQL = f"mem AS MATERIALIZED ({_CAT} UNION ALL {_BINS})"

#: Evaluated candidates as `ev`: the same steps as in operators/evaluate.py, from `mem` (technique, seg, side, y, s, w, ...).
_NUM_LONG = " UNION ALL ".join(f"SELECT technique, seg, side, '{k}' AS kind, '{f}' AS name, {f}::DOUBLE AS v, NULL AS t FROM mem WHERE {f} IS NOT NULL" for k, fs in (("N", NUMERIC), ("A", SHAP)) for f in fs)
_TXT_LONG = " UNION ALL ".join(f"SELECT technique, seg, side, 'T' AS kind, '{f}' AS name, NULL AS v, {f}::VARCHAR AS t FROM mem WHERE {f} IS NOT NULL" for f in (*CATEGORICAL, *LOW_CARD))
EVALUATE_SQL = f"""tot AS (SELECT count(*) FILTER (WHERE side = 0) AS nn0, count(*) FILTER (WHERE side = 1) AS nn1, sum(w) FILTER (WHERE side = 0) AS ww0, sum(w) FILTER (WHERE side = 1) AS ww1, avg(y) FILTER (WHERE side = 0) AS rate0 FROM pop),
hist AS (SELECT technique, seg, s, sum(y) FILTER (WHERE side = 0) AS b0, sum(1 - y) FILTER (WHERE side = 0) AS g0, sum(y) FILTER (WHERE side = 1) AS b1, sum(1 - y) FILTER (WHERE side = 1) AS g1, sum(w) FILTER (WHERE side = 0) AS w0, sum(w) FILTER (WHERE side = 1) AS w1 FROM mem GROUP BY ALL),
hist0 AS (SELECT technique, seg, s, coalesce(b0, 0) AS b0, coalesce(g0, 0) AS g0, coalesce(b1, 0) AS b1, coalesce(g1, 0) AS g1, coalesce(w0, 0) AS w0, coalesce(w1, 0) AS w1 FROM hist),
cum AS (SELECT *, sum(b0) OVER u AS cb0, sum(g0) OVER u AS cg0, sum(b1) OVER u AS cb1, sum(g1) OVER u AS cg1, sum(b0) OVER e AS tb0, sum(g0) OVER e AS tg0, sum(b1) OVER e AS tb1, sum(g1) OVER e AS tg1 FROM hist0 WINDOW u AS (PARTITION BY technique, seg ORDER BY s), e AS (PARTITION BY technique, seg)),
perf AS (SELECT technique, seg, CAST(max(tb0 + tg0) AS BIGINT) AS n_dev, CAST(max(tb1 + tg1) AS BIGINT) AS n_mon, CAST(max(tb0) AS BIGINT) AS x_dev, CAST(max(tb1) AS BIGINT) AS x_mon, sum(w0) AS weight_dev, sum(w1) AS weight_mon, sum(s * (b0 + g0)) AS s_dev, sum(s * (b1 + g1)) AS s_mon,
 sum(b0 * (cg0 - g0 / 2)) / nullif(max(tb0) * max(tg0), 0) AS auc_dev, sum(b1 * (cg1 - g1 / 2)) / nullif(max(tb1) * max(tg1), 0) AS auc_mon, max(abs(cb0 / nullif(tb0, 0) - cg0 / nullif(tg0, 0))) AS ks_dev, max(abs(cb1 / nullif(tb1, 0) - cg1 / nullif(tg1, 0))) AS ks_mon,
 max(abs((cb0 + cg0) / (tb0 + tg0) - (cb1 + cg1) / (tb1 + tg1))) AS ks_shift FROM cum WHERE tb0 + tg0 > 0 AND tb1 + tg1 > 0 GROUP BY ALL),
vals AS ({_NUM_LONG} UNION ALL {_TXT_LONG}), cnt AS (SELECT technique, seg, kind, name, v, t, count(*) FILTER (WHERE side = 0) AS n0, count(*) FILTER (WHERE side = 1) AS n1 FROM vals GROUP BY ALL),
edg AS (SELECT technique, seg, kind, name, quantile_cont(v, [0.0::DOUBLE, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM vals GROUP BY ALL),
sta AS (SELECT technique, seg, kind, name, sum(n0) AS t0, sum(n1) AS t1, kind = 'T' OR kind = 'A' AND count(v) <= 20 AS lev, sum(v * n0) AS s0, sum(v * n1) AS s1 FROM cnt GROUP BY technique, seg, kind, name),
edi AS (SELECT technique, seg, kind, name, coalesce(list_sort(list_distinct(q))[2:-2], []) AS e FROM edg),
bkt AS (SELECT technique, seg, kind, name, CASE WHEN lev THEN coalesce(t, v::VARCHAR) ELSE len(list_filter(e, lambda x: x < v))::VARCHAR END AS bucket, sum(n0) AS n0, sum(n1) AS n1, any_value(t0) AS t0, any_value(t1) AS t1, any_value(lev) AS lev, any_value(s0) AS s0, any_value(s1) AS s1, any_value(len(e) + 1) AS k FROM cnt JOIN sta USING (technique, seg, kind, name) JOIN edi USING (technique, seg, kind, name) GROUP BY ALL),
shr AS (SELECT *, (n0 + 1e-6) / (t0 + CASE WHEN lev THEN 1e-6 ELSE 1e-6 * k END) AS p0, (n1 + 1e-6) / (t1 + CASE WHEN lev THEN 1e-6 ELSE 1e-6 * k END) AS p1 FROM bkt),
fdr AS (SELECT technique, seg, kind, name, CASE WHEN any_value(t0) = 0 OR any_value(t1) = 0 THEN 0 ELSE greatest(0, sum((p1 - p0) * ln(p1 / p0))) END AS psi, CASE WHEN kind = 'A' THEN any_value(s1) / nullif(any_value(t1), 0) - any_value(s0) / nullif(any_value(t0), 0) END AS delta FROM shr GROUP BY technique, seg, kind, name HAVING kind = 'A' OR least(any_value(t0), any_value(t1)) >= 5),
top AS (SELECT technique, seg, coalesce(avg(psi) FILTER (WHERE kind <> 'A'), 0) AS mean_feature_psi, coalesce(avg(abs(delta)) FILTER (WHERE kind = 'A'), 0) AS mean_shap_shift, coalesce(max(psi) FILTER (WHERE kind <> 'A'), 0) AS top_drift_psi, coalesce(max(psi) FILTER (WHERE kind = 'A'), 0) AS top_shap_shift_psi,
 (list(name ORDER BY psi DESC, name) FILTER (WHERE kind <> 'A'))[1] AS top_drift_feature, (list(name ORDER BY psi DESC, name) FILTER (WHERE kind = 'A'))[1] AS top_shap_shift_feature FROM fdr GROUP BY ALL),
d1 AS (SELECT *, n_dev / nn0 AS pct_dev, n_mon / nn1 AS pct_mon, x_dev / n_dev AS br_dev, x_mon / n_mon AS br_mon, 2 * auc_dev - 1 AS gini_dev, 2 * auc_mon - 1 AS gini_mon, weight_dev / ww0 AS dev_weight_pct, weight_mon / ww1 AS mon_weight_pct, (x_dev + x_mon) / (n_dev + n_mon) AS pool FROM perf JOIN top USING (technique, seg), tot),
d2 AS (SELECT *, pool * (1 - pool) * (1 / n_dev + 1 / n_mon) AS variance FROM d1), d3 AS (SELECT *, CASE WHEN variance > 0 THEN (br_mon - br_dev) / sqrt(variance) END AS z FROM d2),
ev AS (SELECT technique, seg AS segment_definition, n_dev, n_mon, pct_dev, pct_mon, x_dev, x_mon, (greatest(pct_mon, 1e-6) - greatest(pct_dev, 1e-6)) * ln(greatest(pct_mon, 1e-6) / greatest(pct_dev, 1e-6)) AS psi, br_dev, br_mon, br_mon - br_dev AS delta_br, CASE WHEN z IS NOT NULL THEN {NORMAL_SQL.format(z="z")} END AS br_pvalue,
 auc_dev, auc_mon, auc_mon - auc_dev AS delta_auc, gini_dev, gini_mon, gini_mon - gini_dev AS delta_gini, ks_dev, ks_mon, ks_mon - ks_dev AS delta_ks, {ks_survival_sql("ks_shift", "n_dev", "n_mon")} AS score_shift_pvalue, weight_dev, weight_mon, dev_weight_pct, mon_weight_pct, mon_weight_pct - dev_weight_pct AS exposure_drift,
 x_mon / greatest(s_mon, 1e-6) - x_dev / greatest(s_dev, 1e-6) AS calibration_drift, mean_feature_psi, mean_shap_shift, top_drift_feature, top_drift_psi, top_shap_shift_feature, top_shap_shift_psi FROM d3)"""

KINDS = dict.fromkeys(ev.METRICS, "d") | {k: "" for k in ("n_dev", "n_mon", "x_dev", "x_mon", "top_drift_feature", "top_shap_shift_feature")}
BASE = f"WITH {POP_SQL}, {MEMBERS_SQL}, {EVALUATE_SQL}"


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    pop = population(spark, sf_dir).persist()  # edges, totals and two aggregates read it
    return ev.evaluate(pop, technique_rules(pop), ROLES, ev.Totals.of(pop, ROLES))


@query("segment_evaluation", BASE + rounded_sql("SELECT * FROM ev", {"technique": "", "segment_definition": ""} | KINDS))
def segment_evaluation(spark, sf_dir):
    return rounded(evaluated(spark, sf_dir).drop("cand_id"))


_RANK = ["segment_definition", "n_dev", "n_mon", "psi", "delta_br", "delta_auc", "delta_ks", "mon_weight_pct", "exposure_drift"]


@query("segment_ranking", BASE + f", g AS (SELECT * FROM ev, tot WHERE technique = 'categorical' AND least(n_dev, n_mon) >= greatest(50, ceil(30 / greatest(rate0, 1e-4))) AND least(pct_dev, pct_mon) >= least(0.30, greatest(0.02, greatest(50, ceil(30 / greatest(rate0, 1e-4))) / least(nn0, nn1))) AND greatest(pct_dev, pct_mon) <= 0.35 AND least(x_dev, x_mon) >= 30) SELECT segment_definition, n_dev, n_mon, round(psi, 6) AS psi, round(delta_br, 6) AS delta_br, round(delta_auc, 6) AS delta_auc, round(delta_ks, 6) AS delta_ks, round(mon_weight_pct, 6) AS mon_weight_pct, round(exposure_drift, 6) AS exposure_drift FROM g")
def segment_ranking(spark, sf_dir):
    """Flagship: which categorical segments shifted most, in share, bad rate and discrimination?"""
    pop = population(spark, sf_dir)
    totals = ev.Totals.of(pop, PLAIN)
    gates = totals.gates()
    rules = rl.atomic_rules(rl.atomic_predicates(pop.where("side = 0"), [], CATEGORICAL))
    kept = set(ev.gate_counts(pop, rules, PLAIN, totals, gates))
    out = ev.evaluate(pop, [r for r in rules if r.cand_id in kept], PLAIN, totals)
    return rounded(ev.passes(out, gates).orderBy(F.desc(F.abs("delta_br")), "cand_id").select(*_RANK))


def _bh_sql(p: str, out: str) -> str:
    return f"least(1.0, min({p} * nn / rk) OVER (PARTITION BY technique, {p} IS NULL ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)) AS {out}"


def _mm_sql(x: str, by: str = "PARTITION BY technique") -> str:
    return f"CASE WHEN max({x}) OVER ({by}) - min({x}) OVER ({by}) < 1e-9 THEN 0.0 ELSE ({x} - min({x}) OVER ({by})) / (max({x}) OVER ({by}) - min({x}) OVER ({by})) END"


_DROP = "greatest(0.0, coalesce(-{0}, 0.0))"
_EXPLAIN = """concat_ws('; ', CASE WHEN psi > 0.10 THEN printf('share moved from %.1f%% to %.1f%% (PSI %.4f)', 100 * pct_dev, 100 * pct_mon, psi) END,
 CASE WHEN delta_gini < -0.05 THEN printf('Gini down by %.4f, from %.4f to %.4f', abs(delta_gini), gini_dev, gini_mon) END, CASE WHEN delta_ks < -0.05 THEN printf('KS down by %.4f, from %.4f to %.4f', abs(delta_ks), ks_dev, ks_mon) END,
 CASE WHEN abs(delta_br) > 0.03 AND p_br <= 0.05 THEN printf('bad rate from %.2f%% to %.2f%% (adjusted p %.4f)', 100 * br_dev, 100 * br_mon, p_br) END,
 CASE WHEN psi < 0.10 AND abs(delta_gini) >= 0.05 THEN 'as many rows as before, but the score ranks them differently: the relation changed, not the mix' END)"""
SCORE_SQL = f"""r1 AS (SELECT *, count(*) OVER (PARTITION BY technique, br_pvalue IS NULL) AS nn, row_number() OVER (PARTITION BY technique, br_pvalue IS NULL ORDER BY br_pvalue) AS rk FROM ev), r2 AS (SELECT * EXCLUDE (nn, rk), {_bh_sql("br_pvalue", "q1")} FROM r1),
r3 AS (SELECT *, count(*) OVER (PARTITION BY technique, score_shift_pvalue IS NULL) AS nn, row_number() OVER (PARTITION BY technique, score_shift_pvalue IS NULL ORDER BY score_shift_pvalue) AS rk FROM r2), r4 AS (SELECT * EXCLUDE (nn, rk), {_bh_sql("score_shift_pvalue", "q2")} FROM r3),
i1 AS (SELECT *, coalesce(q1, 1.0) AS p_br, coalesce(q2, 1.0) AS p_ks, CASE WHEN mon_weight_pct > 0 THEN mon_weight_pct ELSE 1.0 END AS expo, {_DROP.format("delta_auc")} AS adrop, least(1.0, sqrt(n_mon / 100.0::DOUBLE)) AS conf FROM r4),
i2 AS (SELECT *, adrop * expo * pct_mon * conf AS sis, greatest(0.0, (pct_mon - pct_dev) * adrop * expo * (1 + mean_feature_psi)) AS dis, abs(pct_mon - pct_dev) * adrop * expo * (1 + mean_feature_psi) AS diss FROM i1),
i3 AS (SELECT *, 0.35 * ({_mm_sql("sis")}) + 0.30 * ({_mm_sql("dis")}) + 0.20 * ({_mm_sql("mean_feature_psi")}) + 0.15 * ({_mm_sql("mean_shap_shift")}) AS blend, {_EXPLAIN} AS ex FROM i2),
sc AS (SELECT *, p_br AS badrate_pvalue_adj, p_ks AS scoreshift_pvalue_adj, p_br <= 0.05 OR p_ks <= 0.05 AS statistically_significant, round(pct_mon * mon_weight_pct * (1 + psi + {_DROP.format("delta_gini")}), 4) AS business_impact_score, round(sis, 6) AS sis_raw, round(dis, 6) AS dis_raw, round(diss, 6) AS dis_symmetric, round(conf, 4) AS confidence_score,
 'Population Share: ' || CASE WHEN psi < 0.1 THEN 'Stable' WHEN psi <= 0.25 THEN 'Moderate Drift' ELSE 'Significant Drift' END AS psi_interpretation, round(blend, 6) AS root_cause_score, round(20 * blend, 4) AS severity_score, round(coalesce(pct_mon * abs(delta_gini), 0), 6) AS portfolio_impact_score, CASE WHEN ex = '' THEN 'no notable change' ELSE ex END AS drift_explanation FROM i3)"""
SCORED = f"{BASE}, {SCORE_SQL}"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.score(evaluated(spark, sf_dir))


@query("segment_scores", SCORED + " " + rounded_sql("SELECT * FROM sc", {"technique": "", "segment_definition": ""} | dict.fromkeys(scoring.SCORED, "") | {"badrate_pvalue_adj": "d", "scoreshift_pvalue_adj": "d"}))
def segment_scores(spark, sf_dir):
    return rounded(scored(spark, sf_dir).select("technique", "segment_definition", *scoring.SCORED))




@query("segment_rank", SCORED + " SELECT technique, segment_definition, statistically_significant, severity_score, row_number() OVER (PARTITION BY technique ORDER BY statistically_significant DESC, severity_score DESC, segment_definition) AS rank FROM sc")
def segment_rank(spark, sf_dir):
    return scoring.ranked(scored(spark, sf_dir).withColumn("cand_id", F.col("segment_definition"))).select("technique", "segment_definition", "statistically_significant", "severity_score", "rank")


@query("portfolio_view", SCORED + ", p AS (SELECT *, row_number() OVER (PARTITION BY technique ORDER BY portfolio_impact_score DESC, segment_definition) AS rank FROM sc WHERE statistically_significant) SELECT technique, rank, segment_definition AS segment, round(pct_mon, 6) AS population_pct, round(delta_gini, 6) AS delta_gini, round(delta_ks, 6) AS delta_ks, round(delta_br, 6) AS delta_br, portfolio_impact_score AS severity_population_x_gini, sis_raw, statistically_significant FROM p WHERE rank <= 10")
def portfolio_view(spark, sf_dir):
    return rounded(scoring.portfolio_view(scored(spark, sf_dir).withColumn("cand_id", F.col("segment_definition"))))


_WORST = "wo AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY technique ORDER BY severity_score DESC, segment_definition) AS rr FROM sc) WHERE rr <= 10)"


@query("worst_segments", SCORED + f", {_WORST} SELECT technique, segment_definition, severity_score FROM wo")
def worst_segments(spark, sf_dir):
    return scoring.worst(scored(spark, sf_dir).withColumn("cand_id", F.col("segment_definition"))).select("technique", "segment_definition", "severity_score")


@query(
    "cross_technique_top",
    SCORED + f""", {_WORST}, m AS (SELECT arg_max(segment_definition, (severity_score, technique)) AS best, arg_min(segment_definition, (length(segment_definition), segment_definition)) AS shortest, count(*) AS n, string_agg(DISTINCT technique, ', ' ORDER BY technique) AS discovered_by, max(severity_score) AS severity_score, arg_max(root_cause_score, (severity_score, technique)) AS root_cause_score FROM wo GROUP BY n_dev, n_mon, round(psi, 6), round(delta_br, 6), round(delta_gini, 6)),
k AS (SELECT CASE WHEN n > 1 THEN shortest ELSE best END AS segment_definition, discovered_by, severity_score, root_cause_score, {_mm_sql("root_cause_score", "")} AS normalized_root_cause_score FROM m),
o AS (SELECT *, row_number() OVER (ORDER BY normalized_root_cause_score DESC, severity_score DESC, segment_definition) AS overall_rank FROM k) SELECT overall_rank, segment_definition, discovered_by, severity_score, root_cause_score, round(normalized_root_cause_score, 6) AS normalized_root_cause_score FROM o WHERE overall_rank <= 10""",
)
def cross_technique_top(spark, sf_dir):
    out = scoring.cross_top(scored(spark, sf_dir))
    return rounded(out.select("overall_rank", "segment_definition", "discovered_by", "severity_score", "root_cause_score", "normalized_root_cause_score"))


@query(
    "technique_comparison",
    SCORED + f""", k AS (SELECT *, row_number() OVER (PARTITION BY technique ORDER BY statistically_significant DESC, severity_score DESC, segment_definition) AS rank FROM sc),
t AS (SELECT technique, arg_min(segment_definition, rank) AS top_segment_definition, count(*) AS segments_generated, arg_min(pct_mon, rank) AS pm, arg_min(mon_weight_pct, rank) AS pw, max(psi) AS mp, greatest(0.0, -min(delta_gini)) AS mg, greatest(0.0, -min(delta_ks)) AS mk, max(abs(delta_br)) AS mb, arg_min(business_impact_score, rank) AS bi, arg_min(top_drift_feature, rank) AS root_cause_feature FROM k GROUP BY technique),
q AS (SELECT *, round(100 * (0.30 * ({_mm_sql("mp", "")}) + 0.25 * ({_mm_sql("mg", "")}) + 0.20 * ({_mm_sql("mk", "")}) + 0.15 * ({_mm_sql("mb", "")}) + 0.10 * ({_mm_sql("bi", "")})), 1) AS overall_score_100 FROM t)
SELECT technique, top_segment_definition, segments_generated, round(100 * pm, 2) AS top_segment_pop_pct, round(100 * pw, 2) AS top_segment_exp_pct, round(mp, 4) AS max_psi, round(mg, 4) AS max_gini_drop, round(mk, 4) AS max_ks_drop, round(100 * mb, 2) AS max_br_shift_pct, bi AS business_impact_score, root_cause_feature, overall_score_100, rank() OVER (ORDER BY overall_score_100 DESC) AS severity_rank FROM q""",
)
def technique_comparison(spark, sf_dir):
    return scoring.compare_techniques(scored(spark, sf_dir).withColumn("cand_id", F.col("segment_definition")))
