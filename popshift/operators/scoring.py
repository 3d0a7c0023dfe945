"""Scores and rankings of evaluated segments: window functions over small tables of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from popshift.functions.buckets import psi_band

c = F.col
#: Fixed values.
WEIGHTS = {"sis": 0.35, "dis": 0.30, "psi": 0.20, "shap": 0.15}


def adjusted_p(p: str, by: str = "technique") -> tuple[Column, Column]:
    """Benjamini-Hochberg in two steps, as windows can't be nested: p n / rank, then its minimum from the largest rank on."""
    there = Window.partitionBy(by, c(p).isNull())
    rank = F.row_number().over(there.orderBy(p))
    return c(p) * F.count("*").over(there) / rank, rank


def benjamini_hochberg(df: DataFrame, p: str, out: str, by: str = "technique") -> DataFrame:
    """df with out: the adjusted p-values within each group; null stays null and doesn't count."""
    raw, rank = adjusted_p(p, by)
    df = df.withColumns({"_raw": raw, "_rank": rank})
    down = Window.partitionBy(by, c(p).isNull()).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(out, F.when(c(p).isNotNull(), F.least(F.lit(1.0), F.min("_raw").over(down)))).drop("_raw", "_rank")


def min_max(value: Column, by: str = "technique") -> Column:
    """0 to 1 within the group; zeros if the range is degenerate."""
    w = Window.partitionBy(by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi - lo < 1e-9, 0.0).otherwise((value - lo) / (hi - lo))


def drop(delta: str) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(-c(delta), F.lit(0.0)))


def confidence(n: Column) -> Column:
    return F.least(F.lit(1.0), F.sqrt(F.greatest(F.lit(0.0), n) / 100.0))


def impact(df: DataFrame) -> DataFrame:
    """df with SIS, DIS, its symmetric form, business and portfolio impact, unrounded."""
    exposure = F.when(c("mon_weight_pct") > 0, c("mon_weight_pct")).otherwise(1.0)
    growth, auc = c("pct_mon") - c("pct_dev"), drop("delta_auc")
    return df.withColumns({
        "confidence": confidence(c("n_mon")), "sis": auc * exposure * c("pct_mon") * confidence(c("n_mon")),
        "dis": F.greatest(F.lit(0.0), growth * auc * exposure * (1 + F.greatest(F.lit(0.0), c("mean_feature_psi")))),
        "dis_symmetric": F.abs(growth) * auc * exposure * (1 + F.greatest(F.lit(0.0), c("mean_feature_psi"))),
        "business_impact": c("pct_mon") * c("mon_weight_pct") * (1 + c("psi") + drop("delta_gini")), "portfolio_impact": F.coalesce(c("pct_mon") * F.abs("delta_gini"), F.lit(0.0)),
    })


def blend(sis: str = "sis", dis: str = "dis", psi: str = "mean_feature_psi", shap: str = "mean_shap_shift", by: str = "technique") -> Column:
    """Weighted sum of the normalised parts."""
    return sum((WEIGHTS[k] * min_max(c(v), by) for k, v in (("sis", sis), ("dis", dis), ("psi", psi), ("shap", shap))), F.lit(0.0))


def explanation(p_br: Column, alpha: float) -> Column:
    pct1, pct2 = (lambda x, k=k: F.format_string(f"%.{k}f%%", 100 * x) for k in (1, 2))
    f4 = lambda x: F.format_string("%.4f", x)
    from_to = lambda a, b, show: F.concat(show(c(a)), F.lit(" to "), show(c(b)))
    parts = F.concat_ws(
        "; ",
        F.when(c("psi") > 0.10, F.concat(F.lit("share moved from "), from_to("pct_dev", "pct_mon", pct1), F.lit(" (PSI "), f4(c("psi")), F.lit(")"))),
        F.when(c("delta_gini") < -0.05, F.concat(F.lit("Gini down by "), f4(F.abs("delta_gini")), F.lit(", from "), from_to("gini_dev", "gini_mon", f4))),
        F.when(c("delta_ks") < -0.05, F.concat(F.lit("KS down by "), f4(F.abs("delta_ks")), F.lit(", from "), from_to("ks_dev", "ks_mon", f4))),
        F.when((F.abs("delta_br") > 0.03) & (p_br <= alpha), F.concat(F.lit("bad rate from "), from_to("br_dev", "br_mon", pct2), F.lit(" (adjusted p "), f4(p_br), F.lit(")"))),
        F.when((c("psi") < 0.10) & (F.abs("delta_gini") >= 0.05), F.lit("as many rows as before, but the score ranks them differently: the relation changed, not the mix")),
    )
    return F.when(parts == "", "no notable change").otherwise(parts)


def drift_confidence(p_br: str = "p_br", p_ks: str = "p_ks") -> Column:
    """How sure a change is, from 0 to 1: one less the smaller p-value of bad rate and score; a missing one counts as 1."""
    p = lambda x: F.when(c(x).isNull() | F.isnan(c(x)), 1.0).otherwise(c(x))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.least(p(p_br), p(p_ks))))


def with_root_cause_score(segments: DataFrame) -> DataFrame:
    """segments with root_cause_score: as it is where any is not zero; else the first drift column there is times the first
    impact column there is, missing values as 0; 0 without such columns."""
    if "root_cause_score" in segments.columns and segments.agg(F.sum(F.abs("root_cause_score"))).first()[0]:
        return segments
    psi = next((x for x in ("root_cause_psi", "top_drift_psi", "top_shap_psi", "top_shap_shift_psi") if x in segments.columns), None)
    impact = next((x for x in ("severity_score", "business_impact_score", "sis_business_impact") if x in segments.columns), None)
    if psi and impact:
        return segments.withColumn("root_cause_score", F.round(F.coalesce(psi, F.lit(0.0)) * F.coalesce(impact, F.lit(0.0)), 6))
    return segments if "root_cause_score" in segments.columns else segments.withColumn("root_cause_score", F.lit(0.0))


SCORED = ["badrate_pvalue_adj", "scoreshift_pvalue_adj", "statistically_significant", "business_impact_score", "sis_raw", "dis_raw", "dis_symmetric", "confidence_score", "psi_interpretation", "root_cause_score", "severity_score", "portfolio_impact_score", "drift_explanation"]


def score(pool: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The evaluated pool with SCORED, within each technique."""
    df = benjamini_hochberg(benjamini_hochberg(pool, "br_pvalue", "p_br"), "score_shift_pvalue", "p_ks")
    df = impact(df.withColumns({"p_br": F.coalesce("p_br", F.lit(1.0)), "p_ks": F.coalesce("p_ks", F.lit(1.0))}))
    df = df.withColumn("blend", blend())
    df = df.withColumns({
        "badrate_pvalue_adj": c("p_br"), "scoreshift_pvalue_adj": c("p_ks"), "statistically_significant": (c("p_br") <= alpha) | (c("p_ks") <= alpha), "business_impact_score": F.round("business_impact", 4), "sis_raw": F.round("sis", 6), "dis_raw": F.round("dis", 6),
        "dis_symmetric": F.round("dis_symmetric", 6), "confidence_score": F.round("confidence", 4), "psi_interpretation": F.concat(F.lit("Population Share: "), psi_band(c("psi"))), "root_cause_score": F.round("blend", 6), "severity_score": F.round(20 * c("blend"), 4),
        "portfolio_impact_score": F.round("portfolio_impact", 6), "drift_explanation": explanation(c("p_br"), alpha),
    })
    return df.select(*pool.columns, *SCORED)


def ranked(scored: DataFrame) -> DataFrame:
    """Significant segments first, then by severity; ties keep the order of evaluation."""
    w = Window.partitionBy("technique").orderBy(F.desc("statistically_significant"), F.desc_nulls_last("severity_score"), "cand_id")
    return scored.withColumn("rank", F.row_number().over(w))


def portfolio_view(scored: DataFrame, top_n: int = 10) -> DataFrame:
    w = Window.partitionBy("technique").orderBy(F.desc("portfolio_impact_score"), "cand_id")
    out = scored.where("statistically_significant").withColumn("rank", F.row_number().over(w)).where(c("rank") <= top_n)
    return out.select("technique", "rank", c("segment_definition").alias("segment"), c("pct_mon").alias("population_pct"), "delta_gini", "delta_ks", "delta_br", c("portfolio_impact_score").alias("severity_population_x_gini"), "sis_raw", "statistically_significant")


def worst(scored: DataFrame, n: int = 10, by: tuple[str, ...] = ("technique",)) -> DataFrame:
    """The n most severe of each group; ties keep the order of evaluation."""
    w = Window.partitionBy(*by).orderBy(F.desc_nulls_last("severity_score"), "cand_id")
    return scored.withColumn("_n", F.row_number().over(w)).where(c("_n") <= n).drop("_n")


def merged(pool: DataFrame) -> DataFrame:
    """One row for each population: candidates of equal counts, PSI and changes are one, found by several techniques."""
    fp = F.struct("n_dev", "n_mon", *[F.round(x, 6).alias(x) for x in ("psi", "delta_br", "delta_gini")])
    top = F.max_by(F.struct(*pool.columns), F.struct("severity_score", "technique", F.lit(0) - c("cand_id")))
    name = F.min_by("segment_definition", F.struct(F.length("segment_definition"), c("segment_definition")))
    g = pool.groupBy(fp.alias("fp")).agg(top.alias("t"), name.alias("shortest"), F.count("*").alias("n_found"), F.array_join(F.array_sort(F.collect_set("technique")), ", ").alias("discovered_by"))
    keep = [c(f"t.{x}").alias(x) for x in pool.columns if x != "segment_definition"]
    return g.select(*keep, F.when(c("n_found") > 1, c("shortest")).otherwise(c("t.segment_definition")).alias("segment_definition"), "discovered_by")


def cross_top(scored: DataFrame, per_technique: int = 10, top_n: int = 10) -> DataFrame:
    """The worst of each technique, merged, ranked by the normalised root-cause score, then severity."""
    pool = merged(worst(scored, per_technique)).withColumns({"one": F.lit(1), "root_cause_score": F.coalesce("root_cause_score", F.lit(0.0))})
    pool = pool.withColumn("normalized_root_cause_score", min_max(c("root_cause_score"), "one"))
    w = Window.orderBy(F.desc("normalized_root_cause_score"), F.desc("severity_score"), "segment_definition")
    return pool.orderBy(F.desc("normalized_root_cause_score"), F.desc("severity_score"), "segment_definition").limit(top_n).withColumn("overall_rank", F.row_number().over(w)).drop("one")


def compare_techniques(scored: DataFrame) -> DataFrame:
    """One row per technique: extremes, a weighted score out of 100, and its rank."""
    first = F.min_by(F.struct("segment_definition", "pct_mon", "mon_weight_pct", "business_impact_score", "root_cause_score", "top_drift_feature", "exposure_drift", "calibration_drift"), "rank")
    t = ranked(scored).groupBy("technique").agg(first.alias("f"), F.count("*").alias("segments_generated"), F.max("psi").alias("max_psi"), F.greatest(F.lit(0.0), -F.min("delta_gini")).alias("max_gini_drop"), F.greatest(F.lit(0.0), -F.min("delta_ks")).alias("max_ks_drop"), F.max(F.abs("delta_br")).alias("max_br_shift"))
    t = t.withColumns({"one": F.lit(1), "business_impact_score": c("f.business_impact_score")})
    parts = (("max_psi", 0.30), ("max_gini_drop", 0.25), ("max_ks_drop", 0.20), ("max_br_shift", 0.15), ("business_impact_score", 0.10))
    t = t.withColumn("overall_score_100", F.round(100 * sum((w * min_max(c(x), "one") for x, w in parts), F.lit(0.0)), 1))
    return t.select(
        "technique", c("f.segment_definition").alias("top_segment_definition"), "segments_generated", F.round(100 * c("f.pct_mon"), 2).alias("top_segment_pop_pct"), F.round(100 * c("f.mon_weight_pct"), 2).alias("top_segment_exp_pct"), F.round("max_psi", 4).alias("max_psi"), F.round("max_gini_drop", 4).alias("max_gini_drop"),
        F.round("max_ks_drop", 4).alias("max_ks_drop"), F.round(100 * c("max_br_shift"), 2).alias("max_br_shift_pct"), F.round("business_impact_score", 4).alias("business_impact_score"), c("f.top_drift_feature").alias("root_cause_feature"), "overall_score_100", F.rank().over(Window.orderBy(F.desc("overall_score_100"))).alias("severity_rank"),
    )


def heuristic() -> Column:
    """The beam's quick measure of a candidate."""
    return c("psi") * 0.30 + c("mon_weight_pct") * 0.25 + drop("delta_gini") * 0.20 + drop("delta_ks") * 0.15 + F.coalesce(F.abs("delta_br"), F.lit(0.0)) * 0.10
