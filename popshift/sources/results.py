"""Result tables of techniques: uniform column names, meanings of columns, and a bundle of files."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, functions as F

from popshift.sources.tables import labelled, write_result

#: Other names of columns, in lower case. They are what other tools write.
ALIASES = {
    "segment": "segment_definition", "rule_text": "segment_definition",
    "br_p_value": "br_pvalue",
    "dev_count": "n_dev", "mon_count": "n_mon",
    "dev_ead": "weight_dev", "mon_ead": "weight_mon", "ead_dev": "weight_dev", "ead_mon": "weight_mon",
    "dev_exposure_pct": "dev_weight_pct", "mon_exposure_pct": "mon_weight_pct", "exposure_pct": "mon_weight_pct",
    "delta_intercept": "calibration_drift", "delta_calibration_intercept": "calibration_drift",
    "root_cause_feature": "top_drift_feature", "root_cause_psi": "top_drift_psi",
    "top_shap_feature": "top_shap_shift_feature", "top_shap_psi": "top_shap_shift_psi",
    "final_score": "severity_score", "overall_score": "severity_score",
    "significant": "statistically_significant",
}
_SIDED = re.compile(r"(dev|mon)_(auc|gini|ks|br|pct)")


def standard_name(name: str) -> str:
    """The name that this package uses: lower case, the side behind the measure, one name for each alias."""
    low = name.lower()
    if m := _SIDED.fullmatch(low):
        return f"{m[2]}_{m[1]}"
    return ALIASES.get(low, low)


def standardised(df: DataFrame, technique: str) -> DataFrame:
    """df with standard names and a technique column. Of columns that come to the same name, the one that has it already
    stays, else the first; the others keep their names."""
    taken = {c for c in df.columns if standard_name(c) == c}
    renamed = {}
    for c in df.columns:
        new = standard_name(c)
        if new != c and new not in taken:
            renamed[c] = new
            taken.add(new)
    out = df.withColumnsRenamed(renamed)
    return out if "technique" in out.columns else out.withColumn("technique", F.lit(technique))


_SIDES = {"dev": "on the baseline", "mon": "under monitoring"}
_MEASURES = {"n": "Rows of the segment", "x": "Bad outcomes in the segment", "pct": "Share of the side's rows in the segment", "br": "Bad rate of the segment", "auc": "AUC of the score in the segment", "gini": "Gini of the score in the segment", "ks": "KS distance of the score in the segment", "weight": "Exposure of the segment"}
#: What each column of a result says.
MEANING: dict[str, str] = (
    {f"{m}_{s}": f"{text} {where}" for m, text in _MEASURES.items() for s, where in _SIDES.items()}
    | {f"delta_{m}": f"{_MEASURES[m]}: monitoring less baseline" for m in ("br", "auc", "gini", "ks")}
    | {
        "technique": "What found the segment", "segment_definition": "The segment's rule as text", "rank": "Place within the technique", "psi": "Stability index of the segment's share",
        "br_pvalue": "p-value of the change of the bad rate", "score_shift_pvalue": "p-value of the change of the score's distribution", "badrate_pvalue_adj": "br_pvalue after correction for the number of tests", "scoreshift_pvalue_adj": "score_shift_pvalue after correction",
        "statistically_significant": "Whether one of the corrected p-values is small", "dev_weight_pct": "Share of the baseline's exposure", "mon_weight_pct": "Share of monitoring's exposure", "exposure_drift": "Change of the share of exposure",
        "calibration_drift": "Change of bad outcomes per expected one", "mean_feature_psi": "Mean stability index of the features in the segment", "mean_shap_shift": "Mean absolute change of attributions", "top_drift_feature": "Feature with the largest index", "top_drift_psi": "Its index",
        "top_shap_shift_feature": "Attribution with the largest index", "top_shap_shift_psi": "Its index", "sis_raw": "Static impact: fall of AUC by exposure, share and confidence", "dis_raw": "Dynamic impact: also by growth of the share and feature drift", "dis_symmetric": "Dynamic impact of shrinking shares, too",
        "confidence_score": "Confidence by number of rows", "business_impact_score": "Impact by share, exposure and changes", "portfolio_impact_score": "Share times change of Gini", "root_cause_score": "Weighted sum of normalised impacts", "severity_score": "The same on a scale to 20",
        "psi_interpretation": "Band of the index", "drift_explanation": "What changed, in words",
    }
)


def described(df: DataFrame) -> DataFrame:
    """df with the meanings of its columns as metadata."""
    return labelled(df, MEANING)


def write_bundle(tables: Mapping[str, DataFrame], folder: str, kind: str = "csv") -> dict[str, str]:
    """Each table under its name; where that can't be replaced, under its name and _latest. The paths by name."""
    written = {}
    for name, df in tables.items():
        path = f"{folder.rstrip('/')}/{name}"
        try:
            write_result(described(df), path, kind)
        except PySparkException:
            path += "_latest"
            write_result(described(df), path, kind)
        written[name] = path
    return written
