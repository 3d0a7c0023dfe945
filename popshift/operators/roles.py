"""Column roles from one aggregate over the baseline and the columns' names."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

#: Name patterns by role, in order of preference. Fixed values.
TARGETS = (r"default_?flag", r"^target$", r"^y$", r"bad_?flag", r"^label$", r"outcome")
SCORES = (r"predicted_?pd", r"^pd(_|$)", r"prob", r"score|^s$")
WEIGHTS = (r"^ead$", r"exposure", r"balance", r"weight|^w$", r"amount")
IDS = (r"(^|_)id$", r"_rk$", r"_sk$", r"key$", r"^rid$")
TIMES = (r"date", r"(^|_)dt$", r"(^|_)ts$", r"month", r"period", r"year", r"time")
SHAP = (r"^shap[_-]",)


@dataclass(frozen=True)
class Settings:
    target: str | None = None
    score: str | None = None
    weight: str | None = None
    ids: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    max_levels: int = 20
    id_share: float = 0.98


def _like(name: str, patterns: tuple[str, ...]) -> bool:
    return any(re.search(p, name, re.I) for p in patterns)


def column_stats(df: DataFrame) -> DataFrame:
    """(name, n, n_valid, card, lo, hi): distinct values and ends of every column, NaN as null."""
    cols = [F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("v"), (F.col(f"`{c}`").cast("double") if isinstance(t, T.NumericType) else F.lit(None).cast("double")).alias("x")) for c, t in ((f.name, f.dataType) for f in df.schema)]
    long = df.select(F.explode(F.array(*cols)).alias("c")).select("c.*").withColumns({"v": F.when(~F.isnan(F.coalesce("x", F.lit(0.0))), F.col("v")), "x": F.when(~F.isnan("x"), F.col("x"))})
    return long.groupBy("name").agg(F.count("*").alias("n"), F.count("v").alias("n_valid"), F.count_distinct("v").alias("card"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def detect(df: DataFrame, cfg: Settings = Settings()) -> dict[str, tuple[str, str]]:
    """Column to (role, reason): target, score, weight, id, time, shap, excluded, categorical or numeric feature.

    Explicit settings come first; raises ValueError if no target or score can be found.
    """
    numeric = {f.name for f in df.schema if isinstance(f.dataType, T.NumericType)}
    whole = {f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)}
    s = {r["name"]: r for r in column_stats(df).collect()}  # a row for each column
    out: dict[str, tuple[str, str]] = {}

    def pick(role: str, explicit: str | None, patterns: tuple[str, ...], fits, last=()) -> None:
        if explicit:
            out[explicit] = (role, "setting")
            return
        for p in patterns:
            for c in df.columns:
                if c not in out and re.search(p, c, re.I) and fits(c):
                    out[c] = (role, f"name like {p}")
                    return
        for reason, other in last:
            for c in df.columns:
                if c not in out and other(c):
                    out[c] = (role, reason)
                    return
        if role != "weight":
            raise ValueError(f"no column can be the {role}")

    for c in cfg.exclude:
        out[c] = ("excluded", "setting")
    binary = lambda c: s[c]["card"] == 2
    pick("target", cfg.target, TARGETS, binary, [("two values 0 and 1", lambda c: c in numeric and binary(c) and s[c]["lo"] == 0 and s[c]["hi"] == 1)])
    unit = lambda c: c in numeric and s[c]["card"] > cfg.max_levels and s[c]["lo"] >= 0 and s[c]["hi"] <= 1
    pick("score", cfg.score, SCORES, lambda c: c in numeric, [("numbers in [0, 1]", unit), ("first number with many values", lambda c: c in numeric and s[c]["card"] > cfg.max_levels)])
    pick("weight", cfg.weight, WEIGHTS, lambda c: c in numeric)
    for c in df.columns:
        if c in out:
            continue
        if c in cfg.ids or _like(c, IDS):
            out[c] = ("id", "setting or name")
        elif _like(c, TIMES):
            out[c] = ("time", "name")
        elif _like(c, SHAP):
            out[c] = ("shap", "name")
        elif s[c]["n_valid"] and s[c]["card"] / s[c]["n_valid"] > cfg.id_share and (c not in numeric or c in whole):
            out[c] = ("id", "almost all values differ")
        elif c in cfg.categorical or (c not in cfg.numeric and (c not in numeric or s[c]["card"] <= cfg.max_levels)):
            out[c] = ("categorical", "text or few values")
        else:
            out[c] = ("numeric", "number")
    return out


def strict(df: DataFrame, mon: DataFrame, roles: dict[str, tuple[str, str]], private: tuple[str, ...] = (), after: tuple[str, ...] = (), max_levels: int = 50) -> dict[str, tuple[str, str]]:
    """The roles with features set aside that can't be used: private, known only afterwards, absent or of another type in
    monitoring, constant, or text with too many levels."""
    kinds = {f.name: f.dataType for f in mon.schema}
    s = {r["name"]: r for r in column_stats(df).collect()}
    out = dict(roles)
    for c, (role, _) in roles.items():
        if role not in ("categorical", "numeric"):
            continue
        if _like(c, private) if private else False:
            out[c] = ("excluded", "private")
        elif _like(c, after) if after else False:
            out[c] = ("excluded", "known only after the decision")
        elif c not in kinds:
            out[c] = ("excluded", "not in monitoring")
        elif kinds[c] != df.schema[c].dataType:
            out[c] = ("excluded", "another type in monitoring")
        elif s[c]["card"] <= 1:
            out[c] = ("excluded", "constant")
        elif isinstance(df.schema[c].dataType, T.StringType) and s[c]["card"] > max_levels:
            out[c] = ("excluded", "too many levels")
    return out
