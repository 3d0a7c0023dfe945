"""Patterns for preparing application tables: derived columns, appends, JSON grids, pivots, samples, reconciliation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN_END = "9999-12-31 00:00:00"


def age_at(event: Column, birth: Column) -> Column:
    return F.floor(F.months_between(event, birth) / 12).cast("int")


def status_flag(status: Column, bad: str) -> Column:
    return (F.upper(F.trim(status)) == bad.upper()).cast("int")


def coded(value: Column, codes: Mapping[str, str], otherwise: str = "") -> Column:
    out = None
    for k, v in codes.items():
        out = F.when(value == k, v) if out is None else out.when(value == k, v)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both by column name; what only one has is null in the other."""
    return old.unionByName(new, allowMissingColumns=True)


def key_check(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(key).alias("n_keys"))


def to_grid(metadata: list[str], *columns: Column) -> Column:
    """A row's values as a one-row JSON grid: [{"metadata": [...]}, {"data": [[...]]}]."""
    data = F.to_json(F.array(F.array(*[c.cast("string") for c in columns])))
    meta = F.to_json(F.array(*[F.lit(m) for m in metadata]))
    return F.concat(F.lit('[{"metadata":'), meta, F.lit('},{"data":'), data, F.lit("}]"))


def from_grid(grid: Column, k: int) -> Column:
    return F.from_json(grid, "array<struct<metadata:array<string>,data:array<array<string>>>>")[1]["data"][0][k]


def from_json_key(json: Column, key: str) -> Column:
    return F.get_json_object(json, f"$.{key}")


def keyed_rows_to_columns(rows: DataFrame, id_col: str, name_col: str, value_col: str, names: list[str]) -> DataFrame:
    return rows.groupBy(id_col).pivot(name_col, names).agg(F.first(value_col))


def half_year(date: Column) -> Column:
    return F.ceil(F.month(date) / 6)


#: Digits of a hash by which a stratum's rows are counted.
PREFIX = 4


def stratified(df: DataFrame, stratum: str, share: float, key: str) -> DataFrame:
    """Exactly ceil(share * n) rows of each stratum, those with the smallest hashes of the key. The sample is the feature here.

    Counts by the hash's first digits say at which prefix a stratum's sample ends: rows below it are in, and only those with
    this very prefix, one in 16 ** PREFIX, are put in order.
    """
    h = F.md5(F.col(key).cast("string"))
    rows = df.withColumns({"_h": h, "_p": F.coalesce(F.substring(h, 1, PREFIX), F.lit(""))})
    counts = rows.groupBy(F.col(stratum).alias("_s"), F.col("_p").alias("_last")).agg(F.count("*").alias("_m"))
    w = Window.partitionBy("_s")
    counts = counts.withColumns({"_quota": F.ceil(share * F.sum("_m").over(w)), "_upto": F.sum("_m").over(w.orderBy("_last"))})
    ends = counts.where((F.col("_upto") >= F.col("_quota")) & (F.col("_upto") - F.col("_m") < F.col("_quota"))).select("_s", "_last", (F.col("_quota") - F.col("_upto") + F.col("_m")).alias("_left"))
    near = rows.join(ends, F.col(stratum).eqNullSafe(F.col("_s"))).where(F.col("_p") <= F.col("_last"))
    below = near.where(F.col("_p") < F.col("_last")).select(df.columns)
    at = near.where(F.col("_p") == F.col("_last")).withColumn("_k", F.row_number().over(Window.partitionBy("_s").orderBy("_h", key)))
    return below.unionByName(at.where(F.col("_k") <= F.col("_left")).select(df.columns))


def reconcile(left: DataFrame, right: DataFrame, left_key: Column, right_key: str, agree: Mapping[str, Column]) -> DataFrame:
    """One row: how many left rows find no right row, and on how many each condition holds."""
    j = left.join(right, left_key == F.col(right_key), "left")
    return j.agg(F.count("*").alias("n_left"), F.count_if(F.col(right_key).isNull()).alias("n_missing"), *[F.count_if(v).alias(k) for k, v in agree.items()])


def parity(a: DataFrame, b: DataFrame, keys: list[str], metrics: list[str], tolerance: float) -> DataFrame:
    """(metric, n_both, n_one_sided, max_diff, within): two result tables, metric by metric."""
    x, y = a.select(*keys, *[F.col(m).alias(f"a_{m}") for m in metrics]), b.select(*keys, *[F.col(m).alias(f"b_{m}") for m in metrics])
    j = x.withColumn("_a", F.lit(1)).join(y.withColumn("_b", F.lit(1)), keys, "full")
    rows = j.select(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1).otherwise(0).alias("both"), *[F.abs(F.col(f"a_{m}") - F.col(f"b_{m}")).cast("double").alias(m) for m in metrics]).unpivot(["both"], metrics, "metric", "diff")
    g = rows.groupBy("metric").agg(F.sum("both").alias("n_both"), F.sum(1 - F.col("both")).alias("n_one_sided"), F.max("diff").alias("max_diff"))
    return g.withColumn("within", F.coalesce(F.col("max_diff") <= tolerance, F.lit(True)) & (F.col("n_one_sided") == 0))
