"""Scored populations over the star schema: a baseline side (0) and a monitoring side (1) with one schema.

`y` is the outcome, `s` the model score, `w` the exposure, `shap_*` attributions, `period` the month. A drift is planted: on
the monitoring side, four of ten rows of the BUILDING segment get the bad outcome whatever the score says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from popshift.sources.tables import spread, table

SPLIT = "1999-01-01"
TARGET, SCORE, WEIGHT = "y", "s", "w"
NUMERIC = ["l_quantity", "p_size", "p_retailprice", "c_acctbal"]
LOW_CARD = ["l_discount", "l_tax"]
CATEGORICAL = ["c_mktsegment", "o_orderpriority", "l_linestatus", "n_name"]
SHAP = ["shap_quantity", "shap_discount", "shap_segment"]


def population(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, c, p, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "part", "nation"))
    li = spread(li)
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(p, li.l_partkey == p.p_partkey).join(n, c.c_nationkey == n.n_nationkey)
    side = F.when(F.col("o_orderdate") < F.lit(SPLIT).cast("timestamp_ntz"), 0).otherwise(1)
    bad = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    planted = (side == 1) & (F.col("c_mktsegment") == "BUILDING") & ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 10 < 4)
    return rows.select(
        side.alias("side"),
        F.when(planted, 1).otherwise(bad).alias("y"),
        (F.lit(0.05) + F.lit(0.45) * (F.col("l_quantity") - F.lit(1.0)) / F.lit(49.0) + F.lit(0.225) * bad + F.lit(0.1) * F.col("l_discount")).alias("s"),
        F.col("l_extendedprice").alias("w"),
        "l_quantity",
        F.col("p_size").cast("double").alias("p_size"),
        "p_retailprice",
        F.when(F.col("o_orderkey") % 17 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        "l_discount", "l_tax", "c_mktsegment", "o_orderpriority", "l_linestatus", "n_name",
        F.date_format("o_orderdate", "yyyy-MM").alias("period"),
        ((F.col("l_quantity") - F.lit(25.5)) / F.lit(49.0) * (F.lit(1.0) + F.lit(0.2) * side)).alias("shap_quantity"),
        (F.col("l_discount") - F.lit(0.05)).alias("shap_discount"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit(0.1) + F.lit(0.05) * side).otherwise(F.lit(0.0)).alias("shap_segment"),
    )


#: The same rows in DuckDB, as common table expression `pop`.
POP_SQL = f"""pop AS (
SELECT side, CASE WHEN side = 1 AND c_mktsegment = 'BUILDING' AND (l_orderkey * 7 + l_linenumber) % 10 < 4 THEN 1 ELSE bad END AS y,
 CAST(0.05 AS DOUBLE) + CAST(0.45 AS DOUBLE) * (l_quantity - 1.0::DOUBLE) / 49.0::DOUBLE + CAST(0.225 AS DOUBLE) * bad + CAST(0.1 AS DOUBLE) * l_discount AS s,
 l_extendedprice AS w, l_quantity, p_size::DOUBLE AS p_size, p_retailprice, CASE WHEN o_orderkey % 17 <> 0 THEN c_acctbal END AS c_acctbal,
 l_discount, l_tax, c_mktsegment, o_orderpriority, l_linestatus, n_name, strftime(o_orderdate, '%Y-%m') AS period,
 (l_quantity - 25.5::DOUBLE) / 49.0::DOUBLE * (1.0::DOUBLE + 0.2::DOUBLE * side) AS shap_quantity, l_discount - 0.05::DOUBLE AS shap_discount,
 CASE WHEN c_mktsegment = 'BUILDING' THEN 0.1::DOUBLE + 0.05::DOUBLE * side ELSE 0.0::DOUBLE END AS shap_segment
FROM (SELECT *, CASE WHEN o_orderdate < TIMESTAMP '{SPLIT}' THEN 0 ELSE 1 END AS side, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS bad
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey JOIN nation ON c_nationkey = n_nationkey))"""
