"""Queries for the preparation patterns, over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from popshift.operators import etl
from popshift.plans.registry import query, rounded
from popshift.sources.tables import table

c = F.col
_STATUS = {"F": "ACC", "O": "REF", "P": "CAP"}


def _applications(spark, sf_dir) -> DataFrame:
    """Orders as applications, with the customer's number as the applicant."""
    return table(spark, sf_dir, "orders").select(c("o_orderkey").alias("application_id"), c("o_custkey").alias("customer_id"), c("o_orderdate").alias("application_dt"), c("o_orderstatus").alias("outcome"), c("o_totalprice").alias("amount"), c("o_orderpriority").alias("channel"))


_AGE = "CAST(date_diff('month', DATE '1970-06-15', o_orderdate::DATE) - CASE WHEN day(o_orderdate) < 15 THEN 1 ELSE 0 END AS BIGINT) // 12"


@query("etl_derived", f"SELECT o_orderkey AS application_id, CAST({_AGE} AS INTEGER) AS age, CAST(upper(trim(o_orderstatus)) = 'F' AS INTEGER) AS reject_flg, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS application_ts FROM orders")
def etl_derived(spark, sf_dir):
    a = _applications(spark, sf_dir)
    return a.select("application_id", etl.age_at(c("application_dt"), F.lit("1970-06-15").cast("date")).alias("age"), etl.status_flag(c("outcome"), "f").alias("reject_flg"), F.date_format("application_dt", "yyyy-MM-dd HH:mm:ss").alias("application_ts"))


_OLD = "SELECT o_orderkey AS application_rk, CAST(o_orderkey AS VARCHAR) AS application_id, o_orderdate AS valid_start, NULL AS outcome_cd, NULL AS valid_end, NULL AS purpose_cd FROM orders WHERE o_orderkey % 2 = 0"
_NEW = f"SELECT o_orderkey AS application_rk, CAST(o_orderkey AS VARCHAR) AS application_id, o_orderdate AS valid_start, CASE o_orderstatus WHEN 'F' THEN 'ACC' WHEN 'O' THEN 'REF' WHEN 'P' THEN 'CAP' ELSE '' END AS outcome_cd, TIMESTAMP '{etl.OPEN_END}' AS valid_end, substr(o_orderpriority, 1, 3) AS purpose_cd FROM orders WHERE o_orderkey % 2 = 1"


def _appended(spark, sf_dir) -> DataFrame:
    a = _applications(spark, sf_dir).select(c("application_id").alias("application_rk"), c("application_id").cast("string").alias("application_id"), c("application_dt").alias("valid_start"), "outcome", "channel")
    old = a.where("application_rk % 2 = 0").drop("outcome", "channel")
    new = a.where("application_rk % 2 = 1").select("application_rk", "application_id", "valid_start", etl.coded(c("outcome"), _STATUS).alias("outcome_cd"), F.lit(etl.OPEN_END).cast("timestamp_ntz").alias("valid_end"), F.substring("channel", 1, 3).alias("purpose_cd"))
    return etl.appended(old, new)


@query("etl_append", f"SELECT outcome_cd, purpose_cd, valid_end IS NULL AS open_before, count(*) AS n, CAST(sum(application_rk) AS BIGINT) AS keys FROM ({_OLD} UNION ALL {_NEW}) GROUP BY ALL")
def etl_append(spark, sf_dir):
    return _appended(spark, sf_dir).groupBy("outcome_cd", "purpose_cd", c("valid_end").isNull().alias("open_before")).agg(F.count("*").alias("n"), F.sum("application_rk").alias("keys"))


@query("etl_key_check", f"SELECT count(*) AS n_rows, count(DISTINCT application_rk) AS n_keys FROM ({_OLD} UNION ALL {_NEW})")
def etl_key_check(spark, sf_dir):
    return etl.key_check(_appended(spark, sf_dir), "application_rk")


@query("etl_json_grid", """SELECT c_custkey, '[{"metadata":["name","segment"]},{"data":[["' || c_name || '","' || c_mktsegment || '"]]}]' AS grid, c_mktsegment AS segment FROM customer""")
def etl_json_grid(spark, sf_dir):
    cust = table(spark, sf_dir, "customer").select("c_custkey", etl.to_grid(["name", "segment"], c("c_name"), c("c_mktsegment")).alias("grid"))
    return cust.withColumn("segment", etl.from_grid(c("grid"), 1))


@query("etl_json_key", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def etl_json_key(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(etl.from_json_key(c("props"), "k").try_cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("etl_pivot", "SELECT user_id, max(value) FILTER (WHERE event_type = 'click') AS click, max(value) FILTER (WHERE event_type = 'view') AS view, max(value) FILTER (WHERE event_type = 'error') AS error FROM events GROUP BY user_id")
def etl_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("value"))
    return etl.keyed_rows_to_columns(rows, "user_id", "event_type", "value", ["click", "view", "error"])


@query("etl_half_year", "SELECT CAST(year(o_orderdate) AS INTEGER) AS yr, CAST(ceil(month(o_orderdate) / 6.0) AS BIGINT) AS half, count(*) AS n, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 6) AS rej_rate, round(avg(o_totalprice), 4) AS avg_amount FROM orders GROUP BY ALL")
def etl_half_year(spark, sf_dir):
    a = _applications(spark, sf_dir)
    return a.groupBy(F.year("application_dt").alias("yr"), etl.half_year(c("application_dt")).alias("half")).agg(F.count("*").alias("n"), F.round(F.avg(etl.status_flag(c("outcome"), "F")), 6).alias("rej_rate"), F.round(F.avg("amount"), 4).alias("avg_amount"))


@query("etl_stratified_sample", "SELECT o_orderkey, o_orderstatus FROM (SELECT *, count(*) OVER (PARTITION BY o_orderstatus) AS n, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS k FROM orders) WHERE k <= ceil(0.1::DOUBLE * n)")
def etl_stratified_sample(spark, sf_dir):
    return etl.stratified(table(spark, sf_dir, "orders"), "o_orderstatus", 0.1, "o_orderkey").select("o_orderkey", "o_orderstatus")


@query("join_reconcile", "SELECT count(*) AS n_left, count(*) FILTER (WHERE c_custkey IS NULL) AS n_missing, count(*) FILTER (WHERE c_nationkey = o_orderkey % 25) AS nation_ok, count(*) FILTER (WHERE abs(c_acctbal - o_totalprice) <= 1000) AS amount_ok FROM orders LEFT JOIN customer ON CAST(o_custkey + 5 AS DOUBLE) = c_custkey")
def join_reconcile(spark, sf_dir):
    o, cu = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return etl.reconcile(o, cu, (c("o_custkey") + 5).cast("double"), "c_custkey", {"nation_ok": c("c_nationkey") == c("o_orderkey") % 25, "amount_ok": F.abs(c("c_acctbal") - c("o_totalprice")) <= 1000})


@query("join_exists", "SELECT n_nationkey, n_name, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9000) AS has_rich_supplier FROM nation")
def join_exists(spark, sf_dir):
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 9000").select(c("s_nationkey").alias("n_nationkey")).distinct().withColumn("has", F.lit(True))
    return table(spark, sf_dir, "nation").join(rich, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("has", F.lit(False)).alias("has_rich_supplier"))


@query("join_enrich", "SELECT o_orderkey, p_partkey, coalesce(p_retailprice, 0) AS sc_price, CAST(ceil(coalesce(p_size, 0) / 30.0) AS BIGINT) AS sc_size FROM orders LEFT JOIN part ON CAST(floor(CAST(o_orderkey AS DOUBLE) / 10) AS BIGINT) = p_partkey")
def join_enrich(spark, sf_dir):
    o, p = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    return o.join(p, F.floor(c("o_orderkey").cast("double") / 10) == c("p_partkey"), "left").select("o_orderkey", "p_partkey", F.coalesce("p_retailprice", F.lit(0.0)).alias("sc_price"), F.ceil(F.coalesce("p_size", F.lit(0)) / 30).alias("sc_size"))


@query("join_semi", "SELECT count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def join_semi(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(c("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").join(urgent, "l_orderkey", "left_semi").agg(F.count("*").alias("n"))


@query("parity_check", """WITH a AS (SELECT o_orderpriority, avg(o_totalprice) AS m, count(*) AS k FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1), b AS (SELECT o_orderpriority, avg(o_totalprice) AS m, count(*) AS k FROM orders WHERE o_orderdate >= TIMESTAMP '1999-01-01' GROUP BY 1),
j AS (SELECT a.o_orderpriority IS NOT NULL AND b.o_orderpriority IS NOT NULL AS in_both, abs(a.m - b.m) AS m, abs(a.k - b.k)::DOUBLE AS k FROM a FULL JOIN b USING (o_orderpriority)), l AS (SELECT in_both, 'm' AS metric, m AS d FROM j UNION ALL SELECT in_both, 'k', k FROM j)
SELECT metric, CAST(count(*) FILTER (WHERE in_both) AS BIGINT) AS n_both, CAST(count(*) FILTER (WHERE NOT in_both) AS BIGINT) AS n_one_sided, round(max(d), 4) AS max_diff, coalesce(max(d) <= 1000, true) AND count(*) FILTER (WHERE NOT in_both) = 0 AS within FROM l GROUP BY metric""")
def parity_check(spark, sf_dir):
    side = lambda cond: table(spark, sf_dir, "orders").where(cond).groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("m"), F.count("*").alias("k"))
    out = etl.parity(side("o_orderdate < timestamp_ntz'1999-01-01'"), side("o_orderdate >= timestamp_ntz'1999-01-01'"), ["o_orderpriority"], ["m", "k"], 1000.0)
    return out.withColumn("max_diff", F.round("max_diff", 4))
