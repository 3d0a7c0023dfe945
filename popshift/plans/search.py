"""Candidate generation queries: predicates, membership, trees, boosting, clusters, supervised bins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from popshift.operators import cart, evaluate as ev, generators as gen, rules as rl, scoring
from popshift.plans.monitoring import long_sql
from popshift.plans.registry import query, rounded
from popshift.plans.segments import MEMBERS_SQL, technique_rules
from popshift.sources.population import CATEGORICAL, LOW_CARD, NUMERIC, POP_SQL, population
from popshift.sources.staging import discard, staged

c = F.col
ROLES = ev.Roles(numeric=tuple(NUMERIC), categorical=(*CATEGORICAL, *LOW_CARD))
CFG = gen.SearchConfig()


def searched(spark, sf_dir, search) -> DataFrame:
    """What search(population) finds, written. Searches run many jobs over the population: it is joined and written once, and
    takes no memory of the executors, which their Python workers need."""
    pop = staged(population(spark, sf_dir), "population")
    try:
        return staged(search(pop), "search")
    finally:
        discard(pop)


@query("membership_counts", f"WITH {POP_SQL}, {MEMBERS_SQL} SELECT seg AS segment_definition, side, count(*) AS n, CAST(sum(y) AS BIGINT) AS events FROM mem GROUP BY ALL")
def membership_counts(spark, sf_dir):
    """One scan: each row is exploded to the candidates that it fits."""
    pop = population(spark, sf_dir)
    rules = technique_rules(pop)
    names = spark.createDataFrame([(r.cand_id, r.label()) for r in rules], "cand_id int, segment_definition string")
    m = rl.members(pop, rules, ["side", "y"]).groupBy("cand_id", "side").agg(F.count("*").alias("n"), F.sum("y").alias("events"))
    return m.join(F.broadcast(names), "cand_id").select("segment_definition", "side", "n", "events")


@query("membership_where_text", f"WITH {POP_SQL}, {MEMBERS_SQL} SELECT seg AS segment_definition, count(*) AS n FROM mem WHERE technique = 'categorical' GROUP BY ALL")
def membership_where_text(spark, sf_dir):
    """The same counts from the rules' executable WHERE text."""
    pop = population(spark, sf_dir)
    rules = [r for r in technique_rules(pop) if r.technique == "categorical"]
    hits = pop.select(F.explode(F.array_compact(F.array(*[F.when(F.expr(r.where()), F.lit(r.label())) for r in rules]))).alias("segment_definition"))
    return hits.groupBy("segment_definition").agg(F.count("*").alias("n"))


@query("rule_rows")
def rule_rows(spark, sf_dir):
    return rl.rule_table(spark, technique_rules(population(spark, sf_dir)))


@query("conjunctions", f"WITH {POP_SQL} SELECT 'c_mktsegment = ' || c_mktsegment || ' AND o_orderpriority = ' || o_orderpriority AS segment_definition, count(*) FILTER (WHERE side = 0) AS n_dev, count(*) FILTER (WHERE side = 1) AS n_mon, round(avg(y) FILTER (WHERE side = 1) - avg(y) FILTER (WHERE side = 0), 6) AS delta_br FROM pop GROUP BY 1")
def conjunctions(spark, sf_dir):
    pop = population(spark, sf_dir)
    preds = rl.atomic_predicates(pop.where("side = 0"), [], ["c_mktsegment", "o_orderpriority"])
    rules = [rl.Rule("pairs", i, pq) for i, pq in enumerate((p, q) for p in preds["c_mktsegment"] for q in preds["o_orderpriority"])]
    names = spark.createDataFrame([(r.cand_id, r.label()) for r in rules], "cand_id int, segment_definition string")
    on = lambda s, x: F.when(c("side") == s, x)
    m = rl.members(pop, rules, ["side", "y"]).groupBy("cand_id").agg(F.count(on(0, F.lit(1))).alias("n_dev"), F.count(on(1, F.lit(1))).alias("n_mon"), F.round(F.avg(on(1, c("y"))) - F.avg(on(0, c("y"))), 6).alias("delta_br"))
    return m.join(F.broadcast(names), "cand_id").drop("cand_id")


_NUMBERED = "(SELECT *, row_number() OVER (ORDER BY l_quantity) AS rid FROM pop WHERE side = 1)"


@query("overlap_pairs", f"""WITH {POP_SQL}, num AS {_NUMBERED}, x AS (SELECT rid, 'c_mktsegment = ' || c_mktsegment AS seg FROM num UNION ALL SELECT rid, 'o_orderpriority = ' || o_orderpriority FROM num UNION ALL SELECT rid, 'l_linestatus = ' || l_linestatus FROM num)
SELECT a.seg AS a, b.seg AS b, count(*) AS n FROM x a JOIN x b ON a.rid = b.rid AND a.seg <= b.seg GROUP BY ALL""")
def overlap_pairs(spark, sf_dir):
    """Rows that two candidates share, counted within rows instead of by a self-join."""
    pop = population(spark, sf_dir)
    rules = rl.atomic_rules(rl.atomic_predicates(pop.where("side = 0"), [], ["c_mktsegment", "o_orderpriority", "l_linestatus"]))
    names = {r.cand_id: r.label() for r in rules}
    label = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    o = rl.overlaps(pop.where("side = 1"), rules)
    return o.select(F.least(label[c("a")], label[c("b")]).alias("a"), F.greatest(label[c("a")], label[c("b")]).alias("b"), "n")


@query("calibration_error", f"""WITH {POP_SQL}, h AS (SELECT c_mktsegment AS segment, side, least(1.0, greatest(0.0, s)) AS s, y FROM pop), q AS (SELECT segment, side, list_sort(list_distinct(quantile_cont(s, [0.0::DOUBLE, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])))[2:-2] AS e, count(*) AS total FROM h GROUP BY ALL),
b AS (SELECT segment, side, len(list_filter(e, lambda x: x < s)) AS bin, count(*) AS n, sum(y) AS y, sum(s) AS sy, any_value(total) AS total FROM h JOIN q USING (segment, side) GROUP BY ALL) SELECT segment, side, round(sum(n / total * abs(sy / n - y / n)), 6) AS ece FROM b GROUP BY ALL""")
def calibration_error(spark, sf_dir):
    m = population(spark, sf_dir).select("side", "y", "s", c("c_mktsegment").alias("segment"))
    return rounded(gen.ece(m, ROLES, "segment"))


_STRENGTH = f"""n AS (SELECT name, v, y FROM ({long_sql(NUMERIC, 'DOUBLE').replace('SELECT side,', 'SELECT side, y,')}) WHERE side = 0 AND v IS NOT NULL), t AS (SELECT name, coalesce(v, '__MISSING__') AS v, y FROM ({long_sql([*CATEGORICAL, *LOW_CARD], 'VARCHAR').replace('SELECT side,', 'SELECT side, y,')}) WHERE side = 0),
k AS (SELECT name, v, avg(y) AS r, sum(y) AS b, sum(1 - y) AS g FROM t GROUP BY ALL), h AS (SELECT name, v, sum(y) AS b, sum(1 - y) AS g FROM n GROUP BY ALL UNION ALL SELECT name, r AS v, sum(b), sum(g) FROM k GROUP BY name, r),
u AS (SELECT *, sum(g) OVER (PARTITION BY name ORDER BY v) AS cg FROM h)"""


@query("feature_strength", f"WITH {POP_SQL}, {_STRENGTH} SELECT name, round(coalesce(abs(sum(b * (cg - g / 2)) / nullif(sum(b) * sum(g), 0) - 0.5), 0), 6) AS strength FROM u GROUP BY name")
def feature_strength(spark, sf_dir):
    return rounded(gen.feature_strength(population(spark, sf_dir), ev.Roles(numeric=tuple(NUMERIC), categorical=(*CATEGORICAL, *LOW_CARD))))


@query("column_screen", f"WITH {POP_SQL}, {_STRENGTH}, a AS (SELECT name, coalesce(abs(sum(b * (cg - g / 2)) / nullif(sum(b) * sum(g), 0) - 0.5), 0) AS target_strength FROM u GROUP BY name), n2 AS (SELECT name, v, side FROM ({long_sql(NUMERIC, 'DOUBLE')}) WHERE v IS NOT NULL), t2 AS (SELECT name, coalesce(v, '__MISSING__') AS v, side FROM ({long_sql([*CATEGORICAL, *LOW_CARD], 'VARCHAR')})), k2 AS (SELECT name, v, avg(side) AS r, sum(side) AS b, sum(1 - side) AS g FROM t2 GROUP BY ALL), h2 AS (SELECT name, v, sum(side) AS b, sum(1 - side) AS g FROM n2 GROUP BY ALL UNION ALL SELECT name, r, sum(b), sum(g) FROM k2 GROUP BY name, r), u2 AS (SELECT *, sum(g) OVER (PARTITION BY name ORDER BY v) AS cg FROM h2), d AS (SELECT name, coalesce(abs(sum(b * (cg - g / 2)) / nullif(sum(b) * sum(g), 0) - 0.5), 0) AS drift_strength FROM u2 GROUP BY name) SELECT name, round(target_strength, 6) AS target_strength, round(drift_strength, 6) AS drift_strength, round(greatest(target_strength, drift_strength), 6) AS strength FROM a JOIN d USING (name)")
def column_screen(spark, sf_dir):
    """How well each column tells bad from good, and monitoring from baseline."""
    pop = population(spark, sf_dir)
    roles = ev.Roles(numeric=tuple(NUMERIC), categorical=(*CATEGORICAL, *LOW_CARD))
    t = gen.feature_strength(pop, roles).withColumnRenamed("strength", "target_strength")
    d = gen.feature_strength(pop.withColumn("y", c("side")).withColumn("side", F.lit(0)), roles).withColumnRenamed("strength", "drift_strength")
    return rounded(t.join(d, "name").withColumn("strength", F.greatest("target_strength", "drift_strength")))


_X = " UNION ALL ".join(f"SELECT {i} AS f, {f}::FLOAT::DOUBLE AS x, side FROM pop" for i, f in enumerate(("l_quantity", "p_size", "p_retailprice", "w")))


@query("tree_first_split", f"""WITH {POP_SQL}, l AS (SELECT f, x, count(*) AS n, sum(1 - side) AS t0, sum(side) AS t1 FROM ({_X}) GROUP BY ALL), d AS (SELECT f, x, lead(x) OVER u AS nx, sum(n) OVER u AS nl, sum(t0) OVER u AS l0, sum(t1) OVER u AS l1, sum(n) OVER (PARTITION BY f) AS na, sum(t0) OVER (PARTITION BY f) AS a0, sum(t1) OVER (PARTITION BY f) AS a1 FROM l WINDOW u AS (PARTITION BY f ORDER BY x)),
g AS (SELECT f, x / 2 + nx / 2 AS threshold, (l0 * l0 + l1 * l1) / nl + ((a0 - l0) * (a0 - l0) + (a1 - l1) * (a1 - l1)) / (na - nl) AS gain FROM d WHERE nx - x > 1e-7 AND nl >= 50 AND na - nl >= 50) SELECT f AS feature, round(threshold, 6) AS threshold FROM g ORDER BY gain DESC, f, threshold LIMIT 1""")
def tree_first_split(spark, sf_dir):
    names = ["l_quantity", "p_size", "p_retailprice", "w"]
    tree = cart.grow(population(spark, sf_dir), names, [1 - c("side"), c("side")], "gini", 1, 50)
    root = tree.nodes[1]
    return rounded(spark.createDataFrame([(names.index(root.feature), root.threshold)] if root.feature else [], "feature int, threshold double"))


def _shown(found: DataFrame) -> DataFrame:
    return scoring.ranked(scoring.score(found)).select(_SHOWN)


_SHOWN = ["technique", "segment_definition", "n_dev", "n_mon", "psi", "delta_br", "delta_gini", "statistically_significant", "severity_score", "rank"]


@query("beam_search")
def beam_search(spark, sf_dir):
    return searched(spark, sf_dir, lambda pop: gen.top_segments(pop, *gen.beam_search(pop, ROLES, CFG), CFG).select(_SHOWN))


@query("drift_tree")
def drift_tree(spark, sf_dir):
    return searched(spark, sf_dir, lambda pop: _shown(gen.drift_tree(pop, ROLES, CFG)[0]))


@query("gradient_boosting")
def gradient_boosting(spark, sf_dir):
    return searched(spark, sf_dir, lambda pop: _shown(gen.boosting(pop, ROLES, CFG)[0]))


@query("kmeans_clusters")
def kmeans_clusters(spark, sf_dir):
    return searched(spark, sf_dir, lambda pop: gen.clusters(pop, ROLES, CFG)[0].select("technique", "segment_definition", "n_dev", "n_mon", "psi", "delta_br", "delta_gini", "rule_precision", "rule_recall"))


@query("supervised_bins")
def supervised_bins(spark, sf_dir):
    return searched(spark, sf_dir, lambda pop: rl.rule_table(spark, gen.supervised_rules(pop, ROLES, CFG)).drop("where_text"))


@query("feature_binning")
def feature_binning(spark, sf_dir):
    return searched(spark, sf_dir, lambda pop: gen.feature_binning(pop, ROLES, replace(CFG, top_n=20, resampling="multinomial")).select("technique", "segment_definition", "n_dev", "n_mon", "psi", "delta_br", "delta_gini", "delta_ece", "auc_p_adj", "ks_p_adj", "br_p_adj", "ece_p_adj", "min_p_adj", "significant", "deterioration_score", "final_score", "rank"))


@query("bootstrap_intervals")
def bootstrap_intervals(spark, sf_dir):
    """Intervals of each market segment's changes from resamples of n rows out of n, on both sides."""
    def search(pop):
        rules = rl.atomic_rules(rl.atomic_predicates(pop.where("side = 0"), [], ["c_mktsegment"]))
        named = spark.createDataFrame([(r.cand_id, r.label()) for r in rules], "cand_id int, segment_definition string")
        found = gen.bootstrap(pop, rules, ROLES, replace(CFG, resampling="multinomial"))
        return found.join(F.broadcast(named), "cand_id").select("segment_definition", "metric", "lower", "upper", "p")

    return searched(spark, sf_dir, search)


@query("calibration_shift")
def calibration_shift(spark, sf_dir):
    """Logistic calibration of the score by segment, on both sides."""
    from popshift.operators import calibration

    return rounded(calibration.calibration_shift(population(spark, sf_dir), ROLES, "c_mktsegment"), 5)


@query("technique_benchmark")
def technique_benchmark(spark, sf_dir):
    """All techniques over one comparison with their tuned settings, compared: the setting taken, and a technique that failed has
    a row that says so."""
    from popshift.operators import runner

    def search(pop):
        out = runner.benchmark(pop, ROLES, CFG)
        log = out["run_log"].drop("seconds")
        return log.join(out["comparison"], "technique", "left") if "comparison" in out else log

    return searched(spark, sf_dir, search)


@query("shap_detail", f"""WITH {POP_SQL}, m AS (SELECT c_mktsegment AS segment, side, shap_quantity, shap_discount, shap_segment FROM pop), u AS (SELECT segment, side, 'shap_quantity' AS name, shap_quantity AS v FROM m UNION ALL SELECT segment, side, 'shap_discount', shap_discount FROM m UNION ALL SELECT segment, side, 'shap_segment', shap_segment FROM m)
SELECT segment, name, round(avg(v) FILTER (WHERE side = 1) - avg(v) FILTER (WHERE side = 0), 6) AS delta FROM u GROUP BY ALL""")
def shap_detail(spark, sf_dir):
    """Attribution shift by segment."""
    from popshift.sources.population import SHAP

    m = population(spark, sf_dir).withColumn("cand_id", c("c_mktsegment"))
    d = ev.feature_drift(staged(ev.value_counts(m, ev.Roles(shap=tuple(SHAP))), "counts"))
    return rounded(d.select(c("cand_id").alias("segment"), "name", "delta"))
