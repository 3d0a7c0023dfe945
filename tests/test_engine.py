"""Closed forms, brute force on small frames, planted drift, and the oracle on the small tables."""

import math
import random
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from popshift.functions import special
from popshift.operators import cart, drift, etl, evaluate as ev, generators as gen, outliers, quality, report, roles, rules as rl, scoring, trend
from popshift.plans import QUERIES, SQL

#: A folder with published trend figures, if one is given.
PUBLISHED = os.environ.get("POPSHIFT_PUBLISHED_DIR", "")


def members(spark, rows):
    return spark.createDataFrame(rows, "cand_id int, side int, y int, s double, w double")


def brute_auc(y, s):
    bad, good = [v for v, k in zip(s, y, strict=True) if k], [v for v, k in zip(s, y, strict=True) if not k]
    return sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))


def brute_ks(y, s):
    bad, good = sum(y), len(y) - sum(y)
    return max(abs(sum(k for v, k in zip(s, y, strict=True) if v <= t) / bad - sum(1 - k for v, k in zip(s, y, strict=True) if v <= t) / good) for t in s)


def test_auc_and_ks_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = []
    for cand in range(3):
        for side in (0, 1):
            for _ in range(120):
                rows.append((cand, side, int(rng.integers(0, 2)), float(np.round(rng.random(), 1)), 1.0))
    got = {r.cand_id: r for r in ev.performance(ev.score_histogram(members(spark, rows), ev.Roles())).collect()}
    for cand in range(3):
        for side, name in ((0, "dev"), (1, "mon")):
            y, s = zip(*[(r[2], r[3]) for r in rows if r[0] == cand and r[1] == side], strict=True)
            assert got[cand][f"auc_{name}"] == pytest.approx(brute_auc(y, s)) and got[cand][f"ks_{name}"] == pytest.approx(brute_ks(y, s))


def test_perfect_score_and_one_class(spark):
    rows = [(0, side, y, s, 1.0) for side in (0, 1) for y, s in zip([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9], strict=True)] + [(1, 0, 0, 0.5, 1.0), (1, 1, 0, 0.5, 1.0), (2, 0, 1, 0.5, 1.0)]
    got = {r.cand_id: r for r in ev.performance(ev.score_histogram(members(spark, rows), ev.Roles())).collect()}
    assert got[0].auc_dev == 1.0 and got[0].ks_mon == 1.0
    assert got[1].auc_dev is None and got[1].ks_dev is None
    assert 2 not in got  # one empty side: no row


def test_gates():
    assert ev.Totals(10_000, 10_000, 0.0, 0.0, 0.1).gates().min_abs == 300
    assert ev.Totals(500, 500, 0.0, 0.0, 0.1).gates().min_support == 0.30
    assert ev.Totals(10**6, 10**6, 0.0, 0.0, 0.5).gates().min_support == 0.02


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("t", 0, 0.01), ("t", 1, 0.04), ("t", 2, 0.03), ("t", 3, None), ("u", 4, 0.5)], "technique string, k int, p double")
    got = {r.k: r.q for r in scoring.benjamini_hochberg(df, "p", "q").collect()}
    assert [got[0], got[1], got[2], got[3], got[4]] == [pytest.approx(0.03), pytest.approx(0.04), pytest.approx(0.04), None, 0.5]


def test_normal_tail_and_ks_survival(spark):
    zs = [0.0, 0.1, 1.0, 1.96, 3.5, 5.0, 8.2, 9.0, -2.0]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(special.normal_two_sided(F.col("z"))).collect()]
    assert all(abs(g - math.erfc(abs(z) / math.sqrt(2))) < 1e-13 for g, z in zip(got, zs, strict=True))
    p = spark.createDataFrame([(0.0, 50, 50), (0.9, 50, 50), (0.2, 1, 50)], "d double, a long, b long").select(special.ks_survival(F.col("d"), F.col("a"), F.col("b")).alias("p")).collect()
    assert p[0].p == 1.0 and p[1].p < 1e-6 and p[2].p is None


def test_student_t():
    for dof, t, p in ((1, 12.7062, 0.975), (2, 4.30265, 0.975), (5, 2.57058, 0.975), (30, 2.04227, 0.975)):
        assert special.t_quantile(p, dof) == pytest.approx(t, abs=1e-4)
        assert special.t_cdf(t, dof) == pytest.approx(p, abs=1e-5) and special.t_cdf(-t, dof) == pytest.approx(1 - p, abs=1e-5)


def scored_row(**kw):
    base = dict(technique="t", cand_id=0, segment_definition="a", n_dev=100, n_mon=100, pct_dev=0.1, pct_mon=0.2, x_dev=10, x_mon=20, psi=0.05, br_dev=0.1, br_mon=0.2, delta_br=0.1, br_pvalue=0.01, auc_dev=0.8, auc_mon=0.7, delta_auc=-0.1, gini_dev=0.6, gini_mon=0.4, delta_gini=-0.2, ks_dev=0.5, ks_mon=0.4, delta_ks=-0.1, score_shift_pvalue=0.2, weight_dev=1.0, weight_mon=1.0, dev_weight_pct=0.1, mon_weight_pct=0.2, exposure_drift=0.1, calibration_drift=0.1, mean_feature_psi=0.1, mean_shap_shift=0.1, top_drift_feature="f", top_drift_psi=0.2, top_shap_shift_feature="g", top_shap_shift_psi=0.1)
    return base | kw


METRIC_SCHEMA = "technique string, cand_id int, segment_definition string, " + ", ".join(f"{m} {'long' if m in ('n_dev', 'n_mon', 'x_dev', 'x_mon') else 'string' if m.endswith('_feature') else 'double'}" for m in ev.METRICS)


def pool(spark, *rows):
    return spark.createDataFrame([scored_row(**r) for r in rows], METRIC_SCHEMA)


def test_scores_by_hand(spark):
    got = {r.cand_id: r for r in scoring.score(pool(spark, {}, {"cand_id": 1, "delta_auc": 0.1, "n_mon": 25, "pct_mon": 0.05}, {"cand_id": 2, "delta_auc": None, "delta_gini": None})).collect()}
    assert got[0].sis_raw == pytest.approx(0.1 * 0.2 * 0.2) and got[0].dis_raw == pytest.approx(0.1 * 0.1 * 0.2 * 1.1)
    assert got[1].sis_raw == 0 and got[1].confidence_score == 0.5 and got[1].dis_symmetric == 0  # an improvement never wins
    assert got[2].sis_raw == 0 and got[2].portfolio_impact_score == 0
    assert got[0].statistically_significant and got[0].psi_interpretation == "Population Share: Stable" and "Gini down by 0.2000" in got[0].drift_explanation
    assert got[0].severity_score == pytest.approx(20 * got[0].root_cause_score, abs=1e-3)


def test_shrinking_and_degrading_counts_symmetrically(spark):
    r = scoring.score(pool(spark, {"pct_dev": 0.3, "pct_mon": 0.2})).first()
    assert r.dis_raw == 0 and r.dis_symmetric > 0


def test_merge_keeps_the_shortest_rule(spark):
    rows = scoring.score(pool(spark, {"technique": "a", "segment_definition": "region = West"}, {"technique": "b", "cand_id": 1, "segment_definition": "Cluster_4: region != South AND age < 29.5"}, {"technique": "b", "cand_id": 2, "segment_definition": "other", "n_mon": 99}))
    got = {r.segment_definition: r.discovered_by for r in scoring.merged(rows).collect()}
    assert got == {"region = West": "a, b", "other": "b"}


def test_rules_text_and_where(spark):
    assert [rl.format_number(x) for x in (60810.0, 44.5, 1234.567, 0.1, -0.001)] == ["60,810", "44.5", "1,234.57", "0.1", "0"]
    df = spark.createDataFrame([(1, 5.0, "a"), (2, 10.0, "b'c"), (3, None, None), (4, 2.5, "d")], "k int, x double, t string")
    ps = [rl.Predicate("x", "N", 2.5, 10.0), rl.Predicate("x", "B", 2.5, 10.0), rl.Predicate("x", "M"), rl.Predicate("t", "C", values=("b'c",)), rl.Predicate("t", "X", values=("a",)), rl.Predicate("t", "I", values=("d", rl.MISSING))]
    want = [{1, 4}, {1, 2}, {3}, {2}, {2, 3, 4}, {3, 4}]
    for p, w in zip(ps, want, strict=True):
        assert {r.k for r in df.where(p.column()).collect()} == w == {r.k for r in df.where(p.where()).collect()}, p
    assert ps[0].label() == "2.5 <= x < 10" and ps[1].label() == "2.5 < x <= 10.0" and ps[2].label() == "x is Missing"


def test_dedup_drops_near_repeats(spark):
    df = spark.createDataFrame([(float(i), i % 2) for i in range(100)], "x double, z int")
    rules = [rl.Rule("t", 0, (rl.Predicate("x", "N", 0.0, 50.0),)), rl.Rule("t", 1, (rl.Predicate("x", "N", 0.0, 55.0),)), rl.Rule("t", 2, (rl.Predicate("x", "N", 10.0, 14.0),)), rl.Rule("t", 3, (rl.Predicate("x", "N", 60.0, 90.0),))]
    assert [r.cand_id for r in rl.deduplicated(df, rules)] == [0, 3]


def brute_tree(x, y, depth, min_leaf):
    """Leaves as (path, n) by trying every split."""
    def gain(l, r):
        return (l.sum() ** 2 + (1 - l).sum() ** 2) / len(l) + (r.sum() ** 2 + (1 - r).sum() ** 2) / len(r)

    def grow(rows, d):
        if d == depth or len(rows) < 2 * min_leaf or len(set(y[rows])) < 2:
            return len(rows)
        best = None
        for f in range(x.shape[1]):
            v = np.unique(x[rows, f])
            for a, b in zip(v, v[1:], strict=False):
                left = rows[x[rows, f] <= a]
                right = rows[x[rows, f] > a]
                if min(len(left), len(right)) < min_leaf:
                    continue
                g = gain(y[left], y[right])
                if best is None or g > best[0] + 1e-12:
                    best = (g, f, a / 2 + b / 2, left, right)
        return len(rows) if best is None else (best[1], best[2], grow(best[3], d + 1), grow(best[4], d + 1))

    return grow(np.arange(len(y)), 0)


def test_cart_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.random((300, 3)), 2).astype(np.float32).astype(float)
    y = ((x[:, 0] > 0.6) ^ (x[:, 1] < 0.3) ^ (rng.random(300) < 0.1)).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(x, y, strict=True)], "a double, b double, c double, y int")
    tree = cart.grow(df, ["a", "b", "c"], [1 - F.col("y"), F.col("y")], "gini", 3, 15)

    def shape(k):
        n = tree.nodes[k]
        return n.n if n.feature is None else ("abc".index(n.feature), n.threshold, shape(2 * k), shape(2 * k + 1))

    def same(a, b):
        return a == b if isinstance(a, int) or isinstance(b, int) else a[0] == b[0] and a[1] == pytest.approx(b[1]) and same(a[2], b[2]) and same(a[3], b[3])

    assert same(shape(1), brute_tree(x, y, 3, 15))
    assert sum(r["count"] for r in df.groupBy(tree.leaf()).count().collect()) == 300


def test_paths_canonicalised():
    names = {"m_x": ("x", ""), "h_r_0": ("r", "West"), "h_r_1": ("r", "East")}
    assert cart.conditions([("m_x", 5.0, ">"), ("m_x", 9.5, "<="), ("m_x", 7.0, ">")], names) == ["x >= 7", "x < 9.5"]
    assert cart.conditions([("m_x", 5.0, "<="), ("m_x", 7.0, ">")], names) is None
    assert cart.conditions([("h_r_1", 0.5, "<="), ("h_r_0", 0.5, "<=")], names) == ["r != East", "r != West"]
    assert cart.rule_text(["x >= 7", "r = West"]) == "r = West AND x >= 7" and cart.rule_text([]) == "All Customers (Root)"


@pytest.mark.parametrize("many", [500_000, 3])
def test_best_first_bins(spark, monkeypatch, many):
    """Against a plain search; with few values being many already, they are cumulated in two steps."""
    monkeypatch.setattr(cart, "MANY", many)
    rng = random.Random(8)
    hists = {f: [(v, rng.randint(0, 9), rng.randint(0, 4) + (6 if 3 < v < 7 else 0)) for v in sorted({round(rng.uniform(0, 10), 1) for _ in range(60)})] for f in "ab"}
    df = spark.createDataFrame([(f, float(v), g, b) for f, h in hists.items() for v, g, b in h], "name string, v double, g long, b long")
    bins = cart.best_first_bins(df, ["a", "b", "none"], 5, 20)

    def best(h):
        n, own, found = sum(g + b for _, g, b in h), None, None
        if n:
            own = (sum(g for _, g, _ in h) ** 2 + sum(b for _, _, b in h) ** 2) / n
        for i in range(1, len(h)):
            parts = [(sum(g for _, g, _ in p), sum(b for _, _, b in p)) for p in (h[:i], h[i:])]
            if min(map(sum, parts)) >= 20:
                gain = sum((g * g + b * b) / (g + b) for g, b in parts) - own
                if gain > 1e-12 and (found is None or gain > found[0] + 1e-9):
                    found = gain, i
        return found

    for f, h in hists.items():
        leaves = [h]
        while len(leaves) < 5 and any(map(best, leaves)):
            k = max((i for i, x in enumerate(leaves) if best(x)), key=lambda i: (best(leaves[i])[0], -i))
            i = best(leaves[k])[1]
            leaves[k : k + 1] = [leaves[k][:i], leaves[k][i:]]
        assert [b.n for b in bins[f]] == [sum(g + b for _, g, b in x) for x in leaves]
        assert [b.upper for b in bins[f][:-1]] == [pytest.approx((x[-1][0] + y[0][0]) / 2) for x, y in zip(leaves, leaves[1:], strict=False)]
    assert set(bins) == {"a", "b"}


def test_profile_and_quality_edges(spark):
    df = spark.createDataFrame([(0, float(i), 1.0, None, "a" if i % 2 else None) for i in range(40)], "side int, x double, const double, empty double, t string")
    prof = quality.profile(df, ["x", "const", "empty"], ["t"])
    got = {r.name: r for r in prof.collect()}
    assert got["x"].skewness == pytest.approx(0, abs=1e-12) and got["x"].kurtosis == pytest.approx(-1.2) and got["x"].std == pytest.approx(np.std(np.arange(40), ddof=1))
    rules = {(r.name, r.rule) for r in quality.blockers(prof, 60.0).collect()}
    assert rules == {("const", "zero_variance"), ("empty", "zero_variance"), ("empty", "high_missing"), ("t", "high_missing"), ("t", "zero_variance")}


def test_drift_of_identical_sides_is_zero(spark):
    rows = [(s, float(i % 37), "abc"[i % 3]) for s in (0, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "side int, x double, t string")
    assert drift.csi(df, ["x"]).first().csi == 0 and drift.categorical_psi(df, ["t"]).first().psi == 0 and drift.five_point_ks(df, ["x"]).first().ks_statistic == 0
    moved = df.withColumn("x", F.when(F.col("side") == 1, F.col("x") + 1000).otherwise(F.col("x")))
    assert drift.csi(moved, ["x"]).first().label == "shift" and drift.five_point_ks(moved, ["x"]).first().ks_statistic == 1.0


def test_schema_drift(spark):
    a = spark.createDataFrame([], "id long, Age int, zip string").schema
    b = spark.createDataFrame([], "ID long, age string, city string").schema
    assert {(r.name, r.change_type) for r in drift.schema_drift(spark, a, b).collect()} == {("id", "unchanged"), ("Age", "type_changed"), ("zip", "dropped"), ("city", "added")}


def test_outliers(spark):
    rng = np.random.default_rng(1)
    rows = [(side, float(v), float(n), float(f)) for side in (0, 1) for v, n, f in zip(rng.lognormal(3, 0.4, 1500), rng.normal(0, 1, 1500), rng.integers(0, 2, 1500), strict=True)] + [(1, 25.0, 50.0, 0.0)] * 60
    df = spark.createDataFrame(rows, "side int, skewed double, norm double, flag double")
    got = {(r.side, r.name): r for r in outliers.report(df, ["skewed", "norm", "flag"]).collect()}
    assert (0, "flag") not in got and got[(0, "norm")].outlier_pct < 2 and got[(0, "skewed")].outlier_pct < 5 and got[(1, "norm")].status in ("elevated", "new_range")
    fit = outliers.fences(df.where("side = 0"), ["norm"])
    assert outliers.winsorised(df, fit).agg(F.max("norm")).first()[0] < 20
    multi = outliers.multivariate(df, ["skewed", "norm"])
    share, spikes, usual = multi.agg(F.avg(F.when(F.col("side") == 0, F.col("outlier_multivariate").cast("int"))), F.avg(F.when(F.col("norm") == 50, F.col("isolation"))), F.avg(F.when(F.col("norm") < 1, F.col("isolation")))).first()
    assert share <= 0.02 and spikes < usual


def history(spark, rows):
    return spark.createDataFrame([(p, i, "t", seg, sev, rc, 0.1, 0.0, 0.0, 0.0, seg) for p, i, seg, sev, rc in rows], "period string, period_index int, technique string, segment_definition string, severity_score double, root_cause_score double, sis_raw double, dis_raw double, mean_feature_psi double, mean_shap_shift double, cand_id string")


def test_trend_gaps_and_recency(spark):
    rows = [(f"2026-0{i + 1}", i, "always", 5.0, 0.2) for i in range(6)] + [("2026-01", 0, "once", 9.0, 0.5)] + [(f"2026-0{i + 1}", i, "gap", 4.0, 0.3) for i in (0, 1, 4)]
    got = {r.segment_definition: r for r in trend.trend(trend.appearances(history(spark, rows)), 6).collect()}
    assert (got["always"].frequency, got["always"].recency_factor, got["always"].consistency_score, got["always"].trend_impact_score) == (1, 1, 1, 1)
    assert got["once"].recency_factor == pytest.approx(0.5**2.5, abs=1e-4) and got["gap"].consistency_score == pytest.approx(2 / 6, abs=1e-4) and got["gap"].appeared_in == "2026-01, 2026-02, 2026-05"


def test_forecast_breach(spark):
    rows = [(f"p{i}", i, "up", 1.0, v) for i, v in enumerate([0.2, 0.3, 0.4])] + [("p0", 0, "two", 1.0, 0.1), ("p1", 1, "two", 1.0, 0.05)] + [("p0", 0, "one", 1.0, 0.9)]
    got = {r.segment_definition: r for r in trend.forecast(history(spark, rows)).collect()}
    assert set(got) == {"up", "two"} and got["up"].months_to_breach == 1 and got["up"].early_warning and got["up"].predicted_next_root_cause_score == 0.5
    assert got["two"].confidence == "Low (2 points)" and got["two"].r_squared is None and got["two"].predicted_next_lower95 is None


@pytest.mark.skipif(not os.path.isdir(PUBLISHED), reason="the published figures aren't here")
def test_published_trend_figures(spark):
    h = spark.read.option("header", True).option("inferSchema", True).csv(f"{PUBLISHED}/*trend_history.csv")
    h = h.toDF(*[c.lower() for c in h.columns]).withColumns({"cand_id": F.col("segment_definition"), "period_index": F.col("period_index").cast("int")})
    want = {(r.Technique, r.Segment_Definition): r for r in spark.read.option("header", True).option("inferSchema", True).csv(f"{PUBLISHED}/*trend_summary.csv").collect()}
    got = {(r.technique, r.segment_definition): r for r in trend.trend(h, 6).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        for a, b in (("frequency", "Frequency"), ("recency_factor", "Recency_Factor"), ("consistency_score", "Consistency_Score"), ("trend_impact_score", "Trend_Impact_Score"), ("sis_trend", "SIS_Trend"), ("root_cause_score_trend", "Root_Cause_Score_Trend"), ("severity_score_trend", "Severity_Score_Trend")):
            assert got[k][a] == pytest.approx(w[b], abs=1e-6), (k, a)
    want = {(r.Technique, r.Segment_Definition): r for r in spark.read.option("header", True).option("inferSchema", True).csv(f"{PUBLISHED}/*trend_forecast.csv").collect()}
    got = {(r.technique, r.segment_definition): r for r in trend.forecast(h).collect()}
    for k, w in want.items():
        for a, b in (("trend_slope", "Trend_Slope"), ("r_squared", "R_Squared"), ("trend_p_value", "Trend_P_Value"), ("months_to_breach", "Months_To_Breach")):
            assert (got[k][a], w[b]) == (None, None) or (got[k][a] is not None and w[b] is not None and float(got[k][a]) == pytest.approx(float(w[b]), abs=2e-4)), (k, a, got[k], w)
        lower = next(c for c in w.asDict() if "lower95" in c.lower())
        assert (got[k]["predicted_next_lower95"] is None and w[lower] is None) or got[k]["predicted_next_lower95"] == pytest.approx(float(w[lower]), abs=2e-4)


def test_etl_patterns(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (2, "a", "z")], "id int, name string, value string")
    assert {tuple(r) for r in etl.keyed_rows_to_columns(df, "id", "name", "value", ["a", "b"]).collect()} == {(1, "x", "y"), (2, "z", None)}
    g = spark.createDataFrame([("n", 3)], "a string, b int").select(etl.to_grid(["a", "b"], F.col("a"), F.col("b")).alias("g"))
    assert g.first().g == '[{"metadata":["a","b"]},{"data":[["n","3"]]}]' and g.select(etl.from_grid(F.col("g"), 1)).first()[0] == "3"
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, m double")
    r = etl.parity(a, a.where("k = 1").withColumn("m", F.col("m") + 0.5), ["k"], ["m"], 0.1).first()
    assert (r.n_both, r.n_one_sided, r.max_diff, r.within) == (1, 1, 0.5, False)


def test_roles(spark):
    rows = [(i, i % 2, (i * 37 % 101) / 101, float(i), float(i % 30) + 0.5, "NS"[i % 2], 0.1, f"2020-{i % 12 + 1:02d}") for i in range(200)]
    df = spark.createDataFrame(rows, "customer_id int, default_flag int, pd_score double, ead double, age double, region string, shap_age double, month string")
    assert {k: v[0] for k, v in roles.detect(df).items()} == {"customer_id": "id", "default_flag": "target", "pd_score": "score", "ead": "weight", "age": "numeric", "region": "categorical", "shap_age": "shap", "month": "time"}
    with pytest.raises(ValueError):
        roles.detect(df.select("age", "region"))
    out = roles.strict(df.withColumn("c", F.lit(1.0)), df.withColumn("region", F.lit(1)), roles.detect(df) | {"c": ("numeric", "number")})
    assert out["region"] == ("excluded", "another type in monitoring") and out["c"] == ("excluded", "not in monitoring")


def test_kpis_and_routing(spark):
    rows = scoring.score(pool(spark, {}, {"cand_id": 1, "delta_gini": -0.9, "br_pvalue": 0.9, "score_shift_pvalue": 0.9}))
    got = {r.kpi_id: r.kpi_value for r in report.kpis(rows).collect()}
    assert got["rca_max_gini_drop"] == pytest.approx(0.2) and got["rca_n_significant"] == 1
    assert report.route("why did the PSI drift?") == ["data_drift", "segments"] and len(report.route("hello")) == 3


def test_planted_drift_is_found(spark, sf):
    first = QUERIES["segment_ranking"](spark, sf).first()
    assert first.segment_definition == "c_mktsegment = BUILDING" and first.delta_br > 0.2
    pop = __import__("popshift.sources.population", fromlist=["population"]).population(spark, sf)
    cfg = gen.SearchConfig(max_combo_depth=1, numeric_bins=2)
    metrics, found = gen.beam_search(pop, ev.Roles(numeric=("l_quantity",), categorical=("c_mktsegment",)), cfg)
    assert gen.top_segments(pop, metrics, found, cfg).orderBy("rank").first().segment_definition == "c_mktsegment = BUILDING"


def test_searches_are_registered_with_full_settings():
    from popshift.plans import search
    from popshift.sources import population as p

    assert gen.SearchConfig() == search.CFG
    assert {*search.ROLES.numeric, *search.ROLES.categorical} == {*p.NUMERIC, *p.LOW_CARD, *p.CATEGORICAL}


def test_binning_finds_a_change_of_calibration_alone(spark):
    """Monitoring scores are higher by a constant: order, bad rate and KS stay."""
    rows = [(side, int((i * 37) % 100 < i % 100), (i % 100) / 200 + 0.25 * side, 1.0, g) for side in (0, 1) for g in "abcd" for i in range(300)]
    df = spark.createDataFrame(rows, "side int, y int, s double, w double, g string")
    roles = ev.Roles(categorical=("g",))
    got = gen.feature_binning(df, roles, gen.SearchConfig(n_iter=40)).collect()
    assert got and all(r.significant and r.ece_p_adj < 0.05 and r.auc_p_adj > 0.1 and r.br_p_adj > 0.1 and r.ks_p_adj > 0.1 for r in got)


def test_adjusted_rand_and_quality(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (1, 0)], "a int, b int")
    tables = [{(r["a"], r["x"]): r["n"] for r in df.groupBy("a", x.alias("x")).agg(F.count("*").alias("n")).collect()} for x in (F.col("b"), F.col("a") % 1)]
    assert gen.adjusted_rand(tables[0]) == 1.0 and gen.adjusted_rand(tables[1]) == 0.0
    pts = [([0.0, 0.0], 0), ([0.0, 1.0], 0), ([10.0, 0.0], 1), ([10.0, 1.0], 1)]
    x, label, centres = np.array([p[0] for p in pts]), np.array([p[1] for p in pts]), np.array([[0.0, 0.5], [10.0, 0.5]])
    d = ((x - centres[label]) ** 2).sum(axis=1)
    q = {"silhouette": gen.silhouette(x, label)} | gen.spread_quality(centres, np.bincount(label).astype(float), float(d.sum()), np.array([np.sqrt(d[label == i]).mean() for i in (0, 1)]))
    assert q["silhouette"] > 0.85 and q["calinski_harabasz"] == pytest.approx(200.0) and q["davies_bouldin"] == pytest.approx(0.1)


def test_sources(spark, tmp_path):
    from popshift.sources import tables

    df = spark.createDataFrame([(1, "2020-01-02 03:04:05", "7")], "a int, t string, n string")
    tables.write_result(df, str(tmp_path / "x.csv"), "csv")
    got = tables.typed_csv(spark, str(tmp_path / "x.csv"), "a int, t string, n string", {"t": "yyyy-MM-dd HH:mm:ss"}, {"n": "m"})
    assert got.columns == ["a", "t", "m"] and str(got.first().t) == "2020-01-02 03:04:05"
    ref = tables.reference(spark, str(tmp_path / "ref"), df, bootstrap=True)
    assert ref.count() == 1 and tables.aligned(df, spark.createDataFrame([], "N long").schema).schema["n"].dataType.simpleString() == "bigint"
    with pytest.raises(Exception, match="(?i)exists"):
        tables.save_reference(df, str(tmp_path / "ref"))
    assert tables.labelled(df, {"a": "key"}).schema["a"].metadata == {"comment": "key"} and tables.kpi_row(spark, "k", None).first().success == "N"


def test_every_sql_twin_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_calibration_finds_the_curve(spark):
    from popshift.operators import calibration

    rng = np.random.default_rng(4)
    rows = []
    for side, a, b in ((0, -1.0, 2.0), (1, -0.5, 3.0)):
        s = np.round(rng.random(6000), 3)
        y = rng.random(6000) < 1 / (1 + np.exp(-(a + b * s)))
        rows += [(side, int(k), float(v), "g") for k, v in zip(y, s, strict=True)]
    rows += [(side, 0, 0.5, "one class") for side in (0, 1)]
    got = {r.seg: r for r in calibration.calibration_shift(spark.createDataFrame(rows, "side int, y int, s double, seg string"), ev.Roles(), "seg").collect()}
    assert got["g"].dev_slope == pytest.approx(2.0, abs=0.35) and got["g"].mon_intercept == pytest.approx(-0.5, abs=0.2) and got["one class"].dev_intercept is None


def test_technique_plug_in(spark, sf):
    from popshift.operators import runner
    from popshift.sources.population import population

    class Broken(runner.Technique):
        name = "Broken"

        def run(self, df, roles, cfg):
            raise ValueError("no")

    runner.register(Broken())
    cfg = gen.SearchConfig(tree_depth=1, min_leaf=0.2)
    out = runner.benchmark(population(spark, sf), ev.Roles(numeric=("l_quantity", "p_size")), cfg, ["Drift Tree", "Broken"])
    assert {r.technique: r.status[:6] for r in out["run_log"].collect()} == {"Drift Tree": "OK", "Broken": "FAILED"}
    assert {r.technique for r in out["segments"].collect()} <= {"Drift Tree"}
    del runner.TECHNIQUES["Broken"]


def test_benchmark_names_every_technique(spark, sf, monkeypatch):
    from popshift.operators import runner
    from popshift.plans import search

    assert list(runner.TECHNIQUES) == ["Beam Search", "Drift Tree", "Gradient Boosting", "K-Means", "Feature Binning"]
    late = runner._Function("Late", lambda df, roles, cfg: gen.drift_tree(df, roles, cfg)[0].withColumn("x", F.raise_error(F.lit("late"))))
    monkeypatch.setattr(runner.scoring, "portfolio_view", lambda *_: None)
    monkeypatch.setattr(runner, "TECHNIQUES", {"Late": late, **{k: runner.TECHNIQUES[k] for k in ("Drift Tree", "Feature Binning")}})
    monkeypatch.setattr(search, "ROLES", ev.Roles(numeric=("l_quantity",), categorical=("c_mktsegment",)))
    monkeypatch.setattr(search, "CFG", gen.SearchConfig(tree_depth=1, n_iter=2, bootstrap_top_n=2))
    got = {r.technique: r for r in search.technique_benchmark(spark, sf).collect()}
    assert set(got) == {"Late", "Drift Tree", "Feature Binning"}
    assert got["Late"].status.startswith("FAILED") and got["Drift Tree"].status == got["Feature Binning"].status == "OK"
    assert got["Late"].segments_generated is None and got["Feature Binning"].segments_generated > 0


def test_fences_of_negative_and_few_valued_columns(spark):
    """The limit of shares and percentages is for columns without negative values; given limits hold without fences."""
    df = spark.createDataFrame([(side, float(i - 50), float(i % 100), float(i % 3)) for side in (0, 1) for i in range(141)], "side int, signed double, percent double, few double")
    cfg = outliers.OutlierConfig(valid_ranges={"few": (0, 1), "percent": (0, None)})
    fit = {r.name: r for r in outliers.fences(df.where("side = 0"), ["signed", "percent", "few"], cfg).collect()}
    assert fit["signed"].dev_min == -50 and fit["signed"].upper > 100 and fit["percent"].upper == 100
    assert (fit["few"].method, fit["few"].lower, fit["few"].upper, fit["few"].dev_max) == ("valid_range", 0.0, 1.0, 2.0) and fit["percent"].method.endswith("+valid_range")
    found = {(r.side, r.name): r for r in outliers.report(df, ["signed", "percent", "few"], cfg).collect()}
    assert found[0, "few"].status == "range_violation" and found[0, "few"].range_violations == 47


def test_confidence_and_fallback_root_cause_score(spark):
    df = spark.createDataFrame([(0.2, 0.01, 2.0, 0.3), (None, float("nan"), None, 0.1)], "p_br double, p_ks double, severity_score double, top_drift_psi double")
    assert [r[0] for r in df.select(scoring.drift_confidence()).collect()] == [0.99, 0.0]
    assert [r.root_cause_score for r in scoring.with_root_cause_score(df).collect()] == [0.6, 0.0]
    given = df.withColumn("root_cause_score", F.lit(5.0))
    assert {r.root_cause_score for r in scoring.with_root_cause_score(given).collect()} == {5.0}
    assert {r.root_cause_score for r in scoring.with_root_cause_score(df.select("p_br")).collect()} == {0.0}


def test_standard_names_and_bundle(spark, tmp_path):
    from popshift.operators.scoring import SCORED
    from popshift.sources import results

    df = spark.createDataFrame([("a", 0.5, 0.6, 7, True, 1.0, 2.0, "x")], "segment string, Dev_AUC double, Mon_Gini double, Mon_Count long, Significant boolean, final_score double, Overall_Score double, Other string")
    out = results.standardised(df, "T")
    assert out.columns == ["segment_definition", "auc_dev", "gini_mon", "n_mon", "statistically_significant", "severity_score", "Overall_Score", "other", "technique"] and out.first().technique == "T"
    assert {results.standard_name(x) for x in ("PSI", "Delta_BR", "ks_dev", "Dev_Pct", "EAD_Mon", "Exposure_Pct", "Root_Cause_PSI")} == {"psi", "delta_br", "ks_dev", "pct_dev", "weight_mon", "mon_weight_pct", "top_drift_psi"}
    assert set(ev.METRICS) | set(SCORED) <= set(results.MEANING)
    blocked = tmp_path / "blocked"
    blocked.write_text("a file where the folder should be")
    paths = results.write_bundle({"segments": out.drop("Overall_Score")}, str(tmp_path)) | results.write_bundle({"b": out.select("technique")}, str(tmp_path), "parquet")
    assert spark.read.option("header", True).csv(paths["segments"]).first().segment_definition == "a"
    assert spark.read.parquet(paths["b"]).schema["technique"].metadata == {"comment": "What found the segment"}


def test_binned_error_equals_a_plain_version(spark):
    rng = random.Random(3)
    rows = [(side, rng.randint(0, 1), rng.uniform(-0.1, 1.1)) for side in (0, 1) for _ in range(200)] + [(0, 1, 0.5), (0, 0, 0.25)]
    edges = [0.0, 0.25, 0.5, 1.0]
    df = spark.createDataFrame([(1, *r) for r in rows], "cand_id int, side int, y int, s double")
    for r in gen.binned_error(df, ev.Roles(weight=None), edges).collect():
        own = [(y, s) for side, y, s in rows if side == r.side]
        at = np.clip(np.digitize([s for _, s in own], edges) - 1, 0, 2)
        want = sum(abs(sum(s - y for (y, s), b in zip(own, at, strict=True) if b == k)) for k in range(3)) / len(own)
        assert r.ece == pytest.approx(want)


def test_bootstrap_takes_further_measures(spark):
    rows = [(side, int(i % 10 < 3 + 3 * side), (i % 50) / 50, "ab"[i % 2]) for side in (0, 1) for i in range(400)]
    df = spark.createDataFrame(rows, "side int, y int, s double, g string")
    rules = [rl.Rule("t", 0, (rl.Predicate("g", "C", values=("a",)),))]
    extra = {"rows": F.col("n_mon") - F.col("n_dev")}
    roles_ = ev.Roles(weight=None)
    got = {r.metric: r for r in gen.bootstrap(df, rules, roles_, gen.SearchConfig(n_iter=60), extra).collect()}
    assert set(got) == {"auc", "gini", "ks", "br", "ece", "rows"} and got["br"].p == 0 and got["br"].lower < 0.2 < got["br"].upper and got["rows"].lower < 0 < got["rows"].upper
    again = {r.metric: r for r in gen.bootstrap(df.repartition(7), rules, roles_, gen.SearchConfig(n_iter=60), extra).collect()}
    assert {k: (v.lower, v.upper) for k, v in again.items()} == {k: (pytest.approx(v.lower), pytest.approx(v.upper)) for k, v in got.items()}
