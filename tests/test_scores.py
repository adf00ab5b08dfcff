import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlens.functions import levels
from ledgerlens.functions.prefix import global_percentiles, running_totals
from ledgerlens.operators import fairness, scoring

few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def scores(spark, rows):
    return spark.createDataFrame([(i, y, float(s)) for i, (y, s) in enumerate(rows)], "user_id long, status int, risk_score double")


def test_level_ends(spark):
    df = scores(spark, [(0, 0.2), (0, 0.4)])
    right = [r[0] for r in df.select(levels.risk_level(F.col("risk_score"))).collect()]
    left = [r[0] for r in df.select(levels.level_at_least(F.col("risk_score"))).collect()]
    assert right == [levels.LEVELS[0], levels.LEVELS[1]]
    assert left == [levels.LEVELS[1], levels.LEVELS[2]]


@few
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.8, 1.0])), min_size=4, max_size=40))
def test_pr_threshold_reproduces_its_f1(spark, rows):
    if not any(y for y, _ in rows):
        rows = [(1, 0.5), *rows]
    best = scoring.best_threshold(scoring.pr_curve(scores(spark, rows))).first()
    t = best["threshold"]
    tp = sum(y == 1 and s >= t for y, s in rows)
    fp = sum(y == 0 and s >= t for y, s in rows)
    assert (best["tp"], best["fp"]) == (tp, fp)

    def f1(t):
        tp = sum(y == 1 and s >= t for y, s in rows)
        n = sum(s >= t for _, s in rows)
        p = sum(y for y, _ in rows)
        return 2 * tp / (n + p)

    assert best["f_beta"] == pytest.approx(max(f1(s) for _, s in rows), abs=1e-6)


@few
@given(st.lists(st.tuples(st.integers(0, 1), st.floats(0, 1)), min_size=6, max_size=40))
def test_auc_equals_pair_counting(spark, rows):
    rows = [(1, 0.3), (0, 0.7), *rows]
    pos = [s for y, s in rows if y]
    neg = [s for y, s in rows if not y]
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert scoring.binary_metrics(scores(spark, rows)).first()["auc_roc"] == pytest.approx(pairs)


def test_running_totals_across_ranges(spark):
    df = spark.range(5000).select(F.floor(F.sqrt("id")).cast("double").alias("x"), F.lit(1).alias("n"))
    got = running_totals(df, "x", ["n"], descending=False, ranges=16).orderBy("x").collect()
    total = 0
    for r in got:
        total += r["n"]
        assert r["cum_n"] == total
    assert total == 5000


def test_global_percentiles(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 2, 10]], "x double")
    got = {r["name"]: r["x"] for r in global_percentiles(df, "x", {"a": 0.5, "b": 0.9, "c": 1.0}).collect()}
    assert got == pytest.approx({"a": 2.0, "b": 6.8, "c": 10.0})


def test_threshold_sweep_counts(spark):
    rows = [(1, 0.05), (0, 0.5), (1, 0.94), (0, 0.01)]
    sweep = {round(r["threshold"], 2): r for r in scoring.threshold_sweep(scores(spark, rows)).collect()}
    assert len(sweep) == 90
    assert (sweep[0.05]["tp"], sweep[0.05]["fp"]) == (2, 1)
    assert (sweep[0.94]["tp"], sweep[0.94]["fp"], sweep[0.94]["total_cost"]) == (1, 0, 10)


def test_tiered_middle_band_includes_ends(spark):
    df = spark.createDataFrame([(1, 0.3, 0.9)], "user_id long, m double, s double")
    row = scoring.fuse_scores(df, "m", "s").where("strategy = 'tiered'").first()
    assert row["hybrid_score"] == pytest.approx(0.3 * 0.6 + 0.9 * 0.4)


def test_one_group_attribute_fails_with_no_ratio(spark):
    rows = [(0, 40.0, 0, 0, 1, 1), (0, 41.0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, "is_female int, age double, is_high_risk_career int, is_high_risk_income int, status int, predicted int")
    out = {r["attribute"]: r for r in fairness.fairness_judgments(fairness.fairness_gaps(fairness.fairness_groups(df))).collect()}
    assert out["age"]["dpd"] is None and out["age"]["demographic_parity"] == "FAIL"
    assert out["age"]["disparate_impact_judgment"] == "N/A" and out["age"]["overall"] == "FAIL"


@few
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(18, 90), st.integers(0, 1), st.integers(0, 1)), min_size=3, max_size=25))
def test_fairness_gaps_are_shares(spark, rows):
    df = spark.createDataFrame([(f, float(a), 0, 1, y, p) for f, a, y, p in rows],
                               "is_female int, age double, is_high_risk_career int, is_high_risk_income int, status int, predicted int")
    for r in fairness.fairness_gaps(fairness.fairness_groups(df)).collect():
        for c in ("dpd", "tpr_gap", "fpr_gap", "precision_gap", "disparate_impact"):
            assert r[c] is None or 0 <= r[c] <= 1


def test_reports_join_the_transfers_once(spark, sf_dir, monkeypatch):
    """The scores of the reports come from the written transfers of the mart, not from the raw tables again, and are those of ``scored``."""
    from ledgerlens.operators import explain
    from ledgerlens.plans import all_queries
    from ledgerlens.plans.common import scored

    seen = []
    for name in ("predict_reports", "risk_report"):
        monkeypatch.setattr(explain, name, lambda scores, *rest: seen.append(scores) or scores)
    for name in ("predict_reports", "risk_report_with_changes"):
        all_queries()[name].run(spark, sf_dir)
    assert len(seen) == 2
    for scores in seen:
        assert not [f for f in scores.inputFiles() if "lineitem" in f or "orders" in f]
    want = sorted(map(tuple, scored(spark, sf_dir).collect()))
    assert [sorted(map(tuple, s.collect())) for s in seen] == [[r for r in want if r[0] % 5 == 0], want]
