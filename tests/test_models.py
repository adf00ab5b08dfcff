import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import anomaly, explain, models, neighbors


def vectors(spark, x, name):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], f"{name} long, vec array<double>")


def test_knn_matches_brute_force_in_crowded_cells(spark, monkeypatch):
    # tiny blocks and shards, and a third of the references in one spot
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 40)
    monkeypatch.setattr(neighbors, "SHARD_ROWS", 50)
    rng = np.random.default_rng(1)
    refs = np.vstack([rng.normal(size=(200, 3)), rng.normal(scale=1e-3, size=(100, 3)) + 5])
    qs = np.vstack([rng.normal(size=(60, 3)), rng.normal(scale=1e-3, size=(60, 3)) + 5])
    got = neighbors.knn_join(vectors(spark, qs, "qid"), vectors(spark, refs, "rid"), 5, cells=8).collect()
    assert len(got) == 120 * 5
    d = np.linalg.norm(qs[:, None] - refs[None], axis=2)
    for r in got:
        assert r["distance"] == pytest.approx(np.sort(d[r["qid"]])[r["rank"] - 1])
        assert r["distance"] == pytest.approx(d[r["qid"], r["rid"]])


def test_knn_with_fewer_references_than_k(spark):
    got = neighbors.knn_join(vectors(spark, np.zeros((2, 2)), "qid"), vectors(spark, np.ones((3, 2)), "rid"), 5)
    assert got.count() == 6


def test_knn_sends_on_few_rows_per_query(spark, monkeypatch):
    """Tasks return rows within the bound of the home block, not k per block; ties and self pairs as by brute force."""
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 50)
    monkeypatch.setattr(neighbors, "CELL_ROWS", 50)
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(900, 4)), np.repeat(rng.normal(size=(5, 4)), 60, axis=0)])
    v = vectors(spark, x, "qid")
    joined = neighbors.knn_join(v, v.withColumnRenamed("qid", "rid"), 5, exclude_self=True)
    got = {}
    for r in joined.collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["rid"], r["distance"]))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for q in range(len(x)):
        want = sorted((round(d[q, r], 12), r) for r in range(len(x)) if r != q)[:5]
        assert [(r, pytest.approx(w)) for w, r in want] == [(r, c) for _, r, c in sorted(got[q])]
    # some 24 blocks of 50 rows: six rows from each were 144 a query
    assert neighbors._close_rows(v, v.withColumnRenamed("qid", "rid"), 6, 8).count() < 40 * len(x)
    # cells that no query has as its home
    assert neighbors.knn_join(v.where("qid = 3"), v.withColumnRenamed("qid", "rid"), 5, exclude_self=True).count() == 5


def test_knn_excludes_itself(spark):
    x = np.arange(20, dtype=float).reshape(10, 2)
    got = neighbors.knn_join(vectors(spark, x, "qid"), vectors(spark, x, "rid"), 2, exclude_self=True).collect()
    assert len(got) == 20 and all(r["qid"] != r["rid"] for r in got)


def test_fixed_decimals_of_large_numbers(spark):
    """A ratio over a withdrawal without deposit leaves 64 bits; it stopped the report."""
    want = {1.38580995e15: "1385809950000000.0000", -2e30: "-2" + "0" * 30 + ".0000", 12.34567: "12.3457", -1e-9: "0.0000", -3.5: "-3.5000", None: None}
    df = spark.createDataFrame([(x,) for x in want], "x double")
    assert {r["x"]: r["s"] for r in df.select("x", explain.fixed_decimals(F.col("x")).alias("s")).collect()} == want


def test_folds_are_stratified_and_total(spark):
    df = spark.range(1003).select(F.col("id").alias("user_id"), (F.col("id") % 10 == 0).cast("int").alias("status"))
    rows = models.stratified_folds(df, 5).groupBy("status", "fold").count().collect()
    for status in (0, 1):
        sizes = [r["count"] for r in rows if r["status"] == status]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    assert sum(r["count"] for r in rows) == 1003
    again = models.stratified_folds(df, 5).exceptAll(models.stratified_folds(df.repartition(7), 5))
    assert again.isEmpty()


def test_isolation_forest_ranks_the_outlier_first(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(400, 2)), [[9.0, 9.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "user_id long, a double, b double")
    top = anomaly.iforest_score(df, ["a", "b"], trees=40).orderBy(F.col("if_score").desc()).first()
    assert top["user_id"] == 400 and 0.5 < top["if_score"] <= 1


def test_selection_drops_constant_and_twin(spark):
    df = spark.range(200).select(
        F.col("id").alias("user_id"), (F.col("id") % 4 == 0).cast("int").alias("status"),
        (F.col("id") % 4).cast("double").alias("good"), (F.col("id") % 4 + F.rand(3) * 0.05).alias("twin"),
        F.lit(1.0).alias("flat"), F.rand(1).alias("noise"), (F.col("id") % 50).cast("double").alias("age"),
    )
    kept, report = models.select_features(df, ["good", "twin", "flat", "noise", "age"])
    stages = {r["feature"]: r["stage"] for r in report.collect()}
    assert stages["flat"] == "zero_variance" and stages["age"] == "protected"
    assert sorted(stages[f] for f in ("good", "twin")) == ["correlated", "kept"]
    assert "noise" in kept


def test_smote_count_and_span(spark):
    pos = vectors(spark, np.array([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]]), "rid")
    near = neighbors.knn_join(pos.withColumnRenamed("rid", "qid"), pos, 2, exclude_self=True)
    made = neighbors.smote(pos, near, 7).collect()
    assert len(made) == 7
    assert all(r["vec"][0] == pytest.approx(r["vec"][1]) and 0 <= r["vec"][0] <= 2 for r in made)


def test_perturb_kinds(spark):
    df = spark.createDataFrame([(i, 1.0, 3.0, 5.0) for i in range(300)], "user_id long, flag double, step double, size double")
    kinds = {"flag": "binary", "step": "ordinal"}
    out = explain.perturb(df, ["flag", "step", "size"], {"size": 2.0}, {"step": (1.0, 3.0)}, [0.2], 4, kinds)
    rows = out.collect()
    assert len(rows) == 1200
    assert {r["flag"] for r in rows} == {0.0, 1.0} and {r["step"] for r in rows} == {2.0, 3.0}
    assert np.mean([r["flag"] == 0 for r in rows]) == pytest.approx(0.2, abs=0.05)
    assert np.std([r["size"] for r in rows]) == pytest.approx(0.4, abs=0.05)


def test_ssr_of_a_dominant_feature_is_stable(spark):
    df = spark.range(100).select(
        F.col("id").alias("user_id"), (F.col("id") % 2).cast("int").alias("status"),
        F.when(F.col("id") % 2 == 0, 10.0).otherwise(-10.0).alias("big"), (F.col("id") % 3).cast("double").alias("small"),
    )
    out = {(r["top_k"], r["class"]): r["ssr"] for r in explain.ssr(df, {"big": 1.0, "small": 1e-6}, epsilons=[0.05]).collect()}
    assert out[(1, -1)] == 1.0


def test_scores_do_not_depend_on_units(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 3))
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "user_id long, a double, b double, c double")
    scaled = df.withColumn("b", F.col("b") * 1e4)
    for score, name in ((anomaly.hbos_score, "hbos_score"), (anomaly.lof_score, "lof_score")):
        one, two = ({r["user_id"]: r[name] for r in score(d, ["a", "b", "c"]).collect()} for d in (df, scaled))
        assert one == pytest.approx(two)


def test_histogram_score_of_values_outside_the_fitted_range(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(21)], "user_id long, a double")
    held = spark.createDataFrame([(100, -0.4), (101, -50.0), (102, 70.0)], "user_id long, a double")
    got = {r["user_id"]: r["hbos_score"] for r in anomaly.hbos_score(held, ["a"], fit_on=df).collect()}
    floor = -np.log2(anomaly.HBOS_FLOOR)
    assert got[101] == got[102] == pytest.approx(floor) and got[100] < floor
