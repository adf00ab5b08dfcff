"""Findings of round 4: whole results, and shared steps against plain versions."""

import math
import random

import numpy as np
import pytest

import __spark_entry__ as entry_module
from pyspark.sql import functions as F
from test_graph import plain_trace, run_trace

from ledgerlens.operators import anomaly, boosting, models, neighbors, trace
from ledgerlens.plans.model_queries import VEC


def test_correlation_covers_every_feature_pair(spark, sf_dir):
    rows = entry_module.queries()["feature_correlation"](spark, sf_dir).collect()
    names = [*VEC, "status"]
    assert {(r["feature_a"], r["feature_b"]) for r in rows} == {(a, b) for i, a in enumerate(names) for b in names[i + 1 :]}
    assert len(rows) == len(names) * (len(names) - 1) // 2


def test_correlation_of_a_constant_column_is_null(spark):
    df = spark.createDataFrame([(float(i), 1.0, float(i * i)) for i in range(5)], "a double, b double, c double")
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in models.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] is None and got["b", "c"] is None
    assert math.isclose(got["a", "c"], np.corrcoef(np.arange(5), np.arange(5) ** 2)[0, 1])


def test_groups_of_models_get_a_task_each(spark):
    """A union of single partitions is one partition in Spark 4.1: all groups ran in one task."""
    rows = spark.range(30).select((F.col("id") % 3).cast("int").alias("part"), "id")
    held = boosting._by_group(rows, 3, 1)
    per_task = [{r["part"] for r in t} for t in held.rdd.glom().collect()]
    held.unpersist()
    assert sorted(map(sorted, per_task)) == [[0], [1], [2]]


def test_small_tables_need_no_job_per_level(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    rows = [(i, int(a[0] + a[1] > 0.3), i % 3, *map(float, a)) for i, a in enumerate(x)]
    df = spark.createDataFrame(rows, "user_id long, status int, fold int, a double, b double, c double")
    jobs = [boosting.Model(f"m{k}", boosting.Params(rounds=4, depth=3, row_share=0.8, column_share=0.7, seed=k), without=k) for k in range(3)]
    monkeypatch.setattr(boosting, "TASK_BYTES", 2000)
    split = boosting.fit_models(df, ["a", "b", "c"], jobs)
    monkeypatch.undo()
    monkeypatch.setattr(boosting, "_sum_rows", lambda *_: 1 / 0)
    whole = boosting.fit_models(df, ["a", "b", "c"], jobs)
    for name in whole:
        assert len(whole[name].trees) == 4
        assert np.allclose(whole[name].margin(x), split[name].margin(x), atol=1e-9)


def test_trace_over_many_blocks_and_shared_hubs(spark, monkeypatch):
    """Edges in small blocks, a hub's edges in several, seeds in several slots: the paths are those of a plain queue, and a hop is a row per slot."""
    monkeypatch.setattr(trace, "HUB_LINKS", 2)
    monkeypatch.setattr(trace, "BLOCK_LINKS", 4)
    monkeypatch.setattr(trace, "SLOT_NODES", 20)
    tables = []
    levels = trace._levels

    def watched(*args):
        out = levels(*args)
        tables.append(([x.count() for x in out[0]], args[3]))
        return out

    monkeypatch.setattr(trace, "_levels", watched)
    rng = random.Random(11)
    names = [f"user_{i}" for i in range(8)] + ["wallet_0", "wallet_1"]
    pairs = {tuple(rng.sample(names, 2)) for _ in range(25)} | {(n, "wallet_0") for n in names[:8]} | {("wallet_0", n) for n in names[:8]}
    rows = [(a, b, i if i % 5 else None, float(rng.randint(1, 400_000))) for i, (a, b) in enumerate(sorted(pairs))]
    risks, seeds = {i: i / 20 for i in range(8)}, [f"user_{i}" for i in range(6)]
    got = run_trace(spark, rows, seeds, risks.items())
    for s in seeds:
        want = plain_trace(rows, s, risks, 5)
        assert (want is None) == (s not in got)
        if want:
            assert got[s]["path_nodes"] == want[1] and got[s]["score"] == pytest.approx(want[0])
    (rows_per_hop, slots), = tables
    assert slots > 1 and max(rows_per_hop) <= slots < len(seeds) * len(names)


def plain_nearest(q, x, k, own):
    d = np.sqrt(((x[q] - x) ** 2).sum(axis=1))
    return sorted((float(v), i) for i, v in enumerate(d) if not (own and i == q))[:k]


@pytest.mark.parametrize("scale", [1.0, 1e18])
def test_a_query_travels_once_to_each_group(spark, monkeypatch, scale):
    """Many cells, small blocks and groups, equal rows and rows beyond single precision: the neighbours are exact, and a task gives at most k rows a query."""
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 10)
    monkeypatch.setattr(neighbors, "GROUP_ROWS", 40)
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(160, 4)), 1) * scale
    x[120:150] = x[3]
    x[159] = 50.0 * scale
    v = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "qid long, vec array<double>")
    refs = v.withColumnRenamed("qid", "rid")
    got = {}
    for r in neighbors.knn_join(v, refs, 5, exclude_self=True, cells=16).collect():
        got.setdefault(r["qid"], []).append((r["rank"], r["distance"], r["rid"]))
    for q in range(len(x)):
        want = plain_nearest(q, x, 5, True)
        assert [d for _, d, _ in sorted(got[q])] == pytest.approx([d for d, _ in want])
    seen = []
    meets = neighbors._groups
    monkeypatch.setattr(neighbors, "_groups", lambda *a: seen.append(meets(*a)) or seen[-1])
    rows = neighbors._close_rows(v, refs, 6, 16).count()
    # 160 rows in groups of 40 by the rows alone; every group gives at most six rows for a query that visits it
    assert rows <= 6 * len(x) * (1 + max(g for own in seen[0] for g in own))


def test_outlier_scores_of_a_fitted_set_that_is_no_part_of_the_table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3))
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    every = spark.createDataFrame(rows, "user_id long, a double, b double, c double")
    train = every.where("user_id % 3 <> 0")
    calls = []

    def scores(df, joins):
        calls.clear()
        join = neighbors.knn_join
        with pytest.MonkeyPatch.context() as m:
            m.setattr(anomaly, "knn_join", lambda *a, **k: calls.append(1) or join(*a, **k))
            out = anomaly.anomaly_scores(df, ["a", "b", "c"], fit_on=train, trees=5)
        assert len(calls) == joins
        return {r["user_id"]: r["lof_score"] for r in out.collect()}

    together, apart = scores(every, 1), scores(every.where("user_id % 2 = 0"), 2)
    assert apart == pytest.approx({k: v for k, v in together.items() if k % 2 == 0})


def test_repeated_strings_leave_only_spans(spark):
    """The dictionary, the settled phrases and the opened units go when what they show is written."""
    import os

    from ledgerlens.llm import phrases
    from ledgerlens.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")

    def folders():
        return {d for d, _, files in os.walk(root) for f in files if f.endswith(".parquet")}

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = " ".join(word() for _ in range(40))
    texts = [(i, " ".join(word() for _ in range(20)) + shared[i:] + " ".join(word() for _ in range(10))) for i in range(6)]
    df = spark.createDataFrame(texts, "user_id long, report string")
    before = folders()
    spans = phrases.repeated_strings(df)
    columns = {c for d in folders() - before for c in spark.read.parquet(d).columns}
    assert not columns & {"bytes", "name", "core", "windows"}
    found = {r["id"] for r in spans.collect()}
    assert found == {1, 2, 3, 4, 5}
