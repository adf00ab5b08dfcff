"""Hard negatives and whitening against plain versions, and on odd, tied, repeated and missing vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import hard_negatives, whitening
from ledgerlens.llm.queries import QUERIES
from ledgerlens.llm.vectors import common_length, fixed_point, usable


def plain_negatives(rows, is_anchor, positives=5, negatives=3, low=50, high=95):
    out = []
    for a, label, x in rows:
        if not is_anchor(a):
            continue
        scored = sorted(((sum(p * q for p, q in zip(x, y)), b, other) for b, other, y in rows if b != a), key=lambda t: (-t[0], t[1]))
        for score, b, _ in [t for t in scored if t[2] == label][:positives]:
            fits = [t for t in scored if t[2] != label and low * score <= 100 * t[0] <= high * score][:negatives]
            out += [(a, b, i, c, score, s) for i, (s, c, _) in enumerate(fits, 1)]
    return sorted(out)


def mined(df, step, **more):
    return sorted(tuple(r) for r in hard_negatives.mine_hard_negatives(df, F.col("user_id") % step == 0, **more).collect())


@pytest.mark.parametrize("block, chunk, leaf", [(4096, 512, 32), (40, 6, 4)])
def test_hard_negatives(spark, monkeypatch, block, chunk, leaf):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    monkeypatch.setattr(hard_negatives, "PER_PIVOT", 60)
    rng = random.Random(6)
    centres = [[rng.randrange(-40, 90) for _ in range(6)] for _ in range(8)]
    rows = []
    for i in range(400):
        c = centres[rng.randrange(8)]
        rows.append((i, rng.randrange(4), [v + rng.randrange(-9, 10) for v in c]))
    rows += [(400 + i, i % 3, centres[0]) for i in range(130)]  # copies of one vector: ties everywhere
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "user_id bigint, status int, vec array<bigint>, id string, label int").repartition(3)
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 500 and mined(df, 10) == want
    assert mined(df, 10, positives=2, negatives=7, low=10, high=99) == plain_negatives(rows, lambda i: i % 10 == 0, 2, 7, 10, 99)


def test_hard_negatives_odd_rows(spark):
    schema = "user_id bigint, status int, vec array<bigint>"
    rows = [(0, 1, [3, 4]), (1, 1, [3, 3]), (2, 2, [2, 2]), (3, 2, [-9, -9]), (4, None, [9, 9]), (5, 2, None), (6, 2, [1, None]), (7, 2, [1, 1, 1]), (None, 2, [2, 2])]
    whole = [r for r in rows[:4]]
    assert mined(spark.createDataFrame(rows, schema), 1) == plain_negatives(whole, lambda i: True)
    twice = [*rows, (2, 3, [2, 3]), (0, 1, [3, 4])]
    assert mined(spark.createDataFrame(twice, schema), 1) == plain_negatives(whole, lambda i: True)
    assert mined(spark.createDataFrame([], schema), 1) == [] and mined(spark.createDataFrame(rows, schema), 100) == plain_negatives(whole, lambda i: i == 0)
    big = [(i, i % 2, [10**8 + 7 * i, 10**7 - i]) for i in range(40)]  # sums beyond 53 bits stay exact
    assert mined(spark.createDataFrame(big, schema), 3, low=0, high=100) == plain_negatives(big, lambda i: i % 3 == 0, low=0, high=100)


def test_tree_bounds():
    rng = np.random.default_rng(3)
    points = np.vstack([rng.integers(-50, 50, (300, 5)), np.zeros((60, 5), int)])
    tree = hard_negatives.CoverTree.from_bytes(hard_negatives.build_tree(np.arange(360), points).to_bytes())
    assert sorted(tree.ids) == list(range(360)) and (points[tree.ids] == tree.points).all()
    square = (tree.points**2).sum(1)
    lifted = np.hstack([tree.points, np.sqrt(square.max() - square)[:, None]])
    for k in range(len(tree.centre)):
        run = slice(tree.first[k], tree.last[k])
        far = np.sqrt(((lifted[run] - lifted[tree.centre[k]]) ** 2).sum(1)).max()
        assert far <= tree.radius[k] * (1 + 1e-9) + 1e-9 and tree.first[k] <= tree.centre[k] < tree.last[k]
        if k:
            assert tree.radius[k] <= tree.radius[tree.parent[k]] / hard_negatives.RATIO + 1e-9
            assert tree.first[tree.parent[k]] <= tree.first[k] and tree.last[k] <= tree.last[tree.parent[k]]
    # a narrow window opens few leaves, and still every member in it is found
    q = rng.integers(-50, 50, (20, 5))
    i, ids, score = hard_negatives.search(tree, q, np.arange(20), np.full(20, -1), np.full(20, 900), np.full(20, 1000), 400)
    all_scores = q @ points.T
    assert {(a, b) for a, b in zip(i, ids)} == {(a, b) for a, b in zip(*np.nonzero((all_scores >= 900) & (all_scores <= 1000)))}
    assert (score == all_scores[i, ids]).all()


def test_singular_values():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 8, 40):
        for kind in range(5):
            r = np.triu(rng.normal(size=(d, d)))
            if kind == 1:
                r *= np.logspace(0, -14, d)  # graded
            elif kind == 2:
                r[:, d // 2 :] = 0  # rank deficient
            elif kind == 3:
                r = np.eye(d) * 3.0  # one value d times
            elif kind == 4:
                r = np.linalg.qr(rng.normal(size=(d, d)))[0] @ np.diag([2.0] * (d - d // 2) + [1.0] * (d // 2))
            diagonal, above, v = whitening.bidiagonalise(r)
            b = np.diag(diagonal) + np.diag(above, 1)
            assert np.allclose(b.T @ b, v.T @ r.T @ r @ v, atol=1e-12 * max(1, np.abs(r).max() ** 2)) and np.allclose(v.T @ v, np.eye(d), atol=1e-12)
            got = np.sqrt(whitening.squared_singular_values(diagonal, above))
            assert np.allclose(got, np.linalg.svd(b, compute_uv=False), rtol=1e-12, atol=1e-14 * got[0])
            found, e, _ = whitening.solve(r, 1, d)
            assert np.allclose(found @ found.T, np.eye(len(found)), atol=1e-8)
            assert np.allclose(found @ r.T @ r, e[:, None] * found, atol=1e-11 * e.max(initial=1))


def plain_whitening(x, components=16):
    fit = np.unique(x, axis=0)
    n, mean = len(fit), fit.mean(0)
    cov = (fit - mean).T @ (fit - mean) / n
    e, v = np.linalg.eigh(cov)
    order = np.argsort(-e)[:components]
    return n, fit.sum(0), e[order], v[:, order].T, e[order] / np.trace(cov), (x - mean) @ v[:, order] / np.sqrt(e[order])


@pytest.mark.parametrize("fan", [16, 2])
def test_whitening(spark, monkeypatch, fan):
    monkeypatch.setattr(whitening, "FAN_IN", fan)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(size=(600, 20)) * np.linspace(80, 3, 20)).astype(int) + 1_000_000
    x = np.vstack([x, np.repeat(x[:1], 300, 0)])  # one vector owns a third of the rows
    df = spark.createDataFrame([(i, r.tolist(), "x", [0.0]) for i, r in enumerate(x)], "user_id bigint, vec array<bigint>, row string, whitened array<double>").repartition(9)
    # as on a cluster: many partitions, so that factors are merged in rounds
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        model = whitening.fit_whitening(df)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n, sums, e, v, explained, w = plain_whitening(x)
    assert model.n == n and model.sums == sums.tolist() and model.identity_error < 1e-10
    assert np.allclose(model.eigenvalues, e, rtol=1e-11) and np.allclose(model.explained, explained, rtol=1e-11)
    assert np.allclose(np.abs((model.directions * v).sum(1)), 1, atol=1e-11)
    out = {r["user_id"]: r for r in whitening.whiten(df, model).collect()}
    got = np.array([out[i]["whitened"] for i in range(len(x))]) * np.sign((model.directions * v).sum(1))
    assert np.allclose(got, w, atol=1e-8) and out[0]["row"] == "x"


def test_whitening_odd_rows(spark):
    schema = "user_id bigint, vec array<bigint>"
    rows = [(1, [1, 5]), (2, [3, 5]), (2, [3, 5]), (3, None), (4, []), (5, [1, None]), (6, [1, 2, 3]), (None, [8, 5])]
    df = spark.createDataFrame(rows, schema)
    model = whitening.fit_whitening(df)  # the second entry never varies
    assert model.n == 3 and model.sums == [12, 15] and len(model.directions) == 1 and math.isclose(model.explained[0], 1)
    out = whitening.whiten(df, model).collect()
    assert len(out) == len(rows)
    want = {1: -3, 2: -1, None: 4}
    for r in out:
        if r["user_id"] in want:
            assert math.isclose(r["whitened"][0], want[r["user_id"]] / math.sqrt(26 / 3))
        else:
            assert r["whitened"] is None
    for some in (rows[:1], [], [(3, None)], [(4, [])], [(1, [2, 2]), (2, [2, 2])]):
        part = spark.createDataFrame(some, schema)
        model = whitening.fit_whitening(part)
        assert len(model.directions) == 0 and all(not r["whitened"] for r in whitening.whiten(part, model).collect())


def test_fixed_point(spark):
    df = spark.createDataFrame([([0.5, -0.001],), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([None, 1.0],), (None,), ([],)], "v array<float>")
    good = [r["v"] for r in df.where(usable(F.col("v"))).select(fixed_point(F.col("v"), 64, 100).alias("v")).collect()]
    assert good == [[132, 99], []] and common_length(df, "v") == 2


def test_queries(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in r["embedding"]] for r in rows])
    n, sums, _, _, explained, w = plain_whitening(x)
    out = QUERIES["op13_qd_whitening"](spark, sf_dir).collect()
    assert len(out) == 16 * len(rows) and dict(zip(out[0].__fields__, map(type, out[0]))) == {
        "vec_id": int, "component": int, "n": int, "deviation": int, "whitened": float, "explained": float, "identity_error": float,
    }
    at = {r["vec_id"]: i for i, r in enumerate(rows)}
    signs = {}
    for r in out:
        i, k = at[r["vec_id"]], r["component"] - 1
        assert r["n"] == n and r["deviation"] == int(((n * x[i].astype(object) - sums) ** 2).sum()) and r["identity_error"] <= 1e-4
        assert math.isclose(r["explained"], explained[k], rel_tol=1e-9)
        sign = signs.setdefault(k, np.sign(r["whitened"] * w[i, k]) if abs(w[i, k]) > 1e-3 else None) or 1
        if signs[k] is not None:
            assert math.isclose(r["whitened"], sign * w[i, k], abs_tol=1e-7)
        elif signs[k] is None:
            del signs[k]
