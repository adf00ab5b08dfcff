"""Boosting with its own gradient and exact tree attributions against plain versions."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import boosting as bt
from ledgerlens.operators import models, pseudo, tree_shap

COLS = [f"x{i}" for i in range(6)]


def table(n=500, seed=3):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 6)), 2)
    x[:, 4] = 1.0  # no variance
    x[:, 5] = rng.integers(0, 3, n)
    y = (x[:, 0] * x[:, 1] + x[:, 5] + 0.5 * rng.normal(size=n) > 1.6).astype(int)
    return x, y


@pytest.fixture(scope="module")
def users(spark):
    x, y = table()
    rows = [(i, int(b), i % 3, *map(float, a)) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "user_id bigint, status int, fold int, " + ", ".join(f"{c} double" for c in COLS)).repartition(4).cache()


def plain_fit(x, y, edges, p):
    """The same model by plain loops over rows and candidate splits."""
    pos = y.sum() * p.positive_weight
    start = math.log(pos / (len(y) - y.sum())) if p.objective == "logistic" else 0.0
    margin, trees = np.full(len(y), start), []

    def grow(rows, depth, g, h):
        value = -p.step * g[rows].sum() / (h[rows].sum() + p.ridge)
        best = None
        if depth < p.depth:
            for c in range(x.shape[1]):
                for e in edges[c]:
                    left = rows[x[rows, c] <= e]
                    hl, hr = h[left].sum(), h[rows].sum() - h[left].sum()
                    if hl < p.min_hessian or hr < p.min_hessian:
                        continue
                    gl, ga, ha = g[left].sum(), g[rows].sum(), h[rows].sum()
                    gain = gl**2 / (hl + p.ridge) + (ga - gl) ** 2 / (hr + p.ridge) - ga**2 / (ha + p.ridge)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, c, e)
        if best is None:
            return value
        go = x[rows, best[1]] <= best[2]
        return (best[1], best[2], grow(rows[go], depth + 1, g, h), grow(rows[~go], depth + 1, g, h))

    def walk(tree, r):
        while isinstance(tree, tuple):
            tree = tree[2] if r[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(p.rounds):
        q = 1 / (1 + np.exp(-margin))
        w = np.where(y == 1, p.positive_weight, 1.0)
        if p.objective == "focal":
            w = w * np.where(y == 1, p.alpha, 1 - p.alpha) * np.where(y == 1, 1 - q, q) ** p.gamma
        tree = grow(np.arange(len(y)), 0, w * (q - y), np.maximum(w * q * (1 - q), 1e-7))
        margin = margin + np.array([walk(tree, r) for r in x])
        trees.append(tree)
    return margin


def test_models_equal_a_plain_version(spark, users, monkeypatch):
    monkeypatch.setattr(bt, "KEEP_EVERY", 2)  # scores are written in between
    x, y = table()
    edges = bt.bin_edges(users, COLS, 12)
    models = [
        bt.Model("logistic", bt.Params(rounds=5, depth=3, step=0.3, positive_weight=2.0)),
        bt.Model("focal", bt.Params(rounds=4, depth=2, step=0.5, objective="focal", alpha=0.7, gamma=1.5)),
        bt.Model("without_1", bt.Params(rounds=3, depth=2), without=1),
    ]
    fitted = bt.fit_models(users, COLS, models, bins=12)
    for m in models:
        part = np.arange(len(y)) % 3 != (m.without if m.without is not None else 9)
        want = plain_fit(x[part], y[part], edges, m.params)
        assert np.allclose(fitted[m.name].margin(x[part]), want, atol=1e-9)
    got = bt.score(users, fitted, ["user_id"]).collect()
    assert len(got) == 500
    for r in got[:50]:
        for m in models:
            assert math.isclose(r[m.name], 1 / (1 + math.exp(-fitted[m.name].margin(x[[r["user_id"]]])[0])), rel_tol=1e-12)
    # parts of the table do not matter, and the sums of many tasks meet in two steps
    monkeypatch.setattr(bt, "TASK_BYTES", 500)
    monkeypatch.setattr(bt, "MERGE", 3)
    again = bt.fit_models(users.repartition(7), COLS, models[:1], bins=12)
    assert np.allclose(again["logistic"].margin(x), fitted["logistic"].margin(x), atol=1e-9)


def test_gradients():
    y = np.array([0, 1, 0, 1])
    margin = np.array([-2.0, -1.0, 0.5, 3.0])
    for p in (bt.Params(positive_weight=3.0), bt.Params(objective="focal", gamma=0.0, alpha=0.5)):
        g, h = bt.gradients(margin, y, p)

        def loss(m, p=p):
            q = 1 / (1 + np.exp(-m))
            return np.where(y == 1, p.positive_weight, 1.0) * (0.5 if p.objective == "focal" else 1.0) * -(y * np.log(q) + (1 - y) * np.log(1 - q))

        e = 1e-5
        assert np.allclose((loss(margin + e) - loss(margin - e)) / (2 * e), g, atol=1e-8)
        assert np.allclose((loss(margin + e) - 2 * loss(margin) + loss(margin - e)) / e**2, h, atol=1e-4)
    g, _ = bt.gradients(margin, y, bt.Params(objective="focal"))
    plain = bt.gradients(margin, y, bt.Params())[0]
    assert abs(g[3] / plain[3]) < abs(g[1] / plain[1])  # a case that is right already counts less


def test_odd_tables(spark, users):
    one = bt.fit_models(users.where("status = 0"), COLS, [bt.Model("m", bt.Params(rounds=2))])["m"]
    assert one.trees == [] and one.start < -30
    none = bt.fit_models(users.where("user_id < 0"), COLS, [bt.Model("m", bt.Params(rounds=2))])["m"]
    assert none.trees == [] and bt.score(users.where("user_id < 0"), {"m": none}, ["user_id"]).count() == 0
    gaps = users.withColumn("x0", F.when(F.col("user_id") % 2 == 0, F.col("x0"))).withColumn("status", F.when(F.col("user_id") > 9, F.col("status")))
    model = bt.fit_models(gaps, COLS, [bt.Model("m", bt.Params(rounds=2, depth=2))])["m"]
    assert len(model.trees) == 2 and all(4 not in t.feature for t in model.trees)
    assert bt.score(gaps, {"m": model}, ["user_id"]).where("m IS NULL").count() == 0


def random_tree(rng, columns, depth):
    tree = bt.Tree()
    tree.add(rng.uniform(-1, 1), 100.0)
    todo = [(0, 0)]
    while todo:
        node, level = todo.pop()
        if level == depth or rng.random() < 0.15:
            continue
        share = rng.uniform(0.05, 0.95)
        kids = [tree.add(rng.uniform(-1, 1), tree.cover[node] * s) for s in (share, 1 - share)]
        tree.feature[node], tree.value[node], (tree.left[node], tree.right[node]) = rng.randrange(columns), rng.uniform(-1, 1), kids
        todo += [(k, level + 1) for k in kids]
    return tree


def expected(tree, x, known, node=0):
    f = tree.feature[node]
    if f < 0:
        return tree.leaf[node]
    left, right = tree.left[node], tree.right[node]
    if f in known:
        return expected(tree, x, known, left if x[f] <= tree.value[node] else right)
    return sum(tree.cover[k] / tree.cover[node] * expected(tree, x, known, k) for k in (left, right))


def test_attributions_equal_subset_enumeration():
    rng = random.Random(11)
    for _ in range(12):
        columns = rng.randrange(1, 6)
        model = bt.BoostedTrees([f"c{i}" for i in range(columns)], 0.3, [random_tree(rng, columns, rng.randrange(0, 5)) for _ in range(3)])
        explain, base = tree_shap.explainer(model)
        for _ in range(4):
            x = [rng.uniform(-1, 1) for _ in range(columns)]
            value = lambda s: sum(expected(t, x, s) for t in model.trees)  # noqa: B023, E731
            got = explain(np.array([x]))[0]
            for i in range(columns):
                rest = [j for j in range(columns) if j != i]
                want = sum(
                    math.factorial(k) * math.factorial(columns - k - 1) / math.factorial(columns) * (value({*s, i}) - value(set(s)))
                    for k in range(columns) for s in combinations(rest, k)
                )
                assert abs(got[i] - want) < 1e-12
            assert abs(base + got.sum() - model.margin(np.array([x]))[0]) < 1e-12 and abs(base - 0.3 - value(set())) < 1e-12


def test_attributions_of_all_users(spark, users):
    model = bt.fit_models(users, COLS, [bt.Model("m", bt.Params(rounds=12, depth=4))])["m"]
    long = tree_shap.tree_attributions(users, model)
    sums = long.groupBy("user_id").agg(F.sum("shap").alias("s"), F.count("*").alias("n")).collect()
    x, _ = table()
    margin = model.margin(x)
    assert len(sums) == 500
    for r in sums:
        assert r["n"] == 6 and abs(tree_shap.base_value(model) + r["s"] - margin[r["user_id"]]) < 1e-9
    assert long.where("feature = 'x4' AND shap <> 0").count() == 0


def test_pseudo_labels_kept_and_rolled_back(spark, users):
    """Clean unlabelled users help or do no harm; users whose features lie about their class make the loop return to the first model."""
    learner = bt.Params(rounds=8, depth=3, step=0.4)
    few = users.where("user_id < 200").drop("fold")
    more = users.where("user_id >= 200").drop("fold", "status")
    start = bt.fit_models(models.stratified_folds(few.select("user_id", "status", *COLS), 5).where("fold <> 0"), COLS, [bt.Model("m", learner)])["m"]
    model, rounds = pseudo.pseudo_label_rounds(few, more, COLS, learner, 0.7, 0.3)
    table = [r.asDict() for r in rounds.orderBy("round").collect()]
    for a, b in zip(table, table[1:]):
        assert a["outcome"] == "kept" and b["f1_before"] == a["f1_after"]
    assert all((r["outcome"] == "kept") == (r["f1_after"] >= r["f1_before"]) for r in table if r["outcome"] != "nothing added")
    assert table[0]["positives_added"] + table[0]["negatives_added"] + table[0]["remaining"] == 300
    # a threshold of 0 calls everyone positive: the refitted model is worse and goes
    model, rounds = pseudo.pseudo_label_rounds(few, more, COLS, learner, 0.0, -1.0)
    (only,) = rounds.collect()
    assert only["positives_added"] == 300 and only["f1_after"] < only["f1_before"] and only["outcome"] == "rolled back"
    x, _ = table()
    assert np.array_equal(model.margin(x), start.margin(x))
    # nobody is confident enough
    _, rounds = pseudo.pseudo_label_rounds(few, more, COLS, learner, 1.1, -0.1)
    (only,) = rounds.collect()
    assert only["outcome"] == "nothing added" and only["remaining"] == 300


def test_stack_scores_every_user_out_of_fold(spark, users):
    train = users.drop("fold")
    stack, oof = models.fit_stack(train, COLS, folds=3, rounds=6)
    rows = oof.collect()
    assert len(rows) == 500 and all(0 <= r["risk_score"] <= 1 for r in rows)
    folds = {r["user_id"]: r["fold"] for r in models.stratified_folds(train.select("user_id", "status"), 3).collect()}
    x, _ = table()
    for r in rows[:60]:
        model = stack.models["boost_b"][folds[r["user_id"]]]
        assert math.isclose(r["boost_b"], 1 / (1 + math.exp(-model.margin(x[[r["user_id"]]])[0])), rel_tol=1e-12)
    got = stack.score(users).collect()
    assert len(got) == 500 and all(0 <= r["risk_score"] <= 1 for r in got)
    shares = stack.importances()
    assert len(shares) == 18 and all(math.isclose(sum(v for n, _, v in shares if n == name), 1) for name in stack.models)


def test_selection_needs_all_folds(spark, users):
    wide = users.drop("fold").withColumns({"copy": F.col("x0") * 2, "noise": F.lit(0.0) + (F.col("user_id") == 7).cast("double")})
    kept, report = models.select_features(wide, [*COLS, "copy", "noise"], importance_rounds=4)
    stage = {r["feature"]: r["stage"] for r in report.collect()}
    assert stage["x4"] == "zero_variance" and "correlated" in (stage["x0"], stage["copy"]) and {"x1", "x5"} <= set(kept)
    fitted = models.importance_models(wide, [c for c in COLS if c != "x4"], 4)
    used = {c for m in fitted for c, v in zip(m.columns, m.importance()) if v > 0}
    assert len(fitted) == 5 and len({m.start for m in fitted}) >= 1 and used <= set(COLS)
    assert stage["noise"] == ("kept" if "noise" in kept else "zero_importance")
    shares = {r["feature"]: r["importance"] for r in models.fold_importance(wide, COLS, 4).collect()}
    assert math.isclose(sum(shares.values()), 1) and shares["x4"] == 0


def test_calibration_on_bins(spark):
    """Against pool-adjacent-violators on the same bins."""
    rng = np.random.default_rng(8)
    score = np.round(rng.random(900), 3)
    label = (rng.random(900) < score**2).astype(int)
    df = spark.createDataFrame([(i, int(y), float(s)) for i, (s, y) in enumerate(zip(score, label))], "user_id bigint, status int, risk_score double")
    got = {r["user_id"]: r for r in models.calibrate(df, step=0.01).collect()}
    folds = {r["user_id"]: r["fold"] for r in models.stratified_folds(df, 3).collect()}
    assert len(got) == 900
    for fold in range(3):
        bins = {}
        for i in range(900):
            if folds[i] != fold:
                bins.setdefault(float(np.rint(score[i] / 0.01) * 0.01), []).append(int(label[i]))
        # the fit sees each fold's bins on their own, which merge at equal scores
        blocks = [[sum(v), len(v), [k]] for k, v in sorted(bins.items())]
        out = []
        for b in blocks:
            out.append([b[0], b[1], list(b[2])])
            while len(out) > 1 and out[-2][0] * out[-1][1] >= out[-1][0] * out[-2][1]:
                s, n, ks = out.pop()
                out[-1] = [out[-1][0] + s, out[-1][1] + n, out[-1][2] + ks]
        xs, ys = zip(*[(k, s / n) for s, n, ks in out for k in ks])
        for i in range(900):
            if folds[i] == fold:
                assert abs(got[i]["calibrated_score"] - np.interp(score[i], xs, ys)) < 1e-9


def test_models_are_dealt_over_groups_of_tasks(spark, users, monkeypatch):
    """Few users are one part, yet several tasks share the models of a level; dealing and row parts change no model."""
    jobs = [bt.Model(f"m{k}", bt.Params(rounds=3, depth=3, step=0.3, row_share=0.9, seed=k), without=k) for k in range(3)]
    seen = []
    by_group = bt._by_group
    monkeypatch.setattr(bt, "_by_group", lambda written, groups, parts: seen.append((groups, parts)) or by_group(written, groups, parts))
    dealt = bt.fit_models(users, COLS, jobs)
    monkeypatch.setattr(bt, "TASK_BYTES", 4000)
    split = bt.fit_models(users, COLS, jobs)
    assert seen[0] == (3, 1) and seen[1][0] == 1 and seen[1][1] > 1
    x, _ = table()
    for name in dealt:
        assert split[name].margin(x) == pytest.approx(dealt[name].margin(x), abs=1e-9)
