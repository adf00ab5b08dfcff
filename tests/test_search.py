"""The Parzen search beats the random draw on known surfaces, repeats by seed, and stops poor trials."""

import math

import numpy as np

from ledgerlens.operators import boosting as bt
from ledgerlens.operators import search as se

SPACE = {"x": se.Range(-3.0, 3.0), "step": se.Range(1e-3, 1.0, log=True), "depth": se.Range(1, 12, whole=True), "idle": se.Range(0.0, 1.0)}


def surface(p):
    return -((p["x"] - 1.2) ** 2) - (math.log10(p["step"]) + 1.5) ** 2 - 0.1 * (p["depth"] - 5) ** 2


def best_of(seed, trials, model_based):
    rng = np.random.default_rng(seed)
    history = []
    for _ in range(trials):
        p = se.suggest(history if model_based else [], SPACE, rng)
        history.append((p, surface(p)))
    return max(v for _, v in history), history


def test_beats_the_random_draw():
    model = [best_of(s, 40, True)[0] for s in range(15)]
    plain = [best_of(s, 40, False)[0] for s in range(15)]
    assert np.mean(model) > np.mean(plain) and sum(a > b for a, b in zip(model, plain)) >= 10
    assert best_of(3, 25, True)[1] == best_of(3, 25, True)[1]
    for p, _ in best_of(1, 40, True)[1]:
        assert all(r.low <= p[k] <= r.high for k, r in SPACE.items()) and isinstance(p["depth"], int)


def test_rows_and_early_stops():
    asked = []

    def evaluate(batch, share):
        asked.append((len(batch), share))
        return [surface(p) + (0 if share == 1 else -0.1) for _, p in batch]

    rows = se.search(evaluate, {"a": SPACE, "b": SPACE}, trials=12, batch=4)
    assert sorted((r[0], r[1]) for r in rows) == [(n, t) for n in "ab" for t in range(12)]
    stopped = [r for r in rows if r[4]]
    assert 0 < len(stopped) < len(rows) and sum(n for n, share in asked if share == 1) == len(rows) - len(stopped)
    for name, _, p, v, was_stopped in rows:
        assert math.isclose(v, surface(p) - (0.1 if was_stopped else 0))
    assert rows == se.search(evaluate, {"a": SPACE, "b": SPACE}, trials=12, batch=4)
    # one learner's trials do not depend on the other's presence
    assert [r for r in rows if r[0] == "a"] == se.search(evaluate, {"a": SPACE}, trials=12, batch=4)


def test_tune_learners(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=240) > 0.8).astype(int)
    df = spark.createDataFrame([(i, int(b), *map(float, a)) for i, (a, b) in enumerate(zip(x, y))], "user_id bigint, status int, a double, b double")
    common = {"rounds": se.Range(2, 4, whole=True), "step": se.Range(0.1, 0.5, log=True), "depth": se.Range(1, 2, whole=True)}
    spaces = {"deep": common | {"weight_factor": se.Range(0.5, 2.0)}, "focal": common | {"alpha": se.Range(0.6, 0.9), "gamma": se.Range(0.5, 2.0)}}
    rows = se.tune_learners(df, ["a", "b"], trials=3, batch=2, spaces=spaces).collect()
    assert len(rows) == 6 and all(0 <= r["f1"] <= 1 for r in rows) and sum(r["is_best"] for r in rows) == 2
    assert all((r["gamma"] is None) == (r["learner"] == "deep") for r in rows)
    best = next(r for r in rows if r["learner"] == "deep" and r["is_best"])
    assert best["f1"] == max(r["f1"] for r in rows if r["learner"] == "deep" and not r["stopped"]) > 0.5
    # the value is the mean fold F1 of such a model
    from ledgerlens.operators.models import stratified_folds

    folded = stratified_folds(df, 3).cache()
    n = int(y.sum())
    p = bt.Params(rounds=int(best["rounds"]), step=best["step"], depth=int(best["depth"]), positive_weight=(240 - n) / n * best["weight_factor"])
    f1 = []
    fold = {r["user_id"]: r["fold"] for r in folded.collect()}
    for k in range(3):
        m = bt.fit_models(folded, ["a", "b"], [bt.Model("m", p, without=k)])["m"]
        own = [i for i in range(240) if fold[i] == k]
        hit = m.margin(x[own]) >= 0
        tp, fp, fn = (hit & (y[own] == 1)).sum(), (hit & (y[own] == 0)).sum(), (~hit & (y[own] == 1)).sum()
        f1.append(2 * tp / (2 * tp + fp + fn))
    assert math.isclose(np.mean(f1), best["f1"], rel_tol=1e-9)
