"""Sequential model-based search: a tree-structured Parzen estimator over continuous, log and whole-number ranges.

Suggestions are driver arithmetic over a few dozen trials; their evaluation is Spark's: all folds of all trials of a batch grow
in the same jobs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .boosting import Model, Params, fit_models, score
from .models import SEED, stratified_folds

# trials before the estimator starts, share of trials that count as good, candidates per suggestion
START, GOOD_SHARE, CANDIDATES = 8, 0.25, 32
# share of the rounds after which a trial below the median of its learner stops
FIRST_LOOK = 1 / 3


@dataclass(frozen=True)
class Range:
    low: float
    high: float
    log: bool = False
    whole: bool = False

    def inner(self, x: float) -> float:
        return math.log(x) if self.log else float(x)

    def outer(self, u: float) -> float:
        x = math.exp(u) if self.log else u
        x = min(max(x, self.low), self.high)
        return int(round(x)) if self.whole else x

    @property
    def bounds(self) -> tuple[float, float]:
        return self.inner(self.low), self.inner(self.high)


_COMMON = {
    "rounds": Range(10, 40, whole=True), "step": Range(0.03, 0.4, log=True), "row_share": Range(0.6, 1.0), "column_share": Range(0.5, 1.0),
    "ridge": Range(0.1, 10.0, log=True), "min_hessian": Range(0.01, 5.0, log=True),
}
# the three learners and what is searched of each
SPACES = {
    "deep": _COMMON | {"depth": Range(4, 6, whole=True), "weight_factor": Range(0.5, 2.0)},
    "shallow": _COMMON | {"depth": Range(2, 3, whole=True), "weight_factor": Range(0.5, 2.0)},
    "focal": _COMMON | {"depth": Range(3, 5, whole=True), "alpha": Range(0.6, 0.95), "gamma": Range(0.5, 3.0)},
}


def _log_density(u: float, points: np.ndarray, widths: np.ndarray, low: float, high: float) -> float:
    """Log of a mixture of the uniform density and a truncated normal around each point."""
    span = high - low
    parts = [1 / span]
    for m, w in zip(points, widths):
        mass = 0.5 * (math.erf((high - m) / (w * math.sqrt(2))) - math.erf((low - m) / (w * math.sqrt(2))))
        parts.append(math.exp(-0.5 * ((u - m) / w) ** 2) / (w * math.sqrt(2 * math.pi) * max(mass, 1e-12)))
    return math.log(sum(parts) / len(parts))


def _widths(points: np.ndarray, low: float, high: float) -> np.ndarray:
    """A point's width is the larger distance to its neighbours, at least a share of the range that shrinks with their number."""
    order = np.argsort(points, kind="stable")
    p = np.concatenate([[low], points[order], [high]])
    w = np.maximum(p[1:-1] - p[:-2], p[2:] - p[1:-1])
    out = np.empty(len(points))
    out[order] = np.clip(w, (high - low) / min(100, 1 + len(points)), high - low)
    return out


def suggest(history: list[tuple[dict, float]], space: dict[str, Range], rng: np.random.Generator, pending: list[dict] = ()) -> dict:
    """The next parameters. The best ``GOOD_SHARE`` of the trials make one density per range, the others and the pending ones a second;
    of ``CANDIDATES`` draws from the first the one with the largest ratio wins. The first ``START`` are uniform draws."""
    if len(history) < START:
        return {name: r.outer(rng.uniform(*r.bounds)) for name, r in space.items()}
    ranked = sorted(range(len(history)), key=lambda i: (-history[i][1], i))
    cut = max(1, math.ceil(GOOD_SHARE * len(history)))
    good, bad = [history[i][0] for i in ranked[:cut]], [history[i][0] for i in ranked[cut:]] + list(pending)
    out = {}
    for name, r in space.items():
        low, high = r.bounds
        sets = []
        for group in (good, bad):
            points = np.array([r.inner(g[name]) for g in group])
            sets.append((points, _widths(points, low, high) if len(points) else points))
        best = None
        for _ in range(CANDIDATES):
            k = int(rng.integers(len(sets[0][0]) + 1))
            if k == len(sets[0][0]):
                u = rng.uniform(low, high)
            else:
                u = rng.normal(sets[0][0][k], sets[0][1][k])
                while not low <= u <= high:
                    u = rng.normal(sets[0][0][k], sets[0][1][k])
            ratio = _log_density(u, *sets[0], low, high) - _log_density(u, *sets[1], low, high)
            if best is None or ratio > best[0]:
                best = (ratio, u)
        out[name] = r.outer(best[1])
    return out


def search(evaluate: Callable, spaces: dict[str, dict[str, Range]], trials: int = 20, batch: int = 5, seed: int = SEED) -> list[tuple[str, int, dict, float, bool]]:
    """(learner, trial, parameters, value, stopped) of ``trials`` trials per learner, ``batch`` of each at a time.

    ``evaluate(list of (learner, parameters), share)`` gives the values after that share of the rounds. After ``FIRST_LOOK`` of
    them a trial below the median of all first looks at its learner stops; its value is the first look's. Equal seeds give equal trials.
    """
    rng = {name: np.random.default_rng([seed, k]) for k, name in enumerate(spaces)}
    rows: list[tuple[str, int, dict, float, bool]] = []
    history: dict[str, list] = {name: [] for name in spaces}
    looks: dict[str, list[float]] = {name: [] for name in spaces}
    for start in range(0, trials, batch):
        asked = []
        for name, space in spaces.items():
            mine: list[dict] = []
            for _ in range(min(batch, trials - start)):
                mine.append(suggest(history[name], space, rng[name], mine))
            asked += [(name, p) for p in mine]
        first = evaluate(asked, FIRST_LOOK)
        for (name, _), v in zip(asked, first):
            looks[name].append(v)
        going = [k for k, (name, _) in enumerate(asked) if first[k] >= float(np.median(looks[name]))]
        final = dict(zip(going, evaluate([asked[k] for k in going], 1.0)))
        for k, (name, p) in enumerate(asked):
            value = final.get(k, first[k])
            history[name].append((p, value))
            rows.append((name, len(history[name]) - 1, p, value, k not in final))
    return rows


def tune_learners(train: DataFrame, cols: list[str], trials: int = 20, folds: int = 3, batch: int = 10, spaces: dict | None = None, seed: int = SEED) -> DataFrame:
    """One row per learner and trial: parameters, mean fold F1 at probability 0.5, whether it was stopped early, and is_best of its learner."""
    spaces = SPACES if spaces is None else spaces
    data = cut_lineage(stratified_folds(train.select("user_id", "status", *cols), folds))
    n = {r["status"]: r["count"] for r in data.groupBy("status").count().collect()}
    weight = max(n.get(0, 0), 1) / max(n.get(1, 0), 1)

    def params(learner: str, p: dict, share: float) -> Params:
        known = {k: v for k, v in p.items() if k != "weight_factor"}
        known["rounds"] = max(1, round(share * p["rounds"]))
        if learner == "focal":
            return replace(Params(objective="focal", seed=seed), **known)
        return replace(Params(positive_weight=weight * p["weight_factor"], seed=seed), **known)

    def evaluate(asked: list, share: float) -> list[float]:
        if not asked:
            return []
        jobs = [Model(f"m{k}_{fold}", params(name, p, share), without=fold) for k, (name, p) in enumerate(asked) for fold in range(folds)]
        scored = score(data, fit_models(data, cols, jobs), ["status", "fold"])
        sums = []
        for k in range(len(asked)):
            hit = F.get(F.array(*[F.col(f"m{k}_{fold}") for fold in range(folds)]), F.col("fold")) >= 0.5
            sums += [F.count_if(hit & (F.col("status") == 1)).alias(f"tp{k}"), F.count_if(hit & (F.col("status") == 0)).alias(f"fp{k}"), F.count_if(~hit & (F.col("status") == 1)).alias(f"fn{k}")]
        totals = scored.groupBy("fold").agg(*sums).collect()  # one row per fold
        f1 = lambda r, k: 2 * r[f"tp{k}"] / max(1, 2 * r[f"tp{k}"] + r[f"fp{k}"] + r[f"fn{k}"])
        return [sum(f1(r, k) for r in totals) / folds for k in range(len(asked))]

    rows = search(evaluate, spaces, trials, batch, seed)
    best = {name: min((r for r in rows if r[0] == name and not r[4]), key=lambda r: (-r[3], r[1]))[1] for name in spaces if any(r[0] == name and not r[4] for r in rows)}
    names = sorted({k for space in spaces.values() for k in space})
    out = [(name, t, *[float(p[k]) if k in p else None for k in names], float(v), stopped, best.get(name) == t) for name, t, p, v, stopped in rows]
    return train.sparkSession.createDataFrame(out, "learner string, trial int, " + ", ".join(f"{k} double" for k in names) + ", f1 double, stopped boolean, is_best boolean")
