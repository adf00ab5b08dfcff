"""Exact path-dependent Shapley values of boosted trees.

The value of a set of features is the tree's mean leaf when splits on other features send a row both ways in the shares of
their training weight. A leaf only sees the few features on its path, and a row either follows all splits of
such a feature or not; so each leaf has one small table of contributions, looked up by the row's pattern.
"""

from __future__ import annotations

from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees, Tree


def _paths(tree: Tree) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """(leaf value, features on the path) per leaf; a feature has (column, low, high, share): the path takes low < x <= high,
    which holds ``share`` of the weight at the splits on it."""
    out, todo = [], [(0, {})]
    while todo:
        node, seen = todo.pop()
        f = tree.feature[node]
        if f < 0:
            out.append((tree.leaf[node], [(c, *v) for c, v in seen.items()]))
            continue
        low, high, share = seen.get(f, (-np.inf, np.inf, 1.0))
        cut = tree.value[node]
        for child, bounds in ((tree.left[node], (low, min(high, cut))), (tree.right[node], (max(low, cut), high))):
            todo.append((child, seen | {f: (*bounds, share * tree.cover[child] / tree.cover[node])}))
    return out


def _table(value: float, shares: list[float]) -> np.ndarray:
    """(pattern, feature) contributions of a leaf; bit i of the pattern is set if the row follows all splits on feature i."""
    m = len(shares)
    patterns = np.arange(1 << m)
    follows = (patterns[:, None] >> np.arange(m)) & 1
    out = np.zeros((1 << m, m))
    for i in range(m):
        rest = [j for j in range(m) if j != i]
        # coefficients by size of the set: products of (follows x + share) over the other features
        poly = np.zeros((1 << m, m))
        poly[:, 0] = 1.0
        for j in rest:
            poly[:, 1:] = poly[:, 1:] * shares[j] + poly[:, :-1] * follows[:, j : j + 1]
            poly[:, 0] *= shares[j]
        weights = np.array([factorial(k) * factorial(m - k - 1) / factorial(m) for k in range(m)])
        out[:, i] = value * (poly @ weights) * (follows[:, i] - shares[i])
    return out


def explainer(model: BoostedTrees):
    """(function of a matrix of rows to contributions per column, base value)."""
    leaves, base = [], model.start
    for tree in model.trees:
        for value, features in _paths(tree):
            shares = [f[3] for f in features]
            base += value * float(np.prod(shares))
            if features:
                leaves.append(([f[0] for f in features], [f[1] for f in features], [f[2] for f in features], _table(value, shares)))

    def explain(x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), len(model.columns)))
        for columns, low, high, table in leaves:
            part = x[:, columns]
            pattern = (((part > low) & (part <= high)) << np.arange(len(columns))).sum(1)
            out[:, columns] += table[pattern]
        return out

    return explain, base


def tree_attributions(df: DataFrame, model: BoostedTrees, key: str = "user_id") -> DataFrame:
    """(key, feature, fidx, value, shap): the contribution of every column to each user's margin, in the long form of ``attributions``.

    The trees travel to the tasks: rounds x 2^depth x 2^depth numbers at most, whatever the number of users. Contributions and
    ``base_value`` of the model add up to the margin. Missing values count as 0; repeated users get equal rows.
    """
    cols = model.columns
    explain, _ = explainer(model)
    ready = df.select(key, F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in cols]).alias("x"))

    def emit(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(cols))
            lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, len(cols), dtype=np.int32), explain(x).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=[key, "x", "shap"])

    kind = ready.schema[key].dataType.simpleString()
    wide = ready.mapInArrow(emit, f"`{key}` {kind}, x array<double>, shap array<double>")
    names = F.array(*[F.lit(c) for c in cols])
    entries = F.transform(F.arrays_zip("x", "shap"), lambda z, i: F.struct(F.get(names, i).alias("feature"), i.alias("fidx"), z["x"].alias("value"), z["shap"].alias("shap")))
    return wide.select(key, F.inline(entries))


def base_value(model: BoostedTrees) -> float:
    return explainer(model)[1]
