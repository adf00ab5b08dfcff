"""Second-order boosted trees with any gradient, grown level by level by one Spark job for all models at once.

Features are put into quantile bins once and packed by column, some thousand users a row. A level is one pass over the users: each task sums
gradients and Hessians by (model, node, feature, bin), the sums of all tasks meet by model, and one row of splits per model comes back. Folds, learners
and trials are models of the same pass, so a cross-validated stack costs no more jobs than a single model; where the users fill
few tasks, the models are dealt over groups of tasks. Users of at most ``WHOLE`` tasks are one part, and a task grows all rounds of its models.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_written

# quantile bins of a feature; rounds after which the scores so far are written (those between are kept by Spark's cache); bytes of bins per task; tasks whose sums meet first
BINS, KEEP_EVERY, TASK_BYTES, MERGE = 48, 10, 24 << 20, 32
# a table of at most so many tasks' bytes is one part: no job per level
WHOLE = 3
LEAST_HESSIAN = 1e-7


@dataclass(frozen=True)
class Params:
    """A learner. ``positive_weight`` weighs positives; ``objective`` is "logistic" or "focal" (``alpha``, ``gamma``).

    ``row_share`` and ``column_share`` are drawn anew each round from hashes, so a task that runs again draws the same rows.
    """

    rounds: int = 100
    depth: int = 4
    step: float = 0.1
    ridge: float = 1.0
    min_hessian: float = 1e-3
    row_share: float = 1.0
    column_share: float = 1.0
    positive_weight: float = 1.0
    objective: str = "logistic"
    alpha: float = 0.75
    gamma: float = 2.0
    seed: int = 42


@dataclass(frozen=True)
class Model:
    """One model of a pass: rows of fold ``without`` are left out; ``kinds`` are the values of ``kind`` it learns from (all if empty)."""

    name: str
    params: Params
    without: int | None = None
    kinds: tuple[int, ...] = ()


@dataclass(frozen=True)
class _Walk:
    """What it takes to send rows down a tree, as arrays."""

    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaf: np.ndarray

    def rows(self, x: np.ndarray, some: np.ndarray | None = None) -> dict[int, np.ndarray]:
        """Which rows (of ``some``, else of all) end in each node without a split; ``x`` has one array per column. Children follow their parent."""
        out = {0: np.arange(x.shape[1]) if some is None else some}
        for node in range(len(self.feature)):
            if self.feature[node] >= 0:
                here = out.pop(node)
                go = x[self.feature[node]][here] <= self.limit[node]
                out[int(self.left[node])], out[int(self.right[node])] = here[go], here[~go]
        return out

    def values(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape[1])
        for node, rows in self.rows(x).items():
            out[rows] = self.leaf[node]
        return out


@dataclass
class Tree:
    """Nodes in arrays: feature (-1 at a leaf), bin and value of the split (left: at most), children, leaf value and Hessian sum."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    leaf: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, leaf: float, cover: float) -> int:
        for name, v in (("feature", -1), ("bin", 0), ("value", 0.0), ("left", -1), ("right", -1), ("leaf", leaf), ("cover", cover), ("gain", 0.0)):
            getattr(self, name).append(v)
        return len(self.feature) - 1

    def walk(self, by_bin: bool) -> _Walk:
        limit = np.array(self.bin, np.int64) if by_bin else np.array(self.value, float)
        return _Walk(np.array(self.feature, np.int64), limit, np.array(self.left, np.int64), np.array(self.right, np.int64), np.array(self.leaf, float))


@dataclass
class BoostedTrees:
    """A fitted model over ``columns``: ``start`` plus the leaf values of all trees is the margin."""

    columns: list[str]
    start: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, by_column = np.full(len(x), self.start), np.ascontiguousarray(x.T)
        for tree in self.trees:
            out += tree.walk(False).values(by_column)
        return out

    def importance(self) -> list[float]:
        """Total gain of the splits on each column."""
        out = [0.0] * len(self.columns)
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain):
                if f >= 0:
                    out[f] += g
        return out


def gradients(margin: np.ndarray, y: np.ndarray, params: Params) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss by the margin (the focal Hessian is the usual approximation)."""
    p = 1 / (1 + np.exp(-margin))
    weight = np.where(y == 1, params.positive_weight, 1.0)
    if params.objective == "focal":
        right = np.where(y == 1, p, 1 - p)
        weight = weight * np.where(y == 1, params.alpha, 1 - params.alpha) * (1 - right) ** params.gamma
    return weight * (p - y), np.maximum(weight * p * (1 - p), LEAST_HESSIAN)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def sampled(draw: np.ndarray, round_no: int, params: Params) -> np.ndarray:
    """Rows a round learns from."""
    if params.row_share >= 1:
        return np.ones(len(draw), bool)
    u = _mixed(draw.astype(np.uint64) + np.uint64(((round_no + 1) * 0x9E3779B97F4A7C15 + params.seed) % (1 << 64)))
    return u.astype(float) / 2.0**64 < params.row_share


def drawn_columns(count: int, round_no: int, params: Params) -> np.ndarray:
    if params.column_share >= 1:
        return np.arange(count)
    order = np.random.default_rng([params.seed, round_no]).permutation(count)
    return np.sort(order[: max(1, round(params.column_share * count))])


def bin_edges(df: DataFrame, cols: list[str], bins: int = BINS) -> list[list[float]]:
    """Distinct quantiles of each column, from one aggregate; a value goes to the number of edges below it."""
    shares = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    row = df.agg(*[F.percentile_approx(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)), shares, F.lit(10_000)).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    return [sorted(set(row[f"q{i}"] or [])) for i in range(len(cols))]


def _binned(df: DataFrame, cols: list[str], edges: list[list[float]], keep: list[str]) -> DataFrame:
    limits = [np.array(e) for e in edges]
    ready = df.select(*keep, F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in cols]).alias("x"))

    def emit(batches):
        for b in batches:
            x = b.column(len(keep)).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(cols))
            codes = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(limits)], 1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], pa.array([r.tobytes() for r in codes], pa.binary())], names=[*keep, "bins"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.select(*keep).schema)
    return ready.mapInArrow(emit, f"{schema}, bins binary")


@dataclass
class _Growing:
    """State of one model during a round."""

    model: Model
    start: float
    trees: list[Tree] = field(default_factory=list)
    tree: Tree | None = None
    open: list[int] = field(default_factory=list)
    columns: np.ndarray | None = None

    def sprout(self, columns: int, round_no: int) -> None:
        self.tree, self.columns, self.open = Tree(), drawn_columns(columns, round_no, self.model.params), [0]
        self.tree.add(0.0, 0.0)


@dataclass(frozen=True)
class _Task:
    """What a level needs to know of a model: its number, the place of its margin in its group, the tree so far and its open nodes."""

    number: int
    group: int
    place: int
    model: Model
    tree: _Walk
    open: list[int]
    columns: np.ndarray

    def splits(self, sums: np.ndarray, width: int) -> bytes:
        return best_splits(sums.reshape(len(self.open), len(self.columns), width, 2), self.model.params).tobytes()


def _members(model: Model, fold: np.ndarray, kind: np.ndarray) -> np.ndarray:
    out = np.ones(len(fold), bool) if model.without is None else fold != model.without
    return out & np.isin(kind, model.kinds) if model.kinds else out


class _Block:
    """Some thousand users: labels, folds, kinds, draws, bins by column, and the margins of the models of one group."""

    TYPES = (np.int8, np.int32, np.int32, np.int64, np.uint8, np.float64)

    def __init__(self, batch: pa.RecordBatch, i: int):
        self.group, self.n = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
        flat = [np.frombuffer(batch.column(2 + k)[i].as_buffer(), kind) for k, kind in enumerate(self.TYPES)]
        self.y, self.fold, self.kind, self.draw = flat[:4]
        self.bins, self.margins = flat[4].reshape(-1, self.n), flat[5].reshape(-1, self.n).copy()


STATE = "part int, n int, y binary, fold binary, kind binary, draw binary, bins binary, margins binary"
STATE_NAMES = [c.split()[0] for c in STATE.split(", ")]


def _packed(starts: list[list[float]]):
    """One row per batch of users and group of models."""

    def emit(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            y, fold, kind, draw = (b.column(i).to_numpy(zero_copy_only=False).astype(t).tobytes() for i, t in enumerate(_Block.TYPES[:4]))
            bins = np.ascontiguousarray(np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(n, -1).T).tobytes()
            for group, own in enumerate(starts):
                margins = np.repeat(np.array(own, np.float64), n).tobytes()
                values = [pa.array([group], pa.int32()), pa.array([n], pa.int32()), *[pa.array([v], pa.binary()) for v in (y, fold, kind, draw, bins, margins)]]
                yield pa.RecordBatch.from_arrays(values, names=STATE_NAMES)

    return emit


def _sums(block: _Block, t: _Task, width: int, round_no: int) -> np.ndarray:
    """Sums of gradients and Hessians over a block, as (nodes, columns, bins, 2)."""
    use = _members(t.model, block.fold, block.kind) & sampled(block.draw, round_no, t.model.params)
    ends = t.tree.rows(block.bins, np.flatnonzero(use))
    chosen = [ends[node] for node in t.open]
    order = np.concatenate(chosen)
    g, h = gradients(block.margins[t.place][order], block.y[order], t.model.params)
    first = np.repeat(np.arange(len(chosen)) * width, [len(r) for r in chosen])
    out = np.empty((len(chosen), len(t.columns), width, 2))
    for j, c in enumerate(t.columns):
        slot = first + block.bins[c].take(order)
        for k, v in enumerate((g, h)):
            out[:, j, :, k] = np.bincount(slot, v, len(chosen) * width).reshape(len(chosen), width)
    return out


def _sum_rows(tasks: list[_Task], width: int, round_no: int):
    """Per task and model: the sums of its blocks."""

    def emit(batches):
        totals: dict = {}
        for b in batches:
            for i in range(b.num_rows):
                block = _Block(b, i)
                for t in tasks:
                    if t.group == block.group:
                        totals[t.number] = totals.get(t.number, 0) + _sums(block, t, width, round_no)
        some = [t for t in tasks if t.number in totals]
        if some:
            part = TaskContext.get().partitionId() // MERGE
            numbers = pa.array([t.number for t in some], pa.int64())
            found = pa.array([totals[t.number].tobytes() for t in some], pa.binary())
            yield pa.RecordBatch.from_arrays([numbers, pa.array([part] * len(some), pa.int64()), found], names=["model", "part", "sums"])

    return emit


def _whole_rows(own: dict[int, list[tuple[int, int, Model, float]]], edges: list[list[float]], width: int):
    """All rounds of the models of a group, (number, place, model, start), over the one part that holds its users: their pickled trees."""

    def emit(batches):
        blocks = [_Block(b, i) for b in batches for i in range(b.num_rows)]
        for number, place, model, start in own[blocks[0].group] if blocks else []:
            s = _Growing(model, start)
            for round_no in range(model.params.rounds):
                s.sprout(len(edges), round_no)
                for level in range(model.params.depth):
                    if not s.open:
                        break
                    t = _Task(number, blocks[0].group, place, model, s.tree.walk(True), s.open, s.columns)
                    total = sum(_sums(block, t, width, round_no) for block in blocks)
                    _grow(s, best_splits(total, model.params), edges, level + 1 < model.params.depth)
                s.trees.append(s.tree)
                walk = s.tree.walk(True)
                for block in blocks:
                    block.margins[place] += walk.values(block.bins)
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([pickle.dumps(s.trees)], pa.binary())], names=["model", "trees"])

    return emit


def _merged(key, table):
    total = sum(np.frombuffer(x.as_buffer(), float) for x in table.column("sums"))
    return pa.table({"model": pa.array([key[0].as_py()]), "part": pa.array([key[1].as_py()]), "sums": pa.array([total.tobytes()], pa.binary())})


def best_splits(sums: np.ndarray, params: Params) -> np.ndarray:
    """Per node: gain, column place, bin, G, H, G of the left side, H of the left side; the first of equal gains. No split: place -1."""
    out = np.zeros((len(sums), 7))
    for k, s in enumerate(sums):
        g_all, h_all = s[0, :, 0].sum(), s[0, :, 1].sum()
        left = np.cumsum(s, axis=1)[:, :-1]
        g, h = left[..., 0], left[..., 1]
        fits = (h >= params.min_hessian) & (h_all - h >= params.min_hessian)
        gain = np.where(fits, g * g / (h + params.ridge) + (g_all - g) ** 2 / (h_all - h + params.ridge) - g_all * g_all / (h_all + params.ridge), -np.inf)
        at = np.unravel_index(int(np.argmax(gain)), gain.shape)
        found = gain[at] > 1e-9
        out[k] = (gain[at], at[0], at[1], g_all, h_all, g[at], h[at]) if found else (0, -1, 0, g_all, h_all, 0, 0)
    return out


def _splitter(tasks: list[_Task], width: int):
    small = {t.number: _Task(t.number, t.group, t.place, t.model, None, t.open, t.columns) for t in tasks}

    def split(key, table):
        number = key[0].as_py()
        total = sum(np.frombuffer(x.as_buffer(), float) for x in table.column("sums"))
        return pa.table({"model": pa.array([number]), "best": pa.array([small[number].splits(total, width)], pa.binary())})

    return split


def _advance(new: dict[tuple[int, int], _Walk]):
    """The blocks with the new trees, by (group, place), added to their margins."""

    def emit(batches):
        for b in batches:
            margins = []
            for i in range(b.num_rows):
                block = _Block(b, i)
                for (group, place), tree in new.items():
                    if group == block.group:
                        block.margins[place] += tree.values(block.bins)
                margins.append(block.margins.tobytes())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(7)], pa.array(margins, pa.binary())], names=STATE_NAMES)

    return emit


def _by_group(written: DataFrame, groups: int, parts: int) -> DataFrame:
    """The blocks in at most ``parts`` tasks for each group of models."""
    if parts == 1:  # a union of single partitions is a single partition, one task for all groups
        return written.repartitionById(groups, F.col("part")).persist()
    out = [written.where(F.col("part") == g).coalesce(parts) for g in range(groups)]
    return reduce(DataFrame.unionAll, out).persist()


def fit_models(df: DataFrame, cols: list[str], models: list[Model], label: str = "status", key: str = "user_id", bins: int = BINS) -> dict[str, BoostedTrees]:
    """Fit all models in one sequence of passes over (key, label, cols and, where a model asks for it, fold and kind).

    A level costs one job whatever the number of rows and models, and users that fit one part cost one job in all. Driver traffic is a few numbers per open node.

    Defined results: missing values count as 0; rows with a null label are left out; a model without rows or with one class
    only is its start score; columns without variance are never split on.
    """
    keep = [c for c in ("fold", "kind") if c in df.columns]
    labelled = df.where(F.col(label).isNotNull())
    edges = bin_edges(labelled, cols, bins)
    width = max((len(e) for e in edges), default=0) + 1
    ready = labelled.select(
        F.col(label).cast("int").alias("y"), *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) if c in keep else F.lit(0).alias(c) for c in ("fold", "kind")],
        F.xxhash64(key).alias("draw"), *[F.col(f"`{c}`") for c in cols],
    )
    table = cut_lineage(_binned(ready, cols, edges, ["y", "fold", "kind", "draw"]))
    counts = table.groupBy("fold", "kind", "y").agg(F.count("*").alias("n")).collect()  # folds x kinds x 2 rows
    rows = sum(r["n"] for r in counts)
    states = [_Growing(m, _start_score(m, counts)) for m in models]
    # few users are few parts: then groups of models share the cores, each with its own copy of the bins
    size = lambda n: max(1, -(-rows * (len(cols) + 8 * n + 17) // TASK_BYTES))
    cores = df.sparkSession.sparkContext.defaultParallelism
    groups = max([g for g in range(1, min(len(states), cores) + 1) if g * size(-(-len(states) // g)) <= cores], default=1)
    parts = size(-(-len(states) // groups))
    dealt = max(1, min(len(states), cores))
    if size(-(-len(states) // dealt)) <= WHOLE:
        groups, parts = dealt, 1
    at = [(j % groups, j // groups) for j in range(len(states))]
    starts = [[s.start for s in states[g::groups]] for g in range(groups)]
    written = cut_lineage(table.repartition(parts).mapInArrow(_packed(starts), STATE))
    state, old = _by_group(written, groups, parts), None
    last_round = max((m.params.rounds for m in models), default=0) - 1
    if parts == 1:
        own: dict = {g: [] for g in range(groups)}
        for j, s in enumerate(states):
            if abs(s.start) < 30:
                own[at[j][0]].append((j, at[j][1], s.model, s.start))
        for r in state.mapInArrow(_whole_rows(own, edges, width), "model bigint, trees binary").collect():
            states[r["model"]].trees = pickle.loads(r["trees"])
        last_round = -1
    for round_no in range(last_round + 1):
        live = [s for s in states if round_no < s.model.params.rounds and abs(s.start) < 30]
        if not live:
            break
        for s in live:
            s.sprout(len(cols), round_no)
        for level in range(max(s.model.params.depth for s in live)):
            tasks = [_Task(j, *at[j], s.model, s.tree.walk(True), s.open, s.columns) for j, s in enumerate(states) if s.open]
            if not tasks:
                break
            sums = state.mapInArrow(_sum_rows(tasks, width, round_no), "model bigint, part bigint, sums binary")
            if parts > MERGE:
                sums = sums.groupBy("model", "part").applyInArrow(_merged, "model bigint, part bigint, sums binary")
            splits = sums.groupBy("model").applyInArrow(_splitter(tasks, width), "model bigint, best binary")
            best = {r["model"]: np.frombuffer(r["best"], float).reshape(-1, 7) for r in splits.collect()}
            if old is not None:  # the margins of this round are in the cache now
                old.unpersist()
                old = None
            for t in tasks:
                _grow(states[t.number], best.get(t.number), edges, level + 1 < t.model.params.depth)
        new = {}
        for j, s in enumerate(states):
            if any(s is o for o in live):
                s.trees.append(s.tree)
                s.open = []
                new[at[j]] = s.tree.walk(True)
        if round_no == last_round:
            break
        moved = state.mapInArrow(_advance(new), STATE)
        if (round_no + 1) % KEEP_EVERY == 0:
            moved = cut_lineage(moved)
            ready = _by_group(moved, groups, parts)
            state.unpersist()
            drop_written(written)
            state, written = ready, moved
        else:
            old, state = state, moved.persist()
    state.unpersist()
    if old is not None:
        old.unpersist()
    drop_written(written)
    drop_written(table)
    return {s.model.name: BoostedTrees(list(cols), s.start, s.trees) for s in states}


def _start_score(model: Model, counts: list) -> float:
    own = [r for r in counts if (model.without is None or r["fold"] != model.without) and (not model.kinds or r["kind"] in model.kinds)]
    pos = sum(r["n"] for r in own if r["y"] == 1) * model.params.positive_weight
    neg = sum(r["n"] for r in own if r["y"] == 0)
    if not pos or not neg:
        return 35.0 if pos else -35.0
    return float(np.log(pos / neg)) if model.params.objective == "logistic" else 0.0


def _grow(s: _Growing, best: np.ndarray | None, edges: list[list[float]], deeper: bool) -> None:
    """Split the open nodes of a model's tree; the children's leaf values follow from the sums of the split."""
    p, following = s.model.params, []
    value = lambda g, h: float(-p.step * g / (h + p.ridge))
    for k, node in enumerate(s.open):
        if best is None:
            continue
        gain, at, b, g, h, gl, hl = best[k]
        s.tree.leaf[node], s.tree.cover[node] = value(g, h), float(h)
        if at < 0:
            continue
        c = int(s.columns[int(at)])
        left, right = s.tree.add(value(gl, hl), float(hl)), s.tree.add(value(g - gl, h - hl), float(h - hl))
        s.tree.feature[node], s.tree.bin[node], s.tree.left[node], s.tree.right[node] = c, int(b), left, right
        s.tree.value[node], s.tree.gain[node] = float(edges[c][int(b)]) if int(b) < len(edges[c]) else float("inf"), float(gain)
        following += [left, right]
    s.open = following if deeper else []


def score(df: DataFrame, models: dict[str, BoostedTrees], keep: list[str], as_margin: bool = False) -> DataFrame:
    """``keep`` and one column per model: its probability of the positive class (or its margin)."""
    cols = list(next(iter(models.values())).columns)
    ready = df.select(F.struct(*keep).alias("row"), F.array(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)) for c in cols]).alias("x"))
    fitted = df.sparkSession.sparkContext.broadcast(list(models.values()))  # rounds x 2^depth numbers a model

    def emit(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(cols))
            out = np.stack([m.margin(x) for m in fitted.value], 1)
            out = out if as_margin else 1 / (1 + np.exp(-out))
            lists = pa.ListArray.from_arrays(np.arange(0, (b.num_rows + 1) * out.shape[1], out.shape[1], dtype=np.int32), out.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["row", "scores"])

    row = ready.schema["row"].dataType.simpleString()
    scored = ready.mapInArrow(emit, f"row {row}, scores array<double>")
    return scored.select("row.*", *[F.get("scores", F.lit(i)).alias(name) for i, name in enumerate(models)])
