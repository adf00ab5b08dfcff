"""Hard negatives of labelled feature vectors, found in cover trees over norm-augmented candidates.

The vector records of this project are the users' feature vectors (``user_id``, ``vec``, with ``status`` as the label) in
fixed point (``vectors.fixed_point``), so that inner products are exact integers. Candidates are cut into blocks of one
label; a task builds a cover tree of a block once. The anchors, a stated query set, visit the blocks in chunks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import byte_batches, cut_lineage
from .vectors import common_length, usable

# candidates of a block, requests of a chunk, members of a leaf; the ratio of covering radii of neighbouring levels
BLOCK, CHUNK, LEAF, RATIO = 4096, 512, 32, 1.3
# pivots that blocks gather around: one per so many candidates of a label, at most MOST_PIVOTS, from a sample of SAMPLE vectors
PER_PIVOT, MOST_PIVOTS, SAMPLE = 16_384, 256, 4096
# leaves a request opens before its next bound is compared; doubled each time
LEAVES_AT_ONCE = 8
# blocks that share a slice, by which chunks find them
SLICE = 64
BATCH_BYTES = 16 << 20
NONE, MOST = -(1 << 63), (1 << 63) - 1


@dataclass
class CoverTree:
    """Members in an order in which every node owns a run of them; nodes level by level.

    ``centre`` is a place among the members, ``radius`` the largest augmented distance of the node's members from it.
    ``first``/``last`` are the run, ``parent`` the node above; a node without children is a leaf.
    """

    ids: np.ndarray
    points: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    parent: np.ndarray
    level: np.ndarray
    leaf: np.ndarray

    def to_bytes(self) -> bytes:
        parts = vars(self) | {"points": _narrow(self.points).ravel()}
        batch = pa.RecordBatch.from_arrays([_listed(v) for v in parts.values()], names=list(parts))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @staticmethod
    def from_bytes(data) -> CoverTree:
        batch = pa.ipc.open_stream(data).read_next_batch()
        got = {name: batch.column(i).flatten().to_numpy(zero_copy_only=False) for i, name in enumerate(batch.schema.names)}
        got["points"] = got["points"].astype(np.int64).reshape(len(got["ids"]), -1)
        return CoverTree(**got)


def _narrow(values: np.ndarray) -> np.ndarray:
    """The smallest integer type of 2, 4 or 8 bytes that holds the values."""
    most = np.abs(values).max(initial=0)
    return values.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def _listed(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.array([0, len(values)], np.int32), pa.array(values))


def build_tree(ids: np.ndarray, points: np.ndarray) -> CoverTree:
    """Cover tree of the points lifted to one norm: (x, sqrt(M - |x|^2)) with M the largest squared norm.

    On each level the children of a node are picked farthest first until every member lies within the level's covering radius,
    ``RATIO`` times smaller than the level above; the node's own centre is its first child. Nodes of at most
    ``LEAF`` members or of radius 0 (copies of one vector) are leaves.
    """
    x = points.astype(float)
    square = (x * x).sum(1)
    lift = np.sqrt(np.maximum(square.max(initial=0) - square, 0.0))
    x = np.hstack([x, lift[:, None]])
    order = np.arange(len(x))
    away = np.sqrt(((x - x[:1]) ** 2).sum(1))
    nodes: dict[str, list] = {k: [] for k in ("centre", "radius", "first", "last", "parent", "level", "leaf")}

    def add(centre, radius, first, last, parent, level):
        for k, v in zip(nodes, (centre, radius, first, last, parent, level, radius == 0 or last - first <= LEAF)):
            nodes[k].append(v)

    add(0, float(away.max(initial=0)), 0, len(x), -1, 0)
    bound = [nodes["radius"][0]]
    at = 0
    while at < len(nodes["centre"]):
        if not nodes["leaf"][at]:
            first, last, level = nodes["first"][at], nodes["last"][at], nodes["level"][at]
            own = order[first:last].copy()
            part = x[own]
            cover = min(bound[at], nodes["radius"][at]) / RATIO
            centres = [int(np.flatnonzero(own == nodes["centre"][at])[0])]
            near = ((part - part[centres[0]]) ** 2).sum(1)
            of = np.zeros(len(own), np.int64)
            while near.max() > cover * cover:
                pick = int(near.argmax())
                d = ((part - part[pick]) ** 2).sum(1)
                closer = d < near
                near[closer], of[closer] = d[closer], len(centres)
                centres.append(pick)
            rank = np.argsort(of, kind="stable")
            order[first:last] = own[rank]
            size = np.bincount(of, minlength=len(centres))
            radius = np.zeros(len(centres))
            np.maximum.at(radius, of, np.sqrt(near))
            ends = first + np.cumsum(size)
            for k, c in enumerate(centres):
                add(int(own[c]), float(radius[k]), int(ends[k] - size[k]), int(ends[k]), at, level + 1)
                bound.append(cover)
        at += 1
    place = np.empty(len(x), np.int64)
    place[order] = np.arange(len(x))
    arrays = {k: np.array(v) for k, v in nodes.items()}
    arrays["centre"] = place[arrays["centre"].astype(np.int64)]
    return CoverTree(ids[order], points[order], **arrays)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows: in doubles where no sum can leave 53 bits."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0)
    if float(most) * a.shape[1] < 2.0**53:
        return np.rint(a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def search(tree: CoverTree, queries: np.ndarray, of: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
    """(request, member id, score) of the first ``k`` members with ``low`` <= score <= ``high`` for each request.

    Request i asks for the inner products with vector ``queries[of[i]]``, leaving out the member with id ``own[i]``. Higher scores come
    first, ties by smaller id. Level by level, q.centre -+ |q| * radius bounds the products of a node; nodes outside the
    window fall. Leaves are opened from the best bound down, and a request stops when no bound reaches its k-th score.
    """
    n = len(of)
    # products of the centres are exact; the margin covers the rounding of |q| * radius
    centre = _products(queries, tree.points[tree.centre])[of].astype(float)
    reach = np.sqrt((queries.astype(float) ** 2).sum(1))[of][:, None] * tree.radius
    reach += 1e-9 * (np.abs(centre) + reach) + 1e-6
    best = centre + reach
    open_ = (best >= low[:, None]) & (centre - reach <= high[:, None])
    for level in range(1, int(tree.level.max(initial=0)) + 1):
        own_level = np.flatnonzero(tree.level == level)
        open_[:, own_level] &= open_[:, tree.parent[own_level]]
    leaves = np.flatnonzero(tree.leaf)
    leaves = leaves[np.argsort(tree.first[leaves])]
    leaf_of = np.repeat(np.arange(len(leaves)), tree.last[leaves] - tree.first[leaves])
    bound = np.where(open_[:, leaves], best[:, leaves], -np.inf)
    rank = np.argsort(-bound, axis=1, kind="stable")
    score, ids = np.full((n, k), NONE), np.full((n, k), MOST)
    alive, start, step = np.arange(n), 0, LEAVES_AT_ONCE
    while start < len(leaves) and len(alive):
        some = rank[alive, start : start + step]
        reaches = np.take_along_axis(bound[alive], some, 1)
        least = np.where(score[alive, -1] == NONE, -np.inf, score[alive, -1].astype(float))
        go = (reaches > -np.inf) & (reaches >= least[:, None])
        alive, some, go = alive[go.any(1)], some[go.any(1)], go[go.any(1)]
        opened = np.zeros((len(alive), len(leaves)), bool)
        np.put_along_axis(opened, some, go, 1)
        members = np.flatnonzero(opened.any(0)[leaf_of])
        got, names = _products(queries[of[alive]], tree.points[members]), tree.ids[members]
        fits = opened[:, leaf_of[members]] & (got >= np.maximum(low[alive], score[alive, -1])[:, None]) & (got <= high[alive][:, None])
        i, j = np.nonzero(fits & (names[None, :] != own[alive][:, None]))
        r = np.concatenate([np.repeat(alive, k), alive[i]])
        s = np.concatenate([score[alive].ravel(), got[i, j]])
        name = np.concatenate([ids[alive].ravel(), names[j]])
        by = np.lexsort((name, ~s, r))
        r, s, name = r[by], s[by], name[by]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        keep = place < k
        score[r[keep], place[keep]], ids[r[keep], place[keep]] = s[keep], name[keep]
        start, step = start + step, 2 * step
    i, j = np.nonzero(score != NONE)
    return i, ids[i, j], score[i, j]


# ---- Spark side ----


def _vectors_of(column, dims: int) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _pivots(rows: DataFrame, dims: int, count: int) -> np.ndarray:
    """Vectors picked farthest first from the ``SAMPLE`` rows with the smallest hash."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vec").toArrow().column("vec")
    x = _vectors_of(got, dims).astype(float)
    chosen = [0]
    near = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < count and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _cells(pivots: np.ndarray):
    half = (pivots**2).sum(1) / 2

    def emit(batches):
        for b in batches:
            x = _vectors_of(b.column(2), pivots.shape[1]).astype(float)
            cell = (x @ pivots.T - half).argmax(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(cell, pa.int64())], names=["id", "label", "vec", "cell"])

    return emit


def _tree_of(dims: int):
    def grow(key, table):
        ids = table.column("id").to_numpy()
        by = np.argsort(ids)
        tree = build_tree(ids[by], _vectors_of(table.column("vec"), dims)[by])
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "label": table.column("label").slice(0, 1), "tree": pa.array([tree.to_bytes()], pa.binary())})

    return grow


def grow_trees(rows: DataFrame, dims: int) -> DataFrame:
    """(block, label, tree): cover trees of about ``BLOCK`` rows of one label near one pivot.

    A crowded cell is cut into as many blocks as its count asks for, by a hash of the id.
    """
    total = rows.count()
    pivots = _pivots(rows, dims, max(1, min(MOST_PIVOTS, total // PER_PIVOT)))
    rows = rows.mapInArrow(_cells(pivots), rows.select("id", "label", "vec", F.lit(0).cast("bigint").alias("cell")).schema)
    rows = cut_lineage(rows)
    parts = rows.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    rows = rows.join(parts, ["label", "cell"])
    block = F.xxhash64("label", "cell", F.pmod(F.xxhash64("id", F.lit(7)), "parts"))
    label = rows.schema["label"].dataType.simpleString()
    return cut_lineage(rows.select("id", "label", "vec", block.alias("block")).groupBy("block").applyInArrow(_tree_of(dims), f"block bigint, label {label}, tree binary"))


def _packed(values: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(values).tobytes()], pa.binary())


def _chunk_of(dims: int):
    def pack(key, table):
        ids, first, of = np.unique(table.column("id").to_numpy(), return_index=True, return_inverse=True)
        requests = np.stack([*(table.column(c).to_numpy() for c in ("low", "high", "id", "mark")), of], 1)
        queries = _narrow(_vectors_of(table.column("vec").take(pa.array(first)), dims))
        return pa.table({"chunk": pa.array([key[0].as_py()], pa.int64()), "label": table.column("label").slice(0, 1), "requests": _packed(requests), "queries": _packed(queries)})

    return pack


def _visit(dims: int, k: int):
    """Each row is a chunk of requests at a tree."""

    def emit(batches):
        for b in batches:
            for row in range(b.num_rows):
                low, high, own, mark, of = np.frombuffer(b.column(0)[row].as_buffer(), np.int64).reshape(-1, 5).T
                data = b.column(1)[row].as_buffer()
                width = len(data) // ((int(of.max()) + 1) * dims)
                queries = np.frombuffer(data, f"i{width}").reshape(-1, dims).astype(np.int64)
                tree = CoverTree.from_bytes(b.column(2)[row].as_buffer())
                i, ids, score = search(tree, queries, of, own, low, high, k)
                yield pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(mark[i]), pa.array(ids), pa.array(score)], names=["anchor_id", "mark", "member_id", "score"])

    return emit


def _search_all(requests: DataFrame, trees: DataFrame, dims: int, k: int, same_label: bool) -> DataFrame:
    """(anchor_id, mark, member_id, score, rank): the first ``k`` of each request over the trees of its own or of all other labels.

    ``requests`` are (id, label, vec, low, high, mark). They travel in chunks of one label; a chunk finds the blocks slice by slice. The
    chunk is what is repeated per visit, a tree moves once.
    """
    spark = requests.sparkSession
    label = requests.schema["label"].dataType.simpleString()
    sizes = requests.groupBy("label").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    chunk = F.xxhash64("label", F.pmod(F.xxhash64("id", F.lit(3)), "parts"))
    chunks = requests.join(sizes, "label").withColumn("chunk", chunk).groupBy("chunk")
    chunks = cut_lineage(chunks.applyInArrow(_chunk_of(dims), f"chunk bigint, label {label}, requests binary, queries binary"))
    slices = -(-trees.count() // SLICE)
    at = F.pmod(F.xxhash64("block", F.lit(5)), F.lit(max(slices, 1)).cast("bigint"))
    blocks = trees.select("block", F.col("label").alias("other"), at.alias("slice"))
    visits = chunks.select("chunk", "label", F.explode(F.sequence(F.lit(0), F.lit(max(slices, 1) - 1)).cast("array<bigint>")).alias("slice")).join(blocks, "slice")
    visits = visits.where(F.col("label") == F.col("other") if same_label else F.col("label") != F.col("other"))
    visits = cut_lineage(visits.select("chunk", "block"))
    loaded = visits.join(chunks.drop("label"), "chunk").join(trees.drop("label"), "block").select("requests", "queries", "tree")
    with byte_batches(spark, BATCH_BYTES):
        found = cut_lineage(loaded.mapInArrow(_visit(dims, k), "anchor_id bigint, mark bigint, member_id bigint, score bigint"))
    first = Window.partitionBy("anchor_id", "mark").orderBy(F.desc("score"), "member_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "user_id",
    label: str = "status",
    vec: str = "vec",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are integer inner products; higher ones come first, ties by smaller id. A row for which ``is_anchor`` holds is an anchor;
    its positives are the first ``positives`` other rows of its label. For each positive, the first ``negatives`` rows of other
    labels whose score is from ``low`` to ``high`` percent of the positive's are returned. The result is exact: bounds of the trees only
    skip members that cannot be in it.

    Defined results: rows with a null id or label, and vectors that are null, hold a null or non-finite entry or have another
    length than most, take no part; of rows that repeat an id the smallest by (label, vector) takes part; fewer positives or negatives than asked
    for give fewer rows, a negative positive score none; an empty table or no anchor gives no row. Extra columns are ignored.
    """
    dims = common_length(vectors, vec)
    vectors = vectors.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label}`").isNotNull() & usable(F.col(f"`{vec}`")) & (F.size(f"`{vec}`") == dims))
    rows = vectors.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vec}`").cast("array<bigint>").alias("vec"),
        F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"),
    )
    rows = cut_lineage(rows.groupBy("id").agg(F.min(F.struct("label", "vec", "is_anchor")).alias("row")).select("id", "row.*"))
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not dims or rows.isEmpty():
        return vectors.sparkSession.createDataFrame([], out)
    trees = grow_trees(rows.select("id", "label", "vec"), dims)
    anchors = rows.where("is_anchor").select("id", "label", "vec")
    everything = (F.lit(NONE + 1).alias("low"), F.lit(MOST).alias("high"), F.lit(0).cast("bigint").alias("mark"))
    best = cut_lineage(_search_all(anchors.select("*", *everything), trees, dims, positives, True).where("score >= 0").select("anchor_id", "member_id", "score"))
    windows = best.join(anchors, best["anchor_id"] == anchors["id"]).select(
        "id", "label", "vec", F.expr(f"(score * {int(low)} + 99) div 100").alias("low"), F.expr(f"score * {int(high)} div 100").alias("high"), F.col("member_id").alias("mark")
    )
    found = _search_all(windows, trees, dims, negatives, False).withColumnRenamed("mark", "positive_id")
    pairs = best.select("anchor_id", F.col("member_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(pairs, ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", F.col("member_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
