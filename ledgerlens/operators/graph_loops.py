"""Iterative graph operators: every round is a join and an aggregate, written to
reliable storage before the next one starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, drop_written

# Damping, iteration limit and tolerance per node; pivots of the sampled centrality.
ALPHA, MAX_ITER, TOLERANCE = 0.85, 100, 1e-6
PIVOTS = 500


def pagerank(edges: DataFrame, nodes: DataFrame, alpha: float = ALPHA, max_iter: int = MAX_ITER, tol: float = TOLERANCE) -> DataFrame:
    """(node, rank). Ranks sum to 1; the mass of nodes without out-edges is spread evenly."""
    out_degree = edges.groupBy("src").agg(F.count("*").alias("deg"))
    links = cut_lineage(edges.join(out_degree, "src").select("src", "dst", (1.0 / F.col("deg")).alias("share")))
    base = cut_lineage(
        nodes.join(out_degree, nodes.node == out_degree.src, "left").select("node", F.col("src").isNull().alias("dangling"))
    )
    n = base.count()
    if n == 0:
        return base.select("node", F.lit(0.0).alias("rank"))
    ranks = base.withColumn("rank", F.lit(1.0 / n))
    hanging = base.where("dangling").count() / n
    before = None
    for _ in range(max_iter):
        got = links.join(ranks.select(F.col("node").alias("src"), "rank"), "src").groupBy("dst").agg(
            F.sum(F.col("rank") * F.col("share")).alias("got")
        )
        new = alpha * (F.coalesce("got", F.lit(0.0)) + hanging / n) + (1 - alpha) / n
        written = cut_lineage(
            ranks.join(got, ranks.node == got.dst, "left").select(
                "node", "dangling", new.alias("rank"), F.abs(new - F.col("rank")).alias("moved")
            )
        )
        moved, hanging = written.agg(
            F.sum("moved"), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))
        ).first()
        ranks = written.drop("moved")
        if before is not None:
            drop_written(before)
        before = written
        if moved < n * tol:
            break
    return ranks.select("node", "rank")


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): the least node id reachable ignoring direction.

    A round takes the least label among the neighbours and then the label of the label,
    so long chains shrink quickly.
    """
    both = cut_lineage(
        edges.where("src <> dst").select("src", "dst").unionByName(edges.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    )
    labels = cut_lineage(nodes.select("node", F.col("node").alias("component")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("src"), "component"), "src").groupBy(
            F.col("dst").alias("node")
        ).agg(F.min("component").alias("heard"))
        near = cut_lineage(
            labels.join(heard, "node", "left").select(
                "node", F.col("component").alias("old"), F.least("component", "heard").alias("component")
            )
        )
        if near.where("old <> component").isEmpty():
            drop_written(near)
            return labels
        jump = near.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = cut_lineage(near.join(jump, "component", "left").select("node", F.least("component", "further").alias("component")))
        drop_written(labels)
        drop_written(near)
        labels = new


def component_size(labels: DataFrame) -> DataFrame:
    size = labels.groupBy("component").agg(F.count("*").alias("connected_component_size"))
    return labels.join(size, "component").select("node", "connected_component_size")


def pivots(nodes: DataFrame, k: int = PIVOTS) -> DataFrame:
    """The k nodes whose hashed id comes first: a fixed, data-independent sample."""
    return nodes.orderBy(F.md5(F.col("node").cast("string")), "node").limit(k).select("node")


def betweenness(edges: DataFrame, nodes: DataFrame, k: int = PIVOTS) -> DataFrame:
    """(node, betweenness) from k pivots by level-wise path counts and backward dependencies."""
    links = cut_lineage(edges.where("src <> dst").select("src", "dst").distinct())
    n = nodes.count()
    zero = nodes.select("node", F.lit(0.0).alias("betweenness"))
    if n <= 2:
        return zero
    k = min(k, n)
    level = cut_lineage(pivots(nodes, k).select(F.col("node").alias("pivot"), "node", F.lit(1.0).alias("paths")))
    levels, seen = [level], level.select("pivot", "node")
    while True:
        step = (
            level.join(links, level.node == links.src)
            .groupBy("pivot", F.col("dst").alias("node"))
            .agg(F.sum("paths").alias("paths"))
            .join(seen, ["pivot", "node"], "left_anti")
        )
        level = cut_lineage(step)
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("pivot", "node"))
    total, below = zero, None
    for level in reversed(levels[1:]):
        if below is None:
            dep = level.withColumn("dep", F.lit(0.0))
        else:
            onward = below.select("pivot", F.col("node").alias("dst"), F.col("paths").alias("paths_below"), F.col("dep").alias("dep_below"))
            fed = (
                level.join(links, level.node == links.src)
                .join(onward, ["pivot", "dst"])
                .groupBy("pivot", "node")
                .agg(F.sum((1 + F.col("dep_below")) / F.col("paths_below")).alias("pull"))
            )
            dep = level.join(fed, ["pivot", "node"], "left").select(
                "pivot", "node", "paths", (F.col("paths") * F.coalesce("pull", F.lit(0.0))).alias("dep")
            )
        below = cut_lineage(dep)
        total = total.unionByName(below.groupBy("node").agg(F.sum("dep").alias("betweenness")))
    scale = (n / k) / ((n - 1) * (n - 2))
    return total.groupBy("node").agg((F.sum("betweenness") * scale).alias("betweenness"))


def closure(edges: DataFrame, starts: DataFrame, upstream: bool) -> DataFrame:
    """(start, node) for all ancestors (upstream) or descendants of each start.

    A start is its own ancestor only when it lies on a cycle.
    """
    here, there = ("dst", "src") if upstream else ("src", "dst")
    links = cut_lineage(edges.select(F.col(here).alias("node"), F.col(there).alias("next")).distinct())
    frontier = starts.select(F.col("node").alias("start"), "node")
    seen = None
    while True:
        step = frontier.join(links, "node").select("start", F.col("next").alias("node")).distinct()
        frontier = cut_lineage(step if seen is None else step.join(seen, ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            return frontier if seen is None else seen
        seen = frontier if seen is None else seen.unionByName(frontier)


def hop_class(edges: DataFrame, nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: how many nodes are one hop away, two hops away, and outside."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    links = cut_lineage(both.select(F.col("src").alias("node"), F.col("dst").alias("next")))
    start = targets.select(F.col("node").alias("target"), "node")
    one = start.join(links, "node").select("target", F.col("next").alias("node")).distinct()
    two = (
        one.join(links, "node")
        .select("target", F.col("next").alias("node"))
        .distinct()
        .where("node <> target")
        .join(one, ["target", "node"], "left_anti")
    )
    marked = one.withColumn("hop", F.lit(1)).unionByName(two.withColumn("hop", F.lit(2)))
    counts = marked.groupBy("target").agg(
        F.count_if(F.col("hop") == 1).alias("one_hop"),
        F.count_if(F.col("hop") == 2).alias("two_hop"),
        F.count_if(F.col("node") == F.col("target")).alias("loops"),
    )
    total = nodes.agg(F.count("*")).scalar()
    filled = start.select("target").join(counts, "target", "left").fillna(0)
    return filled.withColumn("total", total).select(
        "target",
        "one_hop",
        "two_hop",
        (F.col("total") - 1 - F.col("one_hop") - F.col("two_hop") + F.col("loops")).alias("outside"),
    )


def topo_layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, layer): rounds in which a node loses its last in-edge; nodes on or behind cycles are left out."""
    links = cut_lineage(edges.select("src", "dst").distinct())
    waiting = cut_lineage(
        nodes.join(links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("open")), "node", "left").fillna(0, subset=["open"])
    )
    layers, number = None, 0
    while True:
        free = waiting.where("open = 0").select("node", F.lit(number).alias("layer"))
        if free.isEmpty():
            return free if layers is None else layers
        layers = free if layers is None else layers.unionByName(free)
        done = links.join(free, links.src == free.node).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("done"))
        rest = waiting.where("open > 0").join(done, "node", "left")
        waiting = cut_lineage(rest.select("node", (F.col("open") - F.coalesce("done", F.lit(0))).alias("open")))
        number += 1


def reachable(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """(v1, v2, reachable) ignoring direction, from component labels."""
    side = lambda name: labels.select(F.col("node").alias(name), F.col("component").alias(f"c_{name}"))
    return (
        pairs.join(side("v1"), "v1", "left")
        .join(side("v2"), "v2", "left")
        .select("v1", "v2", F.coalesce(F.col("c_v1") == F.col("c_v2"), F.lit(False)).alias("reachable"))
    )


def graph_features(edges: DataFrame, nodes: DataFrame, k: int = PIVOTS) -> DataFrame:
    """Five features keyed by user_id; peers outside the user table still take part."""
    from .graph import graph_degree

    parts = [
        graph_degree(edges, nodes),
        component_size(components(edges, nodes)),
        betweenness(edges, nodes, k).withColumnRenamed("betweenness", "betweenness_centrality"),
    ]
    out = pagerank(edges, nodes).withColumnRenamed("rank", "pagerank_score")
    for p in parts:
        out = out.join(p, "node")
    return out.withColumnRenamed("node", "user_id")
