"""Connected components of verified links as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import cut_lineage, drop_written


def _towards_least(edges: DataFrame, larger_only: bool) -> tuple[DataFrame, DataFrame]:
    """Connect the neighbours of each node to the least of them and the node itself.

    ``edges`` are (u, v) with u the node. The least neighbour comes from a map-side combined
    aggregate and is joined back, so the edges of a hub are never one group. Also returns the written table of leasts.
    """
    least = cut_lineage(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    joined = edges.join(least, "u")
    if larger_only:  # the node's larger neighbours move to the least one
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), least
    own = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))), least


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of a link; component is the least node reachable.

    Alternates the two star operations (every node's larger neighbours, then all smaller
    neighbours, move to the least neighbour) until stars remain; each round is written to the shared folder.
    Links between a node and itself and repeated links do not matter; no links give no rows.
    """
    a, b = links.columns
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    edges = cut_lineage(edges.groupBy("u", "v").agg(F.count("*").alias("_n")).drop("_n"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, first = _towards_least(both, True)
        large = cut_lineage(large.where("u <> v").groupBy("u", "v").agg(F.count("*").alias("_n")).drop("_n"))
        small, second = _towards_least(large, False)
        new = cut_lineage(small.where("u <> v").groupBy("u", "v").agg(F.count("*").alias("_n")).drop("_n"))
        for done in (edges, first, large, second):
            drop_written(done)
        edges = new
        # done when every node has one smaller neighbour or only larger ones: such stars change no more
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(
            edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up"))
        )
        open_ = ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).where("down > 1 OR (down > 0 AND up > 0)")
        if open_.isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.groupBy("v").agg(F.count("*").alias("_n")).select(F.col("v").alias("node"), F.col("v").alias("component"))
    )
