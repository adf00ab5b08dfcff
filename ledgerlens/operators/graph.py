"""The user / wallet transfer graph as node and edge frames, and its non-iterative queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import amount_twd, user_node, wallet_node
from ..session import cut_lineage

# Edge types and the relation codes the dashboard shows.
SENDS, FUNDS, TRANSFERS = "user_sends_wallet", "wallet_funds_user", "user_transfers_user"
RELATIONS = {FUNDS: "R1", TRANSFERS: "R2", SENDS: "R3"}
LOW_RISK = 0.4


def relation_of(edge_type: Column) -> Column:
    out = None
    for kind, code in RELATIONS.items():
        out = F.when(edge_type == kind, code) if out is None else out.when(edge_type == kind, code)
    return out


def _edge(df: DataFrame, source: Column, target: Column, src_raw: Column, dst_raw: Column, kind: str) -> DataFrame:
    return df.select(
        source.alias("source"),
        target.alias("target"),
        src_raw.cast("string").alias("source_raw"),
        dst_raw.cast("string").alias("target_raw"),
        F.lit(kind).alias("edge_type"),
        F.col("created_at").alias("ts"),
        amount_twd("ori_samount", "twd_srate").alias("amount"),
    )


def graph_edges(crypto: DataFrame, users: DataFrame) -> DataFrame:
    """One row per transfer between known ends.

    sends: on-chain withdrawal user -> wallet; funds: on-chain deposit wallet -> user;
    transfers: internal user -> peer, both of which must be known users.
    """
    known = users.select("user_id")
    c = crypto.join(known, "user_id", "left_semi")
    peers = known.withColumnRenamed("user_id", "relation_user_id")
    u, peer, out, src = F.col("user_id"), F.col("relation_user_id"), F.col("to_wallet"), F.col("from_wallet")
    chain = F.col("sub_kind") == 0
    sends = c.where(chain & (F.col("kind") == 1) & out.isNotNull())
    funds = c.where(chain & (F.col("kind") == 0) & src.isNotNull())
    moved = c.where((F.col("sub_kind") == 1) & peer.isNotNull()).join(peers, "relation_user_id", "left_semi")
    return reduce(
        DataFrame.unionByName,
        [
            _edge(sends, user_node(u), wallet_node(out), u, out, SENDS),
            _edge(funds, wallet_node(src), user_node(u), src, u, FUNDS),
            _edge(moved, user_node(u), user_node(peer), u, peer, TRANSFERS),
        ],
    )


def graph_nodes(crypto: DataFrame, scores: DataFrame) -> DataFrame:
    """Users with score and label, and every wallet an on-chain transfer names."""
    wallets = (
        crypto.where("sub_kind = 0")
        .select(F.explode(F.array("from_wallet", "to_wallet")).alias("w"))
        .where("w is not null")
        .distinct()
        .select(wallet_node("w").alias("node_id"), F.lit("wallet").alias("node_type"))
    )
    users = scores.select(
        user_node("user_id").alias("node_id"),
        F.lit("user").alias("node_type"),
        "risk_score",
        F.col("status").cast("double").alias("label"),
    )
    return users.unionByName(wallets, allowMissingColumns=True)


def peer_edges(crypto: DataFrame) -> DataFrame:
    """Distinct internal (src, dst) = (user, peer); unknown peers are kept."""
    return (
        crypto.where("sub_kind = 1 and relation_user_id is not null")
        .select(F.col("user_id").alias("src"), F.col("relation_user_id").alias("dst"))
        .distinct()
    )


def peer_nodes(edges: DataFrame, users: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return users.select(F.col("user_id").alias("node")).unionByName(ends).distinct()


def graph_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct in and out peers; a self-loop counts once each way."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("graph_out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("graph_in_degree"))
    return nodes.join(into, "node", "left").join(out, "node", "left").fillna(0)


def graph_neighbors(edges: DataFrame) -> DataFrame:
    """(node, direction, neighbor): parents feed the node, children are fed by it."""
    parents = edges.select(F.col("dst").alias("node"), F.lit("parent").alias("direction"), F.col("src").alias("neighbor"))
    children = edges.select(F.col("src").alias("node"), F.lit("child").alias("direction"), F.col("dst").alias("neighbor"))
    return parents.unionByName(children).distinct()


def parents_before(edges: DataFrame, cutoff: Column) -> DataFrame:
    """Parents over edges that existed at the cutoff or whose time is unknown."""
    return (
        edges.where((F.col("ts") <= cutoff) | F.col("ts").isNull())
        .select(F.col("target").alias("node"), F.col("source").alias("parent"))
        .distinct()
    )


def neighbor_detail(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Peers of every user per relation and direction with the number of edges."""
    mine = lambda me, other: edges.select(
        F.col(me).alias("center"),
        relation_of(F.col("edge_type")).alias("relation"),
        F.when(F.col("edge_type") != TRANSFERS, F.lit("-"))
        .when(F.col("source") == F.col(me), "out")
        .otherwise("in")
        .alias("direction"),
        F.col(other).alias("peer"),
    ).where(F.col("center").startswith("user_"))
    counted = (
        mine("source", "target")
        .unionByName(mine("target", "source"))
        .groupBy("center", "relation", "direction", "peer")
        .agg(F.count("*").alias("tx_count"))
    )
    info = nodes.select(
        F.col("node_id").alias("peer"),
        F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
        (F.coalesce("label", F.lit(0.0)) >= 1).cast("int").alias("status"),
    )
    return counted.join(info, "peer")


def neighbor_counts(detail: DataFrame) -> DataFrame:
    """Peers per relation; a peer on both sides of R2 counts once."""
    return detail.groupBy("center").agg(
        F.count_if(F.col("relation") == "R1").alias("r1"),
        F.count_distinct(F.when(F.col("relation") == "R2", F.col("peer"))).alias("r2"),
        F.count_if(F.col("relation") == "R3").alias("r3"),
    )


def wallet_links(edges: DataFrame) -> DataFrame:
    """Distinct (wallet, user) with one relation; sending wins over funding."""
    sends = edges.where(F.col("edge_type") == SENDS).select(F.col("target").alias("wallet"), F.col("source").alias("user"), F.lit("R3").alias("relation"))
    funds = edges.where(F.col("edge_type") == FUNDS).select(F.col("source").alias("wallet"), F.col("target").alias("user"), F.lit("R1").alias("relation"))
    return sends.unionByName(funds).groupBy("wallet", "user").agg(F.max("relation").alias("relation"))


def wallet_search(edges: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """Users linked to wallets whose id contains the text, with their risk; sort at the sink."""
    word = text.strip().lower()
    links = wallet_links(edges).where(F.lower("wallet").contains(word)) if word else wallet_links(edges).limit(0)
    risk = nodes.where("node_type = 'user'").select(F.col("node_id").alias("user"), "risk_score")
    return links.join(risk, "user").select("wallet", "user", "relation", "risk_score")


def wallet_top_user(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The linked user of highest risk per wallet; the smallest id wins a tie."""
    risk = nodes.where("node_type = 'user'").select(F.col("node_id").alias("user"), "risk_score")
    best = F.min_by(F.struct("user", "risk_score"), F.struct((-F.col("risk_score")).alias("r"), "user")).alias("b")
    return wallet_links(edges).join(risk, "user").groupBy("wallet").agg(best).select("wallet", "b.user", "b.risk_score")


def k_hop_subgraph(edges: DataFrame, nodes: DataFrame, centers: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Neighbourhoods of all centers at once: (center, node) and (center, edge) frames.

    Parallel edges of one type collapse. Users below the risk cut still relay, but are
    dropped afterwards together with their edges and nodes left without any edge.
    """
    info = nodes.select(F.col("node_id").alias("node"), "node_type", F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"))
    stays = (F.col("node_type") != "user") | (F.col("risk_score") >= LOW_RISK)
    # whether an end stays is a matter of the link, unless the end is the center; null: no such node
    links = edges.select("source", "target", "edge_type").distinct()
    for side in ("source", "target"):
        links = links.join(info.select(F.col("node").alias(side), F.coalesce(stays, F.lit(False)).alias(f"{side}_stays")), side, "left")
    links = cut_lineage(links)
    columns = ["source", "target", "edge_type", "source_stays", "target_stays"]
    around = links.select(F.col("source").alias("node"), F.col("target").alias("next"), *columns)
    around = around.unionByName(links.where("source <> target").select(F.col("target").alias("node"), F.col("source").alias("next"), *columns))
    start = centers.select(F.col("node_id").alias("center"), F.col("node_id").alias("node"))
    seen = frontier = start.join(nodes.select(F.col("node_id").alias("node")), "node", "left_semi").select("center", "node")
    both = [F.col(f"{side}_stays").isNotNull() & (F.col(f"{side}_stays") | (F.col(side) == F.col("center"))) for side in ("source", "target")]
    collected = None
    for _ in range(hops):
        # read the frontier back from storage, so a hop is computed once
        reached = cut_lineage(frontier.join(around, "node").select("center", "next", *columns))
        # all ends of reached links are seen, so no join has to look them up
        found = reached.where(both[0] & both[1]).select("center", "source", "target", "edge_type")
        collected = found if collected is None else collected.unionByName(found)
        frontier = (
            reached.select("center", F.col("next").alias("node")).distinct().join(seen, ["center", "node"], "left_anti")
        )
        seen = seen.unionByName(frontier)
    kept = cut_lineage(seen.join(info, "node").where(stays | (F.col("node") == F.col("center"))).select("center", "node", "node_type", "risk_score"))
    kept_edges = collected.distinct()
    touched = kept_edges.select("center", F.explode(F.array("source", "target")).alias("node")).unionByName(
        kept.where("node = center").select("center", "node")
    )
    return kept.join(touched.distinct(), ["center", "node"], "left_semi"), kept_edges.select(
        "center", "source", "target", relation_of(F.col("edge_type")).alias("relation")
    )


def neighbor_mean_features(edges: DataFrame, features: DataFrame, cols: list[str], layers: int = 2) -> DataFrame:
    """Mean of the neighbours' features per relation, summed over relations, repeated per layer.

    ``features`` has one row per node; nodes without features count as zeros. Stands in
    for the learned message-passing encoder: same neighbourhoods, no trained weights.
    """
    out = features
    for layer in range(layers):
        names = [f"l{layer + 1}_{c}" for c in cols]
        sent = edges.join(
            out.select(F.col("node_id").alias("source"), *[F.col(c if layer == 0 else f"l{layer}_{c}").alias(c) for c in cols]),
            "source",
            "left",
        )
        per_relation = sent.groupBy("target", "edge_type").agg(
            *[F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(c) for c in cols]
        )
        summed = per_relation.groupBy(F.col("target").alias("node_id")).agg(*[F.sum(c).alias(n) for c, n in zip(cols, names)])
        out = out.join(summed, "node_id", "left").fillna(0.0, subset=names)
    return out
