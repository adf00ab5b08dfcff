"""Where did the money of flagged users come from: reverse search for all seeds at once."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import amount_twd, node_user_id, user_node, wallet_node
from ..session import cut_lineage, drop_written, work_folder
from .graph import FUNDS, TRANSFERS

# Weights of the path score, its amount and depth units, the floor of phi.
W_HOPS, W_AMOUNT, W_RISK = 0.4, 0.3, 0.3
FULL_HOPS, FULL_AMOUNT = 5.0, 1_000_000.0
PHI_FLOOR = 1e-9
MAX_HOPS = 5
# edges that the seeds of a batch may walk together: bounds what a round writes
BATCH_LINKS = 1_000_000_000
# nodes that the seeds of a slot may reach together; edges of a block; edges into one node that stay in one block
SLOT_NODES, BLOCK_LINKS, HUB_LINKS = 2_000_000, 1_000_000, 200_000
# bits of a place in the queue of a hop, beside 32 of a node's number
RANK_BITS = 31


def trace_edges(crypto: DataFrame, direction: str = "peer_to_user") -> DataFrame:
    """Money flow: wallet -> user on deposit, user -> wallet on withdrawal, and internal transfers.

    Internal rows read as peer -> user (the tracer's view) or, with ``user_to_peer``, the
    other way round (the graph export's view).
    """
    u, peer = user_node("user_id"), user_node("relation_user_id")
    src, dst = (peer, u) if direction == "peer_to_user" else (u, peer)

    def pick(cond: str, a: Column, b: Column, kind: str) -> DataFrame:
        return crypto.where(cond).select(
            a.alias("src"),
            b.alias("dst"),
            F.col("created_at").alias("ts"),
            F.coalesce(amount_twd("ori_samount", "twd_srate"), F.lit(0.0)).alias("amount"),
            F.lit(kind).alias("edge_type"),
            F.col("currency"),
        )

    return reduce(
        DataFrame.unionByName,
        [
            pick("sub_kind = 0 and kind = 0 and from_wallet is not null", wallet_node("from_wallet"), u, "deposit"),
            pick("sub_kind = 0 and kind = 1 and to_wallet is not null", u, wallet_node("to_wallet"), "withdrawal"),
            pick("sub_kind = 1 and relation_user_id is not null", src, dst, "internal"),
        ],
    )


def edge_amounts(graph: DataFrame, flows: DataFrame) -> DataFrame:
    """Incoming graph edges with amount and time of the latest matching money flow.

    Graph edges carry no amount; one (src, dst) keeps the edge of largest amount.
    """
    latest = F.max_by(F.struct("amount", "ts"), F.struct("ts", "amount")).alias("m")
    lookup = flows.where("edge_type in ('deposit', 'internal')").groupBy("src", "dst").agg(latest)
    wanted = (
        graph.where(F.col("edge_type").isin(FUNDS, TRANSFERS))
        .groupBy(F.col("source").alias("src"), F.col("target").alias("dst"))
        .agg(F.min("edge_type").alias("edge_type"))
    )
    return wanted.join(lookup, ["src", "dst"], "left").select(
        "src", "dst", F.col("m.ts").alias("ts"), F.coalesce(F.col("m.amount"), F.lit(0.0)).alias("amount"), "edge_type"
    )


def path_score(hops: Column, amount: Column, source_risk: Column) -> Column:
    """Depth, amount and source risk; a path without amounts counts its depth twice."""
    hop_part = F.least(hops / FULL_HOPS, F.lit(1.0))
    amount_part = F.when(amount > 0, F.least(amount / FULL_AMOUNT, F.lit(1.0))).otherwise(hop_part)
    return hop_part * W_HOPS + amount_part * W_AMOUNT + source_risk * W_RISK


def _numbered_links(flows: DataFrame, seeds: DataFrame, risks: DataFrame, min_amount: float) -> tuple[DataFrame, DataFrame]:
    """The usable edges under numbers in the order of the names, and the numbers of the seeds.

    An edge carries the risk of its source and ``fan``, the number of edges into its source.
    """
    when = F.coalesce(F.unix_micros("ts"), F.lit(2**62))
    # one edge per (src, dst) can ever be used: the earliest of sufficient amount
    first = F.min_by(F.struct("ts", "amount", "edge_type", "currency"), F.struct(when, F.col("amount"), F.col("edge_type"))).alias("e")
    named = cut_lineage(
        flows.where((F.col("amount") >= min_amount) & (F.col("src") != F.col("dst"))).groupBy("src", "dst").agg(first)
    )
    start = cut_lineage(seeds.select("node").distinct())
    names = named.select(F.col("src").alias("node")).unionByName(named.select(F.col("dst").alias("node"))).unionByName(start)
    # a sort by name first, so that numbers compare as names do
    placed = cut_lineage(names.distinct().orderBy("node").select("node", F.monotonically_increasing_id().alias("id")))
    # without the gaps between partitions
    part, inside = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    before, first = 0, F.lit(0).cast("bigint")
    for p, n in sorted(placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        first, before = F.when(part == p, F.lit(before)).otherwise(first), before + n
    if before >= 1 << 32:
        raise ValueError("a search numbers at most 2**32 nodes")
    number = placed.select("node", (first + inside).cast("bigint").alias("id"))
    risk = risks.groupBy(F.col("user_id").alias("_uid")).agg(F.max("risk_score").alias("risk"))
    fan = named.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan"))
    source = (
        number.withColumn("_uid", node_user_id(F.col("node")))
        .join(risk, "_uid", "left")
        .join(fan, "node", "left")
        .select(F.col("node").alias("src"), F.col("id").alias("src_id"), F.coalesce("risk", F.lit(0.0)).alias("risk"), F.coalesce("fan", F.lit(0)).alias("fan"))
    )
    target = number.select(F.col("node").alias("dst"), F.col("id").alias("dst_id"))
    at = F.coalesce(F.unix_micros("e.ts"), F.lit(2**62)).alias("at")
    links = named.join(source, "src").join(target, "dst").select("src", "dst", "src_id", "dst_id", at, "risk", "fan", "e")
    return cut_lineage(links), cut_lineage(start.join(number, "node"))


def _numbers(row: pa.Table, name: str, i: int, kind) -> np.ndarray:
    return np.frombuffer(row.column(name)[i].as_buffer(), kind)


def _bytes(values: list[np.ndarray]) -> pa.Array:
    return pa.array([np.ascontiguousarray(v).tobytes() for v in values], pa.large_binary()).cast(pa.binary())


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


BLOCK = "block int, parents binary, starts binary, children binary, child binary, at binary, amount binary, risk binary, fan binary"


def _pack_links(key, table):
    """The edges of a block, side by side by the node they lead into."""
    parent = table.column("dst_id").to_numpy()
    order = np.argsort(parent, kind="stable")
    parents, starts = np.unique(parent[order], return_index=True)
    children, child = np.unique(table.column("src_id").to_numpy()[order], return_inverse=True)
    columns = [parents, np.append(starts, len(order)).astype(np.int64), children, child.astype(np.int32)]
    columns += [table.column(c).to_numpy()[order] for c in ("at", "amount", "risk", "fan")]
    names = [c.split()[0] for c in BLOCK.split(", ")]
    return pa.table([pa.array([key[0].as_py()], pa.int32()), *[_bytes([c]) for c in columns]], names=names)


def _packed_links(links: DataFrame, blocks: int) -> DataFrame:
    """One row per block. The edges into a node are in one block, those into a node of many in several."""
    into = links.groupBy("dst_id").agg(F.ceil(F.count("*") / HUB_LINKS).alias("_shares"))
    share = F.pmod(F.xxhash64("src_id"), F.least("_shares", F.lit(blocks)))
    block = F.pmod(F.col("dst_id") + share, F.lit(blocks)).cast("int").alias("block")
    rows = links.join(into, "dst_id").select(block, "dst_id", "src_id", "at", F.col("e.amount").alias("amount"), "risk", "fan")
    return cut_lineage(rows.groupBy("block").applyInArrow(_pack_links, BLOCK))


# a hop of the seeds of a slot: per seed the nodes in the order of the queue; ``father`` is a place in the hop before
LEVEL = "slot int, hop int, rows bigint, walked bigint, seeds binary, counts binary, node binary, father binary, total binary, score binary, risk binary, fan binary"
LEVEL_NAMES = [c.split()[0] for c in LEVEL.split(", ")]
REACH = "block int, slot int, place binary, rank binary, node binary"
STEP = "slot int, walked bigint, place binary, node binary, best binary, at binary, amount binary, risk binary, fan binary"


def _first_level(key, table):
    seeds = table.column("seed").to_numpy()
    n = len(seeds)
    zero = np.zeros(n)
    binary = [seeds, np.ones(n, np.int64), seeds, np.zeros(n, np.int32), zero, zero, zero, table.column("fan").to_numpy()]
    head = [pa.array([key[0].as_py()], pa.int32()), pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([0], pa.int64())]
    return pa.table([*head, *[_bytes([b]) for b in binary]], names=LEVEL_NAMES)


def _spread(blocks: int):
    """A hop's nodes to the blocks that hold edges into them."""

    def emit(batches):
        for b in batches:
            table = pa.Table.from_batches([b])
            for i in range(b.num_rows):
                counts, node, fan = (_numbers(table, c, i, np.int64) for c in ("counts", "node", "fan"))
                shares = np.minimum(-(-fan // HUB_LINKS), blocks)
                at = np.repeat(np.arange(len(node)), shares)
                block = (node[at] + _ranges(np.zeros(len(node), np.int64), shares)) % blocks
                order = np.argsort(block, kind="stable")
                at, block = at[order], block[order]
                place = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
                rank = _ranges(np.zeros(len(counts), np.int64), counts).astype(np.int32)
                some, first = np.unique(block, return_index=True)
                parts = np.split(at, first[1:]) if len(some) else []
                slot = [table.column("slot")[i].as_py()] * len(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some.astype(np.int32)), pa.array(slot, pa.int32()), *[_bytes([v[p] for p in parts]) for v in (place, rank, node)]],
                    names=[c.split()[0] for c in REACH.split(", ")],
                )

    return emit


def _walk(key, reach, block):
    """Per seed the sources of the edges into its nodes, each over the edge whose other end is dequeued first."""
    names = [c.split()[0] for c in STEP.split(", ")]
    out: list[list] = [[] for _ in names]
    if reach.num_rows and block.num_rows:
        parents, starts, children, at, fan = (_numbers(block, c, 0, np.int64) for c in ("parents", "starts", "children", "at", "fan"))
        amount, risk = (_numbers(block, c, 0, np.float64) for c in ("amount", "risk"))
        child = _numbers(block, "child", 0, np.int32)
        last = np.empty(len(children), np.int64)
        for i in range(reach.num_rows):
            place, rank = (_numbers(reach, c, i, np.int32) for c in ("place", "rank"))
            node = _numbers(reach, "node", i, np.int64)
            slot = np.minimum(np.searchsorted(parents, node), len(parents) - 1)
            size = np.where(parents[slot] == node, starts[slot + 1] - starts[slot], 0)
            seeds, first = np.unique(place, return_index=True)
            found, mine, best = [], [], []
            for seed, a, z in zip(seeds, first, np.append(first[1:], len(place))):
                edge = _ranges(starts[slot[a:z]], size[a:z])
                to, number = child[edge], np.arange(len(edge))
                # the first of equal sources is written last
                last[to[::-1]] = number[::-1]
                won = np.flatnonzero(last[to] == number)
                found.append(edge[won])
                best.append(np.repeat(rank[a:z], size[a:z])[won])
                mine.append(np.full(len(won), seed, np.int32))
            edge = np.concatenate(found)
            values = [np.concatenate(mine), children[child[edge]], np.concatenate(best), at[edge], amount[edge], risk[edge], fan[edge]]
            for column, v in zip(out, [reach.column("slot")[i].as_py(), int(size.sum()), *values]):
                column.append(v)
    return pa.table([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), *[_bytes(c) for c in out[2:]]], names=names)


def _by_seed(place: np.ndarray, seeds: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by seed, and where each seed begins in it."""
    order = np.argsort(place, kind="stable")
    return order, np.searchsorted(place[order], np.arange(seeds + 1))


def _settle(hop: int):
    """The next hop of a slot: nodes not seen before, in the order of their parents, then of time and name."""

    def level(key, seen, steps):
        if not seen.num_rows or not steps.num_rows:
            return pa.table([pa.array([], t) for t in [pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 8]], names=LEVEL_NAMES)
        hops = seen.column("hop").to_pylist()
        before = hops.index(hop - 1)
        seeds = _numbers(seen, "seeds", before, np.int64)
        starts = [np.append(0, np.cumsum(_numbers(seen, "counts", i, np.int64))) for i in range(len(hops))]
        nodes = [_numbers(seen, "node", i, np.int64) for i in range(len(hops))]
        totals, first = _numbers(seen, "total", before, np.float64), starts[before]
        kinds = {"place": np.int32, "node": np.int64, "best": np.int32, "at": np.int64, "amount": np.float64, "risk": np.float64, "fan": np.int64}
        place, node, best, at, amount, risk, fan = (np.concatenate([_numbers(steps, c, i, k) for i in range(steps.num_rows)]) for c, k in kinds.items())
        queue = node << RANK_BITS | best
        order, bounds = _by_seed(place, len(seeds))
        chosen, counts, total = [], np.zeros(len(seeds), np.int64), []
        for k in range(len(seeds)):
            mine = order[bounds[k] : bounds[k + 1]]
            mine = mine[np.argsort(queue[mine])]
            own = node[mine]
            new = np.ones(len(mine), bool)
            new[1:] = own[1:] != own[:-1]
            known = np.sort(np.concatenate([n[s[k] : s[k + 1]] for n, s in zip(nodes, starts)]))
            new &= known[np.minimum(np.searchsorted(known, own), len(known) - 1)] != own
            mine = mine[new]
            mine = mine[np.lexsort((at[mine], best[mine]))]
            chosen.append(mine)
            counts[k] = len(mine)
            total.append(totals[first[k] : first[k + 1]][best[mine]] + amount[mine])
        rows, total = np.concatenate(chosen), np.concatenate(total)
        share = min(hop / FULL_HOPS, 1.0)
        score = share * W_HOPS + np.where(total > 0, np.minimum(total / FULL_AMOUNT, 1.0), share) * W_AMOUNT + risk[rows] * W_RISK
        head = [pa.array([key[0].as_py()], pa.int32()), pa.array([hop], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([sum(steps.column("walked").to_pylist())], pa.int64())]
        return pa.table([*head, *[_bytes([c]) for c in (seeds, counts, node[rows], best[rows], total, score, risk[rows], fan[rows])]], names=LEVEL_NAMES)

    return level


def _levels(packed: DataFrame, seeds: DataFrame, blocks: int, slots: int, max_hops: int) -> tuple[list[DataFrame], int]:
    """One table per hop, a row per slot of seeds, and the number of edges walked.

    The nodes of a hop go to the blocks of the edges into them, and what a block finds comes back to the slot; a node's
    place in the queue is its place in the row, so the parent that is dequeued first is the one of least place.
    """
    cores = seeds.sparkSession.sparkContext.defaultParallelism
    block_tasks, slot_tasks = max(4 * blocks, cores), max(8 * cores, slots // 4)
    dealt = seeds.withColumn("slot", F.pmod(F.xxhash64("seed", F.lit(1)), F.lit(slots)).cast("int"))
    levels, walked = [cut_lineage(dealt.groupBy("slot").applyInArrow(_first_level, LEVEL))], 0

    def by(df: DataFrame, key: str, tasks: int):
        return df.repartition(tasks, key).groupBy(key)

    for hop in range(1, max_hops + 1):
        reach = levels[-1].mapInArrow(_spread(blocks), REACH)
        steps = by(reach, "block", block_tasks).cogroup(by(packed, "block", block_tasks)).applyInArrow(_walk, STEP)
        seen = reduce(DataFrame.unionAll, levels).select("slot", "hop", "seeds", "counts", "node", "total")
        level = cut_lineage(by(seen, "slot", slot_tasks).cogroup(by(steps, "slot", slot_tasks)).applyInArrow(_settle(hop), LEVEL))
        levels.append(level)
        rows, more = level.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("walked"), F.lit(0))).first()
        walked += more
        if rows == 0:
            break
    return levels, walked


def _finish(key, table):
    """Per seed the best-scored leaf, the first dequeued on a tie, and the way from it to the seed."""
    hops = table.column("hop").to_pylist()
    order = sorted(range(len(hops)), key=hops.__getitem__)
    seeds = _numbers(table, "seeds", order[0], np.int64)
    starts = [np.append(0, np.cumsum(_numbers(table, "counts", i, np.int64))) for i in order]
    node, father = ([_numbers(table, c, i, k) for i in order] for c, k in (("node", np.int64), ("father", np.int32)))
    score, total, risk = ([_numbers(table, c, i, np.float64) for i in order] for c in ("score", "total", "risk"))
    out = []
    for k in range(len(seeds)):
        won = None
        for h in range(1, len(order)):
            a, z = starts[h][k], starts[h][k + 1]
            if a == z:
                break
            leaf = np.ones(z - a, bool)
            if h + 1 < len(order):
                leaf[father[h + 1][starts[h + 1][k] : starts[h + 1][k + 1]]] = False
            if leaf.any():
                best = int(np.argmax(np.where(leaf, score[h][a:z], -np.inf)))
                if won is None or score[h][a + best] > won[0]:
                    won = (score[h][a + best], h, best)
        if won is not None:
            value, h, at = won
            row, path = starts[h][k] + at, []
            found = (int(seeds[k]), h, float(total[h][row]), float(value), float(risk[h][row]))
            for up in range(h, -1, -1):
                path.append(int(node[up][starts[up][k] + at]))
                at = int(father[up][starts[up][k] + at])
            out.append((*found, path))
    kinds = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int64())]
    columns = zip(*out) if out else [[]] * len(kinds)
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=["seed", "hops", "total", "score", "risk", "path"])


def _best_leaves(levels: list[DataFrame]) -> DataFrame:
    """(seed, hops, total, score, risk, path): per seed the best-scored leaf, the first dequeued on a tie."""
    rows = reduce(DataFrame.unionAll, levels).select("slot", "hop", "seeds", "counts", "node", "father", "total", "score", "risk")
    return rows.groupBy("slot").applyInArrow(_finish, "seed bigint, hops int, total double, score double, risk double, path array<bigint>")


def trace_sources(
    flows: DataFrame, seeds: DataFrame, risks: DataFrame, max_hops: int = MAX_HOPS, min_amount: float = 0.0,
    batch_links: int = BATCH_LINKS,
) -> DataFrame:
    """At most one best path per seed.

    Breadth-first over in-edges. A node is reached once per seed, through the parent that
    is dequeued first and, within it, over the earliest edge; nodes of a hop are dequeued in the
    order of their parents, then of time and name. A row
    that fathers nobody is a leaf; the best-scored leaf wins, the first dequeued on a tie.

    A search may walk every edge, so all seeds together walk up to seeds x edges. They are taken in
    batches that walk about ``batch_links`` edges, and the tables of a batch go when its winners are written.
    """
    spark = flows.sparkSession
    links, numbers = _numbered_links(flows, seeds, risks, min_amount)
    count, edges = numbers.count(), links.count()
    blocks = max(spark.sparkContext.defaultParallelism, -(-edges // BLOCK_LINKS))
    packed = _packed_links(links, blocks)
    nodes = links.agg(F.greatest(F.max("src_id"), F.max("dst_id"))).first()[0] or 0
    parts = max(1, -(-count * edges // batch_links))
    into = links.groupBy(F.col("dst_id").alias("id")).agg(F.count("*").alias("fan"))
    dealt = cut_lineage(
        numbers.join(into, "id", "left").select(F.col("id").alias("seed"), F.coalesce("fan", F.lit(0)).alias("fan"), F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"))
    )
    path, schema = work_folder(spark), None
    done, take = 0, 1
    while done < parts:
        batch = dealt.where(F.col("part").between(done, done + take - 1)).select("seed", "fan")
        size = -(-count * min(take, parts - done) // parts)
        slots = max(1, min(size, max(2 * spark.sparkContext.defaultParallelism, -(-size * (nodes + 1) // SLOT_NODES))))
        levels, walked = _levels(packed, batch, blocks, slots, max_hops)
        won = _best_leaves(levels)
        schema = won.schema
        won.write.mode("append").parquet(path)
        for level in levels:
            drop_written(level)
        done += take
        # the bound counts every edge for every seed; what was walked tells how many seeds really fit
        take = max(1, min(8 * take, int(take * batch_links / max(walked, 1))))
        del batch, levels, won
        # shuffle files go when the driver collects the frames that own them
        spark._jvm.System.gc()
    drop_written(packed)
    won = spark.read.schema(schema).parquet(path)
    pairs = F.arrays_zip(F.expr("slice(path, 1, hops)").alias("src_id"), F.expr("slice(path, 2, hops)").alias("dst_id"))
    link = F.struct(
        "pos", "src", "dst", F.col("e.ts").alias("ts"), F.col("e.amount").alias("amount"),
        F.col("e.edge_type").alias("type"), F.col("e.currency").alias("currency"),
    )
    walked = (
        won.select("seed", F.posexplode(pairs).alias("pos", "p"))
        .select("seed", "pos", "p.src_id", "p.dst_id")
        .join(links.select("src_id", "dst_id", "src", "dst", "e"), ["src_id", "dst_id"])
        .groupBy("seed")
        .agg(F.array_sort(F.collect_list(link)).alias("steps"))
        .select("seed", F.transform("steps", lambda x: x.dropFields("pos")).alias("path_edges"))
    )
    source, last = F.col("path_nodes")[0], F.element_at("path_edges", -1)["dst"]
    return (
        won.join(walked, "seed")
        .withColumn("path_nodes", F.concat(F.transform("path_edges", lambda x: x["src"]), F.array(last)))
        .select(
            F.element_at("path_nodes", -1).alias("fraud_node_id"),
            source.alias("source_node_id"),
            F.when(source.startswith("wallet_"), "wallet").otherwise("user").alias("source_node_type"),
            "path_nodes",
            "path_edges",
            F.col("hops").alias("hop_count"),
            F.array_min(F.transform("path_edges", lambda x: x["ts"])).alias("earliest_tx_time"),
            F.col("total").alias("total_amount"),
            F.col("risk").alias("source_risk_score"),
            "score",
        )
    )


def fraud_chains(traces: DataFrame) -> DataFrame:
    """Flat rows for a file: JSON paths, rounded amounts, heuristic confidence."""
    return traces.select(
        "fraud_node_id",
        "source_node_id",
        "source_node_type",
        F.to_json("path_nodes").alias("path_nodes"),
        F.to_json(
            F.transform("path_edges", lambda e: e.withField("amount", F.round(e["amount"], 2)))
        ).alias("path_edges"),
        "hop_count",
        "earliest_tx_time",
        F.round("total_amount", 2).alias("total_amount_twd"),
        F.round("source_risk_score", 4).alias("source_risk_score"),
        F.round("score", 4).alias("causal_confidence"),
    )


def trace_stats(traces: DataFrame) -> DataFrame:
    return traces.agg(
        F.count("*").alias("chains"),
        F.avg("hop_count").alias("mean_hops"),
        F.max("hop_count").alias("max_hops"),
        F.count_if(F.col("source_node_type") == "wallet").alias("wallet_sources"),
        F.count_if(F.col("source_node_type") == "user").alias("user_sources"),
    )


def chain_nodes(traces: DataFrame, phi: DataFrame) -> DataFrame:
    """One row per node of a chain with its phi (0 when unknown) and backward score.

    The backward score is phi times the geometric mean of phi from the node to the end
    of the chain; a chain has at most max_hops + 1 nodes, which bounds the window.
    """
    rows = traces.select("fraud_node_id", F.posexplode("path_nodes").alias("pos", "node"))
    known = phi.select(F.col("node_id").alias("node"), F.col("phi"))
    rows = rows.join(known, "node", "left").withColumn("phi", F.coalesce("phi", F.lit(0.0)))
    tail = Window.partitionBy("fraud_node_id").orderBy(F.col("pos").desc())
    mean = F.exp(F.avg(F.ln(F.greatest("phi", F.lit(PHI_FLOOR)))).over(tail))
    return rows.select("fraud_node_id", "pos", "node", "phi", (F.col("phi") * mean).alias("backward_score"))


def chain_confidence(scored_nodes: DataFrame) -> DataFrame:
    weight = F.sum("backward_score")
    return scored_nodes.groupBy("fraud_node_id").agg(
        F.round(F.coalesce(F.try_divide(F.sum(F.col("phi") * F.col("backward_score")), weight), F.lit(0.0)), 4).alias(
            "causal_confidence"
        )
    )


def root_cause(scored_nodes: DataFrame) -> DataFrame:
    """Node of highest backward score, then phi; nearest to the source on a tie."""
    best = F.min_by(F.struct("node", "backward_score"), F.struct((-F.col("backward_score")).alias("b"), (-F.col("phi")).alias("p"), "pos"))
    return scored_nodes.groupBy("fraud_node_id").agg(best.alias("r")).select(
        "fraud_node_id", F.col("r.node").alias("best_causal_node"), F.col("r.backward_score").alias("backward_score")
    )


def edge_causal_score(traces: DataFrame, phi: DataFrame) -> DataFrame:
    """phi of both ends, halved when the time of the edge is unknown."""
    rows = traces.select("fraud_node_id", F.posexplode("path_edges").alias("pos", "e")).select("fraud_node_id", "pos", "e.*")
    side = lambda name: phi.select(F.col("node_id").alias(name), F.col("phi").alias(f"phi_{name}"))
    joined = rows.join(side("src"), "src", "left").join(side("dst"), "dst", "left").fillna(0.0, subset=["phi_src", "phi_dst"])
    weight = F.when(F.col("ts").isNotNull(), 1.0).otherwise(0.5)
    return joined.select(
        "fraud_node_id", "pos", "src", "dst", "phi_src", "phi_dst",
        F.round(F.col("phi_src") * F.col("phi_dst") * weight, 4).alias("causal_score"),
    )


def coalition_shapley(values: DataFrame) -> DataFrame:
    """(node, phi) from a full coalition table (node, mask, players, value).

    Summed over all players and divided by their number, the weighted marginals telescope
    to (value of everybody - value of nobody) / players, so two rows per node suffice.
    """
    full = F.pow(F.lit(2.0), F.col("players")).cast("long") - 1
    ends = values.where((F.col("mask") == 0) | (F.col("mask") == full))
    diff = F.max(F.when(F.col("mask") == full, F.col("value"))) - F.max(F.when(F.col("mask") == 0, F.col("value")))
    alone = F.max(F.when(F.col("players") == 0, F.col("value")))
    phi = F.coalesce(alone, F.least(F.greatest(F.try_divide(diff, F.max("players")), F.lit(0.0)), F.lit(1.0)))
    return ends.groupBy("node").agg(phi.alias("phi"))
