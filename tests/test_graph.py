import itertools
from collections import deque
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerlens.operators import graph, graph_loops, trace

few = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
T0 = datetime(2001, 1, 1)


def peers(spark, pairs, extra=()):
    edges = spark.createDataFrame(list(pairs), "src long, dst long").distinct()
    names = {n for p in pairs for n in p} | set(extra)
    return edges, spark.createDataFrame([(n,) for n in sorted(names)], "node long")


def test_pagerank_mass_and_dangling(spark):
    edges, nodes = peers(spark, [(1, 2)], extra=[3])
    got = {r["node"]: r["rank"] for r in graph_loops.pagerank(edges, nodes).collect()}
    assert sum(got.values()) == pytest.approx(1.0)
    assert got[2] > got[1] == pytest.approx(got[3])


def brandes(pairs, nodes):
    """Exact betweenness by counting shortest paths."""
    out = {n: [] for n in nodes}
    for a, b in set(pairs):
        if a != b:
            out[a].append(b)
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        dist, paths, order, queue = {s: 0}, {s: 1}, [], deque([s])
        while queue:
            u = queue.popleft()
            order.append(u)
            for v in out[u]:
                if v not in dist:
                    dist[v], paths[v] = dist[u] + 1, 0
                    queue.append(v)
                if dist[v] == dist[u] + 1:
                    paths[v] += paths[u]
        dep = dict.fromkeys(order, 0.0)
        for u in reversed(order):
            for v in out[u]:
                if dist.get(v) == dist[u] + 1:
                    dep[u] += paths[u] / paths[v] * (1 + dep[v])
            if u != s:
                score[u] += dep[u]
    n = len(nodes)
    return {k: v / ((n - 1) * (n - 2)) for k, v in score.items()}


def test_betweenness_with_all_pivots(spark):
    pairs = [(1, 2), (2, 3), (1, 4), (4, 3), (3, 5), (5, 1), (5, 6), (6, 6), (2, 6)]
    edges, nodes = peers(spark, pairs, extra=[7])
    want = brandes(pairs, list(range(1, 8)))
    got = {r["node"]: r["betweenness"] for r in graph_loops.betweenness(edges, nodes).collect()}
    assert got == pytest.approx(want)


@few
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=14))
def test_components_and_reach(spark, pairs):
    edges, nodes = peers(spark, pairs, extra=range(10))
    parent = list(range(10))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r["node"]: r["component"] for r in graph_loops.components(edges, nodes).collect()}
    assert got == {n: find(n) for n in range(10)}


def test_topo_layers_leave_cycles_out(spark):
    edges, nodes = peers(spark, [(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (5, 6)])
    got = {r["node"]: r["layer"] for r in graph_loops.topo_layers(edges, nodes).collect()}
    assert got == {1: 0, 2: 1, 3: 2}


def test_closure_on_a_cycle(spark):
    edges, nodes = peers(spark, [(1, 2), (2, 1), (3, 1)])
    up = {(r[0], r[1]) for r in graph_loops.closure(edges, nodes, upstream=True).collect()}
    assert up == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)}


def test_hop_class(spark):
    edges, nodes = peers(spark, [(1, 2), (2, 3), (3, 4), (1, 1)], extra=[5])
    got = {r["target"]: (r["one_hop"], r["two_hop"], r["outside"]) for r in graph_loops.hop_class(edges, nodes, nodes).collect()}
    # a self-loop makes the node its own one-hop neighbour
    assert got[1] == (2, 1, 2) and got[4] == (1, 1, 2) and got[5] == (0, 0, 4)


FLOW = "src string, dst string, ts timestamp, amount double, edge_type string, currency string"


def flows(spark, rows):
    return spark.createDataFrame([(a, b, T0 + timedelta(hours=h) if h is not None else None, m, "x", "btc") for a, b, h, m in rows], FLOW)


def run_trace(spark, rows, seeds, risks=(), **kw):
    s = spark.createDataFrame([(x,) for x in seeds], "node string")
    r = spark.createDataFrame(list(risks), "user_id long, risk_score double")
    return {x["fraud_node_id"]: x for x in trace.trace_sources(flows(spark, rows), s, r, **kw).collect()}


def test_trace_visits_a_node_once(spark):
    # a reaches f directly; the way over b comes later and must not be used
    rows = [("user_1", "user_2", 1, 5.0), ("user_2", "user_9", 2, 5.0), ("wallet_w", "user_9", 3, 5.0), ("user_1", "user_9", 4, 5.0)]
    r = run_trace(spark, rows, ["user_9"])["user_9"]
    assert r["hop_count"] == 1


def test_trace_cycle_and_empty(spark):
    got = run_trace(spark, [("user_1", "user_2", 1, 1.0), ("user_2", "user_1", 2, 1.0)], ["user_2", "user_7"])
    assert set(got) == {"user_2"} and got["user_2"]["hop_count"] == 1
    assert got["user_2"]["path_nodes"] == ["user_1", "user_2"]


def plain_trace(rows, seed, risks, max_hops):
    """Queue-based restatement."""
    back = {}
    for a, b, h, m in rows:
        back.setdefault(b, []).append((h if h is not None else 10**9, a, m))
    queue, seen, best = deque([(seed, [seed], 0.0)]), {seed}, None
    while queue:
        node, path, total = queue.popleft()
        hops, grew = len(path) - 1, False
        if hops < max_hops:
            for h, a, m in sorted(back.get(node, [])):
                if a not in seen:
                    seen.add(a)
                    grew = True
                    queue.append((a, [a, *path], total + m))
        if not grew and hops > 0:
            part = min(hops / 5, 1)
            amount = min(total / 1e6, 1) if total > 0 else part
            risk = risks.get(int(node[5:]), 0.0) if node.startswith("user_") else 0.0
            score = part * 0.4 + amount * 0.3 + risk * 0.3
            if best is None or score > best[0] + 1e-12:
                best = (score, path)
    return best


def test_trace_against_plain_queue(spark):
    import random

    rng = random.Random(3)
    names = [f"user_{i}" for i in range(12)] + [f"wallet_{i}" for i in range(4)]
    rows, used = [], set()
    for i in range(40):
        a, b = rng.sample(names, 2)
        if (a, b) not in used:
            used.add((a, b))
            rows.append((a, b, i if i % 7 else None, float(rng.randint(1, 400_000))))
    risks = {i: i / 20 for i in range(12)}
    seeds = [f"user_{i}" for i in range(0, 12, 3)]
    for hops in (1, 3, 5):
        got = run_trace(spark, rows, seeds, risks.items(), max_hops=hops)
        for s in seeds:
            want = plain_trace(rows, s, risks, hops)
            assert (want is None) == (s not in got)
            if want:
                assert got[s]["score"] == pytest.approx(want[0])
                assert got[s]["path_nodes"] == want[1]
                assert got[s]["path_nodes"][-1] == s and got[s]["hop_count"] <= hops


def test_trace_amount_filter(spark):
    rows = [("user_1", "user_9", 1, 5.0), ("user_2", "user_9", 2, 50.0)]
    assert run_trace(spark, rows, ["user_9"], min_amount=10.0)["user_9"]["source_node_id"] == "user_2"


def test_subgraph_drops_low_risk_relays(spark):
    nodes = spark.createDataFrame(
        [("user_1", "user", 0.1, 0.0), ("user_2", "user", 0.2, 0.0), ("user_3", "user", 0.9, 1.0), ("wallet_w", "wallet", None, None)],
        "node_id string, node_type string, risk_score double, label double",
    )
    edges = spark.createDataFrame(
        [("user_1", "user_2", graph.TRANSFERS), ("user_2", "user_3", graph.TRANSFERS), ("user_1", "wallet_w", graph.SENDS)],
        "source string, target string, edge_type string",
    )
    kept, links = graph.k_hop_subgraph(edges, nodes, nodes.where("node_id = 'user_1'"))
    assert {r["node"] for r in kept.collect()} == {"user_1", "wallet_w"}
    assert [(r["source"], r["target"], r["relation"]) for r in links.collect()] == [("user_1", "wallet_w", "R3")]


def test_shapley_telescopes(spark):
    import math

    value = {m: (m * 7 % 11) / 20 + 0.1 * bin(m).count("1") for m in range(8)}
    n, total = 3, 0.0
    for i, size in itertools.product(range(n), range(n)):
        for m in range(8):
            if bin(m).count("1") == size and not m >> i & 1:
                w = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                total += w * (value[m | 1 << i] - value[m])
    df = spark.createDataFrame([("a", m, 3, v) for m, v in value.items()], "node string, mask int, players int, value double")
    assert trace.coalition_shapley(df).first()["phi"] == pytest.approx(min(max(total / n, 0), 1))


def test_trace_batches_leave_nothing_behind(spark):
    """Seeds in many batches give the paths of one batch, and what a batch wrote is gone: the folder does not grow with the batches."""
    import os
    import random

    from ledgerlens.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    rng = random.Random(5)
    names = [f"user_{i}" for i in range(10)] + [f"wallet_{i}" for i in range(3)]
    pairs = sorted({tuple(rng.sample(names, 2)) for _ in range(45)})
    rows = [(a, b, i if i % 6 else None, float(rng.randint(1, 400_000))) for i, (a, b) in enumerate(pairs)]
    risks, seeds = {i: i / 20 for i in range(10)}, [f"user_{i}" for i in range(6)]

    def folders():
        return {os.path.join(d, f) for d, _, files in os.walk(root) for f in files if f.endswith(".parquet")}

    left = []
    for batch in (10**9, 2 * len(rows)):
        before = folders()
        got = run_trace(spark, rows, seeds, risks.items(), batch_links=batch)
        left.append({os.path.dirname(f) for f in folders() - before})
        for s in seeds:
            want = plain_trace(rows, s, risks, 5)
            assert (want is None) == (s not in got)
            if want:
                assert got[s]["path_nodes"] == want[1] and got[s]["score"] == pytest.approx(want[0])
                assert [(e["src"], e["dst"]) for e in got[s]["path_edges"]] == list(zip(want[1], want[1][1:]))
    kept = [sorted(len(spark.read.parquet(d).columns) for d in one) for one in left]
    # of a search only numbers and winners stay; no table of (seed, node) rows
    assert all("rank" not in spark.read.parquet(d).columns and "position" not in spark.read.parquet(d).columns for one in left for d in one), kept


def test_subgraph_reads_written_nodes(spark, sf_dir):
    """The steps of the subgraph read written nodes: the risk scores are not derived again at each of them."""
    from ledgerlens.plans import graph_queries

    for part in graph_queries._subgraph(spark, sf_dir):
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "c_acctbal" not in plan and "l_shipdate" not in plan and "o_orderdate" not in plan
