"""Graph, tracing and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dashboard, graph, graph_loops, mart, profile, trace
from ..session import cut_lineage
from ..sources.fixtures import AS_OF, tables
from . import feature_queries as fq
from .common import scored
from .oracle import add_blocks
from .registry import query

def _hops_sql(hops: int = trace.MAX_HOPS) -> dict[str, str]:
    """Levels of the breadth-first search: per (seed, node) the path whose (time, node) list comes first."""
    blocks = {
        "tr_h0": "SELECT seed, seed AS node, NULL::VARCHAR AS parent, []::STRUCT(t BIGINT, n VARCHAR)[] AS pos, [seed] AS path_nodes, NULL::TIMESTAMP AS earliest, 0.0::DOUBLE AS total FROM tr_seeds",
    }
    leaves = []
    for k in range(1, hops + 1):
        seen = " ".join(f"AND NOT EXISTS (SELECT 1 FROM tr_h{j} v WHERE v.seed = p.seed AND v.node = l.src)" for j in range(k))
        blocks[f"tr_h{k}"] = f"""
SELECT * FROM (
  SELECT p.seed, l.src AS node, p.node AS parent, list_append(p.pos, {{'t': epoch_us(l.ts), 'n': l.src}}) AS pos, list_prepend(l.src, p.path_nodes) AS path_nodes,
    least(p.earliest, l.ts) AS earliest, p.total + l.amount AS total FROM tr_h{k - 1} p JOIN tr_links l ON l.dst = p.node WHERE TRUE {seen})
QUALIFY row_number() OVER (PARTITION BY seed, node ORDER BY pos) = 1"""
        last = "" if k == hops else f" WHERE NOT EXISTS (SELECT 1 FROM tr_h{k + 1} t WHERE t.seed = o.seed AND t.parent = o.node)"
        leaves.append(f"SELECT seed, node, {k} AS hop_count, earliest, total, pos, path_nodes FROM tr_h{k} o{last}")
    return blocks | {"tr_leaves": " UNION ALL ".join(leaves)}


add_blocks(
    {
        "g_edges": """
SELECT concat('user_', CAST(user_id AS STRING)) AS source, concat('wallet_', to_wallet) AS target, CAST(user_id AS STRING) AS source_raw,
  to_wallet AS target_raw, 'user_sends_wallet' AS edge_type, created_at AS ts, amount
FROM c_rows WHERE sub_kind = 0 AND kind = 1 AND to_wallet IS NOT NULL AND user_id IN (SELECT user_id FROM user_info)
UNION ALL SELECT concat('wallet_', from_wallet), concat('user_', CAST(user_id AS STRING)), from_wallet, CAST(user_id AS STRING), 'wallet_funds_user', created_at, amount
FROM c_rows WHERE sub_kind = 0 AND kind = 0 AND from_wallet IS NOT NULL AND user_id IN (SELECT user_id FROM user_info)
UNION ALL SELECT concat('user_', CAST(user_id AS STRING)), concat('user_', CAST(relation_user_id AS STRING)), CAST(user_id AS STRING),
  CAST(relation_user_id AS STRING), 'user_transfers_user', created_at, amount
FROM c_rows WHERE sub_kind = 1 AND relation_user_id IN (SELECT user_id FROM user_info) AND user_id IN (SELECT user_id FROM user_info)""",
        "g_nodes": """
SELECT concat('user_', CAST(user_id AS STRING)) AS node_id, 'user' AS node_type, risk_score, CAST(status AS DOUBLE) AS label FROM risk_grid
UNION ALL SELECT DISTINCT concat('wallet_', w), 'wallet', NULL, NULL FROM (
  SELECT from_wallet AS w FROM crypto_transfer WHERE sub_kind = 0 UNION ALL SELECT to_wallet FROM crypto_transfer WHERE sub_kind = 0) WHERE w IS NOT NULL""",
        "p_edges": "SELECT DISTINCT user_id AS src, relation_user_id AS dst FROM crypto_transfer WHERE sub_kind = 1 AND relation_user_id IS NOT NULL",
        "p_nodes": "SELECT user_id AS node FROM user_info UNION SELECT src FROM p_edges UNION SELECT dst FROM p_edges",
        "p_both": "SELECT src, dst FROM p_edges UNION SELECT dst, src FROM p_edges",
        "p_degree": """
SELECT node, (SELECT count(*) FROM p_edges WHERE dst = node) AS graph_in_degree, (SELECT count(*) FROM p_edges WHERE src = node) AS graph_out_degree FROM p_nodes""",
        "p_reach": "SELECT node, node AS other FROM p_nodes UNION SELECT r.node, b.dst FROM p_reach r JOIN p_both b ON r.other = b.src",
        "p_comp": "SELECT node, min(other) AS component, count(*) AS connected_component_size FROM p_reach GROUP BY node",
        "p_share": "SELECT e.src, e.dst, d.n AS deg FROM p_edges e JOIN (SELECT src, count(*) AS n FROM p_edges GROUP BY src) d ON e.src = d.src",
        "p_start": "SELECT node, node NOT IN (SELECT src FROM p_edges) AS dangling, count(*) OVER () AS n FROM p_nodes",
        "p_rank": """
SELECT 0 AS it, node, dangling, n, 1.0::DOUBLE / n AS rk, 1e9::DOUBLE AS err FROM p_start
UNION ALL
SELECT it + 1, node, dangling, n, new_rk, sum(abs(new_rk - rk)) OVER () FROM (
  SELECT p.it, p.node, p.dangling, p.n, p.rk,
    0.85::DOUBLE * (coalesce(c.got, 0) + (SELECT sum(rk) FROM p_rank WHERE dangling) / p.n) + 0.15::DOUBLE / p.n AS new_rk
  FROM p_rank p LEFT JOIN (SELECT s.dst, sum(q.rk / s.deg) AS got FROM p_rank q JOIN p_share s ON q.node = s.src GROUP BY s.dst) c ON c.dst = p.node
  WHERE p.it < 100 AND p.err >= p.n * 1e-6)""",
        "b_links": "SELECT src, dst FROM p_edges WHERE src <> dst",
        "b_walk": "SELECT node AS s, node, 0 AS d FROM p_nodes UNION SELECT w.s, e.dst, w.d + 1 FROM b_walk w JOIN b_links e ON e.src = w.node WHERE w.d < 24",
        "b_dist": "SELECT s, node, min(d) AS d FROM b_walk GROUP BY s, node",
        "b_paths": """
SELECT node AS s, node, 0 AS d, 1.0::DOUBLE AS sigma FROM p_nodes
UNION ALL SELECT g.s, e.dst, g.d + 1, sum(g.sigma) FROM b_paths g JOIN b_links e ON e.src = g.node
  JOIN b_dist x ON x.s = g.s AND x.node = e.dst AND x.d = g.d + 1 GROUP BY g.s, e.dst, g.d + 1""",
        "b_pivots": "SELECT node FROM p_nodes ORDER BY md5(CAST(node AS STRING)), node LIMIT 500",
        "b_score": """
SELECT v.node, sum(v.sigma * t.sigma / st.sigma) AS pull
FROM b_pivots p JOIN b_paths v ON v.s = p.node AND v.node <> p.node JOIN b_paths t ON t.s = v.node AND t.node <> v.node
JOIN b_paths st ON st.s = p.node AND st.node = t.node AND st.d = v.d + t.d GROUP BY v.node""",
        "b_all": """
SELECT n.node, coalesce(b.pull, 0) * ((SELECT count(*) FROM p_nodes) / (SELECT count(*) FROM b_pivots))
  / (((SELECT count(*) FROM p_nodes) - 1.0) * ((SELECT count(*) FROM p_nodes) - 2)) AS betweenness
FROM p_nodes n LEFT JOIN b_score b ON b.node = n.node""",
        "p_closure": "SELECT src AS a, dst AS b FROM p_edges UNION SELECT c.a, e.dst FROM p_closure c JOIN p_edges e ON e.src = c.b",
        "p_stuck": "SELECT a AS node FROM p_closure WHERE a = b UNION SELECT b FROM p_closure WHERE a IN (SELECT a FROM p_closure WHERE a = b)",
        "p_free": "SELECT node FROM p_nodes WHERE node NOT IN (SELECT node FROM p_stuck)",
        "p_depth": "SELECT node, 0 AS layer FROM p_free UNION SELECT e.dst, w.layer + 1 FROM p_depth w JOIN p_edges e ON e.src = w.node WHERE e.dst IN (SELECT node FROM p_free)",
        "p_features": """
SELECT r.node AS user_id, r.rk AS pagerank_score, d.graph_in_degree, d.graph_out_degree, k.connected_component_size, b.betweenness AS betweenness_centrality
FROM p_rank r JOIN p_degree d ON d.node = r.node JOIN p_comp k ON k.node = r.node JOIN b_all b ON b.node = r.node
WHERE r.it = (SELECT max(it) FROM p_rank)""",
        "p_seeds": "SELECT user_id AS node FROM user_info WHERE status = 1",
        "up_walk": "SELECT s.node AS start, e.src AS node FROM p_seeds s JOIN p_edges e ON e.dst = s.node UNION SELECT w.start, e.src FROM up_walk w JOIN p_edges e ON e.dst = w.node",
        "down_walk": "SELECT s.node AS start, e.dst AS node FROM p_seeds s JOIN p_edges e ON e.src = s.node UNION SELECT w.start, e.dst FROM down_walk w JOIN p_edges e ON e.src = w.node",
        "hop_one": "SELECT DISTINCT s.node AS target, b.dst AS node FROM p_seeds s JOIN p_both b ON b.src = s.node",
        "hop_two": """
SELECT DISTINCT h.target, b.dst AS node FROM hop_one h JOIN p_both b ON b.src = h.node
WHERE b.dst <> h.target AND NOT EXISTS (SELECT 1 FROM hop_one o WHERE o.target = h.target AND o.node = b.dst)""",
        "nb_rows": """
SELECT source AS center, CASE edge_type WHEN 'wallet_funds_user' THEN 'R1' WHEN 'user_transfers_user' THEN 'R2' ELSE 'R3' END AS relation,
  CASE WHEN edge_type = 'user_transfers_user' THEN 'out' ELSE '-' END AS direction, target AS peer FROM g_edges WHERE starts_with(source, 'user_')
UNION ALL SELECT target, CASE edge_type WHEN 'wallet_funds_user' THEN 'R1' WHEN 'user_transfers_user' THEN 'R2' ELSE 'R3' END,
  CASE WHEN edge_type <> 'user_transfers_user' THEN '-' WHEN source = target THEN 'out' ELSE 'in' END, source FROM g_edges WHERE starts_with(target, 'user_')""",
        "nb_detail": """
SELECT center, relation, direction, peer, count(*) AS tx_count, any_value(coalesce(n.risk_score, 0)) AS risk_score,
  any_value(CASE WHEN n.label >= 1 THEN 1 ELSE 0 END) AS status
FROM nb_rows JOIN g_nodes n ON peer = node_id GROUP BY center, relation, direction, peer""",
        "w_links": """
SELECT wallet, usr, max(relation) AS relation FROM (
  SELECT target AS wallet, source AS usr, 'R3' AS relation FROM g_edges WHERE edge_type = 'user_sends_wallet'
  UNION ALL SELECT source, target, 'R1' FROM g_edges WHERE edge_type = 'wallet_funds_user') GROUP BY wallet, usr""",
        "kh_centers": "SELECT node_id AS center FROM g_nodes WHERE node_type = 'user' ORDER BY risk_score DESC, node_id LIMIT 5",
        "kh_links": "SELECT DISTINCT source, target, edge_type FROM g_edges",
        "kh_both": "SELECT source AS node, target AS nxt, * FROM kh_links UNION SELECT target, source, * FROM kh_links",
        "kh_one": "SELECT center, nxt, source, target, edge_type FROM kh_centers JOIN kh_both ON node = center",
        "kh_two": "SELECT DISTINCT o.center, b.nxt, b.source, b.target, b.edge_type FROM (SELECT DISTINCT center, nxt FROM kh_one) o JOIN kh_both b ON b.node = o.nxt",
        "kh_seen": """
SELECT center, center AS node FROM kh_centers UNION SELECT center, nxt FROM kh_one UNION SELECT center, nxt FROM kh_two""",
        "kh_kept": """
SELECT center, node, node_type, coalesce(risk_score, 0) AS risk_score FROM kh_seen JOIN g_nodes ON node = node_id
WHERE node_type <> 'user' OR node = center OR risk_score >= 0.4""",
        "kh_edges": """
SELECT DISTINCT e.center, e.source, e.target, e.edge_type FROM (
  SELECT center, source, target, edge_type FROM kh_one UNION SELECT center, source, target, edge_type FROM kh_two) e
JOIN kh_kept a ON a.center = e.center AND a.node = e.source JOIN kh_kept b ON b.center = e.center AND b.node = e.target""",
        "tr_flows": """
SELECT concat('wallet_', from_wallet) AS src, concat('user_', CAST(user_id AS STRING)) AS dst, created_at AS ts, amount, 'deposit' AS edge_type, currency
FROM c_rows WHERE sub_kind = 0 AND kind = 0 AND from_wallet IS NOT NULL
UNION ALL SELECT concat('user_', CAST(user_id AS STRING)), concat('wallet_', to_wallet), created_at, amount, 'withdrawal', currency
FROM c_rows WHERE sub_kind = 0 AND kind = 1 AND to_wallet IS NOT NULL
UNION ALL SELECT concat('user_', CAST(relation_user_id AS STRING)), concat('user_', CAST(user_id AS STRING)), created_at, amount, 'internal', currency
FROM c_rows WHERE sub_kind = 1 AND relation_user_id IS NOT NULL""",
        "ea_rows": """
SELECT g.src, g.dst, m.ts, coalesce(m.amount, 0) AS amount, g.edge_type FROM (
  SELECT source AS src, target AS dst, min(edge_type) AS edge_type FROM g_edges WHERE edge_type <> 'user_sends_wallet' GROUP BY ALL) g
LEFT JOIN (SELECT src, dst, arg_max(amount, {'t': ts, 'a': amount}) AS amount, max(ts) AS ts FROM tr_flows WHERE edge_type <> 'withdrawal' GROUP BY ALL) m
  ON m.src = g.src AND m.dst = g.dst""",
        "tr_links": """
SELECT * FROM tr_flows WHERE src <> dst QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY ts, amount, edge_type) = 1""",
        "tr_seeds": "SELECT concat('user_', CAST(user_id AS STRING)) AS seed FROM risk_grid WHERE status = 1 OR risk_score >= 0.8415",
        **_hops_sql(),
        "tr_scored": """
SELECT l.*, coalesce(r.risk_score, 0) AS source_risk_score,
  least(hop_count / 5.0::DOUBLE, 1.0) * 0.4::DOUBLE + CASE WHEN total > 0 THEN least(total / 1000000.0::DOUBLE, 1.0) ELSE least(hop_count / 5.0::DOUBLE, 1.0) END * 0.3::DOUBLE
    + coalesce(r.risk_score, 0) * 0.3::DOUBLE AS score
FROM tr_leaves l LEFT JOIN risk_grid r ON l.node = concat('user_', CAST(r.user_id AS STRING))""",
        "tr_best": """
SELECT * FROM tr_scored QUALIFY row_number() OVER (PARTITION BY seed ORDER BY score DESC, hop_count, pos) = 1""",
        "ch_nodes": """
SELECT seed AS fraud_node_id, i - 1 AS pos, path_nodes[i] AS node, coalesce(r.risk_score, 0) AS phi
FROM (SELECT seed, path_nodes, unnest(range(1, len(path_nodes) + 1)) AS i FROM tr_best)
LEFT JOIN risk_grid r ON path_nodes[i] = concat('user_', CAST(r.user_id AS STRING))""",
        "ch_scored": """
SELECT a.fraud_node_id, CAST(a.pos AS INT) AS pos, a.node, a.phi, a.phi * exp(avg(ln(greatest(b.phi, 1e-9)))) AS backward_score
FROM ch_nodes a JOIN ch_nodes b ON a.fraud_node_id = b.fraud_node_id AND b.pos >= a.pos GROUP BY a.fraud_node_id, a.pos, a.node, a.phi""",
        "mart_full0": """
SELECT u.*, COLUMNS(t.* EXCLUDE (user_id)), COLUMNS(c.* EXCLUDE (user_id)), COLUMNS(b.* EXCLUDE (user_id)), COLUMNS(i.* EXCLUDE (user_id)),
  s.fund_stay_sec, r.rk AS pagerank_score, d.graph_in_degree, d.graph_out_degree, k.connected_component_size,
  COLUMNS(x.* EXCLUDE (user_id)), COLUMNS(f.* EXCLUDE (user_id)), COLUMNS(m.* EXCLUDE (user_id))
FROM f_user u LEFT JOIN f_twd t ON u.user_id = t.user_id LEFT JOIN f_crypto c ON u.user_id = c.user_id
LEFT JOIN f_trading b ON u.user_id = b.user_id LEFT JOIN f_ip i ON u.user_id = i.user_id LEFT JOIN f_stay s ON u.user_id = s.user_id
LEFT JOIN (SELECT node, rk FROM p_rank WHERE it = (SELECT max(it) FROM p_rank)) r ON r.node = u.user_id
LEFT JOIN p_degree d ON d.node = u.user_id LEFT JOIN p_comp k ON k.node = u.user_id
LEFT JOIN f_cross x ON u.user_id = x.user_id LEFT JOIN f_red f ON u.user_id = f.user_id LEFT JOIN f_temporal m ON u.user_id = m.user_id""",
        "mart_full1": "SELECT user_id, coalesce(COLUMNS(* EXCLUDE (user_id)), 0) FROM mart_full0",
        "nm_nodes": """
SELECT concat('user_', CAST(user_id AS STRING)) AS node_id, age, CAST(has_kyc_level2 AS DOUBLE) AS has_kyc_level2 FROM f_user
UNION ALL SELECT node_id, 0.0, 0.0 FROM g_nodes WHERE node_type = 'wallet'""",
        "nm_one": """
SELECT target AS node_id, sum(a) AS l1_age, sum(k) AS l1_has_kyc_level2 FROM (
  SELECT target, edge_type, avg(age) AS a, avg(has_kyc_level2) AS k FROM g_edges JOIN nm_nodes ON node_id = source GROUP BY ALL) GROUP BY target""",
        "nm_two": """
SELECT target AS node_id, sum(a) AS l2_age, sum(k) AS l2_has_kyc_level2 FROM (
  SELECT target, edge_type, avg(coalesce(l1_age, 0)) AS a, avg(coalesce(l1_has_kyc_level2, 0)) AS k
  FROM g_edges LEFT JOIN nm_one ON node_id = source GROUP BY ALL) GROUP BY target""",
    }
)


def _edges(spark, sf):
    t = tables(spark, sf)
    return graph.graph_edges(t.crypto, t.users)


def _nodes(spark, sf):
    return graph.graph_nodes(tables(spark, sf).crypto, scored(spark, sf))


def _peers(spark, sf):
    t = tables(spark, sf)
    edges = cut_lineage(graph.peer_edges(t.crypto))
    return edges, graph.peer_nodes(edges, t.users)


def _black(spark, sf):
    return tables(spark, sf).users.where("status = 1").select(F.col("user_id").alias("node"))


@query("graph_edges", "SELECT source, target, source_raw, target_raw, edge_type FROM g_edges")
def _(spark, sf):
    return _edges(spark, sf).select("source", "target", "source_raw", "target_raw", "edge_type")


@query("graph_nodes", "SELECT * FROM g_nodes", fine="risk_score label")
def _(spark, sf):
    return _nodes(spark, sf)


@query("graph_degree", "SELECT * FROM p_degree")
def _(spark, sf):
    return graph.graph_degree(*_peers(spark, sf))


@query("graph_neighbors", "SELECT DISTINCT dst AS node, 'parent' AS direction, src AS neighbor FROM p_edges UNION ALL SELECT DISTINCT src, 'child', dst FROM p_edges")
def _(spark, sf):
    return graph.graph_neighbors(_peers(spark, sf)[0])


@query("parents_before", "SELECT DISTINCT target AS node, source AS parent FROM g_edges WHERE ts <= TIMESTAMP '1996-06-30 00:00:00'")
def _(spark, sf):
    return graph.parents_before(_edges(spark, sf), F.lit("1996-06-30 00:00:00").cast("timestamp"))


@query("component_size", "SELECT node, connected_component_size FROM p_comp")
def _(spark, sf):
    return graph_loops.component_size(graph_loops.components(*_peers(spark, sf)))


@query(
    "pagerank",
    "SELECT node, rk AS rank FROM p_rank WHERE it = (SELECT max(it) FROM p_rank)",
    fine="rank",
)
def _(spark, sf):
    return graph_loops.pagerank(*_peers(spark, sf))


@query("betweenness", "SELECT * FROM b_all", fine="betweenness")
def _(spark, sf):
    return graph_loops.betweenness(*_peers(spark, sf))


@query("graph_features", "SELECT * FROM p_features", fine="pagerank_score betweenness_centrality")
def _(spark, sf):
    return graph_loops.graph_features(*_peers(spark, sf))


@query("ancestors", "SELECT * FROM up_walk")
def _(spark, sf):
    return graph_loops.closure(_peers(spark, sf)[0], _black(spark, sf), upstream=True)


@query("descendants", "SELECT * FROM down_walk")
def _(spark, sf):
    return graph_loops.closure(_peers(spark, sf)[0], _black(spark, sf), upstream=False)


@query(
    "hop_class",
    """SELECT s.node AS target, coalesce(o.n, 0) AS one_hop, coalesce(t.n, 0) AS two_hop,
  (SELECT count(*) FROM p_nodes) - 1 - coalesce(o.n, 0) - coalesce(t.n, 0) + coalesce(o.loops, 0) AS outside
FROM p_seeds s LEFT JOIN (SELECT target, count(*) AS n, count(*) FILTER (node = target) AS loops FROM hop_one GROUP BY target) o ON o.target = s.node
LEFT JOIN (SELECT target, count(*) AS n FROM hop_two GROUP BY target) t ON t.target = s.node""",
)
def _(spark, sf):
    return graph_loops.hop_class(*_peers(spark, sf), _black(spark, sf))


@query("topo_layers", "SELECT node, max(layer) AS layer FROM p_depth GROUP BY node")
def _(spark, sf):
    return graph_loops.topo_layers(*_peers(spark, sf))


@query(
    "reachable",
    """SELECT q.v1, q.v2, coalesce(a.component = b.component, false) AS reachable
FROM (SELECT user_id AS v1, user_id - user_id % 16 + 1 AS v2 FROM user_info) q LEFT JOIN p_comp a ON a.node = v1 LEFT JOIN p_comp b ON b.node = v2""",
)
def _(spark, sf):
    pairs = tables(spark, sf).users.selectExpr("user_id as v1", "user_id - user_id % 16 + 1 as v2")
    return graph_loops.reachable(graph_loops.components(*_peers(spark, sf)), pairs)


@query("neighbor_detail", "SELECT * FROM nb_detail", fine="risk_score")
def _(spark, sf):
    return graph.neighbor_detail(_edges(spark, sf), _nodes(spark, sf))


@query(
    "neighbor_counts",
    """SELECT center, count(*) FILTER (relation = 'R1') AS r1, count(DISTINCT peer) FILTER (relation = 'R2') AS r2,
  count(*) FILTER (relation = 'R3') AS r3 FROM nb_detail GROUP BY center""",
)
def _(spark, sf):
    return graph.neighbor_counts(graph.neighbor_detail(_edges(spark, sf), _nodes(spark, sf)))


@query(
    "wallet_search",
    """SELECT wallet, usr AS user, relation, risk_score FROM w_links JOIN g_nodes ON node_id = usr WHERE contains(wallet, 'w12')""",
    fine="risk_score",
)
def _(spark, sf):
    return graph.wallet_search(_edges(spark, sf), _nodes(spark, sf), " W12")


@query(
    "wallet_top_user",
    """SELECT wallet, usr AS user, risk_score FROM w_links JOIN g_nodes ON node_id = usr
QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY risk_score DESC, usr) = 1""",
    fine="risk_score",
)
def _(spark, sf):
    return graph.wallet_top_user(_edges(spark, sf), _nodes(spark, sf))


def _subgraph(spark, sf):
    # read at every step: written once, so the scores are computed once
    nodes = cut_lineage(_nodes(spark, sf))
    # the dashboard opens the subgraph of a chosen user; here of the five riskiest
    centers = cut_lineage(nodes.where("node_type = 'user'").orderBy(F.col("risk_score").desc(), "node_id").limit(5))
    return graph.k_hop_subgraph(_edges(spark, sf), nodes, centers)


@query(
    "k_hop_subgraph",
    """SELECT k.center, k.node, k.node_type, k.risk_score FROM kh_kept k WHERE k.node = k.center
  OR EXISTS (SELECT 1 FROM kh_edges e WHERE e.center = k.center AND (e.source = k.node OR e.target = k.node))""",
    fine="risk_score",
)
def _(spark, sf):
    return _subgraph(spark, sf)[0]


@query(
    "k_hop_subgraph_edges",
    "SELECT center, source, target, CASE edge_type WHEN 'wallet_funds_user' THEN 'R1' WHEN 'user_transfers_user' THEN 'R2' ELSE 'R3' END AS relation FROM kh_edges",
)
def _(spark, sf):
    return _subgraph(spark, sf)[1]


MART_MONEY = f"{fq.TWD_MONEY} twd_net_flow {fq.CRYPTO_MONEY} {fq.TRADE_MONEY} {fq.TIME_MONEY}"
MART_RATIO = (
    f"{fq.USER_RATIO} twd_withdraw_ratio twd_wit_ip_ratio crypto_wit_ip_ratio {fq.TRADE_RATIO} ip_night_ratio fund_stay_sec"
    f" {fq.CROSS_RATIO} {fq.RED_RATIO} amount_p90_p10_ratio composite_risk_score"
)


MART_SQL = """SELECT *, least(greatest((1 - has_kyc_level2) * 0.30::DOUBLE + twd_withdraw_ratio * 0.25::DOUBLE + ip_night_ratio * 0.15::DOUBLE
  + crypto_currency_diversity * 0.10::DOUBLE + career_income_risk * 0.20::DOUBLE, 0), 1) AS composite_risk_score FROM mart_full1"""


MART_FULL_SQL = f"""SELECT m.* EXCLUDE (composite_risk_score), coalesce(p.betweenness_centrality, 0) AS betweenness_centrality, composite_risk_score
FROM ({MART_SQL}) m LEFT JOIN p_features p ON p.user_id = m.user_id"""


@query("feature_mart_full", MART_FULL_SQL, money=MART_MONEY, ratio=MART_RATIO, fine="pagerank_score betweenness_centrality")
@query("feature_mart", MART_FULL_SQL, money=MART_MONEY, ratio=MART_RATIO, fine="pagerank_score betweenness_centrality")
def _(spark, sf):
    return mart.feature_mart(tables(spark, sf), AS_OF, graph_loops.graph_features(*_peers(spark, sf)))


# ---- tracing ----


def _seeds(spark, sf):
    s = scored(spark, sf)
    chosen = s.where((F.col("status") == 1) | (F.col("risk_score") >= dashboard.DASHBOARD_THRESHOLD))
    return s, chosen.select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("node"))


def _trace(spark, sf):
    risks, seeds = _seeds(spark, sf)
    return trace.trace_sources(trace.trace_edges(tables(spark, sf).crypto), seeds, risks)


@query("trace_edges", "SELECT * FROM tr_flows", money="amount")
def _(spark, sf):
    return trace.trace_edges(tables(spark, sf).crypto)


@query("edge_amounts", "SELECT * FROM ea_rows", money="amount")
def _(spark, sf):
    return trace.edge_amounts(_edges(spark, sf), trace.trace_edges(tables(spark, sf).crypto))


TRACE_SQL = """SELECT seed AS fraud_node_id, node AS source_node_id, CASE WHEN starts_with(node, 'wallet_') THEN 'wallet' ELSE 'user' END AS source_node_type,
  to_json(path_nodes)::VARCHAR AS path_nodes, hop_count, earliest AS earliest_tx_time, total AS total_amount, source_risk_score, score FROM tr_best"""


@query("trace_sources_deep", TRACE_SQL, money="total_amount", ratio="source_risk_score score")
@query("trace_sources", TRACE_SQL, money="total_amount", ratio="source_risk_score score")
def _(spark, sf):
    return _trace(spark, sf).withColumn("path_nodes", F.to_json("path_nodes")).drop("path_edges")


@query(
    "fraud_chains",
    """SELECT seed AS fraud_node_id, node AS source_node_id, CASE WHEN starts_with(node, 'wallet_') THEN 'wallet' ELSE 'user' END AS source_node_type,
  to_json(path_nodes)::VARCHAR AS path_nodes, hop_count, earliest AS earliest_tx_time, total AS total_amount_twd,
  round(source_risk_score, 4) AS source_risk_score, round(score, 4) AS causal_confidence FROM tr_best""",
    money="total_amount_twd",
    ratio="source_risk_score causal_confidence",
)
def _(spark, sf):
    # the edge list is checked field by field through edge_causal_score
    return trace.fraud_chains(_trace(spark, sf)).drop("path_edges")


@query(
    "path_score",
    """SELECT src, dst, least(1 / 5.0::DOUBLE, 1.0) * 0.4::DOUBLE + least(amount / 1000000.0::DOUBLE, 1.0) * 0.3::DOUBLE + coalesce(risk_score, 0) * 0.3::DOUBLE AS score
FROM tr_flows LEFT JOIN risk_grid ON src = concat('user_', CAST(user_id AS STRING))""",
    ratio="score",
)
def _(spark, sf):
    flows = trace.trace_edges(tables(spark, sf).crypto)
    risk = scored(spark, sf).select(F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("src"), "risk_score")
    joined = flows.join(risk, "src", "left")
    score = trace.path_score(F.lit(1), F.col("amount"), F.coalesce("risk_score", F.lit(0.0)))
    return joined.select("src", "dst", score.alias("score"))


@query(
    "trace_stats",
    """SELECT count(*) AS chains, avg(hop_count) AS mean_hops, max(hop_count) AS max_hops,
  count(*) FILTER (starts_with(node, 'wallet_')) AS wallet_sources, count(*) FILTER (starts_with(node, 'user_')) AS user_sources FROM tr_best""",
    ratio="mean_hops",
)
def _(spark, sf):
    return trace.trace_stats(_trace(spark, sf))


def _chain(spark, sf):
    phi = scored(spark, sf).select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("node_id"), F.col("risk_score").alias("phi")
    )
    return _trace(spark, sf), phi


@query("backward_score", "SELECT * FROM ch_scored", ratio="phi backward_score")
def _(spark, sf):
    return trace.chain_nodes(*_chain(spark, sf))


@query(
    "chain_confidence",
    """SELECT fraud_node_id, round(CASE WHEN sum(backward_score) <> 0 THEN sum(phi * backward_score) / sum(backward_score) ELSE 0 END, 4) AS causal_confidence
FROM ch_scored GROUP BY fraud_node_id""",
    ratio="causal_confidence",
)
def _(spark, sf):
    return trace.chain_confidence(trace.chain_nodes(*_chain(spark, sf)))


@query(
    "root_cause",
    """SELECT fraud_node_id, node AS best_causal_node, backward_score FROM ch_scored
QUALIFY row_number() OVER (PARTITION BY fraud_node_id ORDER BY round(backward_score, 12) DESC, phi DESC, pos) = 1""",
    ratio="backward_score",
)
def _(spark, sf):
    rows = trace.chain_nodes(*_chain(spark, sf))
    return trace.root_cause(rows.withColumn("backward_score", F.round("backward_score", 12)))


@query(
    "edge_causal_score",
    """SELECT a.fraud_node_id, a.pos, a.node AS src, b.node AS dst, a.phi AS phi_src, b.phi AS phi_dst, round(a.phi * b.phi, 4) AS causal_score
FROM ch_scored a JOIN ch_scored b ON a.fraud_node_id = b.fraud_node_id AND b.pos = a.pos + 1""",
    ratio="phi_src phi_dst causal_score",
)
def _(spark, sf):
    return trace.edge_causal_score(*_chain(spark, sf))


COALITION = ["(1 - has_kyc_level2) * 0.30", "career_income_risk * 0.20", "is_high_risk_career * 0.25", "is_app_user * 0.10"]


@query(
    "coalition_shapley",
    "SELECT user_id AS node, least(greatest((" + " + ".join(f"{c}::DOUBLE" for c in COALITION) + ") / 4, 0), 1) AS phi FROM f_user",
    ratio="phi",
)
def _(spark, sf):
    """Values of every coalition of four score terms, as a full table."""
    terms = [F.expr(c).cast("double") for c in COALITION]
    value = F.lit(0.0)
    for i, term in enumerate(terms):
        value = value + F.when(F.shiftright("mask", i).bitwiseAND(F.lit(1)) == 1, term).otherwise(F.lit(0.0))
    users = profile.user_features_lite(tables(spark, sf).users, AS_OF)
    table = users.withColumn("mask", F.explode(F.sequence(F.lit(0), F.lit(2 ** len(terms) - 1)))).select(
        F.col("user_id").alias("node"), "mask", F.lit(len(terms)).alias("players"), value.alias("value")
    )
    return trace.coalition_shapley(table)


def _node_features(spark, sf):
    users = profile.user_features_lite(tables(spark, sf).users, AS_OF).select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("node_id"),
        "age",
        F.col("has_kyc_level2").cast("double").alias("has_kyc_level2"),
    )
    wallets = _nodes(spark, sf).where("node_type = 'wallet'").select("node_id", F.lit(0.0).alias("age"), F.lit(0.0).alias("has_kyc_level2"))
    return users.unionByName(wallets)


@query(
    "neighbor_mean_features",
    """SELECT n.node_id, n.age, n.has_kyc_level2, coalesce(l1_age, 0) AS l1_age, coalesce(l1_has_kyc_level2, 0) AS l1_has_kyc_level2,
  coalesce(l2_age, 0) AS l2_age, coalesce(l2_has_kyc_level2, 0) AS l2_has_kyc_level2
FROM nm_nodes n LEFT JOIN nm_one a ON a.node_id = n.node_id LEFT JOIN nm_two b ON b.node_id = n.node_id""",
    ratio="age has_kyc_level2 l1_age l1_has_kyc_level2 l2_age l2_has_kyc_level2",
)
def _(spark, sf):
    return graph.neighbor_mean_features(_edges(spark, sf), _node_features(spark, sf), ["age", "has_kyc_level2"])


# ---- dashboard ----


@query(
    "dashboard_stats",
    """WITH u AS (SELECT * FROM g_nodes WHERE node_type = 'user')
SELECT 'total_nodes' AS metric, CAST(count(*) AS DOUBLE) AS value FROM u
UNION ALL SELECT 'fraud_nodes', count(*) FROM u WHERE label >= 1
UNION ALL SELECT 'normal_nodes', count(*) FROM u WHERE label < 1
UNION ALL SELECT 'fraud_ratio', avg(CASE WHEN label >= 1 THEN 1 ELSE 0 END) FROM u
UNION ALL SELECT '[0, 0.2)', count(*) FROM u WHERE risk_score < 0.2
UNION ALL SELECT '[0.2, 0.4)', count(*) FROM u WHERE risk_score >= 0.2 AND risk_score < 0.4
UNION ALL SELECT '[0.4, 0.6)', count(*) FROM u WHERE risk_score >= 0.4 AND risk_score < 0.6
UNION ALL SELECT '[0.6, 0.8415)', count(*) FROM u WHERE risk_score >= 0.6 AND risk_score < 0.8415
UNION ALL SELECT '[0.8415, 1.0]', count(*) FROM u WHERE risk_score >= 0.8415
UNION ALL SELECT 'R1', count(*) FROM g_edges WHERE edge_type = 'wallet_funds_user'
UNION ALL SELECT 'R2', count(*) FROM g_edges WHERE edge_type = 'user_transfers_user'
UNION ALL SELECT 'R3', count(*) FROM g_edges WHERE edge_type = 'user_sends_wallet'""",
    ratio="value",
)
def _(spark, sf):
    return dashboard.dashboard_stats(_nodes(spark, sf), _edges(spark, sf))


@query("labelled_risk_list", "SELECT user_id, risk_score FROM risk_grid", fine="risk_score")
def _(spark, sf):
    return dashboard.labelled_risk_list(scored(spark, sf))


@query(
    "fp_fn",
    """SELECT CASE status WHEN 0 THEN 'FP' ELSE 'FN' END AS outcome, user_id, risk_score, status, 1 - status AS predicted_status
FROM risk_grid WHERE (status = 0 AND risk_score >= 0.8415) OR (status = 1 AND risk_score < 0.8415)""",
    fine="risk_score",
)
def _(spark, sf):
    return dashboard.fp_fn(scored(spark, sf))


@query(
    "case_groups",
    """SELECT user_id, risk_score, 'black' AS case_group FROM risk_grid WHERE user_id % 5 <> 0 AND status = 1
UNION ALL SELECT user_id, risk_score, 'FP' FROM risk_grid WHERE user_id % 5 <> 0 AND status = 0 AND risk_score >= 0.5
UNION ALL SELECT user_id, risk_score, 'FN' FROM risk_grid WHERE user_id % 5 <> 0 AND status = 1 AND risk_score < 0.5
UNION ALL SELECT user_id, risk_score, 'predicted_black' FROM risk_grid WHERE user_id % 5 = 0 AND risk_score >= 0.5""",
    fine="risk_score",
)
def _(spark, sf):
    label = F.when(F.col("user_id") % 5 != 0, F.col("status"))
    return dashboard.case_groups(scored(spark, sf).withColumn("status", label), 0.5)
