"""Score, threshold, fusion and fairness queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import levels
from ..functions.prefix import global_percentiles
from ..operators import fairness, profile, scoring
from ..sources import loader
from ..session import work_folder
from ..sources.fixtures import AS_OF, tables
from .common import scored, scored_two, split_side
from .oracle import add_blocks
from .registry import query

L = levels.LEVELS
A = levels.ACTIONS


def _closed_right(score: str) -> str:
    return (
        f"CASE WHEN {score} <= 0.2 THEN '{L[0]}' WHEN {score} <= 0.4 THEN '{L[1]}' WHEN {score} <= 0.6 THEN '{L[2]}'"
        f" WHEN {score} <= 0.8 THEN '{L[3]}' ELSE '{L[4]}' END"
    )


def _closed_left(score: str, cuts=(0.2, 0.4, 0.6, 0.8)) -> str:
    a, b, c, d = cuts
    return (
        f"CASE WHEN {score} >= {d} THEN '{L[4]}' WHEN {score} >= {c} THEN '{L[3]}' WHEN {score} >= {b} THEN '{L[2]}'"
        f" WHEN {score} >= {a} THEN '{L[1]}' ELSE '{L[0]}' END"
    )


ACTION_SQL = "CASE lvl " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in A.items()) + " END"


def rates_sql(tp="tp", fp="fp", p="p", n="n") -> str:
    """precision, recall and f1 from counts, zero when undefined."""
    return (
        f"CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0.0 END AS precision,"
        f" CASE WHEN {p} > 0 THEN {tp} / {p} ELSE 0.0 END AS recall,"
        f" CASE WHEN {tp} > 0 THEN 2.0 * {tp} / (2 * {tp} + {fp} + ({p} - {tp})) ELSE 0.0 END AS f1"
    )


add_blocks(
    {
        "sweep_steps": "SELECT (5 + i) / 100 AS threshold FROM range(90) t(i)",
        "sweep_counts": """
SELECT threshold, count(*) FILTER (status = 1 AND risk_score >= threshold) AS tp,
  count(*) FILTER (status = 0 AND risk_score >= threshold) AS fp,
  count(*) FILTER (status = 1) AS p, count(*) FILTER (status = 0) AS n
FROM risk_grid, sweep_steps GROUP BY threshold""",
        "sweep_rows": f"""
SELECT threshold, tp, fp, n - fp AS tn, p - tp AS fn, {rates_sql()}, fp / n AS fpr, (p - tp) / p AS fnr,
  10 * (p - tp) + fp AS total_cost, (10 * (p - tp) + fp) / (p + n) AS cost_per_user FROM sweep_counts""",
        "pr_steps": """
SELECT risk_score AS threshold, CAST(sum(count(*) FILTER (status = 1)) OVER w AS BIGINT) AS tp,
  CAST(sum(count(*) FILTER (status = 0)) OVER w AS BIGINT) AS fp,
  count(*) FILTER (status = 1) AS pos, count(*) FILTER (status = 0) AS neg
FROM risk_grid GROUP BY risk_score WINDOW w AS (ORDER BY risk_score DESC)""",
        "pr_rows": """
SELECT threshold, tp, fp, tp / (tp + fp) AS precision, tp / (SELECT max(tp) FROM pr_steps) AS recall,
  2 * (tp / (tp + fp)) * (tp / (SELECT max(tp) FROM pr_steps))
    / (tp / (tp + fp) + tp / (SELECT max(tp) FROM pr_steps) + 1e-9) AS f_beta
FROM pr_steps""",
        "fused_rows": """
SELECT user_id, status, p_model, p_similar, 'weighted' AS strategy, 0.7::DOUBLE * p_model + 0.3::DOUBLE * p_similar AS hybrid_score,
  1 - abs(p_model - p_similar) AS confidence FROM risk_two
UNION ALL SELECT user_id, status, p_model, p_similar, 'cascade',
  CASE WHEN p_model > 0.3 THEN (p_model + p_similar) / 2 ELSE p_model * 0.5::DOUBLE END,
  CASE WHEN p_model > 0.3 THEN 1 - abs(p_model - p_similar) ELSE p_model END FROM risk_two
UNION ALL SELECT user_id, status, p_model, p_similar, 'voting', least(p_model, p_similar) * 2,
  CASE WHEN p_model > 0.5 AND p_similar > 0.5 THEN 1.0 ELSE 0.3 END FROM risk_two
UNION ALL SELECT user_id, status, p_model, p_similar, 'tiered',
  CASE WHEN p_model > 0.7 THEN p_model * 0.9::DOUBLE + p_similar * 0.1::DOUBLE
       WHEN p_model >= 0.3 THEN p_model * 0.6::DOUBLE + p_similar * 0.4::DOUBLE
       ELSE p_model * 0.3::DOUBLE + p_similar * 0.7::DOUBLE END,
  CASE WHEN p_model > 0.7 THEN 0.9 WHEN p_model >= 0.3 THEN 1 - abs(p_model - p_similar) ELSE p_similar END FROM risk_two""",
        "fair_long": """
SELECT attribute, grp, status, CASE WHEN risk_score >= 0.5 THEN 1 ELSE 0 END AS predicted FROM (
  SELECT 'is_female' AS attribute, CASE is_female WHEN 0 THEN '男性 (Male)' ELSE '女性 (Female)' END AS grp, status, risk_score FROM f_user JOIN risk_grid USING (user_id)
  UNION ALL SELECT 'age', CASE WHEN age < 30 THEN '< 30 歲' WHEN age < 50 THEN '30–50 歲' ELSE '> 50 歲' END, status, risk_score FROM f_user JOIN risk_grid USING (user_id)
  UNION ALL SELECT 'is_high_risk_career', CASE is_high_risk_career WHEN 0 THEN '一般職業' ELSE '高風險職業' END, status, risk_score FROM f_user JOIN risk_grid USING (user_id)
  UNION ALL SELECT 'is_high_risk_income', CASE is_high_risk_income WHEN 0 THEN '一般收入' ELSE '高風險收入' END, status, risk_score FROM f_user JOIN risk_grid USING (user_id))""",
        "fair_groups": """
SELECT attribute, grp, count(*) AS n, count(*) FILTER (predicted = 1) AS predicted_positive,
  count(*) FILTER (status = 1 AND predicted = 1) AS tp, count(*) FILTER (status = 0 AND predicted = 1) AS fp,
  count(*) FILTER (status = 1 AND predicted = 0) AS fn, count(*) FILTER (status = 0 AND predicted = 0) AS tn,
  avg(predicted) AS positive_rate, avg(predicted) FILTER (status = 1) AS tpr,
  avg(predicted) FILTER (status = 0) AS fpr, avg(status) FILTER (predicted = 1) AS precision
FROM fair_long GROUP BY ALL""",
        "fair_gaps": """
SELECT attribute, count(*) AS group_count, max(positive_rate) - min(positive_rate) AS dpd,
  CASE WHEN count(tpr) = count(*) THEN max(tpr) - min(tpr) END AS tpr_gap,
  CASE WHEN count(fpr) = count(*) THEN max(fpr) - min(fpr) END AS fpr_gap,
  CASE WHEN count(precision) = count(*) THEN max(precision) - min(precision) END AS precision_gap,
  min(positive_rate) / max(positive_rate) AS disparate_impact
FROM fair_groups GROUP BY attribute""",
        "fair_judged": """
SELECT *, CASE WHEN dpd < 0.05 THEN 'PASS' WHEN dpd < 0.10 THEN 'WARNING' ELSE 'FAIL' END AS demographic_parity,
  CASE WHEN tpr_gap < 0.05 THEN 'PASS' WHEN tpr_gap < 0.10 THEN 'WARNING' ELSE 'FAIL' END AS equalized_odds_tpr,
  CASE WHEN fpr_gap < 0.05 THEN 'PASS' WHEN fpr_gap < 0.10 THEN 'WARNING' ELSE 'FAIL' END AS equalized_odds_fpr,
  CASE WHEN disparate_impact IS NULL THEN 'N/A' WHEN disparate_impact BETWEEN 0.80 AND 1.25 THEN 'PASS'
       WHEN disparate_impact BETWEEN 0.60 AND 1.50 THEN 'WARNING' ELSE 'FAIL' END AS disparate_impact_judgment
FROM fair_gaps""",
        "fair_overall": """
SELECT *, CASE WHEN 'FAIL' IN (demographic_parity, equalized_odds_tpr, equalized_odds_fpr, disparate_impact_judgment) THEN 'FAIL'
  WHEN 'WARNING' IN (demographic_parity, equalized_odds_tpr, equalized_odds_fpr, disparate_impact_judgment) THEN 'WARNING'
  ELSE 'PASS' END AS overall FROM fair_judged""",
    }
)

# ---- sources ----


@query(
    "load_tables",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) AS row_count, count(DISTINCT user_id) AS users FROM {t}"
        for t in loader.BASE_TABLES
    ),
)
def _(spark, sf):
    t = tables(spark, sf)
    frames = dict(zip(loader.BASE_TABLES, (t.users, t.fiat, t.crypto, t.trades, t.swaps)))
    parts = [
        loader.coerce_types(df, name).agg(
            F.lit(name).alias("table_name"), F.count("*").alias("row_count"), F.count_distinct("user_id").alias("users")
        )
        for name, df in frames.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


RAW_TEXT = """
  CASE WHEN o_orderkey % 7 = 0 THEN 'bad' ELSE concat(' ', CAST(o_custkey AS STRING), '.0') END AS user_id,
  CASE WHEN o_orderkey % 11 = 0 THEN 'not a date' ELSE CAST(o_orderdate AS STRING) END AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '0' END AS kind,
  CAST(CAST(round(o_totalprice * 100) AS BIGINT) * 1000000 AS STRING) AS ori_samount,
  CASE WHEN o_orderkey % 5 = 0 THEN 'nan' ELSE o_orderpriority END AS source_ip"""


@query(
    "coerce_types",
    f"""SELECT TRY_CAST(TRY_CAST(user_id AS DOUBLE) AS BIGINT) AS user_id, TRY_CAST(created_at AS TIMESTAMP) AS created_at,
  TRY_CAST(kind AS INT) AS kind, TRY_CAST(ori_samount AS BIGINT) AS ori_samount,
  CASE WHEN source_ip <> 'nan' THEN source_ip END AS source_ip_hash
FROM (SELECT {RAW_TEXT} FROM orders)""",
)
def _(spark, sf):
    raw = spark.read.parquet(f"{sf}/orders.parquet").selectExpr(*[p.strip() for p in RAW_TEXT.split(",\n")])
    return loader.coerce_types(raw, "twd_transfer")


def _frames(spark, sf):
    t = tables(spark, sf)
    return dict(zip(loader.BASE_TABLES, (t.users, t.fiat, t.crypto, t.trades, t.swaps)))


@query("csv_round_trip", "SELECT user_id, created_at, kind, ori_samount, source_ip_hash FROM twd_transfer")
def _(spark, sf):
    """Written as quoted CSV under the alternate name, found and typed again by the reader."""
    base = work_folder(spark)
    loader.write_outputs({"twd_transfer_train.csv": _frames(spark, sf)["twd_transfer"]}, base, "csv")
    return loader.read_table(spark, base, "twd_transfer").select("user_id", "created_at", "kind", "ori_samount", "source_ip_hash")


@query("json_round_trip", "SELECT user_id, status, career, income_source, confirmed_at FROM user_info")
def _(spark, sf):
    base = work_folder(spark)
    users = _frames(spark, sf)["user_info"].select("user_id", "status", "career", "income_source", "confirmed_at")
    loader.write_outputs({"users": users}, base, "json")
    return loader.coerce_types(spark.read.schema(users.schema).json(f"{base}/users"), "user_info")


@query(
    "text_round_trip",
    "SELECT line, count(*) AS users FROM (SELECT concat('career ', CAST(career AS STRING), ' income ', CAST(income_source AS STRING)) AS line FROM user_info) GROUP BY line",
)
def _(spark, sf):
    base = work_folder(spark)
    lines = _frames(spark, sf)["user_info"].select(F.concat_ws(" ", F.lit("career"), "career", F.lit("income"), "income_source").alias("line"))
    loader.write_outputs({"lines": lines}, base, "text")
    return spark.read.text(f"{base}/lines").groupBy(F.col("value").alias("line")).agg(F.count("*").alias("users"))


@query(
    "load_predict",
    " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, count(*) FILTER (user_id % 5 = 0) AS row_count, count(DISTINCT user_id) FILTER (user_id % 5 = 0) AS users FROM {t}"
        for t in loader.BASE_TABLES
    ),
)
def _(spark, sf):
    """The predict side of all tables is written and loaded; a folder without one of them loads nothing."""
    base, partial = work_folder(spark), work_folder(spark)
    frames = {f"{t}.parquet": split_side(df, "predict") for t, df in _frames(spark, sf).items()}
    loader.write_outputs(frames, base)
    loader.write_outputs({"user_info.parquet": frames["user_info.parquet"]}, partial)
    if loader.load_predict(spark, partial) is not None:
        raise AssertionError("a folder without all tables must load nothing")
    out = None
    for name, df in loader.load_predict(spark, base).items():
        row = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"), F.count_distinct("user_id").alias("users"))
        out = row if out is None else out.unionByName(row)
    return out


NULL_COLS = ["created_at", "user_id", "relation_user_id", "from_wallet", "to_wallet", "currency", "source_ip_hash"]


@query(
    "null_report",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) - count({c}) AS nulls, (count(*) - count({c})) / count(*) AS null_share"
        " FROM crypto_transfer"
        for c in NULL_COLS
    ),
    ratio="null_share",
)
def _(spark, sf):
    return loader.null_report(tables(spark, sf).crypto.select(*NULL_COLS))


@query("label_distribution", "SELECT status, count(*) AS users FROM user_info GROUP BY status")
def _(spark, sf):
    return loader.label_distribution(tables(spark, sf).users)


def _labels(spark, sf):
    users = tables(spark, sf).users.select("user_id", "status")
    return split_side(users, "train"), split_side(users, "predict").select("user_id")


@query(
    "split_by_label",
    """SELECT user_id, created_at, kind, ori_samount, CASE WHEN user_id % 5 = 0 THEN 'predict' ELSE 'train' END AS split
FROM twd_transfer WHERE user_id IN (SELECT user_id FROM user_info)""",
)
def _(spark, sf):
    train, predict = _labels(spark, sf)
    rows = tables(spark, sf).fiat.select("user_id", "created_at", "kind", "ori_samount")
    return loader.split_by_label(rows, train, predict)


@query(
    "attach_label",
    "SELECT user_id, career, CASE WHEN user_id % 5 <> 0 THEN status END AS status FROM user_info",
)
def _(spark, sf):
    train, _ = _labels(spark, sf)
    return loader.attach_label(tables(spark, sf).users.select("user_id", "career"), train)


@query(
    "split_audit",
    """SELECT 0::BIGINT AS in_both,
  (SELECT count(*) FROM user_info WHERE user_id % 5 <> 0 AND user_id NOT IN (SELECT user_id FROM usdt_twd_trading)) AS train_without_rows,
  (SELECT count(*) FROM user_info WHERE user_id % 5 = 0 AND user_id NOT IN (SELECT user_id FROM usdt_twd_trading)) AS predict_without_rows,
  (SELECT count(DISTINCT user_id) FROM usdt_twd_trading WHERE user_id NOT IN (SELECT user_id FROM user_info)) AS rows_without_label""",
)
def _(spark, sf):
    train, predict = _labels(spark, sf)
    return loader.split_audit(tables(spark, sf).trades, train, predict)


@query(
    "fraud_seeds",
    """SELECT user_id, risk_score, CASE WHEN status = 1 THEN 'blacklist' ELSE 'predicted' END AS origin
FROM risk_grid WHERE status = 1 OR risk_score >= 0.8415""",
    fine="risk_score",
)
def _(spark, sf):
    s = scored(spark, sf)
    black = s.where("status = 1").select("user_id", "risk_score", F.lit("blacklist").alias("origin"))
    high = s.where(F.col("risk_score") >= scoring.DASHBOARD_THRESHOLD)
    return loader.first_per_user([black, high.select("user_id", "risk_score", F.lit("predicted").alias("origin"))])


@query(
    "all_scores",
    f"""SELECT user_id, CASE WHEN user_id % 5 <> 0 THEN status END AS true_label, risk_score,
  CASE WHEN risk_score >= 0.8415 THEN 1 ELSE 0 END AS predicted_blacklist, {_closed_right('risk_score')} AS risk_level,
  CASE WHEN user_id % 5 <> 0 THEN 'train' ELSE 'predict' END AS data_source FROM risk_grid""",
    fine="risk_score",
)
def _(spark, sf):
    s = scored(spark, sf)
    score = F.col("risk_score")
    shared = [
        score,
        (score >= scoring.DASHBOARD_THRESHOLD).cast("int").alias("predicted_blacklist"),
        levels.risk_level(score).alias("risk_level"),
    ]
    train = split_side(s, "train").select("user_id", F.col("status").alias("true_label"), *shared)
    return loader.all_scores(train, split_side(s, "predict").select("user_id", *shared))


@query(
    "int_to_ip",
    """SELECT event_id, CASE WHEN v BETWEEN 0 AND 4294967295 THEN
  concat(CAST((v >> 24) & 255 AS STRING), '.', CAST((v >> 16) & 255 AS STRING), '.', CAST((v >> 8) & 255 AS STRING), '.', CAST(v & 255 AS STRING)) END AS ip
FROM (SELECT event_id, event_id * 2654435 - 500 AS v FROM events)""",
)
def _(spark, sf):
    from ..functions.scalars import int_to_ip

    events = spark.read.parquet(f"{sf}/events.parquet")
    return events.select("event_id", int_to_ip(F.col("event_id") * 2654435 - 500).alias("ip"))


@query(
    "clean_features",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 0.0 WHEN c_custkey % 7 = 0 THEN 0.0 ELSE c_acctbal END AS balance FROM customer""",
    money="balance",
)
def _(spark, sf):
    from ..functions.scalars import clean_numeric

    dirty = spark.read.parquet(f"{sf}/customer.parquet").selectExpr(
        "c_custkey",
        "case when c_custkey % 3 = 0 then double('NaN') when c_custkey % 7 = 0 then double('Infinity') else c_acctbal end as balance",
    )
    return clean_numeric(dirty, ["balance"])


@query(
    "align_columns",
    "SELECT user_id, CAST(twd_wit_count AS DOUBLE) AS twd_wit_count, 0.0::DOUBLE AS unseen_feature,"
    " CAST(twd_dep_count AS DOUBLE) AS twd_dep_count FROM f_twd",
    ratio="twd_wit_count twd_dep_count unseen_feature",
)
def _(spark, sf):
    from ..functions.scalars import align_columns
    from ..operators.money import twd_features

    return align_columns(twd_features(tables(spark, sf).fiat), ["twd_wit_count", "unseen_feature", "twd_dep_count"])


# ---- levels and lists ----


@query(
    "risk_level",
    f"SELECT user_id, risk_score, {_closed_right('risk_score')} AS risk_level FROM risk_grid",
    fine="risk_score",
)
def _(spark, sf):
    return scored(spark, sf).select("user_id", "risk_score", levels.risk_level(F.col("risk_score")).alias("risk_level"))


@query(
    "risk_level_action",
    f"SELECT user_id, risk_score, lvl AS risk_level, {ACTION_SQL} AS action FROM (SELECT *, {_closed_left('risk_score')} AS lvl FROM risk_grid)",
    fine="risk_score",
)
def _(spark, sf):
    level = levels.level_at_least(F.col("risk_score"))
    return scored(spark, sf).select(
        "user_id", "risk_score", level.alias("risk_level"), levels.action_for(level).alias("action")
    )


@query(
    "rethreshold",
    f"SELECT user_id, risk_score, {_closed_left('risk_score', (0.08, 0.15, 0.25, 0.40))} AS risk_level,"
    " CASE WHEN risk_score >= 0.15 THEN 1 ELSE 0 END AS predicted_blacklist FROM risk_grid",
    fine="risk_score",
)
def _(spark, sf):
    return scoring.rethreshold(scored(spark, sf), levels.RETHRESHOLD_CUTS, levels.RETHRESHOLD_LABEL)


@query(
    "risk_tabs",
    """SELECT CASE WHEN risk_score >= 0.8743 THEN 'high' WHEN risk_score >= 0.65 THEN 'medium' WHEN risk_score >= 0.45 THEN 'low' END AS tab,
  count(*) AS users FROM risk_grid WHERE risk_score >= 0.45 GROUP BY 1""",
)
def _(spark, sf):
    tab = levels.risk_tab(F.col("risk_score"))
    return scored(spark, sf).groupBy(tab.alias("tab")).agg(F.count("*").alias("users")).where("tab is not null")


@query(
    "search_nodes",
    """SELECT user_id, risk_score FROM risk_grid WHERE risk_score >= 0.4 AND contains(CAST(user_id AS STRING), '12')""",
    fine="risk_score",
)
def _(spark, sf):
    from ..operators.dashboard import search_nodes

    return search_nodes(scored(spark, sf), " 12 ").select("user_id", "risk_score")


@query(
    "risk_distribution",
    f"""SELECT l.risk_level, count(r.user_id) AS users
FROM (VALUES {', '.join(f"('{n}')" for n in L)}) l(risk_level)
LEFT JOIN (SELECT user_id, {_closed_right('risk_score')} AS lv FROM risk_grid) r ON r.lv = l.risk_level GROUP BY 1""",
)
def _(spark, sf):
    return scoring.risk_distribution(scored(spark, sf))


@query(
    "score_percentiles",
    " UNION ALL ".join(
        f"SELECT 'p{p}' AS name, quantile_cont(risk_score, {p / 100}) AS risk_score FROM risk_grid" for p in (75, 90, 95, 99)
    ),
    ratio="risk_score",
)
def _(spark, sf):
    return global_percentiles(scored(spark, sf), "risk_score", {f"p{p}": p / 100 for p in (75, 90, 95, 99)})


@query(
    "top_risk_users",
    f"SELECT user_id, risk_score, {_closed_left('risk_score')} AS risk_level FROM risk_grid ORDER BY risk_score DESC, user_id LIMIT 10",
    fine="risk_score",
)
def _(spark, sf):
    return scoring.top_risk_users(scored(spark, sf))


@query(
    "case_examples",
    """SELECT outcome, case_no, user_id, risk_score FROM (
  SELECT user_id, risk_score, outcome, CAST(row_number() OVER (PARTITION BY outcome ORDER BY risk_score DESC, user_id) AS INT) AS case_no
  FROM (SELECT *, CASE WHEN status = 1 AND risk_score >= 0.5 THEN 'TP' WHEN status = 1 THEN 'FN' WHEN risk_score >= 0.5 THEN 'FP' END AS outcome FROM risk_grid)
  WHERE outcome IS NOT NULL) WHERE case_no <= 5""",
    fine="risk_score",
)
def _(spark, sf):
    return scoring.case_examples(scored(spark, sf), 0.5)


# ---- metrics and thresholds ----


@query(
    "confusion_matrix",
    f"""SELECT tp, fp, fn, tn, tp + fp + fn + tn AS total, (tp + tn) / (tp + fp + fn + tn) AS accuracy, {rates_sql(p='(tp + fn)')},
  2.0 * tn / (2 * tn + fn + fp) AS f1_normal,
  (2.0 * tn / (2 * tn + fn + fp) * (tn + fp) + CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0.0 END * (tp + fn)) / (tp + fp + fn + tn) AS f1_weighted,
  tn / (tn + fp) AS specificity
FROM (SELECT count(*) FILTER (status = 1 AND risk_score >= 0.8415) AS tp, count(*) FILTER (status = 0 AND risk_score >= 0.8415) AS fp,
  count(*) FILTER (status = 1 AND risk_score < 0.8415) AS fn, count(*) FILTER (status = 0 AND risk_score < 0.8415) AS tn FROM risk_grid)""",
    ratio="accuracy precision recall f1 f1_normal f1_weighted specificity",
)
def _(spark, sf):
    return scoring.confusion_matrix(scored(spark, sf))


@query(
    "binary_metrics",
    f"""SELECT 1 - lost / (p * n) AS auc_roc, auc_pr, {rates_sql()}, fp / n AS fpr FROM (
  SELECT (SELECT sum(pos * (fp - neg / 2)) FROM pr_steps) AS lost, count(*) FILTER (status = 1) AS p, count(*) FILTER (status = 0) AS n,
    count(*) FILTER (status = 1 AND risk_score >= 0.5) AS tp, count(*) FILTER (status = 0 AND risk_score >= 0.5) AS fp,
    (SELECT sum(pos * tp / (tp + fp)) / sum(pos) FROM pr_steps) AS auc_pr FROM risk_grid)""",
    ratio="auc_roc auc_pr f1 precision recall fpr",
)
def _(spark, sf):
    return scoring.binary_metrics(scored(spark, sf))


@query("pr_curve", "SELECT * FROM pr_rows", fine="threshold precision recall f_beta")
def _(spark, sf):
    return scoring.pr_curve(scored(spark, sf))


@query(
    "best_threshold",
    "SELECT * FROM pr_rows ORDER BY f_beta DESC, threshold LIMIT 1",
    fine="threshold precision recall f_beta",
)
def _(spark, sf):
    return scoring.best_threshold(scoring.pr_curve(scored(spark, sf)))


SWEEP_DOUBLES = "threshold precision recall f1 fpr fnr cost_per_user"


@query("threshold_sweep", "SELECT * FROM sweep_rows", ratio=SWEEP_DOUBLES)
def _(spark, sf):
    return scoring.threshold_sweep(scored(spark, sf))


def _pick(name: str, keep: str, order: str) -> str:
    return (
        f"(SELECT '{name}' AS rule, threshold, precision, recall, f1, total_cost FROM sweep_rows WHERE {keep}"
        f" ORDER BY {order}, threshold LIMIT 1)"
    )


@query(
    "threshold_picks",
    " UNION ALL ".join(
        [
            _pick("best_f1", "true", "f1 DESC"),
            _pick("min_cost", "true", "total_cost"),
            _pick("precision_at_recall_70", "recall >= 0.70", "precision DESC"),
            _pick("balanced", "true", "abs(precision - recall)"),
            _pick("recall_50_precision_20", "recall >= 0.5 AND precision >= 0.2", "f1 DESC"),
        ]
    ),
    ratio="threshold precision recall f1",
)
def _(spark, sf):
    return scoring.threshold_picks(scoring.threshold_sweep(scored(spark, sf)))


# ---- model score algebra ----


@query(
    "meta_features",
    """SELECT user_id, status, p_model, p_similar, p_night, greatest(p_model, p_similar, p_night) AS meta_max,
  least(p_model, p_similar, p_night) AS meta_min, list_stddev_pop([p_model, p_similar, p_night]) AS meta_std,
  (p_model + p_similar + p_night) / 3 AS meta_mean FROM risk_two""",
    ratio="p_model p_similar p_night meta_max meta_min meta_std meta_mean",
)
def _(spark, sf):
    return scoring.meta_features(scored_two(spark, sf), ["p_model", "p_similar", "p_night"])


@query(
    "blend_scores",
    """SELECT user_id, 0.9 * (p_model * 0.6 + p_similar * 0.4) + 0.1 * p_night AS blended_score FROM risk_two""",
    ratio="blended_score",
)
def _(spark, sf):
    blended = scoring.blend_scores(scored_two(spark, sf), {"p_model": 0.3, "p_similar": 0.2}, graph="p_night")
    return blended.select("user_id", "blended_score")


@query(
    "focal_weight",
    """SELECT user_id, status, risk_score, CASE WHEN status = 1 THEN 0.75 * pow(1 - risk_score, 2) ELSE 0.25 * pow(risk_score, 2) END AS focal_weight FROM risk_grid""",
    ratio="risk_score focal_weight",
)
def _(spark, sf):
    return scoring.focal_weight(scored(spark, sf))


@query(
    "pseudo_labels",
    """SELECT user_id, risk_score, CASE WHEN risk_score >= 0.85 THEN 1 ELSE 0 END AS pseudo_label FROM risk_grid
WHERE user_id % 5 = 0 AND (risk_score >= 0.85 OR risk_score <= 0.05)""",
    fine="risk_score",
)
def _(spark, sf):
    return scoring.pseudo_labels(split_side(scored(spark, sf), "predict"))


@query(
    "pseudo_label_stats",
    """SELECT count(*) FILTER (risk_score >= 0.85) AS pos_added, count(*) FILTER (risk_score <= 0.05) AS neg_added,
  count(*) FILTER (risk_score > 0.05 AND risk_score < 0.85) AS remaining, avg(risk_score) AS score_mean, stddev_pop(risk_score) AS score_std
FROM risk_grid WHERE user_id % 5 = 0""",
    ratio="score_mean score_std",
)
def _(spark, sf):
    return scoring.pseudo_label_stats(split_side(scored(spark, sf), "predict"))


def _fused(spark, sf):
    return scoring.fuse_scores(scored_two(spark, sf), "p_model", "p_similar")


@query(
    "fuse_scores",
    "SELECT user_id, strategy, hybrid_score, confidence FROM fused_rows",
    ratio="hybrid_score confidence",
)
def _(spark, sf):
    return _fused(spark, sf).select("user_id", "strategy", "hybrid_score", "confidence")


@query(
    "fusion_compare",
    f"""SELECT strategy, threshold, precision, recall, f1, tp, fp, p - tp AS fn, n - fp AS tn FROM (
  SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY f1 DESC, threshold) AS rn FROM (
    SELECT *, {rates_sql()} FROM (
      SELECT strategy, threshold, count(*) FILTER (status = 1 AND h >= threshold) AS tp, count(*) FILTER (status = 0 AND h >= threshold) AS fp,
        count(*) FILTER (status = 1) AS p, count(*) FILTER (status = 0) AS n
      FROM (SELECT strategy, status, round_even(hybrid_score * 1e9::DOUBLE, 0) / 1e9::DOUBLE AS h FROM fused_rows),
        (SELECT (10 + 5 * i) / 100 AS threshold FROM range(16) t(i)) GROUP BY ALL)))
WHERE rn = 1""",
    ratio="threshold precision recall f1",
)
def _(spark, sf):
    from .common import grid

    return scoring.fusion_compare(_fused(spark, sf).withColumn("hybrid_score", grid(F.col("hybrid_score"))))


@query(
    "fusion_explain",
    f"""SELECT user_id, strategy, h AS hybrid_score, confidence, CASE WHEN h >= 0.5 THEN 1 ELSE 0 END AS prediction,
  {_closed_left('h')} AS risk_level,
  CASE WHEN h >= 0.5 AND p_model > 0.7 AND p_similar > 0.5 THEN '{scoring.REASON_BOTH_HIGH}'
    WHEN h >= 0.5 AND p_model > 0.7 THEN '{scoring.REASON_MODEL_HIGH}' WHEN h >= 0.5 AND p_similar > 0.7 THEN '{scoring.REASON_SIMILAR}'
    WHEN h >= 0.5 THEN '{scoring.REASON_COMBINED}' WHEN p_model < 0.3 AND p_similar < 0.3 THEN '{scoring.REASON_BOTH_LOW}'
    WHEN abs(p_model - p_similar) > 0.4 THEN '{scoring.REASON_DISAGREE}' ELSE '' END AS reason,
  CASE WHEN h < 0.5 AND abs(p_model - p_similar) > 0.4 AND NOT (p_model < 0.3 AND p_similar < 0.3) THEN 1 ELSE 0 END AS manual_review
FROM (SELECT *, round_even(hybrid_score * 1e9::DOUBLE, 0) / 1e9::DOUBLE AS h FROM fused_rows)""",
    ratio="hybrid_score confidence",
)
def _(spark, sf):
    from .common import grid

    fused = _fused(spark, sf).withColumn("hybrid_score", grid(F.col("hybrid_score")))
    return scoring.fusion_explain(fused, "p_model", "p_similar")


# ---- fairness ----


def _fair(spark, sf):
    users = profile.user_features(tables(spark, sf).users, AS_OF).select("user_id", *fairness.ATTRIBUTES)
    predicted = (F.col("risk_score") >= 0.5).cast("int")
    return fairness.fairness_groups(users.join(scored(spark, sf).withColumn("predicted", predicted), "user_id"))


GAPS = "dpd tpr_gap fpr_gap precision_gap disparate_impact"


@query("fairness_groups", "SELECT * FROM fair_groups", ratio="positive_rate tpr fpr precision")
def _(spark, sf):
    return _fair(spark, sf)


@query("fairness_gaps", "SELECT * FROM fair_gaps", ratio=GAPS)
def _(spark, sf):
    return fairness.fairness_gaps(_fair(spark, sf))


@query("fairness_judgments", "SELECT * FROM fair_overall", ratio=GAPS)
def _(spark, sf):
    return fairness.fairness_judgments(fairness.fairness_gaps(_fair(spark, sf)))


LABEL_SQL = "CASE attribute " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in fairness.ATTRIBUTES.items()) + " END"


@query(
    "fairness_report",
    f"""SELECT *, CASE overall WHEN 'FAIL' THEN replace('{fairness.ADVICE_FAIL}', '%s', label)
  WHEN 'WARNING' THEN replace('{fairness.ADVICE_WARNING}', '%s', label) ELSE '{fairness.ADVICE_NONE}' END AS recommendation
FROM (SELECT *, {LABEL_SQL} AS label FROM fair_overall)""",
    ratio=GAPS,
)
def _(spark, sf):
    judged = fairness.fairness_judgments(fairness.fairness_gaps(_fair(spark, sf)))
    return fairness.fairness_report(judged)
