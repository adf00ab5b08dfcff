"""Explanation queries over a linear score of fifteen mart features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.labels import FEATURE_LABELS, feature_label
from ..functions.levels import COMPOSITE_V1, COMPOSITE_V1_NO_KYC, composite_risk
from ..operators import explain, mart
from ..operators.scoring import DASHBOARD_THRESHOLD
from ..session import cut_lineage
from ..sources.fixtures import AS_OF, tables
from .common import grid, scored, scored_features, split_side
from .oracle import add_blocks
from .registry import query
from .score_queries import ACTION_SQL, _closed_left

# Weights of the linear score the explanations are computed for.
COEFS = {
    "kyc_speed_sec": -1e-7,
    "account_age_days": 1e-5,
    "age": -0.002,
    "is_high_risk_career": 0.3,
    "is_high_risk_income": 0.2,
    "is_app_user": 0.05,
    "twd_dep_count": 0.01,
    "twd_dep_mean": 2e-7,
    "twd_wit_count": 0.012,
    "twd_smurf_flag": 0.5,
    "crypto_wit_count": 0.004,
    "crypto_currency_diversity": 0.1,
    "ip_night_ratio": 0.6,
    "ip_max_shared": 0.002,
    "fund_stay_sec": -1e-8,
}
# The composite score before clipping is linear; its reports are explained by its own weights.
COMPOSITE = {"has_kyc_level2": -COMPOSITE_V1_NO_KYC, **COMPOSITE_V1}
USED = sorted(set(COEFS) | set(COMPOSITE) | set(explain.MUTABLE_FEATURES))


def _label_sql(col: str) -> str:
    return "CASE " + col + " " + " ".join(f"WHEN '{f}' THEN '{FEATURE_LABELS[f]}'" for f in USED) + f" ELSE {col} END"


def _fixed(col: str, digits: int) -> str:
    n = f"CAST(round_even(abs({col}) * {10 ** digits}::DOUBLE, 0) AS BIGINT)"
    return (
        f"concat(CASE WHEN {col} < 0 AND {n} > 0 THEN '-' ELSE '' END, CAST({n} // {10 ** digits} AS STRING), '.',"
        f" lpad(CAST({n} % {10 ** digits} AS STRING), {digits}, '0'))"
    )


def _long_sql(coefs: dict[str, float]) -> str:
    return " UNION ALL ".join(
        f"SELECT user_id, '{f}' AS feature, {i} AS fidx, CAST({f} AS DOUBLE) AS value,"
        f" round_even({w!r}::DOUBLE * ({f} - (SELECT avg({f}) FROM f_mart_lite)) * 1e9::DOUBLE, 0) / 1e9::DOUBLE AS shap FROM f_mart_lite"
        for i, (f, w) in enumerate(coefs.items())
    )


def _top_sql(long: str) -> str:
    return f"""
SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY abs(shap) DESC, fidx) AS INT) AS rank,
  CASE WHEN shap > 0 THEN '{explain.DIRECTION_UP}' ELSE '{explain.DIRECTION_DOWN}' END AS direction FROM {long}
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(shap) DESC, fidx) <= 10"""


add_blocks(
    {
        "at_long": _long_sql(COEFS),
        "at_top": _top_sql("at_long"),
        "cs_long": _long_sql(COMPOSITE),
        "cs_top": _top_sql("cs_long"),
        "at_mean": "SELECT feature, avg(abs(shap)) AS mean_abs_shap FROM at_long GROUP BY feature",
        "at_rank": """
SELECT feature, mean_abs_shap, CAST(row_number() OVER (ORDER BY mean_abs_shap DESC, feature) AS INT) AS rank,
  100 * mean_abs_shap / sum(mean_abs_shap) OVER () AS share,
  100 * sum(mean_abs_shap) OVER (ORDER BY mean_abs_shap DESC, feature) / sum(mean_abs_shap) OVER () AS cumulative_share FROM at_mean""",
        "at_black": "SELECT t.* FROM at_top t JOIN user_info USING (user_id) WHERE status = 1",
        "at_pos": """
SELECT feature, avg(abs(shap)) AS mean_abs_shap, count(*) FILTER (shap > 0) AS frequency FROM at_black GROUP BY feature""",
        "at_pos_rank": """
SELECT feature, mean_abs_shap, frequency, CAST(row_number() OVER (ORDER BY mean_abs_shap DESC, feature) AS INT) AS rank,
  100 * mean_abs_shap / sum(mean_abs_shap) OVER () AS share,
  100 * sum(mean_abs_shap) OVER (ORDER BY mean_abs_shap DESC, feature) / sum(mean_abs_shap) OVER () AS cumulative_share FROM at_pos""",
        "cf_base": """
SELECT user_id, (1 - has_kyc_level2) * 0.30::DOUBLE AS k, twd_withdraw_ratio * 0.25::DOUBLE AS w, ip_night_ratio * 0.15::DOUBLE AS n,
  crypto_currency_diversity * 0.10::DOUBLE AS c, career_income_risk * 0.20::DOUBLE AS r, twd_withdraw_ratio, ip_night_ratio, crypto_currency_diversity FROM f_mart_lite""",
        "cf_rows": """
SELECT user_id, feature, round(cur, 4) AS current, 0.0::DOUBLE AS target, CAST(round(CAST(d AS DECIMAL(18, 9)), 4) AS DOUBLE) AS score_drop FROM (
  SELECT user_id, 'twd_withdraw_ratio' AS feature, CAST(twd_withdraw_ratio AS DOUBLE) AS cur, least(greatest(k+w+n+c+r, 0), 1) - least(greatest(k+n+c+r, 0), 1) AS d FROM cf_base
  UNION ALL SELECT user_id, 'ip_night_ratio', ip_night_ratio, least(greatest(k+w+n+c+r, 0), 1) - least(greatest(k+w+c+r, 0), 1) FROM cf_base
  UNION ALL SELECT user_id, 'crypto_currency_diversity', crypto_currency_diversity, least(greatest(k+w+n+c+r, 0), 1) - least(greatest(k+w+n+r, 0), 1) FROM cf_base)
WHERE round(d, 9) > 0""",
        "cf_top": """
SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY score_drop DESC, feature) AS INT) AS rank FROM cf_rows""",
    }
)


def _features(spark, sf):
    return cut_lineage(mart.feature_mart_lite(tables(spark, sf), AS_OF))


def _long(spark, sf, coefs=COEFS, features=None):
    df = (_features(spark, sf) if features is None else features).select("user_id", *coefs)
    means = explain.column_means(df, list(coefs))
    return explain.attributions(df, coefs, means).withColumn("shap", grid(F.col("shap")))


def _top(spark, sf, coefs=COEFS, features=None):
    return explain.shap_top10(_long(spark, sf, coefs, features))


def _black(spark, sf):
    return tables(spark, sf).users.where("status = 1").select("user_id")


@query("feature_labels", f"SELECT feature, {_label_sql('feature')} AS label, count(*) AS users FROM at_long GROUP BY feature")
def _(spark, sf):
    return _long(spark, sf).groupBy("feature", feature_label(F.col("feature")).alias("label")).agg(F.count("*").alias("users"))


@query("attributions", "SELECT * FROM at_long", money="value", fine="shap")
def _(spark, sf):
    return _long(spark, sf)


@query("shap_top10", "SELECT * FROM at_top", money="value", fine="shap")
def _(spark, sf):
    return _top(spark, sf)


@query(
    "shap_summary",
    f"SELECT feature, count(*) AS frequency, avg(abs(shap)) AS avg_abs_shap, avg(shap) AS avg_shap, {_label_sql('feature')} AS label FROM at_top GROUP BY feature",
    ratio="avg_abs_shap avg_shap",
)
def _(spark, sf):
    return explain.shap_summary(_top(spark, sf))


@query(
    "shap_group_mean",
    f"""SELECT feature, contribution, {_label_sql('feature')} AS label FROM (
  SELECT feature, round(avg(shap), 4) AS contribution FROM cs_top WHERE user_id IN (
    SELECT user_id FROM risk_grid WHERE status = 1 AND risk_score < 0.8415) GROUP BY feature)
ORDER BY abs(contribution) DESC, feature LIMIT 10""",
    ratio="contribution",
)
def _(spark, sf):
    missed = scored(spark, sf).where((F.col("status") == 1) & (F.col("risk_score") < DASHBOARD_THRESHOLD))
    return explain.shap_group_mean(_top(spark, sf, COMPOSITE), missed)


@query(
    "shap_rank",
    f"SELECT *, {_label_sql('feature')} AS label FROM at_rank",
    ratio="mean_abs_shap share cumulative_share",
)
def _(spark, sf):
    return explain.shap_rank(explain.mean_abs(_long(spark, sf)))


@query(
    "shap_top20",
    f"""SELECT r.*, {_label_sql('r.feature')} AS label, coalesce(f.n, 0) AS frequency FROM at_rank r
LEFT JOIN (SELECT feature, count(*) AS n FROM at_top GROUP BY feature) f ON f.feature = r.feature WHERE rank <= 20""",
    ratio="mean_abs_shap share cumulative_share",
)
def _(spark, sf):
    return explain.shap_top20(cut_lineage(_long(spark, sf)))


@query(
    "shap_top20_positive",
    f"SELECT *, {_label_sql('feature')} AS label FROM at_pos_rank WHERE rank <= 20",
    ratio="mean_abs_shap share cumulative_share",
)
def _(spark, sf):
    return explain.shap_top20_positive(_top(spark, sf).join(_black(spark, sf), "user_id", "left_semi"))


@query(
    "importance_compare",
    """SELECT coalesce(a.feature, b.feature) AS feature, coalesce(a.share, 0) AS share_left, coalesce(b.share, 0) AS share_right,
  coalesce(a.share, 0) - coalesce(b.share, 0) AS difference, greatest(coalesce(a.share, 0), coalesce(b.share, 0)) AS larger
FROM at_rank a FULL JOIN at_pos_rank b ON a.feature = b.feature""",
    ratio="share_left share_right difference larger",
)
def _(spark, sf):
    long = cut_lineage(_long(spark, sf))
    black = explain.shap_top10(long).join(_black(spark, sf), "user_id", "left_semi")
    return explain.importance_compare(explain.shap_rank(explain.mean_abs(long)), explain.shap_top20_positive(black))


@query(
    "case_explanation",
    f"SELECT user_id, rank, {_label_sql('feature')} AS label, shap AS contribution, value AS feature_value FROM at_top",
    money="feature_value",
    fine="contribution",
)
def _(spark, sf):
    return explain.case_explanation(_top(spark, sf))


@query(
    "waterfall",
    """SELECT user_id, rank, feature, shap, -2.885 + sum(shap) OVER w - shap AS from_value, -2.885 + sum(shap) OVER w AS to_value
FROM at_top WINDOW w AS (PARTITION BY user_id ORDER BY rank)""",
    ratio="shap from_value to_value",
)
def _(spark, sf):
    return explain.waterfall(_top(spark, sf))


def _changes(df):
    return explain.counterfactuals(df, lambda d: d.withColumn("score", composite_risk()))


@query("counterfactuals", "SELECT * FROM cf_top", money="current", ratio="target score_drop")
def _(spark, sf):
    return _changes(_features(spark, sf))


RISK_LINE = (
    f"concat('  ', CAST(rank AS STRING), '. ', {_label_sql('feature')}, ' = ', {_fixed('value', 3)}, '  ',"
    f" CASE WHEN shap > 0 THEN '▲' ELSE '▼' END, ' ', {_fixed('abs(shap)', 4)})"
)


@query(
    "risk_report",
    f"""SELECT user_id, concat('{explain.REPORT_TITLE}', CAST(user_id AS STRING), chr(10), '{explain.REPORT_SCORE}', {_fixed('risk_score', 4)}, chr(10),
  '{explain.REPORT_LEVEL}', lvl, chr(10), '{explain.REPORT_ACTION}', {ACTION_SQL}, chr(10), '{explain.REPORT_FACTORS}', chr(10), lines) AS report
FROM (SELECT *, {_closed_left('risk_score')} AS lvl FROM risk_grid) JOIN (
  SELECT user_id, string_agg({RISK_LINE}, chr(10) ORDER BY rank) AS lines FROM cs_top WHERE rank <= 5 GROUP BY user_id) USING (user_id)""",
)
def _(spark, sf):
    return explain.risk_report(scored(spark, sf), _top(spark, sf, COMPOSITE))


CHANGE_LINE = (
    f"concat('  • 若將「', {_label_sql('feature')}, '」從 ', {_fixed('current', 4)}, ' 調整至 0.0，風險分數可降低 ', {_fixed('score_drop', 4)})"
)


@query(
    "risk_report_with_changes",
    f"""SELECT r.user_id, concat('{explain.REPORT_TITLE}', CAST(r.user_id AS STRING), chr(10), '{explain.REPORT_SCORE}', {_fixed('risk_score', 4)}, chr(10),
  '{explain.REPORT_LEVEL}', lvl, chr(10), '{explain.REPORT_ACTION}', {ACTION_SQL}, chr(10), '{explain.REPORT_FACTORS}', chr(10), lines,
  CASE WHEN changes IS NULL THEN '' ELSE concat(chr(10), '{explain.REPORT_CHANGES}', chr(10), changes) END) AS report
FROM (SELECT *, {_closed_left('risk_score')} AS lvl FROM risk_grid) r JOIN (
  SELECT user_id, string_agg({RISK_LINE}, chr(10) ORDER BY rank) AS lines FROM cs_top WHERE rank <= 5 GROUP BY user_id) t ON t.user_id = r.user_id
LEFT JOIN (SELECT user_id, string_agg({CHANGE_LINE}, chr(10) ORDER BY rank) AS changes FROM cf_top GROUP BY user_id) c ON c.user_id = r.user_id""",
)
def _(spark, sf):
    scores, features = scored_features(spark, sf)
    return explain.risk_report(scores, _top(spark, sf, COMPOSITE, features), _changes(features))


@query("predict_reports", ratio="risk_score")
def _(spark, sf):
    scores, features = scored_features(spark, sf)
    return explain.predict_reports(split_side(scores, "predict"), _top(spark, sf, COMPOSITE, features), _changes(features))


@query("predict_list", ratio="risk_score")
def _(spark, sf):
    return explain.predict_list(split_side(scored(spark, sf), "predict"), _top(spark, sf, COMPOSITE), DASHBOARD_THRESHOLD)


PERTURBED = [*COEFS, "sex", "income_source", "user_source", "career"]


@query("perturb", ratio=" ".join(PERTURBED))
def _(spark, sf):
    codes = tables(spark, sf).users.select("user_id", "sex", "income_source", "user_source", "career")
    df = _features(spark, sf).select("user_id", *COEFS).join(codes, "user_id")
    df = cut_lineage(df.select("user_id", *[F.col(c).cast("double").alias(c) for c in PERTURBED]))
    measures = [f(c).alias(f"{f.__name__}_{c}") for c in PERTURBED for f in (F.stddev_pop, F.min, F.max)]
    s = df.agg(*measures).first()
    stds = {c: float(s[f"stddev_pop_{c}"]) for c in PERTURBED}
    bounds = {c: (float(s[f"min_{c}"]), float(s[f"max_{c}"])) for c in PERTURBED}
    careers = [float(v) for v in range(1, 32)]
    kinds = explain.FEATURE_KINDS | {"career": "label_encoded"}
    return explain.perturb(df, PERTURBED, stds, bounds, kinds=kinds, valid={"career": careers})


@query("ssr", ratio="epsilon ssr")
def _(spark, sf):
    users = tables(spark, sf).users.select("user_id", "status")
    return explain.ssr(_features(spark, sf).select("user_id", *COEFS).join(users, "user_id"), COEFS)
