"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Amounts and rates are integers in units of 1e-8; ratio guard.
SCALE = 1e-8
EPS = 1e-9

MICROS_PER_SECOND = 1_000_000
MICROS_PER_HOUR = 3600 * MICROS_PER_SECOND
MICROS_PER_DAY = 24 * MICROS_PER_HOUR


def scaled(amount) -> Column:
    """Stored integer amount -> units."""
    return F.col(amount).cast("double") * SCALE if isinstance(amount, str) else amount.cast("double") * SCALE


def amount_twd(amount: str, rate: str | None = None) -> Column:
    """Value in TWD; the rate, when given, is stored on the same 1e-8 scale."""
    value = scaled(amount)
    return value if rate is None else value * F.col(rate).cast("double") * SCALE


def clip(value: Column, low=None, high=None) -> Column:
    """Bound a value and keep nulls null (least/greatest alone would drop them)."""
    bounded = value
    if low is not None:
        bounded = F.greatest(bounded, F.lit(low))
    if high is not None:
        bounded = F.least(bounded, F.lit(high))
    return F.when(value.isNotNull(), bounded)


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(float(MICROS_PER_SECOND))


def days_between_floor(later: Column, earlier: Column) -> Column:
    """Whole days, rounded towards minus infinity."""
    micros = F.unix_micros(later) - F.unix_micros(earlier)
    return F.floor(micros / F.lit(float(MICROS_PER_DAY))).cast("long")


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts).isin(5, 6)


def is_night(ts: Column) -> Column:
    return F.coalesce(F.hour(ts).between(0, 5), F.lit(False))


def flag(condition: Column) -> Column:
    """Boolean -> 0/1, null -> 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den with 0 where the denominator is 0."""
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def int_to_ip(value: Column) -> Column:
    """IPv4 integer -> dotted text; null when out of range."""
    v = value.cast("long")
    parts = [F.shiftright(v, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)]
    return F.when(v.between(0, 2**32 - 1), F.concat_ws(".", *parts))


def fill_zero(df: DataFrame, except_for: tuple[str, ...] = ("user_id",)) -> DataFrame:
    cols = [c for c in df.columns if c not in except_for]
    return df.fillna(0, subset=cols)


def clean_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    """NaN, infinities and nulls -> 0."""
    def one(c: str) -> Column:
        v = F.col(c).cast("double")
        bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
        return F.when(v.isNull() | bad, F.lit(0.0)).otherwise(v)

    return df.withColumns({c: one(c) for c in cols})


def align_columns(df: DataFrame, wanted: list[str], key: str = "user_id") -> DataFrame:
    """Key plus the wanted columns in order; columns the frame lacks become 0."""
    have = set(df.columns)
    return df.select(
        key,
        *[(F.col(c) if c in have else F.lit(0.0)).cast("double").alias(c) for c in wanted],
    )


def user_node(col) -> Column:
    return F.concat(F.lit("user_"), F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))


def wallet_node(col) -> Column:
    return F.concat(F.lit("wallet_"), F.col(col) if isinstance(col, str) else col)


def node_user_id(node: Column) -> Column:
    """Id of a user node, null for wallets."""
    return F.expr("cast(null as bigint)") if node is None else F.when(
        node.startswith("user_"), F.substring(node, 6, 20).try_cast("long")
    )
