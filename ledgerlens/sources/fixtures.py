"""The five base tables derived from the star-schema test tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import use_utc

AS_OF = "2002-01-01 00:00:00"


@dataclass(frozen=True)
class Tables:
    users: DataFrame
    fiat: DataFrame
    crypto: DataFrame
    trades: DataFrame
    swaps: DataFrame


def _users(customer: DataFrame) -> DataFrame:
    base = "788918400000000 + ((c_custkey * 7919) % 31536000) * 1000000"
    kyc1 = "788918400000000 + ((c_custkey * 7919) % 31536000 + (c_custkey * 131) % 900000 - 3600) * 1000000"
    kyc2 = (
        "788918400000000 + ((c_custkey * 7919) % 31536000 + (c_custkey * 131) % 900000"
        " + (c_custkey * 977) % 700000) * 1000000"
    )
    return customer.selectExpr(
        "cast(c_custkey as bigint) as user_id",
        "cast(case when c_acctbal < 0 then 1 else 0 end as int) as status",
        "cast(c_custkey % 3 as int) as sex",
        "cast(18 + (c_custkey * 7) % 60 as int) as age",
        "cast(1 + (c_custkey * 11) % 31 as int) as career",
        "cast(1 + c_nationkey % 10 as int) as income_source",
        "cast(c_custkey % 2 as int) as user_source",
        f"timestamp_micros({base}) as confirmed_at",
        f"timestamp_micros({kyc1}) as level1_finished_at",
        f"case when c_custkey % 11 = 0 then null else timestamp_micros({kyc2}) end as level2_finished_at",
    )


def _fiat(orders: DataFrame) -> DataFrame:
    return orders.selectExpr(
        "timestamp_micros(unix_micros(cast(o_orderdate as timestamp))"
        " + ((o_orderkey * 7919) % 86400) * 1000000) as created_at",
        "cast(o_custkey as bigint) as user_id",
        "cast(case when o_orderstatus = 'F' then 1 else 0 end as int) as kind",
        "case when o_custkey % 20 = 3 then (5000000 + o_orderkey % 1000) * 1000000"
        " else cast(round(o_totalprice * 100) as bigint) * 1000000 end as ori_samount",
        "case when o_orderkey % 4 = 0 then null"
        " else concat('ip_', cast((o_custkey * 5 + o_orderkey % 3) % 997 as string)) end as source_ip_hash",
    )


def _crypto(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    keys = orders.select("o_orderkey", "o_custkey")
    joined = lineitem.join(keys, lineitem.l_orderkey == keys.o_orderkey)
    internal = "l_returnflag = 'N' and l_orderkey % 10 = 0"
    return joined.selectExpr(
        "timestamp_micros(unix_micros(cast(l_shipdate as timestamp))"
        " + ((l_orderkey * 3607) % 86400) * 1000000) as created_at",
        "cast(o_custkey as bigint) as user_id",
        "cast(case when l_linestatus = 'F' then 1 else 0 end as int) as kind",
        f"cast(case when {internal} then 1 else 0 end as int) as sub_kind",
        "cast(l_quantity as bigint) * 100000000 as ori_samount",
        "cast(round(l_extendedprice / l_quantity * 100) as bigint) * 1000000 as twd_srate",
        f"case when {internal} then case when l_orderkey % 50 = 0 then 1000000 + o_custkey - o_custkey % 16"
        " else o_custkey - o_custkey % 16 + l_partkey % 16 end end as relation_user_id",
        f"case when l_linestatus = 'O' and not ({internal}) then concat('w', cast(l_suppkey as string)) end"
        " as from_wallet",
        f"case when l_linestatus = 'F' and not ({internal}) then concat('w', cast(l_partkey as string)) end"
        " as to_wallet",
        "cast(l_suppkey % 7 as int) as protocol",
        "case l_partkey % 5 when 0 then 'btc' when 1 then 'eth' when 2 then 'usdt' when 3 then 'ada'"
        " else 'trx' end as currency",
        "case when l_linenumber = 1 then null"
        " else concat('ip_', cast((o_custkey * 3 + l_suppkey % 4) % 997 as string)) end as source_ip_hash",
    )


def _compressed(ts: str) -> str:
    return (
        f"timestamp_micros(1003968000000000 + cast(floor((unix_micros(cast({ts} as timestamp))"
        " - 1704067200000000) / 12) as bigint))"
    )


def _trades(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin("purchase", "click", "view")).selectExpr(
        f"{_compressed('ts')} as updated_at",
        "user_id",
        "cast(case when event_type = 'purchase' then 1 else 0 end as int) as is_buy",
        "cast(round(value * 100) as bigint) * 1000000 as trade_samount",
        "3000000000 + (event_id % 100) * 1000000 as twd_srate",
        "concat('ip_', cast((user_id * 7 + event_id % 5) % 211 as string)) as source_ip_hash",
        "cast(case when event_id % 3 = 0 then 1 else 0 end as int) as is_market",
        "cast(event_id % 3 as int) as source",
    )


def _swaps(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin("signup", "error")).selectExpr(
        f"{_compressed('ts')} as created_at",
        "user_id",
        "cast(event_id % 2 as int) as kind",
        "cast(round(value * 100) as bigint) * 30000000 as twd_samount",
        "cast(round(value * 100) as bigint) * 1000000 as currency_samount",
    )


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    use_utc(spark)

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    orders, events = read("orders"), read("events")
    return Tables(
        users=_users(read("customer")),
        fiat=_fiat(orders),
        crypto=_crypto(read("lineitem"), orders),
        trades=_trades(events),
        swaps=_swaps(events),
    )
