"""Named queries over a folder of test tables, each with its SQL statement where one exists."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .oracle import compose
from .rounding import on_grid, on_grid_sql


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    doubles: dict[str, int] = field(default_factory=dict)

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return on_grid(self.build(spark, sf_dir), self.doubles)

    def oracle(self) -> str | None:
        return None if self.sql is None else compose(on_grid_sql(self.sql, self.doubles))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, money: str = "", ratio: str = "", fine: str = ""):
    """Register a query. Space-separated double columns: ``money`` is compared at 2
    decimals, ``ratio`` at 6, ``fine`` at 9."""
    doubles = {c: d for names, d in ((money, 2), (ratio, 6), (fine, 9)) for c in names.split()}

    def add(build):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, build, sql, doubles)
        return build

    return add
