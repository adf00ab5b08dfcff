"""Put doubles on a coarse grid so that two engines can be compared by value.

Floating sums depend on their order in the last bits. The small offset keeps values
that lie exactly half way between two grid points (averages of cents do) from
landing on different sides in the two engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OFFSET = 0.1379


def on_grid(df: DataFrame, doubles: dict[str, int]) -> DataFrame:
    def one(name: str, digits: int):
        stepped = F.rint(F.col(name).cast("double") * (10.0**digits) + OFFSET) / (10.0**digits)
        return F.when(stepped == 0, F.lit(0.0)).otherwise(stepped)

    return df.withColumns({n: one(n, d) for n, d in doubles.items()}) if doubles else df


def on_grid_sql(sql: str, doubles: dict[str, int]) -> str:
    if not doubles:
        return f"SELECT * FROM ({sql})"
    parts = []
    for name, digits in doubles.items():
        p = f"{10.0 ** digits:.1f}::DOUBLE"
        stepped = f"(round_even({name}::DOUBLE * {p} + {OFFSET}::DOUBLE, 0) / {p})"
        parts.append(f"CASE WHEN {stepped} = 0 THEN 0.0::DOUBLE ELSE {stepped} END AS {name}")
    return f"SELECT * REPLACE ({', '.join(parts)}) FROM ({sql})"
