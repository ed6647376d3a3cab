"""The query profile: a log of searches, its ring of newest rows and its latency summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RING = 300


#: Values that are sorted out at once for a percentile, and cells that a range is cut into.
MOST_VALUES, CELLS = 1 << 16, 1000


def percentile(df: DataFrame, column: str, q: float, most: int = MOST_VALUES) -> float:
    """Exact percentile with linear interpolation of a numeric column; 0 of nothing, nulls do not count.

    Each pass counts the values of a range in CELLS cells and goes on in the cell that holds the
    rank, until at most `most` values are left; so no task holds all values, as an aggregate does.
    """
    x = F.col(column).cast("double")
    values = df.where(x.isNotNull()).select(x.alias("x"))
    n, low, high = values.agg(F.count("*"), F.min("x"), F.max("x")).first()
    if not n:
        return 0.0
    place = q * (n - 1)
    first, below, inside = int(place), 0, n
    second = min(first + 1, n - 1)
    while inside > most and low < high:
        within = values.where(F.col("x").between(low, high))
        cell = F.least(F.floor((F.col("x") - low) / (high - low) * CELLS), F.lit(CELLS - 1))
        cells = within.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("cell").collect()  # at most CELLS rows
        at = below
        for i, c in enumerate(cells):
            if first < at + c["n"]:
                break
            at += c["n"]
        if second >= at + c["n"]:  # the ranks lie in two cells
            return c["high"] + (place - first) * (cells[i + 1]["low"] - c["high"])
        low, high, below, inside = c["low"], c["high"], at, c["n"]
    if low == high:
        return float(low)
    left = [r["x"] for r in values.where(F.col("x").between(low, high)).orderBy("x").collect()]  # at most `most` rows
    a, b = left[first - below], left[second - below]
    return a + (place - first) * (b - a)


def newest(profile: DataFrame, most: int = RING, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest rows: a top-k, so each task sends at most `most` rows."""
    return profile.orderBy(F.desc(time), F.desc(tie)).limit(most)


def summary(profile: DataFrame, latency: str = "value", query: str = "event_type", time: str = "ts", tie: str = "event_id") -> DataFrame:
    """One row: query_count, avg_latency, p95_latency, max_latency, last_query ("-" of nothing)."""
    x = F.col(latency)
    p95 = percentile(profile, latency, 0.95)
    return profile.agg(
        F.count("*").alias("query_count"),
        F.round(F.coalesce(F.avg(x), F.lit(0.0)), 6).alias("avg_latency"),
        F.round(F.lit(p95), 6).alias("p95_latency"),
        F.coalesce(F.max(x), F.lit(0.0)).alias("max_latency"),
        F.coalesce(F.max_by(query, F.struct(time, tie)), F.lit("-")).alias("last_query"),
    )


def append(profile: DataFrame, path: str) -> None:
    profile.write.mode("append").parquet(path)
