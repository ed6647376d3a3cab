"""Spark helpers of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.sources.shared import shared_dir, written

__all__ = ["bounded_ids", "fold", "shared_dir", "with_fields", "written"]


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """df's schema and the fields of a DDL string."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def fold(key: Column, buckets: int) -> Column:
    """crc32 of the key as text, modulo buckets: the split that the contracts fix."""
    return F.crc32(key.cast("string")) % F.lit(buckets)


def bounded_ids(df: DataFrame, limit: int, salt: int) -> DataFrame:
    """The rows of df whose hashed doc_id is among the `limit` smallest: a uniform sample of that size, as ids of df are distinct (callers group by them).

    Two passes: ids only, for the threshold; the caller's other columns are read in the second.
    """
    h = F.xxhash64(F.col("doc_id"), F.lit(salt))
    top = df.select(h.alias("h")).orderBy("h").limit(limit).agg(F.max("h"), F.count("*")).first()
    if top[1] < limit:
        return df
    return df.where(h <= F.lit(top[0]))
