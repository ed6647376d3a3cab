"""The product-image catalogue and its state table, as DataFrame transformations."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.corpus import brands, title_frequency

STATE = ("product_uid", "title", "brand", "image_url", "source", "local_path", "status", "error", "updated_at")


def image_catalogue(titles: DataFrame, attributes: DataFrame, most: int = 0) -> DataFrame:
    """product_uid, product_title, brand of the most frequent products; here brand names are compared as written, missing texts read ""."""
    top = title_frequency(titles, most)
    joined = top.join(brands(attributes, any_case=False), "product_uid", "left")
    return joined.select("product_uid", F.coalesce("product_title", F.lit("")).alias("product_title"), F.coalesce("brand", F.lit("")).alias("brand"))


def is_pending(retry_failed: bool = False) -> Column:
    """Rows still to fetch. A failed row has an empty path, so only the retry form takes it up again."""
    open_ = F.col("status") != "downloaded" if retry_failed else F.col("status").isin("pending", "no_image")
    return open_ | F.col("local_path").isNull()


def pending(state: DataFrame, retry_failed: bool = False, limit: int = 0) -> DataFrame:
    """product_uid, title, brand to fetch, by product."""
    rows = state.where(is_pending(retry_failed)).select("product_uid", "title", "brand").orderBy("product_uid")
    return rows.limit(limit) if limit > 0 else rows


def image_map(state: DataFrame) -> DataFrame:
    """product_uid, local_path of downloaded pictures."""
    return state.where("status = 'downloaded' and local_path is not null and local_path <> ''").select("product_uid", "local_path")


def with_images(results: DataFrame, images: DataFrame) -> DataFrame:
    """results with the local_path of their pictures, null where there is none."""
    return results.join(images.select("product_uid", "local_path"), "product_uid", "left")


def existing_paths(images: DataFrame, folders: list[str]) -> DataFrame:
    """images whose file exists: an absolute path as it is, a relative one below the first of the folders that has it. Files are asked for where Spark's tasks run."""

    @F.pandas_udf("string")
    def found(paths: pd.Series) -> pd.Series:
        def first(path: str) -> str | None:
            tried = [path] if os.path.isabs(path) else [os.path.join(f, path) for f in folders]
            return next((p for p in tried if os.path.exists(p)), None)

        return paths.map(first, na_action="ignore")

    return images.withColumn("local_path", found("local_path")).where("local_path is not null")


def upsert(state: DataFrame, catalogue: DataFrame, now: Column) -> DataFrame:
    """The next version of the state: new products are pending; known ones get title, brand and time, and keep the rest."""
    new = catalogue.select("product_uid", F.col("product_title").alias("new_title"), F.col("brand").alias("new_brand"), F.lit(True).alias("given"))
    j = state.join(new, "product_uid", "full_outer")
    given = F.coalesce("given", F.lit(False))
    return j.select(
        "product_uid",
        F.when(given, F.col("new_title")).otherwise(F.col("title")).alias("title"),
        F.when(given, F.col("new_brand")).otherwise(F.col("brand")).alias("brand"),
        "image_url",
        "source",
        "local_path",
        F.coalesce("status", F.lit("pending")).alias("status"),
        "error",
        F.when(given, now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def update_results(state: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """The next version of the state with the results of fetches; results of unknown products change nothing."""
    cols = ("status", "image_url", "source", "local_path", "error")
    new = results.select("product_uid", *(F.col(c).alias(f"new_{c}") for c in cols), F.lit(True).alias("given"))
    j = state.join(new, "product_uid", "left")
    given = F.coalesce("given", F.lit(False))
    pick = {c: F.when(given, F.col(f"new_{c}")).otherwise(F.col(c)) for c in cols} | {"updated_at": F.when(given, now).otherwise(F.col("updated_at"))}
    return j.select(*((pick[c].alias(c) if c in pick else F.col(c)) for c in STATE))


def status_counts(state: DataFrame) -> DataFrame:
    return state.groupBy("status").agg(F.count("*").alias("n")).orderBy("status")


def outcome(urls_found: Column, fetched: Column, search_error: Column, fetch_error: Column) -> Column:
    """The result of one product's fetch: status and error, the error cut to 300 characters."""
    return (
        F.when(fetched, F.struct(F.lit("downloaded").alias("status"), F.lit("").alias("error")))
        .when(urls_found > 0, F.struct(F.lit("failed").alias("status"), F.left(F.coalesce(fetch_error, F.lit("Image download failed")), F.lit(300)).alias("error")))
        .when(search_error.isNotNull(), F.struct(F.lit("failed").alias("status"), F.left(search_error, F.lit(300)).alias("error")))
        .otherwise(F.struct(F.lit("no_image").alias("status"), F.lit("No image URL found").alias("error")))
    )


def progress(results: DataFrame, total: int, elapsed: float) -> DataFrame:
    """One row: done, downloaded, no_image, failed, rate a second, seconds left (infinite while nothing is done)."""
    got = results.agg(F.count("*").alias("done"), *(F.count_if(F.col("status") == s).alias(s) for s in ("downloaded", "no_image", "failed")))
    rate = F.col("done") / F.lit(max(elapsed, 1e-6))
    return got.withColumn("rate", rate).withColumn("seconds_left", F.when(F.col("rate") > 0, (F.lit(total) - F.col("done")) / F.col("rate")).otherwise(float("inf")))
