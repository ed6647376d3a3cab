"""The corpus: one row per product, with normalised texts and tokens."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import normalize, split_norm, tokens

TOKENS = {"title_tok": "product_title_norm", "desc_tok": "product_description_norm", "attr_tok": "all_attributes_norm", "brand_tok": "brand_norm"}
REQUIRED = ("product_uid", "product_title", "product_description")


def first_rows(df: DataFrame, key: str, pos: str, *cols: str) -> DataFrame:
    """The first row of each key by pos: partial aggregation, no window."""
    first = df.groupBy(key).agg(F.min_by(F.struct(*cols), F.col(pos)).alias("__first"))
    return first.select(key, *(F.col(f"__first.{c}").alias(c) for c in cols))


def attribute_text(attributes: DataFrame) -> DataFrame:
    """product_uid, all_attributes: values in order of pos; a missing value reads `nan`, rows without product vanish."""
    rows = attributes.where("product_uid is not null")
    item = F.struct("pos", F.coalesce("value", F.lit("nan")).alias("v"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]), " ")
    return rows.groupBy("product_uid").agg(listed.alias("all_attributes"))


def is_brand(name: Column, any_case: bool = True) -> Column:
    return F.lower(name) == "mfg brand name" if any_case else name == "MFG Brand Name"


def brands(attributes: DataFrame, any_case: bool = True) -> DataFrame:
    """product_uid, brand: the first brand attribute. In the corpus names are compared in any case and a missing value reads `nan`."""
    rows = attributes.where(is_brand(F.col("name"), any_case) & F.col("product_uid").isNotNull())
    value = F.coalesce("value", F.lit("nan")) if any_case else F.col("value")
    return first_rows(rows.select("product_uid", "pos", value.alias("brand")), "product_uid", "pos", "brand")


def validate(corpus: DataFrame) -> DataFrame:
    """The same frame; TypeError for no frame, ValueError naming missing columns."""
    if not isinstance(corpus, DataFrame):
        raise TypeError("a Spark DataFrame is expected")
    missing = sorted(set(REQUIRED) - set(corpus.columns))
    if missing:
        raise ValueError(f"the corpus lacks the columns {missing}")
    return corpus


def build_corpus(descriptions: DataFrame, titles: DataFrame, attributes: DataFrame) -> DataFrame:
    """Products that have both a description and a title; brand and attributes where known.

    The join keys are one and the same, so all four inputs share a partitioning by product.
    """
    title = first_rows(titles, "product_uid", "pos", "product_title")
    joined = descriptions.select("product_uid", "product_description").join(title, "product_uid")
    joined = joined.join(brands(attributes), "product_uid", "left").join(attribute_text(attributes), "product_uid", "left")
    norms = {f"{c}_norm": normalize(c) for c in ("product_title", "product_description", "all_attributes", "brand")}
    return validate(joined.withColumns(norms))


class Pipeline(ABC):
    """What turns source tables into a corpus."""

    @abstractmethod
    def load(self) -> dict[str, DataFrame]: ...

    @abstractmethod
    def prepare(self, data: dict[str, DataFrame]) -> DataFrame: ...

    @abstractmethod
    def validate(self, data: DataFrame) -> DataFrame: ...


class CorpusPipeline(Pipeline):
    """The corpus from whatever a loader returns: descriptions, titles (or train) and attributes."""

    def __init__(self, loader: Callable[[], dict[str, DataFrame]]) -> None:
        self.loader = loader

    def load(self) -> dict[str, DataFrame]:
        return self.loader()

    def prepare(self, data: dict[str, DataFrame]) -> DataFrame:
        return with_tokens(build_corpus(data["descriptions"], data["titles"] if "titles" in data else data["train"], data["attributes"]))

    def validate(self, data: DataFrame) -> DataFrame:
        return validate(data)


def with_tokens(corpus: DataFrame) -> DataFrame:
    """The corpus with its token arrays."""
    return corpus.withColumns({t: tokens(c) for t, c in TOKENS.items()})


def with_split_tokens(corpus: DataFrame) -> DataFrame:
    """The same of a corpus as ``build_corpus`` makes it, whose normalised texts need only be split."""
    return corpus.withColumns({t: split_norm(c) for t, c in TOKENS.items()})


def title_frequency(rows: DataFrame, most: int = 0) -> DataFrame:
    """product_uid, product_title (the first), product_freq, most frequent first, ties by product."""
    counted = rows.groupBy("product_uid").agg(F.min_by("product_title", "pos").alias("product_title"), F.count("*").alias("product_freq"))
    out = counted.where("product_uid is not null").orderBy(F.desc("product_freq"), "product_uid")
    return out.limit(most) if most > 0 else out
