"""A training corpus from documents: language, near duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of documents. ``run`` writes each stage's result to the shared folder
and reads it again, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bagminhash, language, mixing, packing, secrets
from lodestone.llm.shared import written

#: What takes the place of a secret.
MARK = "<secret>"


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under names that no operator adds, but for text; and each column's name there."""
    names = {c: c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null or empty text, or no letter) go; lang becomes the predicted one.

    The model learns from the labelled rows of the stage's own input. Repeated rows stay as often
    as they come; rows without doc_id stay.
    """
    model = language.train(language.learned_rows(docs))
    numbered, names = _numbered(docs)
    found = language.identify(numbered, model).where(F.col("lang_pred") != language.UNKNOWN)
    return found.select(*(F.col("lang_pred" if c == "lang" else n).alias(c) for c, n in names.items()))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document of the least id stays; rows without doc_id or words all do."""
    return bagminhash.keep_one(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by MARK; n_chars follows. No document goes; a null text stays null."""
    numbered, names = _numbered(docs)
    found = secrets.find_secrets(numbered, mark=MARK)
    new = {"text": F.col("redacted")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.size("secret_spans") > 0, F.length("redacted")).otherwise(F.col(names["n_chars"])).cast(docs.schema["n_chars"].dataType)
    return found.select(*(new.get(c, F.col(n)).alias(c) for c, n in names.items()))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rate says, for the target weights of the domains; rows without doc_id stay once."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mixing.apply_rates(docs, mixing.mix(docs, labels))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences, with their token ids; a null text is the end id alone."""
    return packing.pack_documents(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("near_dedup", dedup_stage),
    ("secret_scan", secrets_stage),
    ("domain_mixing", mixing_stage),
    ("packing", packing_stage),
]

#: BagMinHash, the classifiers and the projected gradient can't be put in SQL: tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
