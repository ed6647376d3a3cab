"""Index tables: postings, document lengths, term and field statistics, and the typo model.

All fields share the tables, with a `field` column: word (title and description together), gram
(3-grams of those), title, desc, attr. Build once per corpus version and write them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.grams import GRAMS, distinct, gram_codes, gram_text, slices, text_bytes, words
from lodestone.functions.text import char_ngrams, is_number, typo_grams

#: Constants of the ranking function: fixed values.
K1, B, EPSILON = 1.5, 0.75, 0.25


def field_tokens(corpus: DataFrame, fields: tuple[str, ...] = ("word", "gram", "title", "desc", "attr")) -> DataFrame:
    """product_uid, field, toks; corpus with token arrays."""
    both = F.concat("title_tok", "desc_tok")
    of = {"word": both, "gram": char_ngrams(both), "title": F.col("title_tok"), "desc": F.col("desc_tok"), "attr": F.col("attr_tok")}
    made = F.array(*(F.struct(F.lit(f).alias("field"), of[f].alias("toks")) for f in fields))
    return corpus.select("product_uid", F.explode(made).alias("x")).select("product_uid", "x.field", "x.toks")


@dataclass
class Index:
    postings: DataFrame  # field, product_uid, term, tf, dl
    terms: DataFrame  # field, term, df, idf
    fields: DataFrame  # field, n, avgdl
    _negative: bool | None = None
    corpus: DataFrame | None = None  # normalised texts, where postings are made from them

    def negative(self) -> bool:
        """Whether any idf is below 0: on tiny corpora only, asked once."""
        if self._negative is None:
            self._negative = not self.terms.where("idf < 0").isEmpty()
        return self._negative

    def texts(self, field: str) -> tuple[DataFrame, bool]:
        """One column of the field's normalised texts, and whether its terms are their 3-grams, not their words."""
        if self.corpus is not None and field in ("word", "gram"):
            return self.corpus.select(word_text().alias("text")), field == "gram"
        repeated = F.flatten(F.collect_list(F.array_repeat("term", F.col("tf").cast("int"))))
        return self.postings.where(F.col("field") == field).groupBy("product_uid").agg(F.array_join(repeated, " ").alias("text")).select("text"), False

    def write(self, path: str) -> None:
        """Postings lie by field and hashed term, so a probe reads the files of its field."""
        for name in ("postings", "terms", "fields"):
            df = getattr(self, name)
            (df.repartition("field", "term") if name != "fields" else df).write.mode("overwrite").partitionBy("field").parquet(f"{path}/{name}")

    @staticmethod
    def read(spark, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{n}") for n in ("postings", "terms", "fields")))


def field_stats(toks: DataFrame) -> DataFrame:
    """field, n, avgdl; empty documents count."""
    return toks.groupBy("field").agg(F.count("*").alias("n"), F.avg(F.size("toks")).alias("avgdl"))


def term_stats(postings: DataFrame, fields: DataFrame) -> DataFrame:
    """field, term, df, idf. A negative idf becomes EPSILON times the mean idf of the field's vocabulary."""
    return weighed(postings.groupBy("field", "term").agg(F.count("*").alias("df")), fields)


def weighed(df: DataFrame, fields: DataFrame) -> DataFrame:
    """field, term, df with idf."""
    raw = df.join(F.broadcast(fields), "field").withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.groupBy("field").agg(F.avg("raw").alias("mean"))  # one row a field: five at most
    floor = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return raw.join(F.broadcast(mean), "field").select("field", "term", "df", floor.alias("idf"))


def word_text() -> Column:
    """The normalised text of the fields word and gram: title and description."""
    return F.trim(F.concat_ws(" ", "product_title_norm", "product_description_norm"))


TEXTS = {"title": "product_title_norm", "desc": "product_description_norm", "attr": "all_attributes_norm"}


def _texts(fields: tuple[str, ...]) -> list[Column]:
    return [(word_text() if f in ("word", "gram") else F.col(TEXTS[f])).alias(f) for f in fields]


def text_counts(corpus: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """What ``term_counts`` makes, from normalised texts, in slices of many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for field, column in zip(fields, batch.columns[1:], strict=True):
                at = 0
                for part in slices(column):
                    ids, at = batch.column(0).slice(at, len(part)), at + len(part)
                    if field == "gram":
                        doc, code = gram_codes(*text_bytes(part))
                        found = distinct(code)
                        code, terms = np.searchsorted(found, code), pa.array(gram_text(found), pa.string())
                    else:
                        got, doc = words(part)
                        real = pc.not_equal(got, "")
                        coded = got.filter(real).dictionary_encode()
                        code, terms, doc = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, doc[real.to_numpy(zero_copy_only=False)]
                    key = np.sort(doc * len(terms) + code)
                    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
                    tf, (doc_, term) = np.diff(np.append(first, len(key))), np.divmod(key[first], max(len(terms), 1))
                    dl = np.bincount(doc, minlength=len(part))[doc_]
                    yield pa.RecordBatch.from_arrays([pa.array([field] * len(tf), pa.string()), ids.take(pa.array(doc_)), terms.take(pa.array(term)), pa.array(tf), pa.array(dl.astype(np.int32))], names=["field", "product_uid", "term", "tf", "dl"])

    kind = corpus.schema["product_uid"].dataType.simpleString()
    return corpus.select("product_uid", *_texts(fields)).mapInArrow(run, f"field string, product_uid {kind}, term string, tf long, dl int")


def document_counts(corpus: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """field, term, df, tf of a corpus with normalised texts: counted in slices where texts are read, so that no posting is written. A field's length is the sum of its tf."""
    def rows(field: str, terms, df: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([field] * len(df), pa.string()), terms, pa.array(df, pa.int64()), pa.array(tf, pa.int64())], names=["field", "term", "df", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_df, gram_tf = np.zeros(GRAMS, np.int64), np.zeros(GRAMS, np.int64)
        for batch in batches:
            for field, column in zip(fields, batch.columns, strict=True):
                if field == "gram":
                    for part in slices(column):
                        doc, code = gram_codes(*text_bytes(part))
                        gram_tf += np.bincount(code, minlength=GRAMS)
                        gram_df += np.bincount(distinct(doc * GRAMS + code) % GRAMS, minlength=GRAMS)
                    continue
                for part in slices(column, 4096, 8 << 20):
                    got, doc = words(part)
                    coded = got.dictionary_encode()
                    code, terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
                    tf = np.bincount(code, minlength=len(terms))
                    df = np.bincount(distinct(doc * len(terms) + code) % max(len(terms), 1), minlength=len(terms))
                    real = np.flatnonzero(pc.not_equal(terms, "").to_numpy(zero_copy_only=False))
                    yield rows(field, terms.take(pa.array(real)), df[real], tf[real])
        at = np.flatnonzero(gram_df)
        yield rows("gram", pa.array(gram_text(at), pa.string()), gram_df[at], gram_tf[at])

    return corpus.select(*_texts(fields)).mapInArrow(run, "field string, term string, df long, tf long").groupBy("field", "term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def text_index(corpus: DataFrame, fields: tuple[str, ...], keep) -> Index:
    """The index of a corpus with normalised texts, of which only term statistics are kept, by keep(df, name).

    Its postings are made when they are read: retrieval reads texts, and features read the
    postings of candidates alone.
    """
    counts = keep(document_counts(corpus, fields), "counts")
    n = corpus.count()
    length = {r.field: r.tf for r in counts.groupBy("field").agg(F.sum("tf").alias("tf")).collect()}
    rows = [(f, n, length.get(f, 0) / n) for f in fields if n]
    stats = corpus.sparkSession.createDataFrame(rows, "field string, n long, avgdl double")
    return Index(text_counts(corpus, fields), keep(weighed(counts.drop("tf"), stats), "terms"), stats, corpus=corpus)


def term_counts(toks: DataFrame) -> DataFrame:
    """field, product_uid, term, tf, dl from field_tokens(): counted within the row, by runs of the sorted array, so nothing is shuffled."""
    ordered = toks.select("field", "product_uid", F.array_sort("toks").alias("t"))
    first = F.filter(F.transform("t", lambda x, i: F.when((i == 0) | (x != F.get("t", i - 1)), i)), lambda i: i.isNotNull())
    runs = ordered.withColumn("first", first)
    counted = F.transform("first", lambda i, k: F.struct(F.get("t", i).alias("term"), (F.coalesce(F.get("first", k + 1), F.size("t")) - i).cast("long").alias("tf")))
    return runs.select("field", "product_uid", F.size("t").alias("dl"), F.explode(counted).alias("x")).select("field", "product_uid", "x.term", "x.tf", "dl")


def build_index(corpus: DataFrame, fields: tuple[str, ...] = ("word", "gram", "title", "desc", "attr")) -> Index:
    """Index of a corpus with tokens. Only term statistics are shuffled, a row for each distinct term of a task."""
    toks = field_tokens(corpus, fields)
    stats = field_stats(toks)
    postings = term_counts(toks)
    return Index(postings, term_stats(postings, stats), stats)


# ---------------------------------------------------------------- typo model

MIN_FREQ, MIN_LENGTH = 3, 3


@dataclass
class TypoModel:
    frequency: DataFrame  # token, freq
    bigrams: DataFrame  # prev, token, freq
    vocabulary: DataFrame  # token, freq
    grams: DataFrame  # gram, token


def token_frequency(toks: DataFrame, column: str = "toks") -> DataFrame:
    return toks.select(F.explode(column).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))


def bigram_frequency(toks: DataFrame, column: str = "toks") -> DataFrame:
    pairs = F.transform(F.slice(column, 2, F.greatest(F.size(column) - 1, F.lit(0))), lambda t, i: F.struct(F.get(column, i).alias("prev"), t.alias("token")))
    return toks.select(F.explode(pairs).alias("p")).groupBy("p.prev", "p.token").agg(F.count("*").alias("freq"))


def vocabulary(frequency: DataFrame, min_freq: int = MIN_FREQ) -> DataFrame:
    return frequency.where((F.length("token") >= MIN_LENGTH) & (F.col("freq") >= min_freq) & ~is_number(F.col("token")))


def gram_index(vocab: DataFrame) -> DataFrame:
    return vocab.select(F.explode(typo_grams("token")).alias("gram"), "token")


def build_typo_model(titles: DataFrame, column: str = "toks", min_freq: int = MIN_FREQ) -> TypoModel:
    """From title tokens; context pairs from the same."""
    freq = token_frequency(titles, column)
    vocab = vocabulary(freq, min_freq)
    return TypoModel(freq, bigram_frequency(titles, column), vocab, gram_index(vocab))
