"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    y(x) = w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

so all pairwise interactions cost as much as the non-zero features. It is fitted with AdaGrad
on log-loss, on the driver, from a bounded uniform sample of labelled rows (``TRAIN_ROWS`` of
``TRAIN_BYTES`` of text in all); scoring is a map over whole texts and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.blocks import LOWER, hash_words, ragged, sub_blocks, sum_by, text_bytes, word_spans
from lodestone.llm.shared import bounded_ids, fold, with_fields

TRAIN_ROWS, TRAIN_BYTES = 8000, 64 << 20
WORD_BITS = 15
WORDS = 1 << WORD_BITS
FACTORS = 8
EPOCHS = 8
RATE = 0.05
PENALTY = 1e-5
THRESHOLD = 0.3

#: Structure statistics, each cut into BINS ranges by its quantiles in the sample.
STATS = ("log_words", "word_length", "upper", "digit", "symbol", "mark", "lines", "line_words", "repeat_lines", "distinct", "wide", "short_words", "log_chars", "chars_gap")
BINS = 16
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>{}[]\\/_=+~^@"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,;:!?'\"()-"]] = True


def features(data: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket, value) of the distinct words of each document, and its statistics (n, len(STATS)).

    n_chars is the table's own length column, NaN where missing: metadata that may contradict the text.
    """
    n = len(offsets) - 1
    start, end, doc = word_spans(data, offsets)
    bucket = (hash_words(LOWER[data], start, end) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    key, count = np.unique(doc * WORDS + bucket, return_counts=True)
    d, b = np.divmod(key, WORDS)
    value = np.log1p(count)
    norm = np.sqrt(sum_by(value * value, d, n))
    words, distinct = np.bincount(doc, minlength=n).astype(float), np.bincount(d, minlength=n).astype(float)
    at = lambda mask: np.diff(np.concatenate(([0], np.cumsum(mask)))[offsets])
    size = np.maximum(np.diff(offsets), 1).astype(float)
    chars = at((data & 0xC0) != 0x80).astype(float)
    lines, repeated = _lines(data, offsets)
    per = np.maximum(words, 1)
    stats = np.stack([
        np.log1p(words), sum_by(end - start, doc, n) / per, at((data >= 65) & (data <= 90)) / size, at((data >= 48) & (data <= 57)) / size, at(_SYMBOL[data]) / size, at(_MARK[data]) / size, np.log1p(lines), words / np.maximum(lines, 1),
        repeated / np.maximum(lines, 1), distinct / per, at(data >= 128) / size, sum_by(end - start <= 3, doc, n) / per, np.log1p(chars), np.where(np.isnan(n_chars), -1.0, np.log1p(np.abs(chars - np.nan_to_num(n_chars)))),
    ], axis=1)
    return d, b, value / norm[d] if len(d) else value, stats


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines that are not empty, and those of them that repeat an earlier one, for each document."""
    n = len(offsets) - 1
    full = data != 10
    first, last = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
    first[offsets] = last[offsets] = True
    if len(data):
        first[1:][~full] = True
        last[:-1][~full] = True
    start = np.flatnonzero(full & first[:-1])
    end = np.flatnonzero(full & last[1:]) + 1
    if not len(data):
        start = end = np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, start, "right") - 1
    pair = np.stack([doc.astype(np.uint64), hash_words(data, start, end)], axis=1)
    order = np.lexsort((pair[:, 1], pair[:, 0]))
    p = pair[order]
    same = np.concatenate(([False], (p[1:] == p[:-1]).all(axis=1))) if len(p) else np.zeros(0, bool)
    return np.bincount(doc, minlength=n).astype(float), np.bincount(doc[order][same], minlength=n).astype(float)


@dataclass
class FactorisationMachine:
    edges: np.ndarray  # (stats, BINS - 1)
    bias: float
    linear: np.ndarray
    factors: np.ndarray  # (features, FACTORS)

    def rows(self, d, b, value, stats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All features in document order: (document, feature, value)."""
        n, s = stats.shape
        bins = np.stack([np.searchsorted(self.edges[j], stats[:, j], "right") for j in range(s)], axis=1) + WORDS + BINS * np.arange(s)
        doc = np.concatenate((d, np.repeat(np.arange(n), s)))
        order = np.argsort(doc, kind="stable")
        return doc[order], np.concatenate((b, bins.ravel()))[order], np.concatenate((value, np.full(n * s, 0.5)))[order].astype(np.float32)

    def raw(self, doc: np.ndarray, feature: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(y of each document, its factor sums). Every document has features: its bins."""
        first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        vx = self.factors[feature] * x[:, None]
        sums = np.add.reduceat(vx, first)
        squares = np.add.reduceat((vx * vx).sum(axis=1), first)
        y = self.bias + np.add.reduceat(self.linear[feature] * x, first) + 0.5 * ((sums * sums).sum(axis=1) - squares)
        return y, sums

    def score(self, d, b, value, stats) -> np.ndarray:
        if not len(stats):
            return np.zeros(0)
        y, _ = self.raw(*self.rows(d, b, value, stats))
        return 1 / (1 + np.exp(-np.clip(y.astype(float), -30, 30)))


def fit(parts: list[tuple], labels: np.ndarray, seed: int = 7) -> FactorisationMachine:
    """parts: one features() tuple per labelled document. Without labels every score is one half."""
    size = WORDS + BINS * len(STATS)
    rng = np.random.Generator(np.random.PCG64(seed))
    fm = FactorisationMachine(np.zeros((len(STATS), BINS - 1)), 0.0, np.zeros(size, np.float32), (0.01 * rng.standard_normal((size, FACTORS))).astype(np.float32))
    if not len(labels):
        fm.factors[:] = 0
        return fm
    stats = np.concatenate([p[3] for p in parts])
    fm.edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T.copy()
    rate = labels.mean().clip(1e-3, 1 - 1e-3)
    fm.bias = float(np.log(rate / (1 - rate)))
    doc, feature, x = fm.rows(np.repeat(np.arange(len(parts)), [len(p[1]) for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), stats)
    begin = np.searchsorted(doc, np.arange(len(parts) + 1))
    seen = np.bincount(feature, minlength=size)
    fm.factors[seen < 3] = 0  # words of one or two documents say nothing of others
    usable = seen >= 3
    g_lin, g_fac, g_bias = np.full(size, 1e-6, np.float32), np.full((size, FACTORS), 1e-6, np.float32), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(parts))
        for at in range(0, len(order), 64):
            batch = order[at : at + 64]
            count = begin[batch + 1] - begin[batch]
            take = ragged(begin[batch], count)
            own = np.repeat(np.arange(len(batch)), count)
            f, v = feature[take], x[take]
            y, sums = fm.raw(own, f, v)
            slope = ((1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[batch]) / len(batch)).astype(np.float32)
            each = slope[own] * v * usable[f]
            distinct, code = np.unique(f, return_inverse=True)
            order_f = np.argsort(code, kind="stable")
            cut = np.searchsorted(code[order_f], np.arange(len(distinct)))
            gl = np.add.reduceat(each[order_f], cut) + PENALTY * fm.linear[distinct]
            gf = np.add.reduceat((each[:, None] * (sums[own] - fm.factors[f] * v[:, None]))[order_f], cut) + PENALTY * fm.factors[distinct]
            g_lin[distinct] += gl * gl
            g_fac[distinct] += gf * gf
            fm.linear[distinct] -= RATE * gl / np.sqrt(g_lin[distinct])
            fm.factors[distinct] -= RATE * gf / np.sqrt(g_fac[distinct])
            gb = float(slope.sum())
            g_bias += gb * gb
            fm.bias -= RATE * gb / g_bias**0.5
    return fm


def _texts(docs: DataFrame, *more) -> DataFrame:
    chars = F.col("n_chars").cast("double") if "n_chars" in docs.columns else F.lit(None).cast("double")
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), chars.alias("n_chars"), *more)


def _known_chars(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("n_chars").to_numpy(zero_copy_only=False).astype(float)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        chars, label = _known_chars(batch), batch.column("label").to_numpy(zero_copy_only=False)
        for at, to, d, o in sub_blocks(data, offsets):
            doc, bucket, value, stats = features(d, o, chars[at:to])
            cut = np.searchsorted(doc, np.arange(to - at + 1))
            rows = [(bucket[cut[i] : cut[i + 1]].astype(np.int32).tobytes(), value[cut[i] : cut[i + 1]].astype(np.float32).tobytes(), stats[i].tobytes()) for i in range(to - at)]
            cols = [pa.array([r[j] for r in rows], pa.binary()) for j in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(label[at:to].astype(float))], names=["bucket", "value", "stats", "label"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS, size: int = TRAIN_BYTES) -> FactorisationMachine:
    """labels: doc_id and a 0/1 column; a document with several labels takes the majority, 1 on a tie.

    At most `rows` labelled documents of at most `size` bytes in all, and one more (drawn by hashed
    id, whole texts), reach the driver as features; of rows that repeat an id one is used.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label"))
    sample = F.broadcast(bounded_ids(known, rows, 4).select(F.col("doc_id").alias("label_id"), "label"))  # at most `rows` rows
    order = F.xxhash64("doc_id", F.lit(5))
    joined = _texts(docs).join(sample, F.col("doc_id") == F.col("label_id")).dropDuplicates(["doc_id"]).select(order.alias("order"), "text", "n_chars", "label")
    sizes = sorted(joined.select("order", F.coalesce(F.octet_length("text"), F.lit(0))).collect())  # at most `rows` rows
    within = np.cumsum([r[1] for r in sizes]) <= size
    if not within.all():
        joined = joined.where(F.col("order") <= sizes[int(within.argmin())][0])
    got = joined.mapInArrow(_sample_features, "bucket binary, value binary, stats binary, label double").toArrow()
    parts = [(None, np.frombuffer(b, np.int32).astype(np.int64), np.frombuffer(v, np.float32), np.frombuffer(s).reshape(1, -1)) for b, v, s in zip(*(got.column(c).to_pylist() for c in ("bucket", "value", "stats")), strict=True)]
    y = got.column("label").to_numpy()
    order = sorted(range(len(parts)), key=lambda i: (parts[i][3].tobytes(), parts[i][1].tobytes(), y[i]))  # the same model however rows arrive
    return fit([parts[i] for i in order], y[order])


def score(docs: DataFrame, model: FactorisationMachine) -> DataFrame:
    """doc_id, score of every row of docs: doc_id, text and, if there is one, n_chars.

    Null and empty texts are scored by their statistics like any other, very long ones whole.
    Repeated rows get the same score each, an empty table gives no rows. Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            chars = _known_chars(batch)
            found = [held.value.score(*features(d, o, chars[at:to])) for at, to, d, o in sub_blocks(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())], names=["doc_id", "score"])

    src = _texts(docs)
    return src.mapInArrow(run, with_fields(src.select("doc_id"), "score double"))


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """A quality score of every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold(F.col("doc_id"), 5) != 0)
    out = score(docs, train(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
