"""Language-model scoring by deleted interpolation.

    P(w | v) = l2(b) c(v,w)/c(v) + l1(b) c(w)/N + l0(b) 1/(V+1)

Maximum-likelihood estimates of word bigrams, words and the uniform distribution, mixed by
weights that depend on the bucket b of the context's frequency. The weights maximise the
likelihood of held-out counts by expectation-maximisation: each training token is held out
of the counts it is predicted from ("deleted"), so all training text serves both ends.

Counting is distributed and exact. Rows are cut into blocks as they lie in the input, so rows
without or with a repeated id are like others. A block sends each distinct n-gram
once, as a 64-bit hash with its count, to the owner of the hash's range (partial aggregation: a
very common pair costs one entry a block); owners add up and send each block the totals of its
own n-grams, which it looks up for every token. So no row per token is ever shuffled, joined or
collected, and no task sees more than a block or a range.

A block's message to a range is a row, and as ranges grow in number with the blocks, messages
would with their square. So beyond MOST_BLOCKS blocks there are two levels: groups of blocks
first add up among themselves over few wide ranges, then groups stand for blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.blocks import LOWER, hash_words, mix, sub_blocks, sum_by, text_bytes, trim, word_spans
from lodestone.llm.shared import fold, written

#: Bytes of text in a block at most, as far as documents allow, and at least, as far as a task's input does.
BLOCK_TEXT, LEAST_TEXT = 16 << 20, 1 << 20
#: Blocks that send their counts to the owners themselves; of more, groups of about the root of their number do.
MOST_BLOCKS = 4096
BUCKETS = 24  # of context frequency, by powers of two
CELLS = 96  # of each probability's logarithm, for the held-out counts
LOW2, LOW1 = -9.0, -15.0
ROUNDS = 60
SLICE_TOKENS = 1 << 19
_END = np.uint64(0x5851F42D4C957F2D)
_K = np.uint64(0x9E3779B97F4A7C15)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, bigram hash, document) of every token of texts as bytes and offsets; each document ends with the end token, which is also the context of its first word."""
    words, docs = [], []
    for at, to, d, o in sub_blocks(data, offsets):
        start, end, doc = word_spans(d, o)
        count = np.bincount(doc, minlength=to - at)
        out = np.full(len(start) + to - at, _END, np.uint64)
        place = np.arange(len(start)) + doc
        out[place] = hash_words(LOWER[d], start, end)
        words.append(out)
        docs.append(np.repeat(np.arange(at, to, dtype=np.int32), count + 1))
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    w, d = np.concatenate(words), np.concatenate(docs)
    before = np.concatenate(([_END], w[:-1]))  # the token before a document's first is the end of another
    return w, mix(before * _K + (w ^ (w >> np.uint64(29)))), d


_ZSTD = pa.Codec("zstd", 1)


def _small(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _large(small: bytes) -> bytes:
    size = int.from_bytes(small[:8], "little")
    return _ZSTD.decompress(small[8:], decompressed_size=size, asbytes=True) if size else b""


PIECE = "block long, ids array<bigint>, learn array<boolean>, sizes array<bigint>, texts binary"


def _pieces(limit: int):
    """Rows in blocks of at most `limit` bytes of text (or one document), in pieces whose texts are compressed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, filled = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for at, to, d, o in sub_blocks(data, offsets):
                if filled and filled + len(d) > limit:
                    block, filled = block + 1, 0
                filled += len(d)
                part, one = batch.slice(at, to - at), pa.array([0, to - at], pa.int32())
                lists = [pa.ListArray.from_arrays(one, x) for x in (part.column("doc_id"), part.column("learn"), pa.array(np.diff(o)))]
                yield pa.RecordBatch.from_arrays([pa.array([block]), *lists, pa.array([_small(d.tobytes())], pa.binary())], names=["block", "ids", "learn", "sizes", "texts"])

    return run


def _opened_texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(bytes, offsets, ids, learn) of a block's pieces."""
    flat = lambda c: pa.concat_arrays([x.flatten() for x in table.column(c).chunks])
    sizes = flat("sizes").to_numpy()
    data = b"".join(map(_large, table.column("texts").to_pylist()))
    return np.frombuffer(data, np.uint8), np.concatenate(([0], np.cumsum(sizes))), flat("ids"), flat("learn").to_numpy(zero_copy_only=False)


def planes(x: np.ndarray) -> bytes:
    """Integers byte by byte of each rank: columns of zeros that compress to nothing."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _sorted(w: np.ndarray, g: np.ndarray) -> np.ndarray:
    """All hashes of both, sorted in place of their copy."""
    both = np.concatenate((w, g))
    both.sort()
    return both


def _firsts(x: np.ndarray) -> np.ndarray:
    """Where each distinct value of sorted x begins."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


def _distinct(w: np.ndarray, g: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All distinct n-grams of a block, sorted, and their counts in its training documents."""
    every = _sorted(w, g)
    every = every[_firsts(every)]
    x = _sorted(w[learn], g[learn])
    first = _firsts(x)
    count = np.zeros(len(every), np.int64)
    count[np.searchsorted(every, x[first])] = np.diff(np.append(first, len(x)))
    return every, count


def _range_cuts(h: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the equal ranges of hashes begins in sorted h."""
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)
    return np.concatenate(([0], np.searchsorted(h, edges), [len(h)]))


MESSAGE = "rng int, block long, hashes binary, counts binary"


def _messages(h: np.ndarray, c: np.ndarray, block: int, ranges: int, wide: int = 1, of: int = 0) -> pa.Table:
    """Sorted hashes and their counts as rows of MESSAGE, one for each of the equal ranges that holds any; those of the of-th of `wide` equal ranges, if these are all."""
    cut = _range_cuts(h, ranges)
    full = [i for i in range(of * ranges // wide, ranges if wide == 1 else -(-(of + 1) * ranges // wide)) if cut[i] < cut[i + 1]]
    hashes = [planes(np.diff(h[cut[i] : cut[i + 1]], prepend=np.uint64(0))) for i in full]
    counts = [planes(c[cut[i] : cut[i + 1]]) for i in full]
    return pa.table([pa.array(full, pa.int32()), pa.array([block] * len(full), pa.int64()), pa.array(hashes, pa.binary()), pa.array(counts, pa.binary())], names=["rng", "block", "hashes", "counts"])


def _counter(ranges: int):
    def count(table: pa.Table) -> pa.Table:
        data, offsets, _, learn = _opened_texts(table)
        w, g, doc = tokens(data, offsets)
        h, c = _distinct(w, g, learn[doc])
        out = _messages(h, c, table.column("block")[0].as_py(), ranges)
        trim()
        return out

    return count


def _opened(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Of the messages to one range: each one's hashes; all distinct hashes; each one's place among these, one message after another; the sum of its counts."""
    hashes = [np.cumsum(unplanes(x), dtype=np.uint64) for x in table.column("hashes").to_pylist()]
    distinct, code = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(code, weights=np.concatenate([unplanes(x) for x in table.column("counts").to_pylist()]), minlength=len(distinct)).astype(np.int64)
    return hashes, distinct, code, total


def _replies(table: pa.Table, hashes: list[np.ndarray], totals: np.ndarray) -> pa.Table:
    parts = np.split(totals, np.cumsum([len(x) for x in hashes])[:-1])
    return pa.table([table.column("block"), table.column("rng"), pa.array([planes(x) for x in parts], pa.binary())], names=["block", "rng", "totals"])


REPLY = "block long, rng int, totals binary"


def _add_up(table: pa.Table) -> pa.Table:
    """Totals of a range's n-grams, for each block in the order that it sent them."""
    hashes, _, code, total = _opened(table)
    return _replies(table, hashes, total[code])


def _gather(ranges: int, wide: int):
    """The messages of a group's blocks to one wide range as the group's own to the narrower ones within."""

    def gather(table: pa.Table) -> pa.Table:
        _, distinct, _, total = _opened(table)
        return _messages(distinct, total, table.column("team")[0].as_py(), ranges, wide, table.column("rng")[0].as_py())

    return gather


def _pass_on(sent: pa.Table, got: pa.Table) -> pa.Table:
    """The totals that a group was sent, for its blocks."""
    if not sent.num_rows:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.binary())], names=["block", "rng", "totals"])
    hashes, _, code, _ = _opened(sent)
    order = np.argsort(got.column("rng").to_numpy())
    replies = got.column("totals").to_pylist()
    total = np.concatenate([unplanes(replies[i]) for i in order.tolist()])
    return _replies(sent, hashes, total[code])


def totals_of(src: DataFrame, blocks: int, ranges: int, most: int = MOST_BLOCKS) -> DataFrame:
    """REPLY for each block of src (PIECE): totals of its n-grams by range, in order of their hashes."""
    if blocks <= most:
        return src.groupBy("block").applyInArrow(_counter(ranges), MESSAGE).groupBy("rng").applyInArrow(_add_up, REPLY)
    # wide ranges are whole numbers of narrow ones
    teams = wide = math.isqrt(blocks)
    ranges = -(-ranges // wide) * wide
    sent = src.groupBy("block").applyInArrow(_counter(wide), MESSAGE).withColumn("team", F.pmod(F.xxhash64("block", F.lit(5)), F.lit(teams)))
    up = sent.groupBy("team", "rng").applyInArrow(_gather(ranges, wide), MESSAGE)
    down = up.groupBy("rng").applyInArrow(_add_up, REPLY)
    back = down.select(F.col("block").alias("team"), F.floor(F.col("rng") / (ranges // wide)).cast("int").alias("wide"), "rng", "totals")
    return sent.groupBy("team", "rng").cogroup(back.groupBy("team", "wide")).applyInArrow(_pass_on, REPLY)


def _squeeze(x: np.ndarray) -> bytes:
    return _small(planes(x))


def _unsqueeze(raw: bytes) -> np.ndarray:
    return unplanes(_large(raw)).astype(np.int64)


EVENTS = "doc_id long, learn boolean, n_tokens long, n_known long, share double, words binary, pairs binary"


def _look_up(docs: pa.Table, totals: pa.Table) -> pa.Table:
    """For each document the total of every token's word and pair."""
    names = ["doc_id", "learn", "n_tokens", "n_known", "share", "words", "pairs"]
    if not docs.num_rows:
        return pa.table([pa.array([], t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary())], names=names)
    data, offsets, ids, learn = _opened_texts(docs)
    n = len(ids)
    w, g, doc = tokens(data, offsets)
    del data
    h = _sorted(w, g)
    h = h[_firsts(h)]
    order = np.argsort(totals.column("rng").to_numpy())
    sent = totals.column("totals").to_pylist()
    total = np.concatenate([unplanes(sent[i]) for i in order.tolist()]).astype(np.int64)
    del sent
    of_word, of_pair = total[np.searchsorted(h, w)], total[np.searchsorted(h, g)]
    del w, g, h, total
    size = np.bincount(doc, minlength=n)
    known = np.bincount(doc, weights=of_word > 0, minlength=n).astype(np.int64)
    share = sum_by(learn[doc] / np.maximum(of_word, 1), doc, n)  # over all training text these add up to the vocabulary
    cut = np.concatenate(([0], np.cumsum(size)))
    pick = lambda x: pa.array([_squeeze(x[cut[i] : cut[i + 1]]) for i in range(n)], pa.binary())
    out = pa.table([ids, pa.array(learn), pa.array(size), pa.array(known), pa.array(share), pick(of_word), pick(of_pair)], names=names)
    trim()
    return out


def count_events(docs: DataFrame, learn, most: int = MOST_BLOCKS) -> DataFrame:
    """EVENTS of every document, written to the shared folder. learn: which rows the counts come from.

    docs comes from files or a written table, whose rows come in one order whenever they are read.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    limit = max(LEAST_TEXT, min(BLOCK_TEXT, size // (2 * parts)))
    blocks = max(2 * parts, -(-size // limit))  # about
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    src = src.mapInArrow(_pieces(limit), PIECE)
    totals = totals_of(src, blocks, max(parts, blocks // 2), most)
    events = src.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(_look_up, EVENTS)
    return written(events, "events")


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, then by powers of two."""
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)


def _estimates(pair: np.ndarray, word: np.ndarray, context: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.where(context > 0, pair / np.maximum(context, 1), 0.0), word / max(n, 1)


def _cell(p: np.ndarray, low: float) -> np.ndarray:
    """0 for no probability, else 1 to CELLS by its logarithm."""
    with np.errstate(divide="ignore"):
        x = np.log10(p)
    return np.where(p > 0, 1 + np.clip((x - low) / -low * CELLS, 0, CELLS - 1).astype(np.int64), 0)


def _value(cell: np.ndarray, low: float) -> np.ndarray:
    return np.where(cell > 0, 10 ** (low - low * (cell - 0.5) / CELLS), 0.0)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most SLICE_TOKENS tokens, or of one row."""
    total, at = np.cumsum(batch.column("n_tokens").to_numpy()), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_TOKENS, "right")))
        yield batch.slice(at, to - at)
        at = to


def _flat(batch: pa.RecordBatch, n_end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word total, pair total, context total, document) of all tokens of a batch; n_end: total of the end token, every text's first context."""
    words = [_unsqueeze(x) for x in batch.column("words").to_pylist()]
    pairs = [_unsqueeze(x) for x in batch.column("pairs").to_pylist()]
    contexts = [np.concatenate(([n_end], x[:-1])) for x in words]
    return np.concatenate(words), np.concatenate(pairs), np.concatenate(contexts), np.repeat(np.arange(len(words)), [len(x) for x in words])


@dataclass
class Interpolation:
    n: int  # training tokens
    vocabulary: int
    ends: int  # training texts
    weights: np.ndarray  # (BUCKETS, 3): uniform, word, pair


def held_out_cells(events: DataFrame, n: int, ends: int) -> DataFrame:
    """Training tokens by (bucket, word and pair probability without themselves): cell, n. At most BUCKETS x 97 x 97 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * (CELLS + 1) ** 2, np.int64)
        for batch in (part for whole in batches for part in _slices(whole)):
            word, pair, context, _ = _flat(batch, ends)
            p2, p1 = _estimates(pair - 1, word - 1, context - 1, n - 1)
            total += np.bincount((_bucket(context - 1) * (CELLS + 1) + _cell(p1, LOW1)) * (CELLS + 1) + _cell(p2, LOW2), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])

    return events.where("learn").select("n_tokens", "words", "pairs").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def learn_weights(cell: np.ndarray, count: np.ndarray, vocabulary: int) -> np.ndarray:
    """Mixture weights of each bucket by expectation-maximisation; an empty bucket takes those of all tokens together."""
    rest, pair = np.divmod(cell, CELLS + 1)
    bucket, word = np.divmod(rest, CELLS + 1)
    p = np.stack([np.full(len(cell), 1 / (vocabulary + 1)), _value(word, LOW1), _value(pair, LOW2)], axis=1)

    def fit(use: np.ndarray) -> np.ndarray:
        x, c, l = p[use], count[use].astype(float), np.full(3, 1 / 3)
        for _ in range(ROUNDS if len(c) else 0):
            r = x * l
            l = ((r / r.sum(axis=1, keepdims=True)) * c[:, None]).sum(axis=0) / c.sum()
            l = np.maximum(l, 1e-9) / np.maximum(l, 1e-9).sum()
        return l

    whole = fit(np.ones(len(cell), bool))
    return np.stack([fit(bucket == b) if (bucket == b).any() else whole for b in range(BUCKETS)])


def fit_interpolation(events: DataFrame) -> Interpolation:
    got = events.where("learn").agg(F.sum("n_tokens"), F.sum("share"), F.count("*")).first()
    n, vocabulary, ends = int(got[0] or 0), round(got[1] or 0), got[2]
    cells = held_out_cells(events, n, ends).toArrow()
    return Interpolation(n, vocabulary, ends, learn_weights(cells.column("cell").to_numpy(), cells.column("n").to_numpy(), vocabulary))


def score_events(events: DataFrame, model: Interpolation) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole)):
            k = batch.num_rows
            word, pair, context, doc = _flat(batch, model.ends)
            base = np.log10((word + 0.1) / (model.n + 0.1 * (model.vocabulary + 1)))
            p2, p1 = _estimates(pair, word, context, model.n)
            l = model.weights[_bucket(context)]
            p = l[:, 0] / (model.vocabulary + 1) + l[:, 1] * p1 + l[:, 2] * p2
            learn = batch.column("learn").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(~learn), batch.column("n_tokens"), batch.column("n_known"), pa.array(np.full(k, model.n, np.int64)), pa.array(sum_by(base, doc, k)), pa.array(sum_by(np.log10(p), doc, k))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return events.select("doc_id", "learn", "n_tokens", "n_known", "words", "pairs").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_texts(docs: DataFrame, learn) -> DataFrame:
    """Every text's log10 probability under a model of the rows where learn holds.

    A null text counts as empty: its end token alone. A row whose learn is null is not learned
    from. With nothing to learn from, all mass is uniform. Repeated rows are counted and scored
    once each; a very long text is read whole, in a block of its own size. An empty table gives no
    rows. Other columns are not read.
    """
    events = count_events(docs, learn)
    return score_events(events, fit_interpolation(events))


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """All whole texts of documents, learning from nine tenths of them."""
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), fold(F.col("doc_id"), 10) != 0)
