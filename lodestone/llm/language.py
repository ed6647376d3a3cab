"""Language identification of mixed texts.

Script ranges narrow the candidates of each word; character-trigram models score it under
each candidate; Viterbi over the words of a text, with a penalty for each switch, labels
spans. The text's prediction is the language that holds most of its letters.

The models are trigram log-probabilities, learned from a bounded sample of each language's
labelled rows (``TRAIN_ROWS``). Prediction is a map over whole texts: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.blocks import BLOCK_BYTES, sub_blocks, text_bytes, trim
from lodestone.llm.shared import fold, with_fields

#: Labelled rows of each language that a model learns from, at most.
TRAIN_ROWS = 1500
#: Languages that a table may hold.
MOST_LANGUAGES = 1000
BUCKETS = 1 << 16
SWITCH = 12.0
#: A word's evidence against a language counts no further than this.
FLOOR = -20.0
#: A script is a language's own from this share of its letters on.
SCRIPT_SHARE = 0.02
UNKNOWN = "und"
#: Bytes of texts whose words are decoded together, for up to four languages (for more, so many times fewer); scores are made in smaller blocks (``BLOCK_BYTES``).
DECODE_BYTES = 3 << 20

#: Scripts by Unicode block, as ranges of code points: fixed values.
SCRIPTS = (
    ("latin", (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    ("greek", (0x370, 0x3FF), (0x1F00, 0x1FFF)),
    ("cyrillic", (0x400, 0x52F),),
    ("armenian", (0x530, 0x58F),),
    ("hebrew", (0x590, 0x5FF),),
    ("arabic", (0x600, 0x6FF), (0x750, 0x77F)),
    ("devanagari", (0x900, 0x97F),),
    ("bengali", (0x980, 0x9FF),),
    ("tamil", (0xB80, 0xBFF),),
    ("thai", (0xE00, 0xE7F),),
    ("georgian", (0x10A0, 0x10FF),),
    ("hangul", (0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    ("kana", (0x3040, 0x30FF),),
    ("han", (0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
)
OTHER = len(SCRIPTS)
_SCRIPT_OF = np.full(0x10000, OTHER, np.uint8)
for _i, (_name, *_ranges) in enumerate(SCRIPTS):
    for _a, _b in _ranges:
        _SCRIPT_OF[_a : _b + 1] = _i

#: Bytes of words: ASCII letters, lower-cased, and all of multi-byte characters; the rest are gaps.
_NORMAL = np.full(256, 32, np.uint8)
_NORMAL[97:123] = np.arange(97, 123)
_NORMAL[65:91] = np.arange(97, 123)
_NORMAL[128:] = np.arange(128, 256)


@dataclass
class Words:
    start: np.ndarray  # bytes
    end: np.ndarray
    doc: np.ndarray
    script: np.ndarray
    letters: np.ndarray
    gram: np.ndarray  # bucket of the trigram around each byte of a word
    first: np.ndarray  # where each word's trigrams begin


@dataclass
class Scored:
    """Words of several blocks with their scores; what is larger than a word is gone."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    script: np.ndarray
    letters: np.ndarray
    emissions: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    low = _NORMAL[data]
    low[1:][(data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0x9F) & (data[1:] != 0x97)] += 0x20
    inside = low != 32
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (edge[:-1] | np.concatenate(([True], ~inside[:-1]))))
    end = np.flatnonzero(inside & (edge[1:] | np.concatenate((~inside[1:], [True])))) + 1
    if not len(low):
        start = end = np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, start, "right") - 1
    wide = np.concatenate(([32], low, [32])).astype(np.uint32)
    before, here, after = wide[:-2].copy(), wide[1:-1], wide[2:].copy()
    before[start] = 32
    after[end - 1] = 32
    code = (before << np.uint32(16)) | (here << np.uint32(8)) | after
    gram = ((code * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)[inside]
    size = end - start
    # the script of the word's first character
    b = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint32)
    b0, b1, b2 = b[start], b[start + 1], b[start + 2]
    point = np.where(b0 < 0x80, b0, np.where(b0 < 0xE0, (b0 & 31) << 6 | b1 & 63, np.where(b0 < 0xF0, (b0 & 15) << 12 | (b1 & 63) << 6 | b2 & 63, 0xFFFF)))
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return Words(start, end, doc, _SCRIPT_OF[np.minimum(point, 0xFFFF)], lead[end] - lead[start], gram, np.cumsum(size) - size)


@dataclass
class LanguageModel:
    names: list[str]
    logp: np.ndarray  # (BUCKETS, languages)
    scripts: np.ndarray  # (scripts, languages): whether the language writes in it
    usual: int  # the most frequent language

    def emissions(self, w: Words) -> np.ndarray:
        """Log-score of each word under each language, 0 at best, FLOOR at worst and off the candidates."""
        n, k = len(w.start), len(self.names)
        out = np.empty((n, k), np.float32)
        for j in range(k):
            out[:, j] = np.add.reduceat(self.logp[:, j][w.gram], w.first) if n else 0
        allowed = self.scripts[w.script]
        out[~allowed] = -np.inf
        best = out.max(axis=1, keepdims=True, initial=-np.inf)
        out -= np.where(np.isfinite(best), best, 0)
        np.maximum(out, np.float32(FLOOR), out=out)
        out[~allowed.any(axis=1)] = 0  # no language writes so: the word says nothing
        return out


def scored_words(data: np.ndarray, offsets: np.ndarray, model: LanguageModel) -> Scored:
    """Words and emissions of all texts, made block by block, so that memory follows the words and not the bytes."""
    parts = []
    for at, _, d, o in sub_blocks(data, offsets, BLOCK_BYTES * 4 // max(4, len(model.names))):
        w = words_of(d, o)
        shift = offsets[at]
        parts.append((w.start + shift, w.end + shift, w.doc + at, w.script, w.letters.astype(np.int32), model.emissions(w) if model.names else np.zeros((len(w.start), 0), np.float32)))
    if not parts:
        none = np.zeros(0, np.int64)
        return Scored(none, none, none, none, none, np.zeros((0, len(model.names)), np.float32))
    return Scored(*map(np.concatenate, zip(*parts, strict=True)))


def viterbi(emissions: np.ndarray, counts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of every row; counts: rows of each text, one after another.

    All texts advance together, longest first, so the cost of a step is shared. Ties keep the
    label; between switches the lowest number wins.
    """
    n, k = emissions.shape
    labels = np.zeros(n, np.uint8 if k < 256 else np.uint16)
    if not n:
        return labels
    begin = np.cumsum(counts) - counts
    order = np.argsort(-counts, kind="stable")
    base, size = begin[order], counts[order]
    steps = int(size[0])
    active = np.searchsorted(-size, -np.arange(1, steps + 1), "right")
    back = np.zeros((n, k), labels.dtype)
    own = np.arange(k, dtype=labels.dtype)
    a = active[0]
    score = np.zeros((len(size), k), np.float32)
    score[:a] = emissions[base[:a]]
    for t in range(1, steps):
        a = active[t]
        s = score[:a]
        top = s.argmax(axis=1)
        jump = s[np.arange(a), top][:, None] - np.float32(switch)
        stay = s >= jump
        at = base[:a] + t
        back[at] = np.where(stay, own, top[:, None])
        score[:a] = np.where(stay, s, jump) + emissions[at]
    state = score.argmax(axis=1)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        at = base[:a] + t
        labels[at] = state[:a]
        if t:
            state[:a] = back[at, state[:a]]
    return labels


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
        data, offsets = text_bytes(batch.column("text"))
        total = np.zeros((len(names), BUCKETS + OTHER + 1), np.int64)
        for at, _, d, o in sub_blocks(data, offsets):
            w = words_of(d, o)
            lang = code[at + w.doc]
            per_gram = np.repeat(lang, w.end - w.start)
            for j in range(len(names)):
                total[j, :BUCKETS] += np.bincount(w.gram[per_gram == j], minlength=BUCKETS)
                total[j, BUCKETS:] += np.bincount(w.script[lang == j], weights=w.letters[lang == j], minlength=OTHER + 1).astype(np.int64)
        j, g = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in j], pa.string()), pa.array(g.astype(np.int32)), pa.array(total[j, g])], names=["lang", "gram", "n"])


def _sample(known: DataFrame, counts: list, rows: int) -> DataFrame:
    """lang, text of at most `rows` rows of each language, drawn by a hash of id and text; repeated rows count once."""
    share = known.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.2 * rows / r["n"])) for r in counts], "lang string, share double")
    h = F.xxhash64(F.lit(3), "doc_id", "text")
    some = known.withColumn("h", h).join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))  # one row a language, MOST_LANGUAGES at most
    one = some.groupBy("lang", "h").agg(F.first("text").alias("text"))
    return one.withColumn("nr", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("nr") <= rows).select("lang", "text")


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> LanguageModel:
    """A model of every lang in docs, from at most `rows` rows of each; docs: doc_id, text, lang.

    Rows whose text or lang is null teach nothing. A table without labelled rows gives a model
    without languages; one of more than MOST_LANGUAGES distinct values is an error. Of two
    languages with as many rows, the first by name counts as the more frequent.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = [r["lang"] for r in counts]
    number = {x: i for i, x in enumerate(names)}
    total = np.zeros((BUCKETS + OTHER + 1, max(1, len(names))), np.float64)
    if names:  # at most languages x (buckets + scripts) sums
        got = _sample(known, counts, rows).mapInArrow(_gram_counts, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
        total[got.column("gram").to_numpy(), [number[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    grams, scripts = total[:BUCKETS] + 0.5, total[BUCKETS:]
    share = scripts / np.maximum(scripts.sum(axis=0), 1)
    usual = int(np.argmax([r["n"] for r in counts])) if names else 0
    return LanguageModel(names, np.log(grams / grams.sum(axis=0)).astype(np.float32), share >= SCRIPT_SHARE, usual)


def identify(docs: DataFrame, model: LanguageModel, spans: bool = False) -> DataFrame:
    """docs with lang_pred, lang_score and, if asked, lang_spans (lang, start, end in code points).

    `und` with score 0 where the text is null, empty or has no letter, and everywhere under a model
    without languages. lang_score is the share of the text's letters that the predicted language
    holds; of equal holders the first by name is predicted. Texts in scripts of no learned language
    get the most frequent one, with score 0. Texts are read whole whatever their length; repeated
    rows get the same answer each, an empty table gives none. Columns of these names in the input
    are replaced, all others stay.
    """
    added = ["lang_pred", "lang_score"] + ["lang_spans"] * spans
    keep = [c for c in docs.columns if c not in added]
    src = docs.select(*(F.col(f"`{c}`") for c in keep))
    schema = with_fields(src, "lang_pred string, lang_score double" + ", lang_spans array<struct<lang:string,start:bigint,end:bigint>>" * spans)
    held = src.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, k = held.value, max(1, len(held.value.names))
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            pred: list[str] = []
            score: list[float] = []
            found: list[list[dict]] = []
            for _, _, d, o in sub_blocks(data, offsets, DECODE_BYTES * 4 // max(4, len(m.names))):
                n = len(o) - 1
                w = scored_words(d, o, m)
                counts = np.bincount(w.doc, minlength=n)
                label = viterbi(w.emissions, counts) if m.names else np.zeros(len(w.doc), np.uint8)
                mass = np.bincount(w.doc * k + label, weights=w.letters, minlength=n * k).reshape(n, k)
                silent = np.bincount(w.doc, weights=m.scripts[w.script].any(axis=1), minlength=n) == 0 if m.names else np.ones(n, bool)
                best = np.where(silent, m.usual, mass.argmax(axis=1))
                share = np.where(silent, 0.0, mass[np.arange(n), best] / np.maximum(mass.sum(axis=1), 1))
                letter_at = np.flatnonzero((d | 32) - 97 < 26)
                no_ascii = np.searchsorted(letter_at, o[1:]) == np.searchsorted(letter_at, o[:-1])
                for i in range(n):
                    und = not m.names or (no_ascii[i] and not any(map(str.isalpha, d[o[i] : o[i + 1]].tobytes().decode("utf-8", "replace"))))
                    pred.append(UNKNOWN if und else m.names[best[i]])
                    score.append(0.0 if und else min(1.0, float(share[i])))
                if spans:
                    found += _spans(d, o, w, label, m.names)
            cols = [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())]
            if spans:
                cols.append(pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))))
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names, *added])
            trim()

    return src.mapInArrow(run, schema)


def _spans(d: np.ndarray, o: np.ndarray, w: Scored, label: np.ndarray, names: list[str]) -> list[list[dict]]:
    """Runs of words with one label, for each document."""
    out: list[list[dict]] = [[] for _ in range(len(o) - 1)]
    if not len(label) or not names:
        return out
    point = np.concatenate(([0], np.cumsum((d & 0xC0) != 0x80)))
    new = np.concatenate(([True], (label[1:] != label[:-1]) | (w.doc[1:] != w.doc[:-1])))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(label)])) - 1
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        i = int(w.doc[a])
        out[i].append({"lang": names[label[a]], "start": int(point[w.start[a]] - point[o[i]]), "end": int(point[w.end[b]] - point[o[i]])})
    return out


def learned_rows(docs: DataFrame) -> DataFrame:
    """The rows that the contract lets a model learn from."""
    return docs.where(fold(F.col("doc_id"), 4) != 2)


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(learned_rows(docs))
    out = identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
