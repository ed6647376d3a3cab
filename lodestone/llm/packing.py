"""Cost-balanced packing of token sequences.

The cost of a piece of n tokens is LINEAR*n + QUADRATIC*n**2 (the feed-forward part grows
with the tokens, attention with their square). Within a packing group, documents longer
than a sequence are cut into full sequences and a rest; rests go, in descending order of
cost, to the sequence of least cost that has room for them. What fits nowhere whole is cut:
its first piece fills the sequence of least cost that has any room, and so on. So a group of
T tokens fills exactly ceil(T / 2048) sequences and pads only its last one.

A packing group is a run of some GROUP_BYTES of text of a scan task, tokenized and packed
where it was read: no shuffle, bounded memory, and a lost executor repeats its own tasks only.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.blocks import LOWER, SEPARATOR, ragged, sub_blocks, text_bytes, trim

SEQUENCE = 2048
END = 1
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Distinct words whose ids a worker keeps at most before it starts anew.
CACHE_WORDS = 600_000
#: Bytes tokenized at once, and of a packing group, as far as documents allow.
TOKEN_BLOCK, GROUP_BYTES = 3 << 20, 8 << 20
#: Odd words that the tokenizer is given at once: its replies are large.
TOKEN_WORDS = 1 << 13

_tokenizers: dict[str, tuple] = {}


def _tokenizer(path: str):
    """The tokenizer and its cache of word -> (first id's place, ids), one per worker process."""
    if path not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _tokenizers[path] = (Tokenizer.from_file(path), {})
    return _tokenizers[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _splits(data: np.ndarray) -> np.ndarray:
    """Where the tokenizer's own word pattern is sure to cut within a run: before ASCII punctuation
    that follows a letter, and between such punctuation and an ASCII letter.

    Apostrophes (contractions) and the bar (special tokens) never count as punctuation here.
    """
    kind = _KIND[data]
    letter = kind == 1
    letter[1:] |= (data[:-1] == 0xC3) & _C3_LETTER[data[1:]]
    cut = np.zeros(len(data), bool)
    cut[1:] = (letter[:-1] & (kind[1:] == 2)) | ((kind[:-1] == 2) & (kind[1:] == 1))
    return cut


_KIND = np.zeros(256, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'|"]] = 2
_C3_LETTER = np.zeros(256, bool)
_C3_LETTER[[c for c in range(0x80, 0xC0) if c not in (0x97, 0xB7)]] = True
#: Lower-case words of a-z and U+00DF-U+00FF: stable under the normaliser, one word of the pattern.
_PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = "".join(chr(b) if b in _SHOWN else chr(256 + sum(x not in _SHOWN for x in range(b))) for b in range(256))


def _encoded(tok, words: list[bytes]) -> Iterator[bytes]:
    """Ids of each word as unsigned 32-bit integers."""
    model, alphabet = tok.model, _ALPHABET
    odd: dict[bytes, list[int]] = {}
    rest = [w for w in words if not _PLAIN.fullmatch(w)]
    for at in range(0, len(rest), TOKEN_WORDS):
        some = rest[at : at + TOKEN_WORDS]
        for w, e in zip(some, tok.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False), strict=True):
            odd[w] = e.ids
    for w in words:
        ids = odd.get(w)
        if ids is None:
            ids = [t.id for t in model.tokenize(w.decode() if w.isascii() else "".join([alphabet[b] for b in w]))]
        yield struct.pack(f"={len(ids)}I", *ids)


def token_ids(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all documents, ids per document), each document followed by END.

    The tokenizer drops white space and never merges across it or across its word pattern, so
    ids follow from the runs between; each distinct run is encoded once and kept.
    """
    tok, cache = _tokenizer(path)
    n = len(offsets) - 1
    if not ((data[:-1] == 60) & (data[1:] == 124)).any():  # "<|" may begin a special token, which has a case
        data = LOWER[data]
    sep = SEPARATOR[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[:-1] |= sep
    edge[1:] |= sep
    if len(data):
        edge[:-1] |= _splits(data)
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    if len(starts):
        keep = ~sep[starts]
        starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return np.full(n, END, np.uint32), np.ones(n, np.int64)
    docs = np.searchsorted(offsets, starts, "right") - 1
    # every byte that is no separator lies in one run, so the runs follow each other
    begin = np.concatenate(([0], np.cumsum(ends - starts)))
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(begin), pa.py_buffer(data[~sep])]).dictionary_encode()
    distinct, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    if len(cache) > CACHE_WORDS:
        cache.clear()
    new = [w for w in distinct if w not in cache]
    cache.update(zip(new, _encoded(tok, new), strict=True))
    blobs = [cache[w] for w in distinct]
    flat = np.frombuffer(b"".join(blobs), np.uint32)
    size = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
    per_word = size[code]
    ids = flat[ragged((np.cumsum(size) - size)[code], per_word)]
    count = np.bincount(docs, weights=per_word, minlength=n).astype(np.int64)
    total = count + 1
    out = np.full(len(ids) + n, END, np.uint32)
    out[ragged(np.cumsum(total) - total, count)] = ids
    return out, total


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def pack(lengths: np.ndarray, capacity: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; documents of zero tokens have none.

    Ties: the longer document first, then the earlier; the sequence of least cost, then the
    lowest number.
    """
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    out: list[tuple[int, int, int, int, int]] = []
    seq = 0
    for d in np.flatnonzero(lengths >= capacity).tolist():
        for s in range(0, int(lengths[d]) // capacity * capacity, capacity):
            out.append((d, s, capacity, seq, 0))
            seq += 1
    rest = lengths % capacity
    order = np.flatnonzero(rest)
    order = order[np.argsort(-rest[order], kind="stable")]
    opened = -(-total // capacity) - seq
    room = [capacity] * opened
    if opened:  # the last sequence holds what is left over of the group
        room[-1] = total - capacity * (seq + opened - 1)
    room = np.array(room, np.int64)
    limit = room.copy()
    spent = np.zeros(opened)
    left: list[tuple[int, int]] = []
    for d in order.tolist():
        n = int(rest[d])
        i = int(np.where(room >= n, spent, np.inf).argmin()) if opened else -1
        if i < 0 or room[i] < n:
            left.append((d, n))
            continue
        out.append((d, int(lengths[d]) - n, n, seq + i, int(limit[i] - room[i])))
        room[i] -= n
        spent[i] += cost(n)
    for d, n in left:
        start = int(lengths[d]) - n
        while n:
            i = int(np.where(room > 0, spent, np.inf).argmin())
            take = min(n, int(room[i]))
            out.append((d, start, take, seq + i, int(limit[i] - room[i])))
            room[i] -= take
            spent[i] += cost(take)
            start, n = start + take, n - take
    return out


def pack_documents(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, cost[, ids].

    A null text counts as empty: one piece, the end id. Very long texts are cut into as many
    sequences as they fill. Repeated rows are packed once each, an empty table gives no rows. Ties
    of cost: see ``pack``. Other columns of docs are not read. sequence_id is unique over the table:
    task, group, number.
    """
    path = tokenizer or default_tokenizer()
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, base = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for first, last, group, ends in sub_blocks(data, offsets, GROUP_BYTES):
                parts = [token_ids(d, o, path) for _, _, d, o in sub_blocks(group, ends, TOKEN_BLOCK)]
                ids, total = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                begin = np.cumsum(total) - total
                pieces = np.array(pack(total), np.int64).reshape(-1, 5)
                doc, start, length, seq, offset = pieces.T
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                at = begin[doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                keys = batch.column("doc_id").slice(first, last - first).take(pa.array(doc))
                cols = [keys, pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(total[doc]), pa.array((task << 40) + base + seq), pa.array(offset), pa.array(cost(length.astype(float)))]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32)), pa.array(ids[ragged(at, length)].astype(np.int32))))
                base += int(seq.max()) + 1
                yield pa.RecordBatch.from_arrays(cols, names=names)
            trim()

    return src.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double" + ", ids array<int>" * with_ids)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("cost")
