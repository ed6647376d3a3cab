"""Near duplicates by BagMinHash signatures of shingle multisets.

A document is the multiset of its five-word shingles. Each shingle carries Poisson processes
over its discretised weight: one for the interval (0,1], one for (1,2], one for (2,4], ...; a
point has a time, a register and a position in its interval, all functions of the shingle. A
document holds the points whose position lies below the shingle's count there, and a register
keeps the least time. Two documents agree in a register with probability equal to their
weighted Jaccard similarity. Points are drawn in order of time and only up to a bound that
fills all registers, so a signature costs about m log m points however long the text.

Signatures are banded. The members of a bucket are linked to its first member; pairs are
verified on the whole texts by exact weighted Jaccard. The members of buckets that hold several
classes after that go to an exact join by prefixes of their shingles, which finds every pair of
them that is similar (see ``prefixes``). There, classes meet by representatives first, so that
only members of classes that stay apart are compared. No bucket is capped.

A document is known by a hash of its text, so copies collapse before all this. Classes are
connected components, found by alternating large-star and small-star rounds over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.blocks import LOWER, hash_words, mix, sub_blocks, text_bytes, trim, word_spans
from lodestone.llm.shared import written

WORDS = 5
SIMILAR = 0.8
BANDS, ROWS = 26, 5
REGISTERS = BANDS * ROWS
#: Cells that count tokens for the order of prefixes; collisions cost time, not pairs.
CELLS = 1 << 20
#: Parities of tokens that a text carries into the exact join.
PARITIES = 1024
_K = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = np.uint64(0xD1B54A32D192ED03)
_UNIT = 2.0**-53
#: Registers that stay empty up to the first time bound are one in so many documents.
_SPARE = 6.0


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of the distinct shingles, by document and hash.

    Words are runs without white space, A-Z as a-z. A text of fewer words is one shingle of what
    it has; a text without words has none.
    """
    n = len(offsets) - 1
    start, end, doc = word_spans(data, offsets)
    h = hash_words(LOWER[data], start, end)
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    rolled = np.zeros(len(h), np.uint64)
    for j in range(min(words, len(h))):  # position matters: each word has a multiplier of its own
        rolled[: len(h) - j] += h[j:] * np.uint64(pow(int(_K), 2 * j + 1, 1 << 64))
    whole = np.arange(len(h)) - first[doc] <= count[doc] - words
    d, s = doc[whole], mix(rolled[whole])
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        d = np.concatenate((d, short))
        parts = [mix(np.array([np.bitwise_xor.reduce(mix(h[first[i] : first[i] + count[i]] + np.arange(1, count[i] + 1, dtype=np.uint64)))], np.uint64)) for i in short.tolist()]
        s = np.concatenate((s, *parts))
    order = np.lexsort((s, d))
    d, s = d[order], s[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    at = np.flatnonzero(new)
    return d[at], s[at], np.diff(np.append(at, len(d)))


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """(n, m) register values, as the hashes of the points that hold them; 0 for documents without shingles."""
    least = np.full(n * m, np.inf)
    holder = np.zeros(n * m, np.uint64)
    weight = np.bincount(doc, weights=count, minlength=n)
    bound = np.zeros(n)
    has = weight > 0
    bound[has] = (np.log(m) + _SPARE) / weight[has]
    todo = has.copy()
    since = np.zeros(n)  # points up to this time are in
    while todo.any():
        use = todo[doc]
        _points(doc[use], shingle[use], count[use], since, bound, m, least, holder)
        todo = has & ~np.isfinite(least.reshape(n, m)).all(axis=1)
        since = bound.copy()
        bound = np.where(todo, bound * 2, bound)
    return holder.reshape(n, m)


def _points(doc, shingle, count, since, bound, m, least, holder) -> None:
    """Points of all processes with since < time <= bound, put into the registers."""
    level = 0
    while True:
        low, high = (0, 1) if level == 0 else (1 << (level - 1), 1 << level)
        use = count > low
        if not use.any():
            return
        d, c = doc[use], count[use]
        state = mix(shingle[use] + np.uint64(int(_LEVEL) * (level + 1) % (1 << 64)))
        rate = float(m * (high - low))
        t, at = np.zeros(len(d)), 0
        while len(d):
            at += 1
            x = mix(state + np.uint64(int(_K) * at % (1 << 64)))
            y = mix(x ^ _LEVEL)
            t = t - np.log1p(-((x >> np.uint64(11)).astype(float) * _UNIT)) / rate
            alive = t <= bound[d]
            d, c, state, t, x, y = d[alive], c[alive], state[alive], t[alive], x[alive], y[alive]
            held = t > since[d]
            if high - low > 1:  # the position within the interval, against the count
                held &= low + ((mix(y + _K) >> np.uint64(11)).astype(float) * _UNIT) * (high - low) < c
            register = d[held] * m + ((y[held] >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
            time, key = t[held], x[held]
            order = np.lexsort((key, time, register))
            register, time, key = register[order], time[order], key[order]
            first = np.ones(len(register), bool)
            first[1:] = register[1:] != register[:-1]
            register, time, key = register[first], time[first], key[first]
            better = time < least[register]
            least[register[better]] = time[better]
            holder[register[better]] = key[better]
        level += 1


def bands(signature: np.ndarray, bands_: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(n, bands) hashes of consecutive registers."""
    x = signature.reshape(len(signature), bands_, rows)
    out = np.full((len(signature), bands_), _LEVEL, np.uint64)
    for j in range(rows):
        out = mix(out * _K + x[:, :, j])
    return out + np.arange(bands_, dtype=np.uint64) * _LEVEL


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Total weight and bands of each text; texts without words have no bands."""
    for batch in batches:
        data, offsets = text_bytes(batch.column("text"))
        for at, to, d, o in sub_blocks(data, offsets):
            doc, s, c = shingles(d, o)
            weight = np.bincount(doc, weights=c, minlength=to - at).astype(np.int64)
            b = bands(signatures(doc, s, c, to - at)).view(np.int64)[weight > 0]
            cut = np.concatenate(([0], np.cumsum((weight > 0) * BANDS))).astype(np.int32)
            part = batch.slice(at, to - at)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("node"), pa.array(weight), pa.ListArray.from_arrays(pa.array(cut), pa.array(b.ravel()))], names=["id", "node", "weight", "bands"])
        trim()


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two multisets, each sorted hashes and counts."""
    total = int(a[1].sum() + b[1].sum())
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / (total - both) if total else 0.0


def _tokens(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, text, token) of each sub-block: the k-th copy of a shingle is a token of its own, so multisets become sets."""
    data, offsets = text_bytes(column)
    for at, _, d, o in sub_blocks(data, offsets):
        doc, s, c = shingles(d, o)
        copy = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        yield at, np.repeat(doc, c), mix(np.repeat(s, c) + copy.astype(np.uint64) * _K)


def _cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, token in _tokens(batch.column("text")):
            cell, n = np.unique((token % np.uint64(CELLS)).astype(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n.astype(np.int64))], names=["cell", "n"])


def prefixes(texts: DataFrame) -> DataFrame:
    """node, weight, prefix (the first tokens of each text, rare ones first), bits (parities of all its tokens by hash).

    texts: node, text. Two texts whose first common token stands at positions p and q share at most
    min(weight - p, weight' - q) tokens, so those of similarity >= SIMILAR have it at positions of
    at most (1 - SIMILAR) weight. That holds for any order of all tokens. The tokens in which two
    texts differ are at least as many as the parities in which they do.
    """
    counted = texts.select("text").mapInArrow(_cell_counts, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells = np.zeros(CELLS, np.int64)
    cells[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    held = texts.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, doc, token in _tokens(batch.column("text")):
                order = np.lexsort((token, held.value[(token % np.uint64(CELLS)).astype(np.int64)], doc))
                doc, token = doc[order], token[order]
                weight = np.bincount(doc)
                n = len(weight)
                pos = np.arange(len(doc)) - (np.cumsum(weight) - weight)[doc]
                use = weight[doc] - pos >= SIMILAR * weight[doc] - 1e-6
                parity = np.bincount(doc * PARITIES + (mix(token) >> np.uint64(40)).astype(np.int64) % PARITIES, minlength=n * PARITIES) & 1
                bits = np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)
                cut = np.concatenate(([0], np.cumsum(np.bincount(doc[use], minlength=n)))).astype(np.int32)
                words = np.arange(n + 1, dtype=np.int32) * (PARITIES // 64)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(at, n), pa.array(weight), pa.ListArray.from_arrays(pa.array(cut), pa.array(token[use].view(np.int64))), pa.ListArray.from_arrays(pa.array(words), pa.array(bits))], names=["node", "weight", "prefix", "bits"])

    return texts.select("node", "text").mapInArrow(run, "node long, weight long, prefix array<long>, bits array<long>")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the pairs (a, b, text_a, text_b), those that are similar; each distinct text of a batch is shingled once."""
    for batch in batches:
        a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        bags: dict[int, tuple] = {}
        for ids, column in ((a, "text_a"), (b, "text_b")):
            _, first = np.unique(ids, return_index=True)
            first = np.array([i for i in first.tolist() if ids[i] not in bags], np.int64)
            if not len(first):
                continue
            data, offsets = text_bytes(batch.column(column).take(pa.array(first)))
            for at, to, d, o in sub_blocks(data, offsets):
                doc, s, c = shingles(d, o)
                cut = np.searchsorted(doc, np.arange(to - at + 1))
                for i in range(to - at):
                    bags[ids[first[at + i]]] = (s[cut[i] : cut[i + 1]], c[cut[i] : cut[i + 1]])
        ok = np.array([similarity(bags[x], bags[y]) >= SIMILAR for x, y in zip(a, b, strict=True)], bool)
        yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], names=["a", "b"])


def _settled(e: DataFrame) -> bool:
    """Whether the edges u -> v are stars: every u has one v, and no v is a u."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    return ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 or out = 1 and in = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """id, root (the least id of its component) of all ids in edges a, b that are no roots: large-star and small-star rounds until only stars are left.

    Every input of a join is a written table, so Spark may split the rows of a hub over tasks;
    a hub's neighbours are never gathered in one row.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _settled(e):
        # large-star: the larger neighbours of a node point to its least neighbour, or to itself
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), "edges")
        # small-star: a node and its smaller neighbours point to the least of them
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = written(nxt, "edges")
    return e.select(F.col("u").alias("id"), F.col("v").alias("root"))


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """roots after further links: the classes that they join are contracted to their roots first, so few edges are left."""
    if links.isEmpty():
        return roots
    if roots is None:
        return components(links)
    root_of = lambda side: roots.select(F.col("id").alias(side), F.col("root").alias(f"root_{side}"))
    between = links.join(root_of("a"), "a", "left").join(root_of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    above = components(between)
    moved = roots.join(above.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("root"))
    return written(moved.unionByName(above), "roots")


def _classed(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """members with `class`: the root of their node, or the node itself."""
    if roots is None:
        return members.withColumn("class", F.col("node"))
    return members.join(roots.withColumnRenamed("id", "node"), "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")


def _enough(rest, weight_x, weight_y):
    """Whether `rest` common tokens, at most, allow the similarity of two total weights."""
    return (1 + SIMILAR) * rest >= SIMILAR * (F.col(weight_x) + weight_y) - 1e-6


def _pair(x: str, y: str):
    """Columns a < b of two members whose total weights and positions allow the similarity; columns of y start with its name."""
    wx, wy = F.col("weight"), F.col(f"{y}_weight")
    near = (F.greatest(wx, wy) * SIMILAR <= F.least(wx, wy)) & _enough(F.least(wx - F.col("pos"), wy - F.col(f"{y}_pos")), "weight", wy)
    return near, F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


def _named(members: DataFrame, name: str, *more: str) -> DataFrame:
    """The second side of a join by bucket: node, weight, pos and more under a name of their own."""
    return members.select("bucket", F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("weight", "pos", *more)))


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs that are similar. Texts of the larger nodes, which differ, travel; a hub's text joins last."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(b, "b").join(a, "a").select("a", "b", "text_a", "text_b").mapInArrow(_verified, "a long, b long")


class _Links:
    """Classes so far. Each pair is tested once."""

    def __init__(self) -> None:
        self.tested: list[DataFrame] = []
        self.roots: DataFrame | None = None

    def test(self, pairs: DataFrame, texts: DataFrame) -> None:
        pairs = pairs.distinct()
        if self.tested:
            pairs = pairs.join(reduce(DataFrame.unionByName, self.tested), ["a", "b"], "left_anti")
        fresh = written(pairs, "pairs")
        self.tested.append(fresh)
        self.roots = _merged(self.roots, written(_similar(fresh, texts), "links"))


def _shared(members: DataFrame) -> DataFrame:
    """members (node, weight, bucket, pos) of buckets that they share, written, with the bucket's first member as `head`.

    A member that stands beyond its prefix against the lightest partner that it has here meets none.
    """
    head = F.min(F.struct("node", "weight", "pos")).alias("head")
    shared = members.groupBy("bucket").agg(F.count("*").alias("n"), head, F.min("weight").alias("lightest")).where("n > 1")
    shared = written(shared.select("bucket", "lightest", F.col("head.node").alias("head"), F.col("head.weight").alias("head_weight"), F.col("head.pos").alias("head_pos")), "shared")
    of_use = _enough(F.col("weight") - F.col("pos"), "weight", F.greatest(SIMILAR * F.col("weight"), F.col("lightest")))
    return written(members.join(shared, "bucket").where(of_use), "members")


def _to_heads(members: DataFrame) -> DataFrame:
    near, a, b = _pair("node", "head")
    return members.where((F.col("node") != F.col("head")) & near).select(a, b)


def _open(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The members of buckets that hold several classes, written, with `class` and `most`, the bucket's largest class.

    A bucket's head has met all others (``_to_heads``), so it is left out, and a bucket of two is done.
    """
    classed = written(_classed(members.where("node <> head").select("node", "weight", "bucket", "pos"), roots), "classed")
    sizes = classed.groupBy("bucket", "class").agg(F.count("*").alias("size"))
    several = sizes.groupBy("bucket").agg(F.max(F.struct("size", "class")).alias("top"), F.count("*").alias("n")).where("n > 1")
    several = written(several.select("bucket", F.col("top.class").alias("most")), "several")
    return written(classed.join(several, "bucket"), "open")


def _representatives(members: DataFrame) -> DataFrame:
    """Pairs of one member of each class and one of the bucket's largest class."""
    one = members.groupBy("bucket", "class", "most").agg(F.min(F.struct("weight", "node", "pos")).alias("x")).select("bucket", "class", "most", "x.*")
    one = written(one, "heads")
    near, a, b = _pair("node", "other")
    top = _named(one.where(F.col("class") == F.col("most")), "other")
    return one.where(F.col("class") != F.col("most")).join(top, "bucket").where(near).select(a, b)


def _across(members: DataFrame) -> DataFrame:
    """All pairs of members of different classes of a bucket whose weights, positions and parities allow the similarity.

    members: with `bits`. What differs in two texts, at least: see ``prefixes``.
    Partners' weights lie within a factor, so both sides are dealt by bucket and step of weight:
    one side goes to its own step, the other to its own and the two beside it.
    """
    step = F.floor(F.log("weight") / F.lit(-float(np.log(SIMILAR)))).cast("int")
    stepped = members.withColumn("step", step)
    minor = stepped.where(F.col("class") != F.col("most")).withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    other = _named(minor, "other", "class", "bits", "step").withColumnRenamed("other_step", "step")
    near, a, b = _pair("node", "other")
    differ = reduce(Column.__add__, (F.bit_count(F.get("bits", F.lit(i)).bitwiseXOR(F.get("other_bits", F.lit(i)))) for i in range(PARITIES // 64)))
    allowed = differ * (1 + SIMILAR) <= (F.col("weight") + F.col("other_weight")) * (1 - SIMILAR) + 1e-6
    return stepped.join(other, ["bucket", "step"]).where((F.col("class") != F.col("other_class")) & near & allowed).select(a, b)


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, node of every row; id, node, class of every distinct text), both written. Node: a hash of the text, null where it has no words or the row no id."""
    src = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    src = src.select("id", _node(F.col("id"), F.col("text")).alias("node"), "text")
    signed = written(src.mapInArrow(_signed, "id long, node long, weight long, bands array<long>"), "signed")
    # copies: one document of each text goes on
    one = written(signed.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.first("weight").alias("weight"), F.first("bands").alias("bands")), "distinct")
    members = _shared(one.select("node", "weight", F.lit(0).cast("long").alias("pos"), F.explode("bands").alias("bucket")))
    wanted = one.select("id", "node").join(members.select("node").distinct(), "node", "left_semi")
    texts = written(src.join(wanted, ["id", "node"], "left_semi").dropDuplicates(["id", "node"]).select("node", "text"), "texts")
    links = _Links()
    links.test(_to_heads(members), texts)
    left = _open(members, links.roots).select("node").distinct()
    rest = written(texts.join(left, "node", "left_semi"), "rest")
    if not rest.isEmpty():
        bags = written(prefixes(rest), "prefixes")
        members = _shared(bags.select("node", "weight", F.posexplode("prefix").alias("pos", "bucket")).withColumn("pos", F.col("pos").cast("long")))
        links.test(_to_heads(members), texts)
        links.test(_representatives(_open(members, links.roots)), texts)
        links.test(_across(_open(members, links.roots).join(bags.select("node", "bits"), "node")), texts)
    return signed.select("id", "node"), written(_classed(one.select("id", "node"), links.roots), "classes")


def _node(doc_id: Column, text: Column) -> Column:
    """64 bits of the text, null where it has no words or there is no id."""
    return F.when(doc_id.isNotNull() & text.rlike("[^\\x20\\x09-\\x0D]"), F.xxhash64(text))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of its class) for every row of docs: doc_id, text.

    Classes are the connected components of similarity >= 0.8. Pairs in a common bucket are found
    whatever the bucket's size; pairs of similarity 0.8 that share none are 3 in 100,000.

    Texts without words (null, empty, white space) are in classes of their own each. Rows that
    repeat a doc_id are documents of their own where their texts differ. A row without doc_id gets
    a null class and takes no part. Very long texts are read whole. An empty table gives no rows.
    Nothing depends on the order of rows: ties go to the smaller hash or id. Other columns are not
    read. Texts are told apart by 64 bits of hash.
    """
    rows, classes = _linked(docs)
    ids = classes.groupBy("class").agg(F.min("id").alias("class_id"))
    labels = written(classes.join(ids, "class").select("node", "class_id"), "labels")
    known = rows.where("node is not null").join(labels, "node").select(F.col("id").alias("doc_id"), "class_id")
    return known.unionByName(rows.where("node is null").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id")))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without near duplicates: of each class the row of its least doc_id stays.

    Rows without doc_id or without words all stay, as no text is near to them. Of rows that repeat
    id and text one stays; where their other columns differ, any. Columns of any name come back as
    they are.
    """
    _, classes = _linked(docs)
    kept = written(classes.groupBy("class").agg(F.min(F.struct("id", "node")).alias("x")).select("x.id", "x.node"), "kept")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    whole = whole.select("row", "id", _node(F.col("id"), F.col("text")).alias("node"))
    some = whole.where("node is not null").join(kept, ["id", "node"], "left_semi").dropDuplicates(["id", "node"])
    return some.unionByName(whole.where("node is null")).select("row.*")


def op5_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
