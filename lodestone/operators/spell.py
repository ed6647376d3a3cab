"""Query understanding: phrase and token dictionaries, typo correction in context, synonyms.

All batch-first: queries(query_id, raw_query) in, the same rows with token columns out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import is_number, normalize, osa_distance, tokens, typo_grams
from lodestone.operators.index import TypoModel

#: Groups of words that name one thing; the first is the canonical one: fixed values.
SYNONYMS = (
    ("sofa", "sofas", "couch", "couches", "loveseat", "loveseats", "sectional", "sectionals", "settee", "settees", "futon", "futons"),
    ("refrigerator", "refrigerators", "fridge", "fridges"),
    ("faucet", "faucets", "tap", "taps", "spigot", "spigots"),
    ("cabinet", "cabinets", "cupboard", "cupboards"),
    ("mower", "mowers", "lawnmower", "lawnmowers"),
    ("trimmer", "trimmers", "weedwacker", "weedwhacker", "weedeater", "stringtrimmer", "linetrimmer"),
    ("flashlight", "flashlights", "torch", "torches"),
    ("adhesive", "adhesives", "glue", "glues"),
)
MAX_CANDIDATES = 250


def _lookup(values: dict[str, object]) -> Column:
    return F.create_map(*(F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for kv in values.items() for x in kv))


def canonical_map(groups=SYNONYMS) -> Column:
    return _lookup({w: g[0] for g in groups for w in g})


def canonicalize(toks: Column, groups=SYNONYMS) -> Column:
    """Each token's group head, or itself."""
    m = canonical_map(groups)
    return F.transform(toks, lambda t: F.coalesce(F.try_element_at(m, t), t))


def expand(toks: Column, groups=SYNONYMS) -> Column:
    """All words of each token's group, in order, without repeats."""
    m = _lookup({w: list(g) for g in groups for w in g})
    return F.array_distinct(F.flatten(F.transform(toks, lambda t: F.coalesce(F.try_element_at(m, t), F.array(t)))))


def in_synonyms(tok: Column, groups=SYNONYMS) -> Column:
    return tok.isin(*(w for g in groups for w in g))


def max_distance(word: Column) -> Column:
    return F.when(F.length(word) <= 5, 1).when(F.length(word) <= 10, 2).otherwise(3)


def shape_score(a: Column, b: Column) -> Column:
    """Of first letter, last letter, first two, last two: how many agree."""
    same = (F.left(a, F.lit(1)) == F.left(b, F.lit(1)), F.right(a, F.lit(1)) == F.right(b, F.lit(1)), F.left(a, F.lit(2)) == F.left(b, F.lit(2)), F.right(a, F.lit(2)) == F.right(b, F.lit(2)))
    return sum((x.cast("int") for x in same[1:]), same[0].cast("int"))


def spell_phrases(queries: DataFrame, spelling: DataFrame) -> DataFrame:
    """queries with `phrase`: the dictionary's text for the trimmed lower-case query, or the query itself.

    Keys are compared as written, so one with capitals never matches.
    """
    d = spelling.groupBy("wrong").agg(F.max("right").alias("right"))
    joined = queries.join(d, F.lower(F.trim("raw_query")) == F.col("wrong"), "left")
    return joined.withColumn("phrase", F.coalesce("right", "raw_query")).drop("wrong", "right")


def spell_tokens(rows: DataFrame, spelling: DataFrame) -> DataFrame:
    """rows(query_id, place, tok) with each token replaced by the dictionary's single word, if it has one."""
    d = spelling.where(~F.contains("right", F.lit(" "))).groupBy("wrong").agg(F.max("right").alias("right"))
    return rows.join(d, F.col("tok") == F.col("wrong"), "left").withColumn("tok", F.coalesce("right", "tok")).drop("wrong", "right")


def typo_candidates(words: DataFrame, model: TypoModel, most: int = MAX_CANDIDATES) -> DataFrame:
    """tok, cand, overlap, dist, shape, freq: corrections of distinct words(tok) within the distance that their length allows.

    Words in the vocabulary, of under three letters or of digits only have none. The `most`
    candidates of largest gram overlap are tried, ties by word. Distances are computed once per
    distinct pair; a cheap Levenshtein bound goes first (a swap is two of its edits).
    """
    known = model.vocabulary.select(F.col("token").alias("tok"))
    open_ = words.select("tok").distinct().where((F.length("tok") >= 3) & ~is_number(F.col("tok"))).join(known, "tok", "left_anti")
    shared = open_.select("tok", F.explode(typo_grams("tok")).alias("gram")).join(model.grams, "gram").groupBy("tok", F.col("token").alias("cand")).agg(F.count("*").alias("overlap"))
    by = Window.partitionBy("tok").orderBy(F.desc("overlap"), "cand")
    top = shared.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most).drop("rank")
    limit = max_distance(F.col("tok"))
    near = top.where((F.abs(F.length("cand") - F.length("tok")) <= limit) & (F.levenshtein("tok", "cand") <= 2 * limit))
    measured = near.withColumn("dist", osa_distance("tok", "cand")).where(F.col("dist") <= limit)
    freq = model.vocabulary.select(F.col("token").alias("cand"), "freq")
    return measured.join(freq, "cand").select("tok", "cand", "overlap", "dist", shape_score(F.col("tok"), F.col("cand")).alias("shape"), "freq")


def _pair(prev: Column, cand: Column) -> Column:
    return F.concat(F.coalesce(prev, F.lit("")), F.lit(" "), cand)


def _choose(tok: Column, cands: Column, context: Column, prev: Column) -> Column:
    """The accepted correction of one token after prev, from its candidates; context: counts of the pairs that can occur here."""
    key = F.transform(
        cands,
        lambda c: F.struct(
            c["dist"].alias("dist"),
            (-F.coalesce(F.try_element_at(context, _pair(prev, c["cand"])), F.lit(0))).alias("context"),
            (-c["shape"]).alias("shape"),
            (-c["overlap"]).alias("overlap"),
            (-c["freq"]).alias("freq"),
            c["cand"].alias("cand"),
        ),
    )
    ordered = F.array_sort(key)

    def decide(o: Column) -> Column:
        best, second = F.get(o, F.lit(0)), F.get(o, F.lit(1))
        strong = (best["context"] < 0) | (best["shape"] <= -2) | (best["overlap"] <= -3) | (best["freq"] <= -8)
        tied = second.isNotNull() & (second["dist"] == best["dist"]) & (second["context"] == best["context"]) & (best["shape"] > -3)
        return F.when(best.isNull(), tok).when(best["dist"] <= 1, best["cand"]).when(~strong | F.coalesce(tied, F.lit(False)), tok).otherwise(best["cand"])

    # a lambda over one element binds the sorted array, so that it is sorted once
    return F.get(F.transform(F.array(ordered), decide), F.lit(0))


def correct_typos(rows: DataFrame, model: TypoModel, groups=SYNONYMS) -> DataFrame:
    """query_id, toks: rows(query_id, place, tok) corrected in order, each in the context of its corrected predecessor.

    The context-free part runs once per distinct word. A place needs the counts of the pairs of its
    own candidates after its predecessor or one of that one's candidates, and only these pairs meet
    the table of pairs; the choice is a fold over the query's tokens. Synonym words stay.
    """
    cands = typo_candidates(rows.where(~in_synonyms(F.col("tok"), groups)), model)
    offers = cands.groupBy("tok").agg(F.collect_list(F.struct("cand", "dist", F.col("shape").cast("long").alias("shape"), "overlap", "freq")).alias("cands"))
    placed = rows.join(offers, "tok", "left")
    before = Window.partitionBy("query_id").orderBy("place")
    after = placed.withColumn("prev", F.concat(F.array(F.lag("tok").over(before)), F.coalesce(F.lag(F.transform("cands", lambda c: c["cand"])).over(before), F.array().cast("array<string>"))))
    met = after.where(F.col("cands").isNotNull()).select("query_id", "place", F.explode(F.array_distinct("prev")).alias("prev"), "cands").where(F.col("prev").isNotNull())
    pairs = met.select("query_id", "place", "prev", F.explode("cands").alias("c")).select("query_id", "place", "prev", F.col("c.cand").alias("token"))
    counts = model.bigrams.select("prev", "token", F.col("freq").cast("long").alias("freq"))
    context = pairs.join(counts, ["prev", "token"]).groupBy("query_id", "place").agg(F.map_from_entries(F.collect_list(F.struct(_pair(F.col("prev"), F.col("token")), "freq"))).alias("context"))
    full = placed.join(context, ["query_id", "place"], "left").withColumn("context", F.coalesce("context", F.create_map().cast("map<string,bigint>")))
    listed = full.groupBy("query_id").agg(F.collect_list(F.struct("place", "tok", "cands", "context")).alias("seq"))
    by_place = F.array_sort("seq", lambda a, b: a["place"] - b["place"])

    def step(done: Column, x: Column) -> Column:
        prev = F.try_element_at(done, F.lit(-1))
        return F.concat(done, F.array(F.when(x["cands"].isNull(), x["tok"]).otherwise(_choose(x["tok"], x["cands"], x["context"], prev))))

    return listed.select("query_id", F.aggregate(by_place, F.array().cast("array<string>"), step).alias("toks"))


def understand(queries: DataFrame, spelling: DataFrame, model: TypoModel | None, groups=SYNONYMS) -> DataFrame:
    """query_id, raw_query, raw_norm, raw_tok, q_tok, q_norm, recall_tok, expanded; queries without any token are left out.

    A phrase that the dictionary changes is normalised and canonicalised only. Others go through
    the token dictionary, typo correction and canonicalisation. If nothing is left of a query
    that had tokens, its raw tokens stand.
    """
    q = spell_phrases(queries, spelling).withColumn("raw_tok", tokens("raw_query")).withColumn("ptok", tokens("phrase"))
    hit = q.where("phrase <> raw_query").select("query_id", F.col("ptok").alias("toks"))
    miss = q.where("not (phrase <> raw_query)").select("query_id", F.posexplode("ptok").alias("place", "tok"))
    words = spell_tokens(miss, spelling)
    fixed = correct_typos(words, model, groups) if model else words.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "tok"))), lambda x: x["tok"]).alias("toks"))
    both = q.select("query_id", "raw_query", "raw_tok").join(hit.unionByName(fixed), "query_id", "left")
    return finish(both.withColumn("toks", F.coalesce("toks", F.array().cast("array<string>"))), groups)


def finish(rows: DataFrame, groups=SYNONYMS) -> DataFrame:
    """Canonical, normalised and expanded columns from raw_query, raw_tok and corrected toks."""
    out = rows.withColumn("q_tok", canonicalize(F.col("toks"), groups))
    out = out.withColumn("q_tok", F.when(F.size("q_tok") == 0, F.col("raw_tok")).otherwise(F.col("q_tok"))).where(F.size("q_tok") > 0)
    out = out.withColumn("recall_tok", expand(F.col("q_tok"), groups))
    return out.select("query_id", "raw_query", normalize("raw_query").alias("raw_norm"), "raw_tok", "q_tok", F.array_join("q_tok", " ").alias("q_norm"), "recall_tok", (F.size("recall_tok") > F.size("q_tok")).alias("expanded"))
