"""Queries of the search engine and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text
from lodestone.operators import corpus as co
from lodestone.operators import images as im
from lodestone.operators import index as ix
from lodestone.operators import models, profile, rank, retrieve, spell
from lodestone.plans import catalogue as cat
from lodestone.sources import tables
from lodestone.sources.shared import written
from lodestone.streaming.profile import windowed

N = 20

# ---------------------------------------------------------------- SQL pieces


def tok(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"


def norm(x: str) -> str:
    return f"array_to_string({tok(x)}, ' ')"


def grams(t: str) -> str:
    return f"flatten(list_transform({t}, lambda w: case when length(w) < 3 then [w] else list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)) end))"


def canon(t: str) -> str:
    whens = " ".join(f"when '{w}' then '{g[0]}'" for g in spell.SYNONYMS for w in g)
    return f"list_transform({t}, lambda w: case w {whens} else w end)"


def expanded(t: str) -> str:
    whens = " ".join(f"when '{w}' then {list(g)}" for g in spell.SYNONYMS for w in g)
    return f"list_distinct(flatten(list_transform({t}, lambda w: case w {whens} else [w] end)))"


CORPUS = f"""corpus as (select d.doc_id as uid, p.p_name as title, d.text as descr, p.p_brand as brand, concat_ws(' ', coalesce(p.p_brand, 'nan'), coalesce(p.p_type, 'nan'), coalesce(cast(p.p_size as varchar), 'nan')) as attrs
  from documents d join part p on d.doc_id = p.p_partkey),
 ctok as (select uid, title, {tok('title')} as t, {tok('descr')} as d, {tok('attrs')} as a, {tok('brand')} as b, {norm('title')} as tn, {norm('descr')} as dn from corpus)"""
QUERIES_SQL = f"""queries as (select item_id as query_id, text as raw_query from benchmark
  union all select * from (values {', '.join(f"({i}, '{q}')" for i, q in cat.EXTRA_QUERIES)}) v(query_id, raw_query)),
 q as (select query_id, raw_query, {tok('raw_query')} as raw_tok, {canon(tok('raw_query'))} as q_tok, {norm('raw_query')} as raw_norm, array_to_string({canon(tok('raw_query'))}, ' ') as q_norm, {expanded(canon(tok('raw_query')))} as recall_tok from queries where len({tok('raw_query')}) > 0)"""


def index_sql(*fields: str) -> str:
    of = {"word": "list_concat(t, d)", "gram": grams("list_concat(t, d)"), "title": "t", "desc": "d", "attr": "a"}
    toks = " union all ".join(f"select uid, '{f}' as field, {of[f]} as toks from ctok" for f in fields)
    return f"""toks as ({toks}),
 fields as (select field, count(*) as n, avg(len(toks)) as avgdl from toks group by field),
 occ as (select field, uid, len(toks) as dl, unnest(toks) as term from toks),
 post as (select field, uid, term, any_value(dl) as dl, count(*) as tf from occ group by field, uid, term),
 dfs as (select field, term, count(*) as df from post group by field, term),
 raws as (select d.field, term, df, n, avgdl, ln(n - df + 0.5) - ln(df + 0.5) as raw from dfs d join fields f on d.field = f.field),
 terms as (select r.field, term, df, n, avgdl, case when raw < 0 then 0.25 * m.mean else raw end as idf from raws r join (select field, avg(raw) as mean from raws group by field) m on r.field = m.field)"""


def scored_sql(name: str, variants: str) -> str:
    """variants: a select of query_id, variant, field, terms (a list)."""
    return f"""qt as (select query_id, variant, field, term, count(*) as qf from (select query_id, variant, field, unnest(terms) as term from ({variants})) group by all),
 {name} as (select query_id, variant, uid, sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as score from qt join terms using (field, term) join post using (field, term) group by query_id, variant, uid)"""


def ranked_sql(scores: str, n: int) -> str:
    """Zero fill over every query and product, then the n best."""
    return f"""alls as (select q.query_id, c.uid, round(coalesce(s.score, 0), 6) as score from q cross join corpus c left join ({scores}) s on s.query_id = q.query_id and s.uid = c.uid)
 select query_id, uid as product_uid, score + 0.0 as score, cast(rank as integer) as rank from (select *, row_number() over (partition by query_id order by score desc, uid desc) as rank from alls) where rank <= {n}"""


def hybrid_sql(mode: str) -> str:
    w = retrieve.GRAM_WEIGHT[mode]
    changed = "(raw_norm <> q_norm)"
    parts = ["select query_id, 'word' as variant, 'word' as field, q_tok as terms from q", "select query_id, 'expanded', 'word', recall_tok from q where len(recall_tok) > len(q_tok)", f"select query_id, 'gram', 'gram', case when {changed} then list_concat({grams('q_tok')}, {grams('raw_tok')}) else {grams('q_tok')} end from q"]
    word = "case when x then greatest(word, 0.72 * ex) else word end"
    gram = "gram"
    if mode == "aggressive":
        parts += [f"select query_id, 'raw', 'word', raw_tok from q where {changed}", f"select query_id, 'raw_ex', 'word', {expanded('raw_tok')} from q where {changed} and len(recall_tok) > len(q_tok)", f"select query_id, 'raw_gram', 'gram', {grams('raw_tok')} from q where {changed}"]
        raw = "case when x then greatest(raw, 0.68 * raw_ex) else raw end"
        word = f"case when fb then greatest({word}, 0.88 * ({raw})) else {word} end"
        gram = "case when fb then greatest(gram, raw_gram) else gram end"
    pivot = ", ".join(f"coalesce(sum(score) filter (where variant = '{v}'), 0) as {a}" for v, a in (("word", "word"), ("expanded", "ex"), ("gram", "gram"), ("raw", "raw"), ("raw_ex", "raw_ex"), ("raw_gram", "raw_gram")))
    fused = f"select query_id, uid, ({word}) + {w} * ({gram}) as score from (select s.query_id, uid, len(any_value(recall_tok)) > len(any_value(q_tok)) as x, any_value(raw_norm) <> any_value(q_norm) as fb, {pivot} from sc s join q on q.query_id = s.query_id group by s.query_id, uid)"
    return f"with {CORPUS}, {QUERIES_SQL}, {index_sql('word', 'gram')}, {scored_sql('sc', ' union all '.join(parts))}, {ranked_sql(fused, N)}"


def word_candidates_sql() -> str:
    """CTEs up to `cand`: the N best products by words."""
    return f"{CORPUS}, {QUERIES_SQL}, {index_sql('word')}, {scored_sql('sc', chr(39).join(('select query_id, ', 'word', ' as variant, ', 'word', ' as field, q_tok as terms from q')))}, cand as (with {ranked_sql('select query_id, uid, score from sc', N)})"


def pairs_sql(select: str) -> str:
    return f"with {word_candidates_sql()}, pair as (select c.query_id, c.product_uid, q.q_tok as q, q.q_norm as qn, k.t, k.d, k.a, k.b, k.tn, k.dn from cand c join q on q.query_id = c.query_id join ctok k on k.uid = c.product_uid) select query_id, product_uid, {select} from pair"


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- text, corpus, catalogue


@query(f"select doc_id, {norm('text')} as norm, len({tok('text')}) as n_tokens from documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return cat.table(spark, d, "documents").select("doc_id", text.normalize("text").alias("norm"), F.size(text.tokens("text")).cast("long").alias("n_tokens"))


@query(f"select p_partkey, array_to_string({grams(tok('p_name'))}, ',') as grams from part")
def char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return cat.table(spark, d, "part").select("p_partkey", F.array_join(text.char_ngrams(text.tokens("p_name")), ",").alias("grams"))


@query(f"with {CORPUS} select uid as product_uid, title as product_title, brand, attrs as all_attributes, tn as product_title_norm, dn as product_description_norm, {norm('attrs')} as all_attributes_norm, {norm('brand')} as brand_norm from corpus join ctok using (uid, title)")
def corpus_build(spark: SparkSession, d: str) -> DataFrame:
    return co.build_corpus(cat.descriptions(spark, d), cat.titles(spark, d), cat.attributes(spark, d)).drop("product_description")


@query("select p_partkey as product_uid, p_brand as brand from part")
def brand_lookup(spark: SparkSession, d: str) -> DataFrame:
    return co.brands(cat.attributes(spark, d))


@query("select p_partkey as product_uid, concat_ws(' ', p_brand, p_type, cast(p_size as varchar)) as all_attributes from part")
def attr_concat(spark: SparkSession, d: str) -> DataFrame:
    return co.attribute_text(cat.attributes(spark, d))


@query("select l_partkey as product_uid, l_shipmode as product_title from (select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey) as rn from (select l_partkey, l_orderkey, l_linenumber, l_suppkey, l_returnflag || l_linestatus as l_shipmode from lineitem)) where rn = 1")
def first_title(spark: SparkSession, d: str) -> DataFrame:
    rows = cat.table(spark, d, "lineitem").select(F.col("l_partkey").alias("product_uid"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("pos"), F.concat("l_returnflag", "l_linestatus").alias("product_title"))
    return co.first_rows(rows, "product_uid", "pos", "product_title")


@query("select l_partkey as product_uid, p_name as product_title, count(*) as product_freq from lineitem join part on l_partkey = p_partkey group by all")
def catalog_freq(spark: SparkSession, d: str) -> DataFrame:
    rows = cat.table(spark, d, "lineitem").select(F.col("l_partkey").alias("product_uid")).join(cat.titles(spark, d), "product_uid")
    return co.title_frequency(rows)


@query("select doc_id as product_uid from documents join part on doc_id = p_partkey")
def validate_schema(spark: SparkSession, d: str) -> DataFrame:
    return co.validate(cat.corpus(spark, d)).select("product_uid")


# ---------------------------------------------------------------- index and typo model


@query(f"select token, count(*) as freq from (select unnest({tok('p_name')}) as token from part) group by token")
def token_freq(spark: SparkSession, d: str) -> DataFrame:
    return ix.token_frequency(cat.titles(spark, d).select(text.tokens("product_title").alias("toks")))


@query(f"with t as (select {tok('text')} as l from documents) select prev, token, count(*) as freq from (select unnest(l[1:len(l)-1]) as prev, unnest(l[2:]) as token from t where len(l) > 1) group by all")
def bigram_freq(spark: SparkSession, d: str) -> DataFrame:
    return ix.bigram_frequency(cat.table(spark, d, "documents").select(text.tokens("text").alias("toks")))


@query(f"select token, count(*) as freq from (select unnest({tok('text')}) as token from documents) group by token having count(*) >= 3 and length(token) >= 3 and not regexp_full_match(token, '[0-9]+')")
def vocab_filter(spark: SparkSession, d: str) -> DataFrame:
    return ix.vocabulary(ix.token_frequency(cat.table(spark, d, "documents").select(text.tokens("text").alias("toks"))))


@query(f"with {CORPUS}, {index_sql('word', 'title', 'desc', 'attr')} select field, term, df, round(idf, 6) as idf from terms")
def term_idf(spark: SparkSession, d: str) -> DataFrame:
    return cat.index(spark, d, "word", "title", "desc", "attr").terms.withColumn("idf", F.round("idf", 6))


@query(f"with {CORPUS}, {index_sql('word', 'gram', 'title', 'desc', 'attr')} select field, n, round(avgdl, 6) as avgdl from fields")
def field_stats(spark: SparkSession, d: str) -> DataFrame:
    return ix.field_stats(ix.field_tokens(co.with_split_tokens(cat.corpus(spark, d)))).withColumn("avgdl", F.round("avgdl", 6))


# ---------------------------------------------------------------- retrieval


@query(f"with {word_candidates_sql()} select * from cand")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return cat.candidates(spark, d, N)


@query(f"""with {CORPUS}, {QUERIES_SQL}, {index_sql('gram')}, {scored_sql('sc', "select query_id, 'gram' as variant, 'gram' as field, " + grams('q_tok') + " as terms from q")}, {ranked_sql('select query_id, uid, score from sc', N)}""")
def bm25_ngram(spark: SparkSession, d: str) -> DataFrame:
    q, c = cat.plain_queries(spark, d), cat.corpus(spark, d)
    terms = retrieve.query_terms(q, ("gram", "gram", text.char_ngrams("q_tok"), None))
    idx = cat.index(spark, d, "gram")
    return retrieve.best(terms, q, idx, c, N)


def _hybrid(spark: SparkSession, d: str, mode: str) -> DataFrame:
    c = cat.corpus(spark, d)
    return retrieve.hybrid(cat.plain_queries(spark, d).withColumn("mode", F.lit(mode)), cat.index(spark, d, "word", "gram"), c, N)


@query(hybrid_sql("balanced"))
def hybrid_balanced(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, "balanced")


@query(hybrid_sql("aggressive"))
def hybrid_aggressive(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, "aggressive")


@query(f"with {QUERIES_SQL} select query_id, array_to_string(list_sort(recall_tok), ' ') as recall, len(recall_tok) > len(q_tok) as expanded from q")
def synonym_expand(spark: SparkSession, d: str) -> DataFrame:
    return cat.plain_queries(spark, d).select("query_id", F.array_join(F.array_sort("recall_tok"), " ").alias("recall"), "expanded")


UNIT = "list_transform(embedding, lambda x: cast(x as double) / sqrt(list_sum(list_transform(embedding, lambda y: cast(y as double) * y))))"
KNN_SQL = f"select a.vec_id as query_id, b.vec_id as product_uid, round(list_inner_product(a.v, b.v), 6) as score from (select vec_id, {UNIT} as v from embeddings where vec_id % 50 = 0) a cross join (select vec_id, {UNIT} as v from embeddings) b"


@query(f"select query_id, product_uid, score, cast(rank as integer) as rank from (select *, row_number() over (partition by query_id order by score desc, product_uid desc) as rank from ({KNN_SQL})) where rank <= {N}")
def knn_cosine(spark: SparkSession, d: str) -> DataFrame:
    v = cat.vectors(spark, d)
    return retrieve.knn(v.where("product_uid % 50 = 0").withColumnRenamed("product_uid", "query_id"), v, N)


@query(
    f"""with {word_candidates_sql()}, sem as (select query_id, product_uid, row_number() over (partition by query_id order by score desc, product_uid desc) as rank from ({KNN_SQL}) where query_id in (select query_id from q)),
 both_ as (select query_id, product_uid, rank as ord from cand union all select query_id, product_uid, rank + 1000000 from sem where rank <= {N})
 select query_id, product_uid, cast(row_number() over (partition by query_id order by o) as integer) as ord from (select query_id, product_uid, min(ord) as o from both_ group by all)"""
)
def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    lexical = cat.candidates(spark, d, N)
    v = cat.vectors(spark, d)
    ids = cat.plain_queries(spark, d).select("query_id")
    asked = v.where("product_uid % 50 = 0").withColumnRenamed("product_uid", "query_id").join(ids, "query_id", "left_semi")
    return retrieve.merge(lexical, retrieve.knn(asked, v, N))


# ---------------------------------------------------------------- features


def _pairs(spark: SparkSession, d: str, *names: str) -> DataFrame:
    found = cat.candidates(spark, d, N)
    out = rank.overlap_features(found, cat.plain_queries(spark, d), cat.narrowed(found, cat.corpus(spark, d))[0])
    return out.select("query_id", "product_uid", *(F.round(n, 6).alias(n) for n in names))


def _ratio(a: str, b: str) -> str:
    return f"cast({a} as double) / greatest({b}, 1)"


_NUM = "regexp_full_match(x, '[0-9]+')"
_SQL = {
    "query_len": "len(q)",
    "title_len": "len(t)",
    "desc_len": "len(d)",
    "attr_len": "len(a)",
    "query_unique_terms": "len(list_distinct(q))",
    "num_attributes": "cast(len(a) > 0 as integer)",
    "len_ratio": _ratio("len(q)", "len(t)"),
    "last_word_match": "cast(list_contains(t, q[-1]) as integer)",
    "num_match_count": f"len(list_distinct(list_intersect(list_filter(q, lambda x: {_NUM}), list_filter(t, lambda x: {_NUM}))))",
    "brand_match": "coalesce(cast(list_contains(q, b[1]) as integer), 0)",
    "exact_in_title": "cast(contains(tn, qn) as integer)",
    "exact_in_desc": "cast(contains(dn, qn) as integer)",
}
for _p, _v in (("title", "t"), ("desc", "d")):
    _at = f"list_filter(range(1, len({_v}) + 1), lambda i: list_contains(q, {_v}[i]))"
    _SQL |= {f"{_p}_pos_min": f"coalesce(list_min({_at}), 0)", f"{_p}_pos_mean": f"coalesce(list_avg({_at}), 0)", f"{_p}_pos_max": f"coalesce(list_max({_at}), 0)"}
for _v, _names in (("t", ("title_overlap", "title_overlap_ratio", "title_coverage", "title_jaccard")), ("d", ("desc_overlap", "desc_overlap_ratio", "desc_coverage", "desc_jaccard")), ("a", ("attr_overlap", "attr_overlap_ratio", "all_attrs_match_ratio", "attr_jaccard"))):
    _common, _either = f"len(list_distinct(list_intersect(q, {_v})))", f"len(list_distinct(list_concat(q, {_v})))"
    _SQL |= dict(zip(_names, (_common, _ratio(_common, "len(list_distinct(q))"), _ratio(_common, f"len(list_distinct({_v}))"), _ratio(_common, _either)), strict=True))


def _feature_query(name: str, *cols: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _pairs(spark, d, *cols)

    run.__name__ = name
    query(pairs_sql(", ".join(f"round(cast({_SQL[c]} as double), 6) as {c}" for c in cols)))(run)


_feature_query("feat_lengths", "query_len", "title_len", "desc_len", "attr_len", "query_unique_terms", "num_attributes", "len_ratio")
_feature_query("feat_matches", "last_word_match", "num_match_count", "brand_match", "exact_in_title", "exact_in_desc")
_feature_query("feat_positions", "title_pos_min", "title_pos_mean", "title_pos_max", "desc_pos_min", "desc_pos_mean", "desc_pos_max")
_feature_query("feat_overlap_title", "title_overlap", "title_overlap_ratio", "title_coverage", "title_jaccard")
_feature_query("feat_overlap_desc", "desc_overlap", "desc_overlap_ratio", "desc_coverage", "desc_jaccard")
_feature_query("feat_overlap_attr", "attr_overlap", "attr_overlap_ratio", "all_attrs_match_ratio", "attr_jaccard")


def _field_variants(fields: tuple[str, ...]) -> str:
    return " union all ".join(f"select query_id, '{f}' as variant, '{f}' as field, q_tok as terms from q" for f in fields)


@query(
    f"""with cand0 as (with {word_candidates_sql()} select * from cand), {CORPUS}, {QUERIES_SQL}, {index_sql('title', 'desc', 'attr')}, {scored_sql('sc', _field_variants(('title', 'desc', 'attr')))}
 select c.query_id, c.product_uid, {', '.join(f"round(coalesce(sum(s.score) filter (where variant = '{f}'), 0), 6) as score_bm25_{f}" for f in ('title', 'desc', 'attr'))}
 from cand0 c left join sc s on s.query_id = c.query_id and s.uid = c.product_uid group by c.query_id, c.product_uid"""
)
def feat_bm25_fields(spark: SparkSession, d: str) -> DataFrame:
    found = cat.candidates(spark, d, N)
    _, index = cat.narrowed(found, cat.corpus(spark, d), cat.index(spark, d, "title", "desc", "attr"))
    out = rank.field_scores(found, cat.plain_queries(spark, d), index)
    return out.select("query_id", "product_uid", *(F.round(c, 6).alias(c) for c in ("score_bm25_title", "score_bm25_desc", "score_bm25_attr")))


@query(
    f"""with cand0 as (with {word_candidates_sql()} select * from cand), {CORPUS}, {QUERIES_SQL}, {index_sql('title', 'desc')},
 w as (select field, term, ln((1.0 + n) / (1.0 + df)) + 1 as w from terms),
 dv as (select p.field, p.uid, p.term, tf * w as x from post p join w using (field, term)),
 dn as (select field, uid, sqrt(sum(x * x)) as norm from dv group by all),
 qv as (select query_id, field, term, count(*) * any_value(w) as y from (select query_id, unnest(q_tok) as term from q) join w using (term) group by all),
 qn as (select query_id, field, sqrt(sum(y * y)) as norm from qv group by all),
 s as (select qv.query_id, dv.field, dv.uid, sum(x * y) / (any_value(dn.norm) * any_value(qn.norm)) as score from qv join dv using (field, term) join dn on dn.field = dv.field and dn.uid = dv.uid join qn on qn.query_id = qv.query_id and qn.field = qv.field group by all)
 select c.query_id, c.product_uid, {', '.join(f"round(coalesce(sum(s.score) filter (where field = '{f}'), 0), 6) as score_tfidf_{f}" for f in ('title', 'desc'))}
 from cand0 c left join s on s.query_id = c.query_id and s.uid = c.product_uid group by c.query_id, c.product_uid"""
)
def tfidf_dot(spark: SparkSession, d: str) -> DataFrame:
    found = cat.candidates(spark, d, N)
    _, index = cat.narrowed(found, cat.corpus(spark, d), cat.index(spark, d, "title", "desc"))
    out = rank.tfidf_scores(found, cat.plain_queries(spark, d), index)
    return out.select("query_id", "product_uid", *(F.round(c, 6).alias(c) for c in ("score_tfidf_title", "score_tfidf_desc")))


@query()
def lsa_scores(spark: SparkSession, d: str) -> DataFrame:
    found = cat.candidates(spark, d, N)
    _, idx = cat.narrowed(found, cat.corpus(spark, d), cat.index(spark, d, "word", "gram", "title", "desc", "attr"))
    return models.lsa_scores(found, cat.plain_queries(spark, d), idx, *cat.latent_spaces(spark, d))


@query(
    f"""with cand0 as (with {word_candidates_sql()} select * from cand), v as (select vec_id, {UNIT} as v from embeddings)
 select query_id, product_uid, round(list_inner_product(a.v, b.v), 6) as score_st_title, round(list_inner_product(a.v, e.v), 6) as score_st_desc
 from cand0 left join v a on a.vec_id = query_id left join v b on b.vec_id = product_uid left join v e on e.vec_id = product_uid + 1"""
)
def feat_vectors(spark: SparkSession, d: str) -> DataFrame:
    """A product's title has the vector of its number, its description the next one."""
    v = cat.vectors(spark, d)
    return rank.vector_scores(cat.candidates(spark, d, N), v.withColumnRenamed("product_uid", "query_id"), v, v.withColumn("product_uid", F.col("product_uid") - 1))


# ---------------------------------------------------------------- query understanding

_SPELL = ", ".join(f"('{a}', '{b}')" for a, b in cat.SPELLING)


@query(f"with {QUERIES_SQL}, s(wrong, right_) as (values {_SPELL}) select query_id, coalesce(right_, raw_query) as phrase from queries left join s on wrong = lower(trim(raw_query))")
def spell_phrase(spark: SparkSession, d: str) -> DataFrame:
    return spell.spell_phrases(cat.queries(spark, d), cat.spelling(spark)).select("query_id", "phrase")


@query(f"with {QUERIES_SQL}, s(wrong, right_) as (values {_SPELL}), t as (select query_id, unnest(raw_tok) as tok, unnest(range(0, len(raw_tok))) as place from q) select query_id, cast(place as integer) as place, case when contains(coalesce(right_, ' '), ' ') then tok else right_ end as tok from t left join s on wrong = tok")
def spell_token(spark: SparkSession, d: str) -> DataFrame:
    rows = cat.queries(spark, d).select("query_id", F.posexplode(text.tokens("raw_query")).alias("place", "tok"))
    return spell.spell_tokens(rows, cat.spelling(spark))


@query(f"with {QUERIES_SQL} select query_id, array_to_string(q_tok, ' ') as canonical from q")
def canonicalize(spark: SparkSession, d: str) -> DataFrame:
    return cat.plain_queries(spark, d).select("query_id", F.col("q_norm").alias("canonical"))


def _typos(spark: SparkSession, d: str) -> DataFrame:
    """Misspelt title words: first two letters swapped, last letter lost, second letter doubled, two letters changed."""
    w = ix.token_frequency(cat.titles(spark, d).select(text.tokens("product_title").alias("toks"))).select(F.col("token").alias("w"))
    made = F.array(F.concat(F.substring("w", 2, 1), F.substring("w", 1, 1), F.substring("w", 3, 99)), F.expr("substring(w, 1, length(w) - 1)"), F.concat(F.substring("w", 1, 2), F.substring("w", 2, 99)), F.concat(F.lit("x"), F.substring("w", 2, 99), F.lit("q")))
    return w.select(F.explode(made).alias("tok")).distinct()


_TYPO_SQL = f"""f as (select token, count(*) as freq from (select unnest({tok('p_name')}) as token from part) group by token),
 v as (select * from f where freq >= 3 and length(token) >= 3 and not regexp_full_match(token, '[0-9]+')),
 ty as (select distinct tok from (select unnest([substr(token, 2, 1) || substr(token, 1, 1) || substr(token, 3), substr(token, 1, length(token) - 1), substr(token, 1, 2) || substr(token, 2), 'x' || substr(token, 2) || 'q']) as tok from f)),
 op as (select tok from ty where length(tok) >= 3 and not regexp_full_match(tok, '[0-9]+') and tok not in (select token from v)),
 g(t, gs) as (select t, list_distinct(list_concat(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)), list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substr(t, i, 3)))) from (select tok as t from op union select token from v)),
 ov as (select op.tok, v.token as cand, len(list_intersect(a.gs, b.gs)) as overlap, v.freq, case when length(op.tok) <= 5 then 1 when length(op.tok) <= 10 then 2 else 3 end as most, cast(damerau_levenshtein(op.tok, v.token) as integer) as dist from op join g a on a.t = op.tok cross join v join g b on b.t = v.token),
 cands as (select tok, cand, overlap, dist, cast(substr(tok, 1, 1) = substr(cand, 1, 1) as int) + cast(right(tok, 1) = right(cand, 1) as int) + cast(left(tok, 2) = left(cand, 2) as int) + cast(right(tok, 2) = right(cand, 2) as int) as shape, freq from ov where overlap > 0 and abs(length(tok) - length(cand)) <= most and dist <= most)"""


@query(f"with {_TYPO_SQL} select * from cands")
def typo_candidates(spark: SparkSession, d: str) -> DataFrame:
    return spell.typo_candidates(_typos(spark, d), cat.typo_model(spark, d))


@query(
    f"""with {_TYPO_SQL}, r as (select *, row_number() over w as k, lead(dist) over w as dist2 from cands window w as (partition by tok order by dist, shape desc, overlap desc, freq desc, cand))
 select ty.tok, case when r.cand is null then ty.tok when dist <= 1 then cand when not (shape >= 2 or overlap >= 3 or freq >= 8) then ty.tok when dist2 = dist and shape < 3 then ty.tok else cand end as corrected
 from ty left join r on r.tok = ty.tok and r.k = 1"""
)
def typo_correct(spark: SparkSession, d: str) -> DataFrame:
    """One-word queries, so without context; sequences are tested against a plain loop."""
    rows = _typos(spark, d).select(F.col("tok").alias("query_id"), F.lit(0).alias("place"), "tok")
    return spell.correct_typos(rows, cat.typo_model(spark, d)).select(F.col("query_id").alias("tok"), F.get("toks", F.lit(0)).alias("corrected"))


_TWO_SQL = f"""pw as (select p_partkey, ({tok('p_name')})[1] as w1, ({tok('p_name')})[2] as w2 from part),
 two as (select p_partkey as query_id, substr(w1, 2, 1) || substr(w1, 1, 1) || substr(w1, 3) as t1, 'x' || substr(w2, 2) || 'q' as t2 from pw where w2 is not null)"""
_CONTEXT_SQL = f"""{_TWO_SQL}, {_TYPO_SQL},
 bg as (select prev, token, count(*) as n from (select unnest(l[1:len(l)-1]) as prev, unnest(l[2:]) as token from (select {tok('p_name')} as l from part) where len(l) > 1) group by all),
 r1 as (select *, row_number() over w as k, lead(dist) over w as dist2 from cands window w as (partition by tok order by dist, shape desc, overlap desc, freq desc, cand)),
 one as (select two.query_id, t2, case when r.cand is null then t1 when dist <= 1 then cand when not (shape >= 2 or overlap >= 3 or freq >= 8) then t1 when dist2 = dist and shape < 3 then t1 else cand end as c1 from two left join r1 r on r.tok = t1 and r.k = 1),
 r2 as (select o.query_id, c.*, coalesce(n, 0) as ctx, row_number() over w as k, lead(dist) over w as dist2, lead(coalesce(n, 0)) over w as ctx2 from one o join cands c on c.tok = o.t2 left join bg on prev = o.c1 and token = c.cand window w as (partition by o.query_id order by dist, coalesce(n, 0) desc, shape desc, overlap desc, freq desc, cand))"""


@query(
    f"""with {_CONTEXT_SQL} select o.query_id, c1 || ' ' || case when r.cand is null then t2 when dist <= 1 then cand when not (ctx > 0 or shape >= 2 or overlap >= 3 or freq >= 8) then t2 when dist2 = dist and ctx2 = ctx and shape < 3 then t2 else cand end as corrected
 from one o left join r2 r on r.query_id = o.query_id and r.k = 1"""
)
def typo_context(spark: SparkSession, d: str) -> DataFrame:
    """Two misspelt words of each title: the second is corrected in the context of the first's correction."""
    w = cat.titles(spark, d).select(F.col("product_uid").alias("query_id"), text.tokens("product_title").alias("t")).select("query_id", F.get("t", F.lit(0)).alias("a"), F.get("t", F.lit(1)).alias("b")).where("b is not null")
    spoilt = F.array(F.concat(F.substring("a", 2, 1), F.substring("a", 1, 1), F.substring("a", 3, 99)), F.concat(F.lit("x"), F.substring("b", 2, 99), F.lit("q")))
    rows = w.select("query_id", F.posexplode(spoilt).alias("place", "tok"))
    return spell.correct_typos(rows, cat.typo_model(spark, d)).select("query_id", F.array_join("toks", " ").alias("corrected"))


_MODES = ("balanced", " Aggressive ", "AGGRESSIVE", "fast", "")


@query(f"select event_id, case when lower(trim(m)) = 'aggressive' then 'aggressive' else 'balanced' end as mode from (select event_id, {list(_MODES)}[event_id % 6 + 1] as m from events)")
def mode_parse(spark: SparkSession, d: str) -> DataFrame:
    return cat.table(spark, d, "events").select("event_id", retrieve.mode_of(F.get(F.array(*map(F.lit, _MODES)), (F.col("event_id") % 6).cast("int"))).alias("mode"))


# ---------------------------------------------------------------- ranking

_BLEND = "round(0.8 * least(greatest(booster, 1.0), 3.0) + 0.2 * least(greatest(ridge, 1.0), 3.0), 6)"


@query(f"select product_uid, {_BLEND} as relevance_score from (select p_partkey as product_uid, p_size / 10.0 as booster, p_retailprice / 700.0 as ridge from part)")
def clip_blend(spark: SparkSession, d: str) -> DataFrame:
    x = cat.table(spark, d, "part").select(F.col("p_partkey").alias("product_uid"), (F.col("p_size") / 10.0).alias("booster"), (F.col("p_retailprice") / 700.0).alias("ridge"))
    return rank.blend(x).select("product_uid", "relevance_score")


def _scored(spark: SparkSession, d: str):
    c, index, q, booster, ridge, spaces = cat.trained(spark, d)
    found = written(retrieve.hybrid(q, index, c, N).select("query_id", "product_uid"), "candidates")
    return c, cat.model_inputs(found, q, c, index, spaces), booster, ridge


@query()
def ridge_rank(spark: SparkSession, d: str) -> DataFrame:
    c, full, _, ridge = _scored(spark, d)
    return retrieve.top_n(models.ridge_scores(ridge, full).select("query_id", "product_uid", F.round("ridge", 4).alias("score")), 10)


@query()
def gbt_rank(spark: SparkSession, d: str) -> DataFrame:
    c, full, booster, _ = _scored(spark, d)
    return retrieve.top_n(models.booster_scores(booster, full).select("query_id", "product_uid", F.round("booster", 4).alias("score")), 10)


@query()
def search_e2e(spark: SparkSession, d: str) -> DataFrame:
    return cat.search_end_to_end(spark, d)


@query()
def search_full(spark: SparkSession, d: str) -> DataFrame:
    """The whole search with candidates by vectors beside the lexical ones; a query has the vector of its number, if there is one."""
    c, index, q, booster, ridge, spaces = cat.trained(spark, d)
    v = cat.vectors(spark, d)
    asked = v.withColumnRenamed("product_uid", "query_id").join(q.select("query_id"), "query_id", "left_semi")
    known = v.join(c.select("product_uid"), "product_uid", "left_semi")
    return cat.search(c, index, q, booster, ridge, spaces, 10, 20, (asked, known))


# ---------------------------------------------------------------- image state, profile

_STATE_SQL = "st as (select p_partkey as product_uid, p_name as title, p_brand as brand, case p_partkey % 6 when 0 then 'pending' when 1 then 'no_image' when 2 then 'failed' else 'downloaded' end as status, case p_partkey % 6 when 0 then null when 3 then 'x/' || p_partkey || '.jpg' when 4 then null else '' end as local_path from part)"


def _state(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    status = F.when(k == 0, "pending").when(k == 1, "no_image").when(k == 2, "failed").otherwise("downloaded")
    path = F.when(k.isin(0, 4), None).when(k == 3, F.concat(F.lit("x/"), F.col("p_partkey").cast("string"), F.lit(".jpg"))).otherwise("")
    none = F.lit(None).cast("string")
    return cat.table(spark, d, "part").select(F.col("p_partkey").alias("product_uid"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), none.alias("image_url"), none.alias("source"), path.alias("local_path"), status.alias("status"), none.alias("error"), F.lit("2024-01-01 00:00:00").cast("timestamp").alias("updated_at"))


@query(f"with {_STATE_SQL} select product_uid, title, brand, status <> 'failed' as first_try from st where status <> 'downloaded' or local_path is null")
def image_pending(spark: SparkSession, d: str) -> DataFrame:
    first = im.pending(_state(spark, d)).select("product_uid", F.lit(True).alias("first_try"))
    return im.pending(_state(spark, d), retry_failed=True).join(first, "product_uid", "left").withColumn("first_try", F.coalesce("first_try", F.lit(False)))


@query(f"with {_STATE_SQL} select product_uid, local_path from st where status = 'downloaded' and local_path is not null and local_path <> ''")
def image_map(spark: SparkSession, d: str) -> DataFrame:
    return im.image_map(_state(spark, d))


@query(f"with {_STATE_SQL} select status, count(*) as n from st group by status")
def image_status(spark: SparkSession, d: str) -> DataFrame:
    return im.status_counts(_state(spark, d))


@query(
    f"""with {_STATE_SQL}, old as (select * from st where product_uid % 2 = 0), cat_ as (select p_partkey as product_uid, 'new ' || p_name as title, p_brand as brand from part where p_partkey % 3 = 0)
 select coalesce(o.product_uid, c.product_uid) as product_uid, coalesce(c.title, o.title) as title, coalesce(c.brand, o.brand) as brand, o.local_path, coalesce(o.status, 'pending') as status, c.product_uid is not null as touched from old o full outer join cat_ c on o.product_uid = c.product_uid"""
)
def image_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = _state(spark, d).where("product_uid % 2 = 0")
    new = cat.titles(spark, d).where("product_uid % 3 = 0").select("product_uid", F.concat(F.lit("new "), "product_title").alias("product_title")).join(co.brands(cat.attributes(spark, d)), "product_uid")
    out = im.upsert(old, new, F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return out.select("product_uid", "title", "brand", "local_path", "status", (F.year("updated_at") * 100 + F.month("updated_at") == 202406).alias("touched"))


@query(
    f"""with {_STATE_SQL}, res as (select p_partkey as product_uid, case when p_partkey % 2 = 0 then 'downloaded' else 'failed' end as status, 'u' || p_partkey as image_url from part where p_partkey % 4 < 2)
 select st.product_uid, coalesce(res.status, st.status) as status, res.image_url, case when res.product_uid is null then st.local_path else 'p' end as local_path, res.product_uid is not null as touched from st left join res using (product_uid)"""
)
def image_update(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("product_uid")
    done = cat.titles(spark, d).where("product_uid % 4 < 2").select("product_uid", F.when(key % 2 == 0, "downloaded").otherwise("failed").alias("status"), F.concat(F.lit("u"), key.cast("string")).alias("image_url"), F.lit("s").alias("source"), F.lit("p").alias("local_path"), F.lit("").alias("error"))
    out = im.update_results(_state(spark, d), done, F.lit("2024-06-01 00:00:00").cast("timestamp"))
    return out.select("product_uid", "status", "image_url", "local_path", (F.year("updated_at") * 100 + F.month("updated_at") == 202406).alias("touched"))


_SOLD_SQL = "sold as (select l_partkey as product_uid, count(*) as n from lineitem join part on l_partkey = p_partkey group by 1)"


def _sold(spark: SparkSession, d: str) -> DataFrame:
    return cat.table(spark, d, "lineitem").select(F.col("l_partkey").alias("product_uid")).join(cat.titles(spark, d), "product_uid")


def _cased(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of which every third product's brand is named in lower case."""
    return cat.attributes(spark, d).withColumn("name", F.when(F.col("product_uid") % 3 == 0, F.lower("name")).otherwise(F.col("name")))


@query(f"with {_SOLD_SQL} select product_uid, p_name as product_title, case when p_partkey % 3 = 0 then '' else p_brand end as brand from sold join part on product_uid = p_partkey")
def image_catalogue(spark: SparkSession, d: str) -> DataFrame:
    return im.image_catalogue(_sold(spark, d), _cased(spark, d))


@query(f"with {_SOLD_SQL}, both_ as (select product_uid, n from sold union all select p_partkey, 1 from part), top as (select product_uid, sum(n) as n from both_ group by 1 order by n desc, product_uid limit 25) select product_uid, p_name as product_title, case when p_partkey % 3 = 0 then '' else p_brand end as brand from top join part on product_uid = p_partkey")
def image_catalogue_top(spark: SparkSession, d: str) -> DataFrame:
    """The 25 most frequent products of two title tables laid end to end."""
    return im.image_catalogue(_sold(spark, d).unionByName(cat.titles(spark, d)), _cased(spark, d), 25)


@query(f"with {_STATE_SQL} select p_partkey as product_uid, p_name as product_title, local_path from part left join (select product_uid, local_path from st where status = 'downloaded' and local_path is not null and local_path <> '') on product_uid = p_partkey")
def image_join(spark: SparkSession, d: str) -> DataFrame:
    return im.with_images(cat.titles(spark, d).select("product_uid", "product_title"), im.image_map(_state(spark, d)))


_LONG = "repeat(p_name || ' ', 60)"


@query(
    f"""select p_partkey as product_uid, case when p_partkey % 4 = 0 then 'downloaded' when p_size % 3 > 0 then 'failed' when p_partkey % 5 = 0 then 'failed' else 'no_image' end as status,
 case when p_partkey % 4 = 0 then '' when p_size % 3 > 0 then left(case when p_partkey % 7 = 0 then {_LONG} else 'Image download failed' end, 300) when p_partkey % 5 = 0 then left({_LONG}, 300) else 'No image URL found' end as error from part"""
)
def image_outcome(spark: SparkSession, d: str) -> DataFrame:
    key, said = F.col("p_partkey"), F.repeat(F.concat("p_name", F.lit(" ")), F.lit(60))
    result = im.outcome(F.col("p_size") % 3, key % 4 == 0, F.when(key % 5 == 0, said), F.when(key % 7 == 0, said))
    return cat.table(spark, d, "part").select(key.alias("product_uid"), result.alias("x")).select("product_uid", "x.status", "x.error")


@query(f"with {_STATE_SQL}, n as (select count(*) as done, count(*) filter (where status = 'downloaded') as downloaded, count(*) filter (where status = 'no_image') as no_image, count(*) filter (where status = 'failed') as failed from st where product_uid % 2 = 0) select *, done / 8.0 as rate, (100000 - done) / (done / 8.0) as seconds_left from n")
def fetch_progress(spark: SparkSession, d: str) -> DataFrame:
    return im.progress(_state(spark, d).where("product_uid % 2 = 0"), 100000, 8.0)


# ---------------------------------------------------------------- scalars

_NUMBERS, _FLAGS = ("12", " 7 ", "x", "1.5", ""), ("TRUE", " yes ", "0", "on", "off")


@query(
    f"""select event_id, coalesce(case when regexp_full_match(trim(a), '[0-9]+') then cast(trim(a) as integer) end, -1) as number, coalesce(lower(trim(b)) in ('1', 'true', 'yes', 'on'), false) as flag,
 case when s < 0 then 'unknown' when s >= 3600 then (s // 3600) || 'h' || lpad(cast(s % 3600 // 60 as varchar), 2, '0') || 'm' when s >= 60 then (s // 60) || 'm' || lpad(cast(s % 60 as varchar), 2, '0') || 's' else s || 's' end as lasted, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as at_
 from (select *, {list(_NUMBERS)}[event_id % 6 + 1] as a, {list(_FLAGS)}[event_id % 6 + 1] as b, event_id * 7 - 100 as s from events)"""
)
def scalar_parse(spark: SparkSession, d: str) -> DataFrame:
    at = (F.col("event_id") % 6).cast("int")
    pick = lambda values: F.get(F.array(*map(F.lit, values)), at)
    return cat.table(spark, d, "events").select("event_id", text.parse_int(pick(_NUMBERS), -1).alias("number"), text.parse_flag(pick(_FLAGS)).alias("flag"), text.format_duration(F.col("event_id") * 7 - 100).alias("lasted"), text.iso_time(F.col("ts").cast("timestamp")).alias("at_"))


@query("""select doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as escaped, text as again, replace(url_encode(text), '%2F', '/') as quoted from documents""")
def scalar_html(spark: SparkSession, d: str) -> DataFrame:
    return cat.table(spark, d, "documents").select("doc_id", text.html_escape(F.col("text")).alias("escaped"), text.html_unescape(text.html_escape(F.col("text"))).alias("again"), text.url_quote(F.col("text")).alias("quoted"))


_HREF = 'href="([^"]*)"'


@query(
    f"""with u as (select page_id, url, regexp_replace(url, '^https:', 'http:') as plain, list_filter(list_transform(regexp_extract_all(html || '<a href="http://x.test/?a=1&amp;b=2">', '{_HREF}', 1), lambda x: trim(replace(x, '&amp;', '&'))), lambda x: regexp_matches(x, '^https?://')) as l from pages)
 select page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:5], ' ') as found, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || '/' as referer, plain || case when starts_with(plain, 'http://example.com/') then ' https://example.com/' || substr(plain, 20) else '' end as tried from u"""
)
def scalar_url(spark: SparkSession, d: str) -> DataFrame:
    plain = F.regexp_replace("url", "^https:", "http:")
    html = F.concat("html", F.lit('<a href="http://x.test/?a=1&amp;b=2">'))
    return cat.table(spark, d, "pages").select("page_id", F.array_join(text.found_urls(html, _HREF, 1, 5), " ").alias("found"), text.referer(F.col("url")).alias("referer"), F.array_join(text.https_variant(plain, "example.com"), " ").alias("tried"))


@query("select p_partkey, to_json({'texts': [p_name, p_type], 'batch_size': 64, 'normalize_embeddings': true}) as request, 'data:image/' || case p_partkey % 3 when 0 then 'png' when 1 then 'webp' else 'jpeg' end || ';base64,' || to_base64(encode(p_name)) as uri from part")
def scalar_json(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("a/b"), F.when(F.col("p_partkey") % 3 == 0, ".PNG").when(F.col("p_partkey") % 3 == 1, ".webp").otherwise(""))
    return cat.table(spark, d, "part").select("p_partkey", tables.embedding_request(F.array("p_name", "p_type")).alias("request"), tables.data_uri(F.encode("p_name", "UTF-8"), path).alias("uri"))


# ---------------------------------------------------------------- query profile


@query("select count(*) as query_count, round(avg(value), 6) as avg_latency, round(quantile_cont(value, 0.95), 6) as p95_latency, max(value) as max_latency, arg_max(event_type, (ts, event_id)) as last_query from events")
def profile_summary(spark: SparkSession, d: str) -> DataFrame:
    return profile.summary(cat.table(spark, d, "events"))


@query("select event_id, event_type, value from events order by ts desc, event_id desc limit 300")
def profile_ring(spark: SparkSession, d: str) -> DataFrame:
    return profile.newest(cat.table(spark, d, "events")).select("event_id", "event_type", "value")


@query("select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type as mode, count(*) as n, round(avg(value), 6) as avg_latency, max(value) as max_latency from events group by all")
def profile_windows(spark: SparkSession, d: str) -> DataFrame:
    """The stream's aggregation over the table; the stream itself is tested on files."""
    return windowed(cat.table(spark, d, "events")).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query("select page_id, coalesce(nullif(regexp_extract(lower(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1)), '(\\.jpg|\\.jpeg|\\.png|\\.webp|\\.gif)$', 1), ''), '.jpg') as by_url, case page_id % 3 when 0 then '.png' when 1 then '.webp' else coalesce(nullif(regexp_extract(lower(regexp_extract(url, '^[a-z]+://[^/]*([^?#]*)', 1)), '(\\.jpg|\\.jpeg|\\.png|\\.webp|\\.gif)$', 1), ''), '.jpg') end as by_type from pages")
def url_extension(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 3 == 0, "image/PNG; q=1").when(F.col("page_id") % 3 == 1, "image/webp").otherwise("text/html")
    return cat.table(spark, d, "pages").select("page_id", text.image_extension(F.lit(None).cast("string"), F.col("url")).alias("by_url"), text.image_extension(kind, F.col("url")).alias("by_type"))


_B = "trim(p_name || ' ' || b)"
_LEAD = lambda x, n: f"trim(array_to_string((list_filter(string_split_regex(regexp_replace({x}, '[^A-Za-z0-9 ]+', ' ', 'g'), ' +'), lambda y: y <> ''))[1:{n}], ' '))"
_FORMS = [f"base || ' product photo'", "base || ' home depot product image'", "base", "p_name", _LEAD("base", 8), _LEAD("p_name", 6), _LEAD("p_name", 4), "b", f"b || ' ' || {_LEAD('p_name', 4)}"]


@query(f"with x as (select p_partkey, p_name, p_brand as b, case when contains(lower(p_name), lower(p_brand)) then p_name else {_B.replace(' b)', ' p_brand)')} end as base from part), y as (select p_partkey, list_filter([{', '.join(_FORMS)}], lambda z: z <> '') as l from x) select p_partkey, array_to_string(list_filter(l, lambda z, i: list_position(l, z) = i), '|') as variants from y")
def query_variants(spark: SparkSession, d: str) -> DataFrame:
    return cat.table(spark, d, "part").select("p_partkey", F.array_join(text.query_variants(F.col("p_name"), F.col("p_brand")), "|").alias("variants"))

