"""The contract queries of this subpackage, and parts of their results that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.bagminhash import op5_near_duplicates
from lodestone.llm.html_crf import op1_html_extraction
from lodestone.llm.interpolation import op7_lm_scoring
from lodestone.llm.language import UNKNOWN, op3_language_id
from lodestone.llm.mixing import DOMAINS, TARGETS, op8_domain_mixing
from lodestone.llm.outliers import op6_robust_outliers
from lodestone.llm.packing import SEQUENCE, op2_packing
from lodestone.llm.quality import op4_quality_classifier
from lodestone.llm.secrets import op10_secret_scan
from lodestone.llm.tiff import op9_tiff_media

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_packing": op2_packing,
    "op3_language_id": op3_language_id,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_robust_outliers": op6_robust_outliers,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_domain_mixing": op8_domain_mixing,
    "op9_tiff_media": op9_tiff_media,
    "op10_secret_scan": op10_secret_scan,
}

ORACLES: dict[str, str] = {}

#: crc32 of a text of ASCII, as a macro over its characters.
_CRC = """crc_table as (select list_transform(range(256), lambda i: list_reduce(list_prepend(cast(i as bigint), cast(range(8) as bigint[])), lambda a, k: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as ct)"""


def _fold(buckets: int) -> str:
    """crc32(doc_id as text) modulo buckets; needs the CTE crc_table."""
    steps = "list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(doc_id as varchar), ''), lambda c: cast(ascii(c) as bigint))), lambda a, b: xor(ct[(xor(a, b) & 255) + 1], a >> 8))"
    return f"(xor({steps}, 4294967295) % {buckets})"


_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


def _part(sql: str):
    """Registers a part of an operator's result under the function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@_part("select doc_id, true as whole, true as within from documents")
def packing_whole(spark: SparkSession, d: str) -> DataFrame:
    """Every document's pieces are its tokens, each once, and no piece reaches beyond its sequence."""
    pieces = op2_packing(spark, d).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"), F.max(F.col("start") + F.col("length")).alias("end"), F.max(F.col("offset") + F.col("length")).alias("reach"))
    return pieces.select("doc_id", ((F.col("n") == F.col("all")) & (F.col("end") == F.col("all"))).alias("whole"), (F.col("reach") <= SEQUENCE).alias("within"))


@_part("select 0 as gaps, 0 as overfull, 0 as open_beyond_groups")
def packing_gapless(spark: SparkSession, d: str) -> DataFrame:
    """Sequences without gaps, of at most SEQUENCE tokens; at most one in 50 is not full."""
    seq = op2_packing(spark, d).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"), F.min("offset").alias("first"))
    return seq.agg(F.count_if((F.col("n") != F.col("end")) | (F.col("first") != 0)).cast("int").alias("gaps"), F.count_if(F.col("n") > SEQUENCE).cast("int").alias("overfull"), (F.count_if(F.col("n") < SEQUENCE) > 8 + F.count("*") / 50).cast("int").alias("open_beyond_groups"))


@_part(f"with {_CRC} select doc_id, {_fold(4)} = 2 as held_out, not regexp_matches(coalesce(text, ''), '\\p{{L}}') as unknown from documents, crc_table")
def language_keys(spark: SparkSession, d: str) -> DataFrame:
    return op3_language_id(spark, d).select("doc_id", "held_out", (F.col("lang_pred") == UNKNOWN).alias("unknown"))


@_part(f"with {_CRC} select doc_id, {_fold(5)} = 0 as held_out, true as valid from documents, crc_table")
def quality_keys(spark: SparkSession, d: str) -> DataFrame:
    x = op4_quality_classifier(spark, d)
    return x.select("doc_id", "held_out", (F.col("score").between(0, 1) & (F.col("predicted") == (F.col("score") >= 0.3).cast("int"))).alias("valid"))


@_part(
    f"""with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents), w as (select *, {_WORDS.format('t')} as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
 g as (select rid, i, count(*) over (partition by rid, w[i], w[i + 1], w[i + 2]) as n from (select rid, w, unnest(range(1, len(w) - 1)) as i from w where len(w) > 2)),
 c as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from g where n > 1) group by rid),
 b as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words from w left join c using (rid))
 select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b"""
)
def outlier_base(spark: SparkSession, d: str) -> DataFrame:
    return op6_robust_outliers(spark, d).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


@_part(
    f"""with {_CRC}, d as (select row_number() over () as rid, doc_id, {_fold(10)} = 0 as held_out, list_append({_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, ' ') as w from documents, crc_table),
 tok as (select rid, held_out, unnest(w) as t from d), c as (select t, count(*) as c from tok where not held_out group by t), n as (select sum(c) as n, count(*) as v from c)
 select d.doc_id, d.held_out, len(d.w) as n_tokens, count(c.c) as n_known, cast(any_value(n.n) as bigint) as train_tokens, round(sum(log10((coalesce(c.c, 0) + 0.1) / (n.n + 0.1 * (n.v + 1)))), 4) as base_score
 from d join tok on tok.rid = d.rid left join c on c.t = tok.t, n group by d.rid, d.doc_id, d.held_out, d.w"""
)
def lm_base(spark: SparkSession, d: str) -> DataFrame:
    return op7_lm_scoring(spark, d).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


@_part(f"select * from (values {', '.join(f"('{x}', true)" for x in DOMAINS)}) v(domain, met)")
def mixing_targets(spark: SparkSession, d: str) -> DataFrame:
    """Whether the expected tokens of each domain are within 1 % of its target."""
    got = op8_domain_mixing(spark, d)
    total = F.sum("tokens")
    met = F.array(*(F.struct(F.lit(x).alias("domain"), (F.abs(F.sum(F.col("rate") * F.col("tokens") * F.col(f"p_{x}")) / total / (TARGETS[x] / sum(TARGETS.values())) - 1) < 0.01).alias("met")) for x in DOMAINS))
    return got.agg(met.alias("x")).select(F.explode("x").alias("x")).select("x.domain", "x.met")


@_part(
    """with d as (select doc_id, coalesce(text, '') as t from documents), p as (select doc_id, strlen(t) as n, t || repeat(chr(0), case when t = '' then 64 else (64 - strlen(t) % 64) % 64 end) as p from d)
 select doc_id, n as n_bytes, strlen(p) as payload_bytes, sha256(p) as payload_sha256 from p"""
)
def tiff_payload(spark: SparkSession, d: str) -> DataFrame:
    return op9_tiff_media(spark, d).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


@_part(
    r"""select doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 8)) as n_assign,
 len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) as n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 32)) as n_hex from documents"""
)
def secret_counts(spark: SparkSession, d: str) -> DataFrame:
    return op10_secret_scan(spark, d).select("doc_id", "n_assign", "n_access", "n_hex")
