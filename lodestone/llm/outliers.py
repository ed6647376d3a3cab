"""Robust multivariate outliers, in DataFrame expressions only.

Statistics of each whole text are transformed to a vector; for each language and source the
minimum-covariance-determinant estimate of centre and scatter is found by concentration steps
(start at coordinate-wise median and MAD; keep the h nearest by Mahalanobis distance; re-estimate;
repeat), and texts whose robust distance is beyond a chi-square quantile are rejected.

A group's sums are partial aggregates, its distances need one small row of the group, so a
source with a third of all rows is no burden to any task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import written

#: Share of a group that the estimate rests on.
SUBSET = 0.75
STEPS = 4
#: Groups of fewer texts that pass the base rules are judged by the estimate of their language, or else of the whole table.
LEAST_GROUP = 50
#: Groups whose estimates are broadcast: at most so many, of 25 numbers each. Beyond, a group's rows are dealt to SALTS tasks.
MAX_BROADCAST, SALTS = 20_000, 16
#: Ridge on the scatter: a tenth in the root of a ratio is no evidence, and constant statistics stay regular.
RIDGE = 1e-2
VECTOR = ("x0", "x1", "x2", "x3", "x4")
#: Chi-square quantiles of 5 degrees of freedom, at 0.75 (the subset) and 1 - 1e-9 (the cut: clean texts stay): fixed values.
CHI_SUBSET, CHI_CUT = 6.62568, 50.6922
MIN_WORDS, MAX_REPEAT = 50, 50


def words_column(text: Column) -> Column:
    """Runs of [^\\x20\\x09-\\x0D]; null text: none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]"), "")


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Repeated windows are found by sorting window hashes within the row: O(n log n), no explode.
    Temporary columns are prefixed with __; those of the input must not be.
    """
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = docs.withColumn("__w", words_column(F.col(f"`{text}`").cast("string"))).withColumn("__l", lines)
    df = df.withColumn("n_words", F.size("__w").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long"))
    df = df.withColumn("n_symbols", F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"))
    # hashes of 3-word windows; the separator keeps word borders apart
    window = lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2))
    none = F.array().cast("array<bigint>")
    df = df.withColumn("__h", F.when(F.col("n_words") < 4, none).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size("__w") - 3, F.lit(0))), window)))
    # only rows with a repeated window go on to the sort
    some = F.size(F.array_distinct("__h")) < F.size("__h")
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("__s", F.when(some, F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(empty))
    same = lambda x, i: F.get("__s", i - 1)["h"].eqNullSafe(x["h"]) | F.get("__s", i + 1)["h"].eqNullSafe(x["h"])
    df = df.withColumn("__r", F.transform(F.filter("__s", same), lambda x: x["i"]))
    covered = F.array_distinct(F.concat("__r", F.transform("__r", lambda i: i + 1), F.transform("__r", lambda i: i + 2)))
    df = df.withColumn("n_repeat_words", F.size(covered).cast("long"))
    return df.drop("__w", "__l", "__h", "__s", "__r")


def transformed() -> list[Column]:
    """The statistic vector: logarithms and square roots bring ratios and counts near to normal."""
    n = F.greatest("n_words", F.lit(1)).cast("double")
    return [
        F.log1p(F.col("n_words").cast("double")),
        F.col("word_chars") / n,
        F.sqrt(F.col("n_symbols") / n),
        F.sqrt(F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
    ]


def _beside(points: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """points joined with a written table of groups. Few groups are broadcast; of many each is laid out SALTS times, so that a hot group's rows are spread."""
    if groups.count() <= MAX_BROADCAST:
        return points.join(F.broadcast(groups), keys, how)
    salted = groups.withColumn("g_salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    dealt = points.withColumn("g_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*keys, "g_salt"], how).drop("g_salt")


def _distance(centre, scatter) -> Column:
    """Squared Mahalanobis distance of VECTOR by the Cholesky factor of the scatter, unrolled.

    centre: columns m0.., factor: columns l{i}{j} and the inverse diagonal.
    """
    y: list[Column] = []
    for i, x in enumerate(VECTOR):
        rest = F.col(x) - centre(i)
        for j in range(i):
            rest = rest - scatter(i, j) * y[j]
        y.append(rest / scatter(i, i))
    return reduce(lambda a, b: a + b, [v * v for v in y])


def _factored(groups: DataFrame, keys: list[str]) -> DataFrame:
    """groups with columns m{i} and c{i}{j} -> m{i} and the Cholesky factor l{i}{j}."""
    df = groups
    d = len(VECTOR)
    for i in range(d):
        for j in range(i + 1):
            s = F.col(f"c{i}{j}") + (F.lit(RIDGE) if i == j else F.lit(0.0))
            for k in range(j):
                s = s - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(s, F.lit(RIDGE / 10))) if i == j else s / F.col(f"l{j}{j}"))
    return df.select(*keys, *(f"m{i}" for i in range(d)), *(f"l{i}{j}" for i in range(d) for j in range(i + 1)))


def _with_distance(points: DataFrame, factors: DataFrame, keys: list[str]) -> DataFrame:
    """points with d2; where a group has no estimate d2 is null."""
    joined = _beside(points, factors, keys, "left")
    return joined.withColumn("d2", _distance(lambda i: F.col(f"m{i}"), lambda i, j: F.col(f"l{i}{j}"))).select(*points.columns, "d2")


def _moments(points: DataFrame, keys: list[str]) -> DataFrame:
    d = len(VECTOR)
    sums = [F.count("*").alias("n")]
    sums += [F.avg(VECTOR[i]).alias(f"m{i}") for i in range(d)]
    sums += [F.covar_pop(VECTOR[i], VECTOR[j]).alias(f"c{i}{j}") for i in range(d) for j in range(i + 1)]
    return points.groupBy(*keys).agg(*sums)


def mcd(points: DataFrame, keys: list[str], steps: int = STEPS, subset: float = SUBSET) -> DataFrame:
    """Centre and Cholesky factor of each group's minimum-covariance-determinant estimate.

    points: keys (not null) and VECTOR. The scatter is made consistent by the median distance
    against the chi-square median of the subset share.
    """
    d = len(VECTOR)
    middle = points.groupBy(*keys).agg(*(F.percentile_approx(x, 0.5, 1000).alias(f"m{i}") for i, x in enumerate(VECTOR)), F.count("*").alias("n")).where(F.col("n") >= LEAST_GROUP)
    middle = written(middle, "middle")
    off = _beside(points, middle.select(*keys, *(f"m{i}" for i in range(d))), keys)
    spread = off.groupBy(*keys).agg(*(F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), 0.5, 1000).alias(f"s{i}") for i, x in enumerate(VECTOR)))
    start = middle.join(spread, keys).select(*keys, *(f"m{i}" for i in range(d)), *((F.pow(1.4826 * F.col(f"s{i}"), 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(d) for j in range(i + 1)))
    factors = written(_factored(start, keys), "factors")
    for step in range(steps + 1):
        near = _with_distance(points, factors, keys).where("d2 is not null")
        cut = written(near.groupBy(*keys).agg(F.percentile_approx("d2", subset, 1000).alias("cut")), "cut")
        if step == steps:  # consistency: the h-th distance is where it belongs for normal data
            scale = F.greatest(F.sqrt(F.col("cut") / CHI_SUBSET), F.lit(1e-6))
            return written(factors.join(cut, keys).select(*keys, *(f"m{i}" for i in range(d)), *((F.col(f"l{i}{j}") * scale).alias(f"l{i}{j}") for i in range(d) for j in range(i + 1))), "mcd")
        kept = _beside(near, cut, keys).where("d2 <= cut")
        factors = written(_factored(_moments(kept, keys), keys), "factors")
    raise AssertionError


def _estimates(points: DataFrame, keys: list[str], wider: list[str]) -> DataFrame:
    """Centre and factor for every group of points by keys: its own estimate, or where it is small that by the keys `wider`, or else that of all points."""
    own = mcd(points, keys)
    small = written(points.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") < LEAST_GROUP).select(*keys), "small")
    if small.isEmpty():
        return own
    some = _beside(points, written(small.select(*wider).distinct(), "wider"), wider, "left_semi")
    pooled = mcd(some, wider)
    out = own.unionByName(small.join(pooled, wider).select(*own.columns))
    rest = written(small.join(pooled, wider, "left_anti"), "rest")
    if not rest.isEmpty():
        whole = mcd(points.withColumn("g_all", F.lit(0)), ["g_all"]).drop("g_all")
        out = out.unionByName(rest.crossJoin(F.broadcast(whole)).select(*own.columns))
    return written(out, "estimates")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept.

    docs: doc_id, text, lang, source; a null lang or source is a group of its own. Texts that fail
    the base rules (under 50 words, or over half of the words in repeated windows) are rejected
    and not estimated from. Groups of fewer than LEAST_GROUP others are judged by the estimate of
    their language, or of the whole table where the language has fewer too; a table of fewer has
    none, and null distances. Null and empty texts have no words and fail the base rules; texts are
    read whole whatever their length. Repeated rows count once each, rows of equal statistics get
    equal verdicts; an empty table gives no rows. Extra columns are not read.
    """
    src = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("g_lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("g_source"), F.col("lang").isNull().alias("g_no_lang"), F.col("source").isNull().alias("g_no_source"))
    counted = with_counts(src).drop("text")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    counted = counted.withColumn("base_failed", failed)
    table = written(counted.select(*counted.columns, *(c.alias(x) for x, c in zip(VECTOR, transformed(), strict=True))), "counts")
    keys = ["g_lang", "g_source", "g_no_lang", "g_no_source"]
    points = table.where("not base_failed").select(*keys, *VECTOR)
    out = _with_distance(table, _estimates(points, keys, ["g_lang", "g_no_lang"]), keys)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.sqrt("d2").alias("distance"), (~F.col("base_failed") & F.coalesce(F.col("d2") <= CHI_CUT, F.lit(True))).alias("kept"))


def op6_robust_outliers(spark, sf_dir: str) -> DataFrame:
    """Base rules and the robust-outlier verdict for every document."""
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
