"""Mixing documents to target domain weights by soft membership, in DataFrame expressions only.

A softmax regression, fitted on a bounded sample of the labelled table, gives each document a
posterior over domains from statistics of its text and from the words that tell domains apart.
With t_d the share of tokens of document d and p_dk its posteriors, non-negative rates r_d solve

    min  1/2 sum_k ( (sum_d r_d t_d p_dk - T_k) / T_k )^2  +  SOFT/2 sum_d t_d ( r_d - 1 )^2

by projected gradient: rates are 1 less a gradient that is accumulated in K multipliers, projected
onto r >= 0 in every row. A step is one aggregation over the table of K expected totals and of the
K x K Gram matrix of the rows with r > 0, which scales the gradient; only these sums reach the
driver, and no state is kept but the multipliers. Steps end where the gradient vanishes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import bounded_ids, written

TRAIN_ROWS = 4000
#: Words that tell domains apart: so many at most.
LEXICON = 96
#: A word must occur in so many sampled documents.
SUPPORT = 8
EVIDENCE = 30.0
PENALTY = 1.0
ROUNDS = 600
#: Weight of keeping rates near 1 against the relative misses of the targets.
SOFT = 1e-5
#: Steps end at a gradient of the relative misses below this; beyond MOST_STEPS is an error.
TOLERANCE = 1e-7
MOST_STEPS = 200
DOMAINS = ("good", "low", "toxic")
TARGETS = {"good": 0.92, "low": 0.06, "toxic": 0.02}
STATS = ("log_words", "word_length", "symbols", "upper", "distinct", "same_lines")


def domain_column() -> Column:
    """The domain of a labelled row: low quality, else toxic, else good; null labels count as 1 and 0."""
    return F.when(F.coalesce(F.col("quality"), F.lit(1)) == 0, "low").when(F.coalesce(F.col("toxic"), F.lit(0)) == 1, "toxic").otherwise("good")


def with_features(docs: DataFrame) -> DataFrame:
    """docs with __words (distinct runs of letters, lower case), tokens and STATS. A null text counts as empty.

    Temporary columns are prefixed with __; callers pass columns of their own choice.
    """
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.withColumn("__all", F.array_remove(F.split(F.lower(t), "[\\x20\\x09-\\x0D]"), "")).withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    df = df.withColumn("__words", F.array_distinct(F.split(F.lower(t), "[^\\p{L}]+"))).withColumn("tokens", F.size("__all").cast("long"))
    n, chars = F.greatest("tokens", F.lit(1)).cast("double"), F.greatest(F.length(t), F.lit(1)).cast("double")
    return df.withColumns({
        "log_words": F.log1p(F.col("tokens").cast("double")),
        "word_length": F.length(t) / n,
        "symbols": F.sqrt(F.regexp_count(t, F.lit("[#*$%&|<>]")) / chars),
        "upper": F.sqrt(F.regexp_count(t, F.lit("[A-Z]")) / chars),
        "distinct": F.size(F.array_distinct("__all")) / n,
        "same_lines": F.sqrt(1 - F.size(F.array_distinct("__lines")) / F.greatest(F.size("__lines"), F.lit(1))),
    }).drop("__all", "__lines")


def _adds(k: int):
    return lambda total, weights: total + F.get(weights, F.lit(k))


@dataclass
class Membership:
    """Log-odds of a softmax regression as expressions over with_features(): for each domain a constant, a slope of each of STATS and of each word."""

    constant: list[float]
    stats: dict[str, list[float]]
    words: dict[str, list[float]]

    @property
    def blind(self) -> bool:
        """Learned from nothing."""
        return not any(map(any, (self.constant, *self.stats.values(), *self.words.values())))

    def posteriors(self, df: DataFrame) -> DataFrame:
        """df, with columns of with_features(), and p_<domain>, which add up to 1."""
        names = F.array(*map(F.lit, sorted(self.words)))
        table = F.array(*(F.array(*(F.lit(v) for v in self.words[w])) for w in sorted(self.words)))
        if self.words:
            df = df.withColumn("__said", F.transform(F.array_intersect("__words", names), lambda w: F.get(table, F.array_position(names, w).cast("int") - 1)))
        for k, d in enumerate(DOMAINS):
            x = reduce(lambda a, b: a + b, (F.col(s) * self.stats[s][k] for s in STATS), F.lit(self.constant[k]))
            df = df.withColumn(f"__log_{d}", x + F.aggregate("__said", F.lit(0.0), _adds(k)) if self.words else x)
        df = df.withColumn("__top", F.greatest(*(F.col(f"__log_{d}") for d in DOMAINS)))
        df = df.withColumns({f"__e_{d}": F.exp(F.col(f"__log_{d}") - F.col("__top")) for d in DOMAINS})
        total = reduce(lambda a, b: a + b, (F.col(f"__e_{d}") for d in DOMAINS))
        return df.withColumns({f"p_{d}": F.col(f"__e_{d}") / total for d in DOMAINS})


def softmax_regression(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> np.ndarray:
    """(1 + features, domains) weights of least penalised log-loss over x, whose columns are put on one scale; the first row is the constant."""
    scale = x.std(axis=0)
    mean, scale = x.mean(axis=0), np.where(scale > 0, scale, 1.0)
    z = np.concatenate((np.ones((len(x), 1)), (x - mean) / scale), axis=1)
    target = np.eye(len(DOMAINS))[y]
    ridge = np.full((z.shape[1], 1), penalty / len(x))
    ridge[0] = 1e-6
    rate = 1 / (np.linalg.norm(z, 2) ** 2 / (2 * len(x)) + penalty / len(x))
    w = ahead = np.zeros((z.shape[1], len(DOMAINS)))
    pace = 1.0
    for _ in range(rounds):
        e = z @ ahead
        p = np.exp(e - e.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - rate * (z.T @ (p - target) / len(x) + ridge * ahead)
        following = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead, w, pace = new + (pace - 1) / following * (new - w), new, following
    w[1:] /= scale[:, None]
    w[0] -= mean @ w[1:]
    return w


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Membership:
    """labels: doc_id, quality, toxic. At most `rows` of them are used, of several labels of a document the worse.

    Without labelled documents all domains are alike. A domain without rows gets next to nothing.
    Of words that tell as much the first by name is taken.
    """
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).select("doc_id", domain_column().alias("domain"))
    sample = F.broadcast(bounded_ids(known, rows, 8).withColumnRenamed("doc_id", "label_id"))  # at most `rows` rows
    joined = docs.select("doc_id", "text").join(sample, F.col("doc_id") == F.col("label_id")).dropDuplicates(["doc_id"])
    marked = written(with_features(joined).select("doc_id", "domain", "__words", *STATS), "labelled")
    count = {r["domain"]: r["n"] for r in marked.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = sum(count.values())
    if not n:
        return Membership([0.0] * len(DOMAINS), {s: [0.0] * len(DOMAINS) for s in STATS}, {})
    seen = marked.select("domain", F.explode("__words").alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n"), *(F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS)).where(F.col("n") >= SUPPORT)
    # likelihood-ratio statistic of word against domain: chance alone keeps it under EVIDENCE
    some = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
    statistic = F.lit(0.0)
    for d in DOMAINS:
        if count.get(d):
            held, share = F.col(d).cast("double"), count[d] / n
            statistic = statistic + 2 * (some(held, F.col("n") * share) + some(count[d] - held, F.greatest((n - F.col("n")) * share, F.lit(1e-9))))
    top = seen.select("word", statistic.alias("apart")).where(F.col("apart") >= EVIDENCE).orderBy(F.desc("apart"), "word").limit(LEXICON).collect()
    lexicon = sorted(r["word"] for r in top)
    said = F.array_intersect("__words", F.array(*map(F.lit, lexicon))) if lexicon else F.array().cast("array<string>")
    got = marked.select("domain", *STATS, said.alias("said")).orderBy("doc_id").collect()  # at most `rows` rows
    x = np.zeros((len(got), len(STATS) + len(lexicon)))
    place = {w: len(STATS) + i for i, w in enumerate(lexicon)}
    for i, r in enumerate(got):
        x[i, : len(STATS)] = [r[s] for s in STATS]
        x[i, [place[w] for w in r["said"]]] = 1
    w = softmax_regression(x, np.array([DOMAINS.index(r["domain"]) for r in got]))
    return Membership(w[0].tolist(), {s: w[1 + i].tolist() for i, s in enumerate(STATS)}, {v: w[1 + place[v]].tolist() for v in lexicon})


def memberships(docs: DataFrame, model: Membership) -> DataFrame:
    """doc_id, tokens, p_<domain>..., written to the shared folder."""
    df = model.posteriors(with_features(docs.select("doc_id", "text")))
    return written(df.select("doc_id", "tokens", *(f"p_{d}" for d in DOMAINS)), "membership")


@dataclass
class Rates:
    """A solution: rates follow from a row's posteriors and one multiplier for each domain."""

    multipliers: list[float]
    shares: list[float]  # expected shares of the budget that the rates reach
    steps: int

    def column(self) -> Column:
        return F.greatest(F.lit(0.0), reduce(lambda a, b: a - b, (F.col(f"p_{d}") * c for d, c in zip(DOMAINS, self.multipliers, strict=True)), F.lit(1.0)))


def fit_rates(members: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None) -> Rates:
    """Multipliers of the rates that bring members (tokens, p_<domain>) to the targets.

    targets: each domain's share of the budget; budget: tokens, by default as many as there are.
    Targets out of reach (a domain without documents) are met as nearly as least squares allow.
    RuntimeError if MOST_STEPS do not bring the gradient under TOLERANCE.
    """
    k = len(DOMAINS)
    total = members.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return Rates([0.0] * k, [0.0] * k, 0)
    whole = sum(targets.values())
    scale = (budget or total) / total
    aim = np.array([targets.get(d, 0.0) / whole * scale for d in DOMAINS])
    slack = SOFT * np.maximum(aim, 1e-3) ** 2  # in units of multipliers: a relative miss of SOFT/aim for each

    def at(c: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Expected totals, Gram matrix of the rows with a rate above 0, and the dual objective."""
        r = Rates(c.tolist(), [], 0).column()
        t, p = F.col("tokens") / float(total), [F.col(f"p_{d}") for d in DOMAINS]
        pairs = [(i, j) for i in range(k) for j in range(i + 1)]
        rated = members.select(t.alias("t"), r.alias("r"), *(x.alias(f"p{i}") for i, x in enumerate(p)))
        w = F.col("t") * F.col("r")
        inside = F.when(F.col("r") > 0, F.col("t")).otherwise(0.0)
        got = rated.agg(*(F.sum(w * F.col(f"p{i}")) for i in range(k)), *(F.sum(inside * F.col(f"p{i}") * F.col(f"p{j}")) for i, j in pairs), F.sum(w * F.col("r"))).first()
        gram = np.zeros((k, k))
        for (i, j), v in zip(pairs, got[k:-1], strict=True):
            gram[i, j] = gram[j, i] = v
        return np.array(got[:k]), gram, got[-1] / 2 + float(aim @ c) + float(slack @ (c * c)) / 2

    c = np.zeros(k)
    reached, gram, value = at(c)
    for step in range(MOST_STEPS):
        slope = aim - reached + slack * c
        if np.abs(slope).max() <= TOLERANCE * scale:
            return Rates(c.tolist(), (reached / scale).tolist(), step)
        way = np.linalg.solve(gram + np.diag(slack), slope)
        length = 1.0
        while True:  # a full step unless the objective rises
            new = c - length * way
            found = at(new)
            if found[2] <= value - 1e-4 * length * float(slope @ way) or length < 1e-6:
                break
            length /= 2
        c, (reached, gram, value) = new, found
    raise RuntimeError(f"the rates did not settle: shares {reached / scale} for {aim / scale}")


def solve(members: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None) -> DataFrame:
    """members with rate >= 0 (see ``fit_rates``). A table without tokens gets rate 1 throughout."""
    return members.withColumn("rate", F.round(fit_rates(members, targets, budget).column(), 6))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, budget: float | None = None) -> DataFrame:
    """doc_id, tokens, p_<domain>..., rate of every row of docs: doc_id, text.

    Null and empty texts have no tokens and keep a rate of their own posteriors. Very long texts
    are read whole. Repeated rows are mixed once each, documents of equal posteriors get equal
    rates. Without labelled documents all domains are alike and rates only scale to the budget. An
    empty table gives no rows. Other columns are not read.
    """
    model = train(docs, labels)
    members = memberships(docs, model)
    if model.blind:
        total = members.agg(F.sum("tokens")).first()[0] or 0
        return members.withColumn("rate", F.lit((budget or total) / total if total else 1.0))
    return solve(members, targets, budget)


def apply_rates(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """Each row of docs as often as its rate says: its whole part, and once more with the chance of the rest by hashed doc_id.

    Rows without a rate (no doc_id among them) stay once. rates: doc_id, rate; of repeated ids the
    largest. Columns of any name come back as they are.
    """
    r = rates.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("rate").alias("rate"))
    chance = F.pmod(F.xxhash64("id", F.lit(88)), F.lit(1 << 30)) / float(1 << 30)
    copies = F.when(F.col("rate").isNull(), 1).otherwise(F.floor(F.col("rate") + chance)).cast("int")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"))
    return whole.join(r, "id", "left").withColumn("copies", copies).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op8_domain_mixing(spark, sf_dir: str) -> DataFrame:
    """Rates that bring all documents to TARGETS."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
