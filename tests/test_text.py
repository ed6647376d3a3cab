import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as tx


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"]) if not any(v is None for v in values.values()) else spark.range(1).select(*(F.lit(v).cast("string").alias(k) for k, v in values.items()))
    return row.select(col.alias("out")).first()["out"]


@pytest.mark.parametrize("raw,want", [("Ryobi 18-V ONE+ Drill/Driver", "ryobi 18 v one drill driver"), ("Kİ café", "ki caf"), (None, ""), ("", ""), ("---", "")])
def test_normalize(spark, raw, want):
    assert one(spark, tx.normalize("x"), x=raw) == want


def test_tokens_of_nothing_are_none(spark):
    assert one(spark, tx.tokens("x"), x="") == []


def test_char_ngrams(spark):
    assert one(spark, tx.char_ngrams(tx.tokens("x")), x="saw drill ab") == ["saw", "dri", "ril", "ill", "ab"]


def osa(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_osa_distance(spark):
    rng = random.Random(3)
    pairs = [("tiolet", "toilet"), ("ca", "abc"), ("", "ab"), ("ab", ""), ("", ""), ("a", "a")]
    pairs += [tuple("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2)) for _ in range(200)]
    got = spark.createDataFrame(pairs, ["a", "b"]).select("a", "b", tx.osa_distance("a", "b").alias("d"), F.levenshtein("a", "b").alias("l")).collect()
    for r in got:
        assert r.d == osa(r.a, r.b) and r.d <= r.l <= 2 * r.d


def test_typo_grams(spark):
    a = set(one(spark, tx.typo_grams("x"), x="tiolet"))
    assert a & set(one(spark, tx.typo_grams("x"), x="toilet")) == {"et", "le", "let"}
    assert one(spark, tx.typo_grams("x"), x="a") == ["a"]
    assert one(spark, tx.typo_grams("x"), x="ab") == ["ab"]


@pytest.mark.parametrize("s,want", [(3720.0, "1h02m"), (123.0, "2m03s"), (5.9, "5s"), (-1.0, "unknown"), (math.inf, "unknown")])
def test_format_duration(spark, s, want):
    assert one(spark, tx.format_duration(F.col("x")), x=s) == want


def test_small_functions(spark):
    assert one(spark, tx.html_escape(F.col("x")), x="<a href=\"x\">'&") == "&lt;a href=&quot;x&quot;&gt;&#x27;&amp;"
    assert one(spark, tx.html_unescape(F.col("x")), x="&amp;lt; &quot;") == '&lt; "'
    assert one(spark, tx.url_quote(F.col("x")), x="a b/c~d*é") == "a%20b/c~d%2A%C3%A9"
    assert one(spark, tx.parse_int(F.col("x"), 7), x=" 12 ") == 12
    assert one(spark, tx.parse_int(F.col("x"), 7), x="x1") == 7
    assert one(spark, tx.parse_flag(F.col("x")), x=" Yes ") is True
    assert one(spark, tx.parse_flag(F.col("x")), x=None) is False
    assert one(spark, tx.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(spark, tx.image_extension(F.lit("IMAGE/PNG; q"), F.lit("http://a/b.gif"))) == ".png"
    assert one(spark, tx.image_extension(F.lit(None).cast("string"), F.lit("http://a/b.jpeg?x=.gif"))) == ".jpg"
    assert one(spark, tx.referer(F.lit("https://a.b/c"))) == "https://a.b/"
    assert one(spark, tx.https_variant(F.lit("http://h.com/x"), "h.com")) == ["http://h.com/x", "https://h.com/x"]
    page = 'murl":"http://a/1.jpg" murl":"ftp://b" murl":"http://a/1.jpg" murl":"https://c&amp;d"'
    assert one(spark, tx.found_urls(F.lit(page), r'murl":"(.*?)"', 1, 5)) == ["http://a/1.jpg", "https://c&d"]


def test_query_variants(spark):
    got = one(spark, tx.query_variants(F.lit("Big Drill"), F.lit("Ryobi")))
    assert got[:3] == ["Big Drill Ryobi product photo", "Big Drill Ryobi home depot product image", "Big Drill Ryobi"] and got[-2:] == ["Ryobi", "Ryobi Big Drill"]
    assert one(spark, tx.query_variants(F.lit("ryobi saw"), F.lit("Ryobi")))[2] == "ryobi saw"
    assert one(spark, tx.query_variants(F.lit(None).cast("string"), F.lit("Ryobi")))[0] == "Ryobi product photo"
