"""Text, token and vector expressions: everything here is a Column over built-in functions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens are runs of lower-case ASCII letters and digits.
TOKEN = "[a-z0-9]+"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def tokens(x: Column | str) -> Column:
    """Tokens of a text; null and "" give an empty array (split would give ['']). """
    return F.regexp_extract_all(F.lower(F.coalesce(_c(x), F.lit(""))), F.lit(TOKEN), F.lit(0))


def normalize(x: Column | str) -> Column:
    """Tokens joined by one space."""
    return F.array_join(tokens(x), " ")


def split_norm(x: Column | str) -> Column:
    """Tokens of a normalised text, without matching them anew."""
    x = _c(x)
    return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, " "))


def word_grams(word: Column, n: int) -> Column:
    """The n-grams of one word, in order; a shorter word yields itself."""
    # the upper end stays valid for short words: sequence() is evaluated before the branch is known
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - (n - 1), F.lit(1))), lambda i: F.substring(word, i, F.lit(n)))
    return F.when(F.length(word) < n, F.array(word)).otherwise(grams)


def char_ngrams(toks: Column | str, n: int = 3) -> Column:
    """n-grams within each token, token by token, repeats kept."""
    return F.flatten(F.transform(_c(toks), lambda w: word_grams(w, n)))


def typo_grams(word: Column | str) -> Column:
    """Distinct 2- and 3-grams of a word; a word of one letter yields itself."""
    w = _c(word)
    three = F.when(F.length(w) >= 3, word_grams(w, 3)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(word_grams(w, 2), three))


def is_number(x: Column) -> Column:
    """All digits; no sign, no point."""
    return x.rlike("^[0-9]+$")


def ratio(a: Column, b: Column) -> Column:
    """a / max(b, 1)."""
    return a.cast("double") / F.greatest(b, F.lit(1)).cast("double")


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays; null where their lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def osa_distance(a: Column | str, b: Column | str) -> Column:
    """Optimal string alignment: insertions, deletions, substitutions and swaps of neighbours.

    A fold over the characters of a that carries two rows of the table, each row a fold over b.
    """
    a, b = _c(a), _c(b)
    chars = F.transform(F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1))), lambda j: F.substring(b, j, F.lit(1)))
    first = F.sequence(F.lit(0), F.length(b))

    def row(state: Column, i: Column) -> Column:
        ca, before = F.substring(a, i, F.lit(1)), F.substring(a, i - 1, F.lit(1))
        up, upper = state["r"], state["q"]

        def cell(done: Column, j: Column) -> Column:
            cb, cb1 = F.get(chars, j - 1), F.get(chars, j - 2)
            plain = F.least(F.get(up, j) + 1, F.get(done, j - 1) + 1, F.get(up, j - 1) + F.when(ca == cb, 0).otherwise(1))
            swap = F.when((i > 1) & (j > 1) & (ca == cb1) & (before == cb), F.get(upper, j - 2) + 1)
            return F.concat(done, F.array(F.least(plain, swap)))

        nxt = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1))), F.array(i.cast("int")), cell)
        return F.struct(nxt.alias("r"), up.alias("q"))

    start = F.struct(first.alias("r"), first.alias("q"))
    walked = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1))), start, row, lambda s: F.get(s["r"], F.length(b)))
    return F.when(F.length(a) == 0, F.length(b)).when(F.length(b) == 0, F.length(a)).otherwise(walked)


# ---------------------------------------------------------------- small scalar functions


def parse_int(x: Column, default: int) -> Column:
    """The integer in a text, or the default."""
    return F.coalesce(F.trim(x).try_cast("int"), F.lit(default))


def parse_flag(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit("")))).isin("1", "true", "yes", "on")


def format_duration(seconds: Column) -> Column:
    """1h02m, 2m03s, 5s; unknown if negative or infinite."""
    s = seconds.cast("double")
    known = F.when((s < 0) | s.isin(float("inf"), float("-inf")) | F.isnan(s), None).otherwise(s).cast("long")
    h, m, r = F.floor(known / 3600), F.floor(known % 3600 / 60), known % 60
    shown = F.when(h > 0, F.format_string("%dh%02dm", h, m)).when(m > 0, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))
    return F.when(known.isNull(), "unknown").otherwise(shown)


def html_escape(x: Column) -> Column:
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(raw), F.lit(ref))
    return x


def html_unescape(x: Column) -> Column:
    """All character references of HTML decoded, in Arrow batches: no built-in function knows them."""

    @F.pandas_udf("string")
    def decoded(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    return decoded(x)


def url_quote(x: Column) -> Column:
    """Percent-encoding of a path: space as %20, / and ~ kept, * encoded."""
    x = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    for code, raw in (("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        x = F.replace(x, F.lit(code), F.lit(raw))
    return x


def iso_time(x: Column) -> Column:
    """UTC time in ISO-8601, whole seconds, with Z."""
    return F.date_format(F.to_utc_timestamp(x, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


#: Content types of pictures and their extensions: fixed values.
EXTENSION_OF_TYPE = {"image/jpeg": ".jpg", "image/jpg": ".jpg", "image/png": ".png", "image/webp": ".webp", "image/gif": ".gif"}


def image_extension(content_type: Column, url: Column) -> Column:
    """By content type, else by the end of the URL's path, else .jpg."""
    kind = F.trim(F.split_part(F.lower(F.coalesce(content_type, F.lit(""))), F.lit(";"), F.lit(1)))
    path = F.lower(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")))
    found = F.regexp_extract(path, r"(\.jpg|\.jpeg|\.png|\.webp|\.gif)$", 1)
    out = F.when(found.isin("", ".jpeg"), ".jpg").otherwise(found)
    for name, ext in EXTENSION_OF_TYPE.items():
        out = F.when(kind == name, ext).otherwise(out)
    return out


def referer(url: Column) -> Column:
    """scheme://host/ of a URL, null if either is missing."""
    return F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.try_parse_url(url, F.lit("HOST")), F.lit("/"))


def https_variant(url: Column, host: str) -> Column:
    """The URLs to try: as given, and over https where it begins with http://host/."""
    plain = f"http://{host}/"
    upgraded = F.concat(F.lit(f"https://{host}/"), F.substring(url, len(plain) + 1, 1 << 20))
    return F.when(F.startswith(url, F.lit(plain)), F.array(url, upgraded)).otherwise(F.array(url))


def found_urls(page: Column, pattern: str, group: int, most: int) -> Column:
    """Matches of a pattern, decoded and trimmed: distinct http(s) URLs in order, the first `most`."""
    raw = F.split(html_unescape(F.array_join(F.regexp_extract_all(page, F.lit(pattern), F.lit(group)), "\x01")), "\x01")
    return F.slice(F.array_distinct(F.filter(F.transform(raw, F.trim), lambda x: x.rlike("^https?://"))), 1, most)


def query_variants(title: Column, brand: Column, vendor: str = "home depot") -> Column:
    """Image-search queries for a product: nine forms in order, empty and repeated ones dropped.

    The brand is appended unless the title holds it, in either case.
    """
    t, b = F.trim(F.coalesce(title, F.lit(""))), F.trim(F.coalesce(brand, F.lit("")))
    alone = F.when(t != "", t).otherwise(b)
    base = F.when((b != "") & ~F.contains(F.lower(t), F.lower(b)), F.trim(F.concat_ws(" ", t, b))).otherwise(alone)
    words = lambda x: F.array_remove(F.split(F.regexp_replace(x, "[^A-Za-z0-9 ]+", " "), " +"), "")
    lead = lambda x, n: F.array_join(F.slice(words(x), 1, n), " ")
    forms = [F.trim(F.concat(base, F.lit(" product photo"))), F.trim(F.concat(base, F.lit(f" {vendor} product image"))), base, t, lead(base, 8), lead(t, 6), lead(t, 4), b, F.trim(F.concat_ws(" ", b, lead(t, 4)))]
    return F.array_distinct(F.filter(F.array(*forms), lambda x: x != ""))
