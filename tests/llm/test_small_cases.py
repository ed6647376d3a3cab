"""Nulls, empty and odd texts, repeats, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

from lodestone.llm import bagminhash, html_crf, interpolation, language, mixing, outliers, packing, quality, secrets, tiff

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", None, 4),
    (4, "plain words of a little text here", "en", "a", 33),
    (4, "plain words of a little text here", "en", "a", 33),
    (5, "… 12 -- ", "de", "b", 8),
    (6, "long word " * 9000, "en", "a", 90000),
    (7, "\U0001f600 zażółć \u0000 x", "pl", "c", 10),
    (None, "no id at all in this row", "en", "a", 24),
]


@pytest.fixture(scope="module")
def odd(spark):
    # columns that a careless operator would clash with
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"key": F.lit("k"), "id": F.lit(0), "block": F.lit(1), "score": F.lit(0.5), "lang_pred": F.lit("zz"), "secret_spans": F.lit("s"), "tokens": F.lit(3), "kept": F.lit(True)})


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (4, 1, 0), (6, 0, 0), (None, 1, 1), (2, None, 1)], "doc_id long, quality int, toxic int")


def test_pages(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, None, "<p>Hello there, this is a text.</p>"), (3, None, "<p>Hello there, this is a text.</p>"), (4, "u", "<<<>>&&amp;<p"), (5, "u", "<div>" * 2000 + "deep" + "</div>" * 10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"main_text": F.lit("old"), "text": F.lit("t")})
    got = html_crf.extract(pages, blocks=True).collect()
    assert len(got) == 6 and got[0].main_text == "" and got[1].main_text == "" and got[0].blocks == []
    assert got[2].main_text == got[3].main_text == "Hello there, this is a text."
    assert html_crf.extract(pages.where("false")).count() == 0


def test_packing(odd, none):
    got = packing.pack_documents(odd).collect()
    assert sum(r.doc_id == 4 for r in got) == 2 and {r.doc_id for r in got} == {1, 2, 3, 4, 5, 6, 7, None}
    assert all(r.doc_tokens == 1 for r in got if r.doc_id in (1, 2, 3))
    assert packing.pack_documents(none).count() == 0


def test_language(spark, odd, none):
    model = language.train(language.learned_rows(odd))
    got = language.identify(odd, model, spans=True).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 9 and all(by[i].lang_pred == "und" and by[i].lang_score == 0 for i in (1, 2, 3, 5))
    assert by[4].lang_pred in model.names and 0 <= by[4].lang_score <= 1 and by[4].key == "k"
    assert language.identify(none, model).count() == 0
    empty = language.train(none)
    assert {r.lang_pred for r in language.identify(odd, empty).collect()} == {"und"}


def test_quality(spark, odd, none):
    model = quality.train(odd, labels(spark))
    got = quality.score(odd, model).collect()
    assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score(odd, quality.train(none, labels(spark))).collect()} == {0.5}
    assert quality.score(none, model).count() == 0
    assert quality.score(odd.drop("n_chars"), model).count() == 9


def test_near_duplicates(odd, none):
    got = bagminhash.near_duplicates(odd).collect()
    assert len(got) == 9
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 6, 7: 7, None: None}
    kept = bagminhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == 8
    assert bagminhash.near_duplicates(none).count() == 0 and bagminhash.keep_one(none).count() == 0


def test_near_duplicates_of_repeated_ids_and_clashing_columns(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen fourteen"
    rows = [(1, a), (1, b), (1, a), (2, a), (3, b + " fifteen"), (4, b), (5, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("kept_id", "node", "id", "row", "class")})
    got = sorted((r.doc_id, r.class_id) for r in bagminhash.near_duplicates(docs).collect())
    assert got == [(1, 1), (1, 1), (1, 1), (2, 1), (3, 3), (4, 1), (5, 5), (5, 5)]
    kept = bagminhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(1, b), (1, a), (3, b + " fifteen"), (5, ""), (5, "")]


def test_outliers(odd, none):
    got = outliers.judge(odd).collect()
    assert len(got) == 9 and sum(r.base_failed for r in got) == 9 and not any(r.kept for r in got)
    assert outliers.judge(none).count() == 0


def test_scoring(odd, none):
    got = interpolation.score_texts(odd, F.col("doc_id") != 7).collect()
    assert len(got) == 9 and {r.doc_id: r.n_tokens for r in got}[1] == 1 and all(r.score < 0 for r in got)
    assert {r.doc_id: r.held_out for r in got}[7] and {r.doc_id: r.held_out for r in got}[None]
    assert all(r.train_tokens == 0 for r in interpolation.score_texts(odd, F.lit(False)).collect())
    assert interpolation.score_texts(none, F.lit(True)).count() == 0


def test_mixing(spark, odd, none):
    got = mixing.mix(odd, labels(spark)).collect()
    assert len(got) == 9 and all(r.rate >= 0 and abs(r.p_good + r.p_low + r.p_toxic - 1) < 1e-9 for r in got)
    assert all(r.rate == 1 for r in mixing.mix(odd, labels(spark).where("false")).collect())
    taken = odd.withColumns({c: F.lit(1) for c in ("__id", "__rate", "__copy", "__copies", "rate", "copies", "row")})
    out = mixing.apply_rates(taken, spark.createDataFrame([(4, 2.0), (6, 0.0)], "doc_id long, rate double"))
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(4) == 4 and ids.count(6) == 0 and ids.count(1) == 1 and ids.count(None) == 1 and out.columns == taken.columns
    assert mixing.mix(none, labels(spark)).count() == 0


def test_media(odd, none):
    got = tiff.media_digest(odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 9 and by[1].payload_bytes == 64 and by[1].n_bytes == 0 and by[1].media_sha256 == by[2].media_sha256
    assert tiff.media_digest(none).count() == 0
    pages = tiff.tiff_pages(odd.withColumn("media", F.col("text").cast("binary")), "doc_id", "media").collect()
    assert len(pages) == 9 and all(r.error for r in pages)


def test_secrets(odd, none):
    got = secrets.find_secrets(odd, mark="*").collect()
    assert len(got) == 9 and all(r.secret_spans == [] for r in got) and {r.doc_id: r.redacted for r in got}[1] is None
    assert secrets.secret_digest(none).count() == 0


# ---------------------------------------------------------------- pipeline stages


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("odd")
    labels(spark).write.parquet(str(d / "labels.parquet"))
    return str(d)


def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", ["language_id", "near_dedup", "secret_scan", "domain_mixing"])
def test_stage_of_odd_rows(spark, odd, none, folder, name):
    """Columns come back as they were; rows go only where the stage says so."""
    taken = odd.withColumns({c: F.lit(1) for c in ("kept_id", "__id", "__rate", "__copies", "row", "node", "redacted", "main_text")})
    stage = stages()[name]
    out = stage(spark, taken, folder)
    assert out.columns == taken.columns and out.dtypes == taken.dtypes
    ids = sorted(r.doc_id or 0 for r in out.collect())
    full = [0, 1, 2, 3, 4, 4, 5, 6, 7]
    want = {"language_id": [0, 4, 4, 6, 7], "near_dedup": [0, 1, 2, 3, 4, 5, 6, 7], "secret_scan": full}
    assert ids == want[name] if name in want else set(ids) <= set(full) and 0 in ids
    assert stage(spark, none, folder).count() == 0


def test_packing_stage_of_odd_rows(spark, odd, none, folder):
    got = stages()["packing"](spark, odd, folder)
    assert got.where("doc_id = 4").count() == 2 and got.agg(F.sum("length")).first()[0] == got.where("start = 0").agg(F.sum("doc_tokens")).first()[0]
    assert stages()["packing"](spark, none, folder).count() == 0


def test_dedup_stage_is_done_with_pairs_that_have_met(spark, monkeypatch):
    """pipeline: unlike texts that share buckets in twos all stay, and none goes to open buckets."""
    texts = [" ".join([f"p{i // 2}x{j}" for j in range(110)] + [f"w{i}x{j}" for j in range(17)]) for i in range(80)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    kept, real = [], bagminhash.written

    def written(df, name):
        out = real(df, name)
        kept.extend([out.count()] if name == "open" else [])
        return out

    monkeypatch.setattr(bagminhash, "written", written)
    assert sorted(r.doc_id for r in stages()["near_dedup"](spark, docs, "").collect()) == list(range(80))
    assert kept and not any(kept)


def test_ties(spark):
    """Rows that are equal but for their order get equal results, whatever the order."""
    rows = [(i, "the same words of one text stand here twice and more", "en", "a", 50) for i in range(6)] + [(9, "la la la la", "fr", "a", 11), (8, "da da da da", "de", "a", 11)]
    for x in (rows, rows[::-1]):
        docs = spark.createDataFrame(x, SCHEMA)
        model = language.train(docs)
        assert model.names == ["de", "en", "fr"]
        got = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
        assert len({got[i] for i in range(6)}) == 1
        # two languages with as many letters: the first by name
        even = spark.createDataFrame([(1, "la la la la la\n1 2 3\nda da da da da")], "doc_id long, text string")
        spans = language.identify(even, model, spans=True).first()
        assert spans.lang_pred == min(s.lang for s in spans.lang_spans) if len({s.lang for s in spans.lang_spans}) == 2 else True
        assert {r.doc_id: r.class_id for r in bagminhash.near_duplicates(docs).collect()} == {**dict.fromkeys(range(6), 0), 8: 8, 9: 9}
        fm = quality.train(docs, spark.createDataFrame([(0, 1), (1, 0), (2, 1), (2, 0)], "doc_id long, quality int"))
        assert len({r.score for r in quality.score(docs, fm).collect() if r.doc_id < 6}) == 1
        rates = mixing.mix(docs, spark.createDataFrame([(0, 1, 0), (1, 0, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")).collect()
        assert len({r.rate for r in rates if r.doc_id < 6}) == 1


def test_very_long_texts(spark):
    """Texts of several blocks are read whole."""
    text = "one long text of many words " * 250_000 + "password=abcdefgh12345"
    docs = spark.createDataFrame([(1, text, "en", "a", len(text)), (2, "short text", "en", "a", 10)], SCHEMA)
    found = {r.doc_id: r for r in secrets.secret_digest(docs).collect()}
    assert found[1].n_assign == 1 and found[1].spans.startswith(f"assign:{len(text) - 22}:")
    assert {r.doc_id: r.lang_pred for r in language.identify(docs, language.train(docs)).collect()} == {1: "en", 2: "en"}
    pieces = packing.pack_documents(docs).where("doc_id = 1").agg(F.sum("length"), F.max("doc_tokens")).first()
    assert pieces[0] == pieces[1] > 1_000_000
    assert {r.doc_id: r.payload_bytes for r in tiff.media_digest(docs).collect()}[1] == -(-len(text) // 64) * 64
    assert {r.doc_id: r.n_tokens for r in interpolation.score_texts(docs, F.lit(True)).collect()}[1] == text.count(" ") + 2
    page = spark.createDataFrame([(1, f"<article><p>{text}</p></article>")], "page_id long, html string")
    assert html_crf.extract(page).first().main_text == text
    assert {r.doc_id: r.class_id for r in bagminhash.near_duplicates(docs).collect()} == {1: 1, 2: 2}
    assert {r.doc_id: r.n_words for r in outliers.judge(docs).collect()}[1] == text.count(" ") + 1
