import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.functions import overlap
from lodestone.functions.text import tokens
from lodestone.operators import corpus as co
from lodestone.operators import images as im
from lodestone.operators import index as ix
from lodestone.operators import models, profile, rank, retrieve, spell
from lodestone.sources import settings, tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_corpus_build(spark):
    attrs = frame(spark, [(1, "Bullet01", "18 V", 0), (1, "mfg BRAND name", "Ryobi", 1), (1, "MFG Brand Name", "Other", 2), (None, "x", "y", 3), (2, "Color", None, 4)], "product_uid long, name string, value string, pos long")
    titles = frame(spark, [(1, "Drill", 0), (1, "Drill v2", 1), (2, "Saw", 2), (3, "Nut", 3)], "product_uid long, product_title string, pos long")
    desc = frame(spark, [(1, "A drill."), (2, None)], "product_uid long, product_description string")
    got = {r.product_uid: r for r in co.build_corpus(desc, titles, attrs).collect()}
    assert set(got) == {1, 2}
    assert (got[1].product_title, got[1].brand, got[1].all_attributes) == ("Drill", "Ryobi", "18 V Ryobi Other")
    assert (got[2].product_title, got[2].brand, got[2].all_attributes, got[2].product_description_norm) == ("Saw", None, "nan", "")
    assert {r.product_uid: r.brand for r in co.brands(attrs, any_case=False).collect()} == {1: "Other"}
    with pytest.raises(ValueError):
        co.validate(desc)
    with pytest.raises(TypeError):
        co.validate(None)


def index_of(spark, texts):
    c = frame(spark, [(i, t) for i, t in enumerate(texts, 1)], "product_uid long, t string").select("product_uid", tokens("t").alias("title_tok"), F.array().cast("array<string>").alias("desc_tok"))
    return c, ix.build_index(c, ("word",))


def bm25_of(spark, index, q):
    qs = frame(spark, [(1, q)], "query_id long, raw string").withColumn("q_tok", tokens("raw"))
    scores = retrieve.bm25(retrieve.query_terms(qs, ("word", "word", F.col("q_tok"), None)), index, ("query_id",))
    return qs, scores


def test_bm25_golden(spark):
    c, index = index_of(spark, ["cordless drill kit", "drill bit set", "sofa", "patio door", ""])
    qs, s = bm25_of(spark, index, "cordless drill")
    assert {r.product_uid: round(r.score, 6) for r in s.collect()} == {1: 1.103911, 2: 0.258825}
    _, s2 = bm25_of(spark, index, "drill drill")
    assert {r.product_uid: round(r.score, 6) for r in s2.collect()} == {1: 0.51765, 2: 0.51765}
    filled = retrieve.fill(s, qs, c, 5).orderBy("rank").collect()
    assert [r.product_uid for r in filled] == [1, 2, 5, 4, 3]
    assert [r.product_uid for r in retrieve.fill(s, qs, c, 3).orderBy("rank").collect()] == [1, 2, 5]
    with pytest.raises(ValueError):
        retrieve.fill(s, qs, c, 0)


def test_bm25_floor_and_negative_fill(spark):
    c, index = index_of(spark, ["a b", "a c", "a"])
    idf = {r.term: round(r.idf, 6) for r in index.terms.collect()}
    assert idf == {"a": -0.077022, "b": 0.510826, "c": 0.510826}
    qs, s = bm25_of(spark, index, "a")
    assert [r.score < 0 for r in retrieve.fill(s, qs, c, 3).collect()] == [True] * 3


def test_features_golden(spark):
    row = frame(spark, [("ryobi 18 v drill drill", "drill 18", "", "ryobi")], "t string, q string, d string, b string")
    x = row.select(tokens("t").alias("title_tok"), tokens("d").alias("desc_tok"), tokens("d").alias("attr_tok"), tokens("b").alias("brand_tok"), F.col("t").alias("product_title_norm"), F.col("d").alias("product_description_norm"), tokens("q").alias("q"), F.col("q").alias("qn"))
    got = x.select(*(c.alias(n) for n, c in overlap.features(F.col("q"), F.col("qn")).items())).first().asDict()
    assert len(got) == 30
    want = {"query_len": 2, "title_len": 5, "len_ratio": 0.4, "last_word_match": 1, "num_match_count": 1, "brand_match": 0, "exact_in_title": 0, "title_pos_min": 2, "title_pos_max": 5, "title_overlap": 2, "title_overlap_ratio": 1.0, "title_coverage": 0.5, "title_jaccard": 0.5, "desc_pos_mean": 0, "desc_jaccard": 0}
    assert {k: got[k] for k in want} == want and abs(got["title_pos_mean"] - 11 / 3) < 1e-9


def test_spelling_branches(spark):
    d = frame(spark, [("toliet", "toilet"), ("2X4 SRUDS", "2x4 studs"), ("whitesilicone", "white silicone"), ("smal", "small")], "wrong string, right string")
    q = frame(spark, [(1, "toliet"), (2, "2X4 SRUDS"), (3, "red couch"), (4, "whitesilicone"), (5, "red whitesilicone"), (6, "smal couch"), (7, "---"), (8, " Toliet ")], "query_id long, raw_query string")
    got = {r.query_id: r for r in spell.understand(q, d, None).collect()}
    assert got[1].q_norm == "toilet" and got[2].q_norm == "2x4 sruds" and got[4].q_norm == "white silicone"
    assert got[5].q_norm == "red whitesilicone" and got[6].q_norm == "small sofa" and got[8].q_norm == "toilet"
    assert got[3].q_norm == "red sofa" and got[3].expanded and got[3].recall_tok == ["red", *spell.SYNONYMS[0]]
    assert 7 not in got


def correct(tok, prev, vocab, freq, pairs):
    """A plain loop with the same rules."""
    if tok in vocab or len(tok) < 3 or tok.isdigit():
        return tok
    g = lambda w: {w[i : i + n] for n in (2, 3) for i in range(len(w) - n + 1)}
    limit = 1 if len(tok) <= 5 else 2 if len(tok) <= 10 else 3
    from tests.test_text import osa

    found = []
    for c in vocab:
        over, d = len(g(tok) & g(c)), osa(tok, c)
        if over and abs(len(c) - len(tok)) <= limit and d <= limit:
            shape = (c[0] == tok[0]) + (c[-1] == tok[-1]) + (c[:2] == tok[:2]) + (c[-2:] == tok[-2:])
            found.append((d, -pairs[prev, c] if prev else 0, -shape, -over, -freq[c], c))
    if not found:
        return tok
    found.sort()
    b = found[0]
    if b[0] <= 1:
        return b[5]
    if not (b[1] < 0 or b[2] <= -2 or b[3] <= -3 or b[4] <= -8):
        return tok
    if len(found) > 1 and found[1][:2] == b[:2] and b[2] > -3:
        return tok
    return b[5]


def test_typo_correction_in_sequence(spark):
    rng = random.Random(5)
    words = ["hammer", "hummer", "handle", "candle", "cordless", "garden", "harden", "sander", "wrench", "trench", "drill", "grill", "kit", "set"]
    titles = [[rng.choice(words) for _ in range(rng.randint(2, 5))] for _ in range(60)]
    model = ix.build_typo_model(frame(spark, [(t,) for t in titles], "toks array<string>"))
    freq = Counter(w for t in titles for w in t)
    pairs = Counter(p for t in titles for p in zip(t, t[1:], strict=False))
    vocab = {w for w, n in freq.items() if n >= 3 and len(w) >= 3}

    def spoil(w):
        i = rng.randrange(len(w) - 1)
        return rng.choice((w, w[:i] + w[i + 1] + w[i] + w[i + 2 :], w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "q" + w[i + 1 :], "couch", "12", "zz"))

    asked = [[spoil(spoil(rng.choice(words)) if rng.random() < 0.3 else rng.choice(words)) for _ in range(rng.randint(1, 5))] for _ in range(60)]
    rows = frame(spark, [(i, j, w) for i, q in enumerate(asked) for j, w in enumerate(q)], "query_id long, place int, tok string")
    got = {r.query_id: r.toks for r in spell.correct_typos(rows, model).collect()}
    for i, q in enumerate(asked):
        want = []
        for w in q:
            want.append(w if w == "couch" else correct(w, want[-1] if want else None, vocab, freq, pairs))
        assert got[i] == want, (q, got[i], want)


def test_blend_and_results(spark):
    x = frame(spark, [(1, 1, 3.4, 0.5), (1, 2, 2.0, 2.0)], "query_id long, product_uid long, booster double, ridge double")
    got = {r.product_uid: r.relevance_score for r in rank.blend(x).collect()}
    assert got == {1: 2.6, 2: 2.0}
    c = frame(spark, [(1, "a"), (2, "b")], "product_uid long, product_title string")
    assert [r.product_uid for r in rank.results(rank.blend(x), c, 1).collect()] == [1]
    with pytest.raises(ValueError):
        rank.results(rank.blend(x), c, -1)


def test_ridge_closed_form(spark):
    import numpy as np

    rng = random.Random(2)
    rows = [(" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee"]) for _ in range(6)), 1.0 + rng.random() * 2) for _ in range(40)]
    df = frame(spark, rows, "text string, relevance double")
    m = models.fit_ridge(df, alpha=2.0)
    from pyspark.ml.functions import vector_to_array

    out = m.transform(df.withColumn("ridge_terms", tokens("text"))).select(vector_to_array("ridge_x").alias("x"), "relevance", "ridge").collect()
    X, y, p = np.array([r.x for r in out]), np.array([r.relevance for r in out]), np.array([r.ridge for r in out])
    Xc, yc = X - X.mean(0), y - y.mean()
    w = np.linalg.solve(Xc.T @ Xc + 2.0 * np.eye(X.shape[1]), Xc.T @ yc)
    assert np.abs(Xc @ w + y.mean() - p).max() < 1e-4


def test_latent_space_matches_svd(spark):
    import numpy as np

    rng = random.Random(4)
    texts = [[rng.choice("abcdefgh") for _ in range(8)] for _ in range(30)]
    c = frame(spark, [(i, t) for i, t in enumerate(texts)], "product_uid long, title_tok array<string>").withColumn("desc_tok", F.array().cast("array<string>"))
    idx = ix.build_index(c, ("word",))
    space = models.LatentSpace.fit(idx, "word", 3)
    got = {r.product_uid: np.array(r.place) for r in space.project(idx.postings, "product_uid", k=3).collect()}
    names = sorted({w for t in texts for w in t})
    tf = np.array([[t.count(w) for w in names] for t in texts], float)
    idf = np.log(31 / (1 + (tf > 0).sum(axis=0))) + 1
    x = tf * idf
    _, _, v = np.linalg.svd(x / np.linalg.norm(x, axis=1, keepdims=True), full_matrices=False)
    v = v[:3] * np.where(v[:3][np.arange(3), np.abs(v[:3]).argmax(axis=1)] < 0, -1, 1)[:, None]
    assert np.allclose(np.array([got[i] for i in range(30)]), x @ v.T, atol=1e-6)
    q = frame(spark, [(1, ["a", "c", "a"]), (2, ["zz"])], "query_id long, q_tok array<string>")
    pairs = frame(spark, [(1, 4), (2, 4)], "query_id long, product_uid long")
    s = {r.query_id: r.score_lsa_word for r in models.lsa_scores(pairs, q, idx, space).collect()}
    y, z = (np.array([2.0 * (w == "a") + (w == "c") for w in names]) * idf) @ v.T, x[4] @ v.T
    assert abs(s[1] - y @ z / np.linalg.norm(y) / np.linalg.norm(z)) < 1e-5 and s[2] == 0


def test_counts_within_rows(spark):
    rng = random.Random(3)
    texts = {i: [rng.choice("abcd") for _ in range(rng.randint(0, 12))] for i in range(40)}
    counted = ix.term_counts(frame(spark, [("f", i, t) for i, t in texts.items()], "field string, product_uid long, toks array<string>"))
    assert {(r.product_uid, r.term, r.tf, r.dl) for r in counted.collect()} == {(i, w, n, len(t)) for i, t in texts.items() for w, n in Counter(t).items()}
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()


def test_negative_scores_are_filled(spark):
    corpus = frame(spark, [(i,) for i in range(30)], "product_uid long")
    q = frame(spark, [(1,), (2,), (3,)], "query_id long")
    rng = random.Random(7)
    scores = {(k, i): rng.choice((-1.0, -0.5, 2.0)) for k in (1, 2) for i in rng.sample(range(30), 22 if k == 1 else 29)}
    got = retrieve.fill(frame(spark, [(*k, v) for k, v in scores.items()], "query_id long, product_uid long, score double"), q, corpus, 6, negative=True).collect()
    for k in (1, 2, 3):
        want = sorted((-scores.get((k, i), 0.0), -i) for i in range(30))[:6]
        assert [(-r.score, -r.product_uid) for r in sorted((r for r in got if r.query_id == k), key=lambda r: r["rank"])] == want


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(retrieve, "BLOCK", 7)
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 3)
    x = np.random.default_rng(1).integers(-2, 3, (60, 4)).astype(float)
    v = frame(spark, [(i, r.tolist()) for i, r in enumerate(x)], "product_uid long, vec array<double>")
    got = retrieve.knn(v.where("product_uid < 8").withColumnRenamed("product_uid", "query_id"), v, 5).collect()
    for k in range(8):
        want = sorted((-(x[k] @ x[i]), -i) for i in range(60))[:5]
        assert [(-r.score, -r.product_uid) for r in sorted((r for r in got if r.query_id == k), key=lambda r: r["rank"])] == want


def test_salted_terms_score_alike(spark, monkeypatch):
    _, index = index_of(spark, ["cordless drill kit", "drill bit set", "sofa", "patio door", ""])
    monkeypatch.setattr(retrieve, "MOST_TERMS", 0)
    _, s = bm25_of(spark, index, "cordless drill")
    assert {r.product_uid: round(r.score, 6) for r in s.collect()} == {1: 1.103911, 2: 0.258825}


def test_percentile_in_passes(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    for x in (rng.exponential(3, 4000), rng.integers(0, 3, 500).astype(float), np.array([4.0] * 50 + [9.0])):
        df = frame(spark, [(float(v),) for v in x] + [(None,)], "x double")
        for q in (0.0, 0.5, 0.95, 1.0):
            assert abs(profile.percentile(df, "x", q, most=20) - np.percentile(x, 100 * q)) < 1e-9


def test_kept_tables_follow_their_files(spark, tmp_path):
    from lodestone.plans import catalogue as cat

    for name in ("part", "documents", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(50).write.parquet(str(tmp_path / f"{name}.parquet"))
    d = str(tmp_path)
    assert cat.corpus(spark, d).count() <= 50 and cat.corpus(spark, d) is cat.corpus(spark, d)
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(7).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert cat.corpus(spark, d).count() <= 7
    cat.release(spark, d)
    assert not any(k[1] == d for k in cat._kept)


def test_image_paths_and_pipeline(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.jpg").write_bytes(b"x")
    rows = frame(spark, [(1, "1.jpg"), (2, "2.jpg"), (3, str(tmp_path / "a" / "1.jpg"))], "product_uid long, local_path string")
    assert {r.product_uid for r in im.existing_paths(rows, [str(tmp_path), str(tmp_path / "a")]).collect()} == {1, 3}
    state = tables.create_state(spark, str(tmp_path / "state"))
    assert state.count() == 0 and tables.create_state(spark, str(tmp_path / "state")).schema == state.schema
    attrs = frame(spark, [(1, "Color", "red", 0)], "product_uid long, name string, value string, pos long")
    titles = frame(spark, [(1, "Drill", 0)], "product_uid long, product_title string, pos long")
    pipe = co.CorpusPipeline(lambda: {"descriptions": frame(spark, [(1, "A drill.")], "product_uid long, product_description string"), "train": titles, "attributes": attrs})
    assert pipe.validate(pipe.prepare(pipe.load())).first().title_tok == ["drill"]


def test_policies():
    class M:
        def predict(self, x):
            return x + 1

    assert models.InferencePolicy().predict((M(), 1)) == 2 and models.InferencePolicy().train(5) == 5
    assert models.TrainingPolicy().train(lambda: 3) == 3
    with pytest.raises(TypeError):
        models.TrainingPolicy().train(3)
    with pytest.raises(TypeError):
        models.InferencePolicy().predict((object(), 1))
    with pytest.raises(RuntimeError):
        models.BoosterModel().predict(None)


def test_image_state(spark):
    rows = [(1, "pending", None), (2, "no_image", ""), (3, "failed", ""), (4, "downloaded", "x/4.jpg"), (5, "downloaded", None), (6, "downloaded", "")]
    st = frame(spark, rows, "product_uid long, status string, local_path string").selectExpr("*", "'t' as title", "'b' as brand", "cast(null as string) as image_url", "cast(null as string) as source", "cast(null as string) as error", "timestamp'2024-01-01' as updated_at")
    assert [r.product_uid for r in im.pending(st).collect()] == [1, 2, 5]
    assert [r.product_uid for r in im.pending(st, True).collect()] == [1, 2, 3, 5]
    assert [r.product_uid for r in im.pending(st, True, 2).collect()] == [1, 2]
    assert [r.product_uid for r in im.image_map(st).collect()] == [4]
    res = frame(spark, [(1, "downloaded", "u", "s", "p", ""), (99, "failed", "", "", "", "x")], "product_uid long, status string, image_url string, source string, local_path string, error string")
    new = {r.product_uid: r for r in im.update_results(st, res, F.current_timestamp()).collect()}
    assert len(new) == 6 and new[1].status == "downloaded" and new[1].local_path == "p" and new[3].status == "failed"
    assert im.progress(res, 10, 2.0).first().failed == 1


def test_profile(spark):
    p = frame(spark, [(1, 1.0, "a"), (2, 2.0, "b"), (3, 10.0, "c")], "event_id long, value double, event_type string").withColumn("ts", F.timestamp_seconds("event_id"))
    r = profile.summary(p).first()
    assert (r.query_count, r.p95_latency, r.max_latency, r.last_query) == (3, 9.2, 10.0, "c")
    e = profile.summary(p.where("false")).first()
    assert (e.query_count, e.p95_latency, e.avg_latency, e.last_query) == (0, 0.0, 0.0, "-")
    assert [x.event_id for x in profile.newest(p, 2).collect()] == [3, 2]


def test_profile_stream(spark, tmp_path):
    from lodestone.streaming.profile import read_profile, run_once, windowed

    p = frame(spark, [(i, float(i), "m") for i in range(50)], "event_id long, value double, event_type string").withColumn("ts", F.timestamp_seconds(F.col("event_id") * 600))
    p.write.parquet(str(tmp_path / "in"))
    stream = windowed(read_profile(spark, str(tmp_path / "in"), "event_id long, value double, event_type string, ts timestamp"))
    run_once(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out"))
    want = windowed(p)
    assert got.count() >= want.count() - 2 and got.exceptAll(want).isEmpty()  # the last windows wait for the watermark


def test_csv_sources(spark, tmp_path):
    (tmp_path / "train.csv").write_bytes('id,product_uid,product_title,search_term\n1,7,"Caf\xe9 ""x"", a\nb",q\n2,7,N/A,q\n3,oops,z\\,q\n'.encode("latin-1"))
    rows = tables.read_csv(spark, str(tmp_path / "train.csv"), tables.TITLES).orderBy("pos").collect()
    assert [(r.product_uid, r.product_title) for r in rows] == [(7, 'Café "x", a\nb'), (7, None), (None, "z\\")]
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "train.csv"), "nothing string")
    (tmp_path / "many.csv").write_text("product_uid,product_title\n" + "".join(f"{i},t{i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        split = tables.read_csv(spark, str(tmp_path / "many.csv"), tables.TITLES, spans_lines=False)
        assert split.select(F.spark_partition_id()).distinct().count() > 1 and [r.product_uid for r in split.orderBy("pos").collect()] == list(range(20_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "log.txt").write_text("a\nb\nc\n")
    assert [r.line for r in tables.read_log_tail(spark, str(tmp_path / "log.txt"), 2).collect()] == ["b", "c"]
    (tmp_path / "p.png").write_bytes(b"\x89PNG")
    assert tables.read_images(spark, str(tmp_path / "p.png")).first().data_uri == "data:image/png;base64,iVBORw=="


def test_embedding_client(spark):
    df = frame(spark, [(1, "ab"), (2, None)], "id long, t string")
    got = {r.id: list(r.embedding) for r in tables.embed(df, "t", lambda xs: {"embeddings": [[3.0, 4.0] if x else [0.0, 0.0] for x in xs]}).collect()}
    assert got[2] == [0.0, 0.0] and abs(got[1][0] - 0.6) < 1e-6
    for bad in ({}, [[1.0]], [[1.0], [1.0, 2.0]], "x"):
        with pytest.raises(ValueError):
            tables.checked_embeddings(bad, ["a", "b"])


def test_settings():
    s = settings.from_env("X", {"X_TOP_K": " 5 ", "X_CANDIDATES": "many", "X_DATA_DIR": "d"})
    assert (s.top_k, s.candidates, s.data_dir) == (5, 100, "d")
    assert settings.from_env("X", {"X_EMBEDDING_BATCH": "8", "ST_EMBEDDING_BATCH": "16"}).embedding_batch == 16
    assert settings.recommended_workers(2) == 48 and settings.recommended_workers(100) == 256
