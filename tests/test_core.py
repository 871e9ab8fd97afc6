"""Core operators on small fixtures: text, sources, design, embeddings, streaming."""

import numpy as np
import pytest

from corpusloom.models.dirichlet import LDA
from corpusloom.models.embedding import Top2Vec
from corpusloom.models.ensemble import align_topics, ensemble_align, topic_stability
from corpusloom.operators import design, rows, text
from corpusloom.sources import corpus
from corpusloom.streaming.scorer import score_stream
from pyspark.sql import functions as F


def docs(spark, *tokens):
    return spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], "doc_id bigint, tokens array<string>")


def test_tokenize(spark):
    df = spark.createDataFrame([(0, "Don’t stop—the U.S. re-run 42 a É."), (1, None), (2, "")], "doc_id int, text string")
    got = {r.doc_id: r.tokens for r in text.token_docs(df, stopwords=["the"]).collect()}
    assert got == {0: ["don’t", "stop", "u.s", "re-run"], 1: [], 2: []}


def test_phrases_are_greedy_and_do_not_overlap(spark):
    d = docs(spark, ["a", "b", "a", "b", "c"], ["b", "c"], [], ["a", "a", "b"])
    p = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    got = {r.doc_id: r.tokens for r in text.apply_phrases(d, p).collect()}
    assert got == {0: ["a_b", "a_b", "c"], 1: ["b_c"], 2: [], 3: ["a", "a_b"]}


def test_chunks_ngrams(spark):
    d = docs(spark, [str(i) for i in range(25)], [], ["x"])
    got = {(r.parent, r.chunk): len(r.tokens) for r in text.chunk_tokens(d, 10, 6).collect()}
    assert got == {(0, 0): 10, (0, 1): 15, (1, 0): 0, (2, 0): 1}
    assert {r.doc_id: r.tokens for r in text.add_ngrams(docs(spark, ["a", "b", "c"], ["a"])).collect()} == {0: ["a", "b", "c", "a_b", "b_c"], 1: ["a"]}


def test_latest_rows(spark):
    df = spark.createDataFrame([(1, 5, "old"), (1, 6, "new"), (1, 6, "newer"), (2, None, "only"), (None, 1, "x")], "k int, t int, v string")
    assert {tuple(r) for r in rows.latest_rows(df, ["k"], "t", ["v"]).collect()} == {(1, "newer"), (2, "only")}


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one two\n\n  three four  \n")
    assert {tuple(r) for r in corpus.read_lines(spark, str(tmp_path / "a.txt")).collect()} == {("doc_0", "", "one two"), ("doc_2", "", "three four")}
    assert {r.doc_name for r in corpus.read_lines(spark, str(tmp_path / "a.txt"), True).collect()} == {"one", "three"}
    (tmp_path / "b.tsv").write_text("x\tl\tsome text here\nshort\ny\tm\tmore text\n")
    t = corpus.read_tsv(spark, str(tmp_path / "b.tsv"))
    assert {(r.doc_name, r.label) for r in t.collect()} == {("x", "l"), ("y", "m")}
    d, v = corpus.build_corpus(t, "doc_name", "text", min_doc_freq=2)
    assert {(r.doc_name, tuple(r.tokens)) for r in d.collect()} == {("x", ("text",)), ("y", ("text",))}
    corpus.save_corpus(d, v, str(tmp_path / "c"))
    assert corpus.load_corpus(spark, str(tmp_path / "c"))[1].collect() == v.collect()


def test_effects_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 2))
    y = 0.3 + x @ [0.1, -0.2] + 0.05 * rng.normal(size=80) * (1 + np.abs(x[:, 0]))
    th = spark.createDataFrame([(i, 0, float(v)) for i, v in enumerate(y)], "doc_id int, topic int, p double")
    xs = spark.createDataFrame([(i, float(a), float(b), i % 7) for i, (a, b) in enumerate(x)], "doc_id int, a double, b double, g int")
    full = np.c_[np.ones(80), x]
    b = np.linalg.lstsq(full, y, rcond=None)[0]
    inv, u = np.linalg.inv(full.T @ full), full * (y - full @ b)[:, None]
    got = design.estimate_effect(th, xs, ["a", "b"])
    assert np.allclose([r["coef"] for r in got], b)
    rss = ((y - full @ b) ** 2).sum()
    assert np.allclose([r["se"] for r in got], np.sqrt(np.diag(inv) * rss / 77)) and np.isclose(got[0]["r2"], 1 - rss / ((y - y.mean()) ** 2).sum())
    got = design.estimate_effect(th, xs, ["a", "b"], cluster="doc_id")
    assert np.allclose([r["se"] for r in got], np.sqrt(np.diag(inv @ (u.T @ u) @ inv) * 80 / 77))
    g = np.stack([u[np.arange(80) % 7 == k].sum(0) for k in range(7)])
    got = design.estimate_effect(th, xs, ["a", "b"], cluster="g")
    assert np.allclose([r["se"] for r in got], np.sqrt(np.diag(inv @ (g.T @ g) @ inv) * 7 / 6 * 79 / 77))


def test_design_columns(spark):
    df = spark.createDataFrame([(float(i), "abc"[i % 3]) for i in range(21)], "x double, c string")
    at = design.knots(df, "x")
    assert np.allclose(at, np.quantile(np.arange(21), np.linspace(0, 1, 5)))
    s = df.withColumns(design.spline("x", [2.0, 5.0, 8.0, 11.0, 14.0])).toPandas().sort_values("x")
    # linear before the first and after the last knot
    assert {"s1", "s2", "s3", "s4"} <= set(s.columns) and all(np.allclose(np.diff(s[c], 2)[14:], 0) and np.allclose(s[c][:3], 0) for c in ("s2", "s3", "s4"))
    hot = design.one_hot(df, "c", prefix="is_")
    assert hot.columns == ["x", "c", "is_b", "is_c"] and hot.agg(F.sum("is_b")).first()[0] == 7


def test_top2vec_recovers_blocks(spark):
    rng = np.random.default_rng(1)
    c = np.eye(3, 8) * 4
    rows_ = [(i, [f"b{i % 3}w{j}" for j in rng.integers(0, 6, 8)], (c[i % 3] + 0.3 * rng.normal(size=8)).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows_, "doc_id bigint, tokens array<string>, vec array<double>")
    m = Top2Vec(3, n_components=2).fit(df.select("doc_id", "tokens"), df.select(F.col("doc_id").alias("id"), "vec"), 8)
    z = {r.id: r.label for r in m.labels.collect()}
    assert len(set(z.values())) == 3 and all(z[i] == z[i % 3] for i in range(90))
    for k in range(3):
        assert len({r.term[:2] for r in m.top_words(5).filter(F.col("class") == k).collect()}) == 1
    p = m.transform(df.select(F.col("doc_id").alias("id"), "vec")).groupBy("id").agg(F.sum("p").alias("s"), F.max_by("label", "p").alias("l")).collect()
    assert all(abs(r.s - 1) < 1e-9 and r.l == z[r.id] for r in p)


def test_alignment_and_ensemble():
    rng = np.random.default_rng(2)
    a = rng.dirichlet(np.full(20, 0.1), 4)
    perm = np.array([2, 0, 3, 1])
    b = a[perm] + 1e-3
    assert align_topics(a, b)[0].tolist() == np.argsort(perm).tolist() == align_topics(a, b / b.sum(1, keepdims=True), "js")[0].tolist()
    assert topic_stability([a, b, a]) > 0.7 and np.allclose(ensemble_align([a, a[perm], a[::-1]]).sum(1), 1)


def test_stream_scores_every_document_once(spark, tmp_path):
    d = docs(spark, ["a", "b"] * 4, ["c", "d"] * 4, ["a"], [])
    m = LDA(2, alpha_sum=0.2).fit(d, iters=5, parts=1)
    d.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = score_stream(m, spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def test_entry_names_match(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 40
    assert {"topic", "class"} & set(e.entry(spark).columns)


@pytest.mark.parametrize("bad", [dict(num_topics=0), dict(num_topics=2, sampler="x")])
def test_bad_arguments(bad):
    with pytest.raises(ValueError):
        LDA(**bad)


def test_windows_are_counted_without_listing_their_starts(spark, monkeypatch):
    from corpusloom.operators import cooc

    rng = np.random.default_rng(3)
    rows = [(i, [f"w{x}" for x in rng.integers(0, 6, rng.integers(0, 30))]) for i in range(60)] + [(60, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>").repartition(3)
    top = spark.createDataFrame([(t, p, w) for t, ws in ((0, ["w0", "w1", "w2"]), (1, ["w2", "w4", "absent"])) for p, w in enumerate(ws)], "topic int, place int, term string")
    for window in (0, 4, 50):
        occ, co, n = {}, {}, 0
        for tokens in (t for _, t in rows if t):
            for s in range(max(0, len(tokens) - window) + 1 if window else 1):
                n += 1
                seen = set(tokens[s : s + window] if window else tokens)
                for w in seen & {"w0", "w1", "w2", "w4"}:
                    occ[w] = occ.get(w, 0) + 1
                for a, b in (("w0", "w1"), ("w0", "w2"), ("w1", "w2"), ("w2", "w4")):
                    if {a, b} <= seen:
                        co[a, b] = co.get((a, b), 0) + 1
        with monkeypatch.context() as m:
            m.setattr(cooc, "_starts", None)
            got = cooc.cooccurrence(d, top, window)
        assert {r["term"]: r["occ"] for r in got[0].collect()} == occ
        assert {(r["a"], r["b"]): r["co"] for r in got[1].collect()} == co and got[2].first()[0] == n
    # an id in several rows is one document
    twice = spark.createDataFrame([(1, ["w0", "w1"]), (1, ["w0", "w2"])], "doc_id bigint, tokens array<string>")
    assert {r["term"]: r["occ"] for r in cooc.cooccurrence(twice, top, 0)[0].collect()} == {"w0": 1, "w1": 1, "w2": 1}


def test_phi_needs_no_bag_of_words(spark, tmp_path, monkeypatch):
    from corpusloom.plans import catalogue as c

    rows = [(0, "ab cd ab ef", "en"), (1, "ab cd gh", " EN "), (2, None, "de"), (3, "ef zz gh ef", None)]
    for sf, more in (("one", []), ("two", [(0, "ab ij", "de")])):
        spark.createDataFrame(rows + more, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/{sf}/documents.parquet")
    c._memo.clear()
    with monkeypatch.context() as m:
        m.setattr(c.text, "bag_of_words", None)
        got = {(r["class"], r["term"]): r["tf"] for r in c._counts(spark, f"{tmp_path}/one", "lang").collect()}
        assert {(r["term"], r["df"], r["tf"]) for r in c._kept(spark, f"{tmp_path}/one").collect()} == {("ab", 2, 3), ("cd", 2, 2), ("ef", 2, 3), ("gh", 2, 2)}
    assert got == {("en", "ab"): 3, ("en", "cd"): 2, ("en", "ef"): 1, ("en", "gh"): 1, ("none", "ef"): 2, ("none", "gh"): 1}
    # rows of one id are one document, which then has both classes
    assert {(r["class"], r["term"]): r["tf"] for r in c._counts(spark, f"{tmp_path}/two", "lang").collect()} == got | {("en", "ab"): 4, ("de", "ab"): 3, ("de", "cd"): 1, ("de", "ef"): 1}
    c._memo.clear()
