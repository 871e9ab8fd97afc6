"""Planted structure for the models that share the cell sampler."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.models import gibbs
from test_models import blocks, pure


def test_dmr_follows_the_covariate(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [f"{'ab'[int(rng.random() < (0.9 if i % 2 else 0.1))]}{rng.integers(0, 4)}" for _ in range(8)], float(i % 2)) for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>, x double")
    m = gibbs.DMR(2, optimize_interval=10, burn_in=10, seed=1).fit(d.select("doc_id", "tokens"), d.select("doc_id", "x"), ["x"], iters=40, parts=2)
    k = [t[0][0][0] for t in m.top_words(1)].index("b")
    assert m.feature_effects[k, 1] - m.feature_effects[1 - k, 1] > 1
    theta = m.doc_topic().toPandas()
    assert np.allclose(theta.groupby("doc_id").p.sum(), 1) and len(m.effects_frame().collect()) == 4


def test_gdmr_surface(spark):
    assert np.allclose(gibbs.legendre(np.array([0.5, 2.0]), 2), [[1, 0.5, -0.125], [1, 1, 1]])
    rng = np.random.default_rng(1)
    rows = [(i, [f"{'ab'[int(rng.random() < (0.9 if x > 0.5 else 0.1))]}{rng.integers(0, 4)}" for _ in range(10)], float(x)) for i, x in enumerate(rng.random(150))]
    d = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>, x double")
    m = gibbs.GDMR(2, degrees=[2], optimize_interval=10, burn_in=10, seed=1).fit(d.select("doc_id", "tokens"), d.select("doc_id", "x"), ["x"], iters=30, parts=2)
    k = [t[0][0][0] for t in m.top_words(1)].index("b")
    s = m.tdf_linspace(0, 1, 5)
    assert s[-1, k] - s[0, k] > 0.3 and np.allclose(s.sum(1), 1)


def test_labeled_and_seeded(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(90):
        own = rng.choice(3, rng.integers(1, 3), replace=False)
        rows.append((i, [f"b{k}w{rng.integers(0, 8)}" for k in rng.choice(own, 12)], [f"L{k}" for k in own]))
    d = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>, labels array<string>")
    m = gibbs.LabeledLDA(seed=1).fit(d.select("doc_id", "tokens"), d.select("doc_id", "labels"), iters=20, parts=2)
    assert m.topic_names == ["L0", "L1", "L2"] and [{w[:2] for w, _ in t} for t in m.top_words(5)] == [{"b0"}, {"b1"}, {"b2"}]
    s = gibbs.SeededLDA({"one": ["b1w0", "b1w1"], "two": ["b2w0", "b2w1"]}, residual=1, seed=1).fit(d.select("doc_id", "tokens"), iters=30, parts=2, num_samples=2, keep_theta_draws=True)
    assert [{w[:2] for w, _ in t} for t in s.top_words(4)] == [{"b1"}, {"b2"}, {"b0"}] and s.topic_names[2] == "other_1"
    assert s.theta_draws.select("draw").distinct().count() == 2


def test_keyatm_base_covariates_dynamic(spark):
    d = blocks(spark, k=3, per=40)
    keys = {"first": ["b0w0", "b0w1"], "second": ["b1w0"]}
    m = gibbs.KeyATM(keys, num_topics=3, seed=1).fit(d, iters=25, parts=2)
    assert [{w[:2] for w, _ in t} for t in m.top_words(5)] == [{"b0"}, {"b1"}, {"b2"}]
    assert m.keyword_rate()[2] == 0 and 0.05 < m.keyword_rate()[0] < 0.6 and np.allclose(m.topic_word.sum(1), 1)
    x = d.select("doc_id", (F.col("doc_id") < 40).cast("double").alias("x"))
    c = gibbs.KeyATM(keys, num_topics=3, seed=1).fit(d, covariates=x, names=["x"], iters=25, parts=2)
    assert c.feature_effects[0, 1] > max(c.feature_effects[1:, 1])
    t = d.select("doc_id", F.when(F.col("doc_id") < 40, F.pmod("doc_id", F.lit(4))).otherwise(4 + F.pmod("doc_id", F.lit(4))).cast("int").alias("stamp"))
    y = gibbs.KeyATM(keys, num_topics=3, seed=1).fit(d, timestamps=t, num_states=2, iters=31, parts=2)
    assert y.time_state[0] == 0 and (np.diff(y.time_state) >= 0).all() and y.time_state[-1] == 1
    p = {(r.stamp, r.topic): r.prevalence for r in y.time_prevalence().collect()}
    assert p["0", 0] > 0.5 > p["7", 0] and abs(sum(r.p for r in y.doc_topic().filter("doc_id = 3").collect()) - 1) < 1e-9
    assert gibbs.KeyATM.weighted_lda(3, seed=1).fit(d, iters=15, parts=2).topic_word.shape[0] == 3


def test_pachinko_sage_hdp(spark):
    d = blocks(spark, k=4, per=30)
    m = gibbs.PA(2, 4, seed=1).fit(d, iters=30, parts=2)
    assert np.allclose(m.super_sub().sum(1), 1) and len(pure(m, 4)) >= 3 and np.allclose(m.doc_topic().toPandas().groupby("doc_id").p.sum(), 1)
    rng = np.random.default_rng(5)
    rows = [(i, [f"t{i // 2 % 2}{'xy'[i % 2]}{rng.integers(0, 4)}" for _ in range(10)] + [f"t{i // 2 % 2}c{rng.integers(0, 3)}" for _ in range(6)], "xy"[i % 2]) for i in range(120)]
    g = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>, group string")
    s = gibbs.SAGE(2, seed=3).fit(g.select("doc_id", "tokens"), g.select("doc_id", "group"), iters=25, parts=2)
    assert s.topic_word_by_group.shape[:2] == (2, 2)
    assert all(w[2] == "x" for w, _ in s.word_contrast(0, "x", "y", 3))
    h = gibbs.HDP(alpha=0.5, gamma=1.0, max_topics=15, seed=1).fit(d, iters=40, parts=2)
    assert 3 <= h.num_topics <= 10 and h.topic_word.shape[0] == h.num_topics
    assert np.allclose(h.doc_topic().toPandas().groupby("doc_id").p.sum(), 1)


def test_embedding_lda_and_saving(spark, tmp_path):
    rng = np.random.default_rng(6)
    words = spark.createDataFrame([(f"b{k}w{j}", (np.eye(3, 6)[k] * 3 + 0.2 * rng.normal(size=6)).tolist()) for k in range(3) for j in range(8)], "term string, vec array<double>")
    d = blocks(spark, per=20)
    vec = d.select("doc_id", F.expr("array(if(doc_id < 20, 3.0D, 0.0D), if(doc_id between 20 and 39, 3.0D, 0.0D), if(doc_id > 39, 3.0D, 0.0D), 0D, 0D, 0D)").alias("vec"))
    m = gibbs.EmbeddingLDA(3, top_m=4, seed=1).fit(d, words, vec, iters=15, parts=2)
    assert pure(m, 3) == [frozenset({f"b{i}"}) for i in range(3)]
    m.save(str(tmp_path / "m"))
    n = gibbs.EmbeddingLDA.load(spark, str(tmp_path / "m"))
    assert np.array_equal(n.topic_word, m.topic_word) and n.doc_topic().count() == 180
    with pytest.raises(ValueError):
        gibbs.PA.load(spark, str(tmp_path / "m"))
    k = gibbs.EmbeddingKeyATM({"a": ["b0w0"], "b": ["b1w0"]}, num_topics=3, seed=1).fit(d, words, vec, iters=10, parts=2)
    assert np.allclose(k.topic_word.sum(1), 1)


def test_state_is_packed(spark):
    from corpusloom.models.base import Encoded
    from corpusloom.models.engine import token_counts

    rows = [(1, ["a", "b", "a"]), (1, ["b", "c"]), (2, ["a", None, "c", "c", "c"]), (3, None), (4, ["rare"]), (None, ["a", "a"])]
    enc = Encoded(spark.createDataFrame(rows, "doc_id bigint, tokens array<string>"), min_doc_freq=2, parts=2)
    got = {r["doc_id"]: np.frombuffer(bytes(r["bag"]), np.int32).reshape(-1, 2).tolist() for r in enc.docs.collect()}
    assert enc.terms == ["a", "c"] and got == {1: [[0, 2], [1, 1]], 2: [[0, 1], [1, 3]], None: [[0, 2]]}
    assert {r["doc_id"] for r in enc.wordless().collect()} == {3, 4} and enc.frequencies().tolist() == [5, 4]
    m = gibbs.HDP(max_topics=3, seed=1).fit(enc, iters=3)
    for r in m._state.collect():
        n = np.array([c for _, c in got[r["doc_id"]]])
        z = np.frombuffer(bytes(r["g"]), np.uint8).astype(int)
        assert len(z) == n.sum() and np.allclose(token_counts(z, n, 3).sum(0), r["size"])
    assert np.isclose(m._counts.sum(), 9)


def test_tokens_are_redrawn_given_all_others():
    from corpusloom.models.engine import by_rank
    from corpusloom.models.gibbs import redrawn

    # two documents of one word each: the chance of every state, the token's own count left out
    table, alpha, draws = np.array([[3.5, 1.5], [2.5, 4.5], [0.5, 0.5]]), np.array([0.2, 0.7]), []
    nd, total, seen = np.array([2.0, 1.0]), table.sum(0), np.zeros(2)
    for i in range(3000):
        z = np.array([0, 0, 1], np.uint8)
        t = table.astype(np.float32)
        new, _ = redrawn(np.array([0, 0, 1], np.uint16), z, np.array([3]), t, total.copy(), alpha, np.random.default_rng(i))
        seen[new[0]] += 1
        assert np.allclose(t - table, np.bincount(np.array([0, 0, 1]) * 2 + new, minlength=6).reshape(3, 2) - np.array([[2, 0], [0, 1], [0, 0]]))
    p = (nd - [1, 0] + alpha) * (table[0] - [1, 0]) / (total - [1, 0])
    assert abs(seen[0] / 3000 - p[0] / p.sum()) < 0.03
    per = np.array([1, 3, 2])
    assert by_rank(per).tolist() == [1, 4, 0, 2, 5, 3]


def test_a_sweep_writes_blocks_of_documents(spark, monkeypatch):
    from corpusloom.models import dirichlet

    wrote, cut = [], dirichlet.cut
    monkeypatch.setattr(dirichlet, "cut", lambda df: wrote.append(cut(df)) or wrote[-1])
    d = spark.sql("SELECT id AS doc_id, transform(sequence(0, int(id % 7)), i -> concat('w', (i * id) % 5)) AS tokens FROM range(3000)")
    m = dirichlet.LDA(2, sampler="gibbs", seed=3).fit(d, iters=3, parts=2)
    # a row for each batch of documents and a few of sums, not a row for each document
    assert wrote and all(x.count() < 20 for x in wrote[-1:])
    rows = {r.doc_id: r for r in m._state.collect()}
    tokens = {r.doc_id: r.tokens for r in d.collect()}
    assert rows.keys() == tokens.keys() and all(sum(rows[i].size) == len(tokens[i]) for i in rows)
    counts, words = np.zeros((2, len(m.vocabulary))), {}
    for r in m.assignments().collect():
        counts[r.topic, r.typeindex] += 1
        words.setdefault(r.doc_id, []).append(r.term)
    assert np.array_equal(counts, m.counts) and all(sorted(words[i]) == sorted(tokens[i]) for i in tokens)
