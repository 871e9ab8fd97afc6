"""Held-out evaluation, residuals, human tests and panels on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

from corpusloom.models.dirichlet import LDA
from corpusloom.operators import selection
from corpusloom.plans import panels
from test_models import blocks


def fitted(spark):
    d = blocks(spark, k=3, per=30)
    m = LDA(3, alpha_sum=0.3, seed=1).fit(d, iters=20, parts=2)
    return d, m, m.phi().cache(), m.doc_topic().cache()


def test_heldout_splits_exactly(spark):
    d = blocks(spark, per=20)
    train, held = selection.make_heldout(d, 0.5, 0.25, seed=3)
    a, b = {r.doc_id: r.tokens for r in train.collect()}, {r.doc_id: r.tokens for r in held.collect()}
    assert len(a) == 60 and len(b) == 30 and all(len(t) == 3 for t in b.values())
    for r in d.collect():
        assert sorted(a[r.doc_id] + b.get(r.doc_id, [])) == sorted(r.tokens)


def test_residuals_equal_numpy(spark):
    d, m, phi, theta = fitted(spark)
    bow = d.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("cnt"))
    got = selection.check_residuals(bow, theta, phi)
    t = theta.toPandas().pivot(index="doc_id", columns="topic", values="p").sort_index()
    q = np.clip(t.to_numpy() @ m.topic_word, 1e-12, 1 - 1e-12)
    x = np.zeros_like(q)
    for r in bow.collect():
        x[list(t.index).index(r.doc_id), m.vocabulary.index(r.term)] = r.cnt
    n = x.sum(1, keepdims=True)
    stat = ((x**2 - 2 * x * q * n) / (n * q * (1 - q)) + n * q / (1 - q)).sum()
    df = (q * n > 0.01).sum() - q.shape[1] - (90 * 2 + 3 * (q.shape[1] - 1))
    assert got["df"] == df and (df <= 0 or np.isclose(got["dispersion"], stat / df))


def test_human_tests_and_labels(spark):
    d, m, phi, theta = fitted(spark)
    for r in selection.word_intrusion(phi, 5).collect():
        assert len(r.words) == 6 and r.words[r.intruder_index] == r.intruder
        top = [w for w, _ in m.top_words(5)[r.topic]]
        assert r.intruder not in top and set(r.words) == {*top, r.intruder}
    for r in selection.document_intrusion(theta, 3).collect():
        assert len(r.docs) == 4 and r.docs[r.intruder_index] == r.intruder
    texts = d.select("doc_id", F.array_join("tokens", " ").alias("text"))
    prompts = selection.topic_label_prompts(phi, theta, texts)
    assert selection.llm_topic_labels(prompts, lambda p: p.split("Words: ")[1][:2]) == {k: m.top_words(1)[k][0][0][:2] for k in range(3)}
    assert "<mark>" in selection.find_thoughts_html(theta, texts, [w for w, _ in m.top_words(3)[0]], 0)
    labels = d.select("doc_id", F.when(F.col("doc_id") < 5, -1).otherwise(0).alias("label"))
    info = {r.topic: r for r in selection.topic_info(theta, phi, labels, {0: "zero"}).collect()}
    assert info[-1].docs == 5 and info[0].label == "zero" and info[0].docs == 85 and info[1].docs == 0
    assert "3 topics" in selection.summary(m) and selection.check_conformance(m) == []


def test_mmr_avoids_near_words(spark):
    phi = spark.createDataFrame([(0, w, p) for w, p in (("a", 0.5), ("a2", 0.3), ("b", 0.2))], "topic int, term string, prob double")
    emb = spark.createDataFrame([("a", [1.0, 0.0]), ("a2", [1.0, 0.01]), ("b", [0.0, 1.0])], "term string, vec array<double>")
    pick = lambda d: [r.term for r in selection.mmr(phi, emb, 2, d).orderBy("place").collect()]
    assert pick(0.0) == ["a", "a2"] and pick(0.7) == ["a", "b"]


def test_search_and_selection(spark):
    d = blocks(spark, k=3, per=20)
    train, held = selection.make_heldout(d)
    s = selection.search_k(train, [2, 3], lambda k, seed: LDA(k, alpha_sum=0.3, seed=seed), lambda m, x: m.fit(x, iters=15, parts=2), held)
    assert s.best_k() == 3 and s.best_k("frontier") in (2, 3) and s.to_frame(spark).count() == 2
    r = selection.select_model(d, lambda seed: LDA(3, alpha_sum=0.3, seed=seed), runs=3, fraction=0.5, iters=10, burn_in_iters=3, fit=lambda m, x, i: m.fit(x, iters=i, parts=2))
    assert len(r.models) == 2 and r.best in r.models


def test_panels(spark):
    d, m, phi, theta = fitted(spark)
    for by in ("prob", "frex", "lift", "score"):
        assert panels.term_barchart(phi, by, 4).count() == 12
    gaps, order = panels.topic_similarity(m.topic_word)
    assert sorted(order) == [0, 1, 2] and np.allclose(np.diag(gaps), 0, atol=1e-9)
    assert panels.topic_correlation_clr(theta).count() == 3 and panels.document_map(theta, [0, 1, 2]).count() == 90
    assert np.allclose(panels.partial_correlation(np.eye(3)), np.eye(3) * 2 - 1 * np.eye(3))
    near = panels.document_inspector(theta, 3)["neighbours"].collect()
    assert len(near) == 5 and all(r.doc_id < 30 for r in near)
    assert panels.term_topic_browser(phi, 5).count() == 15 and set(panels.dashboard(d, phi, theta)) >= {"terms", "health"}
    assert panels.capabilities(m)["terms"] and not panels.capabilities(m)["content"]
    heat = panels.prevalence_heatmap(theta, d.select("doc_id", F.lit("x").alias("level")), [0, 1, 2]).first()
    assert abs(heat["0"] + heat["1"] + heat["2"] - 1) < 1e-9
