"""Planted structure in small corpora."""

import numpy as np
import pytest

from corpusloom.functions import num
from corpusloom.models.dirichlet import GSDMM, LDA


def blocks(spark, k=3, per=60, words=8, length=12, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(b * per + i, [f"b{b}w{w}" for w in rng.integers(0, words, length)]) for b in range(k) for i in range(per)]
    return spark.createDataFrame(rows, "doc_id bigint, tokens array<string>")


def pure(model, k):
    return sorted({frozenset(w[:2] for w, _ in t) for t in model.top_words(6)}, key=str)


@pytest.mark.parametrize("sampler,iters", [("cvb0", 25), ("gibbs", 25)])
def test_lda_recovers_blocks(spark, sampler, iters):
    m = LDA(3, alpha_sum=0.3, sampler=sampler, seed=1).fit(blocks(spark), iters=iters, parts=2)
    assert pure(m, 3) == [frozenset({f"b{i}"}) for i in range(3)]
    assert np.allclose(m.topic_word.sum(1), 1, atol=1e-9)
    theta = m.doc_topic().toPandas()
    assert np.allclose(theta.groupby("doc_id").p.sum(), 1, atol=1e-6) and (theta.groupby("doc_id").p.max() > 0.8).all()
    assert m.perplexity(blocks(spark, seed=9)) < 12 and np.isfinite(m.log_likelihood())


def test_lda_is_deterministic_guided_and_labelled(spark):
    d = blocks(spark, per=20)
    a, b, c = (LDA(3, alpha_sum=0.3, seed=s).fit(d, iters=5, parts=2).topic_word for s in (1, 1, 2))
    assert np.array_equal(a, b) and not np.array_equal(a, c)
    g = LDA(3, alpha_sum=0.3, seed_words={2: ["b0w1", "b0w2"], 0: ["b1w1"]}).fit(d, iters=20, parts=2)
    assert all(w.startswith("b0") for w, _ in g.top_words(5)[2]) and all(w.startswith("b1") for w, _ in g.top_words(5)[0])
    labels = spark.createDataFrame([(i, [i // 20]) for i in range(60)], "doc_id bigint, topics array<int>")
    for sampler in ("cvb0", "gibbs"):
        m = LDA(3, sampler=sampler).fit(d, iters=4, labels=labels, parts=2)
        assert [{w[:2] for w, _ in t} for t in m.top_words(5)] == [{"b0"}, {"b1"}, {"b2"}]


@pytest.mark.parametrize("sampler", ["cvb0", "gibbs"])
def test_prior_is_fitted_on_all_documents(spark, sampler):
    # the documents above the 20,000 smallest ids are longer and of another block
    d = spark.sql("SELECT id AS doc_id, IF(id < 20000, array('a', 'b', 'a'), array('c', 'd', 'c', 'c', 'd', 'e', 'c', 'd')) AS tokens FROM range(26000)")
    m = LDA(2, alpha_sum=0.5, sampler=sampler, optimize_interval=1, seed=1, seed_words={0: ["a", "b"]}).fit(d, iters=2, parts=2)
    sizes = np.array([r[0] for r in m._state.select("size").collect()])
    assert len(sizes) == 26_000 and np.allclose(m.alpha, num.minka_alpha(sizes, np.full(2, 0.25)), rtol=1e-9)
    assert not np.allclose(m.alpha, num.minka_alpha(sizes[np.argsort(sizes.sum(1), kind="stable")[:20_000]], np.full(2, 0.25)), rtol=0.01)


@pytest.mark.parametrize("sampler,tol", [("cvb0", 1e-3), ("gibbs", 0.05)])
def test_fit_until_it_settles_and_averages_snapshots(spark, sampler, tol):
    d, seen = blocks(spark, per=20), []
    m = LDA(3, alpha_sum=0.3, sampler=sampler, seed=1)
    m.fit(d, iters=200, parts=2, convergence_tol=tol, check_every=3, num_samples=2, sample_interval=2, progress=lambda i, moved: seen.append(i))
    ends = len(seen) - 4
    assert m.converged and 9 < ends < 200
    # the same sweeps without averaging give the snapshots
    a, b = (LDA(3, alpha_sum=0.3, sampler=sampler, seed=1).fit(d, iters=ends + n, parts=2) for n in (2, 4))
    assert np.allclose(m.topic_word, (a.topic_word + b.topic_word) / 2, atol=1e-6)
    t = [x.doc_topic().toPandas().sort_values(["doc_id", "topic"]).p.to_numpy() for x in (m, a, b)]
    assert np.allclose(t[0], (t[1] + t[2]) / 2, atol=1e-6)


def test_documents_without_a_kept_word_have_a_row(spark):
    d = blocks(spark, per=20).unionByName(spark.createDataFrame([(100, ["rare"]), (101, []), (102, None)], "doc_id bigint, tokens array<string>"))
    theta = LDA(3, seed=1).fit(d, iters=2, min_doc_freq=2, parts=2).doc_topic().toPandas()
    assert set(theta.doc_id) == {*range(60), 100, 101, 102} and len(theta) == 63 * 3
    assert np.allclose(theta[theta.doc_id >= 100].p, 1 / 3)
    m = GSDMM(4, seed=1).fit(d, iters=3, min_doc_freq=2, parts=2)
    z = m.doc_cluster.toPandas()
    assert sorted(z.doc_id) == [*range(60), 100, 101, 102] and z.z.between(0, 3).all() and m.sizes.sum() == 63


def test_registered_fits_run_to_the_end(spark, monkeypatch):
    from corpusloom.plans import catalogue

    ran = {}

    def keep(self, docs, **k):
        ran[type(self).__name__, getattr(self, "sampler", "")] = k
        raise InterruptedError

    for model in (LDA, GSDMM):
        monkeypatch.setattr(model, "fit", keep)
    monkeypatch.setattr(catalogue, "_docs", lambda s, d: None)
    for name in ("lda_cvb0_topics", "lda_gibbs_topics", "lda_doc_topic", "gsdmm_clusters"):
        with pytest.raises(InterruptedError):
            catalogue.queries()[name](spark, "")
    assert ran["LDA", "cvb0"]["convergence_tol"] and ran["LDA", "cvb0"]["iters"] >= 1000
    assert ran["LDA", "gibbs"]["convergence_tol"] and ran["LDA", "gibbs"]["num_samples"] == 5
    assert ran["GSDMM", ""].get("iters", 30) >= 30


def test_save_load_and_transform(spark, tmp_path):
    m = LDA(3, alpha_sum=0.3, seed=1).fit(blocks(spark), iters=15, parts=2)
    m.save(str(tmp_path / "m"))
    n = LDA.load(spark, str(tmp_path / "m"))
    d = spark.createDataFrame([(1, ["b0w1"] * 6), (2, ["unknown"]), (3, None)], "doc_id bigint, tokens array<string>")
    x, y = (sorted(map(tuple, q.transform(d).collect())) for q in (m, n))
    assert np.allclose([r[2] for r in x], [r[2] for r in y]) and max(r[2] for r in x if r[0] == 1) > 0.8
    assert np.allclose([r[2] for r in x if r[0] > 1], 1 / 3)


def test_gsdmm_recovers_blocks(spark):
    m = GSDMM(8, seed=1).fit(blocks(spark, length=4, words=4), iters=12, parts=2)
    z = {r.doc_id: r.z for r in m.doc_cluster.collect()}
    assert all(len({z[i] for i in range(b * 60, b * 60 + 60)}) <= 3 for b in range(3)) and m.cluster_counts[-1] <= m.cluster_counts[0]
    assert not {z[i] for i in range(60)} & {z[i] for i in range(60, 120)}


def test_numbers():
    assert np.allclose(num.digamma([1.0, 0.5, 10]), [-0.5772156649, -1.9635100260, 2.2517525890], atol=1e-8)
    cost = np.random.default_rng(0).random((5, 7))
    import itertools

    best = min(sum(cost[i, p[i]] for i in range(5)) for p in itertools.permutations(range(7), 5))
    assert np.isclose(cost[np.arange(5), num.hungarian(cost)].sum(), best)
    x = num.lbfgs(lambda v: (float(((v - [1, 2]) ** 2 * [1, 30]).sum()), 2 * (v - [1, 2]) * [1, 30]), np.zeros(2))
    assert np.allclose(x, [1, 2], atol=1e-4)


def test_stm_recovers_blocks_and_the_covariate(spark):
    from corpusloom.models.logistic import STM

    rng = np.random.default_rng(3)
    rows = []
    for i in range(150):
        x = i % 2
        share = rng.dirichlet([6, 1, 1] if x else [1, 6, 1])
        rows.append((i, [f"b{b}w{rng.integers(0, 8)}" for b in rng.choice(3, 30, p=share)], float(x)))
    d = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>, x double")
    m = STM(3, seed=1).fit(d.select("doc_id", "tokens"), d.select("doc_id", "x"), ["x"], iters=12, parts=2)
    assert pure(m, 3) == [frozenset({f"b{i}"}) for i in range(3)]
    assert m.bound_history[-1] > m.bound_history[0] and np.allclose(m.topic_word.sum(1), 1)
    names = [t[0][0][:2] for t in m.top_words(1)]
    theta = m.doc_topic().toPandas().pivot(index="doc_id", columns="topic", values="p")
    lift = theta[theta.index % 2 == 1].mean() - theta[theta.index % 2 == 0].mean()
    assert lift[names.index("b0")] > 0.4 and lift[names.index("b1")] < -0.4
