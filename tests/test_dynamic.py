"""Moving topics, sentiment and trees on planted data."""

import numpy as np
from pyspark.sql import functions as F

from corpusloom.models import dynamic as D


def test_chain_and_dynamic_topics(spark):
    c = np.array([[20.0, 5], [12, 12], [5, 20]])
    tight, loose = (np.exp(x := D.chain_mode(c, s)) / np.exp(x).sum(1, keepdims=True) for s in (1e-4, 100.0))
    assert np.allclose(loose, c / c.sum(1, keepdims=True), atol=0.03) and np.ptp(tight[:, 0]) < 0.05
    rng = np.random.default_rng(0)
    rows = []
    for t in range(3):
        for i in range(40):
            # one topic turns from early to late words, the other stays
            word = (lambda: f"m{'el'[int(rng.random() < t / 2)]}{rng.integers(0, 3)}") if i % 2 else (lambda: f"f{rng.integers(0, 6)}")
            rows.append((t * 100 + i, [word() for _ in range(12)], t))
    d = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>, time int")
    m = D.DTM(2, chain_variance=0.5, seed=1).fit(d.select("doc_id", "tokens"), d.select("doc_id", "time"), iters=6, parts=2)
    k = int(np.argmax([sum(p for w, p in zip(m.vocabulary, b) if w[0] == "m") for b in m.topic_word]))
    drift = m.word_drift(k, 6)
    assert all((v > 0) == (w[1] == "l") for w, v in drift) and max(abs(v) for _, v in m.word_drift(1 - k, 3)) < 0.12
    assert m.word_evolution().count() == 2 * 3 * len(m.vocabulary) and np.allclose(m.topic_word_at(1).sum(1), 1)
    assert np.allclose(m.doc_topic().toPandas().groupby("doc_id").p.sum(), 1)


def test_sentiment_gradient_and_fit(spark):
    rng = np.random.default_rng(1)
    k, v = 3, 12
    args = (np.log(rng.dirichlet(np.ones(v))), rng.normal(size=(k, v)), rng.normal(size=(k, v)), np.array([1, 4, 7]), np.array([2.0, 1, 3]), rng.normal(size=5), np.eye(5) * 1.3)
    a = rng.normal(size=5)
    g = D.sentiment_value(a, *args)[1]
    for i in range(5):
        e = np.zeros(5)
        e[i] = 1e-6
        assert abs((D.sentiment_value(a + e, *args)[0] - D.sentiment_value(a - e, *args)[0]) / 2e-6 - g[i]) < 1e-4
    rows = []
    for i in range(84):
        s, t = i % 3 - 1, i // 3 % 2
        rows.append((i, [f"t{t}{'np'[int(rng.random() < 0.5 + 0.4 * s)]}{rng.integers(0, 3)}" for _ in range(12)], float(s), float(t)))
    d = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>, s double, x double")
    m = D.STS(2, seed=1).fit(d.select("doc_id", "tokens"), d.select("doc_id", "s"), d.select("doc_id", "x"), ["x"], iters=6, parts=2)
    up, down = m.topic_word_at(1.0), m.topic_word_at(-1.0)
    pos = np.array([w[2] == "p" for w in m.vocabulary])
    assert ((up[:, pos].sum(1) - down[:, pos].sum(1)) > 0.3).all() and m.sentiment().count() == 168
    mean = {r.seed: r.m for r in m.sentiment().join(d.select("doc_id", F.col("s").alias("seed")), "doc_id").groupBy("seed").agg(F.avg("s").alias("m")).collect()}
    assert mean[1.0] > mean[-1.0] and m.bound_history[-1] >= m.bound_history[0]


def test_tree_of_topics(spark):
    rng = np.random.default_rng(2)
    d = spark.createDataFrame([(i, [f"c{j}" for j in rng.integers(0, 3, 6)] + [f"b{i % 2}w{j}" for j in rng.integers(0, 5, 8)]) for i in range(60)], "doc_id bigint, tokens array<string>")
    m = D.HLDA(depth=2, gamma=0.1, beta=0.1, alpha=1.0, seed=3).fit(d, iters=25, parts=2)
    assert m.node_levels[0] == 0 and m.node_parents[0] == -1 and set(m.node_parents[1:]) == {0} and 2 <= len(m.leaves) <= 12
    paths = {r.doc_id: r.path for r in m.doc_paths().collect()}
    assert len(paths) == 60 and all(len(p) == 2 and p[0] == 0 for p in paths.values())
    shared = sum(p for w, p in zip(m.vocabulary, m.topic_word[0]) if w[0] == "c")
    assert shared > 0.5 and m.log_likelihood_history[-1] > m.log_likelihood_history[0]
    top = [max(set(x), key=x.count) for x in ([paths[i][1] for i in range(b, 60, 2)] for b in (0, 1))]
    assert top[0] != top[1] and m.nodes().count() == m.num_nodes


def one_document(a, m, base, slope, w, n, mu, prec, steps: int = 30):
    """(mode, covariance, expected counts, bound) of one document; the curvature is taken from differences of the gradient."""
    a = D.lbfgs(lambda z: D.sentiment_value(z, m, base, slope, w, n, mu, prec)[:2], a, steps)
    value, g, phi = D.sentiment_value(a, m, base, slope, w, n, mu, prec)
    h = np.empty((len(a), len(a)))
    for i in range(len(a)):
        e = np.zeros(len(a))
        e[i] = 1e-4
        h[i] = (D.sentiment_value(a + e, m, base, slope, w, n, mu, prec)[1] - D.sentiment_value(a - e, m, base, slope, w, n, mu, prec)[1]) / 2e-4
    h = (h + h.T) / 2
    if np.linalg.eigvalsh(h)[0] <= 1e-8:
        h = D.make_dominant(h) + 1e-6 * np.eye(len(a))
    return a, np.linalg.inv(h), phi, -value - 0.5 * np.linalg.slogdet(h)[1] + 0.5 * np.linalg.slogdet(prec)[1]


def test_sentiment_modes_of_many_documents():
    """F16: documents were taken one by one, each step over the whole vocabulary; together they reach the same modes."""
    rng = np.random.default_rng(3)
    k, v, count = 3, 40, 30
    m, base, slope = np.log(rng.dirichlet(np.ones(v))), rng.normal(size=(k, v)), 2 * rng.normal(size=(k, v))
    norm = D.Normalizers(m, base, slope)
    s = np.r_[rng.normal(size=(50, k)) * 4, [[-40.0, 15.999, 16.0], [0.0, -16.0, 33.0]]]
    value, mean, var = norm(s)
    p = [D.softmax(m + base + slope * x[:, None]) for x in s]
    assert np.allclose(value, [D.logsumexp(m + base + slope * x[:, None]) for x in s], rtol=0, atol=1e-9)
    assert np.allclose(mean, [(q * slope).sum(1) for q in p], atol=1e-7) and np.allclose(var, [(q * slope**2).sum(1) - (q * slope).sum(1) ** 2 for q in p], atol=1e-5)
    per = rng.integers(1, 9, count)
    w = np.concatenate([np.sort(rng.choice(v, i, replace=False)) for i in per])
    n, mu, prec = rng.integers(1, 4, len(w)).astype(float), rng.normal(size=(count, 2 * k - 1)), np.linalg.inv(np.cov(rng.normal(size=(5, 50))))
    a = rng.normal(size=mu.shape)
    got, g, h, phi = D.sentiment_curves(a, norm, w, n, per, mu, prec)
    ends = np.cumsum(per)
    each = [(m, base, slope, w[e - i : e], n[e - i : e], mu[j], prec) for j, (i, e) in enumerate(zip(per, ends))]
    for j, args in enumerate(each):
        one = D.sentiment_value(a[j], *args)
        assert np.isclose(got[j], one[0]) and np.allclose(g[j], one[1], atol=1e-7) and np.allclose(phi[ends[j] - per[j] : ends[j]].T, one[2], atol=1e-8)
        for i, e in enumerate(np.eye(5) * 1e-5):
            assert np.allclose((D.sentiment_value(a[j] + e, *args)[1] - D.sentiment_value(a[j] - e, *args)[1]) / 2e-5, h[j, i], atol=1e-4)
    a, nu, phi, bound = D.sentiment_modes(mu, norm, w, n, per, mu, prec)
    same = 0
    for j, args in enumerate(each):
        assert np.abs(D.sentiment_value(a[j], *args)[1]).max() < 1e-5
        one = one_document(mu[j], *args)
        if np.allclose(a[j], one[0], atol=1e-3):  # a posterior may have several modes
            same += 1
            assert np.allclose(nu[j], one[1], atol=1e-3) and np.isclose(bound[j], one[3], atol=1e-3)
    assert same >= 0.8 * count
