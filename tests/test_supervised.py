"""A response that follows the topics, and texts of two words."""

import numpy as np

from corpusloom.functions.num import digamma
from corpusloom.models import supervised
from corpusloom.models.supervised import PT, SupervisedLDA
from test_models import pure


def test_response_is_predicted(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(150):
        p = rng.random()
        rows.append((i, [f"b{int(rng.random() < p)}w{rng.integers(0, 6)}" for _ in range(20)], float(2 * p - 1 + 0.1 * rng.uniform(-1, 1))))
    d = spark.createDataFrame(rows, "doc_id bigint, tokens array<string>, y double")
    m = SupervisedLDA(2, seed=1).fit(d.select("doc_id", "tokens"), d.select("doc_id", "y"), iters=12, parts=2)
    k = [t[0][0][:2] for t in m.top_words(1)].index("b1")
    assert m.coefficients[k] > 0.5 > -0.5 > m.coefficients[1 - k] and m.sigma2 < 0.2
    new = d.select("doc_id", "tokens").unionByName(spark.createDataFrame([(999, ["zz"]), (998, None)], "doc_id bigint, tokens array<string>"))
    got = {r.doc_id: r.y for r in m.predict(new).collect()}
    y = np.array([r[2] for r in rows])
    assert np.corrcoef(y, [got[i] for i in range(150)])[0, 1] > 0.85 and got[999] == got[998] == 0.0
    assert np.allclose(m.doc_topic().toPandas().groupby("doc_id").p.sum(), 1)


def test_pseudo_documents_join_short_texts(spark):
    rng = np.random.default_rng(1)
    d = spark.createDataFrame([(i, [f"b{i % 2}w{w}" for w in rng.integers(0, 7, 3)]) for i in range(160)], "doc_id bigint, tokens array<string>")
    m = PT(2, num_pseudo=8, seed=2).fit(d, iters=40, parts=2, keep_theta_draws=2)
    assert len(pure(m, 2)) == 2 and np.allclose(m.doc_topic().toPandas().groupby("doc_id").p.sum(), 1)
    assert m.theta_draws.select("draw").distinct().count() == 2 and m.log_likelihood_history[-1] > m.log_likelihood_history[1]


def response_one_by_one(like, n, doc, count, eta, sigma2, alpha, y=None, steps=15):
    gamma, phi = np.empty((count, like.shape[1])), np.empty(like.shape)
    for d in range(count):
        at, total = doc == d, n[doc == d].sum()
        p, g = np.full(like[at].shape, 1 / like.shape[1]), alpha + total / like.shape[1] * np.ones(like.shape[1])
        for _ in range(steps):
            x = digamma(g) + np.log(np.maximum(like[at], 1e-300))
            if y is not None and np.isfinite(y[d]):
                m = max(total, 1)
                rest = ((p * n[at][:, None]).sum(0) - p) @ eta
                x = x + y[d] * eta / (m * sigma2) - (2 * rest[:, None] * eta + eta * eta) / (2 * m * m * sigma2)
            p = np.exp(x - x.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = alpha + (p * n[at][:, None]).sum(0)
        gamma[d], phi[at] = g, p
    return gamma, phi


def test_shares_of_documents_in_blocks(monkeypatch):
    """shares are worked out in blocks of documents; a document without a response isn't pulled towards 0."""
    monkeypatch.setattr(supervised, "CELLS", 12)
    rng = np.random.default_rng(2)
    per = np.array([0, 3, 1, 30, 0, 0, 5, 2, 4, 0])
    doc = np.repeat(np.arange(10), per)
    like, n, eta = rng.dirichlet(np.ones(50), 4).T[rng.integers(0, 50, len(doc))], rng.integers(1, 4, len(doc)).astype(float), rng.normal(size=4)
    y = np.where(np.arange(10) == 6, np.nan, 2 * rng.normal(size=10))
    like[3] = 0
    for args in ((1.0, 0.1, None), (1.0, 0.1, y), (0.01, 1e-4, y), (1e-6, 0.1, y)):
        got, want = (f(like, n, doc, 10, eta, *args) for f in (supervised.response_step, response_one_by_one))
        assert np.allclose(got[0], want[0], atol=1e-8) and np.allclose(got[1], want[1], atol=1e-8)


def test_texts_move_between_pseudo_documents_by_rising_factorials():
    from corpusloom.functions.num import lgamma
    from corpusloom.models.supervised import rehomed

    rng, alpha = np.random.default_rng(4), 0.3
    size, at = rng.integers(0, 4, (5000, 3)), rng.integers(0, 4, 5000)
    size[:4000] = [2, 0, 1]
    at[:4000] = 1
    pseudo = np.zeros((4, 3))
    np.add.at(pseudo, at, size)
    pseudo += [[900_000, 0, 0], [0, 0, 0], [300_000, 0, 600_000], [0, 5, 0]]
    base = pseudo.copy()
    base[1] -= size[0]
    base += alpha
    lp = (lgamma(base + size[0]) - lgamma(base)).sum(1) - lgamma(base.sum(1) + 3) + lgamma(base.sum(1))
    before = pseudo.copy()
    new = rehomed(size, at, pseudo, alpha, np.random.default_rng(1))
    share = np.bincount(new[:500], minlength=4) / 500
    assert np.abs(share - np.exp(lp) / np.exp(lp).sum()).max() < 0.08
    np.add.at(before, new, size)
    np.subtract.at(before, at, size)
    assert np.array_equal(before, pseudo)
