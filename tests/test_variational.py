"""Logistic-normal models: kernels against finite differences, fits against planted structure."""

import numpy as np
from pyspark.sql import functions as F

from corpusloom.models import logistic as L
from corpusloom.models.base import Encoded
from corpusloom.models.spectral import moments, spectral_init
from test_models import blocks, pure


def test_gradient_and_modes():
    rng = np.random.default_rng(0)
    k, cells = 4, 30
    doc = np.sort(rng.integers(0, 5, cells))
    like, n, mu = rng.dirichlet(np.ones(cells), k).T, rng.integers(1, 5, cells).astype(float), rng.normal(size=(5, 3))
    a = rng.normal(size=(3, 3))
    prec = a @ a.T + np.eye(3)
    eta = rng.normal(size=(5, 3))
    total = np.bincount(doc, n, 5)
    g = L.gradient(eta, like, n, doc, total, mu, prec)[0]
    for d in range(5):
        for i in range(3):
            e = np.zeros((5, 3))
            e[d, i] = 1e-6
            up, down = (L.objective(eta + s * e, like, n, doc, total, mu, prec)[d] for s in (1, -1))
            assert abs((up - down) / 2e-6 - g[d, i]) < 1e-4
    best = L.modes(eta, like, n, doc, mu, prec)
    assert np.abs(L.gradient(best, like, n, doc, total, mu, prec)[0]).max() < 1e-3
    nu = L.laplace(best, like, n, doc, mu, prec)[0]
    assert all((np.linalg.eigvalsh(m) > 0).all() for m in nu)


def test_moments_and_spectral_start(spark):
    d = blocks(spark, k=3, per=40)
    enc = Encoded(d, parts=2)
    rows, p = moments(enc)
    q, used = np.zeros((len(p), len(p))), 0
    at = {t: i for i, t in enumerate(enc.terms)}
    for r in d.collect():
        c = np.bincount([at[t] for t in r.tokens], minlength=len(p)).astype(float)
        q += (np.outer(c, c) - np.diag(c)) / (c.sum() * (c.sum() - 1))
        used += 1
    assert np.allclose(p, q.sum(1) / used) and np.allclose(rows, q / used / p[:, None])
    beta = spectral_init(enc, 3)
    assert sorted({frozenset(enc.terms[i][:2] for i in np.argsort(-b)[:6]) for b in beta}, key=str) == [frozenset({f"b{i}"}) for i in range(3)]
    assert spectral_init(enc, 999) is None


def structural(spark, n=160, own=0.4):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        x, g = i % 2, "uv"[i // 2 % 2]
        share = rng.dirichlet([5, 1, 2] if x else [1, 5, 2])
        rows.append((i, [f"b{b}w{rng.integers(0, 6)}" if rng.random() >= own else f"b{b}{g}{rng.integers(0, 3)}" for b in rng.choice(3, 30, p=share)], float(x), g))
    return spark.createDataFrame(rows, "doc_id bigint, tokens array<string>, x double, group string")


def test_content_groups_transform_and_draws(spark):
    d = structural(spark)
    # words of one group only make anchors of their own, so the start is another one here
    m = L.STM(3, seed=1, init="cvb0").fit(d.select("doc_id", "tokens"), d.select("doc_id", "x"), ["x"], content=d.select("doc_id", "group"), iters=8, parts=2)
    assert m.groups == ["u", "v"] and m.topic_word_by_group.shape[:2] == (3, 2) and len(pure(m, 3)) == 3
    assert all(w[2] == "u" for w, _ in m.word_contrast(0, "u", "v", 3))
    draws = m.posterior_theta_samples(4, 1).toPandas()
    assert np.allclose(draws.groupby(["draw", "doc_id"]).p.sum(), 1) and draws.draw.nunique() == 4
    theta = m.doc_topic().toPandas().pivot(index="doc_id", columns="topic", values="p")
    again = m.transform(d.select("doc_id", "tokens"), d.select("doc_id", "x")).toPandas().pivot(index="doc_id", columns="topic", values="p")
    assert (theta.to_numpy().argmax(1) == again.to_numpy().argmax(1)).mean() > 0.9
    none = m.transform(spark.createDataFrame([(1, ["zzz"]), (2, None)], "doc_id bigint, tokens array<string>")).toPandas()
    assert np.allclose(none.p, 1 / 3)


def test_svi_ctm_and_elastic_net(spark):
    d = structural(spark, own=0).select("doc_id", "tokens")
    m = L.CTM(3, seed=1).fit(d, inference="svi", batch_size=40, tau=1, iters=4, parts=2)
    assert len(pure(m, 3)) == 3 and len(m.bound_history) == 4
    c = L.CTM(3, seed=1, variational="diagonal", init="random").fit(d, iters=6, parts=2)
    assert c.bound_history[-1] > c.bound_history[0] and c.topic_correlation().count() == 3
    rng = np.random.default_rng(5)
    x = np.c_[np.ones(200), rng.normal(size=(200, 5))]
    y = x @ [1, 2, 0, 0, 0, 0] + 0.3 * rng.normal(size=200)
    b = L.elastic_net(x.T @ x, x.T @ y, y @ y, 200)
    assert abs(b[1] - 2) < 0.1 and np.abs(b[2:]).max() < 0.1


def test_modes_leave_finished_documents(monkeypatch):
    from corpusloom.models import logistic

    rng = np.random.default_rng(4)
    per = np.array([2, 5, 40, 3, 60, 1, 0])
    doc, n = np.repeat(np.arange(7), per), rng.integers(1, 4, per.sum()).astype(float)
    like, mu, precision = rng.dirichlet(np.full(4, 0.1), per.sum()) + 1e-6, rng.normal(size=(7, 3)), np.diag([0.5, 1.0, 2.0])
    seen, plain = [], logistic.objective
    monkeypatch.setattr(logistic, "objective", lambda eta, *a: seen.append(len(eta)) or plain(eta, *a))
    eta = logistic.modes(mu.copy(), like, n, doc, mu, precision)
    g = logistic.gradient(eta, like, n, doc, np.bincount(doc, n, 7), mu, precision)[0]
    assert np.abs(g).max() < 1e-5 and np.allclose(eta[6], mu[6])
    # a step costs what the documents cost that still move
    assert min(seen) < 6 and seen[0] == 6
    nu = logistic.laplace(eta, like, n, doc, mu, precision)[0]
    for i in range(7):
        at = doc == i
        one = logistic.laplace(eta[i : i + 1], like[at], n[at], doc[at] * 0, mu[i : i + 1], precision)[0]
        assert np.allclose(nu[i], one[0]) and np.linalg.eigvalsh(nu[i])[0] > 0


def test_modes_are_reached_in_few_steps():
    # documents whose mode a bound of the curvature nears only slowly
    rng = np.random.default_rng(7)
    k, v, docs = 4, 40, 60
    beta = rng.dirichlet(np.full(v, 0.3), k)
    per = np.r_[0, rng.integers(1, 30, docs - 1)]
    doc = np.repeat(np.arange(docs), per)
    like, n, mu, precision = beta[:, rng.integers(0, v, len(doc))].T, rng.integers(1, 4, len(doc)).astype(float), np.zeros((docs, k - 1)), np.eye(k - 1) / 20
    eta = L.modes(mu.copy(), like, n, doc, mu, precision, steps=20)
    g = L.gradient(eta, like, n, doc, np.bincount(doc, n, docs), mu, precision)[0]
    assert np.abs(g).max() < 1e-4
    # the value never falls below that of the start, and no start is needed near the mode
    far = L.modes(rng.normal(0, 3, mu.shape), like, n, doc, mu, precision)
    total = np.bincount(doc, n, docs)
    best, other = (L.objective(e, like, n, doc, total, mu, precision) for e in (eta, far))
    assert (best <= L.objective(mu, like, n, doc, total, mu, precision) + 1e-9).all() and np.median(np.abs(best - other)) < 1e-6


def test_moments_are_those_of_dense_counts(spark, monkeypatch):
    from corpusloom.models import spectral
    from corpusloom.models.base import Encoded

    rng = np.random.default_rng(2)
    d = spark.createDataFrame([(i, [f"w{x:02}" for x in rng.integers(0, 30, 1 + i % 9)]) for i in range(400)], "doc_id bigint, tokens array<string>")
    enc = Encoded(d, parts=2)
    x = np.zeros((400, 30))
    for i, r in enumerate(d.collect()):
        np.add.at(x[i], [enc.terms.index(t) for t in r.tokens], 1)
    x = x[x.sum(1) > 1]
    pairs = x.sum(1) * (x.sum(1) - 1)
    q = (x / pairs[:, None]).T @ x - np.diag((x / pairs[:, None]).sum(0))
    p = (x / x.sum(1)[:, None]).sum(0) / len(x)
    rows, got = spectral.moments(enc)
    assert np.allclose(got, p) and np.allclose(rows, q / len(x) / p[:, None])
    monkeypatch.setattr(spectral, "WHOLE", 3)
    monkeypatch.setattr(spectral, "WIDTH", 16)
    signs = np.random.default_rng(spectral.SEED).choice([-1.0, 1.0], (30, 16))
    assert np.allclose(spectral.moments(enc)[0], q @ signs / len(x) / p[:, None], atol=1e-5)
