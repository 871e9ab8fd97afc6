"""Effects and their uncertainty against NumPy."""

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import design, effects


def frames(spark, draws=1, n=60, seed=0):
    rng = np.random.default_rng(seed)
    x, g = rng.normal(size=n), rng.integers(0, 3, n)
    base = 1 / (1 + np.exp(-(0.3 + 0.8 * x)))
    rows = [(i, k, d, float(np.clip((p if k == 0 else 1 - p), 1e-3, 1))) for d in range(draws) for i, q in enumerate(base) for p in [np.clip(q + 0.03 * rng.normal(), 0.01, 0.99)] for k in (0, 1)]
    th = spark.createDataFrame(rows, "doc_id int, topic int, draw int, p double")
    xs = spark.createDataFrame([(i, float(a), "abc"[b]) for i, (a, b) in enumerate(zip(x, g))], "doc_id int, x double, g string")
    return th, xs, x, g, rows


def test_links_equal_reweighted_least_squares(spark):
    th, xs, x, _, rows = frames(spark)
    y = np.array([r[3] for r in rows if r[1] == 0])
    m = np.c_[np.ones(len(x)), x]
    for link, inverse, var in (("logit", lambda e: 1 / (1 + np.exp(-e)), lambda u: u * (1 - u)), ("log", np.exp, lambda u: u)):
        b = np.zeros(2)
        for _ in range(50):
            u = inverse(m @ b)
            w = var(u)
            b = np.linalg.solve(m.T @ (m * w[:, None]), m.T @ (w * (m @ b + (y - u) / w)))
        u = inverse(m @ b)
        bread = np.linalg.inv(m.T @ (m * var(u)[:, None]))
        s = m * (y - u)[:, None]
        se = np.sqrt(np.diag(bread @ (s.T @ s) @ bread) * len(y) / (len(y) - 2))
        got = [r for r in design.estimate_effect(th.drop("draw"), xs, ["x"], link=link) if r["topic"] == 0]
        assert np.allclose([r["coef"] for r in got], b, atol=1e-6) and np.allclose([r["se"] for r in got], se, atol=1e-6)


def test_draws_are_pooled(spark):
    th, xs, x, _, rows = frames(spark, draws=3)
    m = np.c_[np.ones(len(x)), x]
    inv = np.linalg.inv(m.T @ m)
    b, cov = [], []
    for d in range(3):
        y = np.array([r[3] for r in rows if r[1] == 0 and r[2] == d])
        b.append(inv @ m.T @ y)
        cov.append(inv * ((y - m @ b[-1]) ** 2).sum() / (len(y) - 2))
    want = np.mean(cov, 0) + 4 / 3 * np.cov(np.array(b), rowvar=False)
    got = [r for r in design.estimate_effect(th, xs, ["x"]) if r["topic"] == 0]
    assert np.allclose([r["coef"] for r in got], np.mean(b, 0)) and np.allclose([r["se"] for r in got], np.sqrt(np.diag(want)))


def test_formula_keeps_levels_and_knots(spark):
    _, xs, x, g, _ = frames(spark)
    d, spec = design.design_matrix("~ x * g + spline(x, df=3)", xs, "doc_id")
    assert spec.names == ["x", "g[b]", "g[c]", "x:g[b]", "x:g[c]", "spline(x,df=3)[1]", "spline(x,df=3)[2]", "spline(x,df=3)[3]"]
    one = spec.apply(xs.filter("doc_id = 5"), "doc_id").first()
    whole = d.filter("doc_id = 5").first()
    assert one == whole and one["x:g[b]"] == (x[5] if g[5] == 1 else 0)


def test_predicted_prevalence(spark):
    th, xs, *_ = frames(spark)
    r = {(a.topic, a.at): a for a in design.predicted_prevalence(th.drop("draw"), xs, "~ x + g", contrast=("g", "a", "b")).collect()}
    assert abs(r[0, "difference"].estimate - (r[0, "b"].estimate - r[0, "a"].estimate)) < 1e-12 and r[0, "a"].low < r[0, "a"].estimate < r[0, "a"].high
    grid = design.predicted_prevalence(th.drop("draw"), xs, "~ x", continuous="x", npoints=5).filter("topic = 0").collect()
    assert len(grid) == 5 and grid[-1].estimate > grid[0].estimate


def test_draws_and_bands(spark):
    th, xs, *_ = frames(spark)
    theta, n = th.drop("draw"), xs.select("doc_id", F.lit(50).alias("n"))
    a, b = (effects.dirichlet_theta_samples(theta, n, 6, 3).toPandas().sort_values(["draw", "doc_id", "topic"]).p.to_numpy() for _ in range(2))
    assert np.array_equal(a, b) and np.allclose(a.reshape(-1, 2).sum(1), 1)
    draws = effects.dirichlet_theta_samples(theta, n, 6, 3)
    assert effects.resample_draws(draws, 4).select("draw").distinct().count() == 4 and effects.resample_draws(draws, 9).select("draw").distinct().count() == 9
    band = effects.prevalence_ci(draws, xs.select("doc_id", F.col("g").alias("level"))).collect()
    assert len(band) == 6 and all(r.low <= r.mean <= r.high for r in band)
    assert all(r.se > 0 for r in effects.prevalence_composition(draws).collect())


class Fake:
    """A model with given topics, whose documents follow the covariate."""

    family = "dirichlet"

    def __init__(self, topic_word, theta):
        self.topic_word, self.vocabulary, self._theta = topic_word, [f"w{i}" for i in range(topic_word.shape[1])], theta

    def doc_topic(self):
        return self._theta


def test_bootstrap_and_permutation(spark):
    phi = np.kron(np.eye(2), np.full(5, 0.2))
    docs = spark.createDataFrame([(i, ["w1", "w2"]) for i in range(40)], "doc_id int, tokens array<string>")
    theta = lambda d, swap: d.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("topic")).withColumn("p", F.when((F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0) == (F.col("topic") == int(swap)), 0.9).otherwise(0.1))
    model = Fake(phi, theta(docs, False))
    n = [effects.bootstrap_corpus(docs, s).count() for s in range(5)]
    assert 25 < np.mean(n) < 55
    refit = lambda d, seed: Fake(phi[::-1], theta(d, True))
    rows = effects.standard_errors(model, docs, "top_words", "bootstrap", refit=refit, n_boot=3, topn=5)
    assert {r["inclusion"] for r in rows} == {1.0}
    assert effects.bootstrap_stability(docs, refit, model, 2, 5).tolist() == [1, 1]
    x = docs.select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).cast("int").alias("x"))
    p = effects.permutation_test(model, docs, x, lambda d, c, s: Fake(phi[::-1], theta(d, True)), n_perm=9, topn=5)
    assert p[0]["p"] == 0.1 and len(p[0]["null"]) == 9
