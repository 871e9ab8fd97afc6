"""Clusters of embeddings on planted blocks."""

import numpy as np
from pyspark.sql import functions as F

from corpusloom.models import embedding as E


def planted(spark, per=30, noise=0, seed=1):
    rng = np.random.default_rng(seed)
    c = np.eye(3, 8) * 5
    rows = [(i, [f"b{i % 3}w{j}" for j in rng.integers(0, 6, 8)], (c[i % 3] + 0.3 * rng.normal(size=8)).tolist()) for i in range(3 * per)]
    rows += [(1000 + i, [f"b{i % 3}w0"] * 3, (rng.uniform(-30, 30, 8)).tolist()) for i in range(noise)]
    return spark.createDataFrame(rows, "doc_id bigint, tokens array<string>, vec array<double>")


def test_hdbscan_finds_blocks_and_noise():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(40, 2)) * 0.2 + c for c in ((0, 0), (6, 0), (0, 6))] + [rng.uniform(-40, 40, (10, 2))])
    z = E.hdbscan(x, 10)
    assert z.max() == 2 and all(len(set(z[i * 40 : i * 40 + 40]) - {-1}) == 1 for i in range(3)) and (z[120:] == -1).sum() >= 8
    assert (z[:120] >= 0).mean() > 0.9
    assert (E.hdbscan(x[:5], 10) == -1).all()
    # rows that stand for several count as often
    w = E.hdbscan(np.array([[0.0, 0], [0.1, 0], [9, 9], [9.1, 9]]), 10, 10, np.array([8, 8, 8, 8.0]))
    assert w[0] == w[1] != w[2] == w[3] and (w >= 0).all()


def test_labels():
    assert E.densify(np.array([5, -1, 2, 5])).tolist() == [1, -1, 0, 1]
    assert E.merge_labels(np.array([0, 1, 2, 3, -1]), [[3, 1], [1, 2]]).tolist() == [0, 1, 1, 1, -1]


def test_clusterers_agree(spark):
    d = planted(spark).select(F.col("doc_id").alias("id"), "vec")
    for kind, k in (("kmeans", 3), ("agglomerative", 3), ("hdbscan", None)):
        z = {r.id: r.label for r in E.cluster_points(d, kind, k, 10).collect()}
        assert len({z[0], z[1], z[2]} - {-1}) == 3 and sum(z[i] == z[i % 3] for i in range(90)) > 80
    low = E.reduce(d, 8, 2).collect()
    assert len(low[0].vec) == 2


def test_top2vec_and_bertopic(spark):
    d = planted(spark, noise=4)
    v = d.select(F.col("doc_id").alias("id"), "vec")
    words = spark.createDataFrame([(f"b{k}w{j}", (np.eye(3, 8)[k] * 5).tolist()) for k in range(3) for j in range(6)], "id string, vec array<double>")
    m = E.Top2Vec(min_cluster_size=10).fit(d.select("doc_id", "tokens"), v, 8, words)
    assert m.num_topics == 3 and m.labels.filter("label = -1").count() >= 3
    near = m.topic_neighbors(3).collect()
    assert len(near) == 9 and all(len({r.term[:2] for r in near if r.topic == t}) == 1 for t in range(3))
    m.reduce_outliers()
    assert m.labels.filter("label = -1").count() == 0
    m.merge_topics([[0, 2]])
    assert m.num_topics == 2 and abs(m.doc_topic().groupBy("doc_id").agg(F.sum("p").alias("s")).agg(F.max("s")).first()[0] - 1) < 1e-9
    b = E.BERTopic(min_cluster_size=10, nr_topics=2).fit(d.select("doc_id", "tokens"), v, 8)
    assert b.num_topics == 2
    p = b.doc_topic().toPandas()
    assert np.allclose(p.groupby("doc_id").p.sum(), 1)
    new = spark.createDataFrame([(1, ["b0w1", "b0w2", "b0w1"]), (2, []), (3, None)], "doc_id bigint, tokens array<string>")
    q = b.transform(new).toPandas()
    assert q[q.doc_id == 1].p.max() > 0.9 and np.allclose(q[q.doc_id > 1].p, 0.5)


def test_embedding_cache(spark, tmp_path):
    t = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, None)], "id int, text string")
    got = {r.id: r.vec for r in E.embed(t, lambda xs: [[len(x), 1.0] for x in xs], 2, str(tmp_path / "e"), "len").collect()}
    assert got == {1: [2, 1], 2: [3, 1], 3: [0, 1]}
    changed = t.withColumn("text", F.when(F.col("id") == 1, "zz").otherwise(F.col("text")))
    assert {r.id for r in E.load_embeddings(spark, str(tmp_path / "e"), changed).collect()} == {2, 3}
