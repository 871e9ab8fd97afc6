"""Topics as clusters of document embeddings: reduce, cluster, represent."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.num import agglomerative
from ..functions.session import cut, small
from ..operators.text import bag_of_words
from ..operators.vectors import assign_nearest, assign_outliers, centroids, gram_matrix, nearest, soft_assign
from ..operators.weights import class_counts, ctfidf, idf_weights, top_terms
from .engine import SLICE, sums_over  # noqa: F401

#: Most points that are clustered on the driver; more are first drawn together into as many cells.
MOST_POINTS = 8192


def umap_available() -> bool:
    return False


def tsne_available() -> bool:
    return False


def pca(vectors: DataFrame, dims: int, components: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes (components, dims)): from one pass of sums; the largest loading of an axis is positive."""
    g = gram_matrix(vectors, dims)
    n = max(g[0, 0], 1)
    mean = g[0, 1:] / n
    value, vec = np.linalg.eigh(g[1:, 1:] / n - np.outer(mean, mean))
    axes = vec[:, np.argsort(-value)[:components]].T
    sign = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(1)])
    return mean, axes * sign[:, None]


def project(vectors: DataFrame, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """``vec`` replaced by its scores on the axes."""
    held = vectors.sparkSession.sparkContext.broadcast((mean, axes))

    @F.pandas_udf("array<double>")
    def score(vec):
        m, a = held.value
        return __import__("pandas").Series(list((np.array(vec.tolist(), float).reshape(len(vec), -1) - m) @ a.T))

    return vectors.withColumn("vec", score("vec"))


def reduce(vectors: DataFrame, dims: int, n_components: int = 5, method: str = "pca") -> DataFrame:
    """Scores on the first principal axes, or the centred vectors where there are no more axes than components.

    Layouts that need all pairs (umap, tsne) are not offered; asking for one gives the principal axes.
    """
    if method not in ("pca", "umap", "tsne"):
        raise ValueError(f"unknown method {method!r}")
    return project(vectors, *pca(vectors, dims, min(n_components, dims)))


def densify(labels: np.ndarray) -> np.ndarray:
    """Labels >= 0 renumbered without gaps, in their order; -1 stays."""
    labels = np.asarray(labels)
    out = np.full(len(labels), -1)
    fine = labels >= 0
    out[fine] = np.unique(labels[fine], return_inverse=True)[1]
    return out


def merge_labels(labels: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """Labels of a group become its smallest; groups that overlap join; then ``densify``."""
    root: dict[int, int] = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for g in groups:
        for x in g[1:]:
            a, b = sorted((top(g[0]), top(x)))
            root[b] = a
    return densify(np.array([x if x < 0 else top(int(x)) for x in labels]))


def hdbscan(x: np.ndarray, min_cluster_size: int = 15, min_samples: int | None = None, weight: np.ndarray | None = None) -> np.ndarray:
    """Density clusters of the rows of ``x``, -1 for noise; a row may stand for ``weight`` rows.

    Mutual reachability distances, their minimum spanning tree, the tree of splits condensed at
    ``min_cluster_size`` and the clusters of most excess mass.  All noise where there are too few rows.
    """
    n, m = len(x), min_cluster_size if min_samples is None else min_samples
    weight = np.ones(n) if weight is None else np.asarray(weight, float)
    if weight.sum() < min_cluster_size or weight.sum() <= m or n < 2:
        return np.full(n, -1)
    sq = (x * x).sum(1)
    # core distance: to the point with which m points, the row itself among them, are reached
    core = np.empty(n)
    for lo in range(0, n, 512):
        d = np.sqrt(np.maximum(sq[lo : lo + 512, None] + sq - 2 * x[lo : lo + 512] @ x.T, 0))
        o = np.argsort(d, axis=1)
        reach = np.cumsum(weight[o], axis=1) >= m
        at = np.where(reach.any(1), reach.argmax(1), n - 1)
        core[lo : lo + 512] = np.take_along_axis(d, np.take_along_axis(o, at[:, None], 1), 1)[:, 0]
    # spanning tree, grown from row 0
    best, link, left = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    at, edges = 0, []
    for _ in range(n - 1):
        left[at] = False
        d = np.maximum(np.maximum(np.sqrt(np.maximum(sq + sq[at] - 2 * x @ x[at], 0)), core), core[at])
        closer = left & (d < best)
        best[closer], link[closer] = d[closer], at
        at = int(np.where(left, best, np.inf).argmin())
        edges.append((best[at], link[at], at))
    edges.sort(key=lambda e: e[0])
    # single linkage: node n + i joins two nodes at edge i
    root, mass, kids, height = list(range(n)), [*weight], {}, {}
    parent = list(range(2 * n - 1))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, (d, a, b) in enumerate(edges):
        a, b, node = find(a), find(b), n + i
        kids[node], height[node] = (a, b), d
        mass.append(mass[a] + mass[b])
        parent[a] = parent[b] = node
    del root
    # condense from the top: a split of two large sides opens two clusters, else the small side falls out
    lam = lambda d: 1 / d if d > 0 else 1e300
    cluster_of = np.full(n, -1)
    birth, stability, below, clusters = {0: 0.0}, {0: 0.0}, {0: []}, 1
    stack = [(2 * n - 2, 0)]

    def rows_of(node):
        todo, out = [node], []
        while todo:
            k = todo.pop()
            todo.extend(kids[k]) if k >= n else out.append(k)
        return out

    while stack:
        node, c = stack.pop()
        if node < n:
            cluster_of[node] = c
            continue
        level, (a, b) = lam(height[node]), kids[node]
        large = [k for k in (a, b) if mass[k] >= min_cluster_size]
        for k in (a, b):
            if k not in large:
                stability[c] += (min(level, 1e300) - birth[c]) * mass[k]
                cluster_of[rows_of(k)] = c
        if len(large) == 2:
            for k in large:
                stability[c] += (level - birth[c]) * mass[k]
                birth[clusters], stability[clusters], below[clusters] = level, 0.0, []
                below[c].append(clusters)
                stack.append((k, clusters))
                clusters += 1
        elif large:
            stack.append((large[0], c))
    # excess of mass, children first; the root is no cluster
    keep, worth = {}, {}
    for c in range(clusters - 1, -1, -1):
        under = sum(worth[k] for k in below[c])
        keep[c] = c > 0 and stability[c] >= under
        worth[c] = stability[c] if keep[c] else under
    home = {}
    for c in range(clusters):
        up = next((p for p in range(c) if c in below[p]), None)
        home[c] = home[up] if up is not None and home[up] >= 0 else (c if keep[c] else -1)
    return densify(np.array([home[c] if c >= 0 else -1 for c in cluster_of]))


def kmeans_labels(vectors: DataFrame, k: int, seed: int = 42, rounds: int = 30) -> DataFrame:
    """(id, label): Lloyd rounds over all rows; each sends one sum a centre.  Labels without rows are left out.

    Starting centres: in each of five passes every row is drawn by a hash with a chance in proportion to its cost, about
    2 k rows a pass; the drawn rows, weighted by what they attract, are then reduced to k.
    """
    v = cut(vectors.select("id", "vec"))
    first = v.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(1).collect()
    if not first:
        return v.select("id", F.lit(0).alias("label"))
    c = np.array([first[0]["vec"]], float)
    for r in range(5):
        near = cut(assign_nearest(v, [], c))
        cost = near.agg(F.sum("d")).first()[0] or 0.0
        if cost <= 1e-12:
            break
        u = (F.xxhash64("id", F.lit(seed + 31 * (r + 1))).cast("double") / F.lit(2.0**64)) + 0.5
        drawn = near.filter(u < F.col("d") * F.lit(2.0 * k / cost)).select("id").join(v, "id").orderBy("id").collect()
        if drawn:
            c = np.concatenate([c, np.array([x["vec"] for x in drawn], float)])
    if len(c) > k:
        n = {x["at"]: x["count"] for x in assign_nearest(v, [], c).groupBy("at").count().collect()}
        c = _weighted_centres(c, np.array([n.get(i, 0) for i in range(len(c))], float), k, seed)
    dims, last, count = c.shape[1], None, len(c)
    for _ in range(rounds):

        def part(b, c=c):
            x = b.column("vec").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)
            d = np.stack([((x - row) ** 2).sum(1) for row in c], 1).round(9)
            near = d.argmin(1)
            out = np.zeros((count, dims + 1))
            np.add.at(out, near, np.c_[x, np.ones(len(x))])
            return np.r_[out.ravel(), d.min(1).sum()]

        got = sums_over(v, ["vec"], part, count * (dims + 1) + 1)
        sums, cost = got[:-1].reshape(count, dims + 1), got[-1]
        c = np.where(sums[:, -1:] > 0, sums[:, :-1] / np.maximum(sums[:, -1:], 1), c)
        if last is not None and last - cost <= 1e-9 * max(last, 1e-12):
            break
        last = cost
    near = cut(assign_nearest(v, [], c))
    used = sorted(r[0] for r in near.select("at").distinct().collect())
    dense = F.element_at(F.array(*[F.lit(used.index(i) if i in used else -1) for i in range(count)]), F.col("at") + 1)
    return near.select("id", dense.alias("label"))


def _weighted_centres(x: np.ndarray, weight: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    weight = np.maximum(weight, 1e-9)
    c = [x[rng.choice(len(x), p=weight / weight.sum())]]
    d = ((x - c[0]) ** 2).sum(1)
    while len(c) < k and (d * weight).sum() > 0:
        c.append(x[rng.choice(len(x), p=d * weight / (d * weight).sum())])
        d = np.minimum(d, ((x - c[-1]) ** 2).sum(1))
    c = np.stack(c)
    for _ in range(rounds):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        for j in range(len(c)):
            m = near == j
            if m.any():
                c[j] = np.average(x[m], axis=0, weights=weight[m])
    return c


def cluster_points(vectors: DataFrame, clusterer: str = "hdbscan", num_clusters: int | None = None, min_cluster_size: int = 15, min_samples: int | None = None, seed: int = 42) -> DataFrame:
    """(id, label) by ``kmeans``, ``agglomerative`` or ``hdbscan`` (any other name too); -1 is noise.

    The latter two work on a distance matrix: more than ``MOST_POINTS`` rows are first drawn together into that
    many k-means cells, which then count by their rows; every row gets the label of its cell.  Without
    ``num_clusters`` the number is ``min_cluster_size``.
    """
    k = num_clusters or min_cluster_size
    if clusterer == "kmeans":
        return kmeans_labels(vectors, k, seed)
    v = cut(vectors.select("id", "vec"))
    if v.count() <= MOST_POINTS:
        rows = v.orderBy("id").collect()
        x, cells, weight = np.array([r["vec"] for r in rows], float).reshape(len(rows), -1), None, None
    else:
        cells = cut(kmeans_labels(v, MOST_POINTS, seed, rounds=3))
        got = centroids(v.join(cells, "id")).join(cells.groupBy("label").count(), "label").orderBy("label").collect()
        x, weight = np.array([r["centroid"] for r in got], float), np.array([r["count"] for r in got], float)
    if clusterer == "agglomerative":
        sq = (x * x).sum(1)
        label = agglomerative(np.sqrt(np.maximum(sq[:, None] + sq - 2 * x @ x.T, 0)), k) if len(x) else np.zeros(0, int)
    else:
        label = hdbscan(x, min_cluster_size, min_samples, weight)
    spark = v.sparkSession
    if cells is None:
        kind = dict(v.dtypes)["id"]
        return spark.createDataFrame([(r["id"], int(z)) for r, z in zip(rows, label)], f"id {kind}, label int")
    at = spark.createDataFrame([(i, int(z)) for i, z in enumerate(label)], "label int, new int")
    return cells.join(F.broadcast(at), "label").select("id", F.col("new").alias("label"))


class ClusterModel:
    """What both cluster models share: labels (id, label), class TF-IDF weights, merging, outliers."""

    family = "none"
    converged = None
    bm25 = reduce_frequent = False

    def _represent(self) -> None:
        classes = self.labels.filter("label >= 0").select(F.col("id").alias("doc_id"), F.col("label").alias("class"))
        self.counts = cut(class_counts(self._bow, classes))
        self.weights = cut(ctfidf(self.counts, self.bm25, self.reduce_frequent))
        self.num_topics = self.weights.select("class").distinct().count()

    def top_words(self, n: int = 10) -> DataFrame:
        return top_terms(self.weights, n)

    def phi(self) -> DataFrame:
        """(topic, term, prob): class weights scaled to 1."""
        w = self.weights.filter("weight > 0")
        return w.select(F.col("class").alias("topic"), "term", (F.col("weight") / F.sum("weight").over(W.partitionBy("class"))).alias("prob"))

    def _relabel(self, groups: list[list[int]]) -> dict[int, int]:
        old = sorted(r[0] for r in self.labels.filter("label >= 0").select("label").distinct().collect())
        new = dict(zip(old, merge_labels(np.array(old), groups).tolist()))
        at = self.labels.sparkSession.createDataFrame([*new.items(), (-1, -1)], "label int, new int")
        self.labels = cut(self.labels.join(small(at)[0], "label").select("id", F.col("new").alias("label")))
        return new

    def reduce_outliers(self):
        """Noise documents go to the topic under which their words are likeliest; weights are made anew, vectors stay."""
        fixed = assign_outliers(self._bow, self.labels.select(F.col("id").alias("doc_id"), "label"), self.phi())
        self.labels = cut(fixed.select(F.col("doc_id").alias("id"), "label"))
        self._represent()
        return self


class Top2Vec(ClusterModel):
    """Topic vectors are the centroids of clusters of document embeddings; words by class TF-IDF or nearness to the vector."""

    def __init__(self, num_clusters: int | None = None, *, n_components: int = 5, clusterer: str | None = None, min_cluster_size: int = 15, min_samples: int | None = None, reducer: str = "pca", seed: int = 42):
        self.num_clusters, self.n_components, self.seed, self.reducer = num_clusters, n_components, seed, reducer
        self.clusterer = clusterer or ("kmeans" if num_clusters else "hdbscan")
        self.min_cluster_size, self.min_samples = min_cluster_size, min_samples

    def fit(self, docs: DataFrame, embeddings: DataFrame, dims: int, word_embeddings: DataFrame | None = None) -> "Top2Vec":
        """docs (doc_id, tokens), embeddings (id, vec), word_embeddings (id, vec); only documents with an embedding take part."""
        v = embeddings.select("id", "vec")
        self._bow, self._vectors, self._words = bag_of_words(docs), v, word_embeddings
        low = reduce(v, dims, self.n_components, self.reducer) if dims > self.n_components else v
        self.labels = cut(cluster_points(low, self.clusterer, self.num_clusters, self.min_cluster_size, self.min_samples, self.seed))
        self.topic_vectors = cut(centroids(v.join(self.labels, "id").select("id", "vec", "label")))
        self._represent()
        return self

    def transform(self, embeddings: DataFrame) -> DataFrame:
        """(id, label, p): cosine to the topic vectors, cut at 0 and scaled."""
        return soft_assign(embeddings.select("id", "vec"), self.topic_vectors)

    def assign(self, embeddings: DataFrame) -> DataFrame:
        """(id, label): the topic of greatest share, of equal ones the lowest."""
        return self.transform(embeddings).groupBy("id").agg(F.min_by("label", F.struct(-F.col("p"), F.col("label"))).alias("label"))

    def doc_topic(self) -> DataFrame:
        t = getattr(self, "_theta", None)
        t = self.transform(self._vectors) if t is None else t
        return t.select(F.col("id").alias("doc_id"), F.col("label").alias("topic"), "p")

    def topic_neighbors(self, n: int = 10) -> DataFrame:
        """(topic, place, term, cosine): the words whose vectors are nearest every topic vector."""
        near = nearest(self.topic_vectors.select(F.col("label").alias("query"), F.col("centroid").alias("q")), self._words, n)
        return near.select(F.col("query").alias("topic"), "place", F.col("id").alias("term"), "cosine")

    def merge_topics(self, groups: list[list[int]]) -> "Top2Vec":
        """Topics of a group become one: vectors weighted by size, shares added, words made anew."""
        size = {r["label"]: r["count"] for r in self.labels.groupBy("label").count().collect()}
        theta, vec = self.transform(self._vectors), {r["label"]: np.array(r["centroid"]) for r in self.topic_vectors.collect()}
        new = self._relabel(groups)
        spark = self.labels.sparkSession
        at = small(spark.createDataFrame(list(new.items()), "label int, new int"))[0]
        self._theta = cut(theta.join(at, "label").groupBy("id", F.col("new").alias("label")).agg(F.sum("p").alias("p")))
        rows = []
        for z in sorted(set(new.values())):
            old = [k for k, v in new.items() if v == z]
            w = np.array([size.get(k, 0) for k in old], float)
            rows.append((z, np.average([vec[k] for k in old], axis=0, weights=w).tolist()))
        self.topic_vectors = spark.createDataFrame(rows, "label int, centroid array<double>")
        self._represent()
        return self


class BERTopic(ClusterModel):
    """Clusters of document embeddings described by class TF-IDF; a document's distribution comes from its windows of words."""

    def __init__(self, *, n_components: int = 5, min_cluster_size: int = 15, min_samples: int | None = None, nr_topics: int | None = None, window: int = 4, stride: int = 1, reducer: str = "pca", bm25: bool = False, reduce_frequent: bool = False, clusterer: str = "hdbscan", num_clusters: int | None = None, seed: int = 42):
        self.n_components, self.min_cluster_size, self.min_samples, self.nr_topics, self.window, self.stride = n_components, min_cluster_size, min_samples, nr_topics, window, stride
        self.reducer, self.bm25, self.reduce_frequent, self.clusterer, self.num_clusters, self.seed = reducer, bm25, reduce_frequent, clusterer, num_clusters, seed

    def fit(self, docs: DataFrame, embeddings: DataFrame, dims: int) -> "BERTopic":
        v = embeddings.select("id", "vec")
        self._docs, self._bow = docs.select("doc_id", "tokens"), bag_of_words(docs)
        low = reduce(v, dims, self.n_components, self.reducer) if dims > self.n_components else v
        self.labels = cut(cluster_points(low, self.clusterer, self.num_clusters, self.min_cluster_size, self.min_samples, self.seed))
        self._represent()
        while self.nr_topics and self.num_topics > self.nr_topics:
            a, b = self.most_similar_pair()
            self.merge_topics([[a, b]])
        return self

    def most_similar_pair(self) -> tuple[int, int]:
        """The two topics of greatest cosine of class weights, of equal ones the lowest numbers."""
        w = self.weights
        norm = w.groupBy("class").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("n"))
        a, b = (w.select(F.col("class").alias(x), "term", F.col("weight").alias(f"w{x}")) for x in "ab")
        dot = a.join(b, "term").filter("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("d"))
        x = dot.join(norm.select(F.col("class").alias("a"), F.col("n").alias("na")), "a").join(norm.select(F.col("class").alias("b"), F.col("n").alias("nb")), "b")
        best = x.select("a", "b", F.round(F.col("d") / (F.col("na") * F.col("nb")), 12).alias("c")).orderBy(F.col("c").desc(), "a", "b").first()
        if best is None:  # no shared word: the first two
            first = [r[0] for r in w.select("class").distinct().orderBy("class").limit(2).collect()]
            return first[0], first[1]
        return best["a"], best["b"]

    def merge_topics(self, groups: list[list[int]]) -> "BERTopic":
        self._relabel(groups)
        self._represent()
        return self

    def approximate_distribution(self, docs: DataFrame, window: int | None = None, stride: int | None = None) -> DataFrame:
        """(doc_id, topic, p): every window of words as a bag weighted by idf, its cosines to the topics, cut at 0, summed and scaled; uniform where none is positive.

        The class weights of the topics' words are sent to the tasks; each window is one row of a product there.
        """
        window, stride = window or self.window, stride or self.stride
        idf = {r["term"]: r["idf"] for r in idf_weights(self.counts).collect()}
        at = {t: i for i, t in enumerate(sorted(idf))}
        topics = sorted(r[0] for r in self.weights.select("class").distinct().collect())
        m = np.zeros((len(topics), len(at)))
        for r in self.weights.collect():
            m[topics.index(r["class"]), at[r["term"]]] = r["weight"]
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        held = docs.sparkSession.sparkContext.broadcast((np.divide(m, norm, out=np.zeros_like(m), where=norm > 0), at, np.array([idf[t] for t in sorted(idf)])))

        def run(batches):
            m, at, idf = held.value
            for b in batches:
                out = []
                for tokens in b.column("tokens").to_pylist():
                    w = np.array([at.get(t, -1) for t in tokens or []], int)
                    total = np.zeros(len(m))
                    for lo in range(0, max(len(w) - window, 0) + 1, stride) if len(w) else ():
                        u, n = np.unique(w[lo : lo + window][w[lo : lo + window] >= 0], return_counts=True)
                        x = n * idf[u]
                        size = np.linalg.norm(x)
                        if size > 0:
                            total += np.maximum(m[:, u] @ x / size, 0)
                    out.append((total / total.sum() if total.sum() > 0 else np.full(len(m), 1 / len(m))).tolist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.float64()))], names=["doc_id", "p"])

        wide = docs.select("doc_id", "tokens").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, p array<double>")
        names = F.array(*[F.lit(int(t)) for t in topics])
        return wide.select("doc_id", F.explode(F.arrays_zip(names.alias("topic"), F.col("p"))).alias("x")).select("doc_id", F.col("x.topic").alias("topic"), F.col("x.p").alias("p"))

    def transform(self, docs: DataFrame) -> DataFrame:
        return self.approximate_distribution(docs)

    def doc_topic(self) -> DataFrame:
        return self.approximate_distribution(self._docs)

    def fit_transform(self, docs: DataFrame, embeddings: DataFrame, dims: int) -> DataFrame:
        return self.fit(docs, embeddings, dims).doc_topic()


def save_embeddings(texts: DataFrame, vectors: DataFrame, path: str, model: str = "") -> None:
    """Parquet (id, vec, hash of the text, name of the model): texts (id, text), vectors (id, vec)."""
    texts.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash")).join(vectors.select("id", "vec"), "id").withColumn("model", F.lit(model)).write.mode("overwrite").parquet(path)


def load_embeddings(spark: SparkSession, path: str, texts: DataFrame | None = None) -> DataFrame:
    """(id, vec, text_hash, model); with ``texts`` only the rows whose text is unchanged."""
    e = spark.read.parquet(path)
    return e if texts is None else e.join(texts.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash")), ["id", "text_hash"], "left_semi")


def embed(texts: DataFrame, call, batch: int = 64, cache: str | None = None, model: str = "") -> DataFrame:
    """(id, vec): a user's function from a list of texts to vectors, run in the tasks batch by batch; kept in ``cache``."""

    @F.pandas_udf("array<double>")
    def run(part):
        t, out = part.fillna("").tolist(), []
        for lo in range(0, len(t), batch):
            out += [[float(x) for x in v] for v in call(t[lo : lo + batch])]
        return __import__("pandas").Series(out)

    new = texts.select("id", run("text").alias("vec"))
    if cache:
        save_embeddings(texts, new, cache, model)
        return load_embeddings(texts.sparkSession, cache).select("id", "vec")
    return new
