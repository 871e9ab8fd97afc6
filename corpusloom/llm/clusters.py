"""Clusters of mutually similar records: distributed k-means cells, links inside and across cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.session import cut
from .components import components
from .vectors import matrix, packed, unit, usable


def hashed_features(docs: DataFrame, key: str, tokens: str, dims: int = 64) -> DataFrame:
    """(key, vec ARRAY<FLOAT>): tf-idf weighted tokens of a record, hashed into ``dims`` signed features.

    For records that have no vector yet.  Null tokens count nothing; records without a token give
    no row, and so do null keys.
    """
    t = docs.select(F.col(key).alias("key"), F.explode(tokens).alias("token")).filter("key is not null and token is not null")
    tf = t.groupBy("key", "token").agg(F.count(F.lit(1)).alias("tf"))
    total = t.select("key").distinct().agg(F.count(F.lit(1)).alias("total"))
    df = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total)).select("token", F.log(1 + F.col("total") / F.col("df")).alias("idf"))
    h = F.xxhash64("token")
    part = tf.join(df, "token").select(
        "key",
        F.pmod(h, F.lit(dims)).cast("int").alias("slot"),
        (F.log1p("tf") * F.col("idf") * F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("w"),
    )
    cells = part.groupBy("key", "slot").agg(F.sum("w").alias("w")).groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("m"))
    vec = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("float"))
    return cells.select("key", vec.alias("vec"))


def _spread(points: DataFrame, dims: int, count: int, rounds: int, seed: int) -> np.ndarray:
    """Oversampled parallel seeding: ``rounds`` passes that each draw about 2 x ``count`` rows by cost.

    The driver holds at most a few times rounds x 2 x count rows; the draws are weighted by the
    number of rows they attract and reclustered to ``count`` centres.
    """
    sc = points.sparkSession.sparkContext
    first = matrix(pa.Table.from_batches(points.orderBy(F.xxhash64("key", F.lit(seed))).select("vec").limit(1).toArrow().to_batches()).column("vec"), dims)
    chosen = unit(first)
    for r in range(rounds):
        held = sc.broadcast(chosen)

        def cost(batches, held=held):
            total = 0.0
            for b in batches:
                u = unit(matrix(b.column("vec"), dims))
                total += float(np.maximum(0.0, 2.0 - 2.0 * (u @ held.value.T).max(1)).sum()) if len(u) else 0.0
            yield pa.RecordBatch.from_arrays([pa.array([total])], names=["cost"])

        phi = points.select("vec").mapInArrow(cost, "cost double").agg(F.sum("cost")).first()[0] or 0.0
        if phi <= 1e-6:
            break

        def draw(batches, held=held, phi=phi, r=r):
            for b in batches:
                x = matrix(b.column("vec"), dims)
                if not len(x):
                    continue
                u = unit(x)
                d = np.maximum(0.0, 2.0 - 2.0 * (u @ held.value.T).max(1))
                key = b.column("key").to_numpy().astype(np.uint64)
                z = key * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed + 1) * 1000003 + r * 7919)
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                coin = (z >> np.uint64(11)).astype(np.float64) / 2.0**53
                take = coin < 2.0 * count * d / phi
                yield pa.RecordBatch.from_arrays([packed(u[take])], names=["vec"])

        new = points.select("key", "vec").mapInArrow(draw, "vec binary").toArrow()
        if new.num_rows:
            chosen = np.concatenate([chosen, matrix(new.column("vec"), dims)])
    held = sc.broadcast(chosen)

    def attract(batches):
        n = np.zeros(len(held.value), np.int64)
        for b in batches:
            u = unit(matrix(b.column("vec"), dims))
            if len(u):
                n += np.bincount((u @ held.value.T).argmax(1), minlength=len(n))
        at = np.nonzero(n)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["at", "n"])

    got = points.select("vec").mapInArrow(attract, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    weight = np.zeros(len(chosen))
    weight[got.column("at").to_numpy()] = got.column("n").to_numpy()
    return _recluster(chosen, weight, count, seed)


def _recluster(x: np.ndarray, weight: np.ndarray, count: int, seed: int, rounds: int = 6) -> np.ndarray:
    """Weighted k-means++ and a few Lloyd rounds on the drawn rows."""
    if len(x) <= count:
        return x.astype(np.float32)
    rng = np.random.default_rng(seed)
    first = int(rng.choice(len(x), p=weight / weight.sum()))
    centres = [x[first]]
    d = np.maximum(0.0, 2.0 - 2.0 * (x @ x[first]))
    for _ in range(count - 1):
        p = d * weight
        if p.sum() <= 0:
            break
        j = int(rng.choice(len(x), p=p / p.sum()))
        centres.append(x[j])
        d = np.minimum(d, np.maximum(0.0, 2.0 - 2.0 * (x @ x[j])))
    c = np.stack(centres).astype(np.float32)
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros((len(c), x.shape[1]))
        np.add.at(sums, near, x * weight[:, None])
        size = np.linalg.norm(sums, axis=1)
        c[size > 0] = (sums[size > 0] / size[size > 0, None]).astype(np.float32)
    return c


def kmeans(points: DataFrame, dims: int, count: int, seeding: int = 4, rounds: int = 3, seed: int = 5) -> np.ndarray:
    """Unit centres of a spherical k-means over all of ``points`` (key, vec binary).

    Every Lloyd round sends per task one sum per touched centre; only ``count`` sums reach the driver.
    """
    if count <= 1:
        return np.zeros((1, dims), np.float32)
    centres = _spread(points, dims, count, seeding, seed)
    sc = points.sparkSession.sparkContext
    for _ in range(rounds):
        held = sc.broadcast(centres)

        def sums(batches, held=held):
            c = held.value
            total = np.zeros((len(c), dims))
            n = np.zeros(len(c), np.int64)
            for b in batches:
                u = unit(matrix(b.column("vec"), dims))
                if not len(u):
                    continue
                near = (u @ c.T).argmax(1)
                order = np.argsort(near, kind="stable")
                heads = np.nonzero(np.r_[True, near[order][1:] != near[order][:-1]])[0]
                total[near[order][heads]] += np.add.reduceat(u[order].astype(np.float64), heads, axis=0)
                n += np.bincount(near, minlength=len(c))
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(total[at]), pa.list_(pa.float64()))], names=["at", "total"])

        rows = points.select("vec").mapInArrow(sums, "at bigint, total array<double>")
        parts = rows.groupBy("at").agg(*[F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(dims)]).toArrow().to_pandas()
        fresh = centres.copy()
        for row in parts.itertuples(index=False):
            s = np.array(row[1:], float)
            size = np.linalg.norm(s)
            if size > 0:
                fresh[int(row[0])] = s / size
        centres = fresh
    return centres


def _local_roots(u: np.ndarray, limit: float) -> np.ndarray:
    """Smallest row of the component of every row; rows are linked at cosine >= ``limit``."""
    n = len(u)
    root = np.arange(n)
    free = np.ones(n, bool)
    for i in range(n):
        if not free[i]:
            continue
        free[i] = False
        front = np.array([i])
        while len(front):
            root[front] = i
            rest = np.nonzero(free)[0]
            if not len(rest):
                break
            hit = np.zeros(len(rest), bool)
            for lo in range(0, len(front), 512):
                left = np.nonzero(~hit)[0]
                if not len(left):
                    break
                hit[left] |= (u[rest[left]] @ u[front[lo : lo + 512]].T).max(1) >= limit
            front = rest[hit]
            free[front] = False
    return root


def similarity_clusters(
    vectors: DataFrame,
    key: str = "doc_id",
    dims: int = 64,
    min_similarity: float = 0.78,
    min_size: int = 5,
    margin: float = 0.15,
    cell_rows: int = 2048,
    block_rows: int = 6144,
    seed: int = 5,
) -> DataFrame:
    """(cluster_key, member, size, fit) for every record that belongs to a cluster.

    Two records are linked at a cosine of at least ``min_similarity``; a cluster is a set of at
    least ``min_size`` records joined by links.  ``cluster_key`` is its smallest key, ``fit`` the
    cosine to the mean direction of the cluster; ``typical_members`` ranks by it.

    Method.  Distributed k-means with oversampled parallel seeding over all rows makes cells of
    about ``cell_rows``.  A row is compared with all rows of its own cell and of every cell whose
    centre is at most ``margin`` less similar to it than its own; rows of one cell that are linked
    form a local component, local components linked from outside are joined, and so clusters
    may reach across cells.  A cell of more than ``block_rows`` rows is cut into blocks by key, and
    its rows are compared with each block.  A link between rows whose cells are further apart than
    ``margin`` can be missed; the tests measure what that costs.

    Unusable vectors (null, wrong length, null or non-finite entry, all zero) and null keys stay
    out; a repeated row counts once; of several vectors of a key the greatest counts.  An empty
    table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession

    def to_binary(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), packed(matrix(b.column("vec"), dims))], names=["key", "vec"])

    rows = usable(vectors, key, dims).groupBy("key").agg(F.max("vec").alias("vec"))
    points = cut(rows.mapInArrow(to_binary, "key bigint, vec binary"))
    total = points.count()
    centres = kmeans(points, dims, math.ceil(total / cell_rows), seed=seed) if total else np.zeros((1, dims), np.float32)
    centres = spark.sparkContext.broadcast(centres)

    def near(batches):
        for b in batches:
            u = unit(matrix(b.column("vec"), dims))
            n = np.bincount((u @ centres.value.T).argmax(1), minlength=len(centres.value)) if len(u) else np.zeros(1, int)
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at].astype(np.int64))], names=["cell", "n"])

    held = points.select("vec").mapInArrow(near, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    blocks = np.ones(len(centres.value), np.int64)
    blocks[held.column("cell").to_numpy()] = np.ceil(held.column("n").to_numpy() / block_rows).astype(np.int64)
    blocks = spark.sparkContext.broadcast(blocks)

    def route(batches):
        for b in batches:
            keys = b.column("key").to_numpy()
            x = matrix(b.column("vec"), dims)
            if not len(x):
                continue
            s = unit(x) @ centres.value.T
            best = s.argmax(1)
            qi, cell = np.nonzero(s >= s[np.arange(len(x)), best][:, None] - margin)
            times = blocks.value[cell]
            qi, cell = np.repeat(qi, times), np.repeat(cell, times)
            block = np.arange(len(qi)) - np.repeat(np.cumsum(times) - times, times)
            home = (cell == best[qi]) & (block == np.abs(keys[qi]) % blocks.value[cell])
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(home), pa.array(keys[qi]), packed(x[qi])], names=["cell", "block", "home", "key", "vec"])

    def link(table: pa.Table) -> pa.Table:
        home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        key = table.column("key").to_numpy()
        u = unit(matrix(table.column("vec"), dims))
        mine = np.nonzero(home)[0]
        mine = mine[np.argsort(key[mine], kind="stable")]
        out_a, out_b, out_h = [], [], []
        if len(mine):
            inner = np.ascontiguousarray(u[mine])
            root = _local_roots(inner, min_similarity)
            out_a.append(key[mine])
            out_b.append(key[mine][root])
            out_h.append(np.ones(len(mine), bool))
            others = np.nonzero(~home)[0]
            order = np.argsort(root, kind="stable")
            heads = np.nonzero(np.r_[True, root[order][1:] != root[order][:-1]])[0]
            inner = inner[order]
            for lo in range(0, len(others), 1024):
                q = others[lo : lo + 1024]
                hit = np.maximum.reduceat(u[q] @ inner.T, heads, axis=1) >= min_similarity
                i, j = np.nonzero(hit)
                out_a.append(key[q][i])
                out_b.append(key[mine][root[order][heads[j]]])
                out_h.append(np.zeros(len(i), bool))
        if not out_a:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.bool_())], names=["key", "head", "home"])
        return pa.table([np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_h)], names=["key", "head", "home"])

    linked = cut(points.mapInArrow(route, "cell int, block int, home boolean, key bigint, vec binary").groupBy("cell", "block").applyInArrow(link, "key bigint, head bigint, home boolean"))
    local = linked.filter("home").select("key", "head")
    across = linked.filter("not home").select("key", F.col("head").alias("b")).join(local, "key").select(F.col("head").alias("a"), "b").distinct()
    roots = components(across)
    member = local.join(roots.withColumnRenamed("node", "head"), "head", "left").select("key", F.coalesce("root", "head").alias("root"))
    # the root is a smallest key already: heads are smallest keys of their local components
    sizes = member.groupBy("root").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= min_size)
    kept = cut(member.join(sizes, "root").join(points, "key").select("root", "key", "size", "vec"))

    def add(batches):
        for b in batches:
            u = unit(matrix(b.column("vec"), dims)).astype(np.float64)
            if not len(u):
                continue
            root = b.column("root").to_numpy()
            order = np.argsort(root, kind="stable")
            heads = np.nonzero(np.r_[True, root[order][1:] != root[order][:-1]])[0]
            yield pa.RecordBatch.from_arrays([pa.array(root[order][heads]), pa.array(list(np.add.reduceat(u[order], heads, axis=0)), pa.list_(pa.float64()))], names=["root", "part"])

    sums = kept.select("root", "vec").mapInArrow(add, "root bigint, part array<double>")
    middle = sums.groupBy("root").agg(F.array(*[F.sum(F.col("part")[i]) for i in range(dims)]).alias("middle"))

    def fit(batches):
        for b in batches:
            u = unit(matrix(b.column("vec"), dims)).astype(np.float64)
            m = matrix(b.column("middle"), dims).astype(np.float64)
            size = np.sqrt((m * m).sum(1))
            f = np.where(size > 0, (u * m).sum(1) / np.where(size > 0, size, 1.0), 0.0)
            yield pa.RecordBatch.from_arrays([b.column("root"), b.column("key"), b.column("size"), pa.array(np.round(f, 5))], names=["cluster_key", "member", "size", "fit"])

    scored = kept.join(middle, "root").select("root", "key", "size", "vec", "middle").mapInArrow(fit, "cluster_key bigint, member bigint, size bigint, fit double")
    return scored


def typical_members(clusters: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` best fitting members of every cluster: cluster_key, size, member, fit, place.

    A hot cluster is first cut down in 64 salted parts.
    """
    order = [F.col("fit").desc(), F.col("member")]
    salted = W.partitionBy("cluster_key", "salt").orderBy(*order)
    whole = W.partitionBy("cluster_key").orderBy(*order)
    part = clusters.withColumn("salt", F.pmod(F.xxhash64("member"), F.lit(64))).withColumn("place", F.row_number().over(salted)).filter(F.col("place") <= n)
    return part.withColumn("place", F.row_number().over(whole)).filter(F.col("place") <= n).select("cluster_key", "size", "member", "fit", "place")


def record_clusters(vectors: DataFrame, key: str = "key", dims: int = 64, count: int | None = None, cell_rows: int = 2048, typical: int = 3, seed: int = 5) -> DataFrame:
    """(cluster, size, member, fit, place): every cluster with its ``typical`` members nearest the centroid.

    A partition of all usable vectors (``hashed_features`` makes some for records that have none) into
    ``count`` clusters, or about one per ``cell_rows`` records: k-means with oversampled parallel seeding
    over all rows; each record belongs to the nearest centroid, of equally near ones to the lowest
    number.  ``fit`` is the cosine to the centroid; of equal fits the smaller key goes first.  Rules for
    unusable vectors and repeated rows as in ``similarity_clusters``.
    """
    def to_binary(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), packed(matrix(b.column("vec"), dims))], names=["key", "vec"])

    rows = usable(vectors, key, dims).groupBy("key").agg(F.max("vec").alias("vec"))
    points = cut(rows.mapInArrow(to_binary, "key bigint, vec binary"))
    total = points.count()
    centres = kmeans(points, dims, count or math.ceil(total / cell_rows), seed=seed) if total else np.zeros((1, dims), np.float32)
    held = vectors.sparkSession.sparkContext.broadcast(centres)

    def assign(batches):
        for b in batches:
            x = matrix(b.column("vec"), dims)
            if not len(x):
                continue
            s = unit(x) @ held.value.T
            near = s.argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), b.column("key"), pa.array(np.round(s[np.arange(len(x)), near].astype(float), 5))], names=["cluster_key", "member", "fit"])

    placed = points.mapInArrow(assign, "cluster_key int, member bigint, fit double")
    sizes = placed.groupBy("cluster_key").agg(F.count(F.lit(1)).alias("size"))
    best = typical_members(placed.withColumn("size", F.lit(0)), typical).drop("size")
    return best.join(sizes, "cluster_key").select(F.col("cluster_key").alias("cluster"), "size", "member", "fit", "place")
