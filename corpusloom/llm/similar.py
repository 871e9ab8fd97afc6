"""Most similar vectors for every vector (robust-pruned directed graphs over shards)."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .graph import Graph
from .vectors import cosines, matrix, packed, sample_centres, unit, usable


def _plan(points: DataFrame, dims: int, shard_rows: int, sample_rows: int, seed: int):
    """Centres and shard counts per kind from a bounded sample.

    Returns {kind: (centres (c, dims), shards (c,))}.  ``shards`` splits a cell that holds more
    than ``shard_rows`` rows.
    """
    plan = {}
    for kind, rows in points.groupBy("kind").count().collect():
        mine = points.filter(F.col("kind") == kind)
        share = min(1.0, sample_rows / rows)
        if share < 1.0:
            mine = mine.filter(F.pmod(F.xxhash64(F.col("key"), F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)))
        if rows <= shard_rows:
            plan[kind] = (np.zeros((1, dims), np.float32), np.array([1]))
            continue
        x = matrix(pa.Table.from_batches(mine.select("vec").toArrow().to_batches()).column("vec"), dims)
        centres = sample_centres(x, math.ceil(rows / shard_rows), seed)
        held = np.bincount((unit(x) @ centres.T).argmax(1), minlength=len(centres))
        plan[kind] = (centres, np.maximum(1, np.ceil(held / max(1, held.sum()) * rows / (1.5 * shard_rows))).astype(int))
    return plan


def similar_vectors(
    tables: dict[str, tuple[DataFrame, str]],
    k: int = 5,
    dims: int = 64,
    min_similarity: float | None = None,
    margin: float = 0.12,
    shard_rows: int = 32768,
    sample_rows: int = 40000,
    degree: int = 18,
    beam: int = 20,
    query_beam: int = 12,
    alpha: float = 1.08,
    seed: int = 7,
) -> DataFrame:
    """The ``k`` most similar other vectors of the same table for every usable vector.

    ``tables`` maps a kind to (table, key column); the vector column is ``vec``.  Result: kind,
    key, other, similarity (cosine of the raw vectors in double precision, rounded to 6
    decimals), place (1 is best; of equal similarity the smaller key goes first).

    Method.  Equal vectors form a class, which the search treats as one row.  Classes are cut into
    shards of similar vectors by centres fitted on a sample of at most about ``sample_rows`` rows
    a table; every row is indexed.  Each shard grows a robust-pruned directed graph (``degree``,
    ``alpha``; greedy searches with ``beam`` propose the neighbours; queries take ``query_beam``).  A row queries its own shard
    and every shard whose centre is at most ``margin`` less similar to it than its own; beam
    search finds its best rows there, and the shards' answers are merged and spread over the
    members of each class.  A cell that would exceed 1.5 x ``shard_rows`` is split by key, and then
    each of its shards is queried.  Recall is measured against brute force in the tests.

    With ``min_similarity`` less similar partners are left out.  Null, short, zero or non-finite
    vectors and null keys take no part; a repeated row counts once; a key with several different
    vectors takes part with each and keeps the most similar partners.  Empty tables give no rows;
    other columns are ignored.
    """
    points = None
    for kind, (df, key) in tables.items():
        part = usable(df, key, dims).select(F.lit(kind).alias("kind"), "key", "vec")
        points = part if points is None else points.unionByName(part)
    spark = points.sparkSession
    plan = _plan(points, dims, shard_rows, sample_rows, seed)
    held = spark.sparkContext.broadcast(plan)
    low = -2.0 if min_similarity is None else min_similarity - 1e-5

    hashes = [F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(seed), "vec").alias("h2")]
    hashed = points.select("kind", "key", "vec", *hashes)
    classes = hashed.groupBy("kind", "h1", "h2").agg(F.min("key").alias("rep"), F.first("vec").alias("vec"))

    def route(batches):
        for b in batches:
            kinds = b.column("kind").to_numpy(zero_copy_only=False)
            reps = b.column("rep").to_numpy()
            x = matrix(b.column("vec"), dims)
            u = unit(x)
            for kind in np.unique(kinds):
                centres, shards = held.value[kind]
                at = np.nonzero(kinds == kind)[0]
                s = u[at] @ centres.T
                best = s.argmax(1)
                qi, cell = np.nonzero(s >= s[np.arange(len(at)), best][:, None] - margin)
                # every shard of a split cell is queried; a row is indexed in one of them
                times = shards[cell]
                qi, cell = np.repeat(qi, times), np.repeat(cell, times)
                sub = np.arange(len(qi)) - np.repeat(np.cumsum(times) - times, times)
                home = (cell == best[qi]) & (sub == np.abs(reps[at][qi]) % shards[cell])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([kind] * len(qi), pa.string()),
                        pa.array(cell.astype(np.int32)),
                        pa.array(sub.astype(np.int32)),
                        pa.array(home),
                        pa.array(reps[at][qi]),
                        packed(x[at][qi]),
                    ],
                    names=["kind", "cell", "sub", "home", "rep", "vec"],
                )

    routed = classes.select("kind", "rep", "vec").mapInArrow(route, "kind string, cell int, sub int, home boolean, rep bigint, vec binary")

    def answer(table: pa.Table) -> pa.Table:
        home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        rep = table.column("rep").to_numpy()
        raw = matrix(table.column("vec"), dims)
        u = unit(raw)
        inner = np.nonzero(home)[0]
        inner = inner[np.argsort(rep[inner], kind="stable")]
        outer = np.nonzero(~home)[0]
        found = []
        if len(inner):
            graph = Graph(np.ascontiguousarray(u[inner]), degree, beam, alpha, seed)
            for q, own in ((inner, np.arange(len(inner), dtype=np.int32)), (outer, None)):
                if len(q):
                    ids, sims = graph.query(np.ascontiguousarray(u[q]), k, query_beam, own)
                    i, j = np.nonzero((ids >= 0) & (sims >= low))
                    other = inner[ids[i, j]]
                    keep = rep[q[i]] != rep[other]
                    found.append((q[i][keep], other[keep]))
        a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, int)
        b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, int)
        sim = np.zeros(len(a))
        for lo in range(0, len(a), 1 << 16):
            sim[lo : lo + (1 << 16)] = cosines(raw[a[lo : lo + (1 << 16)]], raw[b[lo : lo + (1 << 16)]])
        kind = table.column("kind")[0].as_py() if len(table) else ""
        return pa.table([pa.array([kind] * len(a), pa.string()), pa.array(rep[a]), pa.array(rep[b]), pa.array(np.round(sim, 6))], names=["kind", "rep", "other", "similarity"])

    near = routed.groupBy("kind", "cell", "sub").applyInArrow(answer, "kind string, rep bigint, other bigint, similarity double")

    # members of the classes that hold several keys; only these need spreading
    keys = hashed.groupBy("kind", "h1", "h2", "key").agg(F.lit(1).alias("one"))
    sizes = keys.groupBy("kind", "h1", "h2").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = keys.join(sizes, ["kind", "h1", "h2"]).select("kind", "rep", "key")
    salted = W.partitionBy("kind", "rep", "salt").orderBy("key")
    whole = W.partitionBy("kind", "rep").orderBy("key")
    first = (
        members.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(64)))
        .withColumn("r", F.row_number().over(salted))
        .filter(F.col("r") <= k + 1)
        .withColumn("r", F.row_number().over(whole))
        .filter(F.col("r") <= k + 1)
        .select("kind", F.col("rep").alias("other"), F.col("key").alias("twin"))
    )
    one = F.round(F.lit(1.0), 6)
    links = near.unionByName(first.select("kind", F.col("other").alias("rep"), "other", one.alias("similarity")).distinct())
    order = [F.col("similarity").desc(), F.col("other")]
    ranked = W.partitionBy("kind", "rep").orderBy(*order)
    lists = (
        links.join(first, ["kind", "other"], "left")
        .select("kind", "rep", F.coalesce("twin", "other").alias("other"), "similarity")
        .groupBy("kind", "rep", "other")
        .agg(F.max("similarity").alias("similarity"))
        .withColumn("place", F.row_number().over(ranked))
        .filter(F.col("place") <= k + 1)
    )
    spread = lists.join(members.select("kind", "rep", "key"), ["kind", "rep"], "left").withColumn("key", F.coalesce("key", "rep"))
    final = W.partitionBy("kind", "key").orderBy(*order)
    out = (
        spread.filter(F.col("key") != F.col("other"))
        .groupBy("kind", "key", "other")
        .agg(F.max("similarity").alias("similarity"))
        .withColumn("place", F.row_number().over(final))
        .filter(F.col("place") <= k)
    )
    if min_similarity is not None:
        out = out.filter(F.col("similarity") >= min_similarity)
    return out.select("kind", "key", "other", "similarity", "place")
