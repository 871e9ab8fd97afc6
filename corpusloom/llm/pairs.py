"""Items that appear together: exact pair counts against a bipartite configuration null."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut
from ..operators.rows import canonical_vocab
from .bags import LOOKUP, block_sums, document_bags, lookup, spans
from .frequency import dense_ids


def fit_null(basket_size, baskets, item_freq, items, rounds: int = 400, tolerance: float = 1e-10):
    """Bipartite configuration model on degree classes.

    ``basket_size`` (K,) with ``baskets`` records each, ``item_freq`` (N,) with ``items`` items each.
    Returns p (K, N), the chance that a record of class k holds an item of class n, such that
    expected sizes and frequencies equal the given ones.
    """
    k, nk = np.asarray(basket_size, float), np.asarray(baskets, float)
    f, nf = np.asarray(item_freq, float), np.asarray(items, float)
    total = max(1.0, (k * nk).sum())
    x, y = k / np.sqrt(total), f / np.sqrt(total)
    full = f >= nk.sum()  # an item in every record has chance one
    for _ in range(rounds):
        open_k = np.maximum(k - nf[full].sum(), 0.0)
        d = (nf[None, :] * np.where(full, 0.0, y)[None, :] / (1.0 + np.outer(x, y))).sum(1)
        nx = np.where(d > 0, open_k / np.where(d > 0, d, 1.0), 0.0)
        d = (nk[:, None] * nx[:, None] / (1.0 + np.outer(nx, y))).sum(0)
        ny = np.where(d > 0, f / np.where(d > 0, d, 1.0), 0.0)
        done = np.abs(nx - x).max(initial=0) <= tolerance * (1 + x.max(initial=0)) and np.abs(ny - y).max(initial=0) <= tolerance * (1 + y.max(initial=0))
        x, y = nx, ny
        if done:
            break
    z = np.outer(x, y)
    p = z / (1.0 + z)
    p[:, full] = 1.0
    return p


def tail(q: np.ndarray, copies: np.ndarray, n: np.ndarray, steps: int = 30):
    """(mean, ln P(X >= n)) for X a sum of independent Bernoulli draws, row by row.

    ``q`` (rows, K) are the chances, ``copies`` (K,) how many records have each of them.  The tail is
    the lattice saddle-point form (Lugannani-Rice) of the Poisson-binomial; at or below the mean it
    is left at 0.
    """
    mean = q @ copies
    s = np.log(np.maximum(n, 0.5) / np.maximum(mean, 1e-300))
    most = ((q > 0) * copies).sum(1)
    up = (n > mean + 1e-9) & (n < most)
    s = np.where(up, np.maximum(s, 1e-8), 1.0)
    lo, hi = np.zeros(len(s)), np.full(len(s), 60.0)
    for _ in range(steps):
        e = q * np.exp(s)[:, None]
        r = e / (1.0 - q + e)
        k1 = r @ copies
        k2 = (r * (1.0 - r)) @ copies
        hi = np.where(k1 > n, np.minimum(hi, s), hi)
        lo = np.where(k1 <= n, np.maximum(lo, s), lo)
        nxt = s - (k1 - n) / np.maximum(k2, 1e-300)
        nxt = np.where((nxt > lo) & (nxt < hi), nxt, (lo + hi) / 2)
        still = up & (np.abs(nxt - s) > 1e-9 * (1 + s))
        s = np.where(up, nxt, s)
        if not still.any():
            break
    e = q * np.exp(s)[:, None]
    r = e / (1.0 - q + e)
    k2 = (r * (1.0 - r)) @ copies
    k0 = np.log1p(q * np.expm1(s)[:, None]) @ copies
    # lattice Lugannani-Rice form, as a factor of the normal density so that deep tails keep their logarithm
    w = np.sqrt(np.maximum(2.0 * (s * n - k0), 1e-12))
    u = -np.expm1(-s) * np.sqrt(np.maximum(k2, 1e-300))
    factor = _mills(w) + 1.0 / np.maximum(u, 1e-300) - 1.0 / w
    ln = -0.5 * w * w - 0.5 * np.log(2 * np.pi) + np.log(np.maximum(factor, 1e-300))
    certain = np.where(q > 0, np.log(np.maximum(q, 1e-300)) * copies, 0.0).sum(1)
    return mean, np.where(up, np.minimum(ln, 0.0), np.where((n >= most) & (n > mean + 1e-9), certain, 0.0))


# fixed values: coefficients of the Chebyshev fit of erfc, highest power last
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def _mills(w: np.ndarray) -> np.ndarray:
    """Upper normal tail over the density, to about 1e-7, for w >= 0."""
    t = 1.0 / (1.0 + 0.5 * w / np.sqrt(2.0))
    return 0.5 * t * np.exp(np.polyval(ERFC[::-1], t)) * np.sqrt(2.0 * np.pi)


#: Bits of a count beside its local key; with the 24 of the key they fill 63.
COUNT = 39
#: A group of pair keys: 256 rarer items (upper bits of the first rank) by 65,536 partners, so a group's counts fit in memory.
RARER, PARTNERS = 8, 16


def _coded(keys: np.ndarray, n: np.ndarray, codec: pa.Codec) -> bytes:
    """Sorted keys of one group as 32-bit differences, and their counts, byte plane by byte plane, compressed."""
    step = np.diff(_local(keys), prepend=0).astype(np.uint32)
    n = n.astype(np.uint32)
    wide = 4 if n.max() > 255 else 1
    planes = np.concatenate([step.view(np.uint8).reshape(-1, 4).T.ravel(), n.view(np.uint8).reshape(-1, 4)[:, :wide].T.ravel()])
    return np.array([len(keys), wide], np.int64).tobytes() + codec.compress(planes.tobytes(), asbytes=True)


def _local(keys: np.ndarray) -> np.ndarray:
    """Keys within their group: RARER + PARTNERS bits."""
    return ((keys >> 32) & ((1 << RARER) - 1)) << PARTNERS | (keys & ((1 << PARTNERS) - 1))


def _decoded(blob, codec: pa.Codec) -> np.ndarray:
    """Local key above and count in the COUNT lower bits of each entry."""
    view = memoryview(blob)
    size, wide = (int(x) for x in np.frombuffer(view[:16], np.int64))
    planes = np.frombuffer(codec.decompress(view[16:], (4 + wide) * size), np.uint8)
    step = np.ascontiguousarray(planes[: 4 * size].reshape(4, size).T).view(np.uint32).ravel()
    n = planes[4 * size :].astype(np.int64) if wide == 1 else np.ascontiguousarray(planes[4 * size :].reshape(4, size).T).view(np.uint32).ravel().astype(np.int64)
    return np.cumsum(step, dtype=np.int64) << COUNT | n


def _slices(limit: float | None, total: int, held, at_once: int = 1 << 22):
    """Arrow function: documents to counted, compressed groups of pair keys.

    A key holds the rank of the rarer item in its upper and of the other in its lower 32 bits.
    Each task sums what ``at_once`` pairs have in common before it hands them on.
    """
    group = lambda keys: (keys >> (32 + RARER) << 32) | ((keys & 0xFFFFFFFF) >> PARTNERS)

    def flush(pending):
        keys = np.sort(np.concatenate(pending))
        heads = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0]
        n = np.diff(np.r_[heads, len(keys)])
        keys = keys[heads]
        at = group(keys)
        # a group is a run only where all partners fall into one range; else the runs are brought together
        if (at[1:] < at[:-1]).any():
            order = np.argsort(at, kind="stable")
            keys, n, at = keys[order], n[order], at[order]
        edges = np.nonzero(np.r_[True, at[1:] != at[:-1]])[0]
        codec = pa.Codec("zstd", 1)
        blobs = [_coded(keys[lo:hi], n[lo:hi], codec) for lo, hi in zip(edges, [*edges[1:], len(keys)])]
        return pa.RecordBatch.from_arrays([pa.array(at[edges]), pa.array(blobs, pa.binary())], names=["block", "keys"])

    def run(batches):
        pending, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            flat, per = spans(b.column("items"))
            item = flat.to_numpy(zero_copy_only=False)
            if held is None:
                df = b.column("dfs").flatten().to_numpy(zero_copy_only=False).astype(float)
                item = item.astype(np.int64)
            else:
                known, at = held.value.find(item)
                doc = np.repeat(np.arange(len(per)), per)[known]
                key = np.sort((doc << 32) | held.value.values[0][at[known]])
                per, item = np.bincount(key >> 32, minlength=len(per)), key & 0xFFFFFFFF
                df = held.value.by_rank[item].astype(float)
            end = np.repeat(np.cumsum(per), per)
            at = np.arange(len(item))
            if limit is not None and len(item):
                # the last partner rare enough to matter: rows are sorted by df within a document
                most = np.minimum(total * (df / total) ** limit * (1 + 1e-9), total)
                base = np.repeat(np.arange(len(per)), per) * (2.0 * (total + 1))
                end = np.minimum(end, np.searchsorted(base + df, base + most, side="right"))
            reach = np.maximum(end - at - 1, 0)
            cum = np.cumsum(reach)
            lo = 0
            while lo < len(item):
                done = cum[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(cum, done + at_once - rows, side="right")))
                i = np.repeat(np.arange(lo, hi), reach[lo:hi])
                j = i + 1 + np.arange(len(i)) - np.repeat(cum[lo:hi] - reach[lo:hi] - done, reach[lo:hi])
                pending.append((item[i] << 32) | item[j])
                rows += len(i)
                if rows >= at_once:
                    yield flush(pending)
                    pending, rows = [], 0
                lo = hi
        if rows:
            yield flush(pending)

    return run


def _sums(min_count: int, bound=None, at_once: int = 1 << 21):
    """Arrow function over rows sorted by group: exact counts (a, b, n_ab) of at least ``min_count``.

    One group is held at a time, and of it only its distinct pairs and what is not yet added.
    ``bound(a, b)`` may give a greater least count.
    """

    mask = (1 << COUNT) - 1

    def merge(parts):
        packed = np.sort(np.concatenate(parts))
        keys = packed >> COUNT
        heads = np.nonzero(np.r_[True, keys[1:] != keys[:-1]])[0]
        return (keys[heads] << COUNT) | np.add.reduceat(packed & mask, heads)

    def out(block, packed):
        packed = packed[(packed & mask) >= min_count]
        key, n = packed >> COUNT, packed & mask
        a, b = (block >> 32 << RARER) | (key >> PARTNERS), ((block & 0xFFFFFFFF) << PARTNERS) | (key & ((1 << PARTNERS) - 1))
        if bound is not None:
            keep = n >= bound(a, b)
            a, b, n = a[keep], b[keep], n[keep]
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n_ab"])

    def run(batches):
        codec = pa.Codec("zstd", 1)
        block, pending, rows = None, [], 0
        for batch in batches:
            for at, blob in zip(batch.column("block").to_pylist(), batch.column("keys")):
                if at != block:
                    if pending:
                        yield out(block, merge(pending))
                    block, pending, rows = at, [], 0
                pending.append(_decoded(blob.as_buffer(), codec))
                rows += len(pending[-1])
                if rows >= at_once:
                    pending = [merge(pending)]
                    # what is left of a merge counts little against the next one
                    rows = min(len(pending[0]), at_once // 2)
        if pending:
            yield out(block, merge(pending))

    return run


def item_pairs(baskets: DataFrame, min_count: int = 8, min_npmi: float | None = 0.6, max_q: float | None = None, limit: int = LOOKUP) -> DataFrame:
    """``list_pairs`` over rows (basket BIGINT, item INT), item >= 0; repeated rows count once.

    Null baskets and items are left out; other columns are ignored; an empty table gives no rows.
    """
    rows = baskets.select("basket", F.col("item").cast("int").alias("item")).filter("basket is not null and item is not null and item >= 0")
    return list_pairs(rows.groupBy("basket").agg(F.collect_set("item").alias("items")), min_count, min_npmi, max_q, limit)


def list_pairs(baskets: DataFrame, min_count: int = 8, min_npmi: float | None = 0.6, max_q: float | None = None, limit: int = LOOKUP) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, npmi, expected, ln_p, q): items that stand together.

    ``baskets``: rows with ``items``, an array of distinct items >= 0 (INT).  ``n_ab`` is exact.  ``npmi``
    is ln(n_ab D / (n_a n_b)) / -ln(n_ab / D), 1 for a pair in all baskets.  ``expected`` and ``ln_p`` come
    from the fitted null that honours every item's frequency and every basket's size (bipartite
    configuration model on degree classes, Poisson-binomial upper tail), ``q`` is the false discovery
    rate at that p (among all pairs of items; pairs below the bounds count as not surprising, so q is
    never too small).

    Only pairs with n_ab >= ``min_count``, npmi >= ``min_npmi`` and q <= ``max_q`` come out; with a bound of
    None (``min_npmi``, ``max_q``) it selects nothing.  The first two prune exactly before any pair is
    formed: rarer items are dropped, and since n_ab is at most the rarer item's count, an item meets
    only items of at most D (n / D)^min_npmi baskets.  Items are ranked by frequency; every task sums
    its pairs before it hands them on as compressed groups of 256 rarer items by 65,536 partners, which
    bounds what a reducing task holds; a long basket goes in slices.  A table of more than
    ``limit`` items is joined and not sent to the tasks.
    """
    lists_ = cut(baskets.select("items").filter(F.size("items") > 0))
    spark = lists_.sparkSession
    total = lists_.count()
    counts_of = block_sums(lists_.select(F.col("items").alias("words"), F.array_repeat(F.lit(1), F.size("items")).alias("counts")))
    freq = cut(counts_of.select(F.col("code").cast("int").alias("item"), F.col("doc_freq").alias("df")))
    kept = freq.filter(F.col("df") >= min_count)
    ranks = dense_ids(kept.select(F.struct("df", "item").alias("at")), "at", "rank")
    held, ranks = lookup(ranks.select(F.col("at.item").alias("item"), F.col("rank").cast("int").alias("rank"), F.col("at.df").alias("df")), "item", "rank", "df", limit=limit)
    bound = None
    if held is None:
        placed = lists_.withColumn("basket", F.monotonically_increasing_id()).select("basket", F.explode("items").alias("item")).join(ranks, "item")
        packed = placed.groupBy("basket").agg(F.array_sort(F.collect_list(F.struct("rank", "df"))).alias("b"))
        source = packed.select(F.transform("b", lambda x: x["rank"]).alias("items"), F.transform("b", lambda x: x["df"]).alias("dfs"))
    else:
        table = held.value
        table.by_rank = np.zeros(len(table.keys), np.int64)
        table.by_rank[table.values[0]] = table.values[1]
        held = spark.sparkContext.broadcast(table)
        source = lists_.select("items")
        if min_npmi is not None:
            # npmi >= t means n_ab / D >= (n_a n_b / D^2)^(1 / (1 + t))
            def bound(a, b):
                df = held.value.by_rank
                return total * (df[a] / total * (df[b] / total)) ** (1 / (1 + min_npmi)) * (1 - 1e-9)

    keys = source.filter(F.size("items") > 1).mapInArrow(_slices(min_npmi, max(total, 1), held), "block bigint, keys binary")
    # blobs are large: more and smaller partitions keep an Arrow batch of them small
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = keys.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(_sums(min_count, bound), "a bigint, b bigint, n_ab bigint")
    fa = ranks.select(F.col("rank").cast("bigint").alias("a"), F.col("item").alias("item_a"), F.col("df").alias("n_a"))
    fb = ranks.select(F.col("rank").cast("bigint").alias("b"), F.col("item").alias("item_b"), F.col("df").alias("n_b"))
    d = F.lit(float(max(total, 1)))
    npmi = F.when(F.col("n_ab") >= d, F.lit(1.0)).otherwise(F.log(F.col("n_ab") * d / (F.col("n_a").cast("double") * F.col("n_b"))) / -F.log(F.col("n_ab") / d))
    found = counts.join(fa, "a").join(fb, "b").withColumn("npmi", npmi)
    if min_npmi is not None:
        found = found.filter(F.col("npmi") >= min_npmi)

    # degree histograms: summed by degree in Spark, and beyond 1000 by classes of 1 %, so their size is bounded
    width = F.floor(F.log(F.col("degree") / 1000) / 0.01)
    label = F.when(F.col("degree") <= 1000, F.col("degree")).otherwise(1001 + width).alias("label")

    def histogram(degrees):
        by = degrees.groupBy("degree").agg(F.count(F.lit(1)).alias("n")).groupBy(label).agg(F.sum(F.col("degree") * F.col("n")).alias("s"), F.sum("n").alias("n")).orderBy("label")
        r = np.array([tuple(x) for x in by.collect()], float).reshape(-1, 3)
        return r[:, 0].astype(np.int64), r[:, 1] / np.maximum(r[:, 2], 1), r[:, 2]

    _, size, baskets_of = histogram(lists_.select(F.size("items").cast("bigint").alias("degree")))
    labels, f, items_of = histogram(freq.select(F.col("df").alias("degree")))
    null = spark.sparkContext.broadcast((fit_null(size, baskets_of, f, items_of), baskets_of, labels))
    v = float(items_of.sum())
    columns = ["item_a", "item_b", "n_ab", "n_a", "n_b", "npmi"]

    def score(batches):
        p, copies, labels = null.value
        for b in batches:
            if not b.num_rows:
                continue
            at = [_class_of(labels, b.column(c).to_numpy()) for c in ("n_a", "n_b")]
            n = b.column("n_ab").to_numpy().astype(float)
            # a pair's tail depends on its two classes and its count only
            case, back = np.unique(np.stack([np.minimum(*at), np.maximum(*at), n.astype(np.int64)]), axis=1, return_inverse=True)
            mean, ln = np.empty(case.shape[1]), np.empty(case.shape[1])
            for lo in range(0, len(mean), 1024):
                s = slice(lo, lo + 1024)
                mean[s], ln[s] = tail((p[:, case[0, s]] * p[:, case[1, s]]).T, copies, case[2, s].astype(float))
            back = back.ravel()
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(mean[back]), pa.array(ln[back])], names=[*columns, "expected", "ln_p"])

    scored = cut(found.select(*columns).mapInArrow(score, "item_a int, item_b int, n_ab bigint, n_a bigint, n_b bigint, npmi double, expected double, ln_p double"))
    # step-up procedure on a histogram of ln p: bounded bins, each taken at its greater end
    bins = sorted((int(r[0]), int(r[1])) for r in scored.groupBy(F.least(F.floor(-F.col("ln_p") * 10), F.lit(20000)).alias("bin")).count().collect())
    q, rank, least, tests = {}, sum(n for _, n in bins), np.inf, np.log(max(1.0, v * (v - 1) / 2))
    for bin_, n in bins:  # from the least to the most surprising
        least = min(least, tests - bin_ / 10 - np.log(max(rank, 1)), 0.0)
        q[bin_] = float(np.exp(least))
        rank -= n
    table = spark.createDataFrame([(k, x) for k, x in q.items()] or [(0, 1.0)], "bin bigint, q double")
    out = scored.withColumn("bin", F.least(F.floor(-F.col("ln_p") * 10), F.lit(20000))).join(F.broadcast(table), "bin")
    if max_q is not None:
        out = out.filter(F.col("q") <= max_q)
    return out.select(*columns, "expected", "ln_p", "q")


def _class_of(labels: np.ndarray, degree: np.ndarray, exact: int = 1000, width: float = 0.01) -> np.ndarray:
    """Place of a degree's class in ``labels``; floating point may put an edge one class off, so the nearest counts."""
    label = np.where(degree <= exact, degree, exact + 1 + np.floor(np.log(np.maximum(degree, 1) / exact) / width)).astype(np.int64)
    return np.minimum(np.searchsorted(labels, label), len(labels) - 1)


def word_pairs(corpus: DataFrame, vocab: DataFrame, min_count: int = 8, min_npmi: float | None = 0.6, max_q: float | None = None, limit: int = LOOKUP) -> DataFrame:
    """``list_pairs`` over the words of the last loaded documents: term_a < term_b by code points."""
    names = canonical_vocab(vocab).select("word_id", "word").distinct()
    found = list_pairs(document_bags(corpus, vocab, limit).select(F.col("words").alias("items")), min_count, min_npmi, max_q, limit)
    named = found.join(names.select(F.col("word_id").alias("item_a"), F.col("word").alias("wa")), "item_a").join(names.select(F.col("word_id").alias("item_b"), F.col("word").alias("wb")), "item_b")
    first = F.col("wa") < F.col("wb")
    return named.select(
        F.least("wa", "wb").alias("term_a"), F.greatest("wa", "wb").alias("term_b"), "n_ab",
        F.when(first, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"), F.when(first, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b"),
        "npmi", "expected", "ln_p", "q",
    )
