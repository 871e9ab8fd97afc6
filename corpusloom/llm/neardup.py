"""Near-duplicate documents: exact multiset similarity found through a trie join of parity sketches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut, small
from .bags import LOOKUP, block_sums, document_bags, lookup, spans
from .components import components
from .trie import self_join


def _mix(z: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer, so that near integers get unrelated bits."""
    z = z.astype(np.uint64, copy=True)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _rarity(bags: DataFrame, limit: int):
    """(lookup or None, frame (code, df)): in how many of the bags each word stands."""
    return lookup(block_sums(bags).select(F.col("code").cast("int").alias("code"), F.col("doc_freq").alias("df")), "code", "df", limit=limit)


def _postings(threshold: float, width: int, held):
    """Arrow function: (rep, words, counts[, dfs]) to one row per prefix element, with the document's sketch."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rep = b.column("rep").to_numpy()
            flat, per = spans(b.column("words"))
            word = flat.to_numpy(zero_copy_only=False)
            n = b.column("counts").flatten().to_numpy(zero_copy_only=False)
            if held is None:
                df = b.column("dfs").flatten().to_numpy(zero_copy_only=False)
            else:
                df = held.value.values[0][held.value.find(word)[1]]
            # rarest words first, ties by word
            doc = np.repeat(np.arange(len(rep)), per)
            order = np.lexsort((word, df, doc))
            word, n, doc = word[order], n[order], np.repeat(doc, n)
            nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            h = _mix((np.repeat(word, n).astype(np.uint64) << np.uint64(32)) ^ (nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            size = np.bincount(doc, minlength=len(rep))
            bit = (_mix(h + np.uint64(1)) % np.uint64(width)).astype(np.int64)
            odd = (np.bincount(doc * width + bit, minlength=len(rep) * width) & 1).astype(np.uint8).reshape(len(rep), width)
            sketch = np.packbits(odd, axis=1)
            place = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
            probe = size - np.ceil(threshold * size - 1e-9).astype(int) + 1
            keep = place < probe[doc]
            d = doc[keep]
            at = pa.array(np.arange(len(d) + 1, dtype=np.int32) * sketch.shape[1])
            rows = pa.Array.from_buffers(pa.binary(), len(d), [None, at.buffers()[1], pa.py_buffer(np.ascontiguousarray(sketch[d]).tobytes())])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[keep].view(np.int64)), pa.array(rep[d]), pa.array(size[d].astype(np.int32)), pa.array(place[keep].astype(np.int32)), rows],
                names=["token", "rep", "size", "place", "sketch"],
            )

    return run


def _trie_pairs(threshold: float, rows_at_once: int = 1 << 18):
    """Arrow function over partitions sorted by head: pairs that the trie join keeps."""
    share = (1 - threshold) / (1 + threshold)

    def budget(a, b):
        return np.floor(share * (a + b) + 1e-9)

    def join(table):
        head = table.column("head").to_numpy()
        rep, size = table.column("rep").to_numpy(), table.column("size").to_numpy().astype(np.int64)
        left = size - table.column("place").to_numpy()
        mine, cross = table.column("block").to_numpy(), table.column("cross").to_numpy(zero_copy_only=False).astype(bool)
        col = table.column("sketch").combine_chunks()
        col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
        sk = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(head), -1)

        def enough(size_a, left_a, size_b, left_b):
            """Whether rows may be similar if this is the first element they share: what is left of both must hold the overlap."""
            return np.minimum(left_a, left_b) >= threshold / (1 + threshold) * (size_a + size_b) - 1e-9

        def fits(i, j):
            return enough(size[i], left[i], size[j], left[j]) & (rep[i] != rep[j]) & (~cross[i] | (mine[i] != mine[j]))

        for i, j in self_join(head, sk, budget, size, fits, size, left, enough):
            a, b = rep[i], rep[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches):
        held, rows = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows >= rows_at_once:
                table = pa.Table.from_batches(held).combine_chunks()
                head = table.column("head").to_numpy()
                split = int(np.searchsorted(head, head[-1]))  # the last head may go on
                if split:
                    yield from join(table.slice(0, split).combine_chunks())
                    held, rows = table.slice(split).to_batches(), table.num_rows - split
        if rows:
            yield from join(pa.Table.from_batches(held).combine_chunks())

    return run


def _similar(threshold: float):
    """Arrow function: exact sum(min) / sum(max) of the two bags of each candidate pair."""

    def side(words, counts):
        flat, per = spans(words)
        key = (np.repeat(np.arange(len(per)), per) << 32) | flat.to_numpy(zero_copy_only=False).astype(np.int64)
        return key, counts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            # words ascend within a document, so both key arrays are sorted
            (ka, na), (kb, nb) = (side(b.column(f"words_{x}"), b.column(f"counts_{x}")) for x in "ab")
            at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
            hit = kb[at] == ka
            least = np.bincount(ka[hit] >> 32, np.minimum(na[hit], nb[at[hit]]), b.num_rows)
            size = np.bincount(ka >> 32, na, b.num_rows) + np.bincount(kb >> 32, nb, b.num_rows)
            sim = least / (size - least)
            keep = least >= threshold * (size - least) - 1e-9
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(sim)], names=["a", "b", "similarity"]).filter(pa.array(keep))

    return run


def near_duplicates(corpus: DataFrame, vocab: DataFrame, threshold: float = 0.8, min_words: int = 10, width: int = 256, hot_rows: int = 16_384, limit: int = LOOKUP):
    """Pairs of different texts of similarity >= ``threshold``, and the classes of equal texts.

    Returns (links, members).  ``links``: (a, b, similarity), a < b, one row for each two classes;
    ``members``: (doc_id, class_id), class_id the smallest doc_id with the same words.  Similarity
    is sum(min) / sum(max) over the counts of all words; word order plays no role.

    Method, without a miss: the word counts of a document are elements (word, occurrence).
    A parity sketch of ``width`` bits holds, for each bit, whether an odd number of elements hash
    to it; documents that differ in e elements differ in at most e bits, and similar documents of
    sizes s and t differ in at most (1 - threshold) / (1 + threshold) (s + t) elements, which is the
    Hamming budget.  Documents meet under each of the rare elements of which similar ones must
    share one; below it a binary trie of the sketches is joined with itself, node pair by node
    pair, and pruned by the budget.  What remains is compared exactly.  An element that more than
    ``hot_rows`` documents hold is split: the documents are dealt into blocks and each two blocks
    meet in a task of their own.  Lookup tables of more than ``limit`` rows are joined and not sent.

    A document is its last loaded state; null tokens, null entries and unknown ids are dropped;
    documents of fewer than ``min_words`` words and null doc_ids are left out.  Equal texts form
    one class and are compared once.  Empty tables give no rows; other columns are ignored.
    """
    total = F.aggregate("counts", F.lit(0), lambda s, x: s + x)
    bags = document_bags(corpus, vocab, limit).withColumn("size", total).filter(F.col("size") >= min_words)
    docs = cut(bags.select("doc_id", "words", "counts", F.xxhash64("words", "counts").alias("h1"), F.xxhash64(F.lit(17), "counts", "words").alias("h2")))
    classes = docs.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    members = docs.select("doc_id", "h1", "h2").join(classes, ["h1", "h2"]).select("doc_id", F.col("rep").alias("class_id"))
    # the smallest doc_id of a class stands for it; the join is on what the docs are known by
    reps = docs.join(classes, ["h1", "h2"]).filter(F.col("doc_id") == F.col("rep")).select("rep", "words", "counts")
    held, rarity = _rarity(docs, limit)
    shape = "token bigint, rep bigint, size int, place int, sketch binary"
    if held is None:
        flat = reps.select("rep", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("rep", "at", F.col("x.words").alias("code"), F.col("x.counts").alias("n")).join(rarity, "code")
        packed = flat.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("at", "code", "n", "df"))).alias("b"))
        listed = packed.select("rep", F.col("b.code").alias("words"), F.col("b.n").alias("counts"), F.col("b.df").alias("dfs"))
    else:
        listed = reps
    rows = cut(listed.mapInArrow(_postings(threshold, width, held), shape))
    # only elements of more than hot_rows documents need a row of their own: the others form one block
    hot, few = small(rows.groupBy("token").agg(F.count(F.lit(1)).alias("held")).filter(F.col("held") > hot_rows))
    rows = rows.join(hot, "token", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("held") / hot_rows), F.lit(1)).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("block", "other"), F.greatest("block", "other")
    rows = rows.select(F.when(F.col("blocks") == 1, F.col("token")).otherwise(F.xxhash64("token", lo, hi)).alias("head"), "rep", "size", "place", "block", (lo != hi).alias("cross"), "sketch")
    pairs = rows.repartition("head").sortWithinPartitions("head").mapInArrow(_trie_pairs(threshold), "a bigint, b bigint").distinct()
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("words").alias(f"words_{x}"), F.col("counts").alias(f"counts_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "words_a", "counts_a", "words_b", "counts_b")
    links = cut(both.mapInArrow(_similar(threshold), "a bigint, b bigint, similarity double"))
    return links, members


def duplicate_pairs(links: DataFrame, members: DataFrame, block_rows: int = 1024) -> DataFrame:
    """(doc_id_a, doc_id_b), a < b: every two similar documents, equal ones included.

    A class of more than ``block_rows`` copies is dealt into blocks, and each two blocks meet under a
    key of their own, so that no task writes all pairs of a class.
    """
    m = cut(members)
    copies = m.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"))
    m = cut(m.join(copies, "class_id").withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int")).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")))
    a = m.select(F.col("doc_id").alias("x"), F.col("class_id").alias("a"))
    b = m.select(F.col("doc_id").alias("y"), F.col("class_id").alias("b"))
    across = links.select("a", "b").join(a, "a").join(b, "b").select("x", "y")
    met = m.filter("n > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("class_id", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "doc_id")
    key = ["class_id", "lo", "hi"]
    met = met.select(*key, F.col("block").alias("p"), F.col("doc_id").alias("x")).join(met.select(*key, F.col("block").alias("q"), F.col("doc_id").alias("y")), key)
    within = met.filter("x < y and (lo = hi or p <> q)").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def duplicate_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, class_id, group_id, links): one row per document that has a copy or a similar text.

    ``group_id`` is the smallest doc_id joined by links, ``links`` the number of other texts
    (classes) that are similar to the document's.
    """
    roots = components(links.select("a", "b"))
    degree = links.select(F.col("a").alias("class_id")).unionByName(links.select(F.col("b").alias("class_id"))).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    sizes = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"))
    out = members.join(sizes, "class_id").join(roots.withColumnRenamed("node", "class_id"), "class_id", "left").join(degree, "class_id", "left")
    return out.filter("copies > 1 or links is not null").select("doc_id", "class_id", F.coalesce("root", "class_id").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
