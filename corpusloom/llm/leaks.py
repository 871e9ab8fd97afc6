"""Evaluation texts inside a training corpus: edit-tolerant windows by embedding and bit sampling."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAD = np.uint64(0x5851F42D4C957F2D)


def words(text) -> "F.Column":
    """64-bit hashes of the words of a text: longest runs of letters and digits, in lower case.

    Characters that print nothing (Unicode format characters) are taken out first.
    """
    clean = F.lower(F.regexp_replace(text, r"\p{Cf}", ""))
    return F.transform(F.regexp_extract_all(clean, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.xxhash64(w))


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def bucket_keys(flat: np.ndarray, start: np.ndarray, width: int, repeat: int, bits: int, seed: int = 1, end: np.ndarray | None = None) -> np.ndarray:
    """Bucket of every window ``flat[start : start + width]`` in one repetition.

    The window is read by a random walk of 3 x width steps: a step writes the word under the
    pointer, and a random bit of word and step says whether the pointer moves on, so windows a few
    edits apart fall into step again and their walks differ in few places.  The key hashes ``bits``
    sampled places.  Places from ``end`` (one per window) on read as padding.
    """
    rng = np.random.default_rng([seed, repeat])
    steps = 3 * width
    places = np.zeros(steps, bool)
    # the last width steps are mostly padding; places are drawn where the walk still reads
    places[rng.choice(2 * width, min(bits, 2 * width), replace=False)] = True
    salt = rng.integers(1, 2**63, steps, dtype=np.uint64) | np.uint64(1)
    at = np.zeros(len(start), np.int64)
    key = np.full(len(start), np.uint64(repeat + 1))
    for j in range(int(np.nonzero(places)[0][-1]) + 1):
        word = np.where((at < width) & (end is None or start + at < end), flat[np.minimum(start + at, len(flat) - 1)], PAD)
        if places[j]:
            key = _mix(key ^ word) + np.uint64(j)
        at += ((word * salt[j]) >> np.uint64(63)).astype(np.int64)
    return key


def edits(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Edit distance of the rows of a and b (n, width), cut at ``most`` + 1; only the band is filled."""
    n, w = a.shape
    if most == 0:
        return (a != b).any(1).astype(np.int64)
    far = most + 1
    row = np.full((n, w + 1), far, np.int64)
    row[:, : min(most, w) + 1] = np.arange(min(most, w) + 1)
    for i in range(1, w + 1):
        new = np.full((n, w + 1), far, np.int64)
        if i <= most:
            new[:, 0] = i
        for j in range(max(1, i - most), min(w, i + most) + 1):
            new[:, j] = np.minimum(row[:, j - 1] + (a[:, i - 1] != b[:, j - 1]), np.minimum(row[:, j], new[:, j - 1]) + 1)
        row = np.minimum(new, far)
    return row[:, w]


def edits_free(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Edit distance of the rows of a (n, width) to the nearest start of the rows of b (n, width + most), cut at ``most`` + 1.

    Only starts of width - most to width + most words can be within ``most`` edits.
    """
    n, w = a.shape
    if most == 0:
        return (a != b).any(1).astype(np.int64)
    far = most + 1
    row = np.full((n, w + most + 1), far, np.int64)
    row[:, : far] = np.arange(far)
    for i in range(1, w + 1):
        new = np.full((n, w + most + 1), far, np.int64)
        if i <= most:
            new[:, 0] = i
        for j in range(max(1, i - most), i + most + 1):
            new[:, j] = np.minimum(row[:, j - 1] + (a[:, i - 1] != b[:, j - 1]), np.minimum(row[:, j], new[:, j - 1]) + 1)
        row = np.minimum(new, far)
    return row[:, max(0, w - most) :].min(1)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64), np.diff(column.offsets.to_numpy()).astype(np.int64)


def _starts(per: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of every full window of the rows of ``per`` words each."""
    count = np.maximum(per - width + 1, 0)
    row = np.repeat(np.arange(len(per)), count)
    base = np.cumsum(per) - per
    return row, base[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def find_leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", width: int = 12, max_edits: int = 1, repeats: int = 9, bits: int = 8, block_words: int = 2_000_000) -> DataFrame:
    """(doc, item, edits, windows): the items of which a document holds at least one window.

    A window is ``width`` consecutive words of an item; it is held if consecutive words of the
    document, ``width`` - ``max_edits`` to ``width`` + ``max_edits`` of them, differ from it by at most
    ``max_edits`` edits of words: replaced, inserted or left out.  ``edits`` is the least found,
    ``windows`` the number of (document place, item place) pairs verified.

    Method.  Every window of every text is embedded by a random walk that turns edit distance into
    Hamming distance, and hashed on ``bits`` sampled places, ``repeats`` times; windows of documents
    and items that share a bucket are compared exactly.  Windows without an edit share every bucket
    and are never missed; with edits a window is found with the chance the tests measure, and a
    leaked passage has many.  Windows that hold too few words of any item are skipped first, which
    loses nothing.  Items are few and are sent to the tasks in blocks of at most ``block_words``
    words; documents stay where they are and are read once a block.

    Null texts and keys give no row, nor do items of fewer than ``width`` words and documents of fewer
    than ``width`` - ``max_edits``; equal rows count
    together; other columns are ignored.  Empty tables give no rows.
    """
    spark = docs.sparkSession
    shape = "doc bigint, item bigint, edits int, windows bigint"
    it = items.select(F.col(item_key).cast("bigint").alias("item"), words(F.col(text)).alias("words")).filter("item is not null and words is not null").filter(F.size("words") >= width).distinct()
    total = it.agg(F.sum(F.size("words"))).first()[0] or 0
    d = docs.select(F.col(doc_key).cast("bigint").alias("doc"), words(F.col(text)).alias("words")).filter("doc is not null and words is not null").filter(F.size("words") >= max(1, width - max_edits))
    blocks = max(1, math.ceil(total / block_words))
    out = None
    for block in range(blocks):
        part = it if blocks == 1 else it.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        found = _scan(spark, d, part.toArrow(), width, max_edits, repeats, bits, shape)
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc", "item").agg(F.min("edits").alias("edits"), F.sum("windows").alias("windows"))


def _scan(spark, d, table, width, most, repeats, bits, shape):
    item = table.column("item").to_numpy()
    column = table.column("words").combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat, per = _flat(column) if len(item) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    row, start = _starts(per, width)
    index = []
    for r in range(repeats if len(start) else 0):
        key = bucket_keys(flat, start, width, r, bits)
        order = np.argsort(key, kind="stable")
        index.append((key[order], order))
    held = spark.sparkContext.broadcast((item, flat, row, start, index, np.unique(flat)))

    def scan(batches):
        item, flat, row, start, index, known = held.value
        for b in batches:
            if not b.num_rows or not len(start):
                continue
            doc = b.column("doc").to_numpy()
            words_, per = _flat(b.column("words"))
            # a document place may be short of words by the edits
            r, s = _starts(per, max(1, width - most))
            end = np.cumsum(per)[r]
            near = np.searchsorted(known, words_)
            hit = known[np.minimum(near, len(known) - 1)] == words_
            run = np.r_[0, np.cumsum(hit)]
            keep = run[np.minimum(s + width, end)] - run[s] >= width - most
            r, s, end = r[keep], s[keep], end[keep]
            if not len(s):
                continue
            pairs = []
            for k, (key, order) in enumerate(index):
                mine = bucket_keys(words_, s, width, k, bits, end=end)
                lo, hi = np.searchsorted(key, mine, "left"), np.searchsorted(key, mine, "right")
                n = hi - lo
                a = np.repeat(np.arange(len(s)), n)
                at = np.repeat(lo, n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
                pairs.append(np.unique(a * len(start) + order[at]))
                if most == 0:
                    break  # equal windows share every bucket
            pairs = np.unique(np.concatenate(pairs))
            for lo in range(0, len(pairs), 1 << 18):
                a, w = pairs[lo : lo + (1 << 18)] // len(start), pairs[lo : lo + (1 << 18)] % len(start)
                at = s[a][:, None] + np.arange(width + most)
                text = np.where(at < end[a][:, None], words_[np.minimum(at, len(words_) - 1)], PAD)
                e = edits_free(flat[start[w][:, None] + np.arange(width)], text, most)
                ok = e <= most
                if ok.any():
                    yield pa.RecordBatch.from_arrays([pa.array(doc[r[a[ok]]]), pa.array(item[row[w[ok]]]), pa.array(e[ok].astype(np.int32)), pa.array(np.ones(int(ok.sum()), np.int64))], names=["doc", "item", "edits", "windows"])

    return d.mapInArrow(scan, shape)
