"""Word counts of the last loaded documents, packed as arrays: what the corpus operators share.

One shuffle brings the states of a document together; words are looked up and counted in the same
stage, so the (document, word) rows are never spread out.  A vocabulary of more ids than ``limit`` is
not sent to the tasks but joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut
from ..operators.rows import canonical_vocab, latest_rows

#: Greatest number of ids of a lookup table that is sent to the tasks (8 to 16 bytes each).
LOOKUP = 2_000_000


class Lookup:
    """Sorted integer keys and the values beside them; sent to tasks as it is."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], [v[order] for v in values]

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, place) of every element."""
        if not len(self.keys):
            return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
        at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
        return self.keys[at] == x, at


def lookup(df: DataFrame, key: str, *values: str, limit: int = LOOKUP):
    """A ``Lookup`` of ``df`` as a broadcast, or None where it has more than ``limit`` rows; and the frame, written once."""
    df = cut(df.select(key, *values))
    if df.count() > limit:
        return None, df
    t = df.toArrow()
    return df.sparkSession.sparkContext.broadcast(Lookup(*(t.column(c).to_numpy() for c in (key, *values)))), df


def lists(per: np.ndarray, *flat: np.ndarray) -> list[pa.Array]:
    """Arrow lists of ``per`` entries each, cut from flat arrays."""
    at = pa.array(np.r_[0, np.cumsum(per)].astype(np.int32))
    return [pa.ListArray.from_arrays(at, pa.array(f)) for f in flat]


def spans(column) -> tuple[pa.Array, np.ndarray]:
    """(flat values, entries per row) of an Arrow list column."""
    return column.flatten(), np.diff(column.offsets.to_numpy()).astype(np.int64)


def counted(doc: np.ndarray, word: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries per row, words, counts): occurrences (doc, word >= 0) counted, words ascending."""
    key = np.sort((doc.astype(np.int64) << 32) | word.astype(np.int64))
    heads = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0] if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.r_[heads, len(key)])
    return np.bincount(key[heads] >> 32, minlength=rows), (key[heads] & 0xFFFFFFFF).astype(np.int32), n.astype(np.int32)


def encoded_bags(corpus: DataFrame, ids: DataFrame, limit: int = LOOKUP) -> DataFrame:
    """(doc_id, words ARRAY<INT>, counts ARRAY<INT>): the last state of every document with a known word.

    ``ids`` maps term_id to code >= 0 (INT); several ids may share a code.  ``words`` are ascending, so
    equal documents have equal arrays.  Null tokens, null entries and unknown ids are dropped.
    """
    last = latest_rows(corpus, ["doc_id"], "loaded_at", ["tokens"]).filter(F.size("tokens") > 0)
    shape = f"doc_id {dict(last.dtypes)['doc_id']}, words array<int>, counts array<int>"
    held, ids = lookup(ids, "term_id", "code", limit=limit)
    if held is None:
        terms = last.select("doc_id", F.explode("tokens").alias("term_id")).filter("term_id is not null").groupBy("doc_id", "term_id").agg(F.count(F.lit(1)).alias("n"))
        words = terms.join(ids, "term_id").groupBy("doc_id", "code").agg(F.sum("n").cast("int").alias("n"))
        bag = words.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("code").cast("int").alias("code"), "n"))).alias("b"))
        return bag.select("doc_id", F.transform("b", lambda x: x["code"]).alias("words"), F.transform("b", lambda x: x["n"]).alias("counts"))

    def encode(batches):
        table = held.value
        for b in batches:
            flat, per = spans(b.column("tokens"))
            known, at = table.find(flat.fill_null(0).to_numpy(zero_copy_only=False))
            known &= flat.is_valid().to_numpy(zero_copy_only=False)
            per, word, n = counted(np.repeat(np.arange(len(per)), per)[known], table.values[0][at[known]], b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *lists(per, word, n)], names=["doc_id", "words", "counts"]).filter(pa.array(per > 0))

    return last.mapInArrow(encode, shape)


def document_bags(corpus: DataFrame, vocab: DataFrame, limit: int = LOOKUP) -> DataFrame:
    """``encoded_bags`` with the smallest term_id of a word as its code."""
    return encoded_bags(corpus, canonical_vocab(vocab).select("term_id", F.col("word_id").alias("code")), limit)


def block_sums(bags: DataFrame, range_bits: int = 12) -> DataFrame:
    """(code, total_freq, doc_freq) of the words of ``bags`` (words, counts).

    Every task adds occurrences and presences into count arrays for ranges of 2^``range_bits`` codes,
    only for ranges it meets, and hands on the slots that are not 0; the arrays of a range are then
    summed, streaming, where that range belongs.  A hot word costs one slot per task.
    """
    width = 1 << range_bits
    shape = "block bigint, slots array<int>, occ array<bigint>, pres array<bigint>"
    names = ["block", "slots", "occ", "pres"]

    def arrays(held):
        rows = [(b, np.nonzero(c)[0], o, c) for b, (o, c) in held.items()]
        per = np.array([len(s) for _, s, _, _ in rows], np.int64)
        flat = [np.concatenate(x) if rows else np.zeros(0, np.int64) for x in ([s for _, s, _, _ in rows], [o[s] for _, s, o, _ in rows], [c[s] for _, s, _, c in rows])]
        return pa.RecordBatch.from_arrays([pa.array([b for b, *_ in rows], pa.int64()), *lists(per, flat[0].astype(np.int32), flat[1], flat[2])], names=names)

    def count(batches):
        held = {}
        for b in batches:
            code = b.column("words").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n = b.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            blocks = code >> range_bits
            if not len(code):
                continue
            # a batch is summed over the span of codes it meets, then cut into ranges
            low, high = int(blocks.min()), int(blocks.max())
            if high - low <= 1024:
                size = (high - low + 1) * width
                at = code - low * width
                pres = np.bincount(at, minlength=size)
                occ = np.bincount(at, n, size).astype(np.int64)
                met = [(low + int(i), occ[i * width : (i + 1) * width], pres[i * width : (i + 1) * width]) for i in np.unique(blocks) - low]
            else:
                order = np.argsort(blocks, kind="stable")
                edges = np.nonzero(np.r_[True, np.diff(blocks[order]) != 0])[0]
                met = []
                for lo, hi in zip(edges, [*edges[1:], len(code)]):
                    o = order[lo:hi]
                    slot = code[o] & (width - 1)
                    met.append((int(blocks[o[0]]), np.bincount(slot, n[o], width).astype(np.int64), np.bincount(slot, minlength=width)))
            for block, occ, pres in met:
                if block in held:
                    held[block][0][:] += occ
                    held[block][1][:] += pres
                else:
                    held[block] = (occ.copy(), pres.copy())
            if len(held) >= 1024:
                yield arrays(held)
                held = {}
        if held:
            yield arrays(held)

    def add(batches):
        held = {}
        for b in batches:
            slots, per = spans(b.column("slots"))
            slots, occ, pres = (x.to_numpy(zero_copy_only=False) for x in (slots, b.column("occ").flatten(), b.column("pres").flatten()))
            end = np.cumsum(per)
            for i, block in enumerate(b.column("block").to_pylist()):
                a, c = held.setdefault(block, (np.zeros(width, np.int64), np.zeros(width, np.int64)))
                s = slice(end[i] - per[i], end[i])
                a[slots[s]] += occ[s]
                c[slots[s]] += pres[s]
        for block, (a, c) in held.items():
            at = np.nonzero(c)[0]
            yield pa.RecordBatch.from_arrays([pa.array(block * width + at), pa.array(a[at]), pa.array(c[at])], names=["code", "total_freq", "doc_freq"])

    return bags.select("words", "counts").mapInArrow(count, shape).repartition("block").mapInArrow(add, "code bigint, total_freq bigint, doc_freq bigint")
