"""Rounds over partitioned documents: every round is one Spark job.

Documents stay where they are; what all tasks read is broadcast; each task hands back its documents' new
state and one vector of sums.  The sums travel in slices and are added slice by slice in the cluster, so the
driver receives one vector and not one per task.  The state is written to the shared folder, and the one
before it is deleted.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut, drop

#: Numbers in a slice of the sums.
SLICE = 1 << 16


def bags(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells per document, words, counts) of a batch's bags, packed (``packed_bags``) or arrays of (w, n)."""
    bag = batch.column("bag")
    if pa.types.is_binary(bag.type):
        at = np.frombuffer(bag.buffers()[1], np.int32)[bag.offset : bag.offset + len(bag) + 1] if len(bag) else np.zeros(1, np.int32)
        raw = np.frombuffer(bag.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        cells = np.frombuffer(raw.tobytes(), np.int32).reshape(-1, 2)
        return pc.binary_length(bag).to_numpy(zero_copy_only=False).astype(np.int64) // 8, np.ascontiguousarray(cells[:, 0]), cells[:, 1].astype(np.int64)
    flat = bag.flatten()
    return np.diff(bag.offsets.to_numpy()), flat.field("w").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)


def packed(rows: np.ndarray, per: np.ndarray) -> pa.Array:
    """Rows of one type as one binary a document, ``per`` rows each."""
    raw, width = np.ascontiguousarray(rows).tobytes(), rows.dtype.itemsize * int(np.prod(rows.shape[1:]))
    ends = np.r_[0, np.cumsum(per)].astype(np.int64) * width
    if ends[-1] < 2**31 - 1:
        return pa.Array.from_buffers(pa.binary(), len(per), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw)])
    return pa.array([raw[a:b] for a, b in zip(ends, ends[1:])], pa.binary())


def packed_bags(w: np.ndarray, n: np.ndarray, per: np.ndarray) -> pa.Array:
    """Bags of (word, count) cells as one binary a document, eight bytes a cell."""
    return packed(np.stack([w, n], 1).astype(np.int32), per)


def packed_tokens(z: np.ndarray, tokens: np.ndarray, states: int) -> pa.Array:
    """The states of all tokens, in order of their cells, as one binary a document; ``tokens`` are a document's."""
    return packed(z.astype(np.uint8 if states <= 256 else np.int32), tokens)


def unpacked_tokens(column, states: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8 if states <= 256 else np.int32).astype(np.int64)


def token_counts(z: np.ndarray, n: np.ndarray, states: int) -> np.ndarray:
    """(cells, states): how many of a cell's tokens are in each state."""
    return np.bincount(np.repeat(np.arange(len(n)), n) * states + z, minlength=len(n) * states).reshape(-1, states).astype(float)


def by_doc(rows: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Sums of the rows of every document, which stand together."""
    out = np.zeros((len(per), *rows.shape[1:]))
    if len(rows):
        out[per > 0] = np.add.reduceat(rows, (np.cumsum(per) - per)[per > 0], axis=0)
    return out


def by_word(w: np.ndarray, rows: np.ndarray, v: int) -> np.ndarray:
    """(columns of rows, v): sums of the rows of every word."""
    return np.stack([np.bincount(w, c, v) for c in rows.T])


def matrix_of(column, width: int) -> np.ndarray:
    """An Arrow list<double> column of equal lengths as (rows, width)."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).copy()


def listed(rows: np.ndarray) -> pa.Array:
    """(rows, width) as an Arrow list<double> column."""
    at = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
    return pa.ListArray.from_arrays(at, pa.array(np.ascontiguousarray(rows, float).ravel()))


def packed_cells(rows: np.ndarray, per: np.ndarray) -> pa.Array:
    """float32 rows of cells as one binary a document."""
    return packed(rows.astype(np.float32), per)


def unpacked_cells(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, width).astype(float)


def ranked(per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, longest first; how many of them have a token of rank 0, 1, ...)."""
    order = np.argsort(-per, kind="stable")
    return order, np.searchsorted(-per[order], -np.arange(int(per.max(initial=0))), side="left")


def within(left: np.ndarray) -> np.ndarray:
    """Every token's place among those of its rank, so that of its document in the order of ``ranked``."""
    return np.arange(int(left.sum())) - np.repeat(np.cumsum(left) - left, left)


def by_rank(per: np.ndarray) -> np.ndarray:
    """Places of the tokens of documents in the order in which they are redrawn: the first ones of all documents, then the second ones."""
    order, left = ranked(per)
    first = (np.cumsum(per) - per)[order]
    return np.concatenate([first[:m] + j for j, m in enumerate(left)]) if len(left) else np.zeros(0, int)


BLOCK = "ids binary, per binary, w binary"


def blocks_of(docs: DataFrame, v: int) -> DataFrame:
    """(doc_id, ids, per, w): the documents of an Arrow batch as one row, keyed by the first of them.

    ``per`` are their numbers of tokens, ``w`` the words of the tokens in the order of ``by_rank``.
    """
    kind = np.uint16 if v <= 1 << 16 else np.int32

    def run(batches):
        for b in batches:
            if b.num_rows:
                cells, w, n = bags(b)
                per, sink = by_doc(n, cells).astype(np.int64), pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, pa.schema([b.schema.field("doc_id")])) as out:
                    out.write_batch(b.select(["doc_id"]))
                blobs = [sink.getvalue().to_pybytes(), per.astype(np.int32).tobytes(), np.repeat(w, n)[by_rank(per)].astype(kind).tobytes()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(0, 1), *(pa.array([x], pa.binary()) for x in blobs)], names=["doc_id", "ids", "per", "w"])

    return cut(docs.select("doc_id", "bag").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {BLOCK}"))


def block_rows(batch, v: int):
    """(row, tokens per document, words) of every block of a batch."""
    kind = np.uint16 if v <= 1 << 16 else np.int32
    for i in range(batch.num_rows):
        yield i, np.frombuffer(batch.column("per")[i].as_buffer(), np.int32).astype(np.int64), np.frombuffer(batch.column("w")[i].as_buffer(), kind)


def block_ids(batch, row: int):
    """The doc_id column of a block's documents."""
    return pa.ipc.open_stream(batch.column("ids")[row].as_buffer()).read_next_batch().column(0)


def opened(state: DataFrame, v: int, states: int) -> DataFrame:
    """(doc_id, bag, g, size) of documents from blocks with the tokens' states ``g`` and, where they were summed, ``size``."""

    def run(batches):
        for b in batches:
            for i, per, word in block_rows(b, v):
                place, z, w = by_rank(per), np.empty(len(word), np.int64), np.empty(len(word), np.int64)
                z[place], w[place] = np.frombuffer(b.column("g")[i].as_buffer(), np.uint8 if states <= 256 else np.int32), word
                doc = np.repeat(np.arange(len(per)), per)
                starts = np.nonzero(np.r_[True, (np.diff(doc) != 0) | (np.diff(w) != 0)])[0] if len(w) else np.zeros(0, int)
                size = np.frombuffer(b.column("size")[i].as_buffer(), float).reshape(-1, states)
                size = size if len(size) else np.bincount(doc * states + z, minlength=len(per) * states).reshape(-1, states)
                bag = packed_bags(w[starts], np.diff(np.r_[starts, len(w)]), np.bincount(doc[starts], minlength=len(per)))
                yield pa.RecordBatch.from_arrays([block_ids(b, i), bag, packed_tokens(z, per, states), listed(size)], names=["doc_id", "bag", "g", "size"])

    return state.select("doc_id", "ids", "per", "w", "g", "size").mapInArrow(run, f"doc_id {dict(state.dtypes)['doc_id']}, bag binary, g binary, size array<double>")


def _added(parts: Iterator) -> Iterator:
    """Sums of the slices of a partition, in the order of the tasks that sent them."""
    rows = [(r["slice"], r["part"], r["sums"]) for b in parts for r in b.to_pylist()]
    out: dict[int, np.ndarray] = {}
    for at, _, blob in sorted(rows, key=lambda r: r[:2]):
        x = np.frombuffer(blob)
        out[at] = x + out[at] if at in out else x
    yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([x.tobytes() for x in out.values()], pa.binary())], names=["slice", "sums"])


def summed(rows: DataFrame, length: int) -> np.ndarray:
    """The sum of the vectors that tasks sent as rows (slice, part, sums)."""
    total = np.zeros(length)
    for r in rows.repartition("slice").mapInArrow(_added, "slice int, sums binary").collect():
        total[r["slice"] * SLICE : r["slice"] * SLICE + len(r["sums"]) // 8] = np.frombuffer(r["sums"])
    return total


def sliced(total: np.ndarray, part: int):
    for lo in range(0, len(total), SLICE):
        yield lo // SLICE, part, total[lo : lo + SLICE].tobytes()


def slice_columns(rows: list) -> list[pa.Array]:
    return [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())]


def sums_over(state: DataFrame, columns: list[str], kernel: Callable, length: int) -> np.ndarray:
    """Sum over all documents of ``kernel(batch)``, a vector a batch."""

    def run(batches):
        total, part = np.zeros(length), 0
        for b in batches:
            if b.num_rows:
                part = part or zlib.crc32(str(b.column(0)[0].as_py()).encode())
                total += kernel(b)
        rows = list(sliced(total, part))
        yield pa.RecordBatch.from_arrays(slice_columns(rows), names=["slice", "part", "sums"])

    return summed(state.select(*columns).mapInArrow(run, "slice int, part bigint, sums binary"), length)


class Rounds:
    """``state`` (doc_id, bag, ...) and its rounds.  ``kernel(batch, shared, rng, sums)`` returns {column: Arrow array} and adds to ``sums``.

    Columns it does not return stay as they are.  ``kinds`` gives the SQL types of the columns it returns.
    ``rng`` depends on seed, round and the first document of the partition.
    """

    def __init__(self, state: DataFrame, kinds: dict[str, str], seed: int):
        self.state, self.kinds, self.seed, self.round, self._last = state, kinds, seed, 0, None

    def step(self, kernel: Callable, shared, length: int) -> np.ndarray:
        spark, seed, at, kinds = self.state.sparkSession, self.seed, self.round, self.kinds
        held = spark.sparkContext.broadcast(shared)
        old = dict(self.state.dtypes)
        columns = [c for c in old if c not in kinds] + list(kinds)

        def run(batches):
            total, rng, part, types = np.zeros(length), None, 0, None
            values = dict(held.value)  # a task may keep its own view in it
            for b in batches:
                if not b.num_rows:
                    continue
                if rng is None:
                    part = zlib.crc32(str(b.column("doc_id")[0].as_py()).encode())
                    rng = np.random.default_rng([seed, at, part])
                new = kernel(b, values, rng, total)
                cols = [new[c] if c in new else b.column(c) for c in columns]
                types = [c.type for c in cols]
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names=[*columns, "slice", "part", "sums"])
            if types is not None:
                rows = list(sliced(total, part))
                n = len(rows)
                yield pa.RecordBatch.from_arrays([*(pa.nulls(n, t) for t in types), *slice_columns(rows)], names=[*columns, "slice", "part", "sums"])

        shape = ", ".join(f"{c} {kinds.get(c, old.get(c))}" for c in columns)
        out = cut(self.state.mapInArrow(run, f"{shape}, slice int, part bigint, sums binary"))
        total = summed(out.filter("slice is not null").select("slice", "part", "sums"), length)
        held.unpersist()
        if self._last is not None:
            drop(self._last)
        self.state, self._last = out.filter("slice is null").drop("slice", "part", "sums"), out
        self.round += 1
        return total
