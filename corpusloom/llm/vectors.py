"""What the vector operators share: usable vectors, cells of similar vectors, Arrow helpers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, dims: int, vec: str = "vec") -> DataFrame:
    """(key BIGINT, vec ARRAY<FLOAT>): rows whose vector has ``dims`` finite components, not all zero.

    Rows with a null key are left out.  Repeated rows stay repeated.
    """
    v = F.col(vec)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return (
        df.select(F.col(key).cast("bigint").alias("key"), v.cast("array<float>").alias("vec"))
        .filter(F.col("key").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") == dims))
        .filter(F.coalesce(fine, F.lit(False)))
    )


def matrix(column, dims: int) -> np.ndarray:
    """Rows of an Arrow list<float> or binary column as float32 (n, dims)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], column.type)
    if not len(column):
        return np.zeros((0, dims), np.float32)
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
        at = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1]
        return np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.float32).reshape(len(column), dims)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), dims)


def packed(x: np.ndarray) -> pa.Array:
    """float32 rows as an Arrow binary column."""
    x = np.ascontiguousarray(x, np.float32)
    at = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * 4)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(x.tobytes())])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one.

    Each row is divided by its largest component first, so no square over- or underflows.
    """
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0.0)
    return (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision of the raw vectors."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    a = a / np.abs(a).max(axis=1, keepdims=True, initial=0.0)
    b = b / np.abs(b).max(axis=1, keepdims=True, initial=0.0)
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def sample_centres(x: np.ndarray, count: int, seed: int = 11, rounds: int = 8) -> np.ndarray:
    """Unit centres of a spherical k-means on the rows of ``x`` (a bounded sample)."""
    x = unit(x) if len(x) else x
    count = max(1, min(count, len(x)))
    rng = np.random.default_rng(seed)
    if not len(x):
        return np.zeros((1, x.shape[1] if x.ndim == 2 else 1), np.float32)
    centres = x[rng.choice(len(x), count, replace=False)].copy()
    for _ in range(rounds if count > 1 else 1):
        near = (x @ centres.T).argmax(1)
        order = np.argsort(near, kind="stable")
        edges = np.searchsorted(near[order], np.arange(count + 1))
        for j in range(count):
            if edges[j] < edges[j + 1]:
                c = x[order[edges[j] : edges[j + 1]]].sum(0)
                size = np.linalg.norm(c)
                if size > 0:
                    centres[j] = c / size
    return centres.astype(np.float32)
