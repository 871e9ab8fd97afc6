"""Top N items within every group, by a split into hot and cold groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.session import cut
from ..operators.rows import latest_rows


def top_items(scores: DataFrame, groups: list[str], item: str, score: str, stamp: str | None = None, n: int = 10, hot_rows: int = 20_000, most_hot: int = 1000) -> DataFrame:
    """(groups, item, score, place): the ``n`` items of highest score of every group.

    ``place`` 1 is the highest; of equal scores the smaller item goes first.  With ``stamp`` the
    row written last counts for each group and item (of equal stamps the greater score).  Items
    whose score is then null or NaN are not ranked; rows with a null group or item are left out.
    Without ``stamp`` a repeated item keeps its greatest score.  -0.0 equals 0.0.  Empty tables give
    no rows; other columns are ignored.

    Method.  Exact group counts name the hot groups, those of more than ``hot_rows`` rows and of
    more than a ``most_hot``-th of all rows, hence at most ``most_hot`` groups.  Hot groups are
    range-sorted by (group, score descending, item), so that a group spreads over as many
    partitions as it needs; each partition hands on the first ``n`` rows of each group it holds.
    Cold groups go through an ordinary window, and so do the few rows the hot ones leave.
    """
    s = scores.select(*groups, item, F.col(score).cast("double").alias(score), *([stamp] if stamp else []))
    if stamp:
        s = latest_rows(s, [*groups, item], stamp, [score])
    else:
        for c in [*groups, item]:
            s = s.filter(F.col(c).isNotNull())
    s = s.filter(F.col(score).isNotNull() & ~F.isnan(score)).withColumn(score, F.col(score) + F.lit(0.0))
    if not stamp:
        s = s.groupBy(*groups, item).agg(F.max(score).alias(score))
    s = cut(s)
    sizes = s.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    total = s.count()
    hot = sizes.filter(F.col("_n") > max(hot_rows, total // most_hot)).select(*groups)
    hot = F.broadcast(cut(hot))
    order = [F.col(score).desc(), F.col(item)]
    cold = s.join(hot, groups, "left_anti")
    heavy = s.join(hot, groups, "left_semi").repartitionByRange(*groups, F.col(score).desc(), F.col(item)).sortWithinPartitions(*groups, *order)

    def heads(batches):
        last, seen = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(g) for g in groups]
            new = np.zeros(b.num_rows, bool)
            new[0] = True
            for c in cols:
                code = c.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            start = np.nonzero(new)[0]
            place = np.arange(b.num_rows) - start[np.cumsum(new) - 1]
            first = tuple(c[0].as_py() for c in cols)
            if first == last:
                run = start[1] if len(start) > 1 else b.num_rows
                place[:run] += seen
            last = tuple(c[-1].as_py() for c in cols)
            seen = int(place[-1]) + 1
            yield b.filter(pa.array(place < n))

    few = heavy.mapInArrow(heads, s.schema)
    w = W.partitionBy(*groups).orderBy(*order)
    rank = lambda df: df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
    return rank(cold).unionByName(rank(few)).select(*groups, item, score, "place")
