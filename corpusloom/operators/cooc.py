"""Co-occurrence of chosen words in documents or sliding windows, and coherence scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut, small
from .text import repeated

EPSILON = 1e-12


def _starts(docs: DataFrame, words: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, term, s): window starts that see the term, and the number of windows.

    A window of w words over L tokens starts at 0 .. max(0, L - w); window 0 is the document.
    """
    d = docs.filter(F.size("tokens") > 0)
    last = F.lit(0) if window == 0 else F.greatest(F.size("tokens") - window, F.lit(0))
    pos = d.select("doc_id", last.alias("last"), F.posexplode("tokens").alias("pos", "term")).join(small(words)[0], "term")
    lo = F.lit(0) if window == 0 else F.greatest(F.col("pos") - (window - 1), F.lit(0))
    hi = F.least(F.col("pos"), F.col("last"))
    lo = F.least(lo, hi)
    seen = pos.select("doc_id", "term", F.explode(F.sequence(lo, hi)).alias("s")).distinct()
    seen = cut(seen)
    return seen, d.agg(F.sum(last + 1).alias("windows"))


def _covered(doc, lo, hi) -> int:
    """Window starts in the intervals lo .. hi, which rise within a document."""
    after = np.where(doc[1:] == doc[:-1], hi[:-1] + 1, 0)
    return int(np.maximum(hi - np.maximum(lo, np.r_[0, after]) + 1, 0).sum()) if len(doc) else 0


def _window_counts(docs: DataFrame, words: list[str], need: list[tuple[str, str]], window: int) -> DataFrame:
    """(a, b, n): windows that see a (b null), a and b, and all windows (both null), one row of ``docs`` a document.

    A word's positions give intervals of window starts; of two words the starts in both are those of the one and
    of the other less those of either.  Only sums leave a batch.
    """
    at = {w: i for i, w in enumerate(words)}
    pairs = [(at[a], at[b]) for a, b in need]
    known = pa.array(words, pa.string())
    names = [*((w, None) for w in words), *need, (None, None)]

    def run(batches):
        total = np.zeros(len(names), np.int64)
        for batch in batches:
            lists = batch.column("tokens")
            per = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            last = np.zeros(len(per), np.int64) if window == 0 else np.maximum(per - window, 0)
            total[-1] += int((last + 1)[per > 0].sum())
            code = pc.index_in(lists.flatten(), known).fill_null(-1).to_numpy(zero_copy_only=False)
            hit = np.nonzero(code >= 0)[0]
            doc = np.repeat(np.arange(len(per)), per)[hit]
            pos, code = hit - (np.cumsum(per) - per)[doc], code[hit]
            hi = np.minimum(pos, last[doc])
            lo = np.zeros_like(hi) if window == 0 else np.minimum(np.maximum(pos - (window - 1), 0), hi)
            order = np.argsort(code, kind="stable")
            ends = np.cumsum(np.bincount(code, minlength=len(words)))
            of = [order[e - n : e] for e, n in zip(ends, np.diff(np.r_[0, ends]))]
            occ = [_covered(doc[i], lo[i], hi[i]) for i in of]
            total[: len(words)] += occ
            for j, (a, b) in enumerate(pairs, len(words)):
                if occ[a] and occ[b]:
                    i = np.sort(np.concatenate([of[a], of[b]]), kind="stable")  # two runs, which are merged
                    total[j] += occ[a] + occ[b] - _covered(doc[i], lo[i], hi[i])
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in names], pa.string()), pa.array([b for _, b in names], pa.string()), pa.array(total)], names=["a", "b", "n"])

    return docs.select("tokens").mapInArrow(run, "a string, b string, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))


def cooccurrence(docs: DataFrame, topics: DataFrame, window: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Window counts of the words of ``topics`` (topic, place, term) and of the pairs within a topic.

    Returns (term, occ), (a, b, co) with a < b, and (windows).  ``topics`` is a top-word list and is
    broadcast: a few words per topic.  Window starts are listed and joined only where an id stands in several rows.
    """
    words = topics.select("term").distinct()
    x, y = topics.alias("x"), topics.alias("y")
    need = x.join(y, (F.col("x.topic") == F.col("y.topic")) & (F.col("x.term") < F.col("y.term"))).select(F.col("x.term").alias("a"), F.col("y.term").alias("b")).distinct()
    if not repeated(docs):
        chosen = sorted(r["term"] for r in words.filter("term is not null").collect())
        got = cut(_window_counts(docs, chosen, sorted((r["a"], r["b"]) for r in need.collect()), window))
        occ = got.filter("a is not null and b is null and n > 0").select(F.col("a").alias("term"), F.col("n").alias("occ"))
        return occ, got.filter("b is not null and n > 0").select("a", "b", F.col("n").alias("co")), got.filter("a is null").agg(F.sum("n").alias("windows"))
    seen, windows = _starts(docs, words, window)
    occ = seen.groupBy("term").agg(F.count(F.lit(1)).alias("occ"))
    left = seen.withColumnRenamed("term", "a").join(small(need)[0], "a")
    pairs = left.join(seen.withColumnRenamed("term", "b"), ["doc_id", "s", "b"])
    return occ, pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("co")), windows


def coherence(docs: DataFrame, topics: DataFrame, kind: str = "u_mass", window: int | None = None) -> DataFrame:
    """(topic, coherence): c_v, u_mass, c_uci or c_npmi of each topic's top words.

    c_v (windows of 110) takes the NPMI of every two words of a topic, 1 on the diagonal, and is the mean
    cosine of the rows of that matrix to the sum of its rows.  u_mass is the mean over i > j of ln((co + 1) / occ_j), pairs with occ_j = 0 left out; the other
    two are means over pairs with probabilities by window (default 10).  Topics of fewer than two
    known words get NULL under u_mass.
    """
    if kind not in ("u_mass", "c_uci", "c_npmi", "c_v"):
        raise ValueError(f"unknown coherence {kind!r}")
    if window is None:
        window = {"u_mass": 0, "c_v": 110}.get(kind, 10)
    occ, co, windows = cooccurrence(docs, topics, 0 if kind == "u_mass" else window)
    x, y = topics.alias("x"), topics.alias("y")
    p = x.join(y, (F.col("x.topic") == F.col("y.topic")) & (F.col("x.place") > F.col("y.place"))).select(F.col("x.topic").alias("topic"), F.col("x.term").alias("wi"), F.col("y.term").alias("wj"))
    p = p.withColumn("a", F.least("wi", "wj")).withColumn("b", F.greatest("wi", "wj")).join(co, ["a", "b"], "left").fillna(0, ["co"])
    p = p.join(occ.select(F.col("term").alias("wi"), F.col("occ").alias("oi")), "wi", "left").join(occ.select(F.col("term").alias("wj"), F.col("occ").alias("oj")), "wj", "left").fillna(0, ["oi", "oj"])
    if kind == "u_mass":
        score = F.when(F.col("oj") > 0, F.log((F.col("co") + 1) / F.col("oj")))
        return p.groupBy("topic").agg(F.avg(score).alias("coherence"))
    p = p.crossJoin(F.broadcast(windows))
    pij, pi, pj = (F.col(c) / F.col("windows") for c in ("co", "oi", "oj"))
    if kind == "c_uci":
        score = F.log((pij + EPSILON) / (F.greatest(pi, F.lit(EPSILON)) * F.greatest(pj, F.lit(EPSILON))))
    else:
        q = F.when(pij <= 0, F.lit(EPSILON)).otherwise(pij)
        score = F.when(pij >= 1, F.lit(1.0)).otherwise(F.log(q / (F.greatest(pi, F.lit(EPSILON)) * F.greatest(pj, F.lit(EPSILON)))) / -F.log(q))
    if kind == "c_v":
        return _indirect(p.select("topic", "wi", "wj", score.alias("v")), topics)
    return p.groupBy("topic").agg(F.avg(score).alias("coherence"))


def _indirect(pairs: DataFrame, topics: DataFrame) -> DataFrame:
    """Mean cosine of the rows of a symmetric matrix (topic, wi, wj, v) with unit diagonal to the sum of its rows."""
    whole = cut(
        pairs.unionByName(pairs.select("topic", F.col("wj").alias("wi"), F.col("wi").alias("wj"), "v"))
        .unionByName(topics.select("topic", F.col("term").alias("wi"), F.col("term").alias("wj"), F.lit(1.0).alias("v")))
    )
    total = whole.groupBy("topic", "wj").agg(F.sum("v").alias("s"))
    size = total.groupBy("topic").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("size"), F.count(F.lit(1)).alias("n"))
    rows = whole.join(total, ["topic", "wj"]).groupBy("topic", "wi").agg(F.sum(F.col("v") * F.col("s")).alias("d"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("r"))
    x = rows.join(size, "topic")
    cos = F.when((F.col("r") > 0) & (F.col("size") > 0), F.col("d") / (F.col("r") * F.col("size"))).otherwise(F.lit(0.0))
    return x.groupBy("topic").agg(F.when(F.max("n") >= 2, F.avg(cos)).alias("coherence"))


def pair_moments(bow: DataFrame) -> DataFrame:
    """(a, b, q): second moments of words, sum over documents of (c_a c_b - [a = b] c_a) / (n (n - 1)), over the documents used.

    Documents of fewer than two tokens are left out.  ``bow`` (doc_id, term, cnt) should be pruned: every pair of
    words that share a document gives a row, which is what the moments are.
    """
    size = bow.groupBy("doc_id").agg(F.sum("cnt").alias("n")).filter("n > 1")
    x = bow.join(size, "doc_id")
    used = F.broadcast(size.agg(F.count(F.lit(1)).cast("double").alias("used")))
    a = x.select("doc_id", "n", F.col("term").alias("a"), F.col("cnt").alias("ca"))
    b = x.select("doc_id", F.col("term").alias("b"), F.col("cnt").alias("cb"))
    own = F.when(F.col("a") == F.col("b"), F.col("ca")).otherwise(F.lit(0))
    part = (F.col("ca") * F.col("cb") - own) / (F.col("n") * (F.col("n") - 1)).cast("double")
    q = a.join(b, "doc_id").groupBy("a", "b").agg(F.sum(part).alias("q")).crossJoin(used)
    return q.select("a", "b", (F.col("q") / F.col("used")).alias("q"))
