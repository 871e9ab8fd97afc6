"""Mixing sources to target weights by a proportionate-fair block schedule."""

import base64
import heapq
import importlib.util
from collections.abc import Iterator
from fractions import Fraction
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.session import cut

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def source_name(column):
    """A source without outer blanks, in lower case."""
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of ``docs`` with ``tokens``, the size of the text in tokens of a public tokenizer.

    ``vocabulary`` is a rank file; the split pattern comes with the tokenizers' package.  Null and
    empty texts have 0 tokens.  Texts are tokenized whole.
    """

    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        spec = importlib.util.spec_from_file_location("_public_tokenizers", Path(vocabulary).resolve().parent / "__init__.py")
        package = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(package)
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        coder = tiktoken.Encoding("mix", pat_str=package.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for part in texts:
            yield pd.Series([len(coder.encode_ordinary(t)) if t else 0 for t in part], dtype="int64")

    return docs.withColumn("tokens", F.pandas_udf(count, "bigint")(F.col(text)))


def mix_plan(docs: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per target source: what the mix wants of it and what it can give.

    Columns: source, docs, tokens (used once), target_share, max_repeats, wanted (tokens),
    available (tokens x max_repeats), drawn, repeats, share (of the tokens drawn), short.

    The mix is as large as all documents of the listed sources, used once.  A source that would
    need more than ``max_repeats`` uses of its documents is drawn as often as allowed and is
    ``short``; the others are drawn to their wanted size, so a shortfall is reported and not
    hidden by another source.  Names are compared without outer blanks and in lower case; documents
    of null or unlisted sources take no part; listed sources without documents have 0 tokens.  A
    null share or max_repeats counts as 0; of several rows of a source the greatest counts.
    Null and blank texts have 0 tokens.  Empty targets give no rows.
    """
    t = wanted_shares(targets)
    return _plan(t, _sized(docs, t, None, vocabulary))


def wanted_shares(targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats), one row per name."""
    return (
        targets.select(source_name(F.col("source")).alias("source"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(0)).alias("max_repeats"))
        .filter("source is not null")
        .groupBy("source")
        .agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )


def _sized(docs: DataFrame, targets: DataFrame, key: str | None, vocabulary: str) -> DataFrame:
    """(source, doc_id, tokens) of the documents of listed sources; without ``key`` doc_id is null."""
    doc_id = F.lit(None).cast("bigint") if key is None else F.col(key).cast("bigint")
    listed = docs.select(source_name(F.col("source")).alias("source"), doc_id.alias("doc_id"), "text").join(targets.select("source"), "source", "left_semi")
    return token_counts(listed, "text", vocabulary).select("source", "doc_id", "tokens")


def _plan(t: DataFrame, sized: DataFrame) -> DataFrame:
    sizes = sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    both = t.join(sizes, "source", "left").fillna(0, ["docs", "tokens"])
    total = F.sum("tokens").over(W.partitionBy(F.lit(0)))
    # one row per target source: a window over the targets, not over documents
    return (
        both.withColumn("wanted", F.col("target_share") * total)
        .withColumn("available", F.col("tokens") * F.col("max_repeats"))
        .withColumn("drawn", F.least(F.col("wanted"), F.col("available").cast("double")))
        .withColumn("repeats", F.when(F.col("tokens") > 0, F.ceil(F.col("drawn") / F.col("tokens"))).otherwise(F.lit(0)))
        .withColumn("share", F.col("drawn") / F.nullif(F.sum("drawn").over(W.partitionBy(F.lit(0))), F.lit(0.0)))
        .withColumn("short", F.col("available") < F.col("wanted"))
        .select("source", "docs", "tokens", "target_share", "max_repeats", "wanted", "available", "drawn", "repeats", "share", "short")
    )


def pfair(weights: dict[str, Fraction], blocks: dict[str, int]) -> list[str]:
    """Slots of a proportionate-fair schedule: which source gives its next block in each slot.

    Block k of a source of weight w is released at floor(k / w) and due at ceil((k + 1) / w).  Of the
    released blocks the one due first takes the slot (ties by name).  While weights add up to at
    most 1 no source is ever a block or more away from its share.
    """
    waiting, ready, out = [], [], []
    for s, w in weights.items():
        if w > 0 and blocks.get(s, 0) > 0:
            waiting.append((0, s, 0))
    heapq.heapify(waiting)
    slot, left = 0, sum(blocks[s] for _, s, _ in waiting)
    while left:
        if not ready and waiting and waiting[0][0] > slot:
            slot = waiting[0][0]
        while waiting and waiting[0][0] <= slot:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-((-(k + 1)) // weights[s]), s, k))
        _, s, k = heapq.heappop(ready)
        out.append(s)
        left -= 1
        slot += 1
        if k + 1 < blocks[s]:
            heapq.heappush(waiting, ((k + 1) // weights[s], s, k + 1))
    return out


def mix_sources(docs: DataFrame, targets: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY, max_blocks: int = 20_000, seed: int = 3) -> DataFrame:
    """The mix itself: (source, doc_id, use, tokens, slot), to be read in the order of slot, source, use.

    Every source is laid out use after use, each use in its own hashed order, and cut into blocks of
    equal tokens, at most ``max_blocks`` in all; a proportionate-fair schedule (``pfair``) gives
    each block its slot, so that every prefix of the mix keeps the shares to less than one block.
    Where a source falls short the schedule goes by the shares it can reach.  Running sums are taken
    in two steps, over hash ranges and within them, so that no source is summed in one task.  The
    rules for nulls and names are those of ``mix_plan``.
    """
    t = wanted_shares(targets)
    # texts are tokenized once: for the plan and for the layout
    sized = cut(_sized(docs, t, key, vocabulary))
    return _lay(sized, _plan(t, sized).collect(), max_blocks, seed)


def mix_report(docs: DataFrame, targets: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY, max_blocks: int = 20_000, seed: int = 3) -> DataFrame:
    """What the scheduled mix holds: one row per target source.

    Columns: source, wanted (tokens), reached (tokens of the schedule), uses (greatest number of uses
    of a document), share (of all tokens drawn), short (reached < wanted).  Rules as in ``mix_plan``.
    """
    t = wanted_shares(targets)
    sized = cut(_sized(docs, t, key, vocabulary))
    plan = cut(_plan(t, sized))
    mix = _lay(sized, plan.collect(), max_blocks, seed).groupBy("source").agg(F.sum("tokens").alias("reached"), F.max("use").alias("uses"))
    both = plan.select("source", "wanted").join(mix, "source", "left").fillna(0, ["reached", "uses"])
    share = F.col("reached") / F.nullif(F.sum("reached").over(W.partitionBy(F.lit(0))), F.lit(0))
    return both.select("source", "wanted", "reached", "uses", share.alias("share"), (F.col("reached") < F.col("wanted")).alias("short"))


def _lay(sized: DataFrame, plan: list, max_blocks: int, seed: int) -> DataFrame:
    spark = sized.sparkSession
    spark_plan = [r for r in plan if r["tokens"] and r["drawn"] > 0]
    drawn = sum(r["drawn"] for r in spark_plan)
    block = max(1.0, drawn / max(1, max_blocks - len(spark_plan)))
    shape = "source string, use int, doc_key bigint, doc_id bigint, tokens bigint, slot bigint"
    if not spark_plan:
        return spark.createDataFrame([], shape).select("source", "doc_id", "use", "tokens", "slot")
    blocks = {r["source"]: max(1, int(np.ceil(r["drawn"] / block))) for r in spark_plan}
    whole = sum(blocks.values())
    slots: dict[str, list[int]] = {s: [] for s in blocks}
    for i, s in enumerate(pfair({s: Fraction(b, whole) for s, b in blocks.items()}, blocks)):
        slots[s].append(i)
    held = spark.sparkContext.broadcast(({s: np.array(v) for s, v in slots.items()}, block))
    uses = spark.createDataFrame([(r["source"], int(r["repeats"]), float(r["drawn"])) for r in spark_plan], "source string, repeats int, drawn double")
    # one row per target source that is drawn; the plan holds them already
    sized = sized.filter("tokens > 0")
    laid = sized.join(F.broadcast(uses), "source").withColumn("use", F.explode(F.sequence(F.lit(1), "repeats"))).withColumn("h", F.xxhash64("doc_id", "use", F.lit(seed)))
    laid = cut(laid.withColumn("range", F.shiftright("h", 52)))
    sums = laid.groupBy("source", "use", "range").agg(F.sum("tokens").alias("t"))
    before = sums.withColumn("base", F.coalesce(F.sum("t").over(W.partitionBy("source").orderBy("use", "range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = W.partitionBy("source", "use", "range").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    at = laid.join(before.drop("t"), ["source", "use", "range"]).withColumn("start", F.col("base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))).filter(F.col("start") < F.col("drawn"))

    def place(batches):
        slots, block = held.value
        for b in batches:
            src = b.column("source").to_numpy(zero_copy_only=False)
            k = (b.column("start").to_numpy() / block).astype(np.int64)
            out = np.zeros(len(k), np.int64)
            for s in set(src):
                m = src == s
                out[m] = slots[s][np.minimum(k[m], len(slots[s]) - 1)]
            yield pa.RecordBatch.from_arrays([b.column("source"), b.column("doc_id"), b.column("use"), b.column("tokens"), pa.array(out)], names=["source", "doc_id", "use", "tokens", "slot"])

    return at.select("source", "doc_id", "use", "tokens", "start").mapInArrow(place, "source string, doc_id bigint, use int, tokens bigint, slot bigint")
