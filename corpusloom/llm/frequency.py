"""Total and document frequency of every word, and marks for the too rare and too common."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut
from ..operators.rows import canonical_vocab
from .bags import LOOKUP, block_sums, encoded_bags


def dense_ids(df: DataFrame, column: str, name: str) -> DataFrame:
    """The distinct non-null values of ``column`` with dense integers from 0, in order of the value.

    The sorted values are written once to the shared folder; only one count per partition reaches
    the driver.
    """
    parts = cut(df.select(column).filter(F.col(column).isNotNull()).distinct().repartitionByRange(F.col(column)).sortWithinPartitions(column).withColumn("_p", F.spark_partition_id()))
    offset, at = {}, 0
    for p, n in sorted(tuple(r) for r in parts.groupBy("_p").count().collect()):
        offset[p] = at
        at += n
    held = df.sparkSession.sparkContext.broadcast(offset)

    def number(batches):
        at = None
        for b in batches:
            if not b.num_rows:
                continue
            if at is None:
                at = held.value[b.column("_p")[0].as_py()]
            ids = np.arange(at, at + b.num_rows, dtype=np.int64)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(column), pa.array(ids)], names=[column, name])

    kind = dict(df.dtypes)[column]
    return parts.mapInArrow(number, f"`{column}` {kind}, `{name}` bigint")


def _coded(corpus: DataFrame, vocab: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(bags, dictionary (word, code)): documents as counts of dense word codes."""
    ids = canonical_vocab(vocab)
    dictionary = cut(dense_ids(ids.select("word"), "word", "code"))
    return encoded_bags(corpus, ids.join(dictionary, "word").select("term_id", F.col("code").cast("int").alias("code")), limit), dictionary


def word_frequencies(corpus: DataFrame, vocab: DataFrame, range_bits: int = 12, limit: int = LOOKUP) -> DataFrame:
    """(word, total_freq, doc_freq): counts over the last loaded state of every document.

    Method: the words of the vocabulary get dense global integers; the documents' terms are
    encoded by them; every task adds occurrences and presences into count arrays for ranges of
    2^``range_bits`` identifiers, only for ranges it meets; the arrays of a range are then summed,
    streaming, where that range belongs.  A hot word costs one slot per task.  A dictionary of more
    than ``limit`` ids is joined and not sent to the tasks.

    Words that never occur give no row.  Null tokens, null entries, ids the vocabulary lacks, and
    documents without a word count nothing; several ids of one word in a document count once for
    its document frequency.  Empty tables give no rows; other columns are ignored.
    """
    bags, dictionary = _coded(corpus, vocab, limit)
    return block_sums(bags, range_bits).join(dictionary, "code").select("word", "total_freq", "doc_freq")


def marked_words(corpus: DataFrame, vocab: DataFrame, options: DataFrame, limit: int = LOOKUP) -> DataFrame:
    """(option_set, word, doc_freq, total_freq, mark): words outside the bounds of each option row.

    ``rare``: doc_freq < min_doc_freq; ``common``: doc_freq > ceil(D * max_doc_fraction), D the
    number of documents with a word.  A word can bear both marks.  A null bound marks nothing;
    NaN as fraction marks nothing.  Counts are those of ``word_frequencies``; one pass over the
    documents gives both them and D, as a word every document holds.  Bounds become rows
    (option, least and greatest frequency) that are met by frequency, not by word: at most one
    row per option and distinct frequency.
    """
    bags, dictionary = _coded(corpus, vocab, limit)
    # one code more than the dictionary's, which every document bears once
    mark = F.array(F.lit(-1))
    every = bags.select(F.concat(mark, "words").alias("words"), F.concat(F.array(F.lit(1)), "counts").alias("counts"))
    sums = cut(block_sums(every))
    freq = sums.filter("code >= 0")
    total = sums.filter("code = -1").agg(F.max("doc_freq").alias("d")).first()["d"] or 0
    o = options.select("option_set", "min_doc_freq", "max_doc_fraction").distinct()
    fraction = F.when(~F.isnan("max_doc_fraction"), F.col("max_doc_fraction"))
    most = F.ceil(F.lit(total) * fraction)
    bounds = o.select("option_set", F.array(F.struct(F.lit("rare").alias("mark"), F.lit(None).cast("bigint").alias("over"), F.col("min_doc_freq").cast("bigint").alias("under")), F.struct(F.lit("common").alias("mark"), most.cast("bigint").alias("over"), F.lit(None).cast("bigint").alias("under"))).alias("b")).select("option_set", F.inline("b")).filter("over is not null or under is not null")
    # a theta join of the few distinct frequencies with the bounds, then an equality join with the words
    some = freq.select("doc_freq").distinct()
    hit = some.join(F.broadcast(bounds) if options.count() <= 10_000 else bounds, (F.col("doc_freq") > F.col("over")) | (F.col("doc_freq") < F.col("under")))
    return freq.join(hit, "doc_freq").join(dictionary, "code").select("option_set", "word", "doc_freq", "total_freq", "mark")
