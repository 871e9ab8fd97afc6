"""Row-level helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import small


def latest_rows(df: DataFrame, keys: list[str], stamp: str, values: list[str]) -> DataFrame:
    """One row per key: the values that stand beside the greatest ``stamp``.

    A null stamp counts as the oldest; of equal stamps the row with the greatest values wins, in
    the order of ``values``, so the result does not depend on row order.  Rows with a null key
    are left out.  An aggregate and not a window: a hot key is reduced before the shuffle.
    """
    for k in keys:
        df = df.filter(F.col(k).isNotNull())
    packed = F.max(F.struct(F.col(stamp).alias("_stamp"), *[F.col(v) for v in values])).alias("_row")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_row.{v}").alias(v) for v in values])


def canonical_vocab(vocab: DataFrame) -> DataFrame:
    """(term_id, word_id INT, word): ids whose terms differ in case or outer blanks share a word.

    ``word_id`` is the smallest term_id of the word.  Rows without id or term are left out; an
    id that stands in several rows keeps the smallest word.
    """
    v = (
        vocab.select(F.col("term_id").cast("int").alias("term_id"), F.lower(F.trim("term")).alias("word"))
        .filter("term_id is not null and word is not null")
        .groupBy("term_id")
        .agg(F.min("word").alias("word"))
    )
    heads = v.groupBy("word").agg(F.min("term_id").alias("word_id"))
    return v.join(heads, "word").select("term_id", "word_id", "word")


def document_terms(corpus: DataFrame) -> DataFrame:
    """(doc_id, term_id, n): term counts of the last loaded state of every document.

    Null tokens, null entries and empty documents give no row.  The shuffle on doc_id that finds
    the last state also serves the count.
    """
    last = latest_rows(corpus, ["doc_id"], "loaded_at", ["tokens"])
    return last.select("doc_id", F.explode("tokens").alias("term_id")).filter("term_id is not null").groupBy("doc_id", "term_id").agg(F.count(F.lit(1)).cast("int").alias("n"))


def join_on_terms(terms: DataFrame, ids: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """``terms`` (clustered by doc_id) joined with ``ids`` on term_id, clustered by doc_id again.

    A vocabulary of at most ``limit`` ids is sent to every task and the documents stay where they
    are; a larger one is met by a shuffle on term_id and one back.
    """
    side, fits = small(ids, limit)
    joined = terms.join(side, "term_id")
    return joined if fits else joined.repartition("doc_id")


def document_words(corpus: DataFrame, vocab: DataFrame) -> DataFrame:
    """(doc_id, word_id, n), clustered by doc_id: word counts of the last loaded documents.

    Ids that the vocabulary lacks are dropped.
    """
    ids = canonical_vocab(vocab).select("term_id", "word_id")
    return join_on_terms(document_terms(corpus), ids).groupBy("doc_id", "word_id").agg(F.sum("n").cast("int").alias("n"))
