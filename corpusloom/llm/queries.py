"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import read
from ..operators.text import token_docs
from .clusters import hashed_features, record_clusters, similarity_clusters, typical_members
from .frequency import marked_words, word_frequencies
from .leaks import find_leaks
from .mixture import mix_report, mix_sources
from .neardup import duplicate_groups, duplicate_pairs, near_duplicates
from .pairs import word_pairs
from .residue import template_residue
from .similar import similar_vectors
from .topn import top_items


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_pairs(*near_duplicates(read(spark, sf, "corpus_docs"), read(spark, sf, "vocab")))


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    return duplicate_groups(*near_duplicates(read(spark, sf, "corpus_docs"), read(spark, sf, "vocab")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    marks = marked_words(read(spark, sf, "corpus_docs"), read(spark, sf, "vocab"), read(spark, sf, "load_options"))
    return marks.select("option_set", F.col("word").alias("term"), "mark")


def p2_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return word_frequencies(read(spark, sf, "corpus_docs"), read(spark, sf, "vocab")).select(F.col("word").alias("term"), "total_freq", "doc_freq")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [(m, k, read(spark, sf, m).select("topic", F.col(k).cast("bigint").alias("item_id"), "weight", "written_at")) for m, k in (("topic_word", "term_id"), ("doc_topic", "doc_id"))]
    both = None
    for m, _, df in parts:
        df = df.select(F.lit(m).alias("matrix"), "*")
        both = df if both is None else both.unionByName(df)
    return top_items(both, ["matrix", "topic"], "item_id", "weight", "written_at").select("matrix", "topic", "item_id")


def p4_similar(spark: SparkSession, sf: str) -> DataFrame:
    return similar_vectors({"word": (read(spark, sf, "word_vectors"), "term_id"), "topic": (read(spark, sf, "topic_vectors"), "topic"), "doc": (read(spark, sf, "doc_vectors"), "doc_id")}, min_similarity=0.8)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = p4_similar(spark, sf).select("kind", F.least("key", "other").alias("id_a"), F.greatest("key", "other").alias("id_b"))
    return pairs.distinct()


def p5_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs that the fitted null calls surprising at a false discovery rate of 1 %, whatever their NPMI."""
    return word_pairs(read(spark, sf, "corpus_docs"), read(spark, sf, "vocab"), min_npmi=None, max_q=0.01)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return word_pairs(read(spark, sf, "corpus_docs"), read(spark, sf, "vocab")).select("term_a", "term_b")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    clusters = similarity_clusters(read(spark, sf, "doc_vectors"), "doc_id")
    return clusters.select("cluster_key", F.col("member").alias("doc_id")).distinct()


def p6_typical(spark: SparkSession, sf: str) -> DataFrame:
    return typical_members(similarity_clusters(read(spark, sf, "doc_vectors"), "doc_id"))


def p6_records(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of the documents' texts, which have no vectors: hashed weighted words, k-means, members nearest each centroid."""
    docs = token_docs(read(spark, sf, "documents"))
    return record_clusters(hashed_features(docs, "doc_id", "tokens"), "key", count=64)


def p7_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return find_leaks(read(spark, sf, "documents"), read(spark, sf, "eval_items")).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "edits", "windows")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_leaks(spark, sf).filter("edits = 0").select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_report(spark, sf).filter("short").select("source")


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return mix_report(read(spark, sf, "documents"), read(spark, sf, "mix_targets"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(read(spark, sf, "documents"), read(spark, sf, "mix_targets"))


def p9_residue(spark: SparkSession, sf: str) -> DataFrame:
    return template_residue(read(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_residue(spark, sf).select("doc_id").distinct()


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_frequencies, p3_found, p4_found, p5_found, p5_pairs, p6_found, p6_typical, p6_records, p7_found, p7_leaks, p8_found, p8_mix, p8_report, p9_found, p9_residue)}
