"""Corpus sources and sinks: text lines, TSV, Parquet corpora, topic tables, token states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.text import TOKEN, bag_of_words, prune, tokenize


def read_lines(spark: SparkSession, path: str, id_field: bool = False) -> DataFrame:
    """(doc_name, label, text) of a text file, one document a line; blank lines are skipped, lines are trimmed.

    Names are ``doc_`` and the physical line number (over all files, by path), or with ``id_field`` the first token of a
    line; a line of one token then keeps it as its text and is named by its number.
    """
    raw = spark.read.text(path).select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("line"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_i"))
    # lines of a block of a file are numbered in a row; a block starts where all blocks before it end
    blocks = raw.groupBy("_f", "_b").agg(F.min("_i").alias("_first"), F.count(F.lit(1)).alias("_n"))
    table, at = [], 0
    for r in blocks.orderBy("_f", "_b").collect():
        table.append((r["_f"], r["_b"], at - r["_first"]))
        at += r["_n"]
    shift = spark.createDataFrame(table, "_f string, _b bigint, _s bigint")
    d = raw.filter("line <> ''").join(F.broadcast(shift), ["_f", "_b"]).withColumn("_name", F.concat(F.lit("doc_"), (F.col("_i") + F.col("_s")).cast("string")))
    if not id_field:
        return d.select(F.col("_name").alias("doc_name"), F.lit("").alias("label"), F.col("line").alias("text"))
    parts = F.split("line", r"\s+", 2)
    two = F.size(parts) > 1
    return d.select(F.when(two, parts[0]).otherwise(F.col("_name")).alias("doc_name"), F.lit("").alias("label"), F.when(two, F.get(parts, F.lit(1))).otherwise(F.col("line")).alias("text"))


def read_tsv(spark: SparkSession, path: str, id_column: int = 0, label_column: int | None = 1, text_column: int = 2) -> DataFrame:
    """(doc_name, label, text) of a tab-separated file; lines are trimmed first, and those with too few columns are left out."""
    need = max(c for c in (id_column, label_column, text_column) if c is not None)
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    raw = spark.read.text(path).withColumn("c", F.split(line, "\t", -1)).filter((line != "") & (F.size("c") > need))
    label = F.lit("") if label_column is None else F.trim(F.col("c")[label_column])
    return raw.select(F.trim(F.col("c")[id_column]).alias("doc_name"), label.alias("label"), F.col("c")[text_column].alias("text"))


def skipped_rows(spark: SparkSession, path: str, columns: int) -> int:
    """Lines of a tab-separated file that have fewer than ``columns`` columns, blank ones aside."""
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    return spark.read.text(path).filter((line != "") & (F.size(F.split(line, "\t", -1)) < columns)).count()


def prep_documents(docs: DataFrame, meta: DataFrame | None = None, lower_thresh: int = 1, upper_thresh: int | None = None, rm_top: int = 0) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(documents, vocabulary, meta): words of ``lower_thresh`` to ``upper_thresh`` documents kept, emptied documents and their rows of ``meta`` dropped."""
    share = 1.0
    if upper_thresh is not None:
        share = upper_thresh / max(1, docs.filter(F.size("tokens") > 0).count())
    new, vocab = build_corpus(docs, "doc_id", tokens="tokens", min_doc_freq=lower_thresh, max_doc_fraction=share, rm_top=rm_top)
    return new, vocab, None if meta is None else align(meta, new)


def corpus_stats(docs: DataFrame, label: str = "label") -> DataFrame:
    """(num_docs, num_words, total_tokens, has_labels) of tokens documents."""
    n = docs.agg(F.count(F.lit(1)).alias("num_docs"), F.sum(F.greatest(F.size("tokens"), F.lit(0))).cast("bigint").alias("total_tokens"), *([F.max(F.coalesce(F.col(label) != "", F.lit(False))).alias("has_labels")] if label in docs.columns else [F.lit(False).alias("has_labels")]))
    words = docs.select(F.explode("tokens").alias("t")).agg(F.count_distinct("t").alias("num_words"))
    return n.crossJoin(words).select("num_docs", "num_words", "total_tokens", "has_labels")


def build_corpus(df: DataFrame, key: str, text: str | None = None, tokens: str | None = None, pattern: str = TOKEN, stopwords: list[str] | None = None, min_length: int = 1, min_doc_freq: int = 1, max_doc_fraction: float = 1.0, min_cf: int = 0, rm_top: int = 0) -> tuple[DataFrame, DataFrame]:
    """(documents, vocabulary): pruned tokens with the metadata of ``df``; emptied documents go.

    ``documents`` keeps all other columns of ``df`` beside ``tokens``; ``vocabulary`` is (term, df, tf).
    """
    column = F.col(tokens) if tokens else tokenize(F.col(text), pattern=pattern, stopwords=stopwords, min_length=min_length)
    d = df.select(F.col(key).alias("doc_id"), column.alias("tokens"))
    kept = prune(bag_of_words(d), min_doc_freq, max_doc_fraction, min_cf, rm_top)
    pos = d.select("doc_id", F.posexplode("tokens").alias("pos", "term")).join(kept.select("term"), "term")
    new = pos.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"]).alias("tokens"))
    rest = df.drop(*[c for c in ("tokens",) if c in df.columns and key != c])
    return rest.join(new.withColumnRenamed("doc_id", key), key), kept


def save_corpus(docs: DataFrame, vocab: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").parquet(f"{path}/docs")
    vocab.write.mode("overwrite").parquet(f"{path}/vocab")


def load_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/vocab")


def align(meta: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``meta`` whose document survived pruning."""
    return meta.join(docs.select(key), key, "left_semi")


def write_topic_word(phi: DataFrame, path: str) -> None:
    """TSV topic, word, probability with 8 decimals."""
    phi.select("topic", F.col("term").alias("word"), F.format_string("%.8f", "prob").alias("probability")).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_doc_topic(theta: DataFrame, path: str, topics: list[int], labels: DataFrame | None = None) -> None:
    """TSV doc[, label], topic_0 ... with 8 decimals; labels (doc_id, label) are written where any is not empty."""
    wide = theta.groupBy("doc_id").pivot("topic", topics).agg(F.first("p"))
    extra = []
    if labels is not None and not labels.filter("label <> ''").isEmpty():
        wide, extra = wide.join(labels.select("doc_id", "label"), "doc_id", "left"), [F.coalesce("label", F.lit("")).alias("label")]
    wide.select(F.col("doc_id").alias("doc"), *extra, *[F.format_string("%.8f", F.coalesce(F.col(str(k)), F.lit(0.0))).alias(f"topic_{k}") for k in topics]).write.mode("overwrite").csv(path, sep="\t", header=True)


def save_state(tokens: DataFrame, alpha: list[float], beta: float, path: str) -> None:
    """Token-level state as gzip text: a header, #alpha and #beta, then doc source pos typeindex type topic.

    ``tokens`` (doc_id, pos, typeindex, term, topic); the three head lines have a file of their own.
    """
    spark = tokens.sparkSession
    head = ["#doc source pos typeindex type topic", "#alpha : " + " ".join(repr(float(a)) for a in alpha), f"#beta : {float(beta)!r}"]
    line = F.concat_ws(" ", F.col("doc_id").cast("string"), F.lit("NA"), F.col("pos").cast("string"), F.col("typeindex").cast("string"), "term", F.col("topic").cast("string"))
    spark.createDataFrame([(h,) for h in head], "value string").coalesce(1).write.mode("overwrite").text(path, compression="gzip")
    tokens.sortWithinPartitions("doc_id", "pos").select(line.alias("value")).write.mode("append").text(path, compression="gzip")


def load_state(spark: SparkSession, path: str) -> tuple[DataFrame, list[float], float]:
    """(tokens (doc_id STRING, pos, typeindex, term, topic), alpha, beta) of what ``save_state`` wrote."""
    raw = spark.read.text(path)
    head = {r[0].split(" : ")[0]: r[0].split(" : ")[1] for r in raw.filter(F.col("value").startswith("#alpha") | F.col("value").startswith("#beta")).collect()}
    c = F.split("value", " ")
    rows = raw.filter(~F.col("value").startswith("#"))
    tokens = rows.select(c[0].alias("doc_id"), c[2].cast("int").alias("pos"), c[3].cast("int").alias("typeindex"), c[4].alias("term"), c[5].cast("int").alias("topic"))
    return tokens, [float(a) for a in head["#alpha"].split()], float(head["#beta"])


def assignment_counts(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(word counts (typeindex, topic, n), document counts (doc_id, topic, n)) of explicit assignments."""
    return tokens.groupBy("typeindex", "topic").agg(F.count(F.lit(1)).alias("n")), tokens.groupBy("doc_id", "topic").agg(F.count(F.lit(1)).alias("n"))
