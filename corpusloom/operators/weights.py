"""Class TF-IDF, word contrasts, keyword statistics and token weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def class_counts(bow: DataFrame, classes: DataFrame) -> DataFrame:
    """(class, term, tf) from (doc_id, term, cnt) and (doc_id, class)."""
    return bow.join(classes, "doc_id").groupBy("class", "term").agg(F.sum("cnt").alias("tf"))


def ctfidf(counts: DataFrame, bm25: bool = False, reduce_frequent: bool = False) -> DataFrame:
    """(class, term, weight): tf x ln(1 + A / f), A the tokens per class.

    ``reduce_frequent`` takes the root of tf; ``bm25`` uses ln(max(1, 1 + (A - f + .5) / (f + .5))).
    """
    total = F.broadcast(counts.agg((F.sum("tf") / F.count_distinct("class")).alias("a")))
    freq = counts.groupBy("term").agg(F.sum("tf").alias("f"))
    x = counts.join(freq, "term").crossJoin(total)
    tf = F.sqrt("tf") if reduce_frequent else F.col("tf").cast("double")
    idf = F.log(F.greatest(F.lit(1.0), 1 + (F.col("a") - F.col("f") + 0.5) / (F.col("f") + 0.5))) if bm25 else F.log(1 + F.col("a") / F.col("f"))
    return x.select("class", "term", (tf * idf).alias("weight"))


def top_terms(weights: DataFrame, n: int = 10, group: str = "class", value: str = "weight") -> DataFrame:
    """The n greatest values of every group with their place, ties by term."""
    w = W.partitionBy(group).orderBy(F.col(value).desc(), F.col("term"))
    return weights.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def fighting_words(a: DataFrame, b: DataFrame, prior: float = 0.01, informative: bool = False, min_count: int = 1) -> DataFrame:
    """(term, n_a, n_b, z): log-odds contrast of two term counts (term, n).

    With ``informative`` the prior of a term is ``prior`` x its joint count.  ``min_count`` filters the
    output only.
    """
    j = a.select("term", F.col("n").alias("n_a")).join(b.select("term", F.col("n").alias("n_b")), "term", "full_outer").fillna(0, ["n_a", "n_b"])
    j = j.withColumn("p", F.lit(prior) * (F.col("n_a") + F.col("n_b")) if informative else F.lit(prior))
    t = F.broadcast(j.agg(F.sum("n_a").alias("t_a"), F.sum("n_b").alias("t_b"), F.sum("p").alias("t_p")))
    x = j.crossJoin(t)
    odds = lambda n, tot: F.log((F.col(n) + F.col("p")) / (F.col(tot) + F.col("t_p") - F.col(n) - F.col("p")))
    z = (odds("n_a", "t_a") - odds("n_b", "t_b")) / F.sqrt(1 / (F.col("n_a") + F.col("p")) + 1 / (F.col("n_b") + F.col("p")))
    return x.filter(F.col("n_a") + F.col("n_b") >= min_count).select("term", "n_a", "n_b", z.alias("z"))


def keyword_stats(vocab: DataFrame, keywords: DataFrame) -> DataFrame:
    """(set, term, tf, df, share): counts of the words of each keyword set, 0 where absent."""
    total = F.broadcast(vocab.agg(F.sum("tf").alias("total")))
    x = keywords.join(vocab, "term", "left").crossJoin(total)
    return x.select("set", "term", F.coalesce("tf", F.lit(0)).alias("tf"), F.coalesce("df", F.lit(0)).alias("df"), (F.coalesce("tf", F.lit(0)) / F.col("total")).alias("share"))


def refine_keywords(vocab: DataFrame, keywords: DataFrame, min_count: int = 2, min_doc_freq: int = 1) -> DataFrame:
    """(set, term, kept): whether a keyword is frequent enough."""
    s = keyword_stats(vocab, keywords)
    return s.select("set", "term", ((F.col("tf") >= min_count) & (F.col("df") >= min_doc_freq)).alias("kept"))


def token_weights(vocab: DataFrame, scheme: str = "information") -> DataFrame:
    """(term, weight): none 1, information -log2(f / N), inverse N / f."""
    x = vocab.crossJoin(F.broadcast(vocab.agg(F.sum("tf").cast("double").alias("total"))))
    forms = {"none": F.lit(1.0), "information": -F.log(2.0, F.col("tf") / F.col("total")), "inverse": F.col("total") / F.col("tf")}
    return x.select("term", forms[scheme].alias("weight"))


def idf_weights(counts: DataFrame) -> DataFrame:
    """(term, idf): ln(1 + A / f) of class counts (class, term, tf); the plain form, whatever the class weights use."""
    a = F.broadcast(counts.agg((F.sum("tf") / F.count_distinct("class")).alias("a")))
    return counts.groupBy("term").agg(F.sum("tf").alias("f")).crossJoin(a).select("term", F.log(1 + F.col("a") / F.col("f")).alias("idf"))


def top_fighting_words(contrast: DataFrame, n: int = 20) -> DataFrame:
    """(side, place, term, z): the n words of greatest z for side a and of smallest z for side b, ties by term."""
    ends = {"a": F.col("z").desc(), "b": F.col("z").asc()}
    # top-k reports: the n rows of each end, then their places
    few = [contrast.orderBy(o, "term").limit(n).select(F.lit(side).alias("side"), "term", "z", (F.when(F.lit(side) == "a", -F.col("z")).otherwise(F.col("z"))).alias("_o")) for side, o in ends.items()]
    w = W.partitionBy("side").orderBy("_o", "term")
    return few[0].unionByName(few[1]).withColumn("place", F.row_number().over(w)).select("side", "place", "term", "z")
