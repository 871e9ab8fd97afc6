"""Diagnostics of fitted topics: phi (topic, term, prob) and theta (doc_id, topic, p)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _rank(group, value):
    return F.row_number().over(W.partitionBy(group).orderBy(F.col(value).desc(), F.col("term")))


def topic_diversity(top: DataFrame) -> DataFrame:
    """(diversity): distinct over all top words of (topic, term)."""
    return top.agg((F.count_distinct("term") / F.count(F.lit(1))).alias("diversity"))


def exclusivity(phi: DataFrame, n: int = 10) -> DataFrame:
    """(topic, exclusivity): mean share of its top words' probability that a topic holds."""
    share = phi.withColumn("share", F.col("prob") / F.sum("prob").over(W.partitionBy("term"))).withColumn("place", _rank("topic", "prob"))
    return share.filter(F.col("place") <= n).groupBy("topic").agg(F.avg("share").alias("exclusivity"))


def frex(phi: DataFrame, w: float = 0.5) -> DataFrame:
    """(topic, term, frex): harmonic mean of the ranks of frequency and exclusivity; ties (to 12 decimals) by term."""
    x = phi.withColumn("e", F.round(F.col("prob") / F.sum("prob").over(W.partitionBy("term")), 12))
    low = lambda v: F.row_number().over(W.partitionBy("topic").orderBy(F.col(v), F.col("term"))) / F.count(F.lit(1)).over(W.partitionBy("topic"))
    return x.withColumn("fr", low("prob")).withColumn("er", low("e")).select("topic", "term", (1 / (w / F.col("fr") + (1 - w) / F.col("er"))).alias("frex"))


def label_scores(phi: DataFrame) -> DataFrame:
    """(topic, term, lift, score): phi / mean phi, and phi (ln phi - mean ln phi) over topics."""
    t = W.partitionBy("term")
    return phi.select("topic", "term", (F.col("prob") / F.avg("prob").over(t)).alias("lift"), (F.col("prob") * (F.log("prob") - F.avg(F.log("prob")).over(t))).alias("score"))


def relevance(phi: DataFrame, marginal: DataFrame, lam: float = 0.6) -> DataFrame:
    """(topic, term, relevance): lam ln p(w|t) + (1 - lam) ln(p(w|t) / p(w)); ``marginal`` (term, p)."""
    x = phi.join(marginal, "term")
    return x.select("topic", "term", (lam * F.log("prob") + (1 - lam) * F.log(F.col("prob") / F.col("p"))).alias("relevance"))


def topic_divergence(phi: DataFrame) -> DataFrame:
    """(topic_a, topic_b, js): Jensen-Shannon divergence, base 2, of every two topics, a < b."""
    a = phi.select(F.col("topic").alias("topic_a"), "term", F.col("prob").alias("p"))
    b = phi.select(F.col("topic").alias("topic_b"), "term", F.col("prob").alias("q"))
    x = a.join(b, "term").filter("topic_a < topic_b").withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda v: F.when(F.col(v) > 0, F.col(v) * F.log(2.0, F.col(v) / F.col("m"))).otherwise(0.0)
    return x.groupBy("topic_a", "topic_b").agg((F.sum(part("p") + part("q")) / 2).alias("js"))


def topic_cosine(phi: DataFrame) -> DataFrame:
    """(topic_a, topic_b, cosine), a < b."""
    norm = phi.groupBy("topic").agg(F.sqrt(F.sum(F.col("prob") * F.col("prob"))).alias("norm"))
    a = phi.select(F.col("topic").alias("topic_a"), "term", F.col("prob").alias("p"))
    b = phi.select(F.col("topic").alias("topic_b"), "term", F.col("prob").alias("q"))
    dot = a.join(b, "term").filter("topic_a < topic_b").groupBy("topic_a", "topic_b").agg(F.sum(F.col("p") * F.col("q")).alias("dot"))
    x = dot.join(norm.select(F.col("topic").alias("topic_a"), F.col("norm").alias("na")), "topic_a").join(norm.select(F.col("topic").alias("topic_b"), F.col("norm").alias("nb")), "topic_b")
    return x.select("topic_a", "topic_b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))


def topic_sizes(theta: DataFrame) -> DataFrame:
    """(topic, docs, mass): documents whose greatest p it is (lowest topic wins), and summed p."""
    first = theta.groupBy("doc_id").agg(F.min_by("topic", F.struct(-F.col("p"), F.col("topic"))).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("docs"))
    mass = theta.groupBy("topic").agg(F.sum("p").alias("mass"))
    return mass.join(first, "topic", "left").select("topic", F.coalesce("docs", F.lit(0)).alias("docs"), "mass")


def top_topics(theta: DataFrame, n: int = 2) -> DataFrame:
    """(doc_id, topic, p, place): the n greatest topics of every document."""
    w = W.partitionBy("doc_id").orderBy(F.col("p").desc(), "topic")
    return theta.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def top_documents(theta: DataFrame, n: int = 3) -> DataFrame:
    """(topic, doc_id, p, place): the documents of greatest p of every topic."""
    w = W.partitionBy("topic").orderBy(F.col("p").desc(), "doc_id")
    return theta.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def topic_correlation(theta: DataFrame) -> DataFrame:
    """(topic_a, topic_b, corr), a < b: correlation over documents, 0 where undefined."""
    a = theta.select("doc_id", F.col("topic").alias("topic_a"), F.col("p").alias("x"))
    b = theta.select("doc_id", F.col("topic").alias("topic_b"), F.col("p").alias("y"))
    c = a.join(b, "doc_id").filter("topic_a < topic_b").groupBy("topic_a", "topic_b").agg(F.corr("x", "y").alias("corr"))
    return c.select("topic_a", "topic_b", F.coalesce(F.nanvl("corr", F.lit(0.0)), F.lit(0.0)).alias("corr"))


def topics_over_time(theta: DataFrame, stamps: DataFrame, normalize: bool = True) -> DataFrame:
    """(stamp, topic, prevalence): mean p per stamp (as text), rescaled to add up to 1."""
    m = theta.join(stamps.select("doc_id", F.col("stamp").cast("string").alias("stamp")), "doc_id").groupBy("stamp", "topic").agg(F.avg("p").alias("prevalence"))
    if normalize:
        m = m.withColumn("prevalence", F.col("prevalence") / F.nullif(F.sum("prevalence").over(W.partitionBy("stamp")), F.lit(0.0)))
    return m


def by_strata(theta: DataFrame, strata: DataFrame, z: float = 1.959963984540054) -> DataFrame:
    """(level, topic, n, mean, low, high): mean p per level with a normal band clipped to [0, 1]."""
    g = theta.join(strata, "doc_id").groupBy("level", "topic").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean"), (F.coalesce(F.stddev_samp("p"), F.lit(0.0)) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return g.select("level", "topic", "n", "mean", F.greatest(F.lit(0.0), F.col("mean") - z * F.col("se")).alias("low"), F.least(F.lit(1.0), F.col("mean") + z * F.col("se")).alias("high"))


def effect_single(theta: DataFrame, x: DataFrame) -> DataFrame:
    """(topic, slope, intercept, r2, n): ordinary least squares of p on one covariate (doc_id, x)."""
    return theta.join(x, "doc_id").groupBy("topic").agg(F.regr_slope("p", "x").alias("slope"), F.regr_intercept("p", "x").alias("intercept"), F.regr_r2("p", "x").alias("r2"), F.regr_count("p", "x").alias("n"))


def topic_health(phi: DataFrame, sizes: DataFrame, min_mass: float = 0.01, duplicate: float = 0.9) -> DataFrame:
    """(topic, share, nearest, flag): dead topics by mass share, duplicates by cosine; dead wins."""
    c = topic_cosine(phi)
    both = c.select(F.col("topic_a").alias("topic"), F.col("topic_b").alias("other"), "cosine").unionByName(c.select(F.col("topic_b").alias("topic"), F.col("topic_a").alias("other"), "cosine"))
    near = both.groupBy("topic").agg(F.max("cosine").alias("nearest"))
    s = sizes.crossJoin(F.broadcast(sizes.agg(F.sum("mass").alias("all")))).select("topic", (F.col("mass") / F.col("all")).alias("share"))
    flag = F.when(F.col("share") < min_mass, "dead").when(F.col("nearest") >= duplicate, "duplicate").otherwise("ok")
    return s.join(near, "topic", "left").select("topic", "share", "nearest", flag.alias("flag"))


def completion_loglik(held: DataFrame, theta: DataFrame, phi: DataFrame) -> DataFrame:
    """(doc_id, n, loglik): sum of n ln max(theta . phi_w, 1e-12) over held-out (doc_id, term, n).

    Terms without a row in phi are left out.
    """
    p = held.join(phi, "term").join(theta, ["doc_id", "topic"]).groupBy("doc_id", "term").agg(F.max("n").alias("n"), F.sum(F.col("p") * F.col("prob")).alias("prob"))
    return p.groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log(F.greatest("prob", F.lit(1e-12)))).alias("loglik"))
