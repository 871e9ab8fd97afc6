"""The frames behind visual panels: every panel is a DataFrame (or a few) that a client draws."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.ensemble import distances
from ..operators import cooc, diagnostics, selection
from ..operators.weights import top_terms


def capabilities(model) -> dict[str, bool]:
    """Which panels a fitted model can feed."""
    has = lambda n: hasattr(model, n)
    return {
        "terms": has("topic_word"), "documents": has("doc_topic"), "effects": has("doc_topic"), "eta": getattr(type(model), "family", "") == "logistic_normal",
        "draws": has("theta_draws") or has("posterior_theta_samples"), "content": has("topic_word_by_group"), "time": has("time_prevalence") or has("word_evolution"), "tree": has("node_parents"), "vectors": has("topic_vectors"),
    }


def term_barchart(phi: DataFrame, by: str = "prob", n: int = 10, marginal: DataFrame | None = None) -> DataFrame:
    """(topic, place, term, value): top terms by prob, frex, lift, score or relevance, values to 9 decimals, ties by term."""
    forms = {
        "prob": lambda: phi.select("topic", "term", F.col("prob").alias("value")),
        "frex": lambda: diagnostics.frex(phi).withColumnRenamed("frex", "value"),
        "lift": lambda: diagnostics.label_scores(phi).select("topic", "term", F.col("lift").alias("value")),
        "score": lambda: diagnostics.label_scores(phi).select("topic", "term", F.col("score").alias("value")),
        "relevance": lambda: diagnostics.relevance(phi, marginal).withColumnRenamed("relevance", "value"),
    }
    return top_terms(forms[by]().withColumn("value", F.round("value", 9)), n, "topic", "value").select("topic", "place", "term", "value")


def seriate(gaps: np.ndarray) -> list[int]:
    """An order in which each item stands beside its nearest unplaced one, from the item of least total distance."""
    order = [int(gaps.sum(1).argmin())]
    while len(order) < len(gaps):
        rest = gaps[order[-1]].copy()
        rest[order] = np.inf
        order.append(int(rest.argmin()))
    return order


def topic_similarity(topic_word: np.ndarray, metric: str = "js") -> tuple[np.ndarray, list[int]]:
    """(K, K) distances and an order that puts like topics together."""
    d = distances(topic_word, topic_word, metric)
    return d, seriate(d)


def topic_correlation_clr(theta: DataFrame) -> DataFrame:
    """(topic_a, topic_b, corr), a < b: correlation of centred log-ratio shares, free of the closure to 1."""
    logs = theta.withColumn("l", F.log(F.greatest("p", F.lit(1e-12))))
    mean = logs.groupBy("doc_id").agg(F.avg("l").alias("mean"))
    return diagnostics.topic_correlation(logs.join(mean, "doc_id").select("doc_id", "topic", (F.col("l") - F.col("mean")).alias("p")))


def partial_correlation(corr: np.ndarray) -> np.ndarray:
    """Partial correlations from a correlation matrix, by its pseudo-inverse."""
    p = np.linalg.pinv(corr)
    d = np.sqrt(np.maximum(np.diag(p), 1e-300))
    out = -p / np.outer(d, d)
    np.fill_diagonal(out, 1.0)
    return out


def document_inspector(theta: DataFrame, doc_id, n: int = 5) -> dict[str, DataFrame]:
    """A document's shares and its nearest documents."""
    return {"shares": theta.filter(F.col("doc_id") == F.lit(doc_id)).select("topic", "p"), "neighbours": selection.similar_documents(theta, doc_id, n)}


def document_map(theta: DataFrame, topics: list) -> DataFrame:
    """(doc_id, x, y): shares projected on their first two principal axes."""
    from ..models.embedding import pca, project

    wide = theta.groupBy(F.col("doc_id").alias("id")).pivot("topic", topics).agg(F.first("p")).fillna(0.0)
    v = wide.select("id", F.array(*[F.col(f"`{t}`") for t in topics]).alias("vec"))
    return project(v, *pca(v, len(topics), 2)).select(F.col("id").alias("doc_id"), F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))


def content_covariate(model, topic: int, n: int = 10) -> list[tuple]:
    """(term, group, prob) of a topic's words whose wording differs most between groups."""
    p = model.topic_word_by_group[topic]
    spread = np.log(np.maximum(p, 1e-300)).std(0) * p.mean(0)
    best = np.lexsort((np.arange(len(spread)), -spread))[:n]
    return [(model.vocabulary[w], g, float(p[i, w])) for w in best for i, g in enumerate(model.groups)]


def permutation_summary(rows: list[dict]) -> list[dict]:
    """Of ``permutation_test``: observed value, p and the null's mean and 95 % band."""
    return [{"topic": r["topic"], "observed": r["observed"], "p": r["p"], "null_mean": float(np.mean(r["null"])), "null_low": float(np.quantile(r["null"], 0.025)), "null_high": float(np.quantile(r["null"], 0.975))} for r in rows if r["null"]]


def prevalence_heatmap(theta: DataFrame, strata: DataFrame, topics: list) -> DataFrame:
    """One row a level, one column a topic: mean shares."""
    return theta.join(strata, "doc_id").groupBy("level").pivot("topic", topics).agg(F.avg("p"))


def coherence_frontier(docs: DataFrame, phi: DataFrame, theta: DataFrame, n: int = 10) -> DataFrame:
    return selection.quality_frontier(docs, phi, theta, n)


def term_topic_browser(phi: DataFrame, n: int = 30) -> DataFrame:
    """(topic, term, place, prob, lift, frex) of every topic's top terms."""
    top = top_terms(phi, n, "topic", "prob").select("topic", "term", "place", "prob")
    return top.join(diagnostics.label_scores(phi).select("topic", "term", "lift"), ["topic", "term"]).join(diagnostics.frex(phi), ["topic", "term"])


def dashboard(docs: DataFrame, phi: DataFrame, theta: DataFrame, n: int = 10) -> dict[str, DataFrame]:
    """The frames of an overview."""
    top = top_terms(phi, n, "topic", "prob").select("topic", "place", "term")
    return {
        "terms": term_barchart(phi, "prob", n), "frex": term_barchart(phi, "frex", n), "sizes": diagnostics.topic_sizes(theta), "coherence": cooc.coherence(docs, top), "exclusivity": diagnostics.exclusivity(phi, n),
        "correlation": diagnostics.topic_correlation(theta), "health": diagnostics.topic_health(phi, diagnostics.topic_sizes(theta)), "documents": diagnostics.top_documents(theta, n),
    }
