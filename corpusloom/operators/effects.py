"""Uncertainty of topic shares: draws of theta, group prevalence, bootstrap and permutation inference."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import normal_quantile
from ..functions.session import small
from ..models.ensemble import order_of, overlap
from .design import estimate_effect


def model_family(model) -> str:
    """``logistic_normal``, ``dirichlet`` or ``none``: decided by the class."""
    return getattr(type(model), "family", "none")


def _seed(key, seed: int) -> list[int]:
    import zlib

    return [seed, zlib.crc32(str(key).encode())]


def dirichlet_theta_samples(theta: DataFrame, lengths: DataFrame, nsims: int = 25, seed: int = 0, prior: float = 0.0) -> DataFrame:
    """(draw, doc_id, topic, p): draws from Dirichlet(theta (N + prior)), the parameters at least 1e-6; each document has its own generator."""
    wide = theta.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("topic", "p"))).alias("t")).join(lengths.select("doc_id", F.col("n").cast("double").alias("n")), "doc_id")
    wide = wide.select("doc_id", "n", F.col("t.topic").alias("topics"), F.col("t.p").alias("p"))
    kinds = dict(wide.dtypes)
    shape = f"doc_id {kinds['doc_id']}, topics {kinds['topics']}, draws array<array<double>>"

    def run(batches):
        for b in batches:
            out = []
            for key, n, p in zip(b.column("doc_id").to_pylist(), b.column("n").to_pylist(), b.column("p").to_pylist()):
                rng = np.random.default_rng(_seed(key, seed))
                g = rng.standard_gamma(np.maximum(np.array(p) * (n + prior), 1e-6), (nsims, len(p)))
                out.append((g / np.maximum(g.sum(1, keepdims=True), 1e-300)).tolist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("topics"), pa.array(out, pa.list_(pa.list_(pa.float64())))], names=["doc_id", "topics", "draws"])

    drawn = wide.mapInArrow(run, shape).select("doc_id", "topics", F.posexplode("draws").alias("draw", "d"))
    return drawn.select("draw", "doc_id", F.explode(F.arrays_zip("topics", "d")).alias("x")).select("draw", "doc_id", F.col("x.topics").alias("topic"), F.col("x.d").alias("p"))


def resample_draws(draws: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """``count`` draws: evenly spaced ones of more, repeated ones (seeded) of fewer."""
    have = [r[0] for r in draws.select("draw").distinct().orderBy("draw").collect()]
    if len(have) == count:
        return draws
    take = [have[int(i)] for i in np.linspace(0, len(have) - 1, count)] if len(have) > count else np.random.default_rng(seed).choice(have, count).tolist()
    side, _ = small(draws.sparkSession.createDataFrame([(i, int(d)) for i, d in enumerate(take)], "_new int, draw int"))
    return draws.join(side, "draw").drop("draw").withColumnRenamed("_new", "draw")


def composition_theta(model, docs: DataFrame, nsims: int = 25, seed: int = 0) -> DataFrame:
    """(draw, doc_id, topic, p) by the model's family: kept draws, else normal draws of eta or Dirichlet draws by length."""
    kept = getattr(model, "theta_draws", None)
    if kept is not None:
        return resample_draws(kept() if callable(kept) else kept, nsims, seed)
    if model_family(model) == "logistic_normal":
        return model.posterior_theta_samples(nsims, seed)
    lengths = docs.select("doc_id", F.size("tokens").alias("n"))
    return dirichlet_theta_samples(model.doc_topic(), lengths, nsims, seed)


def prevalence_ci(draws: DataFrame, groups: DataFrame, ci: float = 0.95, normalize: bool = True) -> DataFrame:
    """(level, topic, mean, sd, low, high): group means of every draw, then their mean, sd and quantile band.

    ``groups`` (doc_id, level).  With ``normalize`` the topics of a level and draw add up to 1.
    """
    from pyspark.sql import Window as W

    g = draws.join(groups, "doc_id").groupBy("draw", "level", "topic").agg(F.avg("p").alias("m"))
    if normalize:
        g = g.withColumn("m", F.col("m") / F.nullif(F.sum("m").over(W.partitionBy("draw", "level")), F.lit(0.0)))
    tail = (1 - ci) / 2
    band = F.percentile("m", F.array(F.lit(tail), F.lit(1 - tail)))
    out = g.groupBy("level", "topic").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"), band.alias("b"))
    return out.select("level", "topic", "mean", "sd", F.col("b")[0].alias("low"), F.col("b")[1].alias("high"))


def time_prevalence_ci(draws: DataFrame, stamps: DataFrame, **options) -> DataFrame:
    """``prevalence_ci`` by time stamp (doc_id, stamp), ordered as text."""
    return prevalence_ci(draws, stamps.select("doc_id", F.col("stamp").cast("string").alias("level")), **options).withColumnRenamed("level", "stamp")


def strata_by_draws(draws: DataFrame, strata: DataFrame, ci: float = 0.95) -> DataFrame:
    """(level, topic, n, mean, se, low, high): means per level with the errors within and between draws pooled, clipped to [0, 1]."""
    z = normal_quantile(0.5 + ci / 2)
    g = draws.join(strata, "doc_id").groupBy("draw", "level", "topic").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("m"), (F.coalesce(F.var_samp("p"), F.lit(0.0)) / F.count(F.lit(1))).alias("v"))
    x = g.groupBy("level", "topic").agg(F.max("n").alias("n"), F.avg("m").alias("mean"), F.avg("v").alias("within"), F.coalesce(F.var_samp("m"), F.lit(0.0)).alias("between"), F.count(F.lit(1)).alias("draws"))
    x = x.withColumn("se", F.sqrt(F.col("within") + (1 + 1 / F.col("draws")) * F.col("between")))
    return x.select("level", "topic", "n", "mean", "se", F.greatest(F.lit(0.0), F.col("mean") - z * F.col("se")).alias("low"), F.least(F.lit(1.0), F.col("mean") + z * F.col("se")).alias("high"))


def prevalence_composition(draws: DataFrame) -> DataFrame:
    """(topic, mean, se): overall prevalence, variance within over D plus (1 + 1 / M) between draws."""
    one = draws.select("doc_id", F.lit("all").alias("level")).distinct()
    return strata_by_draws(draws, one).select("topic", "mean", "se")


def bootstrap_corpus(docs: DataFrame, seed: int) -> DataFrame:
    """A resample of the documents: each is taken Poisson(1) times by a hash of its id; copies get ids of their own."""
    u = (F.xxhash64("doc_id", F.lit(seed)).cast("double") / F.lit(2.0**64)) + 0.5
    # the Poisson distribution function at 0 .. 7
    steps = np.cumsum([np.exp(-1) / np.prod(np.arange(1, k + 1, dtype=float)) for k in range(8)])
    times = sum(((u > float(c)).cast("int") for c in steps), F.lit(0))
    return docs.withColumn("_n", times).filter("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).withColumn("doc_id", F.concat_ws("#", F.col("doc_id").cast("string"), F.col("_copy").cast("string"))).drop("_n", "_copy")


def match_to_reference(reference, run, topn: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(match, quality, margin): partners by top-word Jaccard, that Jaccard, and its lead over the next best."""
    from ..functions.num import hungarian

    a, b = (np.asarray(getattr(m, "topic_word", m)) for m in (reference, run))
    words_a, words_b = getattr(reference, "vocabulary", None) or range(a.shape[1]), getattr(run, "vocabulary", None) or range(b.shape[1])
    top = lambda m, w: [{w[i] for i in order_of(r, topn)} for r in m]
    jac = np.array([[overlap(x, y) for y in top(b, words_b)] for x in top(a, words_a)])
    match = hungarian(-jac)
    at = np.arange(len(a))
    quality = np.where(match >= 0, jac[at, match], 0.0)
    rest = jac.copy()
    rest[at[match >= 0], match[match >= 0]] = -np.inf
    margin = quality - rest.max(1) if jac.shape[1] > 1 else quality
    return match, quality, margin


def bootstrap_refits(docs: DataFrame, refit: Callable[[DataFrame, int], object], reference, n_boot: int = 20, topn: int = 10, seed: int = 0) -> list[tuple]:
    """[(model, match, quality, margin)] of ``refit(resample, seed)``; one fit at a time, each a series of Spark jobs."""
    out = []
    for i in range(n_boot):
        m = refit(bootstrap_corpus(docs, seed + 1000 * (i + 1)), seed + i)
        out.append((m, *match_to_reference(reference, m, topn)))
    return out


def bootstrap_stability(docs: DataFrame, refit, reference, n_boot: int = 20, topn: int = 10, seed: int = 0) -> np.ndarray:
    """Mean top-word Jaccard of every topic of ``reference`` with its partners in refits on resamples."""
    return np.mean([q for _, _, q, _ in bootstrap_refits(docs, refit, reference, n_boot, topn, seed)], axis=0)


def reliability(refits: list[tuple], min_alignment: float = 0.5, min_margin: float = 0.1) -> np.ndarray:
    return (np.mean([q for _, _, q, _ in refits], axis=0) >= min_alignment) & (np.mean([m for *_, m in refits], axis=0) >= min_margin)


def top_words_bootstrap(refits: list[tuple], reference, topn: int = 10) -> list[tuple[int, str, float]]:
    """(topic, word, share of refits whose matched topic has the word among its top words)."""
    out = []
    for k, row in enumerate(reference.topic_word):
        for i in order_of(row, topn):
            word = reference.vocabulary[i]
            hits = [word in {m.vocabulary[j] for j in order_of(m.topic_word[match[k]], topn)} for m, match, *_ in refits if match[k] >= 0]
            out.append((k, word, float(np.mean(hits)) if hits else float("nan")))
    return out


def prevalence_bootstrap(refits: list[tuple], k: int) -> np.ndarray:
    """Standard deviation over refits of every matched topic's mean share."""
    rows = []
    for m, match, *_ in refits:
        mean = {r["topic"]: r["m"] for r in m.doc_topic().groupBy("topic").agg(F.avg("p").alias("m")).collect()}
        rows.append([mean.get(int(j), np.nan) for j in match])
    return np.nanstd(np.array(rows).reshape(-1, k), axis=0, ddof=1)


def effect_bootstrap(refits: list[tuple], x: DataFrame, features: list[str]) -> dict[tuple, float]:
    """{(topic, feature): standard deviation of the coefficient over refits}; copies of a document share its covariates."""
    rows: dict[tuple, list[float]] = {}
    for m, match, *_ in refits:
        theta = m.doc_topic().withColumn("doc_id", F.split("doc_id", "#")[0].cast(dict(x.dtypes)["doc_id"]))
        back = {int(j): k for k, j in enumerate(match)}
        for r in estimate_effect(theta, x, features):
            if r["topic"] in back:
                rows.setdefault((back[r["topic"]], r["feature"]), []).append(r["coef"])
    return {k: float(np.std(v, ddof=1)) for k, v in rows.items() if len(v) > 1}


def standard_errors(model, docs: DataFrame, of: str = "prevalence", method: str = "composition", x: DataFrame | None = None, features: list[str] | None = None, refit=None, nsims: int = 25, n_boot: int = 20, topn: int = 10, seed: int = 0, min_alignment: float = 0.5, min_margin: float = 0.1):
    """Errors of ``effect``, ``prevalence`` or ``top_words``, by draws of theta or by refits on resamples.

    By bootstrap an unreliable topic (low alignment or margin) has NaN errors.
    """
    if of not in ("effect", "prevalence", "top_words") or method not in ("composition", "bootstrap"):
        raise ValueError(f"unknown {of!r} or {method!r}")
    if method == "composition":
        if of == "top_words":
            raise ValueError("top words have errors by bootstrap only")
        draws = composition_theta(model, docs, nsims, seed)
        if of == "prevalence":
            return [{"topic": r["topic"], "mean": r["mean"], "se": r["se"]} for r in prevalence_composition(draws).orderBy("topic").collect()]
        return estimate_effect(draws, x, features)
    refits = bootstrap_refits(docs, refit, model, n_boot, topn, seed)
    sure = reliability(refits, min_alignment, min_margin)
    if of == "top_words":
        return [{"topic": k, "word": w, "inclusion": p if sure[k] else float("nan"), "reliable": bool(sure[k])} for k, w, p in top_words_bootstrap(refits, model, topn)]
    if of == "prevalence":
        se = prevalence_bootstrap(refits, len(sure))
        return [{"topic": k, "se": float(s) if sure[k] else float("nan"), "reliable": bool(sure[k])} for k, s in enumerate(se)]
    return [{"topic": k, "feature": f, "se": s if sure[k] else float("nan"), "reliable": bool(sure[k])} for (k, f), s in sorted(effect_bootstrap(refits, x, features).items())]


def permutation_test(model, docs: DataFrame, covariate: DataFrame, refit, n_perm: int = 100, topn: int = 10, seed: int = 0) -> list[dict]:
    """(topic, observed, p, null): difference of mean shares between x = 1 and x = 0 against random binary covariates of the same rate.

    ``covariate`` (doc_id, x 0/1); ``refit(docs, covariate, seed)`` fits a model, whose topics are matched to the
    model's.  Two-sided p = (1 + number of null differences at least as large) / (1 + number of them); NaN ones drop out.
    """

    def difference(m, x):
        d = m.doc_topic().join(x, "doc_id").groupBy("topic").agg((F.avg(F.when(F.col("x") == 1, F.col("p"))) - F.avg(F.when(F.col("x") == 0, F.col("p")))).alias("d"))
        return {r["topic"]: float("nan") if r["d"] is None else r["d"] for r in d.collect()}

    rate = covariate.agg(F.avg("x")).first()[0]
    seen, null = difference(model, covariate), {}
    for i in range(n_perm):
        coin = F.pmod(F.xxhash64("doc_id", F.lit(seed + i + 1)), F.lit(1 << 30)) < int(rate * (1 << 30))
        x = covariate.select("doc_id", coin.cast("int").alias("x"))
        m = refit(docs, x, seed + i + 1)
        match = match_to_reference(model, m, topn)[0]
        got = difference(m, x)
        for k, j in enumerate(match):
            null.setdefault(k, []).append(got.get(int(j), float("nan")))
    out = []
    for k in sorted(null):
        n = np.array(null[k])
        n = n[~np.isnan(n)]
        out.append({"topic": k, "observed": seen.get(k, float("nan")), "p": float((1 + (np.abs(n) >= abs(seen.get(k, np.nan)) - 1e-15).sum()) / (1 + len(n))), "null": n.tolist()})
    return out

