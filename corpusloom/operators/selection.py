"""Held-out evaluation, residual checks, human tests, and the choice of a model."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.num import chisq_upper
from ..functions.session import cut, small
from . import cooc, diagnostics
from .weights import top_terms


def make_heldout(docs: DataFrame, prop_docs: float = 0.5, prop_words: float = 0.5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(train, held): floor(prop_docs D) documents give up floor(prop_words N) of their token positions.

    ``train`` (doc_id, tokens) has all documents, ``held`` (doc_id, tokens) the removed tokens.  Both choices go by a
    seeded hash, documents by global rank of the hash and positions by rank within the document.
    """
    d = docs.select("doc_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")).withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))
    want = int(np.floor(prop_docs * d.count()))
    # the hash of the last chosen document; hashes of distinct ids are distinct but for chance
    last = d.select("_h").orderBy("_h").offset(want - 1).limit(1).first() if want else None
    chosen = F.lit(False) if last is None else F.col("_h") <= F.lit(last[0])
    n = F.floor(F.size("tokens") * F.lit(prop_words)).cast("int")
    order = F.array_sort(F.transform("tokens", lambda t, i: F.struct(F.xxhash64("doc_id", i, F.lit(seed + 1)).alias("h"), i.alias("i"))))
    gone = F.transform(F.slice(order, 1, F.greatest(n, F.lit(0))), lambda x: x["i"])
    d = d.withColumn("_gone", F.when(chosen & (n > 0), gone).otherwise(F.array().cast("array<int>")))
    part = lambda keep: F.transform(F.filter(F.transform("tokens", lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda x: F.array_contains("_gone", x["i"]) != F.lit(keep)), lambda x: x["t"])
    return d.select("doc_id", part(True).alias("tokens")), d.filter(F.size("_gone") > 0).select("doc_id", part(False).alias("tokens"))


def eval_heldout(held: DataFrame, theta: DataFrame, phi: DataFrame) -> DataFrame:
    """(expected, docs, tokens): mean over documents of the mean log-likelihood of their held tokens; unknown words are left out."""
    bow = held.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    x = diagnostics.completion_loglik(bow, theta, phi)
    return x.agg(F.avg(F.col("loglik") / F.col("n")).alias("expected"), F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"))


def check_residuals(bow: DataFrame, theta: DataFrame, phi: DataFrame, tol: float = 0.01) -> dict:
    """{dispersion, pvalue, df}: multinomial residual dispersion of a fit; well above 1 means too few topics.

    ``bow`` (doc_id, term, cnt), theta (doc_id, topic, p), phi (topic, term, prob).  A word a document lacks counts
    too, so each document meets all words: phi is sent to the tasks and documents stay where they are.
    """
    topics = [r[0] for r in phi.select("topic").distinct().orderBy("topic").collect()]
    words = [r[0] for r in phi.select("term").distinct().orderBy("term").collect()]
    k, v = len(topics), len(words)
    ids = phi.sparkSession.createDataFrame(list(enumerate(words)), "w int, term string")
    m = np.zeros((k, v))
    for r in phi.join(small(ids)[0], "term").groupBy("topic").agg(F.collect_list(F.struct("w", "prob")).alias("row")).collect():
        for c in r["row"]:
            m[topics.index(r["topic"]), c["w"]] = c["prob"]
    bags = bow.join(small(ids)[0], "term").groupBy("doc_id").agg(F.collect_list(F.struct("w", "cnt")).alias("bag"))
    shares = theta.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("topic", "p"))).alias("t")).select("doc_id", F.col("t.p").alias("t"))
    held = phi.sparkSession.sparkContext.broadcast(m)

    def run(batches):
        d, n_hat, docs = 0.0, 0, 0
        for b in batches:
            flat, per = b.column("bag").flatten(), np.diff(b.column("bag").offsets.to_numpy())
            w, c = flat.field("w").to_numpy(zero_copy_only=False), flat.field("cnt").to_numpy(zero_copy_only=False).astype(float)
            t = b.column("t").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            for lo in range(0, len(per), 64):
                q = np.clip(t[lo : lo + 64] @ held.value, 1e-12, 1 - 1e-12)
                at = slice(per[:lo].sum(), per[: lo + 64].sum())
                x = np.zeros_like(q)
                np.add.at(x, (np.repeat(np.arange(len(q)), per[lo : lo + 64]), w[at]), c[at])
                size = x.sum(1, keepdims=True)
                n_hat += int((q * size > tol).sum())
                d += float(((x * x - 2 * x * q * size) / (size * q * (1 - q)) + size * q / (1 - q)).sum())
            docs += len(per)
        yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([n_hat], pa.int64()), pa.array([docs], pa.int64())], names=["d", "n", "docs"])

    r = bags.join(shares, "doc_id").select("bag", "t").mapInArrow(run, "d double, n bigint, docs bigint").agg(F.sum("d").alias("d"), F.sum("n").alias("n")).first()
    every = theta.select("doc_id").distinct().count()
    df = (r["n"] or 0) - v - (every * (k - 1) + k * (v - 1))
    stat = r["d"] or 0.0
    return {"dispersion": stat / df if df > 0 else float("nan"), "pvalue": chisq_upper(stat, df), "df": float(df)}


def mmr(phi: DataFrame, embeddings: DataFrame, n: int = 10, diversity: float = 0.3, n_candidates: int | None = None) -> DataFrame:
    """(topic, place, term): top words chosen one by one by (1 - diversity) relevance - diversity x greatest cosine to those chosen.

    Candidates are the ``n_candidates`` (default 5 n) most probable words with a vector (term, vec); a topic's
    candidates are a bounded group.
    """
    most = n_candidates or 5 * n
    best = top_terms(phi.join(embeddings, "term"), most, "topic", "prob").groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("place", "term", "prob", "vec"))).alias("c"))

    @F.pandas_udf("array<string>")
    def pick(rows):
        out = []
        for c in rows:
            x = np.array([np.asarray(r["vec"], float) for r in c])
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            like = x @ x.T
            score = np.array([r["prob"] for r in c])
            score = score / max(score.max(), 1e-300)
            chosen = [0] if len(c) else []
            while len(chosen) < min(n, len(c)):
                gain = (1 - diversity) * score - diversity * like[:, chosen].max(1)
                gain[chosen] = -np.inf
                chosen.append(int(gain.argmax()))
            out.append([c[i]["term"] for i in chosen])
        return __import__("pandas").Series(out)

    return best.select("topic", F.posexplode(pick("c")).alias("place", "term")).withColumn("place", F.col("place") + 1)


def word_intrusion(phi: DataFrame, n_words: int = 5, seed: int = 0) -> DataFrame:
    """(topic, words, intruder, intruder_index): a topic's top words and one that is a top word elsewhere but at most median here, shuffled.

    Where no such word is, any of the less probable half.  Choices go by a seeded hash.
    """
    top = cut(top_terms(phi, n_words, "topic", "prob").select("topic", "term", "place"))
    median = phi.groupBy("topic").agg(F.median("prob").alias("median"))
    mine = top.select("topic", "term", F.lit(True).alias("own"))
    side = small(top.select("term").distinct().withColumn("salient", F.lit(True)))[0]
    x = phi.join(median, "topic").filter(F.col("prob") <= F.col("median")).join(side, "term", "left").join(mine, ["topic", "term"], "left").filter("own is null")
    pick = x.groupBy("topic").agg(F.min(F.struct(F.col("salient").isNull().alias("other"), F.xxhash64("term", "topic", F.lit(seed)).alias("h"), "term")).alias("i"))
    words = top.groupBy("topic").agg(F.collect_list("term").alias("t")).join(pick, "topic").select("topic", F.col("i.term").alias("intruder"), F.concat("t", F.array("i.term")).alias("t"))
    shown = F.transform(F.array_sort(F.transform("t", lambda w: F.struct(F.xxhash64(w, F.lit(seed + 1), F.col("topic")).alias("h"), w.alias("w")))), lambda s: s["w"])
    return words.withColumn("words", shown).select("topic", "words", "intruder", (F.array_position("words", F.col("intruder")) - 1).cast("int").alias("intruder_index"))


def document_intrusion(theta: DataFrame, n_docs: int = 3, seed: int = 0) -> DataFrame:
    """(topic, docs, intruder, intruder_index): a topic's top documents and one of its bottom quarter that another topic rules, shuffled."""
    top = cut(diagnostics.top_documents(theta, n_docs).select("topic", "doc_id"))
    rule = theta.groupBy("doc_id").agg(F.min_by("topic", F.struct(-F.col("p"), F.col("topic"))).alias("ruler"))
    # the bottom quarter by exact quantile of every topic's shares
    low = theta.groupBy("topic").agg(F.percentile("p", F.lit(0.25)).alias("low"))
    x = theta.join(low, "topic").filter(F.col("p") <= F.col("low")).join(rule, "doc_id").join(top.withColumn("own", F.lit(True)), ["topic", "doc_id"], "left").filter("own is null")
    pick = x.groupBy("topic").agg(F.min(F.struct((F.col("ruler") == F.col("topic")).alias("same"), F.xxhash64("doc_id", "topic", F.lit(seed)).alias("h"), "doc_id")).alias("i"))
    docs = top.groupBy("topic").agg(F.collect_list("doc_id").alias("d")).join(pick, "topic").select("topic", F.col("i.doc_id").alias("intruder"), F.concat("d", F.array("i.doc_id")).alias("d"))
    shown = F.transform(F.array_sort(F.transform("d", lambda w: F.struct(F.xxhash64(w, F.lit(seed + 1), F.col("topic")).alias("h"), w.alias("w")))), lambda s: s["w"])
    return docs.withColumn("docs", shown).select("topic", "docs", "intruder", (F.array_position("docs", F.col("intruder")) - 1).cast("int").alias("intruder_index"))


def topic_table(phi: DataFrame, theta: DataFrame, n: int = 7) -> DataFrame:
    """(topic, prevalence, prob, frex): mean share and the top words by probability and by FREX, as text."""
    words = lambda df, v, name: top_terms(df, n, "topic", v).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("w")).select("topic", F.array_join("w.term", ", ").alias(name))
    prevalence = theta.groupBy("topic").agg(F.avg("p").alias("prevalence"))
    return prevalence.join(words(phi, "prob", "prob"), "topic").join(words(diagnostics.frex(phi), "frex", "frex"), "topic")


def topic_diagnostics(docs: DataFrame, phi: DataFrame, theta: DataFrame, n: int = 10, kind: str = "u_mass") -> DataFrame:
    """(topic, docs, mass, prevalence, coherence, exclusivity, prob, frex): one row a topic."""
    top = top_terms(phi, n, "topic", "prob").select("topic", "place", "term")
    return (
        diagnostics.topic_sizes(theta)
        .join(cooc.coherence(docs, top, kind), "topic", "left")
        .join(diagnostics.exclusivity(phi, n), "topic", "left")
        .join(topic_table(phi, theta, n), "topic", "left")
    )


def quality_frontier(docs: DataFrame, phi: DataFrame, theta: DataFrame, n: int = 10, kind: str = "u_mass") -> DataFrame:
    """(topic, coherence, exclusivity, prevalence)."""
    return topic_diagnostics(docs, phi, theta, n, kind).select("topic", "coherence", "exclusivity", "prevalence")


# fixed values: which way each metric of a scan is better
DIRECTIONS = {"coherence": 1, "exclusivity": 1, "heldout_loglik": 1, "perplexity": -1}


@dataclass
class Scan:
    """Rows of ``search_k``: k and its metrics."""

    rows: list[dict] = field(default_factory=list)

    def best_k(self, metric: str | None = None) -> int:
        """By held-out metric where there is one, else by ``frontier``: the sum of coherence and exclusivity in standard units."""
        if not self.rows:
            raise ValueError("nothing was scanned")
        has = set(self.rows[0])
        if metric is None:
            metric = next((m for m in ("heldout_loglik", "perplexity") if m in has), "frontier" if len(self.rows) > 1 and {"coherence", "exclusivity"} <= has else "coherence")
        if metric == "frontier":
            if len(self.rows) < 2:
                raise ValueError("a frontier needs at least two k")
            score = np.zeros(len(self.rows))
            for m in ("coherence", "exclusivity"):
                x = np.array([r[m] for r in self.rows], float)
                if x.std() > 0:
                    score += DIRECTIONS[m] * (x - x.mean()) / x.std()
            return self.rows[int(score.argmax())]["k"]
        if metric not in DIRECTIONS or metric not in has:
            raise ValueError(f"unknown metric {metric!r}")
        return max(self.rows, key=lambda r: DIRECTIONS[metric] * r[metric])["k"]

    def to_frame(self, spark) -> DataFrame:
        names = sorted(self.rows[0], key=lambda c: (c != "k", c))
        return spark.createDataFrame([tuple(r[c] for c in names) for r in self.rows], ", ".join(f"{c} {'int' if c == 'k' else 'double'}" for c in names))


def search_k(docs: DataFrame, ks: Iterable[int], make: Callable[[int, int], object], fit: Callable = lambda m, d: m.fit(d), held: DataFrame | None = None, seed: int = 42, coherence_n: int = 10) -> Scan:
    """Fits ``make(k, seed)`` for every k and measures mean UMass coherence, mean exclusivity and, with held tokens (doc_id, tokens), their likelihood."""
    out = []
    for k in ks:
        m = fit(make(k, seed), docs)
        phi = cut(m.phi())
        top = top_terms(phi, coherence_n, "topic", "prob").select("topic", "place", "term")
        row = {"k": int(k), "coherence": float(cooc.coherence(docs, top).agg(F.avg("coherence")).first()[0] or 0.0), "exclusivity": float(diagnostics.exclusivity(phi, coherence_n).agg(F.avg("exclusivity")).first()[0] or 0.0)}
        if held is not None:
            row["heldout_loglik"] = float(eval_heldout(held, m.doc_topic(), phi).first()["expected"] or float("nan"))
        out.append(row)
    return Scan(out)


@dataclass
class Selection:
    models: list
    rows: list[dict]

    @property
    def best(self):
        return self.models[int(np.argmax([r["coherence"] + r["exclusivity"] for r in self.rows]))]


def select_model(docs: DataFrame, make: Callable[[int], object], runs: int = 20, fraction: float | None = None, fit: Callable = lambda m, d, iters: m.fit(d, iters=iters), iters: int = 50, burn_in_iters: int = 10, score: Callable | None = None, n: int = 10) -> Selection:
    """``runs`` fits from different seeds; with ``fraction`` all run ``burn_in_iters`` first and only the ceil(fraction x runs) best by ``score`` go on."""
    score = score or (lambda m: m.log_likelihood())
    seeds = list(range(1, runs + 1))
    if fraction is not None:
        short = [(score(fit(make(s), docs, burn_in_iters)), s) for s in seeds]
        seeds = [s for _, s in sorted(short, reverse=True)[: int(np.ceil(fraction * runs))]]
    models = [fit(make(s), docs, iters) for s in seeds]
    rows = []
    for s, m in zip(seeds, models):
        phi = cut(m.phi())
        top = top_terms(phi, n, "topic", "prob").select("topic", "place", "term")
        rows.append({"seed": s, "coherence": float(cooc.coherence(docs, top).agg(F.avg("coherence")).first()[0] or 0.0), "exclusivity": float(diagnostics.exclusivity(phi, n).agg(F.avg("exclusivity")).first()[0] or 0.0)})
    return Selection(models, rows)


def similar_documents(theta: DataFrame, doc_id, n: int = 10) -> DataFrame:
    """(doc_id, js): the n other documents of smallest Jensen-Shannon divergence (base 2) of shares; ties by id."""
    one = small(theta.filter(F.col("doc_id") == F.lit(doc_id)).select("topic", F.col("p").alias("q")))[0]
    x = theta.filter(F.col("doc_id") != F.lit(doc_id)).join(one, "topic").withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(2.0, F.col(c) / F.col("m"))).otherwise(0.0)
    # a top-k report
    return x.groupBy("doc_id").agg((F.sum(part("p") + part("q")) / 2).alias("js")).orderBy("js", "doc_id").limit(n)


def pyldavis_inputs(docs: DataFrame, phi: DataFrame, theta: DataFrame) -> dict[str, DataFrame]:
    """The five tables an interactive topic browser needs."""
    bow = docs.select("doc_id", F.explode("tokens").alias("term"))
    known = phi.select("term").distinct()
    return {
        "topic_term_dists": phi, "doc_topic_dists": theta, "doc_lengths": docs.select("doc_id", F.size("tokens").alias("n")),
        "vocab": known, "term_frequency": bow.join(known, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n")),
    }


def topic_info(theta: DataFrame, phi: DataFrame, labels: DataFrame | None = None, names: dict | None = None, n: int = 8) -> DataFrame:
    """(topic, label, docs, prevalence, words): one row a topic, and one for -1 with the number of outliers where ``labels`` (doc_id, label) has any."""
    kind = dict(theta.dtypes)["topic"]
    words = top_terms(phi, n, "topic", "prob").groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("w")).select("topic", F.array_join("w.term", ", ").alias("words"))
    share = theta.groupBy("topic").agg(F.avg("p").alias("prevalence"))
    if labels is None:
        sizes = diagnostics.topic_sizes(theta).select("topic", "docs")
    else:
        sizes = labels.filter("label >= 0").groupBy(F.col("label").cast(kind).alias("topic")).agg(F.count(F.lit(1)).alias("docs"))
    out = share.join(sizes, "topic", "left").join(words, "topic", "left").select("topic", F.coalesce("docs", F.lit(0)).alias("docs"), "prevalence", "words")
    if labels is not None:
        noise = labels.filter("label = -1").groupBy().agg(F.count(F.lit(1)).alias("docs")).filter("docs > 0")
        out = out.unionByName(noise.select(F.lit(-1).cast(kind).alias("topic"), "docs", F.lit(None).cast("double").alias("prevalence"), F.lit("").alias("words")))
    if names:
        at = small(theta.sparkSession.createDataFrame([(k, v) for k, v in names.items()], f"topic {kind}, label string"))[0]
        out = out.join(at, "topic", "left")
    else:
        out = out.withColumn("label", F.lit(None).cast("string"))
    return out.select("topic", F.coalesce("label", F.concat(F.lit("topic_"), F.col("topic").cast("string"))).alias("label"), "docs", "prevalence", "words")


def representative_docs(theta: DataFrame, texts: DataFrame, n: int = 5) -> DataFrame:
    """(topic, place, doc_id, p, text): the documents of greatest share of every topic, with their texts."""
    return diagnostics.top_documents(theta, n).join(texts.select("doc_id", "text"), "doc_id", "left").select("topic", "place", "doc_id", "p", "text")


def topic_label_prompts(phi: DataFrame, theta: DataFrame, texts: DataFrame, n_words: int = 12, n_docs: int = 3, max_chars: int = 300) -> DataFrame:
    """(topic, prompt): words and excerpts of a topic as a request for a short name."""
    words = top_terms(phi, n_words, "topic", "prob").groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("w")).select("topic", F.array_join("w.term", ", ").alias("words"))
    docs = representative_docs(theta, texts, n_docs).groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("place", F.substring(F.coalesce("text", F.lit("")), 1, max_chars).alias("x")))).alias("d"))
    body = F.concat(F.lit("Name the topic in at most five words.\nWords: "), F.col("words"), F.lit("\nDocuments:\n- "), F.array_join("d.x", "\n- "))
    return words.join(docs, "topic").select("topic", body.alias("prompt"))


def llm_topic_labels(prompts: DataFrame, call: Callable[[str], str]) -> dict:
    """{topic: answer} of a user's callable, one prompt a topic."""
    return {r["topic"]: call(r["prompt"]).strip() for r in prompts.orderBy("topic").collect()}


def find_thoughts_html(theta: DataFrame, texts: DataFrame, words: Iterable[str], topic, n: int = 3) -> str:
    """The texts of a topic's top documents as HTML, its words marked."""
    import html
    import re

    # longer words first, so that a word inside another does not cut it
    mark = re.compile("|".join(rf"\b{re.escape(html.escape(w))}\b" for w in sorted(words, key=lambda w: -len(w))) or r"(?!)", re.I)
    rows = representative_docs(theta.filter(F.col("topic") == F.lit(topic)), texts, n).orderBy("place").collect()
    items = "".join(f"<li><b>{html.escape(str(r['doc_id']))}</b> ({r['p']:.3f}): {mark.sub(lambda m: f'<mark>{m[0]}</mark>', html.escape(r['text'] or ''))}</li>" for r in rows)
    return f"<h3>Topic {html.escape(str(topic))}</h3><ol>{items}</ol>"


def summary(model, n: int = 8) -> str:
    """A few lines on a fitted model."""
    lines = [f"{type(model).__name__}: {len(model.topic_word)} topics, {len(model.vocabulary)} words"]
    names = getattr(model, "topic_names", None) or [f"topic {k}" for k in range(len(model.topic_word))]
    return "\n".join([*lines, *(f"  {name}: {', '.join(w for w, _ in words)}" for name, words in zip(names, model.top_words(n)))])


def check_conformance(model) -> list[str]:
    """What a fitted model lacks of the common surface."""
    cls = model if isinstance(model, type) else type(model)
    missing = [f"no {name}()" for name in ("fit", "doc_topic", "phi", "top_words", "transform", "save", "load") if not callable(getattr(cls, name, None))]
    if getattr(cls, "family", None) not in ("dirichlet", "logistic_normal", "none"):
        missing.append("no family")
    if not isinstance(model, type):
        p = np.asarray(model.topic_word, float)
        if p.ndim != 2 or not np.allclose(p.sum(1), 1, atol=1e-6):
            missing.append("topic_word rows do not add up to 1")
        if p.shape[1] != len(model.vocabulary):
            missing.append("topic_word and vocabulary differ in width")
    return missing
