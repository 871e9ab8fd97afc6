"""Dirichlet topic models: synchronous CVB0, distributed collapsed Gibbs, and the Movie Group Process.

Every sweep is one Spark job: documents stay partitioned, the topic-word table is broadcast, each
partition updates its documents in NumPy and sends its table of changes in slices, which are added in
the cluster, so the driver receives one table.  Lineage is cut each sweep by writing the state to the shared folder.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.num import digamma, lgamma, minka_beta, minka_steps, prior_terms
from ..functions.session import cut, drop
from .base import Encoded, TopicModel
from .engine import BLOCK, bags, block_rows, blocks_of, by_doc, by_word, listed, opened, packed_cells, packed_tokens, ranked, slice_columns, sliced, summed, token_counts, unpacked_cells, unpacked_tokens, within


#: Samplers that draw from the same conditional.
SAME_CONDITIONAL = ("gibbs", "sparse", "light", "warp")


def _histogram_terms(state: DataFrame, k: int):
    """``terms`` of ``minka_steps`` from whole counts: histograms over all documents, one row per topic and count."""
    from pyspark.sql import functions as F

    whole = state.select(F.transform("size", lambda x: F.round(x).cast("bigint")).alias("size"))
    sizes = whole.select(F.posexplode("size").alias("topic", "n")).filter("n > 0")
    totals = whole.select(F.lit(k).alias("topic"), F.aggregate("size", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("n")).filter("n > 0")
    # at most topics x longest document rows
    rows = np.array(sizes.unionByName(totals).groupBy("topic", "n").count().orderBy("topic", "n").collect(), float).reshape(-1, 3)
    topic, n, docs = rows[:, 0].astype(int), rows[:, 1], rows[:, 2]

    def terms(alpha):
        a = np.r_[alpha, alpha.sum()][topic]
        return np.bincount(topic, docs * (digamma(n + a) - digamma(a)), k + 1)

    return terms


def _summed_terms(state: DataFrame, k: int):
    """``terms`` of ``minka_steps`` from fractional counts: each partition sums over its documents, one job a step."""

    def terms(alpha):
        def part(batches):
            total = np.zeros(k + 1)
            for b in batches:
                total += prior_terms(b.column("size").flatten().to_numpy(zero_copy_only=False).reshape(-1, k), alpha)
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["terms"])

        return np.sum([r[0] for r in state.select("size").mapInArrow(part, "terms array<double>").collect()], axis=0)

    return terms


def fixed_topics(docs: DataFrame, topic_word: np.ndarray, vocabulary: list[str], alpha: np.ndarray, iters: int = 30) -> DataFrame:
    """(doc_id, topic, p) of documents under given topics: expected shares, iterated; unknown words are dropped.

    A document without a known word gets the prior.
    """
    from pyspark.sql import functions as F

    spark, k = docs.sparkSession, len(topic_word)
    held = spark.sparkContext.broadcast((topic_word, {t: i for i, t in enumerate(vocabulary)}, alpha))

    def infer(batches):
        phi, at, alpha = held.value
        for b in batches:
            words = b.column("tokens")
            flat = words.flatten().to_pylist()
            per = np.diff(words.offsets.to_numpy())
            code = np.array([at.get(t, -1) for t in flat], np.int64)
            doc = np.repeat(np.arange(len(per)), per)[code >= 0]
            key, n = np.unique((doc << 32) | code[code >= 0], return_counts=True)
            doc, w = key >> 32, key & 0xFFFFFFFF
            like = phi[:, w].T
            held_n = np.bincount(doc, n, len(per))
            size = np.repeat(held_n[:, None] / k, k, 1)
            for _ in range(iters):
                g = like * (size[doc] + alpha)
                g *= (n / np.maximum(g.sum(1), 1e-300))[:, None]
                size = np.zeros((len(per), k))
                np.add.at(size, doc, g)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(list(size), pa.list_(pa.float64()))], names=["doc_id", "size"])

    sizes = docs.select("doc_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")).mapInArrow(infer, f"doc_id {dict(docs.dtypes)['doc_id']}, size array<double>")
    return LDA._long(sizes, alpha)


class LDA(TopicModel):
    """Latent Dirichlet allocation.

    ``sampler``: "cvb0" (deterministic, synchronous cell updates) or "gibbs" (collapsed Gibbs, private
    tables per partition merged after every sweep); "sparse", "light" and "warp" name ways to draw from the same
    conditional and give that sampler.  ``init`` "spectral" starts from anchor words where they can be found.
    With ``optimize_interval`` the document prior is fitted every so many sweeps, ``use_symmetric_alpha`` its
    concentration only, ``optimize_beta`` the word prior too.  ``seed_words`` {topic: [words]} adds
    ``seed_weight`` to the prior of those words (guided topics).  ``labels`` (doc_id, topics
    ARRAY<INT>) in ``fit`` limits a document to its topics; an empty or missing set limits nothing.
    """

    family = "dirichlet"

    def __init__(self, num_topics: int, *, alpha_sum: float | None = None, beta: float = 0.01, sampler: str = "cvb0", seed: int = 42, optimize_interval: int = 0, use_symmetric_alpha: bool = False, optimize_beta: bool = False, init: str = "random", seed_words: dict[int, list[str]] | None = None, seed_weight: float = 5.0):
        if num_topics < 1:
            raise ValueError("num_topics must be positive")
        if sampler not in ("cvb0", *SAME_CONDITIONAL) or init not in ("random", "spectral"):
            raise ValueError(f"unknown sampler {sampler!r} or start {init!r}")
        self.use_symmetric_alpha, self.optimize_beta, self.init = use_symmetric_alpha, optimize_beta, init
        self.num_topics, self.beta, self.sampler, self.seed = num_topics, beta, sampler, seed
        self.alpha = np.full(num_topics, (num_topics if alpha_sum is None else alpha_sum) / num_topics)
        self.optimize_interval = optimize_interval
        self.seed_words, self.seed_weight = seed_words or {}, seed_weight
        self.history: list[tuple[int, float]] = []
        self.converged: bool | None = None

    def _prior(self) -> np.ndarray:
        b = np.full((self.num_topics, len(self.vocabulary)), self.beta)
        at = {t: i for i, t in enumerate(self.vocabulary)}
        for k, ws in self.seed_words.items():
            for w in ws:
                if w in at:
                    b[k, at[w]] += self.seed_weight
        return b

    def fit(self, docs: DataFrame, *, iters: int = 30, min_doc_freq: int = 1, max_doc_fraction: float = 1.0, labels: DataFrame | None = None, parts: int | None = None, progress=None, num_samples: int = 0, sample_interval: int = 25, convergence_tol: float = 0.0, check_every: int = 10) -> "LDA":
        """At most ``iters`` sweeps, then ``num_samples`` snapshots ``sample_interval`` sweeps apart, whose phi and theta are averaged.

        With ``convergence_tol`` the first part ends before ``iters``: for "cvb0" once a sweep moves less than
        that share of the tokens to other topics, for "gibbs" once the log-likelihood differs by less than
        that share between two checks, ``check_every`` sweeps apart; never in the first 3 x ``check_every``
        sweeps, in which the topics of a random start have yet to part.  ``converged`` says which it was.
        """
        enc = docs if isinstance(docs, Encoded) else Encoded(docs, min_doc_freq, max_doc_fraction, parts)
        enc.check(self.num_topics)
        self.vocabulary, self.spark = enc.terms, enc.spark
        k, v = self.num_topics, len(self.vocabulary)
        prior = self._prior()
        data = enc.docs
        if labels is not None:
            data = cut(data.join(labels.select("doc_id", "topics"), "doc_id", "left").repartition(enc.parts, "doc_id").sortWithinPartitions("doc_id"))
        limited = labels is not None
        from .gibbs import counting, picked, redrawn, upto
        from .gibbs import sweep as one_sweep

        gibbs, seed, spark = self.sampler in SAME_CONDITIONAL, self.seed, self.spark
        start = None
        if self.init == "spectral":
            from .spectral import spectral_init

            start = spectral_init(enc, k)
        # where documents may have all topics, the tokens of many of them stand in one row
        blocked = gibbs and not limited
        if blocked:
            data, kind = blocks_of(data, v), np.uint8 if k <= 256 else np.int32
        state = data
        table, it, ends, taken, phi, checked = None, 0, iters, 0, 0.0, None
        self.converged = False if convergence_tol else None
        while it < ends + num_samples * sample_interval:
            snap = it >= ends and (it - ends + 1) % sample_interval == 0
            held = spark.sparkContext.broadcast((table, prior, self.alpha))

            def sweep(batches, it=it, held=held, snap=snap, taken=taken):
                counts, prior, alpha = held.value
                delta, rng, change, cells, part = np.zeros(k * v), None, 0.0, 0, 0
                shared = {"states": k, "topic": np.arange(k), "width": v, "words": "lda", "docs": "lda", "beta": prior, "start": prior + 1e-12 if start is None else start + 1e-12, "table": counts, "prior_kind": "shared", "alpha": alpha}
                if counts is not None and not gibbs:
                    by_term, beta = np.ascontiguousarray(counts.T), np.ascontiguousarray(prior.T)
                    total = counts.sum(1) + prior.sum(1)
                if counts is not None and blocked:
                    total = counts.sum(1) + prior.sum(1)
                    local = np.ascontiguousarray((counts + prior).T, counting(counts.max(initial=0)))
                for b in batches:
                    ids = b.column("doc_id")
                    if not len(ids):
                        continue
                    part = part or zlib.crc32(str(ids[0].as_py()).encode())
                    rng = rng or np.random.default_rng([seed, it, part])
                    if blocked:
                        g, size = [], []
                        for i, per, w in block_rows(b, v):
                            old = None if counts is None else np.frombuffer(b.column("g")[i].as_buffer(), kind)
                            if old is None:
                                new, far = picked(upto(k) @ shared["start"].take(w, 1), rng.random(len(w))).astype(np.int64), slice(None)
                            else:
                                new, total = redrawn(w, old, per, local, total, alpha, rng)
                                far = np.nonzero(new != old)[0]
                                delta -= np.bincount(old[far].astype(np.int64) * v + w[far], minlength=k * v)
                            by = np.bincount(new[far] * v + w[far], minlength=k * v)
                            delta += by
                            change += float(by.sum()) * (1 if old is None else 2)
                            cells += len(w)
                            g.append(new.astype(kind).tobytes())
                            # from the first snapshot on, the sum of the snapshots
                            sums = np.frombuffer(b.column("size")[i].as_buffer(), float).reshape(-1, k) if taken else np.zeros((0, k))
                            if snap:
                                order, left = ranked(per)
                                sizes = np.bincount(order[within(left)] * k + new, minlength=len(per) * k).reshape(-1, k)
                                sums = sizes + sums if taken else sizes.astype(float)
                            size.append(sums.tobytes())
                        cols = [*(b.column(c) for c in names[:4]), pa.array(g, pa.binary()), pa.array(size, pa.binary()), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.binary())]
                        kinds = [c.type for c in cols[:-3]]
                        yield pa.RecordBatch.from_arrays(cols, names=names)
                        continue
                    per, w, n = bags(b)
                    doc, mask, fresh = np.repeat(np.arange(len(per)), per), None, counts is None
                    if limited:
                        mask = np.ones((len(per), k))
                        for i, t in enumerate(b.column("topics").to_pylist()):
                            if t:
                                mask[i] = 0
                                mask[i, t] = 1
                    if gibbs:
                        # the distinct words of a document are redrawn in turn, for all documents at once;
                        # the tokens of a cell are drawn together given the others
                        z = None if fresh else unpacked_tokens(b.column("g"), k)
                        new, size = one_sweep(shared, per, w, n, z, None, mask, rng, delta)
                        change += float(n.sum() if fresh else np.abs(token_counts(new, n, k) - token_counts(z, n, k)).sum())
                        g = packed_tokens(new, by_doc(n, per).astype(np.int64), k)
                    else:
                        if fresh:
                            new = rng.random((len(w), k)) * prior[:, w].T if start is None else start[:, w].T
                            new = new if mask is None else new * mask[doc]
                            new += 1e-9 if mask is None else 1e-9 * mask[doc]
                            diff = 0.0
                        else:
                            diff = unpacked_cells(b.column("g"), k)
                            unit = diff / n[:, None]
                            new = (by_doc(diff, per) + alpha)[doc] - unit
                            near = by_term[w] - unit
                            new *= np.maximum(near, 0, out=near) + beta[w]
                            new /= np.subtract(total, unit, out=unit)
                            new = new if mask is None else new * mask[doc]
                        new *= (n / new.sum(1))[:, None]
                        g, size = packed_cells(new, per), by_doc(new, per)
                        diff = new - diff
                        change += float(np.abs(diff).sum())
                        delta += by_word(w, diff, v).ravel()
                    cells += int(n.sum())
                    if taken:
                        # from the first snapshot on, the sum of the snapshots
                        size = size * snap + np.array(b.column("size").to_pylist())
                    cols = [ids, b.column("bag"), *([b.column("topics")] if limited else []), g, listed(size), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.binary())]
                    kinds = [c.type for c in cols[:-3]]
                    yield pa.RecordBatch.from_arrays(cols, names=names)
                if cells:
                    rows = list(sliced(np.r_[delta, change, cells], part))
                    none = [pa.nulls(len(rows), t) for t in kinds]
                    yield pa.RecordBatch.from_arrays([*none, *slice_columns(rows)], names=names)

            key = dict(data.dtypes)["doc_id"]
            if blocked:
                names, shape = ["doc_id", "ids", "per", "w"], f"doc_id {key}, {BLOCK}, g binary, size binary"
            else:
                names, shape = ["doc_id", "bag", *(["topics"] if limited else [])], f"doc_id {key}, bag binary, {'topics array<int>, ' if limited else ''}g binary, size array<double>"
            keep = [c for c in (*names, "g", "size") if c in state.columns]
            names, shape = [*names, "g", "size", "slice", "part", "sums"], f"{shape}, slice int, part bigint, sums binary"
            out = cut(state.select(*keep).mapInArrow(sweep, shape))
            got = summed(out.filter("slice is not null").select("slice", "part", "sums"), k * v + 2)
            table = got[:-2].reshape(k, v) + (0.0 if table is None else table)
            table = np.maximum(table, 0.0)
            if it:
                drop(last)
            state, last = out.filter("slice is null").drop("slice", "part", "sums"), out
            held.unpersist()
            moved = got[-2] / max(1, 2 * got[-1])
            self.history.append((it, moved))
            if snap:
                taken += 1
                phi = phi + (table + prior) / (table + prior).sum(1, keepdims=True)
            if convergence_tol and it < ends and it >= 2 * check_every:
                if not gibbs:
                    self.converged = moved < convergence_tol and it >= 3 * check_every
                elif it % check_every == 0:
                    self.counts, self.prior = table, prior
                    now = self.log_likelihood()
                    self.converged, checked = checked is not None and abs(now - checked) < convergence_tol * abs(checked), now
                if self.converged:
                    ends = it + 1
            if self.optimize_interval and it and it < ends and it % self.optimize_interval == 0:
                terms = _histogram_terms(opened(state, v, k) if blocked else state, k) if gibbs else _summed_terms(state, k)
                if self.use_symmetric_alpha:
                    shared = lambda a, f=terms: (lambda t: np.r_[np.full(k, t[:-1].mean()), t[-1]])(f(a))
                    self.alpha = minka_steps(shared, np.full(k, self.alpha.mean()))
                else:
                    self.alpha = minka_steps(terms, self.alpha)
                if self.optimize_beta:
                    self.beta = minka_beta(table, self.beta)
                    prior = self._prior()
            if progress:
                progress(it, moved)
            it += 1
        if blocked and it:
            state = opened(state, v, k)
        if taken:
            from pyspark.sql import functions as F

            state = state.withColumn("size", F.transform("size", lambda x: x / taken))
        self.counts, self.prior, self._state, self._wordless = table if table is not None else np.zeros((k, v)), prior, state, enc.wordless()
        p = self.counts + prior
        self.topic_word = phi / taken if taken else p / p.sum(1, keepdims=True)
        return self

    def doc_topic(self) -> DataFrame:
        """(doc_id, topic, p) of the fitted documents; one without a kept word gets the prior."""
        from pyspark.sql import functions as F

        empty = self._wordless.withColumn("size", F.array_repeat(F.lit(0.0), self.num_topics))
        return self._long(self._state.select("doc_id", "size").unionByName(empty), self.alpha)

    @staticmethod
    def _long(sizes: DataFrame, alpha: np.ndarray) -> DataFrame:
        from pyspark.sql import functions as F

        a = F.array(*[F.lit(float(x)) for x in alpha])
        p = F.zip_with("size", a, lambda x, y: x + y)
        total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
        return sizes.select("doc_id", F.posexplode(F.transform(p, lambda x: x / total)).alias("topic", "p"))

    def log_likelihood(self) -> float:
        """Log joint of words given topics under the prior, from the count table."""
        a, b = self.counts + self.prior, self.prior
        return float((lgamma(a) - lgamma(b)).sum() - (lgamma(a.sum(1)) - lgamma(b.sum(1))).sum())

    def joint_log_likelihood(self) -> float:
        """``log_likelihood`` and the log probability of the documents' topics under their prior, in one pass over the documents."""
        from .engine import matrix_of, sums_over

        k, alpha = self.num_topics, self.alpha

        def part(b):
            n = matrix_of(b.column("size"), k)
            return np.array([(lgamma(alpha.sum()) - lgamma(alpha.sum() + n.sum(1)) + (lgamma(n + alpha) - lgamma(alpha)).sum(1)).sum()])

        return self.log_likelihood() + float(sums_over(self._state, ["size"], part, 1)[0])

    def evaluate(self, docs: DataFrame, num_particles: int = 10, seed: int = 42) -> dict:
        """{log_likelihood, perplexity, num_tokens, num_oov} of held-out documents by the left-to-right estimator.

        For each word in turn, ``num_particles`` histories of topics: those of the words before are redrawn, the word's
        probability is averaged, its topic is drawn.  The cost of a document grows with the square of its length.
        Unknown words are dropped and counted.
        """
        from pyspark.sql import functions as F

        held = docs.sparkSession.sparkContext.broadcast((self.topic_word, {t: i for i, t in enumerate(self.vocabulary)}, self.alpha))

        def run(batches):
            phi, at, alpha = held.value
            k, r = len(phi), num_particles
            for b in batches:
                ll, known, lost = [], [], []
                for key, tokens in zip(b.column("doc_id").to_pylist(), b.column("tokens").to_pylist()):
                    w = [at[t] for t in tokens or [] if t in at]
                    rng, rows = np.random.default_rng([seed, zlib.crc32(str(key).encode())]), np.arange(r)
                    z, n, total = np.zeros((r, len(w)), int), np.zeros((r, k)), 0.0
                    for i, word in enumerate(w):
                        for j in range(i):
                            n[rows, z[:, j]] -= 1
                            p = np.cumsum(phi[:, w[j]] * (n + alpha), 1)
                            z[:, j] = np.minimum((p < rng.random((r, 1)) * p[:, -1:]).sum(1), k - 1)
                            n[rows, z[:, j]] += 1
                        q = phi[:, word] * (n + alpha)
                        total += np.log(max((q.sum(1) / (i + alpha.sum())).mean(), 1e-300))
                        p = np.cumsum(q, 1)
                        z[:, i] = np.minimum((p < rng.random((r, 1)) * p[:, -1:]).sum(1), k - 1)
                        n[rows, z[:, i]] += 1
                    ll.append(total)
                    known.append(len(w))
                    lost.append(len(tokens or []) - len(w))
                yield pa.RecordBatch.from_arrays([pa.array(ll, pa.float64()), pa.array(known, pa.int64()), pa.array(lost, pa.int64())], names=["ll", "n", "oov"])

        r = docs.select("doc_id", "tokens").mapInArrow(run, "ll double, n bigint, oov bigint").agg(F.sum("ll"), F.sum("n"), F.sum("oov")).first()
        n = r[1] or 0
        return {"log_likelihood": r[0] or 0.0, "perplexity": float(np.exp(-r[0] / n)) if n else float("nan"), "num_tokens": n, "num_oov": r[2] or 0}

    def diagnostics(self, docs: DataFrame, n: int = 10) -> DataFrame:
        """(topic, tokens, coherence, exclusivity, effective_words, document_entropy, uniform_dist, corpus_dist, rank1_docs, alpha)."""
        from pyspark.sql import functions as F

        from ..operators import cooc
        from ..operators import diagnostics as D
        from ..operators.weights import top_terms

        phi, p = self.phi(), self.topic_word
        corpus = self.counts.sum(0) / max(self.counts.sum(), 1e-300)
        kl = lambda q: (p * (np.log(np.maximum(p, 1e-300)) - np.log(np.maximum(q, 1e-300)))).sum(1)
        rows = [(k, float(self.counts[k].sum()), float(1 / (p[k] ** 2).sum()), float(u), float(c), float(a)) for k, (u, c, a) in enumerate(zip(kl(np.full(p.shape[1], 1 / p.shape[1])), kl(corpus), self.alpha))]
        own = self.spark.createDataFrame(rows, "topic int, tokens double, effective_words double, uniform_dist double, corpus_dist double, alpha double")
        top = top_terms(phi, n, "topic", "prob").select("topic", "place", "term")
        size = self._state.select(F.posexplode("size").alias("topic", "s"))
        share = size.groupBy("topic").agg(F.sum("s").alias("all"), F.sum(F.when(F.col("s") > 0, F.col("s") * F.log("s")).otherwise(0.0)).alias("slogs"))
        # entropy of a topic's tokens over documents: ln S - sum s ln s / S
        entropy = share.select("topic", F.when(F.col("all") > 0, F.log("all") - F.col("slogs") / F.col("all")).alias("document_entropy"))
        first = D.topic_sizes(self.doc_topic()).select("topic", F.col("docs").alias("rank1_docs"))
        out = own.join(cooc.coherence(docs, top), "topic", "left").join(D.exclusivity(phi, n), "topic", "left").join(entropy, "topic", "left").join(first, "topic", "left")
        return out.select("topic", "tokens", "coherence", "exclusivity", "effective_words", "document_entropy", "uniform_dist", "corpus_dist", "rank1_docs", "alpha")

    def similar_documents(self, doc_id, n: int = 10) -> DataFrame:
        from ..operators.selection import similar_documents

        return similar_documents(self.doc_topic(), doc_id, n)

    def assignments(self) -> DataFrame:
        """(doc_id, pos, typeindex, term, topic): every token with its topic; tokens are in order of their words."""
        k, words, gibbs = self.num_topics, self.spark.sparkContext.broadcast(self.vocabulary), self.sampler in SAME_CONDITIONAL
        key = dict(self._state.dtypes)["doc_id"]

        def run(batches):
            for b in batches:
                per, w, n = bags(b)
                if not len(per):
                    continue
                g = token_counts(unpacked_tokens(b.column("g"), k), n, k) if gibbs else unpacked_cells(b.column("g"), k)
                # whole tokens by largest remainders
                whole = np.floor(g + 1e-6).astype(int)
                order = np.argsort(-(g - whole), axis=1, kind="stable")
                left = n - whole.sum(1)
                np.put_along_axis(whole, order, np.take_along_axis(whole, order, 1) + (np.arange(k) < left[:, None]), 1)
                cell, topic = np.nonzero(whole)
                times = whole[cell, topic]
                cell, topic = np.repeat(cell, times), np.repeat(topic, times)
                doc = np.repeat(np.arange(len(per)), per)[cell]
                pos = np.arange(len(doc)) - np.searchsorted(doc, doc)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(pos.astype(np.int32)), pa.array(w[cell].astype(np.int32)), pa.array([words.value[i] for i in w[cell]], pa.string()), pa.array(topic.astype(np.int32))], names=["doc_id", "pos", "typeindex", "term", "topic"])

        return self._state.mapInArrow(run, f"doc_id {key}, pos int, typeindex int, term string, topic int")

    def save_state(self, path: str) -> None:
        from ..sources.corpus import save_state

        save_state(self.assignments(), list(self.alpha), self.beta, path)

    @classmethod
    def load_state(cls, spark, path: str) -> "LDA":
        """A model from the token states of ``save_state``: topics, shares and priors as they were."""
        from ..sources.corpus import load_state

        tokens, alpha, beta = load_state(spark, path)
        return cls.from_assignments(tokens, np.array(alpha), beta)

    @classmethod
    def from_assignments(cls, tokens: DataFrame, alpha: np.ndarray, beta: float = 0.01) -> "LDA":
        """A model whose count tables come from explicit assignments (doc_id, typeindex, term, topic)."""
        from pyspark.sql import functions as F

        from ..sources.corpus import assignment_counts

        spark, k = tokens.sparkSession, len(alpha)
        m = cls(k, beta=beta, sampler="gibbs")
        words, docs = assignment_counts(tokens)
        names = tokens.select("typeindex", "term").distinct().orderBy("typeindex").collect()
        m.spark, m.alpha, m.vocabulary = spark, np.asarray(alpha, float), [r["term"] for r in names]
        at = {r["typeindex"]: i for i, r in enumerate(names)}
        m.counts, m.prior = np.zeros((k, len(names))), np.full((k, len(names)), beta)
        for r in words.collect():
            m.counts[r["topic"], at[r["typeindex"]]] = r["n"]
        p = m.counts + m.prior
        m.topic_word = p / p.sum(1, keepdims=True)
        size = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.try_element_at("s", i), F.lit(0).cast("bigint")).cast("double"))
        m._state = cut(docs.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("topic", "n"))).alias("s")).select("doc_id", size.alias("size")))
        m._wordless = m._state.select("doc_id").limit(0)
        return m

    def transform(self, docs: DataFrame, iters: int = 30) -> DataFrame:
        """(doc_id, topic, p) of other documents with fixed topics; unknown words are dropped.

        A document without a known word gets the prior.
        """
        return fixed_topics(docs, self.topic_word, self.vocabulary, self.alpha, iters)

    def perplexity(self, docs: DataFrame) -> float:
        """Document completion: even token positions give theta, odd ones are scored; unknown words dropped."""
        from pyspark.sql import functions as F

        from ..operators.diagnostics import completion_loglik

        even = docs.select("doc_id", F.filter("tokens", lambda x, i: i % 2 == 0).alias("tokens"))
        odd = docs.select("doc_id", F.explode(F.filter("tokens", lambda x, i: i % 2 == 1)).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
        r = completion_loglik(odd, self.transform(even), self.phi()).agg(F.sum("loglik"), F.sum("n")).first()
        return float(np.exp(-r[0] / r[1])) if r[1] else float("nan")

    def save(self, path: str) -> None:
        """phi as Parquet beside the settings as JSON, by Spark's file systems."""
        import json

        meta = {"class": type(self).__name__, "version": 1, "num_topics": self.num_topics, "beta": self.beta, "sampler": self.sampler, "seed": self.seed, "alpha": self.alpha.tolist()}
        self.phi().write.mode("overwrite").parquet(f"{path}/phi")
        self.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, spark, path: str) -> "LDA":
        import json

        meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
        if meta["class"] != cls.__name__:
            raise ValueError(f"{path} holds a {meta['class']}, not a {cls.__name__}")
        m = cls(meta["num_topics"], beta=meta["beta"], sampler=meta["sampler"], seed=meta["seed"])
        rows = spark.read.parquet(f"{path}/phi").toPandas().pivot(index="topic", columns="term", values="prob").sort_index()
        m.spark, m.vocabulary, m.topic_word, m.alpha = spark, list(rows.columns), rows.to_numpy(), np.array(meta["alpha"])
        return m


class GSDMM(TopicModel):
    """One topic per document (Movie Group Process) for short texts.

    Each sweep redraws every document's cluster from the counts without it; partitions work on the
    counts of the last sweep plus their own changes.  A document without a kept word stays in the
    sampler and is drawn by the sizes of the clusters alone.
    """

    def __init__(self, num_topics: int, *, alpha: float = 0.1, beta: float = 0.1, seed: int = 42):
        self.num_topics, self.alpha, self.beta, self.seed = num_topics, alpha, beta, seed

    def fit(self, docs: DataFrame, *, iters: int = 30, min_doc_freq: int = 1, parts: int | None = None) -> "GSDMM":
        enc = docs if isinstance(docs, Encoded) else Encoded(docs, min_doc_freq, parts=parts)
        enc.check(self.num_topics)
        k, v, alpha, beta, seed = self.num_topics, len(enc.terms), self.alpha, self.beta, self.seed
        self.vocabulary, self.spark = enc.terms, enc.spark
        state = enc.all_docs()
        key = dict(state.dtypes)["doc_id"]
        m, nkw = np.zeros(k), np.zeros((k, v))
        self.cluster_counts: list[int] = []
        for it in range(iters):
            held = self.spark.sparkContext.broadcast((m, nkw))

            def sweep(batches, it=it, held=held):
                m, nkw = (a.copy() for a in held.value)
                m0, n0, rng, part = m.copy(), nkw.copy(), None, 0
                nk = nkw.sum(1)
                for b in batches:
                    per, w, n = bags(b)
                    ids = b.column("doc_id")
                    if not len(ids):
                        continue
                    part = part or zlib.crc32(str(ids[0].as_py()).encode())
                    rng = rng or np.random.default_rng([seed, it, part])
                    old = b.column("z").to_numpy() if "z" in b.schema.names else np.full(len(ids), -1)
                    new, start = np.zeros(len(ids), np.int32), np.cumsum(per) - per
                    for i in range(len(ids)):
                        wi, ni = w[start[i] : start[i] + per[i]], n[start[i] : start[i] + per[i]]
                        if old[i] >= 0:
                            m[old[i]] -= 1
                            nkw[old[i], wi] -= ni
                            nk[old[i]] -= ni.sum()
                            lp = np.log(m + alpha)
                            for c in range(int(ni.max(initial=0))):
                                lp += np.log(nkw[:, wi[ni > c]] + beta + c).sum(1)
                            lp -= np.log(nk[:, None] + beta * v + np.arange(ni.sum())).sum(1)
                            p = np.exp(lp - lp.max())
                            z = int(rng.choice(k, p=p / p.sum()))
                        else:
                            z = int(rng.integers(k))
                        new[i] = z
                        m[z] += 1
                        nkw[z, wi] += ni
                        nk[z] += ni.sum()
                    kinds = [ids.type, b.column("bag").type, pa.int32()]
                    yield pa.RecordBatch.from_arrays([ids, b.column("bag"), pa.array(new), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.binary())], names=["doc_id", "bag", "z", "slice", "part", "sums"])
                if rng is not None:
                    rows = list(sliced(np.concatenate([(m - m0)[:, None], nkw - n0], 1).ravel(), part))
                    yield pa.RecordBatch.from_arrays([*(pa.nulls(len(rows), t) for t in kinds), *slice_columns(rows)], names=["doc_id", "bag", "z", "slice", "part", "sums"])

            out = cut(state.mapInArrow(sweep, f"doc_id {key}, bag binary, z int, slice int, part bigint, sums binary"))
            change = summed(out.filter("slice is not null").select("slice", "part", "sums"), k * (v + 1)).reshape(k, v + 1)
            m, nkw = m + change[:, 0], nkw + change[:, 1:]
            if it:
                drop(last)
            state, last = out.filter("slice is null").drop("slice", "part", "sums"), out
            held.unpersist()
            self.cluster_counts.append(int((m > 0.5).sum()))
        self.sizes = m
        self.topic_word = (nkw + beta) / (nkw.sum(1, keepdims=True) + beta * v)
        self.doc_cluster = state.select("doc_id", "z")
        return self

    def doc_topic(self) -> DataFrame:
        """(doc_id, topic, p): 1 for a document's cluster."""
        from pyspark.sql import functions as F

        topics = F.explode(F.array(*[F.lit(k) for k in range(self.num_topics)])).alias("topic")
        return self.doc_cluster.select("doc_id", "z", topics).select("doc_id", "topic", (F.col("z") == F.col("topic")).cast("double").alias("p"))
