"""Topics with a response, and pseudo-documents for short texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import digamma, lgamma
from ..functions.session import cut
from .base import Encoded, TopicModel
from .engine import Rounds, bags, block_ids, block_rows, blocks_of, by_word, listed, ranked, sums_over, within
from .gibbs import counting, redrawn


#: Cells of documents that are worked on at once, so that they stay in the processor's cache.
CELLS = 8192


def response_step(like, n, doc, count, eta, sigma2, alpha, y=None, steps: int = 15):
    """(gamma (D, K), phi (cells, K)): variational shares of documents and cells; with ``y`` the response pulls on them.

    The cells of a document stand together.  A document whose ``y`` is NaN is not pulled.
    """
    k, per, total = like.shape[1], np.bincount(doc, minlength=count), np.bincount(doc, n, count)
    like, ends, lo = like.T, np.r_[0, np.cumsum(per)], 0
    gamma, phi = np.empty((count, k)), np.empty((k, len(doc)))
    while lo < count:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + CELLS, "right")) - 1)
        c = slice(ends[lo], ends[hi])
        sums, phi[:, c] = _response_cells(like[:, c], n[c], per[lo:hi], total[lo:hi], eta, sigma2, alpha, None if y is None else y[lo:hi], steps)
        gamma[lo:hi] = alpha + sums.T
        lo = hi
    return gamma, phi.T


def _response_cells(like, n, per, total, eta, sigma2, alpha, y, steps):
    """(sums of the documents (K, D), phi (K, cells)); topics come first, so that sums over them run along rows."""
    k, has = len(like), per > 0
    doc, first = np.repeat(np.arange(len(per)), per), (np.cumsum(per) - per)[has]
    prior = np.broadcast_to(np.asarray(alpha, float), (k,))[:, None]
    sums, phi = np.repeat(total[None] / k, k, 0), np.full(like.shape, 1 / k)
    like = np.maximum(like, 1e-300)
    fine = like.min(initial=1) > 1e-150
    if y is not None:
        seen, m = np.isfinite(y), np.maximum(total, 1)
        pull, inv, e = np.where(seen, y, 0) / (m * sigma2), seen / (m * m * sigma2), np.asarray(eta, float)[:, None]
        most = np.abs(e).max(initial=0)
    for _ in range(steps):
        level, own = digamma(prior + sums), None
        if y is not None:
            level += e * (pull - inv * (eta @ sums)) - e * e * (inv / 2)
            own = (eta @ phi) * inv[doc]
        level -= level.max(0)
        if fine and level.min(initial=0) > -300 and (own is None or np.abs(own).max(initial=0) * most < 200):
            x = np.take(np.exp(level), doc, 1)
            x *= like
            if own is not None:
                x *= np.exp(e * own)
        else:  # a product could leave the range of numbers
            x = level[:, doc] + np.log(like)
            if own is not None:
                x += e * own
            x -= x.max(0)
            np.exp(x, x)
        x /= x.sum(0)
        phi = x
        if len(first):
            sums[:, has] = np.add.reduceat(phi * n, first, axis=1)
    return sums, phi


class SupervisedLDA(TopicModel):
    """LDA whose topics also explain a response: y ~ N(eta . mean topic share, sigma2), by variational EM.

    A document without a response takes part in the topics only.
    """

    family = "dirichlet"

    def __init__(self, num_topics: int, *, alpha: float = 0.1, seed: int = 42):
        self.num_topics, self._alpha, self.seed = num_topics, alpha, seed
        self.alpha = np.full(num_topics, alpha)

    def fit(self, docs: DataFrame, y: DataFrame, *, iters: int = 25, var_iters: int = 15, min_doc_freq: int = 1, parts: int | None = None, convergence_tol: float = 0.0) -> "SupervisedLDA":
        """``y`` (doc_id, y)."""
        from .dirichlet import LDA

        enc = docs if isinstance(docs, Encoded) else Encoded(docs, min_doc_freq, parts=parts)
        enc.check(self.num_topics)
        self._encoded(enc)
        k, v, alpha = self.num_topics, len(enc.terms), self._alpha
        data = cut(enc.docs.join(y.select("doc_id", F.col("y").cast("double").alias("y")), "doc_id", "left").repartition(enc.parts, "doc_id").sortWithinPartitions("doc_id"))
        beta = LDA(k, alpha_sum=k * alpha, seed=self.seed).fit(enc, iters=15).topic_word
        eta, sigma2, last = np.zeros(k), 1.0, None

        def shares(b, beta, eta, sigma2):
            per, w, n = bags(b)
            doc, n = np.repeat(np.arange(len(per)), per), n.astype(float)
            y = b.column("y").to_numpy(zero_copy_only=False).astype(float)
            seen = np.isfinite(y)
            return per, w, n, doc, y, seen, *response_step(beta[:, w].T, n, doc, len(per), eta, sigma2, alpha, y if seen.any() else None, var_iters)

        # a round begins anew from beta, so documents keep no state between rounds
        def part(b, held):
            per, w, n, doc, y, seen, gamma, phi = shares(b, *held.value)
            total, z = np.bincount(doc, n, len(per)), gamma - alpha
            use = seen & (total > 0)
            zb = z[use] / total[use, None]
            cell = use[doc]
            inv = 1 / np.maximum(total, 1) ** 2
            second = zb.T @ zb - (phi[cell] * (n[cell] * inv[doc[cell]])[:, None]).T @ phi[cell] + np.diag((z[use] * inv[use, None]).sum(0))
            return np.concatenate([by_word(w, phi * n[:, None], v).ravel(), second.ravel(), y[use] @ zb, [(y[use] ** 2).sum(), use.sum()]])

        self.bound_history = []
        for _ in range(iters):
            held = self.spark.sparkContext.broadcast((beta, eta, sigma2))
            got = sums_over(data, ["doc_id", "bag", "y"], lambda b, held=held: part(b, held), k * v + k * k + k + 2)
            if last is not None:
                last.unpersist()
            last = held
            ss, m, b, tail = np.split(got, np.cumsum([k * v, k * k, k]))
            ss = ss.reshape(k, v) + 1e-6
            beta = ss / ss.sum(1, keepdims=True)
            if tail[1]:
                eta = np.linalg.solve(m.reshape(k, k) + 1e-6 * np.eye(k), b)
                sigma2 = max((tail[0] - eta @ b) / tail[1], 1e-6)
            self.bound_history.append(-0.5 * float(tail[1] * np.log(2 * np.pi * sigma2) + tail[1]))
            if convergence_tol and len(self.bound_history) > 1 and abs(self.bound_history[-1] - self.bound_history[-2]) < convergence_tol * (abs(self.bound_history[-2]) + 1e-12):
                break

        def run(batches):
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id"), listed(shares(b, *last.value)[6])], names=["doc_id", "gamma"])

        state = data.select("doc_id", "bag", "y").mapInArrow(run, f"doc_id {dict(data.dtypes)['doc_id']}, gamma array<double>")
        self.topic_word, self.coefficients, self.sigma2, self._state, self._wordless = beta, eta, sigma2, state, enc.wordless()
        return self

    def doc_topic(self) -> DataFrame:
        """(doc_id, topic, p): variational means; a document without a kept word has the prior's."""
        every = self._state.select("doc_id", "gamma").unionByName(self._wordless.withColumn("gamma", F.array_repeat(F.lit(float(self._alpha)), self.num_topics)))
        total = F.aggregate("gamma", F.lit(0.0), lambda s, x: s + x)
        return every.select("doc_id", F.posexplode(F.transform("gamma", lambda x: x / total)).alias("topic", "p"))

    def predict(self, docs: DataFrame, var_iters: int = 20) -> DataFrame:
        """(doc_id, y): eta . mean topic share of other documents; 0 for one without a known word."""
        held = docs.sparkSession.sparkContext.broadcast((self.topic_word, list(self.vocabulary), self.coefficients, self.sigma2, self._alpha))

        def run(batches):
            beta, terms, eta, sigma2, alpha = held.value
            known = pa.array(terms, pa.string())
            for b in batches:
                if not b.num_rows:
                    continue
                t = b.column("tokens")
                code = pc.index_in(t.flatten(), known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                doc = np.repeat(np.arange(b.num_rows), np.diff(t.offsets.to_numpy()))[code >= 0]
                key, n = np.unique((doc << 32) | code[code >= 0], return_counts=True)
                doc, w, n = key >> 32, key & 0xFFFFFFFF, n.astype(float)
                gamma, _ = response_step(beta[:, w].T, n, doc, b.num_rows, eta, sigma2, alpha, None, var_iters)
                z, total = gamma - alpha, np.bincount(doc, n, b.num_rows)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.where(total > 0, z @ eta / np.maximum(total, 1e-300), 0.0))], names=["doc_id", "y"])

        return docs.select("doc_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, y double")


def rehomed(size: np.ndarray, at: np.ndarray, pseudo: np.ndarray, alpha: float, rng) -> np.ndarray:
    """New pseudo-documents of texts with topic counts ``size`` (D, K), now at ``at``; their tokens move in ``pseudo`` (P, K).

    A block of texts is drawn at once given all tokens but a text's own: at least 32 texts, and more as long as they hold
    less than a thousandth of the tokens.
    """
    at, (p, k), lo, total = at.copy(), pseudo.shape, 0, size.sum(1)
    ends, most = np.r_[0, np.cumsum(total)], pseudo.sum() / 1000
    while lo < len(at):
        hi = min(max(lo + 32, int(np.searchsorted(ends, ends[lo] + most, "right")) - 1), lo + 4096, len(at))
        n, home, rows = size[lo:hi], at[lo:hi], np.arange(hi - lo)
        every, m = np.maximum(pseudo, 0), total[lo:hi]
        # logs of rising factorials by number of tokens, and of falling ones where a text's own tokens are among the counts
        lp = np.zeros((hi - lo, p))
        own = np.zeros(hi - lo)
        for j in range(k + 1):
            count, base, more = (every[:, j], alpha, n[:, j]) if j < k else (every.sum(1), k * alpha, m)
            steps, sign = np.arange(int(more.max(initial=0))), 1 if j < k else -1
            up = np.vstack([np.zeros((1, p)), np.cumsum(np.log(steps[:, None] + count + base), 0)])
            down = np.vstack([np.zeros((1, p)), np.cumsum(np.log(np.maximum(count - steps[:, None] - 1, 0) + base), 0)])
            lp += sign * up.take(more, 0)
            own += sign * down[more, home]
        lp[rows, home] = own
        up = np.cumsum(np.exp(lp - lp.max(1, keepdims=True)), 1)
        pick = np.minimum((up <= rng.random((hi - lo, 1)) * up[:, -1:]).sum(1), p - 1)
        np.subtract.at(pseudo, home, n)
        np.add.at(pseudo, pick, n)
        at[lo:hi], lo = pick, hi
    return at


class PT(TopicModel):
    """Pseudo-document topics for short texts: every text belongs to one of ``num_pseudo`` pseudo-documents, which have the topic shares.

    A sweep redraws the tokens' topics given the pseudo-documents' counts, then every text's pseudo-document; tasks work on
    the counts of the last sweep and their own changes.
    """

    family = "dirichlet"

    def __init__(self, num_topics: int, *, num_pseudo: int = 100, alpha: float = 0.1, beta: float = 0.01, seed: int = 42):
        self.num_topics, self.num_pseudo, self._alpha, self.beta, self.seed = num_topics, num_pseudo, alpha, beta, seed
        self.alpha = np.full(num_topics, alpha)

    def fit(self, docs: DataFrame, *, iters: int = 100, min_doc_freq: int = 1, parts: int | None = None, keep_theta_draws: int = 0, thin: int = 5) -> "PT":
        enc = docs if isinstance(docs, Encoded) else Encoded(docs, min_doc_freq, parts=parts)
        enc.check(self.num_topics)
        self._encoded(enc)
        k, v, p, alpha, beta = self.num_topics, len(enc.terms), self.num_pseudo, self._alpha, self.beta
        rounds = Rounds(blocks_of(enc.docs, v), {"g": "binary", "pseudo": "binary"}, self.seed)
        kind = np.uint8 if k <= 256 else np.int32

        def kernel(b, sh, rng, sums):
            g, homes = [], []
            if "g" in b.schema.names and "mine" not in sh:
                table = sh["words"] + beta
                sh["mine"] = [np.ascontiguousarray(table.T, counting(table.max(initial=0))), table.sum(1), sh["pseudo"].copy()]
            for i, per, w in block_rows(b, v):
                order, left = ranked(per)
                doc = order[within(left)]
                if "mine" not in sh:
                    at, new = rng.integers(0, p, len(per)), rng.integers(0, k, len(w))
                else:
                    words, total, pseudo = sh["mine"]
                    old = np.frombuffer(b.column("g")[i].as_buffer(), kind).astype(np.int64)
                    was = np.frombuffer(b.column("pseudo")[i].as_buffer(), np.int32).astype(np.int64)
                    new, sh["mine"][1] = redrawn(w, old, per, words, total, np.full(k, alpha), rng, pseudo, was)
                    size = np.bincount(doc * k + new, minlength=len(per) * k).reshape(-1, k)
                    at = rehomed(size, was, pseudo, alpha, rng)
                    sums[: k * v] -= np.bincount(old * v + w, minlength=k * v)
                    sums[k * v :] -= np.bincount(was[doc] * k + old, minlength=p * k)
                sums[: k * v] += np.bincount(new * v + w, minlength=k * v)
                sums[k * v :] += np.bincount(at[doc] * k + new, minlength=p * k)
                g.append(new.astype(kind).tobytes())
                homes.append(at.astype(np.int32).tobytes())
            return {"g": pa.array(g, pa.binary()), "pseudo": pa.array(homes, pa.binary())}

        def placed():
            """(doc_id, pseudo)"""

            def run(batches):
                for b in batches:
                    for i in range(b.num_rows):
                        at = np.frombuffer(b.column("pseudo")[i].as_buffer(), np.int32)
                        yield pa.RecordBatch.from_arrays([block_ids(b, i), pa.array(at)], names=["doc_id", "pseudo"])

            return rounds.state.mapInArrow(run, f"doc_id {dict(rounds.state.dtypes)['doc_id']}, pseudo int")

        words, pseudo, draws = np.zeros((k, v)), np.zeros((p, k)), []
        self.log_likelihood_history = []
        for it in range(iters):
            got = rounds.step(kernel, {"words": words, "pseudo": pseudo}, k * v + p * k)
            words, pseudo = np.maximum(words + got[: k * v].reshape(k, v), 0), np.maximum(pseudo + got[k * v :].reshape(p, k), 0)
            a = words + beta
            self.log_likelihood_history.append(float((lgamma(a) - lgamma(np.full(1, beta))).sum() - (lgamma(a.sum(1)) - lgamma(np.full(1, v * beta))).sum()))
            if keep_theta_draws and it >= iters - keep_theta_draws * thin and (it - iters) % thin == 0:
                draws.append((pseudo.copy(), cut(placed())))
        self.topic_word = (words + beta) / (words.sum(1, keepdims=True) + v * beta)
        self.pseudo_topic = (pseudo + alpha) / (pseudo.sum(1, keepdims=True) + k * alpha)
        self._state, self._wordless = placed(), enc.wordless()
        if draws:
            rows = None
            for i, (q, at) in enumerate(draws):
                one = self._shares(at, (q + alpha) / (q.sum(1, keepdims=True) + k * alpha)).withColumn("draw", F.lit(i))
                rows = one if rows is None else rows.unionByName(one)
            self.theta_draws = rows.select("draw", "doc_id", "topic", "p")
        return self

    def _shares(self, at: DataFrame, pseudo_topic: np.ndarray) -> DataFrame:
        table = self.spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(pseudo_topic)], "pseudo int, t array<double>")
        return at.join(F.broadcast(table), "pseudo").select("doc_id", F.posexplode("t").alias("topic", "p"))

    def doc_topic(self) -> DataFrame:
        """(doc_id, topic, p): the shares of a text's pseudo-document; equal ones without a kept word."""
        empty = self._wordless.select("doc_id", F.posexplode(F.array_repeat(F.lit(1 / self.num_topics), self.num_topics)).alias("topic", "p"))
        return self._shares(self._state.select("doc_id", "pseudo"), self.pseudo_topic).unionByName(empty)
