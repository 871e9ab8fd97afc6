"""Dirichlet topic models by distributed collapsed Gibbs sampling over cells (document, word).

One sweep serves all of them: the distinct words of a document are redrawn in turn, for all documents of a batch
at once; the tokens of a cell are drawn together given all others.  A model says how many states a token can have,
which topic each state counts for, and what weights a document and a word give to the states.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import digamma, lbfgs, lgamma, minka_steps, prior_terms
from ..functions.session import cut
from .base import Encoded, TopicModel
from .engine import Rounds, bags, by_doc, by_word, listed, matrix_of, packed_tokens, ranked, sums_over, token_counts, unpacked_tokens, within


def document_prior(sh: dict, x: np.ndarray | None, rows: int) -> np.ndarray:
    """(rows, K) Dirichlet parameters: shared, shifted by offsets, log-linear in covariates, or by time state."""
    kind = sh["prior_kind"]
    if kind == "shared":
        return np.broadcast_to(sh["alpha"], (rows, len(sh["alpha"])))
    if kind == "offset":
        return sh["alpha"] + x
    if kind == "loglinear":
        return np.exp(np.clip(x @ sh["coef"].T, -30, 30))
    return sh["by_time"][x[:, 0].astype(int)]


def _lda_words(sh, own, w, d, table, total):
    """``table`` and ``total`` hold the prior too."""
    return np.maximum(table[w] - own, 1e-12) / np.maximum(total - own, 1e-12)


def _key_words(sh, own, w, d, table, total):
    """States 0 .. K - 1 draw from all words, K .. 2 K - 1 from a topic's keywords; the switch is integrated out."""
    k, v = len(total) // 2, len(table)
    if "_of_topic" not in sh:
        sh["_of_topic"] = np.ascontiguousarray(sh["keywords"].T, float)
    n0, n1 = np.maximum(total[:k] - own[:, :k], 0), np.maximum(total[k:] - own[:, k:], 0)
    size, mine = sh["_of_topic"].sum(0), np.maximum(table[w] - own, 0)
    both = n0 + n1 + sh["gamma1"] + sh["gamma2"]
    plain = (mine[:, :k] + sh["beta"]) / (n0 + v * sh["beta"]) * np.where(size > 0, (n0 + sh["gamma2"]) / both, 1.0)
    key = (mine[:, k:] + sh["beta_key"]) / (n1 + np.maximum(size, 1) * sh["beta_key"]) * (n1 + sh["gamma1"]) / both
    return np.concatenate([plain, key * sh["_of_topic"][w]], 1)


def _group_words(sh, own, w, d, table, total):
    return sh["group_beta"][:, sh["_group"][d], w].T


def _plain_docs(sh, nd, alpha):
    return nd + alpha


def _key_docs(sh, nd, alpha):
    k = alpha.shape[1]
    both = nd[:, :k] + nd[:, k:] + alpha
    return np.concatenate([both, both], 1)


def _pa_docs(sh, nd, alpha):
    s, k = sh["sub_alpha"].shape
    n = nd.reshape(len(nd), s, k)
    by_super = n.sum(2)
    a = sh["sub_alpha"]
    return ((by_super + alpha)[:, :, None] * (n + a) / (by_super[:, :, None] + a.sum(1)[:, None])).reshape(len(nd), s * k)


WORDS = {"lda": _lda_words, "key": _key_words, "group": _group_words}
DOCS = {"lda": _plain_docs, "key": _key_docs, "pa": _pa_docs}


def _drawn(p: np.ndarray, of: np.ndarray, rng) -> np.ndarray:
    """A state for every token with the weights ``p`` of its cell, ``of``."""
    up = np.cumsum(p, 1)[of]
    return np.minimum((up <= (rng.random(len(of)) * (1 - 1e-12) * up[:, -1])[:, None]).sum(1), p.shape[1] - 1)


def upto(states: int) -> np.ndarray:
    """(states, states) that adds the weights of all states up to each."""
    return np.tril(np.ones((states, states)))


def picked(up: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A state for every column of summed weights (states, tokens); ``u`` are uniform draws."""
    below = up <= u * up[-1]
    return np.minimum(below.view(np.uint8).sum(0, dtype=np.uint8 if len(up) < 256 else np.int32), len(up) - 1)


def redrawn(w, z, per, table, total, alpha, rng, pseudo=None, home=None):
    """New states of the tokens ``z``, one token of every document at a time, in the order of ``engine.by_rank``.

    Every token is drawn given all others.  ``table`` (V, K) and ``total`` (K,) hold the prior.  Documents count their own
    tokens; with ``home`` those of their pseudo-document, in rows of ``pseudo`` (P, K).  ``pseudo`` and the table are
    changed, the latter whenever a thousandth of all tokens has moved.
    """
    k, (order, left), kind = table.shape[1], ranked(per), table.dtype.type
    z, new, one, end, base = z.astype(np.int64), np.empty(len(z), np.int64), kind(1), 0, np.arange(len(per)) * k
    prior, words, chance = np.tile(alpha.astype(kind), (len(per), 1)), table.reshape(-1), rng.random(len(z), dtype=np.float32).astype(kind, copy=False)
    later, waiting, most, add = [], 0, total.sum() / 1000, upto(k)

    def moves():
        # what left a cell is numbered behind what came to it
        both = np.bincount(np.concatenate(later), minlength=2 * words.size).reshape(2, -1)
        np.add(words, both[0] - both[1], words, casting="same_kind")

    if home is None:
        nd = np.bincount(within(left) * k + z, minlength=len(per) * k).astype(kind).reshape(-1, k)
        flat = nd.reshape(-1)
    else:
        at, flat = home[order], pseudo.reshape(-1)
    for m in left:
        s = slice(end, end + m)
        end += m
        was, word = z[s], w[s]
        own = base[:m] + was
        if home is None:
            flat[own] -= one
            p = nd[:m] + prior[:m]
        else:
            p = pseudo.take(at[:m], 0)
            p.reshape(-1)[own] -= one
            p += prior[:m]
        like = table.take(word, 0)
        # the token itself leaves its word and its topic
        like.reshape(-1)[own] = np.maximum(like.reshape(-1)[own] - one, kind(1e-12)) * (total / np.maximum(total - 1, 1e-12)).astype(kind)[was]
        p *= like
        got = picked(np.matmul((add * (total.mean() / total)).astype(kind), p.T), chance[s])
        new[s] = got
        far = np.nonzero(got != was)[0]
        to, back, row = got[far].astype(np.int64), was[far], word[far].astype(np.int64) * k
        if home is None:
            flat[base[:m] + got] += one
        else:
            pseudo += (np.bincount(at[far] * k + to, minlength=pseudo.size) - np.bincount(at[far] * k + back, minlength=pseudo.size)).reshape(pseudo.shape)
        later += [row + to, row + back + words.size]
        waiting += len(far)
        if waiting > most:
            moves()
            later, waiting = [], 0
        total = total + np.bincount(to, minlength=k) - np.bincount(back, minlength=k)
    if later:
        moves()
    return new, total


def counting(largest: float):
    """The narrower kind of numbers in which counts up to ``largest`` can be added up one by one."""
    return np.float32 if largest < 1 << 22 else np.float64


def sweep(sh: dict, per, w, n, old, x, mask, rng, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(new states of the tokens, new document sizes (D, S)) of a batch; the change of the topic-word table is added to ``sums``.

    Tokens are in order of their cells.  ``old`` None draws a start, ``mask`` None allows every state.
    ``sh["local"]`` keeps the task's own view of the table, by word, between its batches.
    """
    states, topic, v = sh["states"], sh["topic"], sh["width"]
    topics = int(topic.max()) + 1
    words, docs = WORDS[sh["words"]], DOCS[sh["docs"]]
    if "local" not in sh and sh["table"] is not None:
        sh["local"] = np.ascontiguousarray((sh["table"] + (sh["beta"] if sh["words"] == "lda" else 0)).T)
    scaled = sh.get("scale") is not None
    to_topic = (lambda c: c) if topics == states else (lambda c: c.reshape(len(c), -1, topics).sum(1))
    doc, of = np.repeat(np.arange(len(per)), per), np.repeat(np.arange(len(w)), n)
    weight = sh["scale"][w[of]] if scaled else np.ones(len(of))
    if old is None:
        p = words(sh, np.zeros((len(w), states)), w, doc, np.zeros((v, topics)), np.zeros(topics)) if sh["words"] == "key" else sh["start"][:, w].T
        p = p if mask is None else p * mask[doc]
        new = np.repeat(np.tile(np.arange(states), len(w)), rng.multinomial(n, p / p.sum(1, keepdims=True)).ravel())
    else:
        table, total = sh["local"], sh["local"].sum(0)
        # longest documents first: those with a word of rank j, and these words, are slices then
        order = np.argsort(-per, kind="stable")
        first, left = (np.cumsum(per) - per)[order], np.searchsorted(-per[order], -np.arange(int(per.max(initial=0))), side="left")
        cells = np.concatenate([first[:m] + j for j, m in enumerate(left)]) if len(left) else np.zeros(0, int)
        times = n[cells]
        ends, t_ends = np.cumsum(left), np.r_[0, np.cumsum(times)]
        tokens = np.repeat((np.cumsum(n) - n)[cells] - t_ends[:-1], times) + np.arange(len(of))
        z, at, held, ws = old[tokens], np.repeat(np.arange(len(cells)), times), weight[tokens], w[cells]
        nd = np.bincount(doc[of] * states + old, weight, len(per) * states).reshape(-1, states)[order]
        alpha = document_prior(sh, x, len(per))[order]
        allowed = None if mask is None else mask[order]
        if sh["words"] == "group":
            sh["_group"] = x[order, -1].astype(int)
        for m, end in zip(left, ends):
            lo, hi = t_ends[end - m], t_ends[end]
            here, wj, zj, tj = at[lo:hi] - (end - m), ws[end - m : end], z[lo:hi], held[lo:hi]
            own = np.bincount(here * states + zj, tj, m * states).reshape(m, states)
            nd[:m] -= own
            like = words(sh, to_topic(own), wj, slice(0, m), table, total)
            if topics != states:
                like = np.tile(like, (1, states // topics))
            p = docs(sh, np.maximum(nd[:m], 0), alpha[:m]) * like
            got = _drawn(p if allowed is None else p * allowed[:m], here, rng)
            nd[:m] += np.bincount(here * states + got, tj, m * states).reshape(m, states)
            moved = np.nonzero(topic[got] != topic[zj])[0]
            word, to, back, by = wj[here[moved]].astype(np.int64) * topics, topic[got[moved]], topic[zj[moved]], tj[moved]
            np.add.at(table.reshape(-1), word + to, by)
            np.subtract.at(table.reshape(-1), word + back, by)
            total = total + np.bincount(to, by, topics) - np.bincount(back, by, topics)
            z[lo:hi] = got
        new = np.empty_like(old)
        new[tokens] = z
    cell = w[of]
    sums[: topics * v] += np.bincount(topic[new] * v + cell, weight, topics * v)
    if old is not None:
        sums[: topics * v] -= np.bincount(topic[old] * v + cell, weight, topics * v)
    return new, np.bincount(doc[of] * states + new, weight, len(per) * states).reshape(-1, states)


class CellModel(TopicModel):
    """A sampler over cells.  Subclasses set ``words``, ``docs``, ``states``, ``topic`` and update hyper-parameters in ``after``."""

    family = "dirichlet"
    words, docs = "lda", "lda"

    def __init__(self, num_topics: int, *, alpha: float = 0.1, beta: float = 0.01, seed: int = 42):
        if num_topics < 1:
            raise ValueError("num_topics must be positive")
        self.num_topics, self.beta, self.seed = num_topics, beta, seed
        self.alpha = np.full(num_topics, float(alpha))
        self.fit_history: list[tuple[int, float]] = []
        self.converged = None

    # what subclasses may change
    def layout(self) -> tuple[int, np.ndarray]:
        """(states, topic of each state)."""
        return self.num_topics, np.arange(self.num_topics)

    def word_prior(self) -> np.ndarray:
        return np.full((self.num_topics, len(self.vocabulary)), self.beta)

    def shared(self) -> dict:
        return {}

    def after(self, it: int, rounds: Rounds, iters: int) -> None:
        """Updates of hyper-parameters after a sweep."""

    def fit(self, docs: DataFrame, side: DataFrame | None = None, *, iters: int = 100, min_doc_freq: int = 1, max_doc_fraction: float = 1.0, parts: int | None = None, num_samples: int = 0, sample_interval: int = 5, keep_theta_draws: bool = False, progress=None) -> "CellModel":
        """``side`` (doc_id, x ARRAY<DOUBLE>[, topics ARRAY<INT>]): a document's covariates and the topics it may have.

        Documents without a row get zeros and may have every topic.  ``num_samples`` snapshots ``sample_interval`` sweeps
        apart are averaged after ``iters`` sweeps; ``keep_theta_draws`` keeps theirs.
        """
        enc = docs if isinstance(docs, Encoded) else Encoded(docs, min_doc_freq, max_doc_fraction, parts)
        self._encoded(enc)
        states, topic = self.layout()
        topics, v = int(topic.max()) + 1, len(self.vocabulary)
        enc.check(states)
        state = enc.docs
        limited = side is not None and "topics" in side.columns
        width = 0
        if side is not None:
            width = side.agg(F.max(F.size("x"))).first()[0] or 0
            # every document meets its covariates here, so the rows are checked for length once
            x = F.when(F.size("x") == width, F.col("x")).otherwise(F.array_repeat(F.lit(0.0), width)).alias("x")
            state = state.join(side.select("doc_id", F.col("x").cast("array<double>").alias("x"), *(["topics"] if limited else [])), "doc_id", "left").withColumn("x", F.coalesce("x", F.array_repeat(F.lit(0.0), width)))
            state = state.select("doc_id", "bag", x, *(["topics"] if limited else [])).repartition(enc.parts, "doc_id").sortWithinPartitions("doc_id")
            state = cut(state)
        rounds = Rounds(state, {"g": "binary", "size": "array<double>"}, self.seed)
        prior = self.word_prior()
        self._width, self._counts, phi, taken, draws = width, np.zeros((topics, v)), 0.0, 0, []
        base = {"states": states, "topic": topic, "width": v, "words": self.words, "docs": self.docs, "beta": prior if self.words != "key" else self.beta, "beta_sum": prior.sum(1), "start": np.tile(prior, (states // len(prior), 1)) if len(prior) < states else prior}

        def kernel(b, sh, rng, sums, states=states, width=width, limited=limited):
            per, w, n = bags(b)
            old = unpacked_tokens(b.column("g"), states) if "g" in b.schema.names else None
            x = matrix_of(b.column("x"), width) if width else None
            mask = None
            if limited:
                mask = np.ones((len(per), states))
                for i, t in enumerate(b.column("topics").to_pylist()):
                    if t:
                        mask[i] = 0
                        mask[i, t] = 1
            new, size = sweep(sh, per, w, n, old, x, mask, rng, sums)
            return {"g": packed_tokens(new, by_doc(n, per).astype(np.int64), states), "size": listed(size)}

        total = iters + num_samples * sample_interval
        for it in range(total):
            sh = base | {"prior_kind": "shared", "alpha": self.alpha} | self.shared() | {"table": self._counts if it else None}
            self._counts = np.maximum(self._counts + rounds.step(kernel, sh, topics * v).reshape(topics, v), 0.0)
            self.after(it, rounds, iters)
            if it % 10 == 0 or it == total - 1:
                self.fit_history.append((it, self.log_likelihood()))
            if progress:
                progress(it, self.fit_history[-1][1])
            if it >= iters and (it - iters + 1) % sample_interval == 0:
                taken += 1
                phi = phi + self.topics_of(self._counts)
                draws.append(cut(rounds.state.select(F.lit(taken - 1).alias("draw"), "doc_id", "size")))
        self._state, self._wordless = rounds.state, enc.wordless()
        self.topic_word = phi / taken if taken else self.topics_of(self._counts)
        if draws:
            every = draws[0]
            for d in draws[1:]:
                every = every.unionByName(d)
            if keep_theta_draws:
                self.theta_draws = self._shares(every.withColumn("x", F.array()) if not width else every.join(rounds.state.select("doc_id", "x"), "doc_id"), ["draw", "doc_id"])
        return self

    def topics_of(self, counts: np.ndarray) -> np.ndarray:
        p = counts + self.word_prior()
        return p / p.sum(1, keepdims=True)

    def topic_sizes_of(self, size):
        """Column of the K topic sizes of a document from its S state sizes."""
        return size

    def log_likelihood(self) -> float:
        """Log joint of the words given the topics under the prior."""
        b = self.word_prior()
        if b.shape != self._counts.shape:
            b = np.full(self._counts.shape, self.beta)
        a = self._counts + b
        return float((lgamma(a) - lgamma(b)).sum() - (lgamma(a.sum(1)) - lgamma(b.sum(1))).sum())

    def _prior_column(self):
        """Column of the K prior parameters of a document, from ``x`` where the prior depends on it."""
        return F.array(*[F.lit(float(a)) for a in self.alpha])

    def _shares(self, sizes: DataFrame, keys: list[str]) -> DataFrame:
        p = F.zip_with(self.topic_sizes_of(F.col("size")), self._prior_column(), lambda a, b: a + b)
        total = F.aggregate(p, F.lit(0.0), lambda s, y: s + y)
        return sizes.select(*keys, F.posexplode(F.transform(p, lambda y: y / total)).alias("topic", "p"))

    def doc_topic(self) -> DataFrame:
        """(doc_id, topic, p); a document without a kept word gets its prior."""
        empty = self._wordless.withColumn("size", F.array_repeat(F.lit(0.0), self.layout()[0]))
        if self._width:
            empty = empty.withColumn("x", F.array_repeat(F.lit(0.0), self._width))
            return self._shares(self._state.select("doc_id", "size", "x").unionByName(empty), ["doc_id"])
        return self._shares(self._state.select("doc_id", "size").unionByName(empty), ["doc_id"])

    def _topic_sizes(self, rounds: Rounds) -> DataFrame:
        return rounds.state.select("doc_id", self.topic_sizes_of(F.col("size")).alias("size"), *(["x"] if self._width else []))


def _dot(row, x):
    return F.aggregate(F.zip_with(F.array(*[F.lit(float(c)) for c in row]), x, lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)


def fit_loglinear(sizes: DataFrame, coef: np.ndarray, variance: np.ndarray, steps: int) -> np.ndarray:
    """Coefficients (K, F) of alpha = exp(coef x) by L-BFGS; value and gradient are summed over all documents, one job each."""
    k, f = coef.shape

    def objective(flat):
        c = flat.reshape(k, f)

        def part(b):
            x, n = matrix_of(b.column("x"), f), matrix_of(b.column("size"), k)
            a = np.exp(np.clip(x @ c.T, -30, 30))
            s, m = a.sum(1), n.sum(1)
            value = (lgamma(s) - lgamma(s + m)).sum() + (lgamma(a + n) - lgamma(a)).sum()
            slope = a * ((digamma(s) - digamma(s + m))[:, None] + digamma(a + n) - digamma(a))
            return np.r_[value, (slope.T @ x).ravel()]

        r = sums_over(sizes, ["x", "size"], part, 1 + k * f)
        return -(r[0] - 0.5 * (c * c / variance).sum()), -(r[1:].reshape(k, f) - c / variance).ravel()

    return lbfgs(objective, coef.ravel(), steps).reshape(k, f)


class DMR(CellModel):
    """Dirichlet-multinomial regression: a document's prior is exp(coef x), x with a leading 1."""

    def __init__(self, num_topics: int, *, beta: float = 0.01, optimize_interval: int = 20, burn_in: int = 20, prior_variance: float = 1.0, lbfgs_iters: int = 10, seed: int = 42):
        super().__init__(num_topics, beta=beta, seed=seed)
        self.optimize_interval, self.burn_in, self.prior_variance, self.lbfgs_iters = optimize_interval, burn_in, prior_variance, lbfgs_iters

    def fit(self, docs: DataFrame, features: DataFrame, names: list[str], **options) -> "DMR":
        """``features`` (doc_id, names ...); a document without a row, and a null, counts as 0."""
        self.feature_names = ["intercept", *names]
        one = F.array(F.lit(1.0), *[F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) for n in names]).alias("x")
        ids = docs.select("doc_id").distinct().join(features, "doc_id", "left")
        self.feature_effects = np.zeros((self.num_topics, len(names) + 1))
        self.feature_effects[:, 0] = np.log(0.1)
        return super().fit(docs, ids.select("doc_id", one), **options)

    def variance(self) -> np.ndarray:
        return np.full(self.feature_effects.shape, self.prior_variance)

    def shared(self) -> dict:
        return {"prior_kind": "loglinear", "coef": self.feature_effects}

    def after(self, it, rounds, iters):
        if it >= min(self.burn_in, iters - 1) and (it - self.burn_in) % self.optimize_interval == 0 or it == iters - 1:
            self.feature_effects = fit_loglinear(cut(self._topic_sizes(rounds)), self.feature_effects, self.variance(), self.lbfgs_iters)

    def _prior_column(self):
        return F.array(*[F.exp(F.greatest(F.least(_dot(row, F.col("x")), F.lit(30.0)), F.lit(-30.0))) for row in self.feature_effects])

    def effects_frame(self) -> DataFrame:
        """(topic, feature, lambda)."""
        return self.spark.createDataFrame([(k, n, float(v)) for k, row in enumerate(self.feature_effects) for n, v in zip(self.feature_names, row)], "topic int, feature string, lambda double")


def legendre(x: np.ndarray, degree: int) -> np.ndarray:
    """(rows, degree + 1) Legendre polynomials of x clipped to [-1, 1], by the three-term recurrence."""
    x = np.clip(np.asarray(x, float), -1, 1)
    out = [np.ones_like(x), x]
    for n in range(1, degree):
        out.append(((2 * n + 1) * x * out[n] - n * out[n - 1]) / (n + 1))
    return np.stack(out[: degree + 1], -1)


class GDMR(DMR):
    """DMR over the products of Legendre polynomials of continuous covariates."""

    def __init__(self, num_topics: int, *, degrees: list[int], sigma: float = 1.0, sigma0: float = 3.0, decay: float = 0.0, metadata_range: list[tuple[float, float]] | None = None, **options):
        super().__init__(num_topics, **options)
        self.degrees, self.sigma, self.sigma0, self.decay, self.metadata_range = list(degrees), sigma, sigma0, decay, metadata_range
        self.orders = np.stack(np.meshgrid(*[np.arange(d + 1) for d in degrees], indexing="ij"), -1).reshape(-1, len(degrees))

    def basis(self, meta: np.ndarray) -> np.ndarray:
        """(rows, products): one column for each combination of orders."""
        lo, hi = np.array(self.metadata_range, float).T
        scaled = (np.atleast_2d(meta) - lo) / np.where(hi > lo, hi - lo, 1) * 2 - 1
        polys = [legendre(scaled[:, i], d) for i, d in enumerate(self.degrees)]
        return np.prod([p[:, self.orders[:, i]] for i, p in enumerate(polys)], axis=0)

    def variance(self) -> np.ndarray:
        order = self.orders.sum(1)
        v = np.where(order == 0, self.sigma0**2, self.sigma**2 * (self.decay ** (2 * order) if self.decay else 1.0))
        return np.broadcast_to(v, self.feature_effects.shape)

    def fit(self, docs: DataFrame, metadata: DataFrame, names: list[str], **options) -> "GDMR":
        self.metadata_names = names
        if self.metadata_range is None:
            r = metadata.agg(*[f(n) for n in names for f in (F.min, F.max)]).first()
            self.metadata_range = [(float(r[2 * i]), float(r[2 * i + 1])) for i in range(len(names))]
        self.feature_names = ["*".join(f"{n}^{o}" for n, o in zip(names, row) if o) or "intercept" for row in self.orders]
        self.feature_effects = np.zeros((self.num_topics, len(self.orders)))
        self.feature_effects[:, 0] = np.log(0.1)

        @F.pandas_udf("array<double>")
        def expand(values):
            return __import__("pandas").Series(list(self_basis(np.array(values.tolist(), float))))

        self_basis = GDMR.basis.__get__(_Basis(self.metadata_range, self.degrees, self.orders))
        mid = [F.lit((a + b) / 2) for a, b in self.metadata_range]
        ids = docs.select("doc_id").distinct().join(metadata, "doc_id", "left")
        x = expand(F.array(*[F.coalesce(F.col(f"`{n}`").cast("double"), m) for n, m in zip(names, mid)])).alias("x")
        return CellModel.fit(self, docs, ids.select("doc_id", x), **options)

    def tdf(self, metadata, normalize: bool = True) -> np.ndarray:
        """(rows, K): the topic distribution the covariates call for."""
        a = np.exp(self.basis(np.asarray(metadata, float)) @ self.feature_effects.T)
        return a / a.sum(1, keepdims=True) if normalize else a

    def tdf_linspace(self, start, stop, num: int, normalize: bool = True) -> np.ndarray:
        return self.tdf(np.linspace(start, stop, num).reshape(num, -1), normalize)


class _Basis:
    def __init__(self, metadata_range, degrees, orders):
        self.metadata_range, self.degrees, self.orders = metadata_range, degrees, orders


class LabeledLDA(CellModel):
    """One topic a label; a document's tokens take its labels only, and any where it has none."""

    def __init__(self, *, alpha: float = 0.1, beta: float = 0.01, seed: int = 42):
        super().__init__(1, alpha=alpha, beta=beta, seed=seed)
        self._alpha = alpha

    def fit(self, docs: DataFrame, labels: DataFrame, **options) -> "LabeledLDA":
        """``labels`` (doc_id, labels ARRAY<STRING>)."""
        self.labels = sorted(r[0] for r in labels.select(F.explode("labels").alias("l")).filter("l is not null").distinct().collect())
        self.num_topics, self.alpha = len(self.labels), np.full(len(self.labels), self._alpha)
        self.topic_names = list(self.labels)
        at = F.create_map(*[F.lit(v) for i, name in enumerate(self.labels) for v in (name, i)])
        topics = F.transform(F.filter("labels", lambda s: s.isNotNull()), lambda s: F.try_element_at(at, s))
        return super().fit(docs, labels.select("doc_id", F.array().cast("array<double>").alias("x"), topics.alias("topics")), **options)


class SeededLDA(CellModel):
    """Topics named by seed words, whose prior is raised, and ``residual`` free ones; ``doc_topic_prior`` shifts a document's prior."""

    def __init__(self, seed_words: dict[str, list[str]], *, residual: int = 0, alpha: float = 0.1, beta: float = 0.01, weight: float = 0.01, seed: int = 42):
        super().__init__(len(seed_words) + residual, alpha=alpha, beta=beta, seed=seed)
        self.seed_words, self.weight = seed_words, weight
        self.topic_names = [*seed_words, *(f"other_{i + 1}" for i in range(residual))]

    def word_prior(self) -> np.ndarray:
        b, at = super().word_prior(), {t: i for i, t in enumerate(self.vocabulary)}
        for k, words in enumerate(self.seed_words.values()):
            hits = [at[w] for w in words if w in at]
            # the weight counts in shares of the corpus, so that it means the same for every size
            b[k, hits] += self.weight * self._tokens / max(1, self.num_topics)
        return b

    def _encoded(self, enc):
        super()._encoded(enc)
        self._tokens = int(enc.frequencies().sum())

    def fit(self, docs: DataFrame, *, doc_topic_prior: DataFrame | None = None, **options) -> "SeededLDA":
        """``doc_topic_prior`` (doc_id, x ARRAY<DOUBLE> of K offsets)."""
        self._offset = doc_topic_prior is not None
        return super().fit(docs, doc_topic_prior, **options)

    def shared(self) -> dict:
        return {"prior_kind": "offset"} if self._offset else {}

    def _prior_column(self):
        own = super()._prior_column()
        return F.zip_with(own, F.col("x"), lambda a, b: a + b) if getattr(self, "_offset", False) else own


def embedding_seeds(embeddings: DataFrame, num_topics: int, *, top_m: int = 20, seed: int = 42) -> dict[str, list[str]]:
    """Disjoint seed words of topics: the ``top_m`` words nearest each centre of the word vectors (term, vec)."""
    from ..operators.vectors import centroids, cosine
    from .embedding import kmeans_labels

    from pyspark.sql import Window as W

    v = embeddings.select(F.col("term").alias("id"), "vec")
    labels = kmeans_labels(v, num_topics, seed)
    at = v.join(labels, "id")
    near = at.join(centroids(at), "label").select("label", "id", cosine(F.col("vec"), F.col("centroid")).alias("c"))
    w = W.partitionBy("label").orderBy(F.col("c").desc(), "id")
    rows = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= top_m).orderBy("label", "r").collect()
    out: dict[str, list[str]] = {f"topic_{k}": [] for k in range(num_topics)}
    for r in rows:
        out[f"topic_{r['label']}"].append(r["id"])
    return out


def cosine_prior(doc_embeddings: DataFrame, topic_vectors: np.ndarray, anchor: float) -> DataFrame:
    """(doc_id, x): anchor x the positive part of the cosine to every topic vector, as prior offsets."""
    held = doc_embeddings.sparkSession.sparkContext.broadcast(topic_vectors / np.maximum(np.linalg.norm(topic_vectors, axis=1, keepdims=True), 1e-300))

    @F.pandas_udf("array<double>")
    def offset(vec):
        x = np.array(vec.tolist(), float)
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        return __import__("pandas").Series(list(anchor * np.maximum(x @ held.value.T, 0)))

    return doc_embeddings.select("doc_id", offset("vec").alias("x"))


class EmbeddingLDA(SeededLDA):
    """SeededLDA whose seeds are clusters of word vectors; document vectors may shift the prior."""

    def __init__(self, num_topics: int, *, top_m: int = 20, doc_anchor: float = 1.0, **options):
        super().__init__({f"topic_{k}": [] for k in range(num_topics)}, **options)
        self.top_m, self.doc_anchor = top_m, doc_anchor

    def fit(self, docs: DataFrame, word_embeddings: DataFrame, doc_embeddings: DataFrame | None = None, **options) -> "EmbeddingLDA":
        """``word_embeddings`` (term, vec), ``doc_embeddings`` (doc_id, vec) in the same space."""
        self.seed_words = embedding_seeds(word_embeddings, len(self.seed_words), top_m=self.top_m, seed=self.seed)
        prior = None
        if doc_embeddings is not None:
            prior = cosine_prior(doc_embeddings, seed_vectors(word_embeddings, self.seed_words), self.doc_anchor)
        return super().fit(docs, doc_topic_prior=prior, **options)


def seed_vectors(word_embeddings: DataFrame, seeds: dict[str, list[str]]) -> np.ndarray:
    """(K, E): mean vector of each topic's seed words."""
    rows = [(k, w) for k, ws in enumerate(seeds.values()) for w in ws]
    want = word_embeddings.sparkSession.createDataFrame(rows, "topic int, term string")
    got = {r["topic"]: r["v"] for r in word_embeddings.join(F.broadcast(want), "term").groupBy("topic").agg(F.collect_list("vec").alias("v")).collect()}
    dims = len(next(iter(got.values()))[0])
    return np.stack([np.mean(got[k], axis=0) if k in got else np.zeros(dims) for k in range(len(seeds))])


class KeyATM(CellModel):
    """Keyword-assisted topics: a token of a topic comes from its keywords (switch 1) or from all words (switch 0).

    ``keywords`` {name: words}; further topics up to ``num_topics`` have none.  ``weights``: none, information
    (-log2 f / N) or inverse (N / f) token weights.  ``covariates`` make the prior log-linear, ``timestamps`` let it
    follow a change-point chain of ``num_states`` states; not both.
    """

    words, docs = "key", "key"

    def __init__(self, keywords: dict[str, list[str]], *, num_topics: int | None = None, alpha: float = 0.1, beta: float = 0.01, beta_keyword: float = 0.1, gamma1: float = 1.0, gamma2: float = 1.0, estimate_alpha: bool = True, weights: str = "information", seed: int = 42):
        super().__init__(num_topics or len(keywords), alpha=alpha, beta=beta, seed=seed)
        if self.num_topics < len(keywords):
            raise ValueError("fewer topics than keyword sets")
        self.keywords, self.beta_keyword, self.gamma1, self.gamma2 = keywords, beta_keyword, gamma1, gamma2
        self.estimate_alpha, self.weights, self._mode = estimate_alpha, weights, "base"
        self.topic_names = [*keywords, *(f"other_{i + 1}" for i in range(self.num_topics - len(keywords)))]
        self.alpha_history, self.pi_history = [], []

    @classmethod
    def weighted_lda(cls, num_topics: int, **options) -> "KeyATM":
        """The same sampler without keywords."""
        return cls({}, num_topics=num_topics, **options)

    def layout(self):
        return 2 * self.num_topics, np.arange(2 * self.num_topics)

    def _encoded(self, enc):
        super()._encoded(enc)
        at = {t: i for i, t in enumerate(self.vocabulary)}
        self._is_key = np.zeros((self.num_topics, len(self.vocabulary)), bool)
        for k, ws in enumerate(self.keywords.values()):
            self._is_key[k, [at[w] for w in ws if w in at]] = True
        f = enc.frequencies()
        total = f.sum()
        forms = {"none": np.ones(len(f)), "information": -np.log2(np.maximum(f, 1) / max(total, 1)), "inverse": total / np.maximum(f, 1)}
        self._scale = forms[self.weights]
        # weights keep their proportions and the corpus its total
        self._scale = self._scale * total / max((self._scale * f).sum(), 1e-300)

    def fit(self, docs: DataFrame, *, covariates: DataFrame | None = None, names: list[str] | None = None, timestamps: DataFrame | None = None, num_states: int = 5, doc_offset: DataFrame | None = None, **options) -> "KeyATM":
        """``covariates`` (doc_id, names ...), ``timestamps`` (doc_id, stamp), ``doc_offset`` (doc_id, x of K offsets to the prior)."""
        if sum(s is not None for s in (covariates, timestamps, doc_offset)) > 1:
            raise ValueError("covariates, timestamps and offsets exclude each other")
        side = None
        if covariates is not None:
            self._mode, self.feature_names = "covariates", ["intercept", *names]
            x = F.array(F.lit(1.0), *[F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) for n in names]).alias("x")
            side = docs.select("doc_id").distinct().join(covariates, "doc_id", "left").select("doc_id", x)
            self.feature_effects = np.zeros((self.num_topics, len(names) + 1))
            self.feature_effects[:, 0] = np.log(self.alpha[0])
        elif timestamps is not None:
            self._mode = "dynamic"
            stamps = [r[0] for r in timestamps.select("stamp").filter("stamp is not null").distinct().orderBy("stamp").collect()]
            self.time_labels, t = stamps, len(stamps)
            at = F.create_map(*[F.lit(v) for i, s in enumerate(stamps) for v in (s, float(i))])
            side = timestamps.select("doc_id", F.array(F.coalesce(F.try_element_at(at, F.col("stamp")), F.lit(0.0))).alias("x"))
            self.num_states = min(num_states, t)
            self.time_state = np.minimum(np.arange(t) * self.num_states // t, self.num_states - 1)
            self.state_alpha = np.full((self.num_states, self.num_topics), self.alpha[0])
            self.transition_matrix = np.eye(self.num_states)
        elif doc_offset is not None:
            self._mode, side = "offset", doc_offset
        return super().fit(docs, side, **options)

    def shared(self) -> dict:
        out = {"keywords": self._is_key, "beta_key": self.beta_keyword, "gamma1": self.gamma1, "gamma2": self.gamma2, "scale": self._scale}
        if self._mode == "covariates":
            out |= {"prior_kind": "loglinear", "coef": self.feature_effects}
        elif self._mode == "dynamic":
            out |= {"prior_kind": "time", "by_time": self.state_alpha[self.time_state]}
        elif self._mode == "offset":
            out |= {"prior_kind": "offset"}
        return out

    def topic_sizes_of(self, size):
        k = self.num_topics
        return F.zip_with(F.slice(size, 1, k), F.slice(size, k + 1, k), lambda a, b: a + b)

    def after(self, it, rounds, iters):
        k = self.num_topics
        self.pi_history.append((it, self.keyword_rate()))
        if not self.estimate_alpha or it < 2 or (it % 10 and it != iters - 1):
            return
        sizes = self._topic_sizes(rounds)
        if self._mode == "covariates":
            self.feature_effects = fit_loglinear(cut(sizes), self.feature_effects, np.ones_like(self.feature_effects), 5)
        elif self._mode == "dynamic":
            self._chain(cut(sizes), it)
        elif self._mode == "base":
            s = cut(sizes)
            self.alpha = minka_steps(lambda a: sums_over(s, ["size"], lambda b: prior_terms(matrix_of(b.column("size"), k), a), k + 1), self.alpha, 3)
        self.alpha_history.append((it, self.alpha.copy() if self._mode == "base" else None))

    def _chain(self, sizes: DataFrame, it: int) -> None:
        """Forward filtering and backward sampling of the change-point path, then the states' priors and staying rates."""
        k, r, t = self.num_topics, self.num_states, len(self.time_labels)
        alpha = self.state_alpha

        def evidence(b):
            n, time = matrix_of(b.column("size"), k), matrix_of(b.column("x"), 1)[:, 0].astype(int)
            out = np.zeros((t, r))
            for s in range(r):
                a = alpha[s]
                ll = lgamma(a.sum()) - lgamma(a.sum() + n.sum(1)) + (lgamma(n + a) - lgamma(a)).sum(1)
                np.add.at(out[:, s], time, ll)
            return out.ravel()

        like = sums_over(sizes, ["x", "size"], evidence, t * r).reshape(t, r)
        rng = np.random.default_rng([self.seed, 77, it])
        stay = np.array([rng.beta(1 + (self.time_state == s).sum(), 2) for s in range(r)])
        stay[-1] = 1.0
        p = np.diag(stay) + np.diag(1 - stay[:-1], 1)
        with np.errstate(divide="ignore"):
            logp = np.log(p)
        f = np.full((t, r), -np.inf)
        f[0, 0] = like[0, 0]
        for i in range(1, t):
            f[i] = np.logaddexp.reduce(f[i - 1][:, None] + logp, axis=0) + like[i]
        path = np.zeros(t, int)
        path[-1] = r - 1 if np.isfinite(f[-1, -1]) else int(np.argmax(f[-1]))
        for i in range(t - 2, -1, -1):
            q = f[i] + logp[:, path[i + 1]]
            q = np.exp(q - q.max())
            path[i] = rng.choice(r, p=q / q.sum())
        self.time_state, self.transition_matrix = path, p

        def terms(a):
            def part(b):
                n, s = matrix_of(b.column("size"), k), path[matrix_of(b.column("x"), 1)[:, 0].astype(int)]
                return np.concatenate([prior_terms(n[s == j], a[j]) for j in range(r)])

            return sums_over(sizes, ["x", "size"], part, r * (k + 1)).reshape(r, k + 1)

        for _ in range(3):
            x = terms(self.state_alpha)
            self.state_alpha = np.where(x[:, -1:] > 0, np.maximum(self.state_alpha * x[:, :-1] / np.maximum(x[:, -1:], 1e-12), 1e-4), self.state_alpha)

    def keyword_rate(self) -> np.ndarray:
        """Share of each topic's tokens that come from its keywords."""
        k = self.num_topics
        n = self._counts.sum(1)
        return (n[k:] + self.gamma1 * self._is_key.any(1)) / np.maximum(n[:k] + n[k:] + (self.gamma1 + self.gamma2) * self._is_key.any(1), 1e-300)

    def topics_of(self, counts):
        k, v = self.num_topics, counts.shape[1]
        plain = (counts[:k] + self.beta) / (counts[:k].sum(1, keepdims=True) + v * self.beta)
        key = (counts[k:] + self.beta_keyword * self._is_key) / np.maximum(counts[k:].sum(1, keepdims=True) + self.beta_keyword * self._is_key.sum(1, keepdims=True), 1e-300)
        pi = self.keyword_rate()[:, None]
        p = np.where(self._is_key.any(1)[:, None], (1 - pi) * plain + pi * key, plain)
        return p / p.sum(1, keepdims=True)

    def _prior_column(self):
        if self._mode == "covariates":
            return F.array(*[F.exp(_dot(row, F.col("x"))) for row in self.feature_effects])
        if self._mode == "offset":
            return F.zip_with(super()._prior_column(), F.col("x"), lambda a, b: a + b)
        if self._mode == "dynamic":
            rows = F.array(*[F.array(*[F.lit(float(a)) for a in self.state_alpha[s]]) for s in self.time_state])
            return F.element_at(rows, F.col("x")[0].cast("int") + 1)
        return super()._prior_column()

    def time_prevalence(self) -> DataFrame:
        """(stamp, state, topic, prevalence): the prior share of every topic at each time."""
        rows = [(str(s), int(z), k, float(a)) for s, z in zip(self.time_labels, self.time_state) for k, a in enumerate(self.state_alpha[z] / self.state_alpha[z].sum())]
        return self.spark.createDataFrame(rows, "stamp string, state int, topic int, prevalence double")


class EmbeddingKeyATM(KeyATM):
    """KeyATM whose prior is shifted by the cosine of document vectors to the mean vectors of the keywords."""

    def fit(self, docs: DataFrame, word_embeddings: DataFrame, doc_embeddings: DataFrame, *, doc_anchor: float = 1.0, **options) -> "EmbeddingKeyATM":
        seeds = {n: self.keywords.get(n, []) for n in self.topic_names}
        return super().fit(docs, doc_offset=cosine_prior(doc_embeddings, seed_vectors(word_embeddings, seeds), doc_anchor), **options)


class PA(CellModel):
    """Pachinko allocation: a token takes a super-topic and below it a sub-topic.

    The weights below each super-topic are matched to the mean of the documents' shares at a fixed concentration of 4 K alpha.
    """

    docs = "pa"

    def __init__(self, num_super: int, num_sub: int, *, alpha: float = 0.1, beta: float = 0.01, seed: int = 42):
        super().__init__(num_sub, alpha=alpha, beta=beta, seed=seed)
        self.num_super, self.num_sub, self._alpha = num_super, num_sub, alpha
        self.sub_alpha = np.full((num_super, num_sub), alpha)

    def layout(self):
        return self.num_super * self.num_sub, np.tile(np.arange(self.num_sub), self.num_super)

    def shared(self):
        return {"alpha": np.full(self.num_super, self._alpha), "sub_alpha": self.sub_alpha}

    def topic_sizes_of(self, size):
        k = self.num_sub
        out = F.slice(size, 1, k)
        for s in range(1, self.num_super):
            out = F.zip_with(out, F.slice(size, s * k + 1, k), lambda a, b: a + b)
        return out

    def after(self, it, rounds, iters):
        if it and it % 5 == 0 or it == iters - 1:
            s, k = self.num_super, self.num_sub

            def shares(b):
                n = matrix_of(b.column("size"), s * k).reshape(-1, s, k)
                return np.concatenate([n.sum(0).ravel(), (n / np.maximum(n.sum(2, keepdims=True), 1)).sum(0).ravel(), (n.sum(2) > 0).sum(0)])

            got = sums_over(rounds.state, ["size"], shares, 2 * s * k + s)
            mean = got[s * k : 2 * s * k].reshape(s, k) / np.maximum(got[2 * s * k :, None], 1)
            self.sub_alpha = np.maximum(4 * k * self._alpha * mean, 1e-3)
            self._pairs = got[: s * k].reshape(s, k)

    def super_sub(self) -> np.ndarray:
        """(super, sub): smoothed shares of the sub-topics below each super-topic, all documents together."""
        p = self._pairs + self._alpha
        return p / p.sum(1, keepdims=True)


class SAGE(CellModel):
    """Group-wise wording: beta = softmax(background + topic + group + topic x group deviations)."""

    words = "group"

    def __init__(self, num_topics: int, *, alpha: float = 0.1, prior_variance: float = 1.0, optimize_interval: int = 5, lbfgs_iters: int = 20, seed: int = 42):
        super().__init__(num_topics, alpha=alpha, seed=seed)
        self.prior_variance, self.optimize_interval, self.lbfgs_iters = prior_variance, optimize_interval, lbfgs_iters

    def fit(self, docs: DataFrame, groups: DataFrame, **options) -> "SAGE":
        """``groups`` (doc_id, group)."""
        self.groups = sorted(r[0] for r in groups.select("group").filter("group is not null").distinct().collect())
        at = F.create_map(*[F.lit(v) for i, g in enumerate(self.groups) for v in (g, float(i))])
        return super().fit(docs, groups.select("doc_id", F.array(F.coalesce(F.try_element_at(at, F.col("group")), F.lit(0.0))).alias("x")), **options)

    def _encoded(self, enc):
        super()._encoded(enc)
        f = enc.frequencies()
        self.background = np.log((f + 0.5) / (f + 0.5).sum())
        k, g, v = self.num_topics, len(self.groups), len(f)
        rng = np.random.default_rng(self.seed)
        self.kappa = [0.1 * rng.normal(size=(k, v)), np.zeros((g, v)), np.zeros((k, g, v))]

    def group_beta(self) -> np.ndarray:
        """(K, G, V)."""
        t, g, tg = self.kappa
        x = self.background + t[:, None] + g[None] + tg
        e = np.exp(x - x.max(2, keepdims=True))
        return e / e.sum(2, keepdims=True)

    def shared(self):
        b = self.group_beta()
        return {"group_beta": b, "start": b.mean(1)}

    def after(self, it, rounds, iters):
        if it % self.optimize_interval and it != iters - 1:
            return
        k, g, v = self.num_topics, len(self.groups), len(self.vocabulary)

        def counts(b):
            per, w, n = bags(b)
            cells, group = token_counts(unpacked_tokens(b.column("g"), k), n, k), np.repeat(matrix_of(b.column("x"), 1)[:, 0].astype(int), per)
            return by_word(group * v + w, cells, g * v).ravel()

        self.group_counts = sums_over(rounds.state, ["bag", "x", "g"], counts, k * g * v).reshape(k, g, v)
        shapes = [a.shape for a in self.kappa]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        c = self.group_counts

        def objective(flat):
            self.kappa = [p.reshape(s) for p, s in zip(np.split(flat, ends[:-1]), shapes)]
            b = self.group_beta()
            miss = c - c.sum(2, keepdims=True) * b
            value = (c * np.log(np.maximum(b, 1e-300))).sum() - 0.5 * (flat @ flat) / self.prior_variance
            return -value, -np.concatenate([miss.sum(1).ravel(), miss.sum(0).ravel(), miss.ravel()]) + flat / self.prior_variance

        best = lbfgs(objective, np.concatenate([a.ravel() for a in self.kappa]), self.lbfgs_iters)
        self.kappa = [p.reshape(s) for p, s in zip(np.split(best, ends[:-1]), shapes)]

    def topics_of(self, counts):
        b = self.group_beta()
        weight = self.group_counts.sum(2) + 1e-9
        return (b * weight[:, :, None]).sum(1) / weight.sum(1)[:, None]

    @property
    def topic_word_by_group(self) -> np.ndarray:
        return self.group_beta()

    def word_contrast(self, topic: int, a, b, n: int = 10) -> list[tuple[str, float]]:
        """The words whose log ratio between two groups' wording of a topic is greatest."""
        p = self.group_beta()[topic]
        ratio = np.log(p[self.groups.index(a)]) - np.log(p[self.groups.index(b)])
        return [(self.vocabulary[i], float(ratio[i])) for i in np.lexsort((np.arange(len(ratio)), -ratio))[:n]]


class HDP(CellModel):
    """Hierarchical Dirichlet process, truncated at ``max_topics``: a document's prior is alpha x the stick weights.

    Tables are drawn document by document in the sweep's task, the weights from their sums on the driver.
    Topics that end without tokens are dropped, so the number of topics is a result.
    """

    def __init__(self, *, alpha: float = 0.1, gamma: float = 0.1, beta: float = 0.01, max_topics: int = 50, resample_conc: bool = False, seed: int = 42):
        super().__init__(max_topics, alpha=alpha / max_topics, beta=beta, seed=seed)
        self.concentration, self.gamma, self.resample_conc = alpha, gamma, resample_conc
        self.sticks = np.full(max_topics, 1 / max_topics)
        self.topic_count_history, self.concentration_history = [], []

    def shared(self):
        return {"alpha": self.concentration * np.maximum(self.sticks, 1e-8)}

    def after(self, it, rounds, iters):
        k, a, seed = self.num_topics, self.concentration * np.maximum(self.sticks, 1e-8), self.seed

        def tables(b):
            n = matrix_of(b.column("size"), k)
            rng = np.random.default_rng([seed, it, 5, int(n.sum()) & 0xFFFFFF])
            # customer i opens a table with chance a / (a + i)
            at, topic = np.nonzero(n > 0)
            size = np.rint(n[at, topic]).astype(np.int64)
            t = np.repeat(topic, size)
            i = np.arange(len(t)) - np.repeat(np.cumsum(size) - size, size)
            m = np.bincount(t[rng.random(len(t)) < a[t] / (a[t] + i)], minlength=k)
            return np.r_[m, len(n), n.sum()]

        got = sums_over(rounds.state, ["size"], tables, k + 2)
        rng = np.random.default_rng([self.seed, it, 9])
        m = got[:k]
        g = rng.standard_gamma(m + self.gamma / k)
        self.sticks = g / g.sum()
        if self.resample_conc and got[k + 1] > 0:
            # auxiliary-variable update with mean document length
            mean = got[k + 1] / max(got[k], 1)
            eta = rng.beta(self.concentration + 1, mean, int(min(got[k], 10_000)))
            self.concentration = float(rng.gamma(1 + m.sum() * len(eta) / max(got[k], 1), 1 / (1 - np.log(eta).sum())))
        self.topic_count_history.append(int((self._counts.sum(1) > 0.5).sum()))
        self.concentration_history.append(self.concentration)
        self.alpha = self.concentration * np.maximum(self.sticks, 1e-8)

    def fit(self, docs: DataFrame, **options) -> "HDP":
        super().fit(docs, **options)
        used = np.nonzero(self._counts.sum(1) > 0.5)[0]
        self.used = used
        self.topic_word, self.num_topics = self.topic_word[used], len(used)
        return self

    def doc_topic(self) -> DataFrame:
        """Shares of the topics that are used, numbered as in ``topic_word``."""
        full = self.num_topics
        self.num_topics = len(self.alpha)
        theta = super().doc_topic()
        self.num_topics = full
        at = self.spark.createDataFrame([(int(t), i) for i, t in enumerate(self.used)], "topic int, new int")
        from pyspark.sql import Window as W

        kept = theta.join(F.broadcast(at), "topic").select("doc_id", F.col("new").alias("topic"), "p")
        return kept.withColumn("p", F.col("p") / F.sum("p").over(W.partitionBy("doc_id")))

    def layout(self):
        n = len(self.alpha)
        return n, np.arange(n)

    def word_prior(self):
        return np.full((len(self.alpha), len(self.vocabulary)), self.beta)
