"""Topics that move with time, topics with sentiment, and trees of topics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import lbfgs, lgamma, logsumexp, make_dominant, softmax
from ..functions.session import cut
from .base import Encoded, TopicModel
from .engine import Rounds, bags, by_doc, listed, matrix_of, packed_cells, sums_over, unpacked_cells
from .supervised import response_step


def chain_mode(counts: np.ndarray, variance: float, first: float = 10.0, start: np.ndarray | None = None, steps: int = 60) -> np.ndarray:
    """(T, V) word logits of a topic: the mode under multinomial counts (T, V) and a Gaussian walk of ``variance``."""
    total, (t, v) = counts.sum(1), counts.shape
    scale = max(1.0, float(total.max()))

    def value(flat):
        x = flat.reshape(t, v)
        p = softmax(x)
        step = np.diff(x, axis=0)
        f = -(counts * x).sum() + (total * logsumexp(x)).sum() + 0.5 * (step * step).sum() / variance + 0.5 * (x[0] @ x[0]) / first
        g = total[:, None] * p - counts
        g[0] += x[0] / first
        g[1:] += step / variance
        g[:-1] -= step / variance
        return f / scale, g.ravel() / scale

    return lbfgs(value, (np.zeros((t, v)) if start is None else start).ravel(), steps).reshape(t, v)


class DTM(TopicModel):
    """Dynamic topics: word logits walk from one time slice to the next.

    Documents have variational shares given their slice's topics; each topic's chain is the mode under the expected
    counts of all slices (the reference's variational filter is replaced by that mode, with the same walk).
    """

    family = "none"

    def __init__(self, num_topics: int, *, alpha: float = 0.01, chain_variance: float = 0.005, seed: int = 42):
        self.num_topics, self._alpha, self.chain_variance, self.seed = num_topics, alpha, chain_variance, seed
        self.alpha = np.full(num_topics, alpha)

    def fit(self, docs: DataFrame, times: DataFrame, *, iters: int = 20, min_doc_freq: int = 1, parts: int | None = None) -> "DTM":
        """``times`` (doc_id, time), compared in their order; documents without a time are left out."""
        from .dirichlet import LDA

        enc = docs if isinstance(docs, Encoded) else Encoded(docs, min_doc_freq, parts=parts)
        self._encoded(enc)
        self.times = [r[0] for r in times.select("time").filter("time is not null").distinct().orderBy("time").collect()]
        k, v, t, alpha = self.num_topics, len(enc.terms), len(self.times), self._alpha
        enc.check(k * t)
        at = F.create_map(*[F.lit(z) for i, s in enumerate(self.times) for z in (s, i)])
        data = cut(enc.docs.join(times.filter("time is not null").select("doc_id", F.try_element_at(at, F.col("time")).alias("period")), "doc_id").repartition(enc.parts, "doc_id").sortWithinPartitions("doc_id"))
        start = LDA(k, alpha_sum=k * max(alpha, 0.1), seed=self.seed).fit(enc, iters=20).topic_word
        chains = np.repeat(np.log(np.maximum(start, 1e-8))[:, None], t, 1)
        rounds = Rounds(data, {"gamma": "array<double>"}, self.seed)

        def kernel(b, sh, rng, sums):
            per, w, n = bags(b)
            doc, n, s = np.repeat(np.arange(len(per)), per), n.astype(float), b.column("period").to_numpy()
            gamma, phi = response_step(sh[:, s[doc], w].T, n, doc, len(per), np.zeros(k), 1.0, alpha, None, 20)
            ss = np.zeros((t * v, k))
            np.add.at(ss, s[doc] * v + w, phi * n[:, None])
            sums += ss.T.ravel()
            return {"gamma": listed(gamma)}

        self.bound_history = []
        for _ in range(iters):
            beta = softmax(chains)
            counts = rounds.step(_with_topics(kernel), {"beta": beta}, k * t * v).reshape(k, t, v)
            self.bound_history.append(float((counts * np.log(np.maximum(beta, 1e-300))).sum()))
            chains = np.stack([chain_mode(c, self.chain_variance, start=x) for c, x in zip(counts, chains)])
        self.word_chains, self._state, self.num_times = softmax(chains), rounds.state, t
        self.topic_word = self.word_chains.mean(1)
        return self

    def topic_word_at(self, time) -> np.ndarray:
        """(K, V) at a time slice."""
        return self.word_chains[:, self.times.index(time)]

    def word_evolution(self) -> DataFrame:
        """(topic, time, term, prob)."""
        k, t, v = self.word_chains.shape
        rows = pa.table({"topic": pa.array(np.repeat(np.arange(k, dtype=np.int32), t * v)), "time": pa.array(np.tile(np.repeat(np.arange(t, dtype=np.int32), v), k)), "term": pa.array(self.vocabulary * (k * t), pa.string()), "prob": pa.array(self.word_chains.ravel())})
        return self.spark.createDataFrame(rows)

    def word_drift(self, topic: int, n: int = 10) -> list[tuple[str, float]]:
        """The words whose probability changed most from the first to the last slice."""
        d = self.word_chains[topic, -1] - self.word_chains[topic, 0]
        return [(self.vocabulary[i], float(d[i])) for i in np.lexsort((np.arange(len(d)), -np.abs(d)))[:n]]

    def doc_topic(self) -> DataFrame:
        total = F.aggregate("gamma", F.lit(0.0), lambda s, x: s + x)
        return self._state.select("doc_id", F.posexplode(F.transform("gamma", lambda x: x / total)).alias("topic", "p"))


def _with_topics(kernel):
    return lambda b, sh, rng, sums: kernel(b, sh["beta"], rng, sums)


class STS(TopicModel):
    """Topics with sentiment: beta_k(s) = softmax(m + base_k + slope_k s), s a latent of every document and topic beside its prevalence.

    Laplace EM as in the structural model over 2 K - 1 latents; the slopes are two-parameter Poisson regressions of
    expected counts on mean sentiment over groups of equal seed, all words at once, with a ridge.
    """

    family = "logistic_normal"

    def __init__(self, num_topics: int, *, seed: int = 42):
        self.num_topics, self.seed, self.bound_history = num_topics, seed, []

    def fit(self, docs: DataFrame, sentiment_seed: DataFrame, prevalence: DataFrame | None = None, features: list[str] | None = None, *, iters: int = 30, kappa_ridge: float = 1e-3, convergence_tol: float = 1e-5, min_doc_freq: int = 1, parts: int | None = None, max_groups: int = 10) -> "STS":
        """``sentiment_seed`` (doc_id, s); more than ``max_groups`` values are cut into that many quantiles."""
        from .dirichlet import LDA

        enc = docs if isinstance(docs, Encoded) else Encoded(docs, min_doc_freq, parts=parts)
        enc.check(self.num_topics * max_groups)
        self._encoded(enc)
        k, v, self.feature_names = self.num_topics, len(enc.terms), ["intercept", "sentiment_seed", *(features or [])]
        p, n_lat = len(self.feature_names), 2 * self.num_topics - 1
        seedcol = sentiment_seed.select("doc_id", F.col("s").cast("double").alias("s"))
        values = [r[0] for r in seedcol.select("s").filter("s is not null").distinct().orderBy("s").limit(max_groups + 1).collect()]
        edges = values[1:] if len(values) <= max_groups else sorted(set(seedcol.agg(F.percentile("s", F.array(*[F.lit(i / max_groups) for i in range(1, max_groups)]))).first()[0]))
        group = sum(((F.col("s") >= F.lit(float(e))).cast("int") for e in edges), F.lit(0))
        g = len(edges) + 1
        data = enc.docs.join(seedcol, "doc_id", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
        data = data if prevalence is None else data.join(prevalence, "doc_id", "left")
        x = F.array(F.lit(1.0), F.col("s"), *[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features or []])
        data = cut(data.select("doc_id", "bag", x.alias("x"), group.alias("group"), "s").repartition(enc.parts, "doc_id").sortWithinPartitions("doc_id"))
        beta = LDA(k, alpha_sum=1.0, seed=self.seed).fit(enc, iters=15).topic_word
        f = beta.mean(0) + 1e-10
        m = np.log(f / f.sum())

        def by_group(b):
            per, w, n = bags(b)
            at, s = b.column("group").to_numpy().astype(np.int64), b.column("s").to_numpy()
            return np.r_[np.bincount(np.repeat(at, per) * v + w, n, g * v), np.bincount(at, s, g), np.bincount(at, minlength=g)]

        # the first slopes: words shared out by beta alone, on the centred seed; at slopes of 0 the seed would have no hold
        got = sums_over(data, ["bag", "group", "s"], by_group, g * v + 2 * g)
        level, size = got[g * v : -g], got[-g:]
        middle = float(level.sum() / max(size.sum(), 1))
        counts = got[: g * v].reshape(g, 1, v) * (beta / np.maximum(beta.sum(0), 1e-12))
        at = np.where(size > 0, level / np.maximum(size, 1) - middle, 0.0)
        base, slope = poisson_lines(counts, counts.sum(2), np.repeat(at[:, None], k, 1), m, np.log(np.maximum(beta, 1e-8)) - m, np.zeros((k, v)), kappa_ridge)
        first = F.concat(F.array_repeat(F.lit(0.0), k - 1), F.array_repeat(F.col("s") - F.lit(middle), k))
        data = data.withColumn("a", first).drop("s")
        gamma, sigma = np.zeros((p, n_lat)), np.eye(n_lat) * 5.0
        cells = [g * k * v, g * k * 2, n_lat**2, n_lat**2, p * n_lat, p * p, 2]
        length = sum(cells)
        rounds = Rounds(data, {"a": "array<double>"}, self.seed)

        def kernel(b, sh, rng, sums):
            if "norm" not in sh:
                sh["norm"] = Normalizers(sh["m"], sh["base"], sh["slope"])
            gamma, prec = sh["gamma"], sh["prec"]
            per, w, n = bags(b)
            n, ends = n.astype(float), np.r_[0, np.cumsum(per)]
            xs, lat, groups = matrix_of(b.column("x"), p), matrix_of(b.column("a"), n_lat), b.column("group").to_numpy()
            parts_ = [s.reshape(q) for s, q in zip(np.split(sums, np.cumsum(cells)[:-1]), [(g, k, v), (g, k, 2), (n_lat, n_lat), (n_lat, n_lat), (p, n_lat), (p, p), (2,)])]
            every = []
            for lo in range(0, len(per), 512):
                d = slice(lo, min(lo + 512, len(per)))
                c = slice(ends[d.start], ends[d.stop])
                lat[d], nu, phi, bound = sentiment_modes(lat[d], sh["norm"], w[c], n[c], per[d], xs[d] @ gamma, prec)
                every.append(phi)
                size = by_doc(phi, per[d])
                for i, of in enumerate((size, size * lat[d, k - 1 :])):
                    np.add.at(parts_[1][:, :, i], groups[d], of)
                parts_[2] += nu.sum(0)
                parts_[6] += [bound.sum(), len(bound)]
            place = np.repeat(groups.astype(np.int64), per) * v + w
            for i, of in enumerate(np.concatenate(every).T):
                parts_[0][:, i] += np.bincount(place, of, g * v).reshape(g, v)
            parts_[3] += lat.T @ lat
            parts_[4] += xs.T @ lat
            parts_[5] += xs.T @ xs
            return {"a": listed(lat)}

        self.converged = None
        for _ in range(iters):
            got = rounds.step(kernel, {"m": m, "base": base, "slope": slope, "gamma": gamma, "prec": np.linalg.inv(sigma)}, length)
            counts, mean, nus, aa, xa, xx, tail = np.split(got, np.cumsum(cells)[:-1])
            self.bound_history.append(float(tail[0]))
            if len(self.bound_history) > 1:
                self.converged = abs(self.bound_history[-1] - self.bound_history[-2]) <= convergence_tol * abs(self.bound_history[-2])
                if self.converged:
                    break
            counts, mean = counts.reshape(g, k, v), mean.reshape(g, k, 2)
            aa, xa, xx = aa.reshape(n_lat, n_lat), xa.reshape(p, n_lat), xx.reshape(p, p)
            gamma = np.linalg.solve(xx + 1e-6 * np.eye(p), xa)
            s = (nus.reshape(n_lat, n_lat) + aa - gamma.T @ xa - xa.T @ gamma + gamma.T @ xx @ gamma) / tail[1]
            sigma = (s + s.T) / 2 + 1e-6 * np.eye(n_lat)
            at = mean[:, :, 1] / np.maximum(mean[:, :, 0], 1e-12)
            base, slope = poisson_lines(counts, mean[:, :, 0], at, m, base, slope, kappa_ridge)
        self.background, self.base, self.slope, self._state = m, base, slope, rounds.state
        self.prevalence_effects, self.sentiment_effects, self.topic_covariance = gamma[:, : k - 1], gamma[:, k - 1 :], sigma
        self.mean_sentiment = (mean.reshape(g, k, 2)[:, :, 1].sum(0) / np.maximum(mean.reshape(g, k, 2)[:, :, 0].sum(0), 1e-12))
        self.topic_word = self.topic_word_at(self.mean_sentiment)
        return self

    def topic_word_at(self, level) -> np.ndarray:
        """(K, V) at a sentiment level, one for all topics or one each."""
        return softmax(self.background + self.base + self.slope * np.broadcast_to(np.asarray(level, float), (self.num_topics,))[:, None])

    def doc_topic(self) -> DataFrame:
        from .logistic import STM

        return STM._shares(self._state.select("doc_id", F.slice("a", 1, self.num_topics - 1).alias("eta")), "doc_id")

    def sentiment(self) -> DataFrame:
        """(doc_id, topic, s)."""
        return self._state.select("doc_id", F.posexplode(F.slice("a", self.num_topics, self.num_topics)).alias("topic", "s"))


def sentiment_value(a, m, base, slope, w, n, mu, prec):
    """(negative log posterior, gradient, responsibilities x counts (K, words)) of one document's latents."""
    k = len(base)
    theta = softmax(np.r_[a[: k - 1], 0.0])
    logits = m + base + slope * a[k - 1 :, None]
    logz = logsumexp(logits)
    beta = np.exp(logits - logz[:, None])
    mix = theta[:, None] * beta[:, w]
    all_ = np.maximum(mix.sum(0), 1e-300)
    phi = mix / all_ * n
    d = a - mu
    pd = prec @ d
    centred = slope[:, w] - (beta * slope).sum(1)[:, None]
    g = np.r_[(n.sum() * theta - phi.sum(1))[:-1], -(phi * centred).sum(1)] + pd
    return -(n @ np.log(all_)) + 0.5 * d @ pd, g, phi


class Normalizers:
    """ln sum_w exp(m_w + base_kw + slope_kw s) of every topic as a function of s, with its first two derivatives.

    It is computed at nodes where it is asked for, and between two nodes it is the quintic that has the value and both
    derivatives of either.  Nodes are a fifth of 1 / (range of the slopes) apart, so the value is right to about 1e-9;
    beyond ``limit`` it is computed for every s.
    """

    BLOCK = 32

    def __init__(self, m, base, slope, limit: float = 16.0):
        self.logits, self.slope, self.limit = m + base, slope, limit
        self.centre = (softmax(self.logits) * slope).sum(1)
        self.step = 1 / max(8.0, 5 * float(np.ptp(slope, axis=1).max(initial=0)))
        blocks = int(np.ceil(2 * limit / self.step / self.BLOCK)) + 1
        self.table, self.filled = np.empty((len(base), blocks * self.BLOCK, 3)), np.zeros((len(base), blocks), bool)

    def exact(self, k: int, s: np.ndarray) -> np.ndarray:
        """(rows, 3) of topic ``k``."""
        out, slope = np.empty((len(s), 3)), self.slope[k] - self.centre[k]
        powers = np.stack([np.ones_like(slope), slope, slope * slope], 1)
        for lo in range(0, len(s), 8):
            x = self.logits[k] + self.slope[k] * s[lo : lo + 8, None]
            top = x.max(1, keepdims=True)
            x -= top
            total, first, second = (np.exp(x, x) @ powers).T
            mean = first / total
            out[lo : lo + 8] = np.stack([top[:, 0] + np.log(total), self.centre[k] + mean, second / total - mean * mean], 1)
        return out

    def __call__(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values, first and second derivatives (rows, K) at ``s`` (rows, K)."""
        h, out = self.step, np.empty((3, *s.shape))
        for k in range(s.shape[1]):
            inside = np.abs(s[:, k]) < self.limit
            x = (np.where(inside, s[:, k], 0) + self.limit) / h
            at = x.astype(np.int64)
            need = np.zeros(self.filled.shape[1], bool)
            need[at // self.BLOCK] = need[(at + 1) // self.BLOCK] = True
            for i in np.nonzero(need & ~self.filled[k])[0]:
                nodes = np.arange(i * self.BLOCK, (i + 1) * self.BLOCK)
                self.table[k, nodes], self.filled[k, i] = self.exact(k, nodes * h - self.limit), True
            t, (f, f1, f2), (g, g1, g2) = x - at, self.table[k, at].T, self.table[k, at + 1].T
            b, c = h * f1, h * h * f2 / 2
            d, e, q = g - f - b - c, h * g1 - b - 2 * c, h * h * g2 - 2 * c
            c3, c4, c5 = 10 * d - 4 * e + q / 2, -15 * d + 7 * e - q, 6 * d - 3 * e + q / 2
            out[0, :, k] = f + t * (b + t * (c + t * (c3 + t * (c4 + t * c5))))
            out[1, :, k] = (b + t * (2 * c + t * (3 * c3 + t * (4 * c4 + t * 5 * c5)))) / h
            out[2, :, k] = (2 * c + t * (6 * c3 + t * (12 * c4 + t * 20 * c5))) / (h * h)
            if not inside.all():
                out[:, ~inside, k] = self.exact(k, s[~inside, k]).T
        return out[0], out[1], out[2]


def _sentiment_mix(a, norm, w, n, per, mu, prec):
    """(negative log posteriors (D,), theta, normalizers, topic x word (cells, K), their sums) of the documents."""
    k = a.shape[1] // 2 + 1
    theta, s = softmax(np.c_[a[:, : k - 1], np.zeros(len(a))]), a[:, k - 1 :]
    z = norm(s)
    mix = np.repeat(theta, per, 0) * np.exp(norm.logits.T[w] + norm.slope.T[w] * np.repeat(s, per, 0) - np.repeat(z[0], per, 0))
    every = np.maximum(mix.sum(1), 1e-300)
    d = a - mu
    return 0.5 * np.einsum("di,ij,dj->d", d, prec, d) - by_doc(n * np.log(every), per), theta, z, mix, every


def sentiment_curves(a, norm, w, n, per, mu, prec):
    """(values (D,), gradients (D, L), curvatures (D, L, L), responsibilities x counts (cells, K)) of documents' latents."""
    k = a.shape[1] // 2 + 1
    value, theta, (_, mean, var), share, every = _sentiment_mix(a, norm, w, n, per, mu, prec)
    share /= every[:, None]
    phi = share * n[:, None]
    pull = np.c_[np.ones((len(w), k - 1)), norm.slope.T[w] - np.repeat(mean, per, 0)]
    topic = np.r_[np.arange(k - 1), np.arange(k)]
    left, right = pull * share[:, topic], pull * phi[:, topic]
    expected, total, got = by_doc(phi, per), by_doc(n, per), by_doc(right, per)
    g = (a - mu) @ prec - got
    g[:, : k - 1] += total[:, None] * theta[:, :-1]
    h = np.empty((len(a), len(topic), len(topic)))
    for i in range(len(topic)):
        h[:, i, : i + 1] = by_doc(left[:, i, None] * right[:, : i + 1], per)
        h[:, :i, i] = h[:, i, :i]
    h += prec
    e = theta[:, :-1]
    h[:, : k - 1, : k - 1] += total[:, None, None] * (e[:, :, None] * np.eye(k - 1) - e[:, :, None] * e[:, None, :])
    # what the second derivative of a topic's own logarithm adds
    at = np.arange(len(topic))
    h[:, at, at] -= np.c_[expected[:, :-1], by_doc(phi * pull[:, k - 1 :] ** 2, per) - expected * var]
    for i in range(k - 1):
        h[:, i, k - 1 + i] -= got[:, k - 1 + i]
        h[:, k - 1 + i, i] -= got[:, k - 1 + i]
    return value, g, h, phi


def sentiment_modes(a, norm, w, n, per, mu, prec, steps: int = 60, tol: float = 1e-6):
    """(modes (D, L), covariances (D, L, L), expected counts at the cells (cells, K), bounds (D,)) of all documents together.

    Newton steps along curvatures made positive; a document at its mode, or that can fall no further, takes no more steps.
    """
    a, open_, ends = a.copy(), np.arange(len(a)), np.cumsum(per)
    cells = lambda docs: np.repeat(ends[docs] - np.cumsum(per[docs]), per[docs]) + np.arange(per[docs].sum())
    for _ in range(steps):
        c = cells(open_)
        value, g, h, _ = sentiment_curves(a[open_], norm, w[c], n[c], per[open_], mu[open_], prec)
        far = np.abs(g).max(1, initial=0) >= tol
        if not far.any():
            break
        open_, value, g = open_[far], value[far], g[far]
        size, turn = np.linalg.eigh(h[far])
        size = np.maximum(np.abs(size), 1e-6)
        step = -np.einsum("dij,dj->di", turn, np.einsum("dji,dj->di", turn, g) / size)
        slope, t, rest = (g * step).sum(1), 1.0, np.arange(len(open_))
        for _ in range(30):
            docs = open_[rest]
            new, c = a[docs] + t * step[rest], cells(docs)
            # a step at the limit of what the value can show still counts
            ok = _sentiment_mix(new, norm, w[c], n[c], per[docs], mu[docs], prec)[0] <= value[rest] + 1e-4 * t * slope[rest] + 1e-12 * np.abs(value[rest])
            a[docs[ok]] = new[ok]
            rest, t = rest[~ok], t / 2
            if not len(rest):
                break
        open_ = np.delete(open_, rest)
        if not len(open_):
            break
    value, _, h, phi = sentiment_curves(a, norm, w, n, per, mu, prec)
    for i in np.nonzero(np.linalg.eigvalsh(h)[:, 0] <= 1e-8)[0]:
        h[i] = make_dominant(h[i]) + 1e-6 * np.eye(a.shape[1])
    return a, np.linalg.inv(h), phi, -value - 0.5 * np.linalg.slogdet(h)[1] + 0.5 * np.linalg.slogdet(prec)[1]


def poisson_lines(counts, exposure, at, m, base, slope, ridge, steps: int = 25):
    """Intercepts and slopes (K, V): counts (G, K, V) ~ Poisson(exposure exp(m + base + slope at)), every topic and word by Newton steps."""
    off = np.log(np.maximum(exposure, 1e-12))[:, :, None] + m
    x = at[:, :, None]
    base, slope = base.copy(), slope.copy()
    for _ in range(steps):
        mu = np.exp(np.clip(off + base + slope * x, -40, 40))
        r = counts - mu
        g0, g1 = r.sum(0) - ridge * base, (r * x).sum(0) - ridge * slope
        h00, h01, h11 = mu.sum(0) + ridge, (mu * x).sum(0), (mu * x * x).sum(0) + ridge
        det = np.maximum(h00 * h11 - h01 * h01, 1e-12)
        d0, d1 = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        base, slope = base + np.clip(d0, -2, 2), slope + np.clip(d1, -2, 2)
        if max(np.abs(d0).max(), np.abs(d1).max()) < 1e-6:
            break
    return base, slope


class HLDA(TopicModel):
    """A tree of topics of fixed depth by the nested Chinese restaurant process: each document has a path from the root, each token a level of it.

    In a sweep every task draws paths and levels given the counts of the last sweep and without the document's own; new
    branches get numbers of their own, and the tree is put together from the documents' paths after the sweep.
    """

    family = "none"

    def __init__(self, *, depth: int = 3, gamma: float = 1.0, beta: float = 0.01, alpha: float = 0.1, seed: int = 42):
        self.depth, self.gamma, self.beta, self.alpha, self.seed = depth, gamma, beta, alpha, seed

    def fit(self, docs: DataFrame, *, iters: int = 50, min_doc_freq: int = 1, parts: int | None = None) -> "HLDA":
        enc = docs if isinstance(docs, Encoded) else Encoded(docs, min_doc_freq, parts=parts)
        self._encoded(enc)
        depth, v, gamma, beta, alpha = self.depth, len(enc.terms), self.gamma, self.beta, self.alpha
        rounds = Rounds(enc.docs, {"g": "binary", "path": "array<bigint>"}, self.seed)

        def kernel(b, sh, rng, sums):
            per, w, n = bags(b)
            ends, first = np.cumsum(per), "g" not in b.schema.names
            old = rng.multinomial(n, np.full((len(n), depth), 1 / depth)).astype(float) if first else unpacked_cells(b.column("g"), depth)
            was = None if first else np.array(b.column("path").to_pylist(), np.int64)
            new, paths = old.copy(), np.zeros((len(per), depth), np.int64)
            nodes, counts, docs_at, kids = sh["nodes"], sh["counts"], sh["docs"], sh["children"]
            total = counts.sum(1) if len(counts) else counts
            at = {int(x): i for i, x in enumerate(nodes)}
            for d in range(len(per)):
                c = slice(ends[d] - per[d], ends[d])
                wi, level = w[c], new[c]
                mine = {} if first else {int(x): level[:, l] for l, x in enumerate(was[d])}

                def fit_of(node, words):
                    """ln chance of words (counts) at a node without this document; None is a new node."""
                    if node is None:
                        a, t = np.zeros(len(wi)), 0.0
                    else:
                        a, t = counts[at[node], wi], total[at[node]]
                        if node in mine:
                            a, t = a - mine[node], t - mine[node].sum()
                    a = np.maximum(a, 0) + beta
                    t = max(t, 0) + v * beta
                    return float((lgamma(a + words) - lgamma(a)).sum() - lgamma(t + words.sum()) + lgamma(t))

                fresh = [fit_of(None, level[:, l]) for l in range(depth)]
                # walk the tree: a path's score adds up from the root; every inner node also offers a new branch
                options, stack = [], [((0,), fit_of(0, level[:, 0]) if 0 in at else fresh[0], 0.0)]
                while stack:
                    path, like, prior = stack.pop()
                    l = len(path)
                    if l == depth:
                        options.append((path, like + prior))
                        continue
                    kin = [(x, docs_at[at[x]] - (x in mine)) for x in kids.get(path[-1], [])]
                    kin = [(x, m) for x, m in kin if m > 0]
                    base = np.log(sum(m for _, m in kin) + gamma)
                    options.append((path, like + prior + np.log(gamma) - base + sum(fresh[l:])))
                    stack += [((*path, x), like + fit_of(x, level[:, l]), prior + np.log(m) - base) for x, m in kin]
                score = np.array([s for _, s in options])
                q = np.exp(score - score.max())
                path = list(options[int(rng.choice(len(q), p=q / q.sum()))][0])
                while len(path) < depth:
                    path.append(int(rng.integers(1, 2**62)))
                paths[d] = path
                here = [(counts[at[x], wi], total[at[x]]) if x in at else (np.zeros(len(wi)), 0.0) for x in path]
                own = [mine.get(x, np.zeros(len(wi))) for x in path]
                size = level.sum(0)
                for j in range(len(wi)):
                    size = size - level[j]
                    p = np.array([(size[l] + alpha) * (max(here[l][0][j] - own[l][j], 0) + beta) / (max(here[l][1] - own[l].sum(), 0) + v * beta) for l in range(depth)])
                    level[j] = rng.multinomial(int(n[c][j]), p / p.sum())
                    size = size + level[j]
                new[c] = level
            return {"g": packed_cells(new, per), "path": pa.array(paths.tolist(), pa.list_(pa.int64()))}

        tree = {"nodes": np.zeros(0, np.int64), "counts": np.zeros((0, v)), "docs": np.zeros(0), "children": {}}
        self.log_likelihood_history, self.node_count_history = [], []
        for _ in range(iters):
            rounds.step(kernel, tree, 1)
            tree = self._tree(rounds.state, v)
            a = tree["counts"] + beta
            self.log_likelihood_history.append(float((lgamma(a) - lgamma(np.full(1, beta))).sum() - (lgamma(a.sum(1)) - lgamma(np.full(1, v * beta))).sum()))
            self.node_count_history.append(len(tree["nodes"]))
        order = np.lexsort((-tree["docs"], tree["level"]))
        number = {int(tree["nodes"][i]): j for j, i in enumerate(order)}
        self.node_levels, self.node_docs = tree["level"][order].tolist(), tree["docs"][order].astype(int).tolist()
        self.node_parents = [-1 if tree["parent"][i] < 0 else number[int(tree["parent"][i])] for i in order]
        a = tree["counts"][order] + beta
        self.topic_word, self._number, self._state = a / a.sum(1, keepdims=True), number, rounds.state
        return self

    def _tree(self, state: DataFrame, v: int) -> dict:
        """Nodes, their parents, levels, documents and word counts, from the paths of all documents (as many rows as leaves)."""
        enc_check = state.groupBy("path").agg(F.count(F.lit(1)).alias("n")).orderBy("path").collect()
        level, parent, docs = {}, {}, {}
        for r in enc_check:
            for l, x in enumerate(r["path"]):
                level[x], parent[x] = l, r["path"][l - 1] if l else -1
                docs[x] = docs.get(x, 0) + r["n"]
        nodes = np.array(sorted(level), np.int64)
        at, depth = {int(x): i for i, x in enumerate(nodes)}, self.depth
        held = state.sparkSession.sparkContext.broadcast(at)

        def part(b):
            per, w, _ = bags(b)
            g, path = unpacked_cells(b.column("g"), depth), np.array(b.column("path").to_pylist(), np.int64)
            index = np.vectorize(held.value.get)(path)
            out = np.zeros((len(held.value), v))
            for l in range(depth):
                np.add.at(out, (np.repeat(index[:, l], per), w), g[:, l])
            return out.ravel()

        counts = sums_over(state, ["bag", "g", "path"], part, len(nodes) * v).reshape(len(nodes), v)
        children: dict[int, list[int]] = {}
        for x, p in parent.items():
            children.setdefault(int(p), []).append(int(x))
        return {"nodes": nodes, "counts": counts, "docs": np.array([docs[int(x)] for x in nodes], float), "children": {k: sorted(c) for k, c in children.items() if k >= 0}, "level": np.array([level[int(x)] for x in nodes]), "parent": np.array([parent[int(x)] for x in nodes], np.int64)}

    @property
    def num_nodes(self) -> int:
        return len(self.node_levels)

    @property
    def leaves(self) -> list[int]:
        return [i for i, l in enumerate(self.node_levels) if l == self.depth - 1]

    def nodes(self) -> DataFrame:
        """(node_id, level, parent, docs)."""
        return self.spark.createDataFrame(list(zip(range(self.num_nodes), self.node_levels, self.node_parents, self.node_docs)), "node_id int, level int, parent int, docs int")

    def doc_paths(self) -> DataFrame:
        """(doc_id, path ARRAY<INT>): node numbers from the root."""
        at = self.spark.createDataFrame(list(self._number.items()), "node bigint, id int")
        x = self._state.select("doc_id", F.posexplode("path").alias("l", "node")).join(F.broadcast(at), "node")
        return x.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("l", "id"))), lambda s: s["id"]).alias("path"))
