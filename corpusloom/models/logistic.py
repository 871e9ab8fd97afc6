"""Correlated and structural topic models: Laplace variational EM with a logistic-normal prior.

The modes of all documents of a batch are found together: Newton steps with a positive definite curvature
and a line search of their own per document.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import lbfgs, make_dominant, softmax
from ..functions.session import cut
from .base import Encoded, TopicModel
from .engine import Rounds, bags, by_doc, by_word, listed, matrix_of, sums_over
from .spectral import spectral_init


def full(eta: np.ndarray) -> np.ndarray:
    """Shares (rows, K) from (rows, K - 1) logits; the last topic is the reference."""
    return softmax(np.c_[eta, np.zeros(len(eta))])


def objective(eta, like, n, doc, total, mu, precision, mix=None):
    """Negative log posterior of every document, up to a constant.  ``like`` (cells, K) is beta at the cells' words.

    ``mix`` gives the cells' mixtures where they are known.
    """
    if mix is None:
        mix = np.maximum((full(eta)[doc] * like).sum(1), 1e-300)
    d = eta - mu
    return 0.5 * np.einsum("di,ij,dj->d", d, precision, d) - np.bincount(doc, n * np.log(mix), len(eta))


def gradient(eta, like, n, doc, total, mu, precision):
    theta = full(eta)
    phi = theta[doc] * like
    phi *= (n / np.maximum(phi.sum(1), 1e-300))[:, None]
    expected = _by_doc(phi, doc, len(eta))
    return (total[:, None] * theta - expected)[:, :-1] + (eta - mu) @ precision, theta, phi


def _by_doc(rows, doc, count):
    """Sums over the rows of each document, which stand together."""
    return by_doc(rows, np.bincount(doc, minlength=count))


def _mixed(eta, like, per):
    """(theta (K, D), mixtures at the cells) with topics first, ``like`` (K, cells)."""
    theta = np.ascontiguousarray(full(eta).T)
    mix = np.repeat(theta[0], per) * like[0]
    for t, x in zip(theta[1:], like[1:]):
        mix += np.repeat(t, per) * x
    return theta, np.maximum(mix, 1e-300, out=mix)


def modes(eta, like, n, doc, mu, precision, steps: int = 60, tol: float = 1e-5):
    """Modes of all documents at once; one that has reached its mode, or cannot rise further, is left out of later steps.

    Steps use the true curvature, its negative directions turned round.
    """
    eta, count, k = eta.copy(), len(eta), like.shape[1]
    if not count:
        return eta
    per, like = np.bincount(doc, minlength=count), np.ascontiguousarray(like.T)
    total, open_, m, eye = np.bincount(doc, n, count), np.arange(count), mu, np.eye(k - 1)
    e, moved = eta, np.ones(count, bool)
    (theta, mix), value = _mixed(e, like, per), None
    least = max(np.linalg.eigvalsh(precision)[0], 1e-9)
    for _ in range(steps):
        ratio = n / mix
        expected = theta * np.stack([by_doc(x * ratio, per) for x in like])
        g = (total * theta - expected)[:-1].T + (e - m) @ precision
        far = moved & (np.abs(g).max(1, initial=0) >= tol)
        eta[open_] = e
        if not far.any():
            break
        if not far.all():
            cells = np.repeat(far, per)
            like, n, mix, ratio = like[:, cells], n[cells], mix[cells], ratio[cells]
            e, g, m, total, per, open_ = e[far], g[far], m[far], total[far], per[far], open_[far]
            value = None if value is None else value[far]
            theta, expected = theta[:, far], expected[:, far]
        doc = np.repeat(np.arange(len(e)), per)
        if value is None:
            value = objective(e, like.T, n, doc, total, m, precision, mix)
        t = theta[:-1].T
        bound = total[:, None, None] * (t[:, :, None] * eye - t[:, :, None] * t[:, None, :]) + precision
        h = bound - expected[:-1].T[:, :, None] * eye
        ratio = ratio / mix
        for i in range(k - 1):
            x = like[i] * ratio
            for j in range(i + 1):
                both = theta[i] * theta[j] * by_doc(x * like[j], per)
                h[:, i, j] += both
                if i != j:
                    h[:, j, i] += both
        bad = ~np.isfinite(h).all((1, 2))
        h[bad] = bound[bad]
        size, axes = np.linalg.eigh(h)
        bad = size[:, 0] < least
        h[bad] = (axes[bad] * np.maximum(np.abs(size[bad]), least)[:, None]) @ axes[bad].transpose(0, 2, 1)
        step = -np.linalg.solve(h, g[:, :, None])[:, :, 0]
        slope, size, moved = (g * step).sum(1), np.ones(len(e)), np.zeros(len(e), bool)
        e = e.copy()
        for _ in range(20):
            rest = np.nonzero(~moved)[0]
            new, whole = e[rest] + size[rest, None] * step[rest], len(rest) == len(e)
            cells = slice(None) if whole else np.repeat(~moved, per)
            part, at = _mixed(new, like[:, cells], per[rest])
            got = objective(new, like.T[cells], n[cells], doc if whole else np.repeat(np.arange(len(rest)), per[rest]), total[rest], m[rest], precision, at)
            ok = got <= value[rest] + 1e-4 * size[rest] * slope[rest]
            won = rest[ok]
            if whole and ok.all():
                theta, mix = part, at
            else:
                theta[:, won] = part[:, ok]
                taken = np.zeros(len(e), bool)
                taken[won] = True
                mix[np.repeat(taken, per)] = at[np.repeat(ok, per[rest])]
            e[won], value[won], moved[won] = new[ok], got[ok], True
            if moved.all():
                break
            size[~moved] /= 2
    eta[open_] = e
    return eta


def laplace(eta, like, n, doc, mu, precision, diagonal: bool = False):
    """(nu (D, K - 1, K - 1), expected counts at the cells (cells, K), bound (D,)) at the modes."""
    k, count = like.shape[1], len(eta)
    total = np.bincount(doc, n, count)
    _, theta, phi = gradient(eta, like, n, doc, total, mu, precision)
    expected = _by_doc(phi, doc, count)
    h = total[:, None, None] * (theta[:, :, None] * np.eye(k) - theta[:, :, None] * theta[:, None, :])
    h -= expected[:, :, None] * np.eye(k)
    share = phi / np.maximum(n[:, None], 1e-300)
    for i in range(k - 1):
        h[:, i, : i + 1] += _by_doc(share[:, i, None] * phi[:, : i + 1], doc, count)
        h[:, :i, i] = h[:, i, :i]
    h = h[:, :-1, :-1] + precision
    if diagonal:
        h = np.maximum(np.einsum("dii->di", h), 1e-6)[:, :, None] * np.eye(k - 1)
    for i in np.nonzero(np.linalg.eigvalsh(h)[:, 0] <= 0)[0]:
        h[i] = make_dominant(h[i]) + 1e-8 * np.eye(k - 1)
    nu = np.linalg.inv(h)
    half = -0.5 * np.linalg.slogdet(h)[1]
    bound = -objective(eta, like, n, doc, total, mu, precision) + half + 0.5 * np.linalg.slogdet(precision)[1]
    return nu, phi, bound


def fit_deviations(counts: np.ndarray, kappa: list[np.ndarray], background: np.ndarray, variance: float, steps: int) -> list[np.ndarray]:
    """Topic (K, V), group (G, V) and joint (K, G, V) deviations of word logits from counts (K, G, V), by penalized likelihood."""
    shapes = [a.shape for a in kappa]
    ends = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]

    def value(flat):
        t, g, tg = (p.reshape(s) for p, s in zip(np.split(flat, ends), shapes))
        b = group_wording(background, t, g, tg)
        miss = counts - counts.sum(2, keepdims=True) * b
        return -(counts * np.log(np.maximum(b, 1e-300))).sum() + 0.5 * (flat @ flat) / variance, flat / variance - np.concatenate([miss.sum(1).ravel(), miss.sum(0).ravel(), miss.ravel()])

    best = lbfgs(value, np.concatenate([a.ravel() for a in kappa]), steps)
    return [p.reshape(s) for p, s in zip(np.split(best, ends), shapes)]


def group_wording(background, topic, group, joint) -> np.ndarray:
    return softmax(background + topic[:, None] + group[None] + joint)


def elastic_net(xx: np.ndarray, xy: np.ndarray, yy: float, n: float, mix: float = 1.0, path: int = 50, rounds: int = 200) -> np.ndarray:
    """Coefficients by coordinate descent from sums of products, the first (intercept) unpenalized; of ``path`` penalties the one of least AIC."""
    p = len(xy)
    base = np.zeros(p)
    base[0] = xy[0] / max(xx[0, 0], 1e-300)
    top = np.abs(xy - xx @ base)[1:].max(initial=0) / max(n * max(mix, 1e-3), 1e-300)
    best, score, b = base, np.inf, base.copy()
    for lam in np.geomspace(max(top, 1e-12), max(top, 1e-12) * 1e-3, path):
        for _ in range(rounds):
            old = b.copy()
            for j in range(p):
                rho = xy[j] - xx[j] @ b + xx[j, j] * b[j]
                if j:
                    b[j] = np.sign(rho) * max(abs(rho) - n * lam * mix, 0) / max(xx[j, j] + n * lam * (1 - mix), 1e-300)
                else:
                    b[j] = rho / max(xx[j, j], 1e-300)
            if np.abs(b - old).max() < 1e-9:
                break
        rss = max(yy - 2 * b @ xy + b @ xx @ b, 1e-12)
        aic = n * np.log(rss / max(n, 1)) + 2 * (b != 0).sum()
        if aic < score:
            best, score = b.copy(), aic
    return best


class STM(TopicModel):
    """Structural topic model; without covariates it is the correlated topic model.

    Every EM round is one Spark job: what all documents share is broadcast, each task finds the modes of its documents
    and adds to the sums; the driver solves the small M-step and stops when the bound rises by less than
    ``convergence_tol`` relative.  ``inference="svi"`` goes over hash-drawn minibatches with natural steps (tau + t)^-kappa.
    ``content`` groups have wordings of their own; ``gamma_prior`` "l1" takes an elastic net for the prevalence.
    """

    family = "logistic_normal"

    def __init__(self, num_topics: int, *, sigma_shrink: float = 0.0, init: str = "spectral", variational: str = "laplace", seed: int = 42):
        if num_topics < 2:
            raise ValueError("num_topics must be at least 2")
        if init not in ("spectral", "random", "cvb0") or variational not in ("laplace", "diagonal"):
            raise ValueError(f"unknown {init!r} or {variational!r}")
        self.num_topics, self.sigma_shrink, self.init, self.variational, self.seed = num_topics, sigma_shrink, init, variational, seed
        self.bound_history: list[float] = []
        self.converged: bool | None = None

    @property
    def bound(self) -> float | None:
        return self.bound_history[-1] if self.bound_history else None

    @property
    def fit_history(self) -> list[tuple[int, float]]:
        return list(enumerate(self.bound_history))

    def _wording(self, counts: np.ndarray) -> np.ndarray:
        """Topics (K, V) from expected counts."""
        return (counts + 1e-8) / (counts + 1e-8).sum(1, keepdims=True)

    def _start(self, enc: Encoded, given) -> np.ndarray:
        k, v = self.num_topics, len(enc.terms)
        if given is not None:
            return given
        if self.init == "cvb0":
            from .dirichlet import LDA

            return LDA(k, alpha_sum=1.0, seed=self.seed).fit(enc, iters=10).topic_word
        got = spectral_init(enc, k) if self.init == "spectral" else None
        if got is None:
            got = 1 + np.random.default_rng(self.seed).random((k, v))
        return got / got.sum(1, keepdims=True)

    def fit(self, docs: DataFrame, prevalence: DataFrame | None = None, features: list[str] | None = None, *, content: DataFrame | None = None, iters: int = 100, convergence_tol: float = 1e-5, min_doc_freq: int = 1, parts: int | None = None, init: np.ndarray | None = None, inference: str = "batch", batch_size: int = 256, tau: float = 64, kappa: float = 0.7, gamma_prior: str = "pooled", gamma_enet: float = 1.0, content_variance: float = 1.0) -> "STM":
        """``prevalence``: (doc_id, features ...), documents without a row get zeros; ``content``: (doc_id, group).

        ``init`` may give the first topics (K, V) over the sorted pruned vocabulary.
        """
        if inference not in ("batch", "svi") or gamma_prior not in ("pooled", "l1"):
            raise ValueError(f"unknown {inference!r} or {gamma_prior!r}")
        enc = docs if isinstance(docs, Encoded) else Encoded(docs, min_doc_freq, parts=parts)
        enc.check(self.num_topics)
        self._encoded(enc)
        k, v, self.feature_names = self.num_topics, len(enc.terms), ["intercept", *(features or [])]
        p = len(self.feature_names)
        design = F.array(F.lit(1.0), *[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features or []])
        data = enc.docs if prevalence is None else enc.docs.join(prevalence, "doc_id", "left")
        data = data.select("doc_id", "bag", design.alias("x"))
        self.groups = None
        if content is not None:
            self.groups = sorted(r[0] for r in content.select("group").filter("group is not null").distinct().collect())
            at = F.create_map(*[F.lit(z) for i, g in enumerate(self.groups) for z in (g, i)])
            data = data.join(content.select("doc_id", F.coalesce(F.try_element_at(at, F.col("group")), F.lit(0)).alias("group")), "doc_id", "left").withColumn("group", F.coalesce("group", F.lit(0)))
        data = cut(data.repartition(enc.parts, "doc_id").sortWithinPartitions("doc_id"))
        g = len(self.groups or [0])
        beta = np.repeat(self._start(enc, init)[:, None], g, 1)
        if content is not None:
            f = beta.mean((0, 1)) + 1e-12
            background = np.log(f / f.sum())
            deviations = [np.log(np.maximum(beta[:, 0], 1e-12)) - background, np.zeros((g, v)), np.zeros((k, g, v))]
        gamma, sigma = np.zeros((p, k - 1)), np.eye(k - 1) * 20.0
        cells = [k * g * v, (k - 1) ** 2, (k - 1) ** 2, p * (k - 1), p * p, 2]
        length, diagonal = sum(cells), self.variational == "diagonal"

        def e_step(b, sh, eta):
            beta, gamma, precision = sh["beta"], sh["gamma"], sh["precision"]
            per, w, n = bags(b)
            x, doc = matrix_of(b.column("x"), p), np.repeat(np.arange(len(per)), per)
            group = b.column("group").to_numpy() if "group" in b.schema.names else np.zeros(len(per), int)
            like, mu, n = beta[:, group[doc], w].T, x @ gamma, n.astype(float)
            eta = modes(mu.copy() if eta is None else eta, like, n, doc, mu, precision)
            nu, phi, bound = laplace(eta, like, n, doc, mu, precision, diagonal)
            return eta, np.concatenate([by_word(group[doc] * v + w, phi, g * v).ravel(), nu.sum(0).ravel(), (eta.T @ eta).ravel(), (x.T @ eta).ravel(), (x.T @ x).ravel(), [bound.sum(), len(per)]])

        def kernel(b, sh, rng, sums):
            eta, s = e_step(b, sh, matrix_of(b.column("eta"), k - 1) if "eta" in b.schema.names else None)
            sums += s
            return {"eta": listed(eta)}

        def shared():
            return {"beta": beta, "gamma": gamma, "precision": np.linalg.inv(sigma)}

        def m_step(total):
            ss, nus, ee, xe, xx, tail = np.split(total, np.cumsum(cells)[:-1])
            nus, ee, xe, xx = nus.reshape(k - 1, k - 1), ee.reshape(k - 1, k - 1), xe.reshape(p, k - 1), xx.reshape(p, p)
            if gamma_prior == "l1" and p > 1:
                new = np.stack([elastic_net(xx, xe[:, j], ee[j, j], tail[1], gamma_enet) for j in range(k - 1)], 1)
            else:
                new = np.linalg.solve(xx + 1e-6 * np.eye(p), xe)
            s = (nus + ee - new.T @ xe - xe.T @ new + new.T @ xx @ new) / max(tail[1], 1)
            s = (s + s.T) / 2
            s = (1 - self.sigma_shrink) * s + self.sigma_shrink * np.diag(np.diag(s)) + 1e-6 * np.eye(k - 1)
            return ss.reshape(k, g, v), new, s, tail

        rounds = Rounds(data, {"eta": "array<double>"}, self.seed)
        if inference == "svi":
            count = data.count()
            parts_ = max(1, round(count / batch_size))
            key, t = F.pmod(F.xxhash64("doc_id", F.lit(self.seed)), F.lit(parts_)), 0
            held = data.withColumn("_m", key)
            stat = np.full((k, g, v), 1e-8)
            columns = ["doc_id", "bag", "x", *(["group"] if content is not None else [])]
            for _ in range(iters):
                for m in range(parts_):
                    t += 1
                    rho, sh = (tau + t) ** -kappa, shared()
                    got = sums_over(held.filter(F.col("_m") == m), columns, lambda b, sh=sh: e_step(b, sh, None)[1], length)
                    if not got[-1]:
                        continue
                    ss, new, s, tail = m_step(got)
                    stat = (1 - rho) * stat + rho * ss * count / tail[1]
                    gamma, sigma = (1 - rho) * gamma + rho * new, (1 - rho) * sigma + rho * s
                    beta = self._wording(stat[:, 0])[:, None] if content is None else (stat + 1e-8) / (stat + 1e-8).sum(2, keepdims=True)
                self.bound_history.append(float(tail[0] * count / tail[1]))
            rounds.step(kernel, shared(), length)
        else:
            for _ in range(iters):
                ss, new, s, tail = m_step(rounds.step(kernel, shared(), length))
                self.bound_history.append(float(tail[0]))
                if len(self.bound_history) > 1:
                    last = self.bound_history[-2]
                    self.converged = abs(self.bound_history[-1] - last) <= convergence_tol * abs(last)
                    if self.converged:
                        break
                gamma, sigma = new, s
                if content is None:
                    beta = self._wording(ss[:, 0])[:, None]
                else:
                    deviations = fit_deviations(ss, deviations, background, content_variance, 15)
                    beta = group_wording(background, *deviations)
        self._state, self._beta, self._gamma, self._sigma, self._wordless = rounds.state, beta, gamma, sigma, enc.wordless()
        self.topic_word = beta.mean(1) if g > 1 else beta[:, 0]
        self.topic_word_by_group = beta
        self.prevalence_effects, self.topic_covariance = gamma, sigma
        return self

    @staticmethod
    def _shares(rows: DataFrame, *keys: str) -> DataFrame:
        e = F.concat("eta", F.array(F.lit(0.0)))
        e = F.transform(e, lambda x: F.exp(x - F.array_max(F.concat("eta", F.array(F.lit(0.0))))))
        total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
        return rows.select(*keys, F.posexplode(F.transform(e, lambda x: x / total)).alias("topic", "p"))

    def doc_topic(self) -> DataFrame:
        """(doc_id, topic, p): softmax of the modes, the last topic as reference; a document without a kept word has equal shares."""
        empty = self._wordless.withColumn("eta", F.array_repeat(F.lit(0.0), self.num_topics - 1))
        return self._shares(self._state.select("doc_id", "eta").unionByName(empty), "doc_id")

    def eta_mean(self) -> DataFrame:
        return self._state.select("doc_id", "eta")

    def eta_cov(self) -> DataFrame:
        """(doc_id, eta, nu ARRAY<DOUBLE> of (K - 1)^2): the Laplace covariance at every document's mode, made anew from the fit."""
        k, p, sh = self.num_topics, len(self.feature_names), (self._beta, self._gamma, np.linalg.inv(self._sigma))
        held, diagonal = self.spark.sparkContext.broadcast(sh), self.variational == "diagonal"

        def run(batches):
            beta, gamma, precision = held.value
            for b in batches:
                if not b.num_rows:
                    continue
                per, w, n = bags(b)
                doc, eta = np.repeat(np.arange(len(per)), per), matrix_of(b.column("eta"), k - 1)
                group = b.column("group").to_numpy() if "group" in b.schema.names else np.zeros(len(per), int)
                nu = laplace(eta, beta[:, group[doc], w].T, n.astype(float), doc, matrix_of(b.column("x"), p) @ gamma, precision, diagonal)[0]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("eta"), listed(nu.reshape(len(per), -1))], names=["doc_id", "eta", "nu"])

        return self._state.mapInArrow(run, f"doc_id {dict(self._state.dtypes)['doc_id']}, eta array<double>, nu array<double>")

    def posterior_theta_samples(self, nsims: int = 25, seed: int = 0) -> DataFrame:
        """(draw, doc_id, topic, p): softmax of draws from each document's N(eta, nu)."""
        k = self.num_topics

        def run(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                eta, nu = matrix_of(b.column("eta"), k - 1), matrix_of(b.column("nu"), (k - 1) ** 2).reshape(-1, k - 1, k - 1)
                out = []
                for key, e, c in zip(b.column("doc_id").to_pylist(), eta, nu):
                    rng = np.random.default_rng([seed, zlib.crc32(str(key).encode())])
                    out.append(full(rng.multivariate_normal(e, c, nsims, method="eigh")).tolist())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(pa.list_(pa.float64())))], names=["doc_id", "t"])

        drawn = self.eta_cov().mapInArrow(run, f"doc_id {dict(self._state.dtypes)['doc_id']}, t array<array<double>>")
        return drawn.select("doc_id", F.posexplode("t").alias("draw", "t")).select("draw", "doc_id", F.posexplode("t").alias("topic", "p"))

    def transform(self, docs: DataFrame, prevalence: DataFrame | None = None, iters: int = 60) -> DataFrame:
        """(doc_id, topic, p) of other documents with everything fitted kept; their prior mean is x gamma (zeros where a covariate is missing).

        Unknown words are dropped; a document without a known word has equal shares.
        """
        k, p = self.num_topics, len(self.feature_names)
        names = self.feature_names[1:]
        data = docs.select("doc_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"))
        if prevalence is not None:
            data = data.join(prevalence.select("doc_id", *[F.col(f"`{f}`").cast("double").alias(f) for f in names]), "doc_id", "left")
        x = F.array(F.lit(1.0), *[F.coalesce(F.col(f"`{f}`"), F.lit(0.0)) if prevalence is not None else F.lit(0.0) for f in names])
        held = self.spark.sparkContext.broadcast((self.topic_word, {t: i for i, t in enumerate(self.vocabulary)}, self._gamma, np.linalg.inv(self._sigma)))

        def run(batches):
            beta, at, gamma, precision = held.value
            for b in batches:
                if not b.num_rows:
                    continue
                t = b.column("tokens")
                code = np.array([at.get(s, -1) for s in t.flatten().to_pylist()], np.int64)
                doc = np.repeat(np.arange(b.num_rows), np.diff(t.offsets.to_numpy()))[code >= 0]
                key, n = np.unique((doc << 32) | code[code >= 0], return_counts=True)
                doc, w, mu = key >> 32, key & 0xFFFFFFFF, matrix_of(b.column("x"), p) @ gamma
                eta = modes(mu.copy(), beta[:, w].T, n.astype(float), doc, mu, precision, iters)
                eta[np.bincount(doc, minlength=len(eta)) == 0] = 0.0
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), listed(eta)], names=["doc_id", "eta"])

        return self._shares(data.select("doc_id", "tokens", x.alias("x")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, eta array<double>"), "doc_id")

    def word_contrast(self, topic: int, a, b, n: int = 10) -> list[tuple[str, float]]:
        """The words whose log ratio between two groups' wording of a topic is greatest."""
        p = self.topic_word_by_group[topic]
        ratio = np.log(p[self.groups.index(a)]) - np.log(p[self.groups.index(b)])
        return [(self.vocabulary[i], float(ratio[i])) for i in np.lexsort((np.arange(len(ratio)), -ratio))[:n]]

    def topic_correlation(self) -> DataFrame:
        from ..operators.diagnostics import topic_correlation

        return topic_correlation(self.doc_topic())


class CTM(STM):
    """Correlated topic model: no covariates."""

    def fit(self, docs: DataFrame, **options) -> "CTM":
        return super().fit(docs, **options)
