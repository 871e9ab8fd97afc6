"""Special functions and small optimizers NumPy lacks."""

from __future__ import annotations

import math

import numpy as np


def lgamma(x) -> np.ndarray:
    """ln Gamma for x > 0: the recurrence up to 9, then Stirling's series."""
    x = np.array(x, float)
    prod = np.ones_like(x)
    for _ in range(9):
        low = x < 9
        if not low.any():
            break
        prod = np.where(low, prod * np.where(low, x, 1), prod)
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r * (1 / 1680 - r / 1188)))) / x
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + series - np.log(prod)


def digamma(x) -> np.ndarray:
    """Derivative of lgamma for x > 0: recurrence up to 6, then the asymptotic series."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(6):
        low = x < 6
        out = np.where(low, out - 1 / np.where(low, x, 1), out)
        x = np.where(low, x + 1, x)
    r = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - r * (1 / 12 - r * (1 / 120 - r / 252))


def prior_terms(counts: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """What documents (D, K) add to a step of ``minka_steps``: K numerators and the denominator."""
    total = alpha.sum()
    num = (digamma(counts + alpha) - digamma(alpha)).sum(0)
    return np.r_[num, (digamma(counts.sum(1) + total) - digamma(total)).sum()]


def minka_steps(terms, alpha: np.ndarray, steps: int = 20) -> np.ndarray:
    """Fixed-point update of an asymmetric Dirichlet prior; ``terms(alpha)`` sums ``prior_terms`` over all documents."""
    for _ in range(steps):
        t = terms(alpha)
        alpha = np.maximum(alpha * t[:-1] / max(t[-1], 1e-12), 1e-6)
    return alpha


def minka_alpha(counts: np.ndarray, alpha: np.ndarray, steps: int = 20) -> np.ndarray:
    """Fixed-point update of an asymmetric Dirichlet prior from document-topic counts (D, K)."""
    return minka_steps(lambda a: prior_terms(counts, a), alpha, steps)


def hungarian(cost: np.ndarray) -> np.ndarray:
    """Column of each row in an assignment of least cost, by shortest augmenting paths; -1 for rows that get none."""
    cost = np.asarray(cost, float)
    n, m = cost.shape
    if n > m:
        out = np.full(n, -1)
        rows = hungarian(cost.T)
        out[rows] = np.arange(m)
        return out
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j, least, way, used = i, 0, np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while match[j]:
            used[j] = True
            row = cost[match[j] - 1] - u[match[j]] - v[1:]
            better = ~used[1:] & (row < least[1:])
            least[1:][better], way[1:][better] = row[better], j
            free = np.where(used[1:], np.inf, least[1:])
            nxt = int(free.argmin()) + 1
            step = free[nxt - 1]
            u[match[used]] += step
            v[used] -= step
            least[1:][~used[1:]] -= step
            j = nxt
        while j:
            match[j] = match[way[j]]
            j = way[j]
    out = np.zeros(n, int)
    out[match[1:][match[1:] > 0] - 1] = np.nonzero(match[1:] > 0)[0]
    return out


def lbfgs(f, x: np.ndarray, steps: int = 50, history: int = 7, tol: float = 1e-7) -> np.ndarray:
    """Minimize f (value, gradient) with limited memory and Armijo steps."""
    val, g = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        if np.abs(g).max() < tol:
            break
        q, coef = g.copy(), []
        for s, y in reversed(past):
            a = (s @ q) / (s @ y)
            coef.append(a)
            q -= a * y
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(coef)):
            q += s * (a - (y @ q) / (s @ y))
        d = -q if q @ g > 0 else -g
        t = 1.0 if past else 1.0 / max(1.0, np.linalg.norm(g))
        for _ in range(30):
            new, ng = f(x + t * d)
            if new <= val + 1e-4 * t * (g @ d):
                break
            t /= 2
        else:
            break
        s, y = t * d, ng - g
        if s @ y > 1e-12:
            past = [*past, (s, y)][-history:]
        x, val, g = x + s, new, ng
    return x


def minka_symmetric(counts: np.ndarray, alpha: float, steps: int = 20) -> float:
    """Fixed-point update of the shared concentration of a symmetric Dirichlet prior from counts (D, K)."""
    k = counts.shape[1]
    for _ in range(steps):
        t = prior_terms(counts, np.full(k, alpha))
        alpha = max(alpha * t[:-1].sum() / max(k * t[-1], 1e-12), 1e-6)
    return float(alpha)


def minka_beta(table: np.ndarray, beta: float, steps: int = 20) -> float:
    """The same update of the word prior, from topic-word counts (K, V)."""
    return minka_symmetric(table, beta, steps)


def gamma_upper(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function Q(a, x): series below a + 1, continued fraction above."""
    if x < 0 or a <= 0:
        raise ValueError("need x >= 0 and a > 0")
    if x == 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        step = c * d
        h *= step
        if abs(step - 1) < 1e-15:
            break
    return front * h


def chisq_upper(x: float, df: float) -> float:
    """P(chi-square with ``df`` degrees of freedom > x); NaN for df <= 0."""
    return gamma_upper(df / 2, x / 2) if df > 0 else float("nan")


def normal_quantile(q: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(q)


def logsumexp(x: np.ndarray, axis=-1) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def softmax(x: np.ndarray, axis=-1) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def make_dominant(h: np.ndarray) -> np.ndarray:
    """A symmetric matrix made positive definite: every diagonal entry at least the sum of the others of its row."""
    out = h.copy()
    at = np.arange(len(h))
    out[at, at] = np.maximum(h[at, at], np.abs(h).sum(1) - np.abs(h[at, at]))
    return out


def agglomerative(distance: np.ndarray, k: int) -> np.ndarray:
    """Labels 0 .. k - 1 by average linkage on a distance matrix; the closest pair of lowest numbers merges first.

    For matrices that fit on the driver: n^2 cells, n merges.
    """
    d = np.array(distance, float)
    n = len(d)
    if k >= n:
        return np.arange(n)
    np.fill_diagonal(d, np.inf)
    size, group = np.ones(n), np.arange(n)
    for _ in range(n - max(1, k)):
        i, j = np.unravel_index(int(d.argmin()), d.shape)
        i, j = min(i, j), max(i, j)
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        row[i] = np.inf
        d[i], d[:, i], d[j], d[:, j] = row, row, np.inf, np.inf
        size[i] += size[j]
        group[group == j] = i
    return np.unique(group, return_inverse=True)[1]
