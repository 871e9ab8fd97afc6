"""First topics from second moments of words: anchor words, and every word as a mixture of them."""

from __future__ import annotations

import numpy as np

from .base import MOST_CELLS, Encoded
from .engine import bags, by_doc, sums_over

# fixed values: words up to which moments are kept whole, width and seed of the projection beyond
WHOLE, WIDTH, SEED = 3000, 1024, 7919

#: Documents whose words meet in one product; fewer hold fewer distinct words, more make fewer products.
TOGETHER = 128


def moments(enc: Encoded) -> tuple[np.ndarray, np.ndarray] | None:
    """(rows, marginals): row-normalized second moments of words, or their +-1 projection where there are many words.

    Every task adds the moments of its documents of two tokens or more; None where there is no such document.
    """
    v = len(enc.terms)
    whole = v <= WHOLE
    width = v if whole else WIDTH
    if v * width > MOST_CELLS:
        raise ValueError(f"{v} words exceed the moments' {MOST_CELLS} cells; prune the vocabulary")
    signs = None if whole else np.random.default_rng(SEED).choice([-1.0, 1.0], (v, width)).astype(np.float32)
    held = enc.spark.sparkContext.broadcast(signs)

    def part(b):
        out, sums, used = np.zeros((v, width)), np.zeros(v), 0
        per, w, n = bags(b)
        size = by_doc(n, per)
        use = np.repeat(size > 1, per)
        per, w, n, size = per[size > 1], w[use], n[use], size[size > 1]
        ends = np.r_[0, np.cumsum(per)]
        kind = np.float64 if whole else np.float32  # sums of blocks are added up in double precision
        for lo in range(0, len(per), TOGETHER):
            hi = min(lo + TOGETHER, len(per))
            c = slice(ends[lo], ends[hi])
            # only words that these documents hold
            words, at = np.unique(w[c], return_inverse=True)
            x = np.zeros((hi - lo, len(words)), kind)
            x[np.repeat(np.arange(hi - lo), per[lo:hi]), at] = n[c]
            y = x / (size[lo:hi] * (size[lo:hi] - 1)).astype(kind)[:, None]
            own = y.sum(0)
            if whole:
                out[np.ix_(words, words)] += x.T @ y
                out[words, words] -= own
            else:
                r = held.value[words]
                out[words] += x.T @ (y @ r) - own[:, None] * r
        sums += np.bincount(w, n / np.repeat(size, per), v)
        used += len(per)
        return np.r_[out.ravel(), sums, used]

    got = sums_over(enc.docs, ["bag"], part, v * width + v + 1)
    used = got[-1]
    if not used:
        return None
    p = got[-1 - v : -1] / used
    return got[: v * width].reshape(v, width) / used / np.maximum(p, 1e-300)[:, None], p


def anchor_words(rows: np.ndarray, p: np.ndarray, k: int, least: float) -> np.ndarray | None:
    """k words whose rows span most, each the one with the largest part outside the span of those before; rare words stay out."""
    able = np.nonzero(p >= least)[0]
    if len(able) < k:
        return None
    rest, chosen = rows[able].astype(float).copy(), []
    for _ in range(k):
        size = (rest * rest).sum(1)
        size[chosen] = -1
        at = int(size.argmax())
        if size[at] < 1e-12:
            return None
        chosen.append(at)
        axis = rest[at] / np.sqrt(size[at])
        rest -= np.outer(rest @ axis, axis)
    return able[chosen]


def mixtures(rows: np.ndarray, anchors: np.ndarray, steps: int = 300, rate: float = 50.0) -> np.ndarray:
    """(V, k): every row as a convex mixture of the anchors' rows of least squares, by exponentiated gradient on all rows at once."""
    c = rows[anchors]
    gram, target = c @ c.T, rows @ c.T
    x = np.full((len(rows), len(anchors)), 1 / len(anchors))
    scale = rate / max(np.abs(gram).max(), 1e-300) / 10
    for _ in range(steps):
        g = x @ gram - target
        x = x * np.exp(-scale * (g - g.min(1, keepdims=True)))
        x /= x.sum(1, keepdims=True)
    x[anchors] = np.eye(len(anchors))
    return x


def spectral_init(enc: Encoded, k: int) -> np.ndarray | None:
    """(K, V) topics, or None where the words cannot be told apart well enough."""
    if len(enc.terms) < k:
        return None
    got = moments(enc)
    if got is None:
        return None
    rows, p = got
    for least in (0.2 / len(p), 0.0):
        anchors = anchor_words(rows, p, k, least)
        if anchors is not None:
            break
    else:
        return None
    beta = (mixtures(rows, anchors) * p[:, None]).T + 1e-10
    return beta / beta.sum(1, keepdims=True)
