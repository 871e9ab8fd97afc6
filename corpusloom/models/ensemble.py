"""Alignment, stability and consensus of fitted topics (runs x topics rows, on the driver)."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from ..functions.num import agglomerative, hungarian

# fixed values: decay of rank-biased overlap; bounds under which a consensus topic is not reliable; mass below which a masked distance is 1
RBO, STABLE, SUPPORTED, MARGIN, SKIP = 0.9, 0.5, 0.5, 0.1, 0.05


def _topics(run) -> np.ndarray:
    return np.asarray(getattr(run, "topic_word", run), float)


def order_of(row: np.ndarray, n: int) -> np.ndarray:
    """The n greatest entries, of equal ones the earlier."""
    return np.lexsort((np.arange(len(row)), -row))[:n]


def distances(a: np.ndarray, b: np.ndarray, metric: str = "cosine") -> np.ndarray:
    """Cosine distance, or Jensen-Shannon divergence in nats, of every two topics."""
    if metric == "cosine":
        unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
        return 1 - unit(a) @ unit(b).T
    if metric == "js":
        kl = lambda p, q: np.where(p > 0, p * np.log(np.maximum(p, 1e-300) / np.maximum(q, 1e-300)), 0).sum(-1)
        out = np.empty((len(a), len(b)))
        for i, p in enumerate(a):
            m = (p + b) / 2
            out[i] = (kl(np.broadcast_to(p, b.shape), m) + kl(b, m)) / 2
        return out
    raise ValueError(f"unknown metric {metric!r}")


def align_topics(a, b, metric: str = "cosine") -> tuple[np.ndarray, np.ndarray]:
    """(match, distance): for each topic of ``a`` its partner in ``b`` in the assignment of least cost, -1 where ``b`` has too few."""
    cost = distances(_topics(a), _topics(b), metric)
    match = hungarian(cost)
    return match, np.where(match >= 0, cost[np.arange(len(cost)), match], np.nan)


def overlap(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


def topic_overlaps(runs, topn: int = 10) -> np.ndarray:
    """(runs - 1, K): Jaccard of top words between each topic of the first run and its partner in every other."""
    top = [[set(order_of(r, topn).tolist()) for r in _topics(run)] for run in runs]
    return np.array([[overlap(x, other[j]) if j >= 0 else 0.0 for x, j in zip(top[0], align_topics(runs[0], run)[0])] for run, other in zip(runs[1:], top[1:])])


def topic_stability(runs, topn: int = 10) -> float:
    """Mean Jaccard of the top words of matched topics, over all other runs and topics."""
    return float(topic_overlaps(runs, topn).mean()) if len(runs) > 1 else float("nan")


@dataclass
class Ensemble:
    """A consensus model: ``topic_word`` (K, V), the mean ``doc_topic`` (D, K) where the runs share documents, and how well each topic is backed."""

    topic_word: np.ndarray
    doc_topic: np.ndarray | None
    vocabulary: list[str] | None
    stability: np.ndarray
    support: np.ndarray
    reliable: np.ndarray
    agreement: float
    method: str
    n_runs: int
    cluster_sizes: np.ndarray | None = None
    reference: int | None = None
    extra: dict = field(default_factory=dict)

    @property
    def num_topics(self) -> int:
        return len(self.topic_word)

    def top_words(self, n: int = 10) -> list[list[tuple]]:
        name = (lambda i: int(i)) if self.vocabulary is None else (lambda i: self.vocabulary[i])
        return [[(name(i), float(row[i])) for i in order_of(row, n)] for row in self.topic_word]


def rbo(a, b, p: float = RBO) -> float:
    """Rank-biased overlap of two ranked lists, extrapolated; 1 for equal lists."""
    depth = max(len(a), len(b))
    if not depth:
        return 1.0
    shared = np.array([len(set(a[:d]) & set(b[:d])) for d in range(1, depth + 1)], float)
    d = np.arange(1, depth + 1)
    return float(shared[-1] / depth * p**depth + (1 - p) / p * (shared / d * p**d).sum())


def mean_jaccard(a, b) -> float:
    """Mean Jaccard over all prefixes of two ranked lists."""
    depth = max(len(a), len(b))
    return float(np.mean([overlap(set(a[:d]), set(b[:d])) for d in range(1, depth + 1)])) if depth else 1.0


def rank_distances(rows: np.ndarray, topn: int, kind: str) -> np.ndarray:
    """1 - similarity of the top lists of every two rows, by ``rbo`` or ``jaccard``."""
    like = {"rbo": rbo, "jaccard": mean_jaccard}[kind]
    top = [order_of(r, topn).tolist() for r in rows]
    out = np.zeros((len(rows), len(rows)))
    for i, j in zip(*np.triu_indices(len(rows), 1)):
        out[i, j] = out[j, i] = 1 - like(top[i], top[j])
    return out


def _weights(w, n: int) -> np.ndarray:
    w = np.ones(n) if w is None else np.asarray(w, float)
    if w.shape != (n,) or (w < 0).any() or w.sum() <= 0:
        raise ValueError("weights must be one non-negative number a run, not all zero")
    return w / w.sum()


def _scaled(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(m.sum(1, keepdims=True), 1e-300)


def ensemble(runs, method: str = "cluster", *, num_topics: int | None = None, lambda_: float = 0.5, distance: str = "rbo", topn: int = 10, weights=None, reference="medoid", metric: str = "cosine", eps: float = 0.1, min_samples: int | None = None, min_cores: int | None = None, masking: str = "mass", masking_threshold: float | None = None, thetas: list[np.ndarray] | None = None) -> Ensemble:
    """Consensus of several fits of the same shape.

    ``cluster``: all topics pooled, their rank distances (of words, and with ``thetas`` (D, K) of documents, blended
    by ``lambda_``) cut into ``num_topics`` clusters by average linkage, cluster means taken.  ``align``: every
    run matched to a reference run (``medoid``, ``first`` or its number) and averaged.  ``stable``: dense cores
    of masked distances; only topics that enough runs find again come out.
    """
    runs = list(getattr(runs, "models", runs))
    if len(runs) < 2:
        raise ValueError("need at least two runs")
    betas = [_topics(r) for r in runs]
    if len({b.shape for b in betas}) > 1:
        raise ValueError("all runs must have the same shape")
    words = getattr(runs[0], "vocabulary", None)
    common = dict(vocabulary=None if words is None else list(words), n_runs=len(runs), method=method)
    if method == "cluster":
        return _cluster(betas, thetas, num_topics, lambda_, distance, topn, _weights(weights, len(runs)), common)
    if method == "align":
        return _align(betas, thetas, reference, metric, topn, _weights(weights, len(runs)), common)
    if method == "stable":
        return _stable(betas, thetas, eps, min_samples, min_cores, masking, masking_threshold, common)
    raise ValueError(f"unknown method {method!r}")


def _consensus(groups, rows, docs, weight, gaps, run_of, n_runs):
    """Means of groups of pooled topics with their inner agreement, share of runs and size."""
    mean = lambda m, g: np.average(m[g], axis=0, weights=weight[run_of[g]])
    beta = _scaled(np.stack([mean(rows, g) for g in groups]))
    theta = None if docs is None else _scaled(np.stack([mean(docs, g) for g in groups]).T)
    inner = [1 - gaps[np.ix_(g, g)][~np.eye(len(g), dtype=bool)].mean() if len(g) > 1 else 1.0 for g in groups]
    return beta, theta, np.array(inner), np.array([len(set(run_of[g])) / n_runs for g in groups]), np.array([len(g) for g in groups])


def _cluster(betas, thetas, num_topics, lam, distance, topn, weight, common):
    rows = np.concatenate(betas)
    docs = None if thetas is None else np.concatenate([t.T for t in thetas])
    run_of = np.repeat(np.arange(len(betas)), len(betas[0]))
    gaps = rank_distances(rows, topn, distance)
    if docs is not None:
        gaps = lam * gaps + (1 - lam) * rank_distances(docs, topn, distance)
    label = agglomerative(gaps, num_topics or len(betas[0]))
    beta, theta, stable, support, size = _consensus([np.nonzero(label == c)[0] for c in range(label.max() + 1)], rows, docs, weight, gaps, run_of, len(betas))
    # the best backed topics first
    o = np.lexsort((-stable, -support))
    reliable = (stable >= STABLE) & (support >= SUPPORTED)
    return Ensemble(beta[o], None if theta is None else theta[:, o], stability=stable[o], support=support[o], reliable=reliable[o], agreement=float(stable.mean()), cluster_sizes=size[o], **common)


def _align(betas, thetas, reference, metric, topn, weight, common):
    if reference == "medoid":
        cost = [sum(np.nanmean(align_topics(a, b, metric)[1]) for b in betas if b is not a) for a in betas]
        ref = int(np.argmin(cost))
    elif reference == "first":
        ref = 0
    elif isinstance(reference, (int, np.integer)) and 0 <= reference < len(betas):
        ref = int(reference)
    else:
        raise ValueError("reference must be 'medoid', 'first' or the number of a run")
    top = lambda m: [set(order_of(r, topn).tolist()) for r in m]
    k, first = len(betas[0]), top(betas[ref])
    perms = [align_topics(betas[ref], b, metric)[0] for b in betas]
    quality, margin = np.zeros((len(betas), k)), np.zeros((len(betas), k))
    for r, (b, perm) in enumerate(zip(betas, perms)):
        jac = np.array([[overlap(x, y) for y in top(b)] for x in first])
        at = jac[np.arange(k), perm]
        jac[np.arange(k), perm] = -np.inf
        quality[r], margin[r] = at, at - jac.max(1) if k > 1 else at
    beta = _scaled(np.tensordot(weight, np.stack([b[p] for b, p in zip(betas, perms)]), 1))
    theta = None if thetas is None else _scaled(np.tensordot(weight, np.stack([t[:, p] for t, p in zip(thetas, perms)]), 1))
    stable, support = weight @ quality, weight @ margin
    return Ensemble(beta, theta, stability=stable, support=support, reliable=(stable >= STABLE) & (support >= MARGIN), agreement=float(stable.mean()), reference=ref, **common)


def mass_mask(row: np.ndarray, threshold: float | None = None) -> np.ndarray:
    """The greatest entries whose running sum stays below the threshold (default .95); at least the greatest."""
    down = np.sort(row)[::-1]
    n = int((np.cumsum(down) < (0.95 if threshold is None else threshold)).sum())
    return row >= down[max(n, 1) - 1]


def rank_mask(row: np.ndarray, threshold: float | None = None) -> np.ndarray:
    """The entries above that of rank threshold x length (default .11)."""
    return row > np.sort(row)[::-1][int(len(row) * (0.11 if threshold is None else threshold))]


def masked_distances(rows: np.ndarray, masking: str = "mass", threshold: float | None = None) -> np.ndarray:
    """(i, j): cosine distance on the terms that row i's mask selects; 1 where row j has nearly no mass there."""
    mask = {"mass": mass_mask, "rank": rank_mask}[masking]
    out = np.ones((len(rows), len(rows)))
    for i, r in enumerate(rows):
        m = mask(r, threshold)
        b, a = rows[:, m], r[m]
        size = np.linalg.norm(b, axis=1) * np.linalg.norm(a)
        fine = (b.sum(1) > SKIP) & (size > 0)
        out[i, fine] = 1 - b[fine] @ a / size[fine]
        out[i, i] = 0.0
    return out


def checkback_dbscan(gaps: np.ndarray, eps: float, min_samples: int) -> tuple[np.ndarray, np.ndarray, list[set]]:
    """(label, core, labels met): DBSCAN from the densest point on; a point of which under a quarter of its parent's neighbours is near opens a new cluster."""
    n = len(gaps)
    away = gaps.copy()
    np.fill_diagonal(away, 1.0)
    label, core, met, seen = np.full(n, -1), np.zeros(n, bool), [set() for _ in range(n)], np.zeros(n, bool)
    fresh = 0
    for start in np.lexsort((np.arange(n), away.min(1))):
        if seen[start]:
            continue
        # a frame: point, the label handed down, the parent's neighbourhood, its own neighbours still to visit
        todo = [(int(start), None, None)]
        frames: list[list] = []
        while todo or frames:
            if todo:
                at, given, around = todo.pop()
                seen[at] = True
                near = [int(j) for j in np.lexsort((np.arange(n), away[at])) if away[at, j] < eps]
                if len(near) < min_samples:
                    label[at] = -1 if given is None else given
                    continue
                if given is None or (away[at, around] < eps).mean() < 0.25:
                    given, fresh = fresh, fresh + 1
                core[at], label[at] = True, given
                frames.append([at, given, near, 0])
            top = frames[-1]
            if top[3] and top[3] <= len(top[2]):
                met[top[2][top[3] - 1]].add(top[1])
            if top[3] == len(top[2]):
                frames.pop()
                continue
            nxt = top[2][top[3]]
            top[3] += 1
            if not seen[nxt]:
                todo.append((nxt, top[1], [*top[2], top[0]]))
    return label, core, met


def stable_labels(label: np.ndarray, core: np.ndarray, met: list[set], min_cores: int) -> set[int]:
    """Labels of clusters with enough cores that have met no other label; failing clusters no longer count as met."""
    groups = {int(c): [set(met[i]) for i in np.nonzero(core & (label == c))[0]] for c in np.unique(label[core])}
    order = sorted(groups, key=lambda c: (max(map(len, groups[c])), len(groups[c]), c))
    fine: set[int] = set()
    gone: set[int] = {c for c in order if len(groups[c]) < min_cores}
    for c in order:
        if c in gone:
            continue
        if sum(bool(m) and m - gone == {c} for m in groups[c]) >= min_cores:
            fine.add(c)
        else:
            gone.add(c)
    return fine


def _stable(betas, thetas, eps, min_samples, min_cores, masking, threshold, common):
    m = len(betas)
    min_samples = m // 2 if min_samples is None else min_samples
    min_cores = min(3, max(1, m // 4 + 1)) if min_cores is None else max(1, min_cores)
    rows = np.concatenate(betas)
    docs = None if thetas is None else np.concatenate([t.T for t in thetas])
    run_of = np.repeat(np.arange(m), len(betas[0]))
    gaps = masked_distances(rows, masking, threshold)
    label, core, met = checkback_dbscan(gaps, eps, min_samples)
    fine = stable_labels(label, core, met, min_cores)
    valid = np.array([core[i] and (met[i] & fine) == {int(label[i])} for i in range(len(rows))])
    groups = [np.nonzero(valid & (label == c))[0] for c in np.unique(label[valid])]
    if not groups:
        none = np.empty(0)
        return Ensemble(np.empty((0, rows.shape[1])), None, stability=none, support=none, reliable=none.astype(bool), agreement=float("nan"), cluster_sizes=none.astype(int), **common)
    beta, theta, stable, support, size = _consensus(groups, rows, docs, np.full(m, 1 / m), gaps, run_of, m)
    return Ensemble(beta, theta, stability=stable, support=support, reliable=(stable >= STABLE) & (support >= SUPPORTED), agreement=float(stable.mean()), cluster_sizes=size, **common)


def ensemble_align(runs, **options) -> np.ndarray:
    """Topics of ``ensemble(runs, "align")``."""
    return ensemble(runs, "align", **options).topic_word
