"""Binary trie self-join of bit sketches with a Hamming error budget."""

from __future__ import annotations

import numpy as np


def _words(sketch: np.ndarray) -> np.ndarray:
    """Sketch bytes as 64-bit words whose numeric order is the order of the bits."""
    n, width = sketch.shape
    room = -(-width // 8) * 8
    wide = np.zeros((n, room), np.uint8)
    wide[:, :width] = sketch
    return wide.view(">u8").astype(np.uint64)


def _first_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading bits in which the rows of a and b (n, words) agree."""
    x = a ^ b
    out = np.full(len(x), 64 * x.shape[1])
    for c in range(x.shape[1] - 1, -1, -1):
        some = x[:, c] != 0
        v = x[some, c]
        lead = np.zeros(len(v), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            high = (v >> np.uint64(64 - step)) == 0
            lead += np.where(high, step, 0)
            v = np.where(high, v << np.uint64(step), v)
        out[some] = 64 * c + lead
    return out


def _masks(words: int) -> np.ndarray:
    """Row d: the first d bits set."""
    depth = np.arange(64 * words + 1)
    out = np.zeros((len(depth), words), np.uint64)
    for c in range(words):
        k = np.clip(depth - 64 * c, 0, 64)
        out[:, c] = np.where(k > 0, np.uint64(0xFFFFFFFFFFFFFFFF) << (64 - np.maximum(k, 1)).astype(np.uint64), np.uint64(0))
    return out


class Trie:
    """Path-compressed binary tries, one below each value of ``head``.

    Nodes are kept as arrays: ``depth`` bits all rows of a node agree on, a row that shows them,
    the two children, and ``first``/``last`` of its rows in order; rows of equal sketches share a leaf.
    """

    def __init__(self, head: np.ndarray, sketch: np.ndarray):
        words = _words(sketch)
        keys = [words[:, c] for c in range(words.shape[1] - 1, -1, -1)]
        self.order = np.lexsort([*keys, head])
        self.words, self.bits = words[self.order], 64 * words.shape[1]
        h = head[self.order]
        n = len(h)
        agree = _first_difference(self.words[1:], self.words[:-1])
        agree[h[1:] != h[:-1]] = -1
        edge = np.r_[True, agree < self.bits]
        start = np.nonzero(edge)[0]
        leaves = len(start)
        # an inner node for every gap between neighbouring leaves of a trie; its depth is the bits they share
        gap = agree[start[1:] - 1]
        before, after = _nearest_less(gap, -1), _nearest_less(gap, 1)
        inner = np.nonzero(gap >= 0)[0]
        node = np.full(len(gap) + 2, -1)  # by gap, with one place at each end
        node[inner + 1] = leaves + np.arange(len(inner))
        bits = np.r_[-1, gap, -1]
        self.depth = np.r_[np.full(leaves, self.bits), gap[inner]]
        self.first = np.r_[start, start[before[inner] + 1]]
        self.last = np.r_[start[1:], n, np.r_[start, n][after[inner] + 1]].astype(np.int64)
        self.show = self.first
        # the parent is the deeper of the two gaps around a node; it is the left child of the right one
        lo = np.r_[np.arange(leaves), before[inner] + 1]
        hi = np.r_[np.arange(leaves) + 1, after[inner] + 1]
        up_left = bits[hi] > bits[lo]
        parent = np.where(up_left, node[hi], node[lo])
        self.roots = np.nonzero(parent < 0)[0]
        self.left, self.right = np.full(len(parent), -1), np.full(len(parent), -1)
        kid = np.nonzero(parent >= 0)[0]
        self.left[parent[kid[up_left[kid]]]] = kid[up_left[kid]]
        self.right[parent[kid[~up_left[kid]]]] = kid[~up_left[kid]]

    def greatest(self, term: np.ndarray) -> np.ndarray:
        """Greatest ``term`` (in row order) below every node."""
        return np.array([0.0]) if not len(self.first) else _range_max(term[self.order], self.first, self.last)


def _nearest_less(x: np.ndarray, way: int) -> np.ndarray:
    """Index of the nearest smaller element before (way -1) or after (1) every element; -1 or len(x) for none."""
    n = len(x)
    at = np.arange(n) + way
    value = np.r_[x, np.iinfo(np.int64).min]  # both ends read the last place
    open_ = np.nonzero(value[at] >= x)[0] if n else at
    while len(open_):
        at[open_] = np.where(at[open_] < 0, at[open_], at[np.clip(at[open_], 0, n - 1)])
        open_ = open_[value[at[open_]] >= x[open_]]
    return at


def _range_max(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Maximum of x[lo:hi] for many non-empty ranges, from maxima over powers of two."""
    table, step = [x], 1
    while 2 * step <= len(x):
        table.append(np.maximum(table[-1][:-step], table[-1][step:]))
        step *= 2
    level = np.floor(np.log2(hi - lo)).astype(int)
    out = np.empty(len(lo), x.dtype)
    for k in np.unique(level):
        at = np.nonzero(level == k)[0]
        out[at] = np.maximum(table[k][lo[at]], table[k][hi[at] - (1 << k)])
    return out


def self_join(head: np.ndarray, sketch: np.ndarray, budget, prepare, pairs=None, least=None, most_of=None, possible=None, most: int = 1 << 19):
    """Pairs (i, j) whose heads are equal and whose sketches differ in no more bits than allowed.

    ``budget(i, j)`` gives the allowed errors for two values of ``prepare`` (its greatest below a node,
    or of a row) and must grow with both.  Node pairs start at every root with itself and are
    expanded together, the shallower node into its two children; bits that differ on the
    part both nodes agree on are the errors so far, and a pair is dropped once they exceed the
    greatest budget of its rows.  ``possible(low_a, high_a, low_b, high_b)`` may drop a node pair before its
    bits are read, by the smallest ``least`` and the greatest ``most_of`` below the two nodes, and
    ``pairs(i, j)`` a row pair.  At most about ``most`` node pairs are open at a time; the rest waits.
    Yields arrays (i, j) of row numbers, each unordered pair once.
    """
    if len(head) < 2:
        return
    t = Trie(head, sketch)
    best, masks = t.greatest(prepare), _masks(t.words.shape[1])
    if possible is not None:
        low, high = -t.greatest(-least), t.greatest(most_of)
    leaf = t.left < 0
    many = t.roots[t.last[t.roots] - t.first[t.roots] > 1]
    stack = [many[lo : lo + 65536] for lo in range(0, len(many), 65536)]
    stack = [(x, x) for x in stack]
    while stack:
        a, b = stack.pop()
        if len(a) > most:
            half = len(a) // 2
            stack += [(a[:half], b[:half]), (a[half:], b[half:])]
            continue
        done = leaf[a] & leaf[b]
        if done.any():
            yield from _leaves(t, a[done], b[done], budget, prepare, pairs, most)
            a, b = a[~done], b[~done]
        if not len(a):
            continue
        same = a == b
        s = a[same]
        l, r = t.left[s], t.right[s]
        # a node with itself: each child with itself and the two children together
        own = np.concatenate([l, r])
        own = own[t.last[own] - t.first[own] > 1]
        x, y = a[~same], b[~same]
        swap = leaf[x] | (~leaf[y] & (t.depth[y] < t.depth[x]))
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        na, nb = np.concatenate([l, t.left[x], t.right[x]]), np.concatenate([r, y, y])
        if possible is not None:
            keep = possible(low[na], high[na], low[nb], high[nb])
            na, nb = na[keep], nb[keep]
        shared = np.minimum(t.depth[na], t.depth[nb])
        err = np.bitwise_count((t.words[t.show[na]] ^ t.words[t.show[nb]]) & masks[shared]).sum(1)
        keep = err <= budget(best[na], best[nb])
        na, nb = np.concatenate([own, na[keep]]), np.concatenate([own, nb[keep]])
        if len(na):
            stack.append((na, nb))


def _leaves(t: Trie, a, b, budget, prepare, pairs, most):
    """Row pairs of leaf pairs: rows of one leaf have equal sketches."""
    wide = t.last[b] - t.first[b]
    size = (t.last[a] - t.first[a]) * wide
    cum = np.cumsum(size)
    lo = 0
    while lo < len(a):
        base = cum[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(cum, base + most, side="right")))
        k = np.repeat(np.arange(lo, hi), size[lo:hi])
        off = np.arange(len(k)) - np.repeat(cum[lo:hi] - size[lo:hi] - base, size[lo:hi])
        i, j = t.first[a][k] + off // wide[k], t.first[b][k] + off % wide[k]
        keep = (a[k] != b[k]) | (i < j)
        i, j = t.order[i[keep]], t.order[j[keep]]
        err = np.bitwise_count(t.words[t.first[a][k[keep]]] ^ t.words[t.first[b][k[keep]]]).sum(1)
        keep = err <= budget(prepare[i], prepare[j])
        if pairs is not None:
            keep &= pairs(i, j)
        if keep.any():
            yield i[keep], j[keep]
        lo = hi
