"""Robust-pruned directed proximity graph over one shard of unit vectors.

The graph is grown in doubling batches.  A batch is searched greedily in the graph built so
far, the nodes a search visited are the proposed neighbours, and relaxed-distance pruning
keeps a diverse subset of them: a candidate is dropped once a kept neighbour is closer to it
than ``1 / alpha`` times its distance to the node.  All steps work on whole batches of rows,
so a shard costs a few NumPy calls per hop and not one Python step per vector.
"""

from __future__ import annotations

import numpy as np

LOW = np.float32(-4.0)


def prune(x, nodes, cand, sims, degree, alpha):
    """Pick at most ``degree`` diverse neighbours for every node.

    ``cand`` (B, C) holds candidate ids, -1 for none, and ``sims`` their cosines.
    Returns (B, degree) ids, -1 where fewer were kept.
    """
    order = np.argsort(-sims, axis=1, kind="stable")
    cand = np.take_along_axis(cand, order, 1)
    sims = np.take_along_axis(sims, order, 1)
    b, c = cand.shape
    alive = (cand >= 0) & (cand != nodes[:, None])
    rows = x[cand]
    gram = np.matmul(rows, rows.transpose(0, 2, 1))
    gap = (1.0 - sims).astype(np.float32)
    near = (1.0 - gram) * np.float32(alpha) <= gap[:, None, :]
    out = np.full((b, degree), -1, np.int32)
    kept = np.zeros(b, np.int32)
    for j in range(c):
        pick = np.nonzero(alive[:, j] & (kept < degree))[0]
        if not len(pick):
            continue
        out[pick, kept[pick]] = cand[pick, j]
        kept[pick] += 1
        alive[pick, j + 1 :] &= ~near[pick, j, j + 1 :]
    return out


def search(x, links, queries, entry, beam, mark, width=3, limit=40):
    """Beam search of a batch; returns ids and cosines of the beam, best first.

    ``entry`` (B, E) are the starting nodes (-1 for none), ``mark`` a scratch array (>= B, n) that says
    which nodes a query has met.  Every hop expands the ``width`` best open nodes.
    """
    b, e = entry.shape
    d, n = x.shape[1], mark.shape[1]
    mark[:b] = 0
    flat = mark.reshape(-1)
    ids = np.full((b, beam), -1, np.int32)
    sims = np.full((b, beam), LOW, np.float32)
    done = np.ones((b, beam), bool)
    row = np.arange(b)
    e = min(e, beam)
    entry = entry[:, :e]
    ids[:, :e] = entry
    sims[:, :e] = np.matmul(x[entry.ravel()].reshape(b, e, d), queries[:, :, None])[:, :, 0]
    sims[:, :e][entry < 0] = LOW
    done[:, :e] = entry < 0
    for c in range(e):
        there = np.nonzero(entry[:, c] >= 0)[0]
        mark[there, entry[there, c]] = 1
    act = row
    for _ in range(limit):
        open_sims = np.where(done[act], LOW, sims[act])
        top = np.argpartition(-open_sims, width - 1, axis=1)[:, :width] if width < beam else np.argsort(-open_sims, 1)
        val = np.take_along_axis(open_sims, top, 1)
        going = val[:, 0:].max(1) > LOW
        if not going.all():
            act, top, val = act[going], top[going], val[going]
        if not len(act):
            break
        r = act[:, None]
        done[r, top] |= val > LOW
        # neighbours as one flat list; only those not met yet are looked at again
        ei, ej = np.nonzero(val > LOW)
        nb = links[ids[act[ei], top[ei, ej]]]
        key = (act[ei] * n)[:, None] + nb
        new = np.flatnonzero((flat.take(key, mode="clip") == 0) & (nb >= 0))
        key = key.ravel()[new]
        # one of equal ids met in the same hop stays
        line, place = np.divmod(new, nb.shape[1])
        slot = (ej[line] * nb.shape[1] + place + 1).astype(mark.dtype)
        flat[key] = slot
        one = flat[key] == slot
        # pack what is new to the left, so that only few columns are compared
        fi = ei[line[one]]
        count = np.bincount(fi, minlength=len(act))
        most = int(count.max()) if len(count) else 0
        if not most:
            continue
        fresh = np.full((len(act), most), -1, np.int32)
        fresh[fi, np.arange(len(fi)) - (np.cumsum(count) - count)[fi]] = nb.ravel()[new[one]]
        fs = np.matmul(x[fresh.ravel()].reshape(len(act), most, d), queries[act][:, :, None])[:, :, 0]
        fs[fresh < 0] = LOW
        all_s = np.concatenate([sims[act], fs], 1)
        keep = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        all_i = np.concatenate([ids[act], fresh], 1)
        all_d = np.concatenate([done[act], fresh < 0], 1)
        ids[act] = np.take_along_axis(all_i, keep, 1)
        sims[act] = np.take_along_axis(all_s, keep, 1)
        done[act] = np.take_along_axis(all_d, keep, 1) | (ids[act] < 0)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


class Graph:
    """Graph over the rows of ``x`` (n, d), float32 unit vectors."""

    def __init__(self, x, degree=18, beam=20, alpha=1.08, seed=7, batch=512, seed_rows=None):
        n = len(x)
        self.x, self.beam, self.batch = x, beam, batch
        order = np.random.default_rng(seed).permutation(n).astype(np.int32)
        self.links = np.full((n, degree), -1, np.int32)
        first = order[: min(n, seed_rows or max(512, min(4096, n // 8)))]
        self.pivots = first
        self.mark = np.zeros((min(batch, max(n, 1)), max(n, 1)), np.int16)
        if n < 2:
            return
        s = x[first] @ x[first].T
        np.fill_diagonal(s, LOW)
        c = min(len(first) - 1, 2 * degree)
        top = np.argpartition(-s, c - 1, axis=1)[:, :c]
        self._adopt(first, first[top].astype(np.int32), np.take_along_axis(s, top, 1), degree, alpha)
        at = len(first)
        while at < n:
            size = min(at, batch, n - at)
            nodes = order[at : at + size]
            ids, sims = search(x, self.links, x[nodes], self._entries(x[nodes]), beam, self.mark)
            self._adopt(nodes, ids, sims, degree, alpha)
            at += size

    def _entries(self, q, count=2):
        count = min(count, len(self.pivots))
        s = q @ self.x[self.pivots].T
        out, row = np.empty((len(q), count), np.int64), np.arange(len(q))
        for c in range(count):
            out[:, c] = s.argmax(1)
            s[row, out[:, c]] = LOW
        return self.pivots[out]

    def _adopt(self, nodes, cand, sims, degree, alpha):
        """Give the nodes pruned neighbours and their neighbours the way back."""
        x, links = self.x, self.links
        links[nodes] = prune(x, nodes, cand, sims, degree, alpha)
        i, j = np.nonzero(links[nodes] >= 0)
        src, dst = nodes[i], links[nodes][i, j]
        s = np.einsum("ij,ij->i", x[src], x[dst])
        o = np.lexsort((-s, dst))
        src, dst, s = src[o], dst[o], s[o]
        start = np.r_[True, dst[1:] != dst[:-1]]
        group = np.cumsum(start) - 1
        rank = np.arange(len(dst)) - np.nonzero(start)[0][group]
        k = rank < degree
        heads = dst[start]
        for lo in range(0, len(heads), 4096):
            hi = min(lo + 4096, len(heads))
            m = k & (group >= lo) & (group < hi)
            part = heads[lo:hi]
            merged = np.full((hi - lo, 2 * degree), -1, np.int32)
            merged[:, :degree] = links[part]
            merged[group[m] - lo, degree + rank[m]] = src[m]
            back = merged[:, degree:]
            back[(back[:, :, None] == merged[:, None, :degree]).any(2)] = -1
            few = (merged >= 0).sum(1) <= degree
            packed = np.take_along_axis(merged, np.argsort(merged < 0, axis=1, kind="stable"), 1)
            links[part[few]] = packed[few, :degree]
            many = np.nonzero(~few)[0]
            if len(many):
                width = int((packed[many] >= 0).sum(1).max())
                c = packed[many, :width]
                cs = np.matmul(x[c.ravel()].reshape(len(many), width, -1), x[part[many]][:, :, None])[:, :, 0]
                cs[c < 0] = LOW
                links[part[many]] = prune(x, part[many], c, cs, degree, alpha)

    def query(self, q, k, beam=None, own=None):
        """Ids and cosines of about the k best rows for every row of ``q``.

        ``own``: the queries' own nodes, where the search then starts (and which it also returns).
        """
        beam = min(max(beam or self.beam, k + 1), max(len(self.x), 2))
        out_i, out_s = [], []
        for lo in range(0, len(q), self.batch):
            part = q[lo : lo + self.batch]
            entry = self._entries(part)
            if own is not None:
                mine = own[lo : lo + self.batch, None]
                entry = np.concatenate([mine, np.where(entry == mine, -1, entry)], 1)
            ids, sims = search(self.x, self.links, part, entry, beam, self.mark)
            out_i.append(ids[:, : k + 1])
            out_s.append(sims[:, : k + 1])
        return np.concatenate(out_i), np.concatenate(out_s)
