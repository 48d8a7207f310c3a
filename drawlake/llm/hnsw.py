"""A hierarchical navigable small-world graph over unit vectors; many searches advance at once as array operations."""

from __future__ import annotations

import io
import math

import numpy as np

#: Neighbours of a node in upper layers (twice that in the lowest), beam while building, nodes added at once, nodes expanded per step.
M, BUILD_BEAM, BATCH, EXPAND = 12, 40, 512, 4
#: Queries that advance together, and the widest beam before a query is held against every vector of the shard.
TOGETHER, WIDEST = 512, 640
#: Float32 similarities this much under the threshold are still computed again in double precision.
SLACK = 1e-4


def _beam(vec: np.ndarray, nb: np.ndarray, q: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-first search of each query from its entries (distinct in a row): similarities and nodes of the final beam; -2 and -1 where it is not full."""
    n, rows = len(vec), np.arange(len(q))
    nb = np.vstack([nb[:n], np.full((1, nb.shape[1]), -1, nb.dtype)])  # the row that -1 reads
    seen = np.zeros((len(q), n), np.uint16)
    ids = np.full((len(q), width), -1, np.int32)
    sim = np.full((len(q), width), -2, np.float32)
    e = entry.shape[1]
    ids[:, :e] = entry
    sim[:, :e] = np.einsum("qd,qed->qe", q, vec[entry])
    seen[rows[:, None], entry] = 1
    done = ids < 0
    live = rows
    while len(live):
        open_sim = np.where(done[live], np.float32(-2), sim[live])
        k = min(EXPAND, width)
        top = np.argpartition(-open_sim, k - 1, axis=1)[:, :k] if k < width else np.tile(np.arange(width), (len(live), 1))
        good = np.take_along_axis(open_sim, top, 1) > -2
        stay = good.any(1)
        live, top, good = live[stay], top[stay], good[stay]
        if not len(live):
            break
        at = np.where(good, ids[live[:, None], top], -1)
        done[live[:, None], top] = True
        near = nb[at].reshape(len(live), -1)
        r, c = np.nonzero(near >= 0)
        x = near[r, c]
        fresh = seen[live[r], x] == 0
        r, c, x = r[fresh], c[fresh], x[fresh]
        seen[live[r], x] = c + 1  # of the same node from two neighbours, one stays
        fresh = seen[live[r], x] == c + 1
        r, c, x = r[fresh], c[fresh], x[fresh]
        new_sim = np.full(near.shape, -2, np.float32)
        new_sim[r, c] = np.einsum("ij,ij->i", vec[x], q[live[r]])
        new_id = np.where(new_sim > -2, near, -1)
        all_sim, all_id = np.hstack([sim[live], new_sim]), np.hstack([ids[live], new_id])
        all_done = np.hstack([done[live], new_id < 0])
        best = np.argpartition(-all_sim, width - 1, axis=1)[:, :width]
        sim[live], ids[live], done[live] = (np.take_along_axis(a, best, 1) for a in (all_sim, all_id, all_done))
    return sim, ids


def _diverse(vec: np.ndarray, cand: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's candidates (-1: none): one that is closer to a chosen one than to the node is taken last."""
    order = np.argsort(-np.where(cand >= 0, sim, -9), axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    v = vec[np.maximum(cand, 0)]
    between = np.einsum("nad,nbd->nab", v, v)
    chosen = np.zeros(cand.shape, bool)
    for j in range(cand.shape[1]):
        blocked = (chosen & (between[:, j] > sim[:, j, None])).any(1)
        chosen[:, j] = (cand[:, j] >= 0) & ~blocked & (chosen.sum(1) < most)
    rank = np.where(chosen, 0, np.where(cand >= 0, 1, 2))
    take = np.argsort(rank, axis=1, kind="stable")[:, :most]
    return np.take_along_axis(cand, take, 1)


class Hnsw:
    """``vec``: unit vectors (float32) in random order; ``members[l]``: those of layer l; ``nb[l]``: their neighbours as places in the layer."""

    def __init__(self, vec: np.ndarray, members: list[np.ndarray], nb: list[np.ndarray]):
        self.vec, self.members, self.nb = vec, members, nb
        self.layer_vec = [vec if k == 0 else vec[m] for k, m in enumerate(members)]

    @classmethod
    def build(cls, vec: np.ndarray, seed: int = 0) -> Hnsw:
        n = len(vec)
        top = max(0, int(math.log(max(n, 1) / 32, M))) if n > 32 else 0
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / math.log(M)).astype(int), top)
        level[:1] = top
        members = [np.flatnonzero(level >= k) for k in range(top + 1)]
        nb = [np.full((len(m), M * 2 if k == 0 else M), -1, np.int32) for k, m in enumerate(members)]
        self = cls(vec, members, nb)
        done = 0
        while done < n:
            step = min(max(64, done), BATCH)
            for k in range(top + 1):  # layers above do not hold these nodes yet
                a, b = np.searchsorted(members[k], (done, done + step))
                if b > a:
                    self._add(k, int(a), int(b), done)
            done += step
        return self

    def _entries(self, q: np.ndarray, layer: int, before: int | None = None) -> np.ndarray:
        """Places in ``layer`` from which to search it: the way down from the top; only nodes added ``before`` count."""
        held = [len(m) if before is None else int(np.searchsorted(m, before)) for m in self.members]
        top = len(self.members) - 1
        if layer == top:
            return np.zeros((len(q), 1), np.int32)
        at = (q @ self.layer_vec[top][: held[top]].T).argmax(1)[:, None]
        for k in range(top - 1, layer - 1, -1):
            at = np.searchsorted(self.members[k], self.members[k + 1][at])
            if k > layer:
                sim, ids = _beam(self.layer_vec[k][: held[k]], self.nb[k], q, at, 8)
                at = np.take_along_axis(ids, sim.argmax(1)[:, None], 1)
        return at

    def _add(self, layer: int, a: int, b: int, before: int) -> None:
        v, nb = self.layer_vec[layer], self.nb[layer]
        q = v[a:b]
        own = q @ q.T
        np.fill_diagonal(own, -9)
        c = min(b - a, BUILD_BEAM // 2)
        mates = np.argpartition(-own, c - 1, axis=1)[:, :c]
        cand, sim = (mates + a).astype(np.int32), np.take_along_axis(own, mates, 1)
        cand[sim < -8] = -1
        if a:
            old_sim, old = _beam(v[:a], nb, q, self._entries(q, layer, before), BUILD_BEAM)
            cand, sim = np.hstack([old, cand]), np.hstack([old_sim, sim])
        pick = _diverse(v, cand, sim, M)
        nb[a:b, : pick.shape[1]] = pick
        # The same links from the other end; lists that would be too long are chosen anew.
        src, dst = np.repeat(np.arange(a, b, dtype=np.int32), pick.shape[1]), pick.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        s = np.einsum("ij,ij->i", v[src], v[dst])
        order = np.lexsort((-s, dst))
        src, dst = src[order], dst[order]
        node, first, count = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(first, count)
        extra = np.full((len(node), nb.shape[1]), -1, np.int32)
        fits = place < nb.shape[1]
        extra[np.repeat(np.arange(len(node)), count)[fits], place[fits]] = src[fits]
        extra[(extra[:, :, None] == nb[node][:, None, :]).any(2)] = -1
        both = np.hstack([nb[node], extra])
        full = (both >= 0).sum(1)
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        short = full <= nb.shape[1]
        nb[node[short]] = packed[short, : nb.shape[1]]
        long = np.flatnonzero(~short)
        for i in range(0, len(long), 1024):
            part = long[i : i + 1024]
            c = packed[part, : full[part].max()]
            near = np.einsum("nd,ncd->nc", v[node[part]], v[np.maximum(c, 0)])
            nb[node[part]] = _diverse(v, c, near, nb.shape[1])

    def within(self, q: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) found with a similarity of about ``least`` or more.

        A beam of which links fill half may hide more of them: it is widened until they do not, and beyond WIDEST the
        query is held against every vector.
        """
        pairs = [self._within(q[i : i + TOGETHER], least - SLACK, width, i) for i in range(0, len(q), TOGETHER)]
        return tuple(np.concatenate(x) if x else np.zeros(0, int) for x in (([p[0] for p in pairs]), ([p[1] for p in pairs])))

    def _within(self, q, least, width, offset):
        left, out_q, out_x = np.arange(len(q)), [], []
        while len(left):
            if width > WIDEST or width >= len(self.vec):
                r, c = np.nonzero(q[left] @ self.vec.T >= least)
                out_q.append(left[r])
                out_x.append(c)
                break
            sim, ids = _beam(self.vec, self.nb[0], q[left], self._entries(q[left], 0), width)
            full = (sim >= least).sum(1) * 2 >= width
            r, c = np.nonzero((sim >= least) & ~full[:, None])
            out_q.append(left[r])
            out_x.append(ids[r, c])
            left, width = left[full], width * 4
        return (np.concatenate(out_q) + offset if out_q else np.zeros(0, int)), (np.concatenate(out_x) if out_x else np.zeros(0, int))

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, n=len(self.members), **{f"m{k}": m for k, m in enumerate(self.members)}, **{f"b{k}": b for k, b in enumerate(self.nb)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes, vec: np.ndarray) -> Hnsw:
        z = np.load(io.BytesIO(data))
        k = int(z["n"])
        return cls(vec, [z[f"m{i}"] for i in range(k)], [z[f"b{i}"] for i in range(k)])
