"""A directed proximity graph of one shard: greedy search, robust pruning, beam search.

(Subramanya et al., DiskANN, NeurIPS 2019.)  Searches of many queries run side by
side in NumPy.  Points are unit vectors, so Euclidean order is cosine order.
"""

from __future__ import annotations

import numpy as np

DEGREE, BUILD_BEAM, QUERY_BEAM, RELAX, BLOCK = 24, 48, 64, 1.2, 128


class Graph:
    """Over distinct unit vectors ``x``; ``edges`` has a row of at most ``degree`` neighbours per point, padded with -1."""

    def __init__(self, x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, relax: float = RELAX, seed: int = 1):
        self.x, self.degree, self.relax = np.ascontiguousarray(x, dtype=np.float32), degree, relax
        n = len(x)
        rng = np.random.default_rng(seed)
        self.edges = rng.integers(0, n, size=(n, degree)).astype(np.int64)
        self.edges[:, degree // 2 :] = -1
        self.edges[self.edges == np.arange(n)[:, None]] = -1
        self.start = int(np.argmax(self.x @ self.x.mean(axis=0)))
        for slack in (1.0, relax):
            for a in range(0, n, BLOCK):
                self._insert(rng.permutation(n)[:0] if n < 2 else np.arange(a, min(n, a + BLOCK)), beam, slack)

    def _insert(self, points: np.ndarray, beam: int, slack: float) -> None:
        """Search for each point, keep pruned edges to what the search visited, and add the edges back."""
        if not len(points):
            return
        _, _, visited = self.search(self.x[points], beam)
        own = np.hstack([visited, self.edges[points]])
        self.edges[points] = self._prune(points, own, slack)
        to = self.edges[points]
        source, target = np.repeat(points, self.degree)[to.ravel() >= 0], to.ravel()[to.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        wide = np.full((len(nodes), self.degree + int(count.max(initial=0))), -1, dtype=np.int64)
        wide[:, : self.degree] = self.edges[nodes]
        wide[np.repeat(np.arange(len(nodes)), count), self.degree + np.arange(len(target)) - np.repeat(first, count)] = source
        have = (wide >= 0).sum(axis=1)
        room = have <= self.degree
        packed = np.sort(wide, axis=1)[:, ::-1]  # ids first, padding last
        self.edges[nodes[room]] = packed[room][:, : self.degree]
        full = np.flatnonzero(~room)
        for a in range(0, len(full), BLOCK):
            part = full[a : a + BLOCK]
            self.edges[nodes[part]] = self._prune(nodes[part], packed[part], slack)

    def _prune(self, points: np.ndarray, candidates: np.ndarray, slack: float) -> np.ndarray:
        """Relaxed distance pruning: the nearest candidate stays and drops all that it is nearer to, by the slack, than the point is."""
        c = np.sort(candidates, axis=1)
        c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
        c[c == points[:, None]] = -1
        v = self.x[c]
        far = np.maximum(2 - 2 * np.einsum("bcd,bd->bc", v, self.x[points]), 0)
        far[c < 0] = np.inf
        order = np.argsort(far, axis=1, kind="stable")
        row = np.arange(len(c))[:, None]
        c, far, v = c[row, order], far[row, order], v[row, order]
        between = np.maximum(2 - 2 * np.matmul(v, v.transpose(0, 2, 1)), 0) * slack**2
        alive = np.isfinite(far)
        out = np.full((len(points), self.degree), -1, dtype=np.int64)
        rows = np.arange(len(points))
        for k in range(self.degree):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = alive.argmax(axis=1)
            out[some, k] = c[rows, pick][some]
            alive &= ~((between[rows, pick] <= far) & some[:, None])
            alive[rows, pick] = False
        return out

    def search(self, queries: np.ndarray, beam: int = QUERY_BEAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Beam search for each query: found ids and distances, nearest first (padded with -1 and inf), and the ids visited."""
        q, n = len(queries), len(self.x)
        beam = min(beam, n)
        rows = np.arange(q)
        seen = np.zeros((q, n), dtype=bool)
        ids = np.full((q, beam), -1, dtype=np.int64)
        far = np.full((q, beam), np.inf, dtype=np.float32)
        done = np.ones((q, beam), dtype=bool)
        ids[:, 0], seen[:, self.start], done[:, 0] = self.start, True, False
        far[:, 0] = 2 - 2 * (queries @ self.x[self.start])
        visited = []
        while True:
            open_ = ~done
            active = np.flatnonzero(open_.any(axis=1))
            if not len(active):
                break
            pick = open_[active].argmax(axis=1)
            now = ids[active, pick]
            done[active, pick] = True
            step = np.full(q, -1, dtype=np.int64)
            step[active] = now
            visited.append(step)
            near = self.edges[now]
            fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
            seen[active[:, None], np.where(near >= 0, near, now[:, None])] = True
            d = 2 - 2 * np.einsum("qrd,qd->qr", self.x[near], queries[active])
            d = np.where(fresh, d, np.inf).astype(np.float32)
            all_far = np.hstack([far[active], d])
            order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            r = np.arange(len(active))[:, None]
            far[active] = all_far[r, order]
            ids[active] = np.hstack([ids[active], np.where(fresh, near, -1)])[r, order]
            done[active] = np.hstack([done[active], ~fresh])[r, order]
        return ids, far, np.stack(visited, axis=1) if visited else np.full((q, 1), -1)
