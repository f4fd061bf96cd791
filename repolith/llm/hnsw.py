"""Hierarchical navigable small-world graph over unit vectors, built and searched for many rows at once."""

from __future__ import annotations

import numpy as np


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    k = min(k, sims.shape[1])
    if k < sims.shape[1]:
        part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        ids, sims = np.take_along_axis(ids, part, 1), np.take_along_axis(sims, part, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


class _Layer:
    def __init__(self, vectors: np.ndarray, links: int) -> None:
        self.x, self.most = vectors, links
        self.near = np.full((len(vectors), links), -1, np.int32)
        self.nodes: list[int] = []

    def search(self, queries: np.ndarray, entries: np.ndarray, width: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` best nodes found from ``entries`` (a row per query), best first, -1 where there are fewer.

        ``at_once`` nodes of a beam are opened together, or an eighth of a wide one, so that the time is in proportion to the width.
        """
        n, at_once = len(queries), max(at_once, width // 8)
        rows = np.arange(n)[:, None]
        entries = np.sort(entries, axis=1)
        entries[:, 1:][entries[:, 1:] == entries[:, :-1]] = -1
        seen = np.zeros((n, len(self.x) + 1), bool)  # the last column stands for -1
        seen[:, -1] = True
        seen[rows, entries] = True
        sims = np.einsum("qd,qed->qe", queries, self.x[entries])
        ids, sims = _top(entries.astype(np.int32), np.where(entries < 0, -np.inf, sims), width)
        if ids.shape[1] < width:
            pad = width - ids.shape[1]
            ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1)
            sims = np.pad(sims, ((0, 0), (0, pad)), constant_values=-np.inf)
        ids = np.where(np.isneginf(sims), -1, ids)
        done = ids < 0
        live = np.arange(n)
        while len(live):
            open_ = ~done[live]
            has = open_.any(axis=1)
            live, open_ = live[has], open_[has]
            if not len(live):
                break
            rank = np.cumsum(open_, axis=1)
            take = open_ & (rank <= at_once)
            opened = np.full((len(live), at_once), -1, np.int32)
            r, c = np.nonzero(take)
            opened[r, rank[r, c] - 1] = ids[live[r], c]
            done[live] |= take
            found = np.where(opened[:, :, None] >= 0, self.near[opened], -1).reshape(len(live), -1)
            found = np.sort(found, axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            found[seen[live[:, None], found]] = -1
            seen[live[:, None], found] = True
            most = max(1, int((found >= 0).sum(axis=1).max()))
            found = np.sort(found, axis=1)[:, -most:]
            got = np.empty(found.shape, np.float32)
            step = max(1, (1 << 22) // (most * self.x.shape[1]))
            for low in range(0, len(live), step):
                got[low : low + step] = np.einsum("qd,qmd->qm", queries[live[low : low + step]], self.x[found[low : low + step]])
            got[found < 0] = -np.inf
            all_ids, all_sims = np.hstack([ids[live], found]), np.hstack([sims[live], got])
            all_done = np.hstack([done[live], found < 0])
            k = ids.shape[1]
            part = np.argpartition(-all_sims, k - 1, axis=1)[:, :k]
            part = np.take_along_axis(part, np.argsort(-np.take_along_axis(all_sims, part, 1), axis=1, kind="stable"), 1)
            ids[live], sims[live], done[live] = (np.take_along_axis(x, part, 1) for x in (all_ids, all_sims, all_done))
        return ids, sims

    def _choose(self, of: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Neighbours for nodes ``of``: candidates nearer to the node than to any chosen before, then the nearest of the rest."""
        candidates = np.where(candidates == of[:, None], -1, candidates)
        sims = np.einsum("qd,qmd->qm", self.x[of], self.x[candidates])
        ids, sims = _top(candidates, np.where(candidates < 0, -np.inf, sims), max(64, self.most))
        own = self.x[ids]
        between = own @ own.transpose(0, 2, 1)
        n, m = ids.shape
        chosen = np.zeros((n, m), bool)
        worst = np.full((n, m), -np.inf)  # nearest chosen so far, of each candidate
        count = np.zeros(n, int)
        for j in range(m):
            ok = (ids[:, j] >= 0) & (sims[:, j] > worst[:, j]) & (count < self.most)
            chosen[:, j] = ok
            count += ok
            worst = np.where(ok[:, None], np.maximum(worst, between[:, j]), worst)
        order = np.argsort(np.where(ids < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, : self.most]
        out = np.take_along_axis(ids, order, 1)
        return np.pad(out, ((0, 0), (0, self.most - out.shape[1])), constant_values=-1)

    def insert(self, new: np.ndarray, found: np.ndarray) -> None:
        """Links nodes ``new`` to the nodes ``found`` for them and to each other."""
        block = self.x[new] @ self.x[new].T
        np.fill_diagonal(block, -np.inf)
        peers, _ = _top(np.broadcast_to(new.astype(np.int32), block.shape), block, 32)
        peers = peers if len(new) > 1 else np.full((1, 1), -1, np.int32)
        self.near[new] = self._choose(new, np.hstack([found, peers]))
        self.nodes += new.tolist()
        back = np.repeat(new, self.most).astype(np.int64)
        to = self.near[new].ravel().astype(np.int64)
        back, to = back[to >= 0], to[to >= 0]
        order = np.lexsort((back, to))
        back, to = back[order], to[order]
        targets, first, counts = np.unique(to, return_index=True, return_counts=True)
        for start in range(0, len(targets), 512):
            own, counted = targets[start : start + 512], counts[start : start + 512]
            width = int(counted.max())
            at = np.minimum(first[start : start + 512, None] + np.arange(width), len(back) - 1)
            more = np.where(np.arange(width) < counted[:, None], back[at], -1)
            both = np.sort(np.hstack([self.near[own], more.astype(np.int32)]), axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            self.near[own] = self._choose(own, both)

    def connect(self) -> None:
        """Adds links until every node is reached from every other: choosing neighbours can leave groups of near copies that nothing outside links to, or that link to nothing outside."""
        n = len(self.x)
        if not n:
            return
        to = self.near.ravel()
        of, to = np.repeat(np.arange(n), self.near.shape[1])[to >= 0], to[to >= 0].astype(np.int64)
        more: list[tuple[int, int]] = []
        for back in (False, True):
            a, b = (to, of) if back else (of, to)
            if more:
                extra = np.array(more)
                a, b = np.concatenate([a, extra[:, int(back)]]), np.concatenate([b, extra[:, 1 - int(back)]])
            order = np.argsort(a, kind="stable")
            ends, cuts = b[order], np.searchsorted(a[order], np.arange(n + 1))
            seen = np.zeros(n, bool)
            nearest, sims = np.zeros(n, np.int64), np.full(n, -np.inf, np.float32)
            at = 0
            while True:
                new, front = [np.array([at])], np.array([at])
                seen[at] = True
                while len(front):
                    each = cuts[front + 1] - cuts[front]
                    front = np.unique(ends[np.arange(int(each.sum())) + np.repeat(cuts[front] - np.cumsum(each) + each, each)])
                    front = front[~seen[front]]
                    seen[front] = True
                    new.append(front)
                out, new = np.flatnonzero(~seen), np.concatenate(new)
                if not len(out):
                    break
                for low in range(0, len(out), 512):
                    rows = out[low : low + 512]
                    got = self.x[rows] @ self.x[new].T
                    best = got.argmax(axis=1)
                    top = got[np.arange(len(rows)), best]
                    nearer = top > sims[rows]
                    nearest[rows[nearer]], sims[rows[nearer]] = new[best[nearer]], top[nearer]
                at = int(out[np.argmax(sims[out])])
                more.append((at, int(nearest[at])) if back else (int(nearest[at]), at))
        if more:
            extra = np.array(sorted(more))
            _, first, each = np.unique(extra[:, 0], return_index=True, return_counts=True)
            added = np.full((n, int(each.max())), -1, np.int32)
            added[extra[:, 0], np.arange(len(extra)) - np.repeat(first, each)] = extra[:, 1]
            self.near = np.hstack([self.near, added])


class HNSW:
    def __init__(self, vectors: np.ndarray, links: int = 16, width: int = 64, batch: int = 256, seed: int = 11) -> None:
        n = len(vectors)
        x = np.ascontiguousarray(vectors, np.float32)
        heights = np.floor(-np.log(np.random.default_rng(seed).random(n) + 1e-12) / np.log(links)).astype(int)
        self.layers = [_Layer(x, links if level else 2 * links) for level in range(int(heights.max(initial=0)) + 1)]
        at, size = 0, 1
        while at < n:
            new = np.arange(at, min(n, at + size))
            entries = None
            for level in range(len(self.layers) - 1, -1, -1):
                layer = self.layers[level]
                own = heights[new] >= level
                if not layer.nodes:
                    if own.any():
                        layer.insert(new[own], np.full((int(own.sum()), 1), -1, np.int32))
                    continue
                start = np.full((len(new), 1), layer.nodes[0]) if entries is None else entries
                found, _ = layer.search(x[new], start, width)
                entries = found[:, :4]
                entries = np.where(entries < 0, entries[:, :1], entries)
                if own.any():
                    layer.insert(new[own], found[own])
            at, size = at + len(new), min(batch, max(1, at + len(new)))
        self.layers[0].connect()

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        queries = np.ascontiguousarray(queries, np.float32)
        entries = np.full((len(queries), 1), self.layers[-1].nodes[0])
        for layer in self.layers[:0:-1]:
            found, _ = layer.search(queries, entries, 8)
            entries = np.where(found[:, :4] < 0, found[:, :1], found[:, :4])
        return self.layers[0].search(queries, entries, width)
