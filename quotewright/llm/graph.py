"""A robust-pruned directed graph over packed bit vectors, built and searched many points at a time.

Points are inserted in batches: a greedy beam search on the graph so far proposes neighbours, relaxed distance pruning
keeps up to DEGREE diverse ones, and the edges are added backwards too, to a point that is pruned again when its spare
places are full. Pruning may leave a point that is far from all
others, or close to a better placed one, without edges towards it; so each point is also held by the first HOLDERS of its
nearest points that have one of their KEPT places free, and pruning leaves those alone. A query walks with a beam.
"""

from __future__ import annotations

import numpy as np

#: Places for points held, holders of a point, and points that a search starts from at most.
KEPT, HOLDERS, MOST_ENTRIES = 20, 6, 256
#: Edges of a point, spare places for edges backwards, beam while building, relaxation of the pruning, points inserted and queries searched at once, and
#: points of a beam that are opened in one step.
DEGREE, SPARE, BUILD_BEAM, RELAX, BATCH, OPENED = 24, 16, 48, 1.2, 512, 4
_FAR = np.int64(1) << 62


_LANES, _ADD = np.uint64(0x00FF00FF00FF00FF), np.uint64(0x0001000100010001)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances along the last axis of packed words. Eight counts of a byte each are added in one word."""
    counts = np.bitwise_count(a ^ b)
    if counts.shape[-1] % 8:
        return counts.sum(-1, dtype=np.int32)
    eight = np.ascontiguousarray(counts).view(np.uint64)
    eight = (((eight & _LANES) + ((eight >> np.uint64(8)) & _LANES)) * _ADD) >> np.uint64(48)
    total = eight[..., 0].astype(np.int32)
    for k in range(1, eight.shape[-1]):
        total += eight[..., k].astype(np.int32)
    return total


class Graph:
    """Vectors as rows of 64-bit words, edges as a table of point numbers (-1 where there is none), and the entries:
    points far and wide, since clusters far apart need not be joined by edges."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, entries: np.ndarray):
        self.x, self.edges, self.entries = x, edges, entries

    def search(self, q: np.ndarray, beam: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(points, distances) of the beam of each query, nearest first; -1 and a large number where there are fewer.
        own: the point that a query is in this graph, or -1; the walk then starts from there as well."""
        n, rows = len(q), np.arange(len(q))
        seen = np.zeros((n, len(self.x)), bool)
        start = np.broadcast_to(self.entries, (n, len(self.entries)))
        if own is not None:
            start = np.concatenate((start, own[:, None]), 1)
        seen[rows[:, None], np.where(start < 0, self.entries[0], start)] = True
        # one number holds distance, point and whether it is still closed, so that one sort orders a beam
        keys = np.full((n, max(beam, start.shape[1])), _FAR)
        first = (distances(q[:, None], self.x[start]).astype(np.int64) << 32) | (start.astype(np.int64) << 1) | 1
        keys[:, : start.shape[1]] = np.where(start >= 0, first, _FAR)
        if own is not None:  # a point that is an entry already stands there once
            keys[:, start.shape[1] - 1][np.isin(own, self.entries)] = _FAR
        keys.sort(1)
        keys = keys[:, :beam]
        active = rows
        stamp = np.full((n, len(self.x)), -1, np.int16)
        while len(active):
            k = keys[active]
            closed = ((k & 1) == 1) & (k < _FAR)
            order = np.cumsum(closed, 1)
            open_now = closed & (order <= OPENED)
            going = open_now.any(1)
            if not going.all():
                active, k, open_now = active[going], k[going], open_now[going]
                if not len(active):
                    break
            k[open_now] -= 1
            r, c = np.nonzero(open_now)
            points = (k[r, c] >> 1) & 0x7FFFFFFF
            found = self.edges[points]
            row = np.repeat(r, found.shape[1])
            point = found.ravel()
            there = point >= 0
            row, point = row[there], point[there]
            query = active[row]
            new = ~seen[query, point]
            row, point, query = row[new], point[new], query[new]
            at = (np.arange(len(row)) % 32768).astype(np.int16)
            stamp[query, point] = at
            once = stamp[query, point] == at
            row, point, query = row[once], point[once], query[once]
            seen[query, point] = True
            d = distances(np.take(q, query, axis=0), np.take(self.x, point, axis=0)).astype(np.int64)
            count = np.bincount(row, minlength=len(active))
            wide = np.full((len(active), beam + (int(count.max()) if len(count) else 0)), _FAR)
            wide[:, :beam] = k
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            wide[row, beam + place] = (d << 32) | (point.astype(np.int64) << 1) | 1
            wide.sort(1)
            keys[active] = wide[:, :beam]
        ids = np.where(keys < _FAR, (keys >> 1) & 0x7FFFFFFF, -1)
        return ids, (np.where(keys < _FAR, keys >> 32, 1 << 30)).astype(np.int64)


def prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """The edges of each point: its nearest candidate is kept, candidates that the kept one is nearer to by the factor
    RELAX go, and so on. candidates: numbers, -1 for none; a point is no candidate of its own."""
    candidates = np.where(candidates == points[:, None], -1, candidates)
    order = np.sort(candidates, 1)
    order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
    d = np.where(order >= 0, distances(x[points][:, None], x[order]), np.int32(1 << 30)).astype(np.int64)
    rank = np.argsort(d, 1, kind="stable")
    order, d = np.take_along_axis(order, rank, 1), np.take_along_axis(d, rank, 1)
    order, d = order[:, : 3 * DEGREE], d[:, : 3 * DEGREE].astype(float)
    out = np.full((len(points), DEGREE), -1, np.int32)
    rows = np.arange(len(points))
    alive = order >= 0
    vectors = x[order]
    for i in range(min(DEGREE, order.shape[1])):
        best = alive.argmax(1)
        has = alive[rows, best]
        if not has.any():
            break
        out[has, i] = order[rows, best][has]
        alive[rows, best] = False
        between = distances(vectors, vectors[rows, best][:, None])
        alive &= ~((between * RELAX <= d) & has[:, None])
    return out


def build(x: np.ndarray, seed: int = 1) -> Graph:
    """The graph over the rows of x; deterministic."""
    n = len(x)
    rng = np.random.default_rng(seed)
    entries = np.sort(rng.permutation(n)[: max(16, min(MOST_ENTRIES, n // 32))])
    edges = np.full((n, DEGREE + SPARE + KEPT), -1, np.int32)
    used = np.zeros(n, np.int64)  # places taken by edges
    free = np.full(n, DEGREE + SPARE)  # the next free place of each holder
    if n > 1:
        edges[:, : DEGREE // 4] = rng.integers(0, n, (n, DEGREE // 4))
        edges[edges == np.arange(n)[:, None]] = -1
        used[:] = DEGREE // 4
    graph = Graph(x, edges, entries)
    order = rng.permutation(n)
    for start in range(0, n, BATCH):
        points = order[start : start + BATCH]
        ids, _ = graph.search(x[points], BUILD_BEAM)
        kept = prune(x, points, np.concatenate((ids, edges[points, : DEGREE + SPARE]), 1))
        edges[points, : DEGREE + SPARE] = -1
        edges[points, :DEGREE] = kept
        used[points] = (kept >= 0).sum(1)
        for p, near in zip(points.tolist(), ids.tolist()):
            held = 0
            for q in near:
                if q >= 0 and q != p and free[q] < edges.shape[1]:
                    edges[q, free[q]] = p
                    free[q] += 1
                    held += 1
                    if held == HOLDERS:
                        break
        source, target = np.repeat(points, DEGREE), kept.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads, first, count = np.unique(target, return_index=True, return_counts=True)
        # an edge backwards takes a spare place; only a point without spare places is pruned again
        spare = used[heads] + count <= DEGREE + SPARE
        r = np.repeat(np.arange(len(heads)), count)
        place = np.arange(len(r)) - np.repeat(first, count)
        easy = spare[r]
        edges[target[easy], used[target[easy]] + place[easy]] = source[easy]
        used[heads[spare]] += count[spare]
        full = np.flatnonzero(~spare)
        for low in range(0, len(full), BATCH):
            part = full[low : low + BATCH]
            h, f, c = heads[part], first[part], count[part]
            back = np.full((len(h), int(c.max())), -1, np.int64)
            r = np.repeat(np.arange(len(h)), c)
            place = np.arange(len(r)) - np.repeat(np.cumsum(c) - c, c)
            back[r, place] = source[np.repeat(f, c) + place]
            again = prune(x, h, np.concatenate((edges[h, : DEGREE + SPARE], back), 1))
            edges[h, : DEGREE + SPARE] = -1
            edges[h, :DEGREE] = again
            used[h] = (again >= 0).sum(1)
    return graph
