"""Walks over neighbour graphs with beams, for many queries at once (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

#: Nodes of each beam that are opened in one step: at least, and as a share of its width, so that wide beams take no more steps.
OPENED, OPENED_SHARE = 4, 16


def squares(x: np.ndarray, nodes: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own row of nodes, by differences: exact enough to tell near neighbours apart; infinite for node -1."""
    d = x[nodes] - queries[:, None, :]
    out = np.einsum("nkd,nkd->nk", d, d)
    out[nodes < 0] = np.inf
    return out


def walk(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, seeds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes and squared distances of the beams, nearest first (-1 where a beam is not full), and how many nodes each query has met.

    `seeds` has the nodes that each beam starts from (-1: none).
    """
    n = len(queries)
    met = np.zeros((n, len(x) + 1), bool)  # the last column is for no node
    rows = np.arange(n)[:, None]
    seeds = _once(seeds)
    ids = np.full((n, max(width, seeds.shape[1])), -1, np.int32)
    ids[:, : seeds.shape[1]] = seeds
    far = squares(x, ids, queries)
    met[rows, ids] = True
    met[:, -1] = False
    order = np.argsort(far, axis=1, kind="stable")[:, :width]
    ids, far = ids[rows, order], far[rows, order]
    done, most = ids < 0, max(OPENED, width // OPENED_SHARE)
    while True:
        order = np.argsort(done, axis=1, kind="stable")[:, :most]  # beams are sorted: the first that are not done are the nearest
        live = ~done[rows, order]
        going = np.flatnonzero(live.any(1))
        if not len(going):
            return ids, far, met.sum(1)
        order, live, at = order[going], live[going], going[:, None]
        opened = np.where(live, ids[at, order], -1)
        done[at, order] = True
        new = np.where((opened >= 0)[:, :, None], edges[opened], -1).reshape(len(going), -1)
        new[met[at, new]] = -1
        new = _once(new)
        if not new.shape[1]:
            continue
        met[at, new] = True
        met[:, -1] = False
        all_ids = np.concatenate([ids[going], new], 1)
        all_far = np.concatenate([far[going], squares(x, new, queries[going])], 1)
        all_done = np.concatenate([done[going], new < 0], 1)
        best = np.argsort(all_far, axis=1, kind="stable")[:, :width]
        here = np.arange(len(going))[:, None]
        ids[going], far[going], done[going] = all_ids[here, best], all_far[here, best], all_done[here, best]


def exact(x: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """The nearest `k` nodes of each query, nearest first, of all nodes. Products propose some more, and differences decide."""
    d = (x * x).sum(1) - 2 * queries @ x.T
    n = min(len(x), 4 * k)
    some = np.argpartition(d, n - 1, axis=1)[:, :n] if n < len(x) else np.tile(np.arange(len(x)), (len(queries), 1))
    order = np.argsort(squares(x, some, queries), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(some, order, 1)


def _once(nodes: np.ndarray) -> np.ndarray:
    """Each row without repeats, as narrow as that allows."""
    nodes = np.sort(nodes, axis=1)
    nodes[:, 1:][nodes[:, 1:] == nodes[:, :-1]] = -1
    return nodes[:, nodes.max(0) >= 0] if len(nodes) else nodes


def spread_out(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, most: int) -> np.ndarray:
    """At most `most` neighbours of each point from its candidates (-1: none): first those that are nearer to the point than to any
    neighbour taken before, so that they lie in different directions, then the nearest of the others."""
    c = np.where(candidates == points[:, None], -1, candidates)
    c = _once(c)
    if not c.shape[1]:
        return np.full((len(points), most), -1, np.int32)
    near = squares(x, c, x[points])
    order = np.argsort(near, axis=1, kind="stable")
    c, near = np.take_along_axis(c, order, 1), np.take_along_axis(near, order, 1)
    v = x[c]
    place = np.full(c.shape, np.iinfo(np.int32).max, np.int32)  # in which order candidates are taken
    alive, count = c >= 0, np.zeros(len(c), np.int32)
    for j in range(c.shape[1]):
        take = np.flatnonzero(alive[:, j] & (count < most))
        if len(take):
            place[take, j] = count[take]
            count[take] += 1
            d = v[take, j + 1 :] - v[take, j][:, None, :]
            alive[take, j + 1 :] &= np.einsum("nkd,nkd->nk", d, d) > near[take, j + 1 :]
    left = (c >= 0) & (place == np.iinfo(np.int32).max)
    place = np.where(left, np.iinfo(np.int32).max - c.shape[1] + np.arange(c.shape[1]), place)
    place[c < 0] = np.iinfo(np.int32).max
    order = np.argsort(place, axis=1, kind="stable")[:, :most]
    out = np.full((len(c), most), -1, np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(c, order, 1)
    return out


def link_back(x: np.ndarray, edges: np.ndarray, points: np.ndarray) -> None:
    """Add to `edges` the other directions of the edges of `points`; where there are too many, choose anew."""
    ends = edges[points]
    source, target = np.repeat(points, ends.shape[1])[ends.ravel() >= 0], ends.ravel()[ends.ravel() >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    if not len(nodes):
        return
    more = np.full((len(nodes), int(count.max())), -1, np.int32)
    more[np.repeat(np.arange(len(nodes)), count), np.arange(len(target)) - np.repeat(first, count)] = source
    both = np.concatenate([edges[nodes], more], 1)
    fits = (both >= 0).sum(1) <= edges.shape[1]
    packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, : edges.shape[1]]
    edges[nodes[fits]] = packed[fits]
    full = np.flatnonzero(~fits)
    for k in range(0, len(full), 256):
        some = full[k : k + 256]
        edges[nodes[some]] = spread_out(x, nodes[some], both[some], edges.shape[1])


def reached(edges: np.ndarray, start: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Which nodes can be reached from `start`, besides those `known`."""
    seen = np.zeros(len(edges) + 1, bool) if known is None else np.append(known, False)
    seen[start] = True
    seen[-1] = False
    front = np.unique(start)
    while len(front):
        front = np.unique(edges[front])
        front = front[(front >= 0) & ~seen[front]]
        seen[front] = True
    return seen[:-1]


def mend(x: np.ndarray, edges: np.ndarray, members: np.ndarray, start: np.ndarray) -> np.ndarray:
    """`edges` with what it takes that all `members` can be reached from `start`: each part that cannot gets an edge from the nearest
    member that can. Edges that are needed are added, in columns of their own, so none is lost for them."""
    seen = reached(edges, start)
    while True:
        lost = members[~seen[members]]
        if not len(lost):
            return edges
        there = members[seen[members]]
        to = lost[0]
        d = ((x[there] - x[to]) ** 2).sum(1)
        source = there[int(d.argmin())]
        free = np.flatnonzero(edges[source] < 0)
        if not len(free):
            edges = np.concatenate([edges, np.full((len(edges), 1), -1, np.int32)], 1)
            free = [edges.shape[1] - 1]
        edges[source, free[0]] = to
        seen = reached(edges, np.array([to]), seen)
