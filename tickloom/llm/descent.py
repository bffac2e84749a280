"""A block of vectors in one task: its neighbour graph by NN-descent, and greedy beam searches of many queries at once.

Vectors are rows of a matrix in 32 bits, none longer than 1; nodes are named by their rows. Nearness of nodes is minus the
squared distance once a further coordinate, made here in double precision, has brought all of them to length 1; nearness to
a query is the inner product. Memory is that of the block, a bounded number of meetings and a bounded number of beams.
"""

from __future__ import annotations

import numpy as np

from tickloom.llm.components import forest

#: Neighbours of a node in the graph, all gathered in a round, and how many of those that it is a neighbour of.
DEGREE, GATHERED = 24, 12
#: A round that changes fewer neighbours than this share of all is the last.
STILL = 0.01
#: Nodes whose neighbours meet before lists are brought up to date, and queries that are searched for side by side.
MEETINGS, BESIDE = 2048, 64


def _lifted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(left, right), whose products are the nearness of nodes; a last row, which -1 names, is near to none.

    The further coordinate sqrt(1 - n) is told by how far it is from 1, so vectors of any length keep their precision.
    """
    x = x.astype(np.float64)
    n = (x * x).sum(1)
    d = n / (1 + np.sqrt(np.maximum(1 - n, 0)))
    side, w, one = 2**0.5 * np.column_stack([x, d]), n + d * d, np.ones(len(x))
    far = np.zeros((1, x.shape[1] + 3))
    far[0, -1] = -1e30
    return np.vstack([np.column_stack([side, w, one]), far * 0]), np.vstack([np.column_stack([side, -one, -w]), far])


def _once(key: np.ndarray) -> np.ndarray:
    """Where each key stands once, in the keys' order."""
    order = np.argsort(key)
    key = key[order]
    return order[np.append(True, key[1:] != key[:-1])[: len(key)]]


def _ranks(group: np.ndarray) -> np.ndarray:
    """Of sorted groups each entry's place in its own."""
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))[: len(group)]
    return np.arange(len(group)) - np.repeat(head, np.diff(np.append(head, len(group))))


def _take(ids: np.ndarray, score: np.ndarray, fresh: np.ndarray, to: np.ndarray, near: np.ndarray, s: np.ndarray) -> int:
    """Bring the lists of `to` up to date with what was found; how many entries changed."""
    k = ids.shape[1]
    once = _once(to << 32 | near)
    to, near, s = to[once], near[once], s[once]
    new = ~(ids[to] == near[:, None]).any(1)
    to, near, s = to[new], near[new], s[new]
    order = np.argsort(to.astype(np.uint64) << np.uint64(32) | np.maximum(-s, 0).view(np.uint32))
    to, near, s = to[order], near[order], s[order]
    place = _ranks(to)
    keep = place < k
    to, near, s, place = to[keep], near[keep], s[keep], place[keep]
    first = np.append(True, to[1:] != to[:-1])[: len(to)]
    who, back = to[first], np.cumsum(first) - 1
    i = np.full((len(who), 2 * k), -1, np.int32)
    v = np.full((len(who), 2 * k), -np.inf, np.float32)
    f = np.zeros((len(who), 2 * k), bool)
    i[:, :k], v[:, :k], f[:, :k] = ids[who], score[who], fresh[who]
    i[back, k + place], v[back, k + place], f[back, k + place] = near, s, True
    best = np.argsort(-v, axis=1, kind="stable")[:, :k]
    ids[who], score[who], fresh[who] = (np.take_along_axis(z, best, 1) for z in (i, v, f))
    return int((best >= k).sum())


def descend(x: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours, nearness) of all nodes, best first: DEGREE each, or all others where there are fewer."""
    size, k = len(x), min(DEGREE, max(0, len(x) - 1))
    rng = np.random.default_rng(seed)
    if not k:
        return np.zeros((size, 0), np.int32), np.zeros((size, 0), np.float32)
    order = rng.permutation(size)
    strides = 1 + rng.choice(size - 1, k, replace=False)
    ids = np.empty((size, k), np.int32)
    ids[order] = order[(np.arange(size)[:, None] + strides) % size]
    left, right = _lifted(x)
    score = np.empty((size, k), np.float32)
    for a in range(0, size, MEETINGS):
        score[a : a + MEETINGS] = np.matmul(right[ids[a : a + MEETINGS]], left[a : min(size, a + MEETINGS), :, None])[:, :, 0]
    best = np.argsort(-score, axis=1)
    ids, score, fresh = np.take_along_axis(ids, best, 1), np.take_along_axis(score, best, 1), np.ones((size, k), bool)
    while True:
        # A node's own list comes whole; of a popular node's reverse side a bounded, drawn number, fresh ones first.
        to = ids.ravel().astype(np.uint64)
        draw = rng.integers(0, 1 << 31, len(to), dtype=np.uint64) | (~fresh.ravel()).astype(np.uint64) << np.uint64(31)
        order = np.argsort(to << np.uint64(32) | draw)
        place = _ranks(to[order])
        order, place = order[place < GATHERED], place[place < GATHERED]
        both = np.full((size, k + GATHERED), -1, np.int32)
        news = np.zeros((size, k + GATHERED), bool)
        both[:, :k], news[:, :k] = ids, fresh
        at = to[order].astype(np.int64), k + place
        both[at], news[at] = order // k, fresh.ravel()[order]
        twice = both[:, k:, None] == ids[:, None, :]
        news[:, :k] |= (twice & news[:, k:, None]).any(1)
        both[:, k:][twice.any(2)] = -1
        fresh[:] = False
        changed = 0
        some = np.flatnonzero(news.any(1))
        for a in range(0, len(some), MEETINGS):
            g, f = both[some[a : a + MEETINGS]], news[some[a : a + MEETINGS]]
            s = np.matmul(left[g], right[g].transpose(0, 2, 1))
            s.reshape(len(g), -1)[:, :: s.shape[1] + 1] = -np.inf
            # What a list doesn't take is not sent to it.
            ok = s > np.append(score[:, -1], np.float32(np.inf))[g][:, :, None]
            ok &= f[:, :, None] | f[:, None, :]
            m, i, j = np.nonzero(ok)
            if len(m):
                changed += _take(ids, score, fresh, g[m, i].astype(np.int64), g[m, j].astype(np.int64), s[m, i, j].astype(np.float32))
        if changed < STILL * ids.size:
            return ids, score


def graph(x: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(neighbours of each node, forward and the best reverse ones, -1 where there are no more; one node of each island).

    Islands of the graph hang together by one node of each, which have a graph of their own, and so on.
    """
    size, left, sides, heads = len(x), np.arange(len(x)), [], np.zeros(0, np.int64)
    while True:
        ids, score = descend(x[left], seed)
        a, b = np.repeat(left, ids.shape[1]), left[ids.ravel()]
        s = score.ravel()
        to, near, s = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([s, s])
        once = _once(to << 32 | near)
        to, near, s = to[once], near[once], s[once]
        order = np.argsort(to.astype(np.uint64) << np.uint64(32) | np.maximum(-s, 0).view(np.uint32), kind="stable")
        to, near = to[order], near[order]
        place = _ranks(to)
        keep = place < 2 * DEGREE
        side = np.full((size, int(place[keep].max(initial=-1)) + 1), -1, np.int32)
        side[to[keep], place[keep]] = near[keep]
        sides.append(side)
        left = np.setdiff1d(left, forest(a, b)[0]) if len(a) else left
        if len(left) < 2:
            return np.concatenate(sides, 1), heads
        heads = heads if len(heads) else left


def search(x: np.ndarray, around: np.ndarray, entries: np.ndarray, q: np.ndarray, homes: np.ndarray, beam: int, opened: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, inner products) of the `most` best found for each query, best first, -1 where there are no more.

    homes: the query's own node, or -1. Each query keeps `beam` nodes and opens the best `opened` of those not yet opened.
    """
    around = np.where(around < 0, np.arange(len(x), dtype=np.int32)[:, None], around)  # a node leads back to itself
    out = [_beside(x, around, entries, q[a : a + BESIDE], homes[a : a + BESIDE], beam, opened, most) for a in range(0, len(q), BESIDE)]
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros((0, most), np.int32), np.zeros((0, most), np.float32))


def _beside(x, around, entries, q, homes, beam, opened, most):
    rows, size = np.arange(len(q)), len(x)
    seen = np.zeros((len(q), size), bool)
    met = seen.ravel()
    # All entry points have been met: those that don't get into the beam never would.
    seen[:, entries] = True
    s = q @ x[entries].T
    start = np.argsort(-s, axis=1, kind="stable")[:, :beam]
    ids = np.full((len(q), beam), -1, np.int32)
    score = np.full((len(q), beam), -np.inf, np.float32)
    ids[:, : start.shape[1]], score[:, : start.shape[1]] = entries[start], np.take_along_axis(s, start, 1)
    home = np.flatnonzero((homes >= 0) & ~np.isin(homes, entries))
    if len(home) and beam > 1:
        seen[home, homes[home]] = True
        ids[home, -1], score[home, -1] = homes[home], (q[home] * x[homes[home]]).sum(1)
    order = np.argsort(-score, axis=1, kind="stable")
    ids, score = np.take_along_axis(ids, order, 1), np.take_along_axis(score, order, 1)
    done = ids < 0
    end_i, end_s = np.full((len(q), most), -1, np.int32), np.full((len(q), most), -np.inf, np.float32)
    while True:
        ahead = ~done
        over = ~ahead.any(1)
        if over.any():
            end_i[rows[over], : min(most, beam)], end_s[rows[over], : min(most, beam)] = ids[over, :most], score[over, :most]
            ids, score, done, ahead, rows = (z[~over] for z in (ids, score, done, ahead, rows))
        if not len(rows):
            return end_i, end_s
        ahead &= np.cumsum(ahead, 1) <= opened
        done |= ahead
        i, j = np.nonzero(ahead)
        near = around.take(ids[i, j], 0)
        at = ((rows[i] * size)[:, None] + near).ravel()
        new = np.flatnonzero(~met.take(at))
        at, i, near = at.take(new), i.take(new // near.shape[1]), near.ravel().take(new)
        met[at] = True
        s = np.einsum("ij,ij->i", x.take(near, 0), q.take(rows.take(i), 0))
        ok = np.flatnonzero(s > score[:, -1].take(i))
        # A node that several opened ones lead to counts once.
        ok = ok.take(_once(at.take(ok)))
        i, near, s = i.take(ok), near.take(ok), s.take(ok)
        if not len(i):
            continue
        place = _ranks(i)
        wide = beam + int(place.max()) + 1
        all_i, all_s, all_d = np.full((len(rows), wide), -1, np.int32), np.full((len(rows), wide), -np.inf, np.float32), np.ones((len(rows), wide), bool)
        all_i[:, :beam], all_s[:, :beam], all_d[:, :beam] = ids, score, done
        all_i[i, beam + place], all_s[i, beam + place], all_d[i, beam + place] = near, s, False
        best = np.argsort(-all_s, axis=1)[:, :beam]
        ids, score, done = (np.take_along_axis(z, best, 1) for z in (all_i, all_s, all_d))
