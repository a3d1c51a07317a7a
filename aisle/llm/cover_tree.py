"""Cover trees over norm-augmented vectors, for exact searches by inner product.

A vector ``x`` gets one more component ``sqrt(M^2 - |x|^2)``, where ``M`` is the
largest norm, and a query one that is 0. The squared distance between them is
then ``|q|^2 + M^2 - 2 q.x``: near means a large inner product. Each level of the
tree covers its rows by balls of half the radius of the level above, around rows
that are more than that radius apart. From the distance of a query to a centre
and the covering radius follow an upper and a lower bound of all inner products
below the node.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np


@dataclass
class CoverTree:
    """Rows in the order of the tree, so that what a node verifies itself is a range of them; node 0 is the root.

    A node has a ``centre`` (a place in the order), a covering ``radius``, ``own`` rows from ``low`` on, which no
    node below holds, and children, whose nodes are listed from ``child`` to ``child_end``.
    """

    order: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    low: np.ndarray
    own: np.ndarray
    child: np.ndarray
    child_end: np.ndarray

    @classmethod
    def build(cls, x: np.ndarray, leaf: int = 64, small: int = 4) -> CoverTree:
        """``x``: augmented rows. A node of at most ``leaf`` rows has no children, and a ball of at most
        ``small`` rows is no child: its rows stay with the node above."""
        centre, radius, own, child, child_end = [], [], [], [], []
        waiting = [(0, np.arange(len(x)))] if len(x) else []
        # Nodes are numbered level by level, so the children of a node follow each other.
        while waiting:
            below: list[tuple[int, np.ndarray]] = []
            start = len(centre) + len(waiting)
            for c, rows in waiting:
                away = np.linalg.norm(x[rows] - x[c], axis=1)
                far = float(away.max())
                balls = _net(x, c, rows, away, far / 2) if len(rows) > leaf and far > 0 else []
                large = [b for b in balls if len(b[1]) > small]
                kept = np.setdiff1d(rows, np.concatenate([b[1] for b in large])) if large else rows
                centre.append(c)
                radius.append(far)
                own.append(kept)
                child.append(start + len(below))
                below.extend(large)
                child_end.append(start + len(below))
            waiting = below
        order = np.concatenate(own) if own else np.zeros(0, np.int64)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        sizes = np.array([len(o) for o in own], np.int64)
        return cls(order, place[np.array(centre, np.int64)], np.array(radius, float), np.cumsum(sizes) - sizes, sizes,
                   np.array(child, np.int64), np.array(child_end, np.int64))


def _net(x: np.ndarray, centre: int, rows: np.ndarray, away: np.ndarray, r: float) -> list[tuple[int, np.ndarray]]:
    """Balls of radius ``r``, around the centre and then around rows that no ball covers yet."""
    near = away <= r
    balls, rest = [(centre, rows[near])], rows[~near]
    while len(rest):
        near = np.linalg.norm(x[rest] - x[rest[0]], axis=1) <= r
        near[0] = True
        balls.append((int(rest[0]), rest[near]))
        rest = rest[~near]
    return balls


def augmented(v: np.ndarray, most: float) -> np.ndarray:
    """Rows with the component that makes all norms ``most``."""
    gap = np.maximum(most * most - np.einsum("ij,ij->i", v, v), 0.0)
    return np.concatenate([v, np.sqrt(gap)[:, None]], axis=1)


def bounds(near: np.ndarray, norm: np.ndarray, radius: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the inner products in balls.

    ``near``: inner products of queries (rows) with centres (columns); ``norm``: norms of the
    queries. A ball moves the product by at most ``|q| r``; the triangle inequality of the augmented distances
    gives a second pair of bounds. They get a slack for rounding.
    """
    n, r = norm[:, None], radius[None, :]
    distance = np.sqrt(np.maximum(n * n + most * most - 2 * near, 0.0))
    up = near + np.minimum(n * r, np.where(distance > r, distance * r - r * r / 2, np.inf))
    low = near - np.minimum(n * r, distance * r + r * r / 2)
    slack = 1e-9 * (n + most) ** 2 + 1e-6
    return low - slack, up + slack


class Best:
    """The first ``k`` rows of each window: largest score, then smallest id. Scores are exact integers."""

    def __init__(self, low: np.ndarray, high: np.ndarray, percent: tuple[int, int], k: int):
        """A window holds scores s with ``percent[0] * low <= 100 * s`` and ``100 * s <= percent[1] * high``;
        without ``low`` and ``high`` (None) all scores."""
        self.k, self.percent = k, percent
        self.low, self.high = low, high
        self.window = np.zeros(0, np.int64)
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)

    def kth(self, windows: int) -> np.ndarray:
        """Score that a row must reach to be among the first k; the least integer where fewer are known."""
        out = np.full(windows, np.iinfo(np.int64).min)
        self.settle()
        count = np.bincount(self.window, minlength=windows)
        last = np.cumsum(count) - 1
        full = count >= self.k
        out[full] = self.score[last[full]]
        return out

    def add(self, window: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.window = np.concatenate([self.window, window])
        self.score = np.concatenate([self.score, score])
        self.id = np.concatenate([self.id, ids])

    def settle(self) -> None:
        at = np.lexsort((self.id, -self.score, self.window))
        window = self.window[at]
        first = np.searchsorted(window, window, "left")
        at = at[np.arange(len(at)) - first < self.k]
        self.window, self.score, self.id = self.window[at], self.score[at], self.id[at]


@dataclass
class Block:
    """One stored tree: rows in its order, all of one label."""

    label: int
    ids: np.ndarray
    v: np.ndarray
    tree: CoverTree


def search(blocks: list[Block], queries: np.ndarray, asks: list[np.ndarray], owner: np.ndarray, best: Best,
           skip: np.ndarray, most: float) -> None:
    """Best-first descent through the trees of several blocks for several queries at once.

    ``owner``: query of each window; ``asks[b]``: mask of the queries that want rows of block ``b``; ``skip``: id
    that a query does not take (itself). The node with the largest upper bound among the open ones comes
    next. A window leaves out a node that lies wholly outside it, or that cannot beat the k rows it has.
    """
    windows = len(owner)
    q = queries.astype(float)
    norm = np.sqrt(np.einsum("ij,ij->i", q, q))
    kth = best.kth(windows)
    heap: list = []

    def open_nodes(b: int, nodes: np.ndarray, alive: np.ndarray) -> None:
        """Put nodes on the heap with the windows for which they still count. ``alive``: windows of the node above."""
        block = blocks[b]
        need = np.unique(owner[alive])
        centre = block.v[block.tree.centre[nodes]].astype(float)
        low, up = bounds(q[need] @ centre.T, norm[need], block.tree.radius[nodes], most)
        at = np.searchsorted(need, owner[alive])
        low, up = low[at], up[at]
        keep = up >= kth[alive][:, None]
        if best.low is not None:
            keep &= 100.0 * up >= best.percent[0] * best.low[alive].astype(float)[:, None]
            keep &= 100.0 * low <= best.percent[1] * best.high[alive].astype(float)[:, None]
        for j, node in enumerate(nodes):
            mine = keep[:, j]
            if mine.any():
                heapq.heappush(heap, (-float(up[mine, j].max()), b, int(node), alive[mine], up[mine, j]))

    for b in range(len(blocks)):
        wanted = np.flatnonzero(asks[b][owner])
        if len(wanted) and len(blocks[b].ids):
            open_nodes(b, np.zeros(1, np.int64), wanted)
    since = 0
    while heap:
        _, b, node, alive, up = heapq.heappop(heap)
        alive = alive[up >= kth[alive]]
        if not len(alive):
            continue
        block, tree = blocks[b], blocks[b].tree
        rows = slice(tree.low[node], tree.low[node] + tree.own[node])
        need = np.unique(owner[alive])
        score = products(queries[need], block.v[rows])
        take = np.ones(score.shape, bool)
        ids = block.ids[rows]
        take &= ids[None, :] != skip[need][:, None]
        at = np.searchsorted(need, owner[alive])
        score, take = score[at], take[at] & (score[at] >= kth[alive][:, None])
        if best.low is not None:
            take &= 100 * score >= best.percent[0] * best.low[alive][:, None]
            take &= 100 * score <= best.percent[1] * best.high[alive][:, None]
        w, column = np.nonzero(take)
        if len(w):
            best.add(alive[w], score[w, column], ids[column])
            since += len(w)
            if since > 4 * windows:
                kth, since = best.kth(windows), 0
        if tree.child_end[node] > tree.child[node]:
            open_nodes(b, np.arange(tree.child[node], tree.child_end[node]), alive)
    best.settle()


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of two sets of integer rows (int64).

    Doubles do as long as no sum can pass 2**53; beyond, 64-bit integers; beyond
    those no long can hold the score and an OverflowError is raised.
    """
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    largest = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1]
    if largest < 2.0**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if largest >= 2.0**56:
        raise OverflowError("a score times 100 does not fit a long")
    return a @ b.T
