"""Ball trees over integer vectors, and the descent of two of them at once.

A node holds a center and a radius that covers all vectors below it. For nodes with
centers a, c and radii r, s the inner product of any two of their vectors lies within
``|a| s + |c| r + r s`` of ``a . c``. A pair of nodes whose interval misses what the anchors
below the first still ask for is given up with everything below both.
"""

from __future__ import annotations

import numpy as np

#: Least points of a node that is divided, and most levels of divisions.
LEAST, DEPTH = 16, 10
#: Radii and intervals are taken this much wider than computed.
SLACK = 1e-9


class Tree:
    """Nodes in an order where parents come before children; ``left`` and ``right`` are -1 for leaves.

    ``leaf`` numbers the leaves, ``members`` holds the points of each, ``direction`` and ``cut`` say on
    which side a vector goes.
    """

    def __init__(self, points: np.ndarray, rows: float, target: float):
        """Divide points, which stand for ``rows`` rows, at the median between two far points until leaves stand for ``target`` rows."""
        points = points.astype(np.float64, copy=False)
        share = rows / max(1, len(points))
        self.left, self.right, self.leaf, self.members = [], [], [], []
        centers, radii, directions, cuts = [], [], [], []
        todo = [(np.arange(len(points)), -1, 0, 0)]
        for own, parent, side, depth in todo:
            node = len(self.left)
            if parent >= 0:
                (self.left, self.right)[side][parent] = node
            held = points[own]
            center = held.mean(axis=0) if len(own) else np.zeros(points.shape[1])
            away = ((held - center) ** 2).sum(axis=1)
            centers.append(center)
            radii.append(float(np.sqrt(away.max())) * (1 + SLACK) + SLACK if len(own) else 0.0)
            direction, cut, near = np.zeros(points.shape[1]), 0.0, None
            if len(own) >= LEAST and depth < DEPTH and len(own) * share > target:
                one = held[away.argmax()]
                direction = one - held[((held - one) ** 2).sum(axis=1).argmax()]
                at = held @ direction
                cut = float(np.median(at))
                near = at <= cut
                if near.all():
                    cut = float(np.nextafter(cut, -np.inf))
                    near = at <= cut
            self.left.append(-1)
            self.right.append(-1)
            directions.append(direction)
            cuts.append(cut)
            if near is None or not near.any() or near.all():
                self.leaf.append(len(self.members))
                self.members.append(own)
            else:
                self.leaf.append(-1)
                todo += [(own[near], node, 0, depth + 1), (own[~near], node, 1, depth + 1)]
        self.left, self.right, self.leaf = (np.array(x) for x in (self.left, self.right, self.leaf))
        self.center, self.radius = np.array(centers), np.array(radii)
        self.direction, self.cut = np.array(directions), np.array(cuts)
        self.node_of_leaf = np.flatnonzero(self.leaf >= 0)

    def route(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        node = np.zeros(len(vectors), dtype=np.int64)
        while (live := np.flatnonzero(self.left[node] >= 0)).size:
            for k in np.unique(node[live]).tolist():
                own = live[node[live] == k]
                node[own] = np.where(vectors[own] @ self.direction[k] <= self.cut[k], self.left[k], self.right[k])
        return self.leaf[node]

    def cover(self, radius: np.ndarray) -> None:
        """Take radii of the leaves as given and make the others cover their children's balls."""
        self.radius = np.zeros(len(self.left))
        self.radius[self.node_of_leaf] = radius * (1 + SLACK) + SLACK
        for k in np.flatnonzero(self.left >= 0)[::-1].tolist():
            below = [self.left[k], self.right[k]]
            self.radius[k] = (np.sqrt(((self.center[below] - self.center[k]) ** 2).sum(axis=1)) + self.radius[below]).max() * (1 + SLACK)

    def gathered(self, of_leaves: np.ndarray, join) -> np.ndarray:
        """Per node what its leaves hold, put together by ``join`` (minimum, maximum, bitwise_or)."""
        out = np.zeros((len(self.left), *of_leaves.shape[1:]), dtype=of_leaves.dtype)
        out[self.node_of_leaf] = of_leaves
        for k in np.flatnonzero(self.left >= 0)[::-1].tolist():
            out[k] = join(out[self.left[k]], out[self.right[k]])
        return out


def interval(product: np.ndarray, a: np.ndarray, r: np.ndarray, c: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of inner products from centers' products, centers' norms and radii."""
    reach = a * s + c * r + r * s + SLACK * (a + r) * (c + s) + SLACK
    return product - reach, product + reach


def descend(anchors: Tree, candidates: Tree, asked) -> tuple[np.ndarray, np.ndarray]:
    """Leaf pairs (by node) that may hold what is asked.

    ``asked(anchor_nodes, candidate_nodes, low, high)`` says for pairs of nodes and their
    intervals which to go on with.
    """
    norm = [np.sqrt((t.center**2).sum(axis=1)) for t in (anchors, candidates)]
    a, c = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(a):
        product = np.einsum("ij,ij->i", anchors.center[a], candidates.center[c])
        low, high = interval(product, norm[0][a], anchors.radius[a], norm[1][c], candidates.radius[c])
        go = asked(a, c, low, high)
        a, c = a[go], c[go]
        last = (anchors.left[a] < 0) & (candidates.left[c] < 0)
        found.append((a[last], c[last]))
        a, c = a[~last], c[~last]
        # Divide the node with the larger ball, or the one that can be divided.
        first = (anchors.left[a] >= 0) & ((candidates.left[c] < 0) | (anchors.radius[a] >= candidates.radius[c]))
        a, c = (
            np.concatenate([anchors.left[a[first]], anchors.right[a[first]], a[~first], a[~first]]),
            np.concatenate([c[first], c[first], candidates.left[c[~first]], candidates.right[c[~first]]]),
        )
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def exact_kind(a: float, c: float) -> type:
    """The narrowest arithmetic that holds every partial sum of inner products of integer vectors of these norms."""
    reach = a * c * 1.01
    for kind, most in ((np.float32, 2**24), (np.float64, 2**53), (np.int64, 2**63)):
        if reach < most:
            return kind
    raise ValueError("inner products of these embeddings do not fit 64-bit integers")


def products(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of integer vectors as int64."""
    kind = exact_kind(*(float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0))) for x in (a, c)))
    return (a.astype(kind) @ c.astype(kind).T).astype(np.int64)
