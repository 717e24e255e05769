"""R-tree over count vectors, searched for pairs of points that may overlap enough.

A point holds, per group of hashed tokens, how many of a set's tokens fall into
the group.  Two sets share at most ``sum(min(a_g, b_g))`` tokens; for two nodes
the same sum over the upper corners of their boxes bounds every pair below.

Vectors have a power-of-two length of ``GROUPS`` or more, longer for larger
sets; token h lies in group ``h mod length``, so a longer vector folds into a
shorter one.  The tree is built on vectors folded to ``GROUPS``; pairs that it
lets through are bounded again at the shorter of their own lengths.
"""

from __future__ import annotations

import numpy as np

LEAF, FAN = 64, 16
GROUPS = 64


def vector_lengths(sizes: np.ndarray) -> np.ndarray:
    """Groups of sets of these sizes: about an eighth of the size, ``GROUPS`` at least."""
    return 1 << np.ceil(np.log2(np.maximum(sizes / 8, GROUPS))).astype(np.int64)


def folded(vector: np.ndarray, length: int) -> np.ndarray:
    return vector.reshape(-1, length).sum(0)


class Forest:
    """Disjoint sets of the numbers 0..n-1; the smallest number of a set is its root."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.parent))], np.int64)


def enough(overlap: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of ``sizes`` together that share ``overlap`` tokens have a Jaccard similarity of ``percent``."""
    return overlap * (100 + percent) >= percent * sizes


class CountTree:
    """Bulk-loaded tree: points sorted by size and then by their widest group are cut into leaves, leaves into nodes."""

    def __init__(self, vectors: list[np.ndarray], sizes: np.ndarray):
        n = len(sizes)
        self.vectors = vectors
        points = np.array([folded(v, GROUPS) for v in vectors], np.int32)
        order = np.argsort(sizes, kind="stable")
        slab = LEAF * max(1, int(np.ceil(np.sqrt(n / LEAF))))
        cut = []
        for lo in range(0, n, slab):
            some = order[lo: lo + slab]
            widest = int(np.ptp(points[some], axis=0).argmax())
            cut.append(some[np.argsort(points[some, widest], kind="stable")])
        self.order = np.concatenate(cut)
        self.points, self.sizes = points[self.order], sizes[self.order]
        # Levels from the leaves up: first point or child of each node, its upper corner, and its sizes' range.
        first = np.arange(0, n, LEAF)
        self.levels = [(first, np.maximum.reduceat(self.points, first), np.minimum.reduceat(self.sizes, first), np.maximum.reduceat(self.sizes, first))]
        while len(first := self.levels[-1][0]) > FAN:
            _, high, least, most = self.levels[-1]
            first = np.arange(0, len(first), FAN)
            self.levels.append((first, np.maximum.reduceat(high, first), np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)))

    def leaf_pairs(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of leaves (i <= j) whose boxes allow a pair of points."""
        top = len(self.levels[-1][0])
        i, j = np.triu_indices(top)
        for level in range(len(self.levels) - 1, -1, -1):
            _, high, least, most = self.levels[level]
            keep = np.zeros(len(i), bool)
            for lo in range(0, len(i), 4096):
                a, b = i[lo: lo + 4096], j[lo: lo + 4096]
                bound = np.minimum(np.minimum(high[a], high[b]).sum(1, dtype=np.int64), np.minimum(most[a], most[b]))
                keep[lo: lo + 4096] = enough(bound, least[a] + least[b], percent)
            i, j = i[keep], j[keep]
            if level:
                below = len(self.levels[level - 1][0])
                pairs = []
                for a, b in zip(i.tolist(), j.tolist(), strict=True):
                    x, y = np.meshgrid(np.arange(a * FAN, min(below, (a + 1) * FAN)), np.arange(b * FAN, min(below, (b + 1) * FAN)), indexing="ij")
                    pairs.append(np.column_stack((x[x <= y], y[x <= y])))
                pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
                i, j = pairs[:, 0], pairs[:, 1]
        return i, j

    def may_link(self, p: int, q: int, percent: int) -> bool:
        """The bound at the shorter length of the two vectors."""
        a, b = self.vectors[self.order[p]], self.vectors[self.order[q]]
        length = min(len(a), len(b))
        return bool(enough(np.minimum(folded(a, length), folded(b, length)).sum(), self.sizes[p] + self.sizes[q], percent))

    def connect(self, percent: int) -> np.ndarray:
        """For each point, the smallest point that it reaches over pairs that the bound allows.

        Leaves that are already connected with each other are not compared.
        """
        forest = Forest(len(self.sizes))
        n = len(self.sizes)
        one: dict[int, int] = {}  # leaves known to be connected throughout

        def whole(leaf: int) -> int:
            """Root of a leaf whose points are connected, -1 if they are not."""
            if leaf not in one:
                members = range(leaf * LEAF, min(n, (leaf + 1) * LEAF))
                root = forest.root(members[0])
                if any(forest.root(m) != root for m in members):
                    return -1
                one[leaf] = members[0]
            return forest.root(one[leaf])

        i, j = self.leaf_pairs(percent)
        for k in np.argsort(j - i, kind="stable").tolist():  # a leaf with itself first
            a, b = int(i[k]), int(j[k])
            if a != b and (x := whole(a)) >= 0 and x == whole(b):
                continue
            left, right = slice(a * LEAF, min(n, (a + 1) * LEAF)), slice(b * LEAF, min(n, (b + 1) * LEAF))
            bound = np.minimum(self.points[left, None], self.points[None, right]).sum(2, dtype=np.int64)
            bound = np.minimum(bound, np.minimum(self.sizes[left, None], self.sizes[None, right]))
            for p, q in np.argwhere(enough(bound, self.sizes[left, None] + self.sizes[None, right], percent)).tolist():
                p, q = p + left.start, q + right.start
                if p < q and forest.root(p) != forest.root(q) and self.may_link(p, q, percent):
                    forest.join(p, q)
        out = np.empty(n, np.int64)
        out[self.order] = self.order[forest.roots()]
        return out
