"""Cover trees over unit vectors and the dual traversal that finds all pairs within a distance.

A tree has nested levels with halving radii: a node at level k has radius 2 * 2**-k and
its points lie within it; its children are points of the node that are further apart
than half that radius, each with the points nearest to the first child that covers
them. Two nodes are left out if the distance of their centres exceeds the sum of their
real radii and the threshold, and linked as a whole, without looking at pairs, if
centre distance and radii together stay below it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LEAF = 128
#: Slack of the bounds, far above rounding and far below any distance of interest.
SLACK = 1e-9
#: Points of nodes that become single points.
FEW = 16
#: Possible centres that are taken at once, rows and columns compared at once, and single distances.
CENTRES, ROWS, COLUMNS, AT_ONCE = 256, 512, 2048, 65_536
#: Radius below which splitting is left and points are compared.
TINY = 1e-6
#: Slack of cosines in single precision, far above their rounding; what they leave is looked at in double precision.
ROUGH = 1e-4


class Node:
    __slots__ = ("points", "centre", "radius", "children", "level")

    def __init__(self, points: np.ndarray, centre: int, radius: float, level: int):
        self.points, self.centre, self.radius, self.level = points, centre, radius, level
        self.children: list[Node] | None = None


class CoverTree:
    """A tree over the rows ``points`` of ``x``; levels are made when they are asked for.

    Nodes of at most ``FEW`` points that are not within ``whole`` of each other as a whole
    become single points at once: in many dimensions most nodes hold two or three points
    that are far apart, and single points are compared in blocks.
    """

    def __init__(self, x: np.ndarray, points: np.ndarray, whole: float = 0.0, single: np.ndarray | None = None):
        self.x, self.whole, self.single = x, whole, x.astype(np.float32) if single is None else single
        self.root = Node(points, int(points[0]), float(distances(x[points], x[points[0]]).max()), 0)

    def split(self, node: Node) -> list[Node]:
        """Children of a node, the largest radius first: centres further apart than the next radius, with what they cover.

        Single precision tells which centre covers a point; the radii are measured in double precision.
        """
        if node.children is None:
            level = node.level + 1
            while 2.0 * 0.5**level >= node.radius:  # a radius that the node itself fits into splits nothing
                level += 1
            centre = self._covering(node, 1.0 - (2.0 * 0.5**level) ** 2 / 2)
            order = np.lexsort((node.points, centre))
            points, centre = node.points[order], centre[order]
            d = np.concatenate([_paired(self.x, points[at : at + AT_ONCE], centre[at : at + AT_ONCE]) for at in range(0, len(points), AT_ONCE)])
            first = np.flatnonzero(np.diff(centre, prepend=-1))
            n, radius = np.diff(first, append=len(points)), np.maximum.reduceat(d, first)
            few = np.repeat((n <= FEW) & (2 * radius + SLACK >= self.whole), n)
            starts = np.zeros(len(points), bool)
            starts[first] = True
            first = np.flatnonzero(starts | few)
            n, radius = np.diff(first, append=len(points)), np.maximum.reduceat(d, first)
            centre, radius = np.where(n == 1, points[first], centre[first]), np.where(n == 1, 0.0, radius)
            parts = np.split(points, first[1:])
            node.children = [Node(parts[i], int(centre[i]), float(radius[i]), level) for i in np.argsort(-radius, kind="stable").tolist()]
        return node.children

    def _covering(self, node: Node, least: float) -> np.ndarray:
        """For each point of a node the first centre whose cosine with it is ``least`` or more."""
        x = self.single if least < 0.99 else self.x
        places = np.arange(len(node.points))
        own = np.flatnonzero(node.points == node.centre)
        left, centre = np.concatenate([own, places[node.points != node.centre]]), np.empty(len(places), np.int64)
        while len(left):
            some = x[node.points[left[:CENTRES]]]
            covers = some @ some.T >= least
            free, chosen = np.ones(len(some), bool), []
            for i in range(len(some)):
                if free[i]:
                    chosen.append(i)
                    free &= ~covers[i]
            centre[left[chosen]] = node.points[left[chosen]]
            taken = np.zeros(len(left), bool)
            taken[chosen] = True
            for at in range(0, len(left), 4096):
                near = x[node.points[left[at : at + 4096]]] @ some[chosen].T >= least
                found = near.any(axis=1) & ~taken[at : at + 4096]
                which = left[at : at + 4096][found]
                centre[which] = node.points[left[chosen]][near[found].argmax(axis=1)]
                taken[at : at + 4096] |= found
            left = left[~taken]
        return centre


def _paired(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each row of ``a`` to its row of ``b``."""
    return np.sqrt(np.maximum(2.0 - 2.0 * np.einsum("ij,ij->i", x[a], x[b]), 0.0))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


class Linker:
    """Counts, for each row, the weight of the rows linked with it, and joins them into sets."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, cosine: float):
        self.x, self.single, self.weight, self.cosine = x, x.astype(np.float32), weight.astype(np.int64), cosine
        self.reach = float(np.sqrt(2.0 - 2.0 * cosine))
        self.links = np.zeros(len(x), np.int64)
        self.parent = np.arange(len(x))

    def tree(self, points: np.ndarray) -> CoverTree:
        return CoverTree(self.x, points, self.reach, self.single)

    def roots(self, i: np.ndarray) -> np.ndarray:
        """The smallest known row of the set of each row."""
        root = self.parent[i]
        while (up := self.parent[root]).tobytes() != root.tobytes():
            root = up
        self.parent[i] = root
        return root

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join the sets of each row of ``a`` and its row of ``b``: roots go below the least root that they meet, until all agree."""
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
            np.minimum.at(self.parent, a, b)

    def _all(self, p: np.ndarray, q: np.ndarray) -> None:
        """Every row of ``p`` is linked with every row of ``q``."""
        self.links[p] += self.weight[q].sum()
        self.links[q] += self.weight[p].sum()
        every = np.concatenate([p, q])
        self.unite(every, np.full(len(every), p[0]))

    def _hits(self, p: np.ndarray, q: np.ndarray) -> None:
        """Link those of the pairs (a row of ``p`` and its row of ``q``) that reach the cosine."""
        for at in range(0, len(p), AT_ONCE):
            a, b = p[at : at + AT_ONCE], q[at : at + AT_ONCE]
            hit = np.einsum("ij,ij->i", self.x[a], self.x[b]) >= self.cosine
            a, b = a[hit], b[hit]
            np.add.at(self.links, a, self.weight[b])
            np.add.at(self.links, b, self.weight[a])
            self.unite(a, b)

    def _compare(self, p: np.ndarray, q: np.ndarray, same: bool = False) -> None:
        """All pairs of a row of ``p`` and one of ``q``, which are the same rows or have none in common."""
        least = np.float32(self.cosine - ROUGH)
        for at in range(0, len(p), ROWS):
            for to in range(at if same else 0, len(q), COLUMNS):
                rows, cols = p[at : at + ROWS], q[to : to + COLUMNS]
                rough = self.single[rows] @ self.single[cols].T
                if same or rough.max() >= least:
                    i, j = np.divmod(np.flatnonzero(rough >= least), len(cols))
                    if same:
                        once = i + at < j + to
                        i, j = i[once], j[once]
                    self._hits(rows[i], cols[j])

    def within(self, tree: CoverTree) -> None:
        """All pairs of one tree."""
        todo = [tree.root]
        while todo:
            n = todo.pop()
            if len(n.points) == 1:
                continue
            if 2 * n.radius + SLACK < self.reach:
                self.links[n.points] += self.weight[n.points].sum() - self.weight[n.points]
                self.unite(n.points, np.full(len(n.points), n.points[0]))
            elif len(n.points) <= LEAF or n.radius <= TINY:
                self._compare(n.points, n.points, same=True)
            else:
                parts = tree.split(n)
                todo += [x for x in parts if len(x.points) > 1]
                self._pairs(tree, parts, tree, parts, same=True)

    def between(self, a: CoverTree, b: CoverTree) -> None:
        """All pairs of a row of one tree and a row of the other."""
        self._pairs(a, [a.root], b, [b.root], same=False)

    def _pairs(self, a: CoverTree, left: list[Node], b: CoverTree, right: list[Node], same: bool) -> None:
        todo = [(left, right, same)]
        while todo:
            left, right, same = todo.pop()
            l, r = Centres(left), Centres(right)
            for i, j, d in self._near(l, r, same):
                single = (l.n[i] == 1) & (r.n[j] == 1)
                self._hits(l.centre[i[single]], r.centre[j[single]])
                i, j, d = i[~single], j[~single], d[~single]
                whole = d + l.radius[i] + r.radius[j] + SLACK < self.reach
                leaf = (np.maximum(l.n[i], r.n[j]) <= LEAF) | (np.maximum(l.radius[i], r.radius[j]) <= TINY)
                down = (l.n[i] > 1) & ((l.radius[i] >= r.radius[j]) | (r.n[j] == 1))
                for p, qs in _grouped(i[whole], j[whole]):
                    self._all(left[p].points, _points(right, qs))
                for p, qs in _grouped(i[leaf & ~whole], j[leaf & ~whole]):
                    self._compare(left[p].points, _points(right, qs))
                rest = ~whole & ~leaf
                for p, qs in _grouped(i[rest & down], j[rest & down]):
                    todo.append((a.split(left[p]), [right[q] for q in qs], False))
                for q, ps in _grouped(j[rest & ~down], i[rest & ~down]):
                    todo.append(([left[p] for p in ps], b.split(right[q]), False))

    def _near(self, left: Centres, right: Centres, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of nodes that linked rows may lie in, and the distances of their centres; with ``same`` each pair once.

        Where even the largest radii of a block of pairs leave few of them, single precision
        leaves out the others; small radii stand together, as children come by their radius.
        """
        for at in range(0, len(left.n), ROWS):
            for to in range(at if same else 0, len(right.n), COLUMNS):
                rows, cols = slice(at, at + ROWS), slice(to, to + COLUMNS)
                a, b = left.centre[rows], right.centre[cols]
                i = j = None
                reach = left.radius[rows].max() + right.radius[cols].max() + self.reach + SLACK
                if reach < 1.0:
                    rough = self.single[a] @ self.single[b].T
                    least = np.float32(1.0 - reach * reach / 2 - ROUGH)
                    if rough.max() < least:
                        continue
                    i, j = np.divmod(np.flatnonzero(rough >= least), len(b))
                if i is None or len(i) > len(a) * len(b) // 16:
                    every = distances(self.x[a], self.x[b])
                    i, j = np.nonzero(every <= left.radius[rows, None] + right.radius[cols] + self.reach + SLACK)
                    d = every[i, j]
                else:
                    d = np.concatenate([_paired(self.x, a[i[k : k + AT_ONCE]], b[j[k : k + AT_ONCE]]) for k in range(0, len(i), AT_ONCE)])
                    near = d <= left.radius[rows][i] + right.radius[cols][j] + self.reach + SLACK
                    i, j, d = i[near], j[near], d[near]
                i, j = i + at, j + to
                if same:
                    once = i < j
                    i, j, d = i[once], j[once], d[once]
                if len(i):
                    yield i, j, d


class Centres:
    """Centres, radii and sizes of a list of nodes."""

    def __init__(self, nodes: list[Node]):
        self.centre, self.n = np.array([x.centre for x in nodes]), np.array([len(x.points) for x in nodes])
        self.radius = np.array([x.radius for x in nodes])


def _grouped(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """Each value of ``a`` with all that stand beside it in ``b``."""
    order = np.argsort(a, kind="stable")
    first = np.flatnonzero(np.diff(a[order], prepend=-1))
    for x, some in zip(a[order][first].tolist(), np.split(b[order], first[1:]), strict=False):
        yield x, some.tolist()


def _points(nodes: list[Node], which: list[int]) -> np.ndarray:
    return np.concatenate([nodes[i].points for i in which])
