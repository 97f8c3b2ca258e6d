"""Spanning trees of a query, and the roots that filters start from."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from sparkmatch.model import QueryGraph


@dataclass(frozen=True)
class Tree:
    """A breadth-first tree: order of visit, parent, level and children of each vertex, and the other query edges by direction."""

    query: QueryGraph
    order: tuple[int, ...]
    parent: dict[int, int | None]
    level: dict[int, int]

    @property
    def place(self) -> dict[int, int]:
        return {u: i for i, u in enumerate(self.order)}

    def children(self, u: int) -> list[int]:
        return [w for w in self.order if self.parent[w] == u]

    def before(self, u: int) -> list[int]:
        """Neighbours visited earlier, in the order of visit."""
        at = self.place
        return sorted((w for w in self.query.adjacent[u] if at[w] < at[u]), key=at.__getitem__)

    def after(self, u: int) -> list[int]:
        at = self.place
        return sorted((w for w in self.query.adjacent[u] if at[w] > at[u]), key=at.__getitem__)

    def deeper(self, u: int) -> list[int]:
        """Neighbours of a later level."""
        return [w for w in self.after(u) if self.level[w] > self.level[u]]

    def levels(self) -> list[list[int]]:
        out: dict[int, list[int]] = {}
        for u in self.order:
            out.setdefault(self.level[u], []).append(u)
        return [out[k] for k in sorted(out)]

    def non_tree_edges(self, vertices: set[int]) -> int:
        """Query edges among the vertices or at one of them that are not in the tree."""
        return sum(1 for u, w in self.query.edges if (u in vertices or w in vertices) and self.parent[u] != w and self.parent[w] != u)

    def paths(self, within: set[int] | None = None, root: int | None = None) -> list[list[int]]:
        """Paths from the root down to each leaf of the tree, over the given vertices."""
        root = self.order[0] if root is None else root
        below = [w for w in self.children(root) if within is None or w in within]
        return [[root, *rest] for w in below for rest in self.paths(within, w)] or [[root]]

    def preorder(self, root: int | None = None) -> list[int]:
        root = self.order[0] if root is None else root
        return [root, *(x for w in self.children(root) for x in self.preorder(w))]


def breadth_first(query: QueryGraph, root: int) -> Tree:
    """Neighbours are visited in ascending order."""
    order, parent, level, todo = [root], {root: None}, {root: 0}, deque([root])
    while todo:
        u = todo.popleft()
        for w in query.adjacent[u]:
            if w not in parent:
                parent[w], level[w] = u, level[u] + 1
                order.append(w)
                todo.append(w)
    return Tree(query, tuple(order), parent, level)


def root_by_frequency(query: QueryGraph, label_count: dict[int, int], nlf_count: dict[int, int], n_vertices: int) -> int:
    """Of the three vertices of least label frequency over degree, the one with fewest candidates by neighbour labels.

    A vertex whose label is on more than a twentieth of the data is passed over unless it is the last of the three.
    """
    three = sorted(range(len(query)), key=lambda u: (label_count.get(query.labels[u], 0) / max(1, query.degree[u]), u))[:3]
    rare = [u for i, u in enumerate(three) if i + 1 == len(three) or label_count.get(query.labels[u], 0) <= 0.05 * n_vertices]
    return min(rare, key=lambda u: (nlf_count.get(u, 0), u))


def root_in_core(query: QueryGraph, label_count: dict[int, int], nlf_count: dict[int, int]) -> int:
    """As above over the 2-core if there is one, by candidates over degree."""
    inside = [u for u in range(len(query)) if query.core[u] >= 2] or list(range(len(query)))
    three = sorted(inside, key=lambda u: (label_count.get(query.labels[u], 0) / max(1, query.degree[u]), u))[:3]
    return min(three, key=lambda u: (nlf_count.get(u, 0) / max(1, query.degree[u]), u))


def root_by_ratio(query: QueryGraph, count: dict[int, int], leaves: bool = True) -> int:
    """Least candidates over degree; without ``leaves`` only vertices of degree 2 or more, if there are any."""
    inside = [u for u in range(len(query)) if leaves or query.degree[u] > 1] or list(range(len(query)))
    return min(inside, key=lambda u: (count.get(u, 0) / max(1, query.degree[u]), u))


def twins(query: QueryGraph) -> list[list[int]]:
    """Vertices that may be exchanged: of one label, with the same neighbours over edges of the same labels."""
    by: dict[tuple, list[int]] = {}
    for u in range(len(query)):
        by.setdefault((query.labels[u], tuple((w, query.edge_label(u, w)) for w in query.adjacent[u])), []).append(u)
    return list(by.values())


def leaf_classes(query: QueryGraph) -> list[list[int]]:
    """Twins that are leaves."""
    return [c for c in twins(query) if query.degree[c[0]] == 1]
