"""Execution trees: a match as a tree of joins that is written down, exported, imported and run node by node.

A ``scan`` gives the index edges of one query edge; a ``multiway`` node extends over a list of query vertices by
worst-case optimal steps; a ``pairwise`` node joins the rows of two nodes on the vertices that they share.  The rows of a
node are the embeddings of the part of the query that its vertices induce, so those of the root are the matches.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmatch.model import QueryGraph
from sparkmatch.operators import engines
from sparkmatch.operators.index import Index
from sparkmatch.operators.steps import col
from sparkmatch.plans import order as orders
from sparkmatch.store import Store

KINDS = ("scan", "multiway", "pairwise")


@dataclass(frozen=True)
class Node:
    kind: str
    #: Query vertices of the rows; of a multiway node in the order in which they are bound, unless another writes much less.
    vertices: tuple[int, ...]
    #: Places of the nodes that a pairwise node joins.
    inputs: tuple[int, ...] = ()


@dataclass(frozen=True)
class ExecutionTree:
    """Nodes in an order of execution, the root last."""

    query: QueryGraph
    nodes: tuple[Node, ...]

    def __post_init__(self):
        used = [i for n in self.nodes for i in n.inputs]
        if sorted(used) != list(range(len(self.nodes) - 1)):
            raise ValueError("each node but the last must be the input of one later node")
        for at, n in enumerate(self.nodes):
            if n.kind not in KINDS or len(set(n.vertices)) != len(n.vertices) or len(n.inputs) != (2 if n.kind == "pairwise" else 0):
                raise ValueError(f"bad node {n}")
            if n.kind == "pairwise":
                left, right = (self.nodes[i].vertices for i in n.inputs)
                if max(n.inputs) >= at or not set(left) & set(right) or set(n.vertices) != {*left, *right}:
                    raise ValueError(f"inputs of {n} must come before it, share a vertex and hold its vertices")
            elif n.kind == "scan" and not (len(n.vertices) == 2 and self.query.has_edge(*n.vertices)):
                raise ValueError(f"{n} is no query edge")
            elif any(not any(self.query.has_edge(u, w) for w in n.vertices[:i]) for i, u in enumerate(n.vertices) if i) or not n.vertices:
                raise ValueError(f"vertices of {n} must each be beside an earlier one")
        if set(self.nodes[-1].vertices) != set(range(len(self.query))):
            raise ValueError("the root must hold all query vertices")

    def to_json(self) -> str:
        return json.dumps({"nodes": [asdict(n) for n in self.nodes]})

    @staticmethod
    def from_json(text: str, query: QueryGraph) -> ExecutionTree:
        return ExecutionTree(query, tuple(Node(n["kind"], tuple(n["vertices"]), tuple(n["inputs"])) for n in json.loads(text)["nodes"]))

    def _rows(self, at: int, index: Index, done: Sequence[DataFrame], constraints: list[tuple[int, int]]) -> DataFrame:
        node, query = self.nodes[at], self.query
        names = [col(u) for u in node.vertices]
        inside = [c for c in constraints if set(c) <= set(node.vertices)]
        if node.kind != "pairwise":
            return engines.multiway(index, engines._sub_steps(query, list(node.vertices), inside)).select(*names)
        left, right = (self.nodes[i].vertices for i in node.inputs)
        shared = [u for u in left if u in right]
        rest = [(a, b) for a in left for b in right if a not in right and b not in left]
        # what a side alone could not test; inequalities and constraints are residual conditions of the join
        other = done[node.inputs[1]].withColumnsRenamed({col(u): f"__{col(u)}" for u in shared})
        on = F.lit(True)
        for u in shared:
            on = on & (F.col(col(u)) == F.col(f"__{col(u)}"))
        for a, b in rest:
            if query.labels[a] == query.labels[b] and not query.has_edge(a, b):
                on = on & (F.col(col(a)) != F.col(col(b)))
        for a, b in inside:
            if (a, b) in rest or (b, a) in rest:
                on = on & (F.col(col(a)) < F.col(col(b)))
        out = done[node.inputs[0]].join(other, on).select(*names)
        for a, b in rest:
            if query.has_edge(a, b):
                e = index.edges(a, b).select(F.col("src").alias(col(a)), F.col("dst").alias(col(b)))
                out = out.join(e, [col(a), col(b)], "left_semi")
        return out

    def _reduced(self, index: Index, shared: list[int], rows: DataFrame, store: Store) -> Index:
        """The index with the edges between shared vertices that the rows of another node hold."""
        n, edges = (dict(x) for x in index.sizes())
        of = dict(index.of)
        for u, w in self.query.edges:
            if u in shared and w in shared:
                of[u, w] = store.put(rows.select(F.col(col(u)).alias("src"), F.col(col(w)).alias("dst")).distinct())
                at = of[u, w].agg(F.count("*"), F.approx_count_distinct("src"), F.approx_count_distinct("dst")).first()
                edges[u, w], n[u], n[w] = at[0], min(n[u], at[1]), min(n[w], at[2])
        return Index(index.candidates, of, known=(n, edges))

    def _put(self, at: int, index: Index, done: Sequence[DataFrame], constraints: list[tuple[int, int]], store: Store) -> tuple[DataFrame, int]:
        """A node's rows, written in slices if they are made of many more, so that what one shuffles is gone before the next; and the number of slices."""
        node = self.nodes[at]
        parts = engines.slices(index, list(node.vertices)) if node.kind == "multiway" and len(node.vertices) > 2 else [index]
        return reduce(DataFrame.unionAll, [store.put(self._rows(at, x, done, constraints)) for x in parts]), len(parts)

    def embeddings(self, index: Index, constraints: Sequence[tuple[int, int]] = (), store: Store | None = None) -> DataFrame:
        """(u0, u1, ...) as one plan, nothing written between the nodes but for one case.

        Where a pairwise node joins two multiway nodes that share an edge, the second of which makes more rows, the
        first is written, to ``store`` or one of its own, and the second extends over the images of the edge that it holds.
        """
        done: list[DataFrame] = []
        of = {i: n for n in self.nodes for i in n.inputs}
        large = lambda i: self.nodes[i].kind == "multiway" and len(self.nodes[i].vertices) > 2
        for at, node in enumerate(self.nodes):
            some, others = index, [i for i in of[at].inputs if i != at] if at in of else []
            if others and others[0] < at and large(at) and large(others[0]):
                other = self.nodes[others[0]].vertices
                shared = [u for u in node.vertices if u in other]
                most = lambda x: engines.written(index, engines.economical(index, list(x))[0])
                if any(set(e) <= set(shared) for e in self.query.edges) and most(other) < most(node.vertices):
                    store = store or Store(index.candidates.graph.vertices.sparkSession, "tree")
                    done[others[0]], _ = self._put(others[0], index, done, list(constraints), store)
                    some = self._reduced(index, shared, done[others[0]], store)
            done.append(self._rows(at, some, done, list(constraints)))
        return engines._ordered(done[-1], len(self.query))

    def execute(self, index: Index, store: Store, constraints: Sequence[tuple[int, int]] = ()) -> tuple[DataFrame, list[tuple[int, str, int, float]]]:
        """The embeddings, and (node, kind, rows, seconds) of each node; each node's rows are written to ``store`` and read again."""
        done: list[DataFrame] = []
        report, written = [], []
        for at, node in enumerate(self.nodes):
            began = time.perf_counter()
            rows, n = self._put(at, index, done, list(constraints), store)
            done.append(rows)
            written.append(n)
            report.append((at, node.kind, done[-1].count(), time.perf_counter() - began))
            for i in node.inputs:
                if written[i] == 1:  # slices stay until the store is cleared
                    store.drop(done[i])
        return engines._ordered(done[-1], len(self.query)), report


def multiway(query: QueryGraph, order: list[int]) -> ExecutionTree:
    """One multiway node over all vertices."""
    return ExecutionTree(query, (Node("multiway", tuple(orders.check(query, list(order)))),))


def left_deep(query: QueryGraph, order: list[int]) -> ExecutionTree:
    """Scans joined one after the other, each along the edge from a vertex to its first neighbour in the order."""
    orders.check(query, list(order))
    if len(order) == 1:
        return multiway(query, order)
    nodes: list[Node] = []
    for i, u in enumerate(order[1:], 1):
        nodes.append(Node("scan", (next(w for w in order[:i] if query.has_edge(u, w)), u)))
        if i > 1:
            nodes.append(Node("pairwise", tuple(order[: i + 1]), (len(nodes) - 2, len(nodes) - 1)))
    return ExecutionTree(query, tuple(nodes))


def core_first(query: QueryGraph, order: list[int]) -> ExecutionTree:
    """A multiway node over the 2-core, if there is one, then a scan and a pairwise join for each other vertex."""
    orders.check(query, list(order))
    core = [u for u in order if query.core[u] >= 2]
    if not core:
        return left_deep(query, order)
    inside = [core[0]]
    while len(inside) < len(core):
        beside = [u for u in core if u not in inside and any(query.has_edge(u, w) for w in inside)]
        if not beside:  # cycles that only a path of other vertices connects
            return multiway(query, order)
        inside.append(beside[0])
    nodes = [Node("multiway", tuple(inside))]
    while len(inside) < len(order):
        u = next(u for u in order if u not in inside and any(query.has_edge(u, w) for w in inside))
        nodes.append(Node("scan", (next(w for w in inside if query.has_edge(u, w)), u)))
        inside.append(u)
        nodes.append(Node("pairwise", tuple(inside), (len(nodes) - 2, len(nodes) - 1)))
    return ExecutionTree(query, tuple(nodes))
