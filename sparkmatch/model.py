"""Query graphs (small, on the driver) and data graphs (two DataFrames)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A query has at most so many vertices.
MAX_QUERY = 64


@dataclass(frozen=True)
class QueryGraph:
    """An undirected, connected graph with a label on every vertex and, if any, a label on every edge.

    ``edges`` maps (u, w) with u < w to the edge label or None.  Build one with ``of``, which checks it.
    """

    labels: tuple[int, ...]
    edges: dict[tuple[int, int], int | None] = field(hash=False)

    @staticmethod
    def of(labels: Iterable[int], edges: Iterable[tuple]) -> QueryGraph:
        labels = tuple(int(x) for x in labels)
        got: dict[tuple[int, int], int | None] = {}
        for u, w, *label in edges:
            if u == w:
                continue
            if not (0 <= u < len(labels) and 0 <= w < len(labels)):
                raise ValueError(f"edge ({u}, {w}) names a vertex that is not in the query")
            got.setdefault((min(u, w), max(u, w)), label[0] if label else None)
        q = QueryGraph(labels, got)
        if not 1 <= len(labels) <= MAX_QUERY:
            raise ValueError(f"a query has 1 to {MAX_QUERY} vertices, not {len(labels)}")
        if len({x is None for x in got.values()}) > 1:
            raise ValueError("either all edges of a query have labels or none")
        seen, todo = {0}, [0]
        while todo:
            for w in q.adjacent[todo.pop()]:
                if w not in seen:
                    seen.add(w)
                    todo.append(w)
        if len(seen) < len(labels):
            raise ValueError("the query is not connected")
        return q

    def __len__(self) -> int:
        return len(self.labels)

    def __hash__(self) -> int:
        return hash((self.labels, tuple(sorted(self.edges))))

    @cached_property
    def adjacent(self) -> list[list[int]]:
        """Neighbours of each vertex, in ascending order."""
        out: list[list[int]] = [[] for _ in self.labels]
        for u, w in self.edges:
            out[u].append(w)
            out[w].append(u)
        return [sorted(x) for x in out]

    @cached_property
    def degree(self) -> list[int]:
        return [len(x) for x in self.adjacent]

    @property
    def edge_labelled(self) -> bool:
        return any(x is not None for x in self.edges.values())

    def edge_label(self, u: int, w: int) -> int | None:
        return self.edges[min(u, w), max(u, w)]

    def has_edge(self, u: int, w: int) -> bool:
        return (min(u, w), max(u, w)) in self.edges

    @cached_property
    def neighbour_kinds(self) -> list[Counter]:
        """For each vertex, how many neighbours it has of each (label, edge label)."""
        return [Counter((self.labels[w], self.edge_label(u, w)) for w in self.adjacent[u]) for u in range(len(self))]

    @cached_property
    def core(self) -> list[int]:
        """Core number of each vertex: peel vertices of least degree."""
        left, degree, out = set(range(len(self))), list(self.degree), [0] * len(self)
        k = 0
        while left:
            u = min(left, key=lambda x: (degree[x], x))
            k = max(k, degree[u])
            out[u] = k
            left.remove(u)
            for w in self.adjacent[u]:
                degree[w] -= w in left
        return out

    def degeneracy_order(self) -> list[int]:
        """Vertices in the order of peeling, least remaining degree first."""
        left, degree, out = set(range(len(self))), list(self.degree), []
        while left:
            u = min(left, key=lambda x: (degree[x], x))
            out.append(u)
            left.remove(u)
            for w in self.adjacent[u]:
                degree[w] -= w in left
        return out

    def reified(self, offset: int) -> QueryGraph:
        """Each labelled edge becomes a vertex of label ``offset`` + edge label between its ends."""
        labels, edges = list(self.labels), []
        for (u, w), label in sorted(self.edges.items()):
            labels.append(offset + (label or 0))
            edges += [(u, len(labels) - 1), (w, len(labels) - 1)]
        return QueryGraph.of(labels, edges)

    def unlabelled(self) -> QueryGraph:
        return QueryGraph.of([0] * len(self), self.edges)


@dataclass(frozen=True)
class DataGraph:
    """``vertices(id, label, degree)`` and ``edges(src, dst, elabel, src_label, dst_label)``, each edge in both directions.

    The labels of both ends are kept on the edge, so that a scan for one label pair filters at the source.
    """

    vertices: DataFrame
    edges: DataFrame
    #: (id, label), if the degrees of ``vertices`` are still to be counted from ``edges``.
    plain: DataFrame | None = None
    #: The tables that ``edges`` is made of, if each holds a pair of labels, the lesser first.
    pairs: dict[tuple[int, int], DataFrame] | None = field(default=None, compare=False)

    @staticmethod
    def of(vertices: DataFrame, edges: DataFrame) -> DataGraph:
        """From ``vertices(id, label)`` and ``edges(src, dst[, elabel])``.

        Edges may be listed in one direction or both.  Loops are dropped, repeated edges kept once with their least
        label, and edges with an end that is no vertex dropped; degrees are counted from the edges that remain.
        """
        elabel = F.col("elabel").cast("int") if "elabel" in edges.columns else F.lit(None).cast("int")
        v = vertices.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"))
        one = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), elabel.alias("elabel")).where("src <> dst")
        one = one.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.min("elabel").alias("elabel"))
        one = one.join(v.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(v.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
        return DataGraph.symmetric(v, one)

    @staticmethod
    def symmetric(vertices: DataFrame, one: DataFrame) -> DataGraph:
        """From edges (a, b, elabel, la, lb) that are distinct, without loops, and listed in one direction."""
        there = one.selectExpr("a as src", "b as dst", "elabel", "la as src_label", "lb as dst_label")
        back = one.selectExpr("b as src", "a as dst", "elabel", "lb as src_label", "la as dst_label")
        edges = there.unionAll(back)
        return DataGraph(DataGraph.with_degrees(vertices, edges), edges, vertices)

    @staticmethod
    def with_degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
        """(id, label, degree) from (id, label) and edges (src, ...) in both directions."""
        return DataGraph.with_counts(vertices, edges.groupBy("src").agg(F.count("*").cast("int").alias("degree")))

    @staticmethod
    def with_counts(vertices: DataFrame, degree: DataFrame) -> DataFrame:
        """(id, label, degree) from (id, label) and (src, degree) of the vertices that have edges."""
        return vertices.join(degree, vertices.id == degree.src, "left").select("id", "label", F.coalesce("degree", F.lit(0)).alias("degree"))

    def between(self, src_label: int, dst_label: int, elabel: int | None = None) -> DataFrame:
        """Edges (src, dst) from one label to another, of one edge label if it is given."""
        out = self.edges.where((F.col("src_label") == src_label) & (F.col("dst_label") == dst_label))
        return (out if elabel is None else out.where(F.col("elabel") == elabel)).select("src", "dst")

    def step(self, query: QueryGraph, u: int, w: int) -> DataFrame:
        """Edges (src, dst) that query edge (u, w) may map to, from u's side to w's."""
        return self.between(query.labels[u], query.labels[w], query.edge_label(u, w))

    def unlabelled(self) -> DataGraph:
        zero = F.lit(0)
        return DataGraph(self.vertices.withColumn("label", zero), self.edges.withColumn("src_label", zero).withColumn("dst_label", zero))

    def cached(self) -> DataGraph:
        return DataGraph(self.vertices.cache(), self.edges.cache())

    def metadata(self) -> DataFrame:
        """One row: numbers of vertices, edges and labels, largest degree, largest number of vertices of a label."""
        v = self.vertices.groupBy("label").agg(F.count("*").alias("n"), F.max("degree").alias("d"), F.sum(F.col("degree").cast("long")).alias("s"))
        return v.agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_vertices"),
            F.coalesce(F.expr("sum(s) div 2"), F.lit(0)).cast("long").alias("n_edges"),
            F.greatest(F.count("*"), F.coalesce(F.max("label") + 1, F.lit(0)).cast("long")).alias("n_labels"),
            F.coalesce(F.max("d"), F.lit(0)).cast("long").alias("max_degree"),
            F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("max_label_frequency"),
        )

    def validate(self, declared: DataFrame | None = None) -> list[str]:
        """Problems found: edges without a reverse, repeated edges, loops, and degrees that differ from ``declared(id, degree)``."""
        e, out = self.edges, []
        if e.where("src = dst").limit(1).count():
            out.append("loops")
        if e.groupBy("src", "dst").count().where("count > 1").limit(1).count():
            out.append("repeated edges")
        if e.select("src", "dst").join(e.selectExpr("dst as src", "src as dst"), ["src", "dst"], "left_anti").limit(1).count():
            out.append("edges in one direction only")
        if declared is not None and declared.join(self.vertices.selectExpr("id", "degree as counted"), "id").where("degree <> counted").limit(1).count():
            out.append("declared degrees differ")
        return out
