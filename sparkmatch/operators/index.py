"""The candidate index: for each query edge the data edges between candidates of its ends."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkmatch.functions import stats as S
from sparkmatch.model import DataGraph
from sparkmatch.operators.filters import Candidates, label_counts
from sparkmatch.plans.order import Stats
from sparkmatch.store import Store, is_scan

#: Edges that are not stored are counted by one of SHARE, those of which the share is less than FEW in full.
SHARE, FEW = 64, 100


@dataclass
class Index:
    """``of[u, w]`` with u < w: (src, dst) with src a candidate of u and dst of w.  The reverse swaps columns."""

    candidates: Candidates
    of: dict[tuple[int, int], DataFrame]
    #: The index of which this one has a part of the candidates; its sizes are taken for those of this one.
    whole: Index | None = None
    known: tuple[dict[int, int], dict[tuple[int, int], int]] | None = field(default=None, repr=False)

    def edges(self, u: int, w: int) -> DataFrame:
        return self.of[u, w] if u < w else self.of[w, u].select(F.col("dst").alias("src"), F.col("src").alias("dst"))

    def frame(self) -> DataFrame:
        """(u, u2, v, v2) of all directed query edges."""
        q = self.candidates.query
        return reduce(DataFrame.unionAll, (self.edges(u, w).select(F.lit(u).alias("u"), F.lit(w).alias("u2"), F.col("src").alias("v"), F.col("dst").alias("v2")) for a, b in sorted(q.edges) for u, w in ((a, b), (b, a))))

    def graph(self) -> DataGraph:
        """The part of the data graph that embeddings can use: its vertices and the edges of the index."""
        c, parts = self.candidates, []
        for a, b in sorted(c.query.edges):
            for u, w in ((a, b), (b, a)):
                label = F.lit(c.query.edge_label(u, w)).cast("int").alias("elabel")
                parts.append(self.edges(u, w).select("src", "dst", label, F.lit(c.query.labels[u]).alias("src_label"), F.lit(c.query.labels[w]).alias("dst_label")))
        return DataGraph(c.graph.vertices, reduce(DataFrame.unionAll, parts).distinct() if parts else c.graph.edges)

    def cardinalities(self) -> DataFrame:
        """(u, u2, n_edges, max_degree, n_bytes) of each directed query edge; n_bytes at 8 bytes an id."""
        by = self.frame().groupBy("u", "u2", "v").agg(F.count("*").alias("d"))
        return by.groupBy("u", "u2").agg(F.sum("d").alias("n_edges"), F.max("d").alias("max_degree"), (8 * (F.sum("d") + F.count("*"))).alias("n_bytes"))

    def projections(self) -> DataFrame:
        """(u, u2, v): the distinct ends at u of the index edges of each directed query edge (u, u2)."""
        return self.frame().select("u", "u2", "v").distinct()

    def projection(self, u: int, w: int) -> DataFrame:
        """(v): the same of one query edge, in ascending order."""
        return self.edges(u, w).select(F.col("src").alias("v")).distinct().orderBy("v")

    def stats(self, paths: bool = False) -> Stats:
        """What orders ask for: one job over the candidates, one over the index, one over the labels."""
        c = self.candidates
        n_edges = {(r.u, r.u2): r.n for r in self.frame().groupBy("u", "u2").agg(F.count("*").alias("n")).collect()} if c.query.edges else {}
        both = [(u, w) for a, b in c.query.edges for u, w in ((a, b), (b, a))]
        labels, n = label_counts(c.graph, c.query)
        tail = [(r.degree, r.p) for r in S.degree_tail(c.graph).collect()]  # one row for each distinct degree
        return Stats(
            c.counts(), {e: n_edges.get(e, 0) for e in both}, labels, n,
            lambda d: max((p for k, p in tail if k >= d), default=0.0), self.path_estimate if paths else None,
        )

    def sizes(self) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
        """Candidates of each vertex and edges of each undirected query edge, for choices that change no result.

        The share of edges that are not stored is picked by a hash of both ends, which the planner moves below the
        joins and aggregations that they come from.
        """
        if self.whole:
            return self.whole.sizes()
        if self.known is None:
            part = F.pmod(F.xxhash64("src", "dst"), F.lit(SHARE)) == 0

            def counted(of: dict[tuple[int, int], DataFrame]) -> dict[tuple[int, int], int]:
                rows = [e.agg(F.count("*").alias("n")).select(F.lit(u).alias("u"), F.lit(w).alias("w"), "n") for (u, w), e in of.items()]
                return {(r.u, r.w): r.n for r in reduce(DataFrame.unionAll, rows).collect()} if rows else {}

            stored = {k: is_scan(e) for k, e in self.of.items()}
            n = counted({k: e if stored[k] else e.where(part) for k, e in self.of.items()})
            few = counted({k: self.of[k] for k in n if not stored[k] and n[k] < FEW})
            self.known = self.candidates.counts(), {k: few.get(k, n[k] if stored[k] else SHARE * n[k]) for k in n}
        return self.known

    def path_estimate(self, path: list[int]) -> float:
        """Exact number of ways to map a path to the index, vertices not told apart: sums of products, from the end."""
        ways = self.candidates.of[path[-1]].select(F.col("v").alias("dst"), F.lit(1.0).alias("ways"))
        for u, w in zip(path[-2::-1], path[:0:-1], strict=True):
            ways = self.edges(u, w).join(ways, "dst").groupBy("src").agg(F.sum("ways").alias("ways")).select(F.col("src").alias("dst"), "ways")
        return ways.agg(F.sum("ways")).first()[0] or 0.0


def build(c: Candidates, store: Store | None = None, spent: Store | None = None) -> Index:
    """One semi-join on either side for each undirected query edge.

    With a ``store`` all are written, to be read several times.  ``spent`` is the store of the graph's edges, if nothing
    else is to read them: of large ones, each pair of labels is dropped when the last query edge over it is written.
    """
    of = {}
    for u, w in sorted(c.query.edges):
        e = c.graph.step(c.query, u, w)
        if not c.notes.get("label_only"):
            e = e.join(c.of[u].select(F.col("v").alias("src")), "src", "left_semi").join(c.of[w].select(F.col("v").alias("dst")), "dst", "left_semi")
        of[u, w] = e.select("src", "dst")
    if store and of:
        over = [tuple(sorted(c.query.labels[u] for u in e)) for e in of]

        def after(i: int) -> None:
            if spent and over[i] not in over[i + 1 :] and spent.holds(edges := (c.graph.pairs or {}).get(over[i])):
                spent.drop(edges)

        of = dict(zip(of, store.put_all(list(of.values()), "edge", after), strict=True))
    return Index(c, of)
