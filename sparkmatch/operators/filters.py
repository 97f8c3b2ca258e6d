"""Candidate filters: for each query vertex u the data vertices that may take its place.

A filter returns ``Candidates``, one DataFrame (v) for each u.  Every filter is complete: it keeps every vertex that u
has in any embedding.  They are chains of semi-joins over the edges of one label pair; what a filter does to a vertex
is seen by the next one in its sweep.  Long sweeps are written to the shared folder after each round.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmatch.functions import stats as S
from sparkmatch.model import DataGraph, QueryGraph
from sparkmatch.plans import tree as T
from sparkmatch.store import Store, is_scan, large, n_scans

#: Hall's condition is checked by one sum for each set of same-label neighbours, up to so many sums; a matching is searched beyond.
HALL_SETS = 254


@dataclass
class Candidates:
    query: QueryGraph
    graph: DataGraph
    of: dict[int, DataFrame]
    notes: dict = field(default_factory=dict)

    @staticmethod
    def within(query: QueryGraph, graph: DataGraph, table: DataFrame) -> Candidates:
        """From one table (u, v), which ``frame`` returns as long as no vertex is pruned."""
        of = {u: table.where(F.col("u") == u).select("v") for u in range(len(query))}
        return Candidates(query, graph, dict(of), {"table": (of, table)})

    def frame(self) -> DataFrame:
        """(u, v) of all candidates."""
        of, table = self.notes.get("table", ({}, None))
        if table is not None and all(self.of[u] is of[u] for u in self.of):
            return table
        return reduce(DataFrame.unionAll, (df.select(F.lit(u).alias("u"), "v") for u, df in sorted(self.of.items())))

    def counts(self) -> dict[int, int]:
        """Number of candidates of each u, by one job."""
        got = {r.u: r.n for r in self.frame().groupBy("u").agg(F.count("*").alias("n")).collect()}
        return {u: got.get(u, 0) for u in self.of}

    def stored(self, store: Store) -> Candidates:
        """The same, cut from its lineage: one table with a folder for each u."""
        out = Candidates.within(self.query, self.graph, store.put(self.frame(), by=("u",)).select("u", "v"))
        out.notes = self.notes | out.notes
        return out


def _toward(c: Candidates, u: int, w: int) -> DataFrame:
    """Edges (src, dst) that (u, w) may map to and that end in a candidate of w."""
    step = c.graph.step(c.query, u, w)
    return step.join(c.of[w].select(F.col("v").alias("dst")), "dst", "left_semi")


def prune(c: Candidates, u: int, near: list[int]) -> None:
    """Keeps the candidates of u that have a neighbour among the candidates of each vertex of ``near``."""
    for w in near:
        c.of[u] = c.of[u].join(_toward(c, u, w).select(F.col("src").alias("v")), "v", "left_semi")


def label(graph: DataGraph, query: QueryGraph) -> Candidates:
    """Same label alone.  Costs nothing: the edges of a label pair need no further semi-join."""
    of = {u: graph.vertices.where(F.col("label") == query.labels[u]).select(F.col("id").alias("v")) for u in range(len(query))}
    return Candidates(query, graph, of, {"label_only": True})


def _fitting(vertices: DataFrame, query: QueryGraph, fits: Callable[[int], Column]) -> DataFrame:
    """(u, v): one pass over the vertices; each comes out once for every query vertex that it fits."""
    which = F.array_compact(F.array(*[F.when((F.col("label") == query.labels[u]) & fits(u), F.lit(u)) for u in range(len(query))]))
    return vertices.select(F.explode(which).alias("u"), F.col("id").alias("v"))


def ldf(graph: DataGraph, query: QueryGraph) -> Candidates:
    """Same label, at least the degree."""
    vertices = graph.vertices.where(F.col("label").isin(sorted(set(query.labels))))
    return Candidates.within(query, graph, _fitting(vertices, query, lambda u: F.col("degree") >= query.degree[u]))


def nlf(graph: DataGraph, query: QueryGraph) -> Candidates:
    """As ``ldf``, and at least as many neighbours of each label (over edges of each label, if the query's have any)."""
    profile, names = S.profile(graph, query)

    def enough(u: int) -> Column:
        out = F.col("degree") >= query.degree[u]
        for kind, n in query.neighbour_kinds[u].items():
            out = out & (F.col(names[kind]) >= n)
        return out

    return Candidates.within(query, graph, _fitting(profile, query, enough))


# ---- bipartite matching


def _memberships(c: Candidates, u: int) -> DataFrame:
    """(v, w, mask) for v a candidate of u and w a neighbour: bit i is set if w is a candidate of u's i-th neighbour over such an edge."""
    parts = [
        _toward(c, u, w).select(F.col("src").alias("v"), F.col("dst").alias("w"), F.lit(1 << i).cast("long").alias("bit"))
        for i, w in enumerate(c.query.adjacent[u])
    ]
    one = reduce(DataFrame.unionAll, parts).join(c.of[u], "v", "left_semi")
    return one.groupBy("v", "w").agg(F.bit_or("bit").alias("mask"))


def _label_sets(query: QueryGraph, u: int) -> list[int]:
    """Masks of all non-empty sets of neighbours with one label; sets of mixed labels follow from these."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(query.adjacent[u]):
        by.setdefault(query.labels[w], []).append(i)
    return [sum(1 << bits[k] for k in range(len(bits)) if s >> k & 1) for bits in by.values() for s in range(1, 1 << len(bits))]


def saturated(c: Candidates, u: int) -> DataFrame:
    """(v): candidates of u whose neighbours can be matched to all neighbours of u at once.

    By Hall's theorem this holds if every set S of u's neighbours has at least |S| data neighbours that can serve one of
    them.  The sums are taken in one aggregation; when there are too many sets, each vertex's counts by mask (at most
    as many as masks, however many neighbours) go to a matching by augmenting paths.
    """
    if not c.query.adjacent[u]:
        return c.of[u]
    member = _memberships(c, u)
    sets = sum((1 << n) - 1 for n in Counter(c.query.labels[w] for w in c.query.adjacent[u]).values())
    if sets <= HALL_SETS:
        masks = _label_sets(c.query, u)
        sums = [F.count(F.when(F.col("mask").bitwiseAND(F.lit(m)) != 0, 1)).alias(f"s{i}") for i, m in enumerate(masks)]
        full = reduce(lambda a, b: a & b, (F.col(f"s{i}") >= m.bit_count() for i, m in enumerate(masks)))
        return member.groupBy("v").agg(*sums).where(full).select("v")
    by_mask = member.groupBy("v", "mask").agg(F.count("*").alias("n")).groupBy("v").agg(F.collect_list("mask").alias("masks"), F.collect_list("n").alias("ns"))
    return by_mask.where(_matches(len(c.query.adjacent[u]))("masks", "ns")).select("v")


def _matches(need: int):
    def full(masks, ns) -> bool:
        slots = [m for m, n in zip(masks, ns, strict=True) for _ in range(min(int(n), need))]
        taken: dict[int, int] = {}

        def augment(i: int, seen: set[int]) -> bool:
            for s, m in enumerate(slots):
                if int(m) >> i & 1 and s not in seen:
                    seen.add(s)
                    if s not in taken or augment(taken[s], seen):
                        taken[s] = i
                        return True
            return False

        return all(augment(i, set()) for i in range(need))

    @F.pandas_udf("boolean")
    def run(masks: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([full(a, b) for a, b in zip(masks, ns, strict=True)])

    return run


def narrowed(graph: DataGraph, query: QueryGraph, store: Store, edge_store: Store | None = None) -> DataGraph:
    """The part of a graph with the query's labels, written once to be read by every step of a filter.

    Edges are written, to ``edge_store`` if there is one, in one direction; by pairs of labels, if the scans for these read no more than that for all.
    Degrees that are still to be counted are counted from what was written, of large pairs one after the other, and from the edges to other labels.
    """
    if is_scan(graph.vertices) and is_scan(graph.edges):  # a stored graph: its scans filter by label themselves
        return graph
    edge_store = edge_store or store
    labels = sorted(set(query.labels))
    inside = graph.edges.where(F.col("src_label").isin(labels) & F.col("dst_label").isin(labels) & (F.col("src") < F.col("dst")))
    pairs = {}
    for i, a in enumerate(labels):
        for b in labels[i:]:
            e = graph.edges.where((F.col("src_label") == a) & (F.col("dst_label") == b))
            pairs[a, b] = (e if a < b else e.where("src < dst")).select("src", "dst", "elabel")
            if not n_scans(pairs[a, b]):
                del pairs[a, b]
    stored = None
    if pairs and sum(map(n_scans, pairs.values())) <= n_scans(inside):
        stored = dict(zip(pairs, edge_store.put_all(list(pairs.values()), "pair"), strict=True))
        parts = [e.select("src", "dst", "elabel", F.lit(a).alias("src_label"), F.lit(b).alias("dst_label")) for (a, b), e in stored.items()]
    else:
        parts = [edge_store.put(inside.sortWithinPartitions("src_label", "dst_label"))]
    edges = reduce(DataFrame.unionAll, [x for e in parts for x in (e, e.selectExpr("dst as src", "src as dst", "elabel", "dst_label as src_label", "src_label as dst_label"))])
    if graph.plain is None:
        return DataGraph(store.put(graph.vertices.where(F.col("label").isin(labels))), edges, pairs=stored)
    plain, ends = graph.plain.where(F.col("label").isin(labels)), [e.select("src").unionAll(e.select("dst")) for e in parts]
    beyond = graph.edges.where(F.col("src_label").isin(labels) & ~F.col("dst_label").isin(labels)).select("src")
    ends = [*ends, beyond] if n_scans(beyond) else [*ends[:-1], ends[-1].unionAll(beyond)]
    if not large(ends):
        return DataGraph(store.put(DataGraph.with_degrees(plain, reduce(DataFrame.unionAll, ends))), edges, pairs=stored)
    counts = store.inner("degrees")
    by = [counts.put(e.groupBy("src").agg(F.count("*").alias("n"))) for e in ends]
    vertices = store.put(DataGraph.with_counts(plain, reduce(DataFrame.unionAll, by).groupBy("src").agg(F.sum("n").cast("int").alias("degree"))))
    counts.clear()
    return DataGraph(vertices, edges, pairs=stored)


def _sweep(c: Candidates, order, visit: Callable[[int], None], store: Store) -> None:
    """Visits the vertices in order.  What a visit leaves is written, since several later visits read it."""
    for u in order:
        before = c.of[u]
        visit(u)
        if c.of[u] is not before:
            c.of[u] = store.put(c.of[u])
            if id(before) in store.paths:  # the state before is read no more
                store.drop(before)


def gql(graph: DataGraph, query: QueryGraph, store: Store, sweeps: int = 2) -> Candidates:
    """``nlf``, then sweeps in order of id: a candidate's neighbours must match all neighbours of u."""
    c = nlf(graph, query).stored(store)
    for _ in range(sweeps):
        _sweep(c, range(len(query)), lambda u: c.of.__setitem__(u, saturated(c, u)), store)
    return c


def calig(graph: DataGraph, query: QueryGraph, store: Store) -> Candidates:
    """``ldf``, then three sweeps, forward, back and forward, with the same test."""
    c, ids = ldf(graph, query).stored(store), list(range(len(query)))
    for order in (ids, ids[::-1], ids):
        _sweep(c, order, lambda u: c.of.__setitem__(u, saturated(c, u)), store)
    return c


# ---- trees


def label_counts(graph: DataGraph, query: QueryGraph) -> tuple[dict[int, int], int]:
    """Vertices of each query label, and of the graph."""
    got = {r.label: r.n for r in S.label_frequency(graph).collect()}
    return {label: got.get(label, 0) for label in set(query.labels)}, sum(got.values())


def _root(root: int | None, choose: Callable[[], int]) -> int:
    return choose() if root is None else root


def _tree_filter(c: Candidates, tree: T.Tree, down: Callable[[int], list[int]], up: Callable[[int], list[int]], store: Store) -> Candidates:
    """Top-down with ``down`` of each vertex, then bottom-up with ``up``."""
    _sweep(c, tree.order, lambda u: prune(c, u, down(u)), store)
    _sweep(c, tree.order[::-1], lambda u: prune(c, u, up(u)), store)
    c.notes["tree"] = tree
    return c


def tso(graph: DataGraph, query: QueryGraph, store: Store, root: int | None = None) -> Candidates:
    """Down the breadth-first tree by parents, then up by children."""
    c = nlf(graph, query).stored(store)
    tree = T.breadth_first(query, _root(root, lambda: T.root_by_frequency(query, label_counts(graph, query)[0], c.counts(), label_counts(graph, query)[1])))
    return _tree_filter(c, tree, lambda u: [] if tree.parent[u] is None else [tree.parent[u]], tree.children, store)


def cfl(graph: DataGraph, query: QueryGraph, store: Store, root: int | None = None) -> Candidates:
    """Level by level: forward by all neighbours before, back by later neighbours of the level; then up by deeper neighbours."""
    c = nlf(graph, query).stored(store)
    tree = T.breadth_first(query, _root(root, lambda: T.root_in_core(query, label_counts(graph, query)[0], c.counts())))
    for level in tree.levels():
        _sweep(c, level, lambda u: prune(c, u, tree.before(u)), store)
        _sweep(c, level[::-1], lambda u: prune(c, u, [w for w in tree.after(u) if tree.level[w] == tree.level[u]]), store)
    _sweep(c, tree.order[::-1], lambda u: prune(c, u, tree.deeper(u)), store)
    c.notes["tree"] = tree
    return c


def dpiso(graph: DataGraph, query: QueryGraph, store: Store, root: int | None = None) -> Candidates:
    """``ldf``, then over the breadth-first directed graph: forward, backward, forward."""
    c = ldf(graph, query).stored(store)
    tree = T.breadth_first(query, _root(root, lambda: T.root_by_ratio(query, c.counts(), leaves=False)))
    for k in range(3):
        order, near = (tree.order[::-1], tree.after) if k % 2 else (tree.order, tree.before)
        _sweep(c, order, lambda u, near=near: prune(c, u, near(u)), store)
    c.notes["tree"] = tree
    return c


def ceci(graph: DataGraph, query: QueryGraph, store: Store, root: int | None = None) -> Candidates:
    """Down the tree by the parent and then by the other neighbours before; up by every neighbour after.

    Going up, a candidate stays only if each later neighbour has a candidate beside it, that is while its number of
    ways down the tree is not zero.
    """
    c = nlf(graph, query).stored(store)
    tree = T.breadth_first(query, _root(root, lambda: T.root_by_ratio(query, c.counts())))

    def down(u: int) -> list[int]:
        first = tree.parent[u]
        return [] if first is None else [first, *(w for w in tree.before(u) if w != first)]

    return _tree_filter(c, tree, down, tree.after, store)


def _still(c: Candidates, u: int) -> DataFrame:
    """(v): candidates of u that have, of each kind of neighbour, enough that are candidates of some neighbour of u of the kind."""
    query, parts = c.query, {}
    for w in query.adjacent[u]:
        kind = (query.labels[w], query.edge_label(u, w))
        parts.setdefault(kind, []).append(_toward(c, u, w))
    out = c.of[u]
    for kind, edges in parts.items():
        near = reduce(DataFrame.unionAll, edges).distinct() if len(edges) > 1 else edges[0]
        enough = near.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") >= query.neighbour_kinds[u][kind])
        out = out.join(enough.select(F.col("src").alias("v")), "v", "left_semi")
    return out


def veq(graph: DataGraph, query: QueryGraph, store: Store, root: int | None = None) -> Candidates:
    """``ldf`` and one sweep by all neighbours; then three sweeps over the directed graph, back, forward and back.

    A sweep tests neighbour counts over those that are still candidates, and the neighbours after (before, going forward).
    """
    c = ldf(graph, query).stored(store)
    _sweep(c, range(len(query)), lambda u: prune(c, u, query.adjacent[u]), store)
    tree = T.breadth_first(query, _root(root, lambda: T.root_by_ratio(query, c.counts(), leaves=False)))
    for k in range(3):
        order, near = (tree.order, tree.before) if k % 2 else (tree.order[::-1], tree.after)

        def visit(u: int, near=near) -> None:
            c.of[u] = _still(c, u)
            prune(c, u, near(u))

        _sweep(c, order, visit, store)
    c.notes["tree"] = tree
    return c


def rm(graph: DataGraph, query: QueryGraph, store: Store) -> Candidates:
    """Relational: one relation for each query edge, its ends filtered by neighbour labels, then a full reducer of semi-joins.

    The reducer goes along the degeneracy order and back, twice; each vertex is reduced by its neighbours on one side.
    """
    c = nlf(graph, query).stored(store)
    order = query.degeneracy_order()
    at = {u: i for i, u in enumerate(order)}
    for k in range(4):
        side = (lambda u: [w for w in query.adjacent[u] if at[w] < at[u]]) if k % 2 == 0 else (lambda u: [w for w in query.adjacent[u] if at[w] > at[u]])
        _sweep(c, order if k % 2 == 0 else order[::-1], lambda u, side=side: prune(c, u, side(u)), store)
    return c


def steady(graph: DataGraph, query: QueryGraph, store: Store, start: Candidates | None = None) -> Candidates:
    """Sweeps by all neighbours until no candidate goes any more: the fixpoint of arc consistency from ``start`` (``nlf`` if not given)."""
    c = (start or nlf(graph, query)).stored(store)
    n = sum(c.counts().values())
    while True:
        _sweep(c, range(len(query)), lambda u: prune(c, u, query.adjacent[u]), store)
        m = sum(c.counts().values())
        if m == n:
            return c
        n = m


def false_positive_ratio(c: Candidates, least: Candidates) -> float:
    """Mean over the query vertices of the share of candidates that the steady state does without."""
    a, b = c.counts(), least.counts()
    return sum((a[u] - b[u]) / a[u] if a[u] else 0.0 for u in a) / max(1, len(a))


FILTERS: dict[str, Callable[..., Candidates]] = {"label": label, "ldf": ldf, "nlf": nlf, "gql": gql, "tso": tso, "cfl": cfl, "dpiso": dpiso, "ceci": ceci, "veq": veq, "rm": rm, "calig": calig, "steady": steady}


def make(name: str, graph: DataGraph, query: QueryGraph, store: Store | None = None, root: int | None = None) -> Candidates:
    """The named filter.  Those with sweeps write their steps to ``store``, or to one of their own."""
    if name not in FILTERS:
        raise ValueError(f"no filter {name!r}; there are {', '.join(FILTERS)}")
    if name in ("label", "ldf", "nlf"):
        return FILTERS[name](graph, query)
    store = store or Store(graph.vertices.sparkSession, f"filter-{name}")
    return FILTERS[name](narrowed(graph, query, store), query, store, **({"root": root} if name in ("tso", "cfl", "dpiso", "ceci", "veq") else {}))
