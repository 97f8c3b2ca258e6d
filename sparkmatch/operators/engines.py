"""Enumeration engines.  All find the same embeddings (u0, u1, ...); they differ in the joins that they are made of.

Binary joins.  ``explore`` extends by the pivot's index edges and checks the other edges in the index too; ``gql`` by
data edges that end in a candidate; ``qsi`` by data edges with label and degree alone; ``vf3`` also looks ahead at neighbour labels, of the data graph and of the
partial embedding.

Worst-case optimal joins.  ``lftj`` extends each partial embedding over the shortest of the index lists of the neighbours
bound before, chosen embedding by embedding, and looks the results up in the others, so no step costs more than the
shortest list and no list is held as one value; ``ceci`` always extends over the tree parent's list and looks up in the
others of the index; ``rm`` does as ``lftj`` on the 2-core and joins the rest.

Factorised counts.  ``kss`` enumerates a kernel that covers all query edges and counts the ways to place the shell, an
independent set, by products; ``veq`` keeps one row, with a number, for all partial embeddings that continue alike.

Local search.  ``dpiso`` deals root candidates, each with the part of the index within its reach, to tasks that search depth first
in an order chosen anew for every partial embedding.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkmatch.functions import stats as S
from sparkmatch.operators import filters
from sparkmatch.operators.index import Index
from sparkmatch.operators.steps import Step, col, steps
from sparkmatch.plans.tree import twins
from sparkmatch.store import Store, is_scan, large

#: Index edges within reach that ``dpiso`` searches in one piece.
LOCAL_EDGES = 100_000
#: Vertices of one label whose joint placements are counted by inclusion and exclusion; more are enumerated.
GROUP = 4
#: A step whose pivot has lists so many times shorter, in the mean, than each other neighbour's does not choose by embedding.
CLEAR = 16
#: A step of a slice should write no more rows than a SLICE-th of the index's edges; there are MOST_SLICES at most.
SLICE, MOST_SLICES = 2, 64
#: Vertices of a query whose sets are all looked at for an order.
SETS = 12


def _root(step: Step, frame: DataFrame) -> DataFrame:
    return frame.select(F.col("v").alias(col(step.u)))


def _ordered(frame: DataFrame, n: int) -> DataFrame:
    return frame.select(*[col(u) for u in range(n)])


def _extend(partial: DataFrame, step: Step, edges: DataFrame, check: Callable[[int], DataFrame]) -> DataFrame:
    """Binary extension: join on the pivot, then an equi-join on both ends for each other edge.

    Constraints and inequalities are residual conditions of the first join, so nothing that they forbid is shuffled on.
    """
    pivot, *others = step.near
    e = edges.withColumnsRenamed({"src": "__src", "dst": col(step.u)})
    out = partial.join(e, (F.col(col(pivot)) == F.col("__src")) & step.accepts(F.col(col(step.u)))).drop("__src")
    for w in others:
        e = check(w).select(F.col("src").alias(col(w)), F.col("dst").alias(col(step.u)))
        out = out.join(e, [col(w), col(step.u)], "left_semi")
    return out


def _binary(index: Index, plan: list[Step], edges: Callable[[int, int], DataFrame], check: Callable[[int, int], DataFrame], after: Callable[[DataFrame, Step], DataFrame] = lambda out, step: out) -> DataFrame:
    return _ordered(_joined(index, plan, edges, check, after), len(plan))


def _joined(index: Index, plan: list[Step], edges: Callable[[int, int], DataFrame], check: Callable[[int, int], DataFrame], after: Callable[[DataFrame, Step], DataFrame] = lambda out, step: out) -> DataFrame:
    """``after`` is applied to what each step leaves; further columns of ``edges`` come with it."""
    out, rest = _root(plan[0], index.candidates.of[plan[0].u]), plan[1:]
    if rest and index.candidates.notes.get("label_only"):  # every end of an edge of the label pair is a candidate
        second = rest.pop(0)
        e = edges(second.near[0], second.u)
        out = after(e.withColumnsRenamed({"src": col(plan[0].u), "dst": col(second.u)}).where(second.accepts(F.col(col(second.u)))), second)
    for step in rest:
        out = after(_extend(out, step, edges(step.near[0], step.u), lambda w, u=step.u: check(w, u)), step)
    return out


def written(index: Index, order: list[int]) -> float:
    """Rows that the largest step of an order writes, by the mean lengths of the index lists."""
    query, (n, edges) = index.candidates.query, index.sizes()
    rows, most = float(n[order[0]]), 0.0
    for i, u in enumerate(order[1:], 1):
        near = [w for w in query.adjacent[u] if w in order[:i]]
        lists = sorted(edges[min(u, w), max(u, w)] / max(1, n[w]) for w in near)
        rows *= lists[0]
        most = max(most, rows)
        for x in lists[1:]:
            rows *= min(1.0, x / max(1, n[u]))
    return most


def economical(index: Index, order: list[int]) -> tuple[list[int], dict[tuple[int, int], float]]:
    """The order, or one from the same root that writes less, and the mean length of the index lists from w to u by (w, u).

    An extension writes as many rows as the shortest list of a bound neighbour has, and the other edges are tested
    after that.  An order is left only if one of its steps so writes more rows than the index has edges; the one of
    least rows in all is taken then, found over all sets of bound vertices.  A query without a cycle has nothing to
    test, and one of more than SETS vertices too many sets: both keep their order.
    """
    query = index.candidates.query
    near = {u: [w for w in query.adjacent[u] if w in order] for u in order}
    if sum(map(len, near.values())) < 2 * len(order):
        return order, {}
    n, edges = index.sizes()
    mean = {(w, u): edges[min(u, w), max(u, w)] / max(1, n[w]) for u in order for w in near[u]}

    def bind(rows: float, bound: frozenset[int], u: int) -> tuple[float, float]:
        """Rows that the extension by u writes, and those that are left."""
        lists = sorted(mean[w, u] for w in near[u] if w in bound)
        left = rows * lists[0]
        for x in lists[1:]:
            left *= min(1.0, x / max(1, n[u]))
        return rows * lists[0], left

    rows, most, bound = float(n[order[0]]), 0.0, frozenset(order[:1])
    for u in order[1:]:
        wrote, rows = bind(rows, bound, u)
        most, bound = max(most, wrote), bound | {u}
    if most <= sum(edges[e] for e in edges if set(e) <= bound) or len(order) > SETS:
        return order, mean
    best = {frozenset(order[:1]): (0.0, float(n[order[0]]), order[:1])}
    for _ in order[1:]:
        after: dict[frozenset[int], tuple[float, float, list[int]]] = {}
        for bound, (total, rows, path) in best.items():
            for u in order:
                if u not in bound and any(w in bound for w in near[u]):
                    wrote, left = bind(rows, bound, u)
                    key = bound | {u}
                    if key not in after or total + wrote < after[key][0]:
                        after[key] = total + wrote, left, [*path, u]
        best = after
    return next(iter(best.values()))[2], mean


def _economical_steps(index: Index, plan: list[Step]) -> list[Step]:
    """Steps of the economical order, the neighbour of the shortest lists as pivot."""
    return _by_length(index, plan)[0]


def _by_length(index: Index, plan: list[Step]) -> tuple[list[Step], set[int]]:
    """The economical steps, and the vertices whose pivot has much shorter lists than their other neighbours."""
    order, mean = economical(index, [s.u for s in plan])
    out = _sub_steps(index.candidates.query, order, [c for s in plan for c in s.less])
    out = [replace(s, near=tuple(sorted(s.near, key=lambda w: mean.get((w, s.u), 0.0)))) for s in out]
    return out, {s.u for s in out if len(s.near) > 1 and CLEAR * mean.get((s.near[0], s.u), 1.0) <= mean.get((s.near[1], s.u), 0.0)}


def explore(index: Index, plan: list[Step]) -> DataFrame:
    return _binary(index, _economical_steps(index, plan), index.edges, index.edges)


def narrows(index: Index, order: list[int]) -> int:
    """Vertices up to the step whose tests leave fewest of the rows written so far, a CLEAR-th at most; 0 if there is none before the last."""
    query, (n, edges) = index.candidates.query, index.sizes()
    rows, most, found = float(n[order[0]]), 0.0, (1 / CLEAR, 0)
    for i, u in enumerate(order[1:-1], 1):
        lists = sorted(edges[min(u, w), max(u, w)] / max(1, n[w]) for w in query.adjacent[u] if w in order[:i])
        rows *= lists[0]
        most = max(most, rows)
        for x in lists[1:]:
            rows *= min(1.0, x / max(1, n[u]))
        found = min(found, (rows / max(1.0, most), i + 1))
    return found[1]


def _explored(index: Index, plan: list[Step], store: Store | None) -> DataFrame:
    """As ``explore``.

    Over a large stored index, the few rows that a step leaves of many are written, in slices of the root if there are
    very many, so that what was shuffled for them is gone before the rest of the search.
    """
    plan, parts = _economical_steps(index, plan), list(index.of.values())
    k = narrows(index, [s.u for s in plan]) if store and parts and all(map(is_scan, parts)) and large(parts) else 0
    if not k:
        return _binary(index, plan, index.edges, index.edges)
    some = slices(index, [s.u for s in plan[:k]])
    out = reduce(DataFrame.unionAll, [store.put(_joined(x, plan[:k], x.edges, x.edges)) for x in some])
    for step in plan[k:]:
        out = _extend(out, step, index.edges(step.near[0], step.u), lambda w, u=step.u: index.edges(w, u))
    return _ordered(out, len(plan))


def explore_count(index: Index, plan: list[Step], store: Store | None = None) -> DataFrame:
    """(n_embeddings), one row, of ``explore``; ``store`` is for what it may write on the way.

    If even the economical order has a step that writes more rows than the index has edges, and the query has twins
    that share their label with no other vertex, one of them is enumerated for all: the c images that it has beside the
    same images of the rest are c (c - 1) ... ways to place k twins.  Other twins then are bound in ascending order, and
    their exchanges counted by a factor.
    """
    query, total = index.candidates.query, [F.count("*").alias("n_embeddings")]
    order = [s.u for s in plan]
    groups = [sorted(g, key=order.index) for g in twins(query) if len(g) > 1]
    alone = [g for g in groups if sum(x == query.labels[g[0]] for x in query.labels) == len(g)]
    if any(s.less for s in plan) or not alone or (most := written(index, economical(index, order)[0])) <= sum(index.sizes()[1].values()):
        return _explored(index, plan, store).agg(*total)
    found = [(written(index, [u for u in order if u not in g[1:]]), g) for g in alone]
    if min(found)[0] >= most:
        return _explored(index, plan, store).agg(*total)
    one, *others = min(found)[1]
    left = [g for g in groups if g[0] != one]
    some = _sub_steps(query, [u for u in order if u not in others], [c for g in left for c in zip(g, g[1:], strict=False)])
    some = _economical_steps(index, some)
    out = _joined(index, some, index.edges, index.edges)
    images = out.groupBy(*[col(s.u) for s in some if s.u != one]).agg(F.count("*").alias("__c"))
    ways = reduce(lambda a, j: a * (F.col("__c") - j), range(1, len(others) + 1), F.col("__c"))
    times = reduce(lambda a, g: a * factorial(len(g)), left, 1)
    return images.agg((F.coalesce(F.sum(ways), F.lit(0)) * times).cast("long").alias("n_embeddings"))


def gql(index: Index, plan: list[Step]) -> DataFrame:
    c = index.candidates
    into = lambda w, u: c.graph.step(c.query, w, u).join(c.of[u].select(F.col("v").alias("dst")), "dst", "left_semi")
    return _binary(index, plan, into, lambda w, u: c.graph.step(c.query, w, u))


def _by_degree(index: Index) -> Callable[[int, int], DataFrame]:
    c = index.candidates

    def edges(w: int, u: int) -> DataFrame:
        enough = c.graph.vertices.where((F.col("label") == c.query.labels[u]) & (F.col("degree") >= c.query.degree[u]))
        return c.graph.step(c.query, w, u).join(enough.select(F.col("id").alias("dst")), "dst", "left_semi")

    return edges


def qsi(index: Index, plan: list[Step]) -> DataFrame:
    c = index.candidates
    return _binary(index, plan, _by_degree(index), lambda w, u: c.graph.step(c.query, w, u))


def vf3(index: Index, plan: list[Step]) -> DataFrame:
    """``qsi`` with two looks ahead, which only prune.

    A candidate must have as many neighbours of each kind as the query vertex; and outside the partial embedding as many
    as the query vertex has unbound ones.  The second says more than the first only where a vertex of that label is
    bound whose image may be, beyond what the query asks, a neighbour too: these are looked up in the data graph.
    """
    c = index.candidates
    query, (profile, names) = c.query, S.profile(c.graph, c.query)
    place = {s.u: i for i, s in enumerate(plan)}
    asked: dict[int, list[tuple[tuple, int, int, list[int]]]] = {u: [] for u in place}
    for step in plan:
        u = step.u
        for kind in sorted(query.neighbour_kinds[u], key=str):
            same = lambda w, kind=kind, u=u: query.has_edge(u, w) and query.labels[w] == kind[0] and query.edge_label(u, w) == kind[1]
            unbound = sum(same(w) for w in place if place[w] > place[u])
            bound = [w for w in place if place[w] < place[u] and query.labels[w] == kind[0]]
            sure = [w for w in bound if query.has_edge(u, w) and kind[1] in (None, query.edge_label(u, w))]
            if unbound and len(sure) < len(bound):
                asked[u].append((kind, unbound, len(sure), [w for w in bound if w not in sure]))

    def edges(w: int, u: int) -> DataFrame:
        ahead = reduce(lambda a, b: a & b, (F.col(names[k]) >= n for k, n in query.neighbour_kinds[u].items()))
        able = profile.where((F.col("label") == query.labels[u]) & (F.col("degree") >= query.degree[u]) & ahead)
        able = able.select(F.col("id").alias("dst"), *[F.col(names[kind]).alias(f"__{names[kind]}") for kind, *_ in asked[u]])
        return c.graph.step(query, w, u).join(able, "dst")

    def after(out: DataFrame, step: Step) -> DataFrame:
        u, kept = step.u, [x for x in out.columns if not x.startswith("__")]
        for kind, unbound, sure, unsure in asked[u]:
            taken = F.lit(sure)
            for w in unsure:
                mark = f"__{names[kind]}_{w}"
                e = c.graph.between(query.labels[u], kind[0], kind[1]).select(F.col("src").alias(col(u)), F.col("dst").alias(col(w)), F.expr("1").alias(mark))
                out = out.join(e, [col(u), col(w)], "left")
                taken = taken + F.coalesce(F.col(mark), F.lit(0))
            out = out.where(F.col(f"__{names[kind]}") - taken >= unbound)
        return out.select(*kept)

    return _binary(index, plan, edges, lambda w, u: c.graph.step(query, w, u), after)


def _length(w: int, u: int) -> str:
    """Name of the column with the length of the index list from w's image to u."""
    return f"d{w}_{u}"


def _wanted(plan: list[Step]) -> dict[int, list[int]]:
    """For each vertex the later ones that several neighbours lead to, whose choice needs the lengths of its lists."""
    return {w: [s.u for s in plan if w in s.near and len(s.near) > 1] for w in (s.u for s in plan)}


def _lengths(index: Index, u: int, later: list[int]) -> DataFrame:
    """(v, lengths of v's lists to each of ``later``); a candidate without an edge to one of them is in no embedding."""
    edges = reduce(DataFrame.unionAll, (index.edges(u, x).select(F.col("src").alias("v"), F.lit(x).alias("x")) for x in later))
    counts = edges.groupBy("v").agg(*[F.count(F.when(F.col("x") == x, 1)).alias(_length(u, x)) for x in later])
    return counts.where(reduce(lambda a, b: a & b, (F.col(_length(u, x)) > 0 for x in later)))


def _lists(index: Index, near: tuple[int, ...], u: int) -> DataFrame:
    """(k, src, dst): the index edges to u from the k-th of its neighbours."""
    return reduce(DataFrame.unionAll, (index.edges(w, u).select(F.lit(k).alias("__k"), F.col("src").alias("__src"), F.col("dst").alias(col(u))) for k, w in enumerate(near)))


def _ranked(near: tuple[int, ...], u: int) -> Column:
    """Array of (length, k, image) of the neighbours, the shortest list first."""
    return F.sort_array(F.array(*[F.struct(F.col(_length(w, u)).alias("n"), F.lit(k).alias("k"), F.col(col(w)).alias("v")) for k, w in enumerate(near)]))


def _looked_up(out: DataFrame, keys: list[str], lists: DataFrame, dst: str, places: range) -> DataFrame:
    """Rows whose image of the last vertex is also in the lists of the other neighbours, ``__at[i]`` for i in ``places``."""
    for i in places:
        at = F.col("__at")[i]
        found = lists.select(*[F.col(k).alias(f"__x{k}") for k in keys], F.col("__k").alias("__xk"), F.col("__src").alias("__xs"), F.col(dst).alias("__xv"))
        on = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__x{k}") for k in keys] + [at["k"] == F.col("__xk"), at["v"] == F.col("__xs"), F.col(dst) == F.col("__xv")])
        out = out.join(found, on, "left_semi")
    return out


def _shortest(partial: DataFrame, index: Index, step: Step, later: list[int]) -> DataFrame:
    """Extension over the shortest list of each partial embedding, with the lengths that ``later`` steps ask for."""
    u, near = step.u, step.near
    if len(near) == 1:
        lists = index.edges(near[0], u).select(F.col("src").alias("__src"), F.col("dst").alias(col(u)))
    else:
        lists = _lists(index, near, u)
    wide = lists.join(_lengths(index, u, later), F.col(col(u)) == F.col("v")).drop("v") if later else lists
    if len(near) == 1:
        return partial.join(wide, (F.col(col(near[0])) == F.col("__src")) & step.accepts(F.col(col(u)))).drop("__src")
    out = partial.withColumn("__at", _ranked(near, u)).drop(*[_length(w, u) for w in near])
    first = F.col("__at")[0]
    out = out.join(wide, (first["k"] == F.col("__k")) & (first["v"] == F.col("__src")) & step.accepts(F.col(col(u)))).drop("__k", "__src")
    return _looked_up(out, [], lists, col(u), range(1, len(near))).drop("__at")


def _bound(index: Index, plan: list[Step], wanted: dict[int, list[int]], shortest: Callable[[Step], bool] = lambda s: True) -> DataFrame:
    """Embeddings of the plan's vertices, and the lengths that are still wanted."""
    first = plan[0].u
    out = _root(plan[0], index.candidates.of[first])
    if wanted[first]:
        out = out.join(_lengths(index, first, wanted[first]), F.col(col(first)) == F.col("v")).drop("v")
    for step in plan[1:]:
        if shortest(step):
            out = _shortest(out, index, step, wanted[step.u])
        else:
            out = _extend(out, step, index.edges(step.near[0], step.u), lambda w, u=step.u: index.edges(w, u))
            if wanted[step.u]:
                out = out.join(_lengths(index, step.u, wanted[step.u]), F.col(col(step.u)) == F.col("v")).drop("v")
    return out


def lftj(index: Index, plan: list[Step]) -> DataFrame:
    return _ordered(_bound(index, plan, _wanted(plan)), len(plan))


def slices(index: Index, order: list[int]) -> list[Index]:
    """The index, or parts of it by a hash of the root's image, few enough rows each for SLICE."""
    query, edges = index.candidates.query, index.sizes()[1]
    most = written(index, economical(index, order)[0])
    k = min(MOST_SLICES, 1 + int(SLICE * most / max(1, sum(edges[e] for e in edges if set(e) <= set(order)))))
    if k == 1:
        return [index]
    root = order[0]
    of = lambda c, i: F.pmod(F.xxhash64(F.lit(3), c), F.lit(k)) == i
    out = []
    for i in range(k):
        c = index.candidates
        kept = filters.Candidates(query, c.graph, c.of | {root: c.of[root].where(of("v", i))}, {x: y for x, y in c.notes.items() if x != "label_only"})
        parts = {(u, w): e.where(of("src" if u == root else "dst", i)) if root in (u, w) else e for (u, w), e in index.of.items()}
        out.append(Index(kept, parts, index))
    return out


def multiway(index: Index, plan: list[Step]) -> DataFrame:
    """Embeddings of some of the query's vertices: as ``lftj``, but in the economical order, and by the pivot alone where the lengths leave no doubt."""
    plan, clear = _by_length(index, plan)
    wanted = {w: [u for u in later if u not in clear] for w, later in _wanted(plan).items()}
    return _bound(index, plan, wanted, lambda s: s.u not in clear)


def ceci(index: Index, plan: list[Step]) -> DataFrame:
    out = _root(plan[0], index.candidates.of[plan[0].u])
    for step in plan[1:]:
        out = _extend(out, step, index.edges(step.near[0], step.u), lambda w, u=step.u: index.edges(w, u))
    return _ordered(out, len(plan))


def rm(index: Index, plan: list[Step]) -> DataFrame:
    inside = {s.u for s in plan if index.candidates.query.core[s.u] >= 2 and len(s.near) > 1}
    wanted = {w: [u for u in later if u in inside] for w, later in _wanted(plan).items()}
    return _ordered(_bound(index, plan, wanted, lambda s: s.u in inside), len(plan))


# ---- factorised counts


def _partitions(items: list[int]):
    """All ways to cut a list into blocks."""
    if not items:
        yield []
        return
    first, rest = items[0], items[1:]
    for blocks in _partitions(rest):
        yield [[first], *blocks]
        for i, b in enumerate(blocks):
            yield [*blocks[:i], [first, *b], *blocks[i + 1 :]]


def placements(items: list[int], common: Callable[[tuple[int, ...]], Column]) -> Column:
    """Number of ways to take one element of each item, all different: a sum over the partitions of the items.

    ``common`` gives the number of elements that all items of a block have.
    """
    total = F.lit(0).cast("long")
    for blocks in _partitions(items):
        term = F.lit(1).cast("long")
        for b in blocks:
            sign = (-1) ** (len(b) - 1) * factorial(len(b) - 1)
            term = term * common(tuple(sorted(b))) * F.lit(sign).cast("long")
        total = total + term
    return total


def kernel(index: Index, plan: list[Step]) -> tuple[list[int], list[int]]:
    """Kernel and shell along the order: a vertex is shell if all its neighbours are kernel.

    A vertex that a constraint ties to another shell vertex, or that would be the fifth shell of its label, is kernel.
    """
    query, inside, shell = index.candidates.query, [], []
    tied = {u: {x for s in plan for c in s.less if u in c for x in c} - {u} for u in range(len(query))}
    for step in plan:
        u = step.u
        free = step.near and set(query.adjacent[u]) <= set(inside) and not tied[u] & set(shell)
        (shell if free and sum(query.labels[s] == query.labels[u] for s in shell) < GROUP else inside).append(u)
    return inside, shell


def kss(index: Index, plan: list[Step]) -> DataFrame:
    """(n_embeddings), one row.

    Each kernel embedding becomes a row for each shell vertex, which is extended like a step of ``lftj``; how many
    vertices every set of shell vertices of one label may share is counted by kernel embedding, in one aggregation.
    """
    query = index.candidates.query
    inside, shell = kernel(index, plan)
    constraints = [c for s in plan for c in s.less]
    bound = _sub_steps(query, inside, [c for c in constraints if set(c) <= set(inside)])
    near = {s: tuple(w for w in inside if query.has_edge(s, w)) for s in shell}
    wanted = _wanted(bound)
    for s in shell:
        for w in near[s] if len(near[s]) > 1 else ():
            wanted[w] = [*wanted[w], s]
    out = _bound(index, bound, wanted)
    if not shell:
        return out.agg(F.count("*").alias("n_embeddings"))
    keys, most = [col(w) for w in inside], max(map(len, near.values()))

    def asked(s: int) -> Column:
        """The row of shell vertex s: its lists, the shortest first; a vertex of fewer lists than others repeats it."""
        at = _ranked(near[s], s) if len(near[s]) > 1 else F.array(F.struct(F.lit(1).cast("long").alias("n"), F.lit(0).alias("k"), F.col(col(near[s][0])).alias("v")))
        return F.struct(F.lit(s).alias("s"), F.concat(at, F.array_repeat(at[0], most - len(near[s]))).alias("at"))

    rows = out.select(*keys, F.explode(F.array(*[asked(s) for s in shell])).alias("__r")).select(*keys, F.col("__r.s").alias("__s"), F.col("__r.at").alias("__at"))
    lists = reduce(DataFrame.unionAll, (_lists(index, near[s], s).select(F.lit(s).alias("__s"), "__k", "__src", F.col(col(s)).alias("__v")) for s in shell))
    first, renamed = F.col("__at")[0], lists.select(F.col("__s").alias("__t"), "__k", "__src", "__v")
    allowed = F.lit(True)
    for s in shell:
        step = Step(s, near[s], tuple(w for w in inside if query.labels[w] == query.labels[s] and not query.has_edge(s, w)), tuple(c for c in constraints if s in c))
        allowed = allowed & ((F.col("__s") != s) | step.accepts(F.col("__v")))
    met = rows.join(renamed, (F.col("__s") == F.col("__t")) & (first["k"] == F.col("__k")) & (first["v"] == F.col("__src")) & allowed).drop("__t", "__k", "__src")
    met = _looked_up(met, ["__s"], lists, "__v", range(1, most))
    groups: dict[int, list[int]] = {}
    for s in shell:
        groups.setdefault(query.labels[s], []).append(s)
    place = {s: (g, i) for g, members in enumerate(groups.values()) for i, s in enumerate(members)}
    of = lambda i: reduce(lambda a, s: F.when(F.col("__s") == s, place[s][i]).otherwise(a), shell, F.lit(0))
    met = met.select(*keys, "__v", of(0).alias("__g"), F.expr("1").alias("__one"), of(1).alias("__i")).withColumn("__m", F.expr("shiftleft(__one, __i)"))
    if max(map(len, groups.values())) > 1:
        met = met.groupBy(*keys, "__g", "__v").agg(F.bit_or("__m").alias("__m"))
    sets = [(g, b) for g, members in enumerate(groups.values()) for b in range(1, 1 << len(members))]
    counts = met.groupBy(*keys).agg(*[F.count(F.when((F.col("__g") == g) & (F.col("__m").bitwiseAND(b) == b), 1)).alias(f"__c{g}_{b}") for g, b in sets])
    ways = F.lit(1).cast("long")
    for g, members in enumerate(groups.values()):
        ways = ways * placements(list(range(len(members))), lambda block, g=g: F.col(f"__c{g}_{sum(1 << i for i in block)}"))
    return counts.agg(F.coalesce(F.sum(ways), F.lit(0)).cast("long").alias("n_embeddings"))


def _sub_steps(query, order: list[int], constraints: list[tuple[int, int]]) -> list[Step]:
    apart = {frozenset(c) for c in constraints}
    out = []
    for i, u in enumerate(order):
        near = tuple(w for w in order[:i] if query.has_edge(u, w))
        differ = tuple(w for w in order[:i] if query.labels[w] == query.labels[u] and w not in near and frozenset((u, w)) not in apart)
        out.append(Step(u, near, differ, tuple(c for c in constraints if u in c and set(c) <= set(order[: i + 1]))))
    return out


def classes(index: Index, u: int, near: tuple[int, ...]) -> DataFrame:
    """(v, rep): candidates of u with equal index lists to each of ``near`` form a class; rep is its least.

    Lists are told apart by their lengths and two 64-bit sums of hashes, so none is collected; a candidate without an
    edge to some of ``near`` is in no embedding and in no class.
    """
    edges = reduce(DataFrame.unionAll, (index.edges(u, w).select(F.col("src").alias("v"), F.lit(w).alias("w"), "dst") for w in near))
    marks = []
    for w in near:
        here = lambda x, w=w: F.when(F.col("w") == w, x)
        marks.append(F.count(here(F.lit(1))).alias(f"n{w}"))
        for seed in (1, 2):
            # sums of 64-bit hashes as decimals: no overflow
            marks.append(F.sum(here(F.xxhash64(F.lit(seed), "dst").cast("decimal(20,0)"))).alias(f"h{seed}_{w}"))
    signs = edges.groupBy("v").agg(*marks).where(reduce(lambda a, b: a & b, (F.col(f"n{w}") > 0 for w in near)))
    signs = signs.select("v", F.struct(*[c for c in signs.columns if c != "v"]).alias("sign"))
    return signs.join(signs.groupBy("sign").agg(F.min("v").alias("rep")), "sign").select("v", "rep")


def twins_at_once(index: Index, plan: list[Step]) -> tuple[list[int], dict[int, int]]:
    """The order without all but the first of some twins, and how many that first one stands for.

    Twins are placed at once when their neighbours are all bound, no other vertex of their label follows, and no
    constraint names them: c common candidates that are free give c (c - 1) (c - 2) ... ways.
    """
    query, place = index.candidates.query, {s.u: i for i, s in enumerate(plan)}
    tied = {x for s in plan for c in s.less for x in c}
    sizes = {}
    for group in twins(query):
        u = min(group, key=place.__getitem__)
        others = {x for x in place if query.labels[x] == query.labels[u]} - set(group)
        if place[u] and not tied & set(group) and all(place[x] < place[u] for x in {*query.adjacent[u], *others}):
            sizes[u] = group
    left_out = {x for u, group in sizes.items() for x in group if x != u}
    return [u for u in place if u not in left_out], {u: len(group) for u, group in sizes.items()}


def veq(index: Index, plan: list[Step]) -> DataFrame:
    """(n_embeddings), one row.

    Partial embeddings that can be continued in the same ways are one row with their number.  After every step the
    image of a bound vertex is forgotten if nothing still depends on it, and replaced by the least candidate with equal
    lists to the neighbours still unbound if nothing else does; so classes are found anew as the embedding grows, and
    equal rows are summed.  A vertex whose image must differ from, or be compared with, that of a later one keeps it till then.
    """
    query, constraints = index.candidates.query, [c for s in plan for c in s.less]
    order, sizes = twins_at_once(index, plan)
    bound = _sub_steps(query, order, constraints)
    wanted, n, known = _wanted(bound), "__n", {}

    def merged(out: DataFrame, i: int) -> DataFrame:
        later, before = bound[i + 1 :], len(known)
        gone = []
        for x in order[: i + 1]:
            lists = tuple(s.u for s in later if x in s.near)
            if col(x) not in out.columns or any(x in s.differ or any(x in c for c in s.less) for s in later):
                continue
            if not lists:
                gone.append(col(x))
            elif (x, lists) not in known:
                known[x, lists] = classes(index, x, lists).select(F.col("v").alias(col(x)), "rep")
                out = out.join(known[x, lists], col(x)).drop(col(x)).withColumnRenamed("rep", col(x))
        if not gone and len(known) == before:
            return out
        keys = [c for c in out.columns if c not in gone and c != n]
        return out.groupBy(*keys).agg(F.sum(n).alias(n))

    out = _root(bound[0], index.candidates.of[order[0]]).withColumn(n, F.expr("1L"))
    if wanted[order[0]]:
        out = out.join(_lengths(index, order[0], wanted[order[0]]), F.col(col(order[0])) == F.col("v")).drop("v")
    for i, step in enumerate(bound):
        if i:
            out = _shortest(out, index, step, wanted[step.u])
        if (k := sizes.get(step.u, 1)) > 1:
            keys = [c for c in out.columns if c not in (col(step.u), n)]
            out = out.groupBy(*keys).agg(F.max(n).alias(n), F.count("*").alias("__c")).where(F.col("__c") >= k)
            out = out.withColumn(n, reduce(lambda a, j: a * (F.col("__c") - j), range(k), F.col(n))).drop("__c")
        if i + 1 < len(bound):
            out = merged(out, i)
    return out.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("n_embeddings"))


# ---- local search


class Search:
    """Depth-first search with an order chosen for every partial embedding, and failing sets.

    The next vertex is, leaves last, the one beside the partial embedding whose local candidates weigh least: a
    candidate weighs the number of ways to go on from it along paths of vertices with a single parent in the order.  A branch that
    fails returns the set of query vertices that its failure depends on; a vertex outside that set need not try its
    other candidates.
    """

    def __init__(self, adjacent: list[list[int]], labels: tuple[int, ...], constraints: list[tuple[int, int]], order: list[int]):
        self.adjacent, self.labels, self.order = adjacent, labels, order
        at = {u: i for i, u in enumerate(order)}
        parents = {u: [w for w in adjacent[u] if at[w] < at[u]] for u in order}
        #: Of each vertex the neighbours that have no other parent.
        self.only = {u: [c for c in adjacent[u] if parents[c] == [u]] for u in order}
        self.limits: dict[int, list[tuple[int, bool]]] = {u: [] for u in range(len(labels))}
        for a, b in constraints:
            self.limits[a].append((b, True))
            self.limits[b].append((a, False))

    def run(self, bound: dict[int, int], lists: dict[tuple[int, int], dict[int, set]]):
        """Yields the images of all embeddings that continue the bound vertices; ``lists[w, u][v]`` are u's candidates beside v."""
        self.lists = lists
        self.weight: dict[int, dict[int, int]] = {}
        for u in reversed(self.order):
            if not self.only[u]:
                continue
            own = {v for c in self.only[u] for v in lists.get((u, c), {})}
            self.weight[u] = {v: min(sum(self.weight[c].get(x, 0) if c in self.weight else 1 for x in lists.get((u, c), {}).get(v, ())) for c in self.only[u]) for v in own}
        self.image = dict(bound)
        self.reasons = {u: 1 << u for u in bound}
        self.used = {v: u for u, v in bound.items()}
        yield from self._go()

    def _local(self, u: int) -> set:
        sets = sorted((self.lists.get((w, u), {}).get(self.image[w], frozenset()) for w in self.adjacent[u] if w in self.image), key=len)
        out = sets[0]
        for s in sets[1:]:
            out = out & s
        return out

    def _weigh(self, u: int, local: set) -> int:
        weight = self.weight.get(u)
        return len(local) if weight is None else sum(weight.get(v, 0) for v in local)

    def _go(self):
        """Yields embeddings and returns the failing set, 0 if there was one."""
        if len(self.image) == len(self.labels):
            yield [self.image[u] for u in range(len(self.labels))]
            return 0
        beside = {w for u in self.image for w in self.adjacent[u]} - self.image.keys()
        local = {u: self._local(u) for u in beside}
        u = min(beside, key=lambda x: (len(self.adjacent[x]) == 1, self._weigh(x, local[x]), x))
        own = 1 << u
        for w in self.adjacent[u]:
            own |= self.reasons.get(w, 0)
        if not local[u]:
            return own
        found, union = False, own
        for v in sorted(local[u]):
            fail = 0
            if v in self.used:
                fail = own | self.reasons[self.used[v]]
            for w, less in self.limits[u]:
                if w in self.image and (v >= self.image[w] if less else v <= self.image[w]):
                    fail |= own | self.reasons[w]
            if not fail:
                self.image[u], self.reasons[u], self.used[v] = v, own, u
                fail = yield from self._go()
                del self.image[u], self.reasons[u], self.used[v]
                if fail and not fail >> u & 1:
                    return 0 if found else fail
            found |= not fail
            union |= fail
        return 0 if found else union


def _region(index: Index, plan: list[Step], partial: DataFrame, depth: int, store: Store) -> DataFrame:
    """(bound vertices, u, w, src, dst): the index edges that the embeddings which continue each row can use.

    The candidates of a vertex within reach are those beside candidates of its first neighbour in the order.
    """
    query, keys = index.candidates.query, [col(s.u) for s in plan[:depth]]
    reach = {s.u: partial.select(*keys, F.col(col(s.u)).alias("v")) for s in plan[:depth]}
    for step in plan[depth:]:
        e = index.edges(step.near[0], step.u)
        reach[step.u] = store.put(reach[step.near[0]].join(e, F.col("v") == F.col("src")).select(*keys, F.col("dst").alias("v")).distinct())
    free, parts = {s.u for s in plan[depth:]}, []
    several = {u: r.groupBy(*keys).agg(F.count("*").alias(f"n{u}")) for u, r in reach.items()}
    fan = {(r.u, r.u2): r.n / max(1, r.m) for r in index.frame().groupBy("u", "u2").agg(F.count("*").alias("n"), F.countDistinct("v").alias("m")).collect()}
    for u, w in sorted(query.edges):
        if u not in free and w not in free:
            continue
        # either all pairs within reach of the same row are looked up, or the lists of one end are run through
        both = several[u].join(several[w], keys).agg(F.sum(F.col(f"n{u}") * F.col(f"n{w}")), F.sum(F.col(f"n{u}") * fan.get((u, w), 0.0))).first()
        ends = reach[u].withColumnRenamed("v", "src"), reach[w].withColumnRenamed("v", "dst")
        if (both[0] or 0) <= (both[1] or 0):
            e = ends[0].join(ends[1], keys).join(index.edges(u, w), ["src", "dst"], "left_semi")
        else:
            e = ends[0].join(index.edges(u, w), "src").join(ends[1], [*keys, "dst"], "left_semi")
        parts.append(e.select(*keys, F.lit(u).alias("u"), F.lit(w).alias("w"), "src", "dst"))
    return store.put(reduce(DataFrame.unionAll, parts))


def dpiso(index: Index, plan: list[Step]) -> DataFrame:
    """Each root candidate goes, with the part of the index within its reach, to one task, which searches it depth first.

    A root whose part has more than LOCAL_EDGES edges is extended by the next vertex of the order, and each extension
    dealt with its own smaller part, until all parts are small or all vertices bound.
    """
    query, spark, n = index.candidates.query, index.candidates.graph.vertices.sparkSession, len(index.candidates.query)
    store, order, most = Store(spark, "dpiso"), [s.u for s in plan], LOCAL_EDGES
    constraints = [c for s in plan for c in s.less]
    adjacent, labels = query.adjacent, query.labels
    schema = ", ".join(f"{col(u)} long" for u in range(n))

    def searched(depth: int):
        def batch(found: list[list[int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([e[u] for e in found], pa.int64()) for u in range(n)], names=[col(u) for u in range(n)])

        def run(batches):
            search, found = Search(adjacent, labels, constraints, order), []
            for bound, lists in _parts(batches, depth):
                for e in search.run(dict(zip(order, bound, strict=False)), lists):
                    found.append(e)
                    if len(found) == 10_000:
                        yield batch(found)
                        found = []
            if found:
                yield batch(found)

        return run

    out, partial = [], _root(plan[0], index.candidates.of[order[0]])
    for depth in range(1, n + 1):
        if depth == n:
            out.append(_ordered(partial, n))
            break
        keys = [col(u) for u in order[:depth]]
        region = _region(index, plan, partial, depth, store)
        large = store.put(region.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > most).select(*keys))
        dealt = region.join(large, keys, "left_anti").select(*keys, "u", "w", "src", "dst").repartition(*keys).sortWithinPartitions(*keys)
        out.append(dealt.mapInArrow(searched(depth), schema))
        if not large.limit(1).count():
            break
        step = plan[depth]
        partial = store.put(_extend(large, step, index.edges(step.near[0], step.u), lambda w, u=step.u: index.edges(w, u)))
    return reduce(DataFrame.unionAll, out)


def _parts(batches, depth: int):
    """(images of the bound vertices, index lists by (w, u) and image) of each run of rows with the same images."""
    now, lists = None, {}
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(depth + 4)]
        for row in zip(*columns, strict=True):
            bound = row[:depth]
            if bound != now:
                if now is not None:
                    yield now, lists
                now, lists = bound, {}
            u, w, src, dst = row[depth:]
            lists.setdefault((u, w), {}).setdefault(src, set()).add(dst)
            lists.setdefault((w, u), {}).setdefault(dst, set()).add(src)
    if now is not None:
        yield now, lists


#: Engines that return embeddings, and those that return counts alone.
ENUMERATORS: dict[str, Callable[[Index, list[Step]], DataFrame]] = {"lftj": lftj, "explore": explore, "gql": gql, "qsi": qsi, "vf3": vf3, "dpiso": dpiso, "ceci": ceci, "rm": rm}
COUNTERS: dict[str, Callable[[Index, list[Step]], DataFrame]] = {"kss": kss, "veq": veq}
ENGINES = {**ENUMERATORS, **COUNTERS}
#: Those that read the data graph; the others read the index alone.
READ_GRAPH = ("gql", "qsi", "vf3")

__all__ = ["COUNTERS", "ENGINES", "ENUMERATORS", "Search", "classes", "kernel", "placements", "steps", "twins_at_once"]
