"""The registered queries over the driver tables, and the same in plain SQL.

Every query of a filter, order or engine runs it on a pattern over the property graph of ``sources.tables``; the SQL
side builds the graph with joins of its own and answers by self-joins, or by chains of EXISTS for filters.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmatch.functions import stats
from sparkmatch.model import QueryGraph
from sparkmatch.operators import engines, filters
from sparkmatch.operators.index import build
from sparkmatch.operators.tree import ExecutionTree, Node
from sparkmatch.plans import symmetry
from sparkmatch.plans.order import ORDERS
from sparkmatch.plans.tree import breadth_first
from sparkmatch.session import prepare, spectrum
from sparkmatch.sources import tables as T
from sparkmatch.sources import transform
from sparkmatch.store import Store

N, S, C, P, O = T.NATION, T.SUPPLIER, T.CUSTOMER, T.PART, T.ORDER  # noqa: E741

SQUARE = QueryGraph.of([N, S, O, C], [(0, 1), (1, 2), (2, 3), (3, 0)])
TRIANGLE = QueryGraph.of([O, P, S], [(0, 1), (1, 2), (0, 2)])
PART_SQUARE = QueryGraph.of([P, O, P, O], [(0, 1), (1, 2), (2, 3), (3, 0)])
HOUSE = QueryGraph.of([N, S, P, O, C], [(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (1, 3)])
PATH = QueryGraph.of([C, O, S, N], [(0, 1), (1, 2), (2, 3)])
STAR = QueryGraph.of([O, C, P, P], [(0, 1), (0, 2), (0, 3)])
#: Square and triangle of the house, joined on the edge that they share.
HOUSE_TREE = ExecutionTree(HOUSE, (Node("multiway", (1, 0, 4, 3)), Node("multiway", (1, 2, 3)), Node("pairwise", (0, 1, 2, 3, 4), (0, 1))))
#: Supplier, part of the fourth brand, order of the first priority, customer of the first segment.
FINE = QueryGraph.of([1, 23, 50, 10], [(0, 1), (1, 2), (2, 3), (0, 2)])
CLIQUE = QueryGraph.of([0] * 4, [(a, b) for a in range(4) for b in range(a)])
#: As the square, but the order must reach the supplier over an edge of that kind.
LABELLED = QueryGraph.of([N, S, O, C], [(0, 1, T.KINDS["supplier_nation"]), (1, 2, T.KINDS["order_supplier"]), (2, 3, T.KINDS["order_customer"]), (3, 0, T.KINDS["customer_nation"])])

_SQUARE_KINDS = ["supplier_nation", "customer_nation", "order_customer", "order_supplier"]
_TRIANGLE_KINDS = ["order_part", "order_supplier", "part_supplier"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


# ---- SQL over the same tables

_SIDES = {
    "supplier_nation": (S, N, "select distinct s_suppkey as x, s_nationkey as y from supplier"),
    "customer_nation": (C, N, "select distinct c_custkey as x, c_nationkey as y from customer"),
    "order_customer": (O, C, "select distinct o_orderkey as x, o_custkey as y from orders"),
    "order_part": (O, P, "select distinct l_orderkey as x, l_partkey as y from lineitem"),
    "order_supplier": (O, S, "select distinct l_orderkey as x, l_suppkey as y from lineitem"),
    "part_supplier": (P, S, "select distinct l_partkey as x, l_suppkey as y from lineitem"),
}
_VERTICES = {
    N: ("nation", "n_nationkey", "0"),
    S: ("supplier", "s_suppkey", "1"),
    C: ("customer", "c_custkey", "9 + dense_rank() over (order by c_mktsegment)"),
    P: ("part", "p_partkey", "19 + dense_rank() over (order by p_brand)"),
    O: ("orders", "o_orderkey", "49 + dense_rank() over (order by o_orderpriority)"),
}


def graph_sql(coarse: bool = True, kinds: list[str] | None = None, extra: str = "") -> str:
    """WITH clause that defines v(id, label), e(src, dst, el, sl, dl) in both directions and g(id, label, degree)."""
    kinds = list(_SIDES) if kinds is None else kinds
    types = sorted({t for k in kinds for t in _SIDES[k][:2]})
    vertex = " union all ".join(f"select cast({T.BASE * t} + {_VERTICES[t][1]} as bigint) as id, cast({t if coarse else _VERTICES[t][2]} as integer) as label from {_VERTICES[t][0]}" for t in types)
    one = " union all ".join(f"select cast({T.BASE * a} + x as bigint) as a, cast({T.BASE * b} + y as bigint) as b, {T.KINDS[k]} as el from ({sql})" for k, (a, b, sql) in _SIDES.items() if k in kinds)
    return f"""with v as ({vertex}),
one as ({one}),
e as (select a as src, b as dst, el, x.label as sl, y.label as dl from one join v x on x.id = a join v y on y.id = b
      union all select b, a, el, y.label, x.label from one join v x on x.id = a join v y on y.id = b),
g as (select v.id, v.label, cast(count(e.src) as integer) as degree from v left join e on e.src = v.id group by 1, 2){extra}
"""


def match_sql(query: QueryGraph, what: str, less: list[tuple[int, int]] | None = None, **graph) -> str:
    """A self-join with one alias of v for each query vertex and one of e for each query edge."""
    tables = [f"v v{u}" for u in range(len(query))]
    where = [f"v{u}.label = {query.labels[u]}" for u in range(len(query))]
    for i, ((u, w), x) in enumerate(sorted(query.edges.items())):
        tables.append(f"e e{i}")
        where += [f"e{i}.src = v{u}.id", f"e{i}.dst = v{w}.id"] + ([f"e{i}.el = {x}"] if x is not None else [])
    where += [f"v{u}.id <> v{w}.id" for u in range(len(query)) for w in range(u) if query.labels[u] == query.labels[w]]
    where += [f"v{a}.id < v{b}.id" for a, b in less or []]
    return f"{graph_sql(**graph)} select {what} from {', '.join(tables)} where {' and '.join(where)}"


def _all(query: QueryGraph) -> str:
    return ", ".join(f"v{u}.id as u{u}" for u in range(len(query)))


_COUNT = "cast(count(*) as bigint) as n_embeddings"


class _FilterSQL:
    """A filter as a chain of common tables c{u}_{k}: the k-th state of u's candidates."""

    def __init__(self, query: QueryGraph):
        self.q, self.parts, self.at = query, [], {}

    def set(self, u: int, sql: str) -> None:
        self.at[u] = self.at.get(u, -1) + 1
        self.parts.append(f"c{u}_{self.at[u]} as materialized ({sql})")

    def now(self, u: int) -> str:
        return f"c{u}_{self.at[u]}"

    def start(self, by_labels: bool) -> None:
        for u in range(len(self.q)):
            sql = f"select id as v from g where label = {self.q.labels[u]} and degree >= {self.q.degree[u]}"
            if by_labels:
                for (label, _), n in self.q.neighbour_kinds[u].items():
                    sql += f" and (select count(*) from e where e.src = g.id and e.dl = {label}) >= {n}"
            self.set(u, sql)

    def prune(self, u: int, near: list[int]) -> None:
        for w in near:
            self.set(u, f"select v from {self.now(u)} c where exists (select 1 from e join {self.now(w)} d on d.v = e.dst where e.src = c.v)")

    def saturate(self, u: int) -> None:
        bits = " union all ".join(f"select c.v, e.dst as w, {1 << i} as bit from {self.now(u)} c join e on e.src = c.v join {self.now(w)} d on d.v = e.dst" for i, w in enumerate(self.q.adjacent[u]))
        masks = " and ".join(f"sum(case when (mask & {m}) <> 0 then 1 else 0 end) >= {m.bit_count()}" for m in range(1, 1 << len(self.q.adjacent[u])))
        self.set(u, f"select v from (select v, w, bit_or(bit) as mask from ({bits}) group by 1, 2) group by v having {masks}")

    def still(self, u: int) -> None:
        for (label, _), n in self.q.neighbour_kinds[u].items():
            near = " union ".join(f"select v from {self.now(w)}" for w in self.q.adjacent[u] if self.q.labels[w] == label)
            self.set(u, f"select v from {self.now(u)} c where (select count(*) from e where e.src = c.v and e.dst in ({near})) >= {n}")

    def text(self, **graph) -> str:
        rows = " union all ".join(f"select {u} as u, v from {self.now(u)}" for u in range(len(self.q)))
        return graph_sql(**graph, extra=",\n" + ",\n".join(self.parts)) + rows


def filter_sql(name: str, query: QueryGraph, root: int, **graph) -> str:
    f, ids, tree = _FilterSQL(query), list(range(len(query))), breadth_first(query, root)
    f.start(name not in ("ldf", "dpiso", "veq", "calig"))
    if name == "gql":
        for u in ids * 2:
            f.saturate(u)
    elif name == "calig":
        for u in ids + ids[::-1] + ids:
            f.saturate(u)
    elif name == "tso":
        for u in tree.order[1:]:
            f.prune(u, [tree.parent[u]])
        for u in tree.order[::-1]:
            f.prune(u, tree.children(u))
    elif name == "cfl":
        for level in tree.levels():
            for u in level:
                f.prune(u, tree.before(u))
            for u in level[::-1]:
                f.prune(u, [w for w in tree.after(u) if tree.level[w] == tree.level[u]])
        for u in tree.order[::-1]:
            f.prune(u, tree.deeper(u))
    elif name == "dpiso":
        for order, near in ((tree.order, tree.before), (tree.order[::-1], tree.after), (tree.order, tree.before)):
            for u in order:
                f.prune(u, near(u))
    elif name == "ceci":
        for u in tree.order[1:]:
            f.prune(u, [tree.parent[u], *(w for w in tree.before(u) if w != tree.parent[u])])
        for u in tree.order[::-1]:
            f.prune(u, tree.after(u))
    elif name == "veq":
        for u in ids:
            f.prune(u, query.adjacent[u])
        for order, near in ((tree.order[::-1], tree.after), (tree.order, tree.before), (tree.order[::-1], tree.after)):
            for u in order:
                f.still(u)
                f.prune(u, near(u))
    elif name == "rm":
        order = query.degeneracy_order()
        place = {u: i for i, u in enumerate(order)}
        for k in range(4):
            for u in order if k % 2 == 0 else order[::-1]:
                f.prune(u, [w for w in query.adjacent[u] if (place[w] < place[u]) == (k % 2 == 0)])
    elif name == "steady":
        for u in ids * 6:
            f.prune(u, query.adjacent[u])
    return f.text(**graph)


# ---- orders: of all connected orders the one whose keys, step after step, are least

def _keys(name: str, q: QueryGraph, order: tuple[int, ...]) -> list | None:
    """The rule's keys of an order as SQL terms over the counts of ``order_sql``; None if the rule never gives the order."""
    before = lambda i: [w for w in q.adjacent[order[i]] if w in order[:i]]
    tree = breadth_first(q, order[0])
    if name == "gql":
        return [x for u in order for x in (f"c{u}", -q.degree[u], u)]
    if name == "vf3":
        return [x for i, u in enumerate(order) for x in (-len(before(i)), f"l{u} / nv * t{u}", -q.degree[u], u)]
    if name in ("dpiso", "ceci"):
        return [f"c{order[0]} / {q.degree[order[0]]}", order[0]] if order == tree.order else None
    if name == "vf2pp":
        return [f"l{order[0]}", -q.degree[order[0]], order[0], *(x for i, u in enumerate(order) for x in (tree.level[u], -len(before(i)), -q.degree[u], f"l{u}", u))]
    if name == "qsi":
        u, w = sorted(order[:2])
        if not q.has_edge(u, w) or list(order[:2]) != ([u, w] if q.degree[u] >= q.degree[w] else [w, u]):
            return None
        first = [f"e{u}_{w}", q.degree[u] + q.degree[w], u, w]
        return first + [x for i, v in enumerate(order) if i > 1 for x in ("least(" + ", ".join(f"e{min(y, v)}_{max(y, v)}" for y in before(i)) + ")", len(before(i)), -q.degree[v], v)]
    return None


#: Orders of HOUSE that no count of the data decides, worked out by hand.
_BY_HAND = {"ri": [1, 3, 2, 0, 4], "spectrum": [0, 1, 2, 3, 4]}


def order_sql(name: str, q: QueryGraph) -> str | None:
    if name in _BY_HAND:
        return "select cast(pos as integer) as pos, u from (values " + ", ".join(map(str, enumerate(_BY_HAND[name]))) + ") t(pos, u)"
    found = [(o, k) for o in permutations(range(len(q))) if all(any(w in o[:i] for w in q.adjacent[u]) for i, u in enumerate(o) if i) and (k := _keys(name, q, o))]
    if not found:
        return None
    fits = lambda t, u: f"{t}.label = {q.labels[u]} and {t}.degree >= {q.degree[u]}"
    counts = [f"(select count(*) from g where {fits('g', u)}) as c{u}, (select count(*) from g where label = {q.labels[u]}) as l{u}, (select count(*) from g where degree >= {q.degree[u]}) / (select count(*) from g) as t{u}" for u in range(len(q))]
    counts += [f"(select count(*) from e join g x on x.id = src join g y on y.id = dst where {fits('x', u)} and {fits('y', w)}) as e{u}_{w}" for u, w in sorted(q.edges)]
    rows = " union all ".join(f"select {list(o)} as o, [{', '.join(f'cast({x} as double)' for x in k)}] as k from s" for o, k in found)
    return f"{graph_sql()}, s as materialized (select (select count(*) from g) as nv, {', '.join(counts)}), best as (select o from ({rows}) order by k limit 1) select cast(unnest(range(len(o))) as integer) as pos, unnest(o) as u from best"


# ---- parts near each other in orders

_NEAR_PARTS = f"""with one as (select distinct least(x.l_partkey, y.l_partkey) as a, greatest(x.l_partkey, y.l_partkey) as b from lineitem x join lineitem y
on x.l_orderkey = y.l_orderkey and y.l_linenumber - x.l_linenumber between 1 and {T.APART} where x.l_partkey <> y.l_partkey),
three as (select x.a, x.b, y.b as c from one x join one y on x.b = y.a join one z on z.a = x.a and z.b = y.b)"""
_FOUR = "select {} from three x join one y on y.a = x.c join one p on p.a = x.a and p.b = y.b join one q on q.a = x.b and q.b = y.b"


# ---- the queries


def _coarse(kinds: list[str] | None = None):
    return lambda spark, sf: T.graph(spark, sf, coarse=True, kinds=kinds)


def _register() -> None:
    every, square, tri = _coarse(), _coarse(_SQUARE_KINDS), _coarse(_TRIANGLE_KINDS)
    fine = lambda spark, sf: T.graph(spark, sf)

    # graph
    _add("graph_metadata", lambda s, d: fine(s, d).metadata(), f"""{graph_sql(coarse=False)} select (select count(*) from v) as n_vertices, (select count(*) from one) as n_edges,
greatest((select count(distinct label) from v), (select max(label) + 1 from v)) as n_labels, cast((select max(degree) from g) as bigint) as max_degree,
(select max(n) from (select count(*) as n from v group by label)) as max_label_frequency""")
    _add("graph_degree", lambda s, d: stats.degrees(every(s, d)), f"{graph_sql()} select id, cast(degree as bigint) as degree from g")
    _add("graph_label_freq", lambda s, d: stats.label_frequency(fine(s, d)), f"{graph_sql(coarse=False)} select label, count(*) as n from v group by label")
    _add("graph_label_pairs", lambda s, d: stats.label_pairs(fine(s, d)), f"{graph_sql(coarse=False)} select sl as src_label, dl as dst_label, count(*) as n from e group by 1, 2")
    _add("graph_label_pair_scan", lambda s, d: every(s, d).between(O, C), f"{graph_sql()} select src, dst from e where sl = {O} and dl = {C}")
    _add("graph_nlf", lambda s, d: stats.neighbour_labels(every(s, d)), f"{graph_sql()} select src as id, dl as label, el as elabel, count(*) as n from e group by 1, 2, 3")
    _add("graph_degree_tail", lambda s, d: stats.degree_tail(every(s, d)), f"{graph_sql()} select cast(x.degree as bigint) as degree, x.n, (select sum(y.n) from (select degree, count(*) as n from g group by 1) y where y.degree >= x.degree) / (select count(*) from g) as p from (select degree, count(*) as n from g group by 1) x")
    _add("graph_triangles", lambda s, d: stats.triangles(every(s, d)), f"{graph_sql()} select x.src as a, x.dst as b, y.dst as c from e x join e y on x.dst = y.src join e z on z.src = x.src and z.dst = y.dst where x.src < x.dst and y.src < y.dst")
    _add("graph_four_cliques", lambda s, d: stats.four_cliques(T.near_parts(s, d)), f"{_NEAR_PARTS} {_FOUR.format('x.a, x.b, x.c, y.b as d')}")
    # every kind of edge, peeled until nothing is left: k goes up when no vertex is below it
    whole = f"""{graph_sql().replace("with v as", "with recursive v as", 1)}, peel(k, id) as (select 1, id from v union all
select k + cast(least_d >= k as integer), id from (select k, id, d, min(d) over () as least_d from (select p.k, p.id, count(q.id) as d from peel p left join e on e.src = p.id left join peel q on q.id = e.dst group by 1, 2))
where least_d >= k or d >= k) select id, cast(max(k) - 1 as bigint) as core from peel group by id"""
    _add("graph_kcore", lambda s, d: stats.core_numbers(every(s, d)), whole)
    _add("graph_unlabel", lambda s, d: every(s, d).unlabelled().vertices.groupBy("label").agg(F.count("*").alias("n"), F.max("degree").alias("max_degree")), f"{graph_sql()} select 0 as label, count(*) as n, max(degree) as max_degree from g")
    _add("graph_reify_edge_labels", lambda s, d: transform.reify(every(s, d), 15, 10**12).metadata(), f"""{graph_sql()} select (select count(*) from v) + (select count(*) from one) as n_vertices, 2 * (select count(*) from one) as n_edges,
cast(15 + (select max(el) from one) + 1 as bigint) as n_labels, greatest(cast((select max(degree) from g) as bigint), 2) as max_degree, greatest((select max(n) from (select count(*) as n from v group by label)), (select max(n) from (select count(*) as n from one group by el))) as max_label_frequency""")

    # filters: the same root on both sides, since it depends on the data
    for name in filters.FILTERS:
        if name == "label":
            continue
        _add(f"filter_{name}", lambda s, d, n=name: filters.make(n, every(s, d), HOUSE, root=3).frame(), filter_sql(name, HOUSE, 3))
    _add("filter_nlf_fine", lambda s, d: filters.nlf(fine(s, d), FINE).frame(), filter_sql("nlf", FINE, 0, coarse=False))

    # index
    pairs = [(u, w) for a, b in sorted(TRIANGLE.edges) for u, w in ((a, b), (b, a))]
    index = " union all ".join(f"select {u} as u, {w} as u2, src as v, dst as v2 from e join g x on x.id = src join g y on y.id = dst where sl = {TRIANGLE.labels[u]} and dl = {TRIANGLE.labels[w]} and x.degree >= {TRIANGLE.degree[u]} and y.degree >= {TRIANGLE.degree[w]}" for u, w in pairs)
    made = lambda s, d: build(filters.ldf(tri(s, d), TRIANGLE))
    _add("index_build", lambda s, d: made(s, d).frame(), f"{graph_sql(kinds=_TRIANGLE_KINDS)} {index}")
    _add("index_cardinality", lambda s, d: made(s, d).cardinalities(), f"{graph_sql(kinds=_TRIANGLE_KINDS)}, i as ({index}), k as (select u, u2, v, count(*) as d from i group by 1, 2, 3) select u, u2, cast(sum(d) as bigint) as n_edges, max(d) as max_degree, cast(8 * (sum(d) + count(*)) as bigint) as n_bytes from k group by 1, 2")

    ends = f"{graph_sql(kinds=_TRIANGLE_KINDS)}, i as ({index}) select u, u2, {{}} from i"
    _add("index_projections", lambda s, d: made(s, d).projections(), f"{ends.format('v')} group by 1, 2, 3")
    distinct = lambda s, d: made(s, d).frame().groupBy("u", "u2").agg(F.count_distinct("v").alias("n"))
    _add("index_distinct_ends", distinct, f"{ends.format('count(distinct v) as n')} group by 1, 2")

    # orders: the order that the rule picks, as rows; the rules without SQL are run, and their counts held against it
    for name in ORDERS:
        ordered = lambda s, d, n=name: prepare(every(s, d), HOUSE, filter="ldf", order=n, engine="explore", store=Store(s, "order"))
        if sql := order_sql(name, HOUSE):
            _add(f"order_{name}", lambda s, d, p=ordered: s.createDataFrame(list(enumerate(p(s, d).order)), "pos int, u int"), sql)
        else:
            _add(f"order_{name}", lambda s, d, p=ordered: p(s, d).count(), match_sql(HOUSE, _COUNT))

    # engines, over a stored index
    for name in engines.ENGINES:
        made_plan = lambda s, d, n=name: prepare(every(s, d), HOUSE, filter="ldf", order=[3, 1, 2, 4, 0], engine=n, store=Store(s, "engine"))
        if name in engines.COUNTERS:
            _add(f"engine_{name}", lambda s, d, p=made_plan: p(s, d).count(), match_sql(HOUSE, _COUNT))
        else:
            _add(f"engine_{name}", lambda s, d, p=made_plan: p(s, d).embeddings(), match_sql(HOUSE, _all(HOUSE)))

    # the vf3 look-ahead over bound vertices needs a label twice
    looked = lambda s, d: prepare(_coarse(["order_customer", "order_part"])(s, d), STAR, filter="ldf", order=[0, 1, 2, 3], engine="vf3", store=Store(s, "engine"))
    _add("engine_vf3_star", lambda s, d: looked(s, d).count(), match_sql(STAR, _COUNT, kinds=["order_customer", "order_part"]))

    # execution trees
    indexed = lambda s, d: prepare(every(s, d), HOUSE, filter="ldf", order=[3, 1, 2, 4, 0], store=Store(s, "tree")).index
    _add("execution_tree", lambda s, d: HOUSE_TREE.embeddings(indexed(s, d)), match_sql(HOUSE, _all(HOUSE)))
    reported = lambda s, d: s.createDataFrame([r[:3] for r in HOUSE_TREE.execute(indexed(s, d), Store(s, "tree"))[1]], "node int, kind string, n long")
    parts = [(QueryGraph.of([S, N, C, O], [(0, 1), (1, 2), (2, 3), (3, 0)]), "multiway"), (QueryGraph.of([S, P, O], [(0, 1), (1, 2), (0, 2)]), "multiway"), (HOUSE, "pairwise")]
    enough = {S: 3, N: 2, C: 2, O: 3, P: 2}  # degrees in the house
    nodes = []
    for k, (q, kind) in enumerate(parts):
        large = " and ".join(f"v{u}.id in (select id from g where degree >= {enough[x]})" for u, x in enumerate(q.labels))
        nodes.append(f"select cast({k} as integer) as node, '{kind}' as kind, n_embeddings as n from ({match_sql(q, _COUNT)} and {large})")
    _add("execution_tree_report", reported, " union all ".join(nodes))

    # semantics
    less = symmetry.constraints(PART_SQUARE)
    run = lambda g, q, order, engine="explore", **more: prepare(g, q, filter="label", order=order, engine=engine, **more)
    part = _coarse(["order_part"])
    _add("match_square", lambda s, d: run(square(s, d), SQUARE, [0, 3, 2, 1]).embeddings(), match_sql(SQUARE, _all(SQUARE), kinds=_SQUARE_KINDS))
    _add("match_triangle", lambda s, d: run(tri(s, d), TRIANGLE, [0, 1, 2]).count(), match_sql(TRIANGLE, _COUNT, kinds=_TRIANGLE_KINDS))
    _add("match_path", lambda s, d: run(square(s, d), PATH, [0, 1, 2, 3]).count(), match_sql(PATH, _COUNT, kinds=_SQUARE_KINDS))
    _add("match_star", lambda s, d: run(_coarse(["order_customer", "order_part"])(s, d), STAR, [0, 1, 2, 3], "kss").count(), match_sql(STAR, _COUNT, kinds=["order_customer", "order_part"]))
    # two orders that share two parts: pairs of edges by order first, so that no join meets all orders of a part
    shared = f"{graph_sql(kinds=['order_part'])}, w as (select x.dst as p, x.src as o, y.dst as q from e x join e y on x.src = y.src and x.dst <> y.dst where x.sl = {O}) select x.p as u0, x.o as u1, x.q as u2, y.o as u3 from w x join w y on x.p = y.p and x.q = y.q and x.o <> y.o"
    bound = " and ".join(f"u{a} < u{b}" for a, b in less)
    _add("match_symmetry", lambda s, d: run(part(s, d), PART_SQUARE, [0, 1, 2, 3], symmetry_breaking=True).embeddings(), f"select * from ({shared}) where {bound}")
    _add("match_symmetry_full", lambda s, d: run(part(s, d), PART_SQUARE, [0, 1, 2, 3]).count(), match_sql(PART_SQUARE, _COUNT, kinds=["order_part"]))
    _add("match_edge_label", lambda s, d: run(every(s, d), LABELLED, [0, 3, 2, 1]).count(), match_sql(LABELLED, _COUNT))
    _add("match_fine_labels", lambda s, d: prepare(fine(s, d), FINE, order=[1, 2, 3, 0], engine="lftj").embeddings(), match_sql(FINE, _all(FINE), coarse=False))
    _add("match_clique4", lambda s, d: run(T.near_parts(s, d), CLIQUE, [0, 1, 2, 3], symmetry_breaking=True).count(), f"{_NEAR_PARTS} {_FOUR.format('count(*) as n_embeddings')}")
    spectra = lambda s, d: s.createDataFrame([(k, n) for k, (_, n, _) in enumerate(spectrum(tri(s, d), TRIANGLE, orders_most=4, filter="ldf"))], "k int, n_embeddings long")
    _add("match_spectrum", spectra, f"select cast(k as integer) as k, n_embeddings from range(4) t(k), ({match_sql(TRIANGLE, _COUNT, kinds=_TRIANGLE_KINDS)})")
    _add("match_limit", lambda s, d: run(square(s, d), SQUARE, [0, 3, 2, 1]).limited(100).agg(F.count("*").alias("n_embeddings")), f"select cast(least(100, n_embeddings) as bigint) as n_embeddings from ({match_sql(SQUARE, _COUNT, kinds=_SQUARE_KINDS)})")
    _add("match_distribution", lambda s, d: run(square(s, d), SQUARE, [0, 3, 2, 1]).distribution(), f"select x as v, count(*) as n from (select unnest([u0, u1, u2, u3]) as x from ({match_sql(SQUARE, _all(SQUARE), kinds=_SQUARE_KINDS)})) group by 1")
    reified = SQUARE_REIFIED
    _add("match_reified", lambda s, d: run(transform.reify(square(s, d), 15, 10**12), reified, "ri").count(), match_sql(LABELLED, _COUNT, kinds=_SQUARE_KINDS))


SQUARE_REIFIED = LABELLED.reified(15)
_register()
