from dataclasses import replace

import pytest

from sparkmatch.model import DataGraph, QueryGraph
from sparkmatch.operators import engines, filters
from sparkmatch.operators.steps import steps
from sparkmatch.plans import symmetry
from sparkmatch.plans.order import ORDERS, make
from sparkmatch.session import Plan, match, prepare, spectrum
from sparkmatch.store import Store
from tests.core.brute import automorphisms, data_graph, embeddings, random_case

CASES = [(5, 0), (5, 3)]


@pytest.fixture(scope="module")
def cases(spark):
    out = []
    for seed, edge_labels in CASES:
        labels, edges, query = random_case(seed, edge_labels=edge_labels, p=0.45 if not edge_labels else 0.7)
        g = data_graph(spark, labels, edges)
        g = DataGraph(g.vertices.coalesce(1).cache(), g.edges.coalesce(1).cache())
        out.append((g, query, embeddings(labels, edges, query)))
    assert all(len(w) > 0 for *_, w in out)
    return out


@pytest.mark.parametrize("name", list(filters.FILTERS))
def test_filters_are_complete_and_shrink(spark, cases, name):
    for g, query, want in cases:
        c = filters.make(name, g, query, Store(spark, "t"))
        got = {u: set() for u in c.of}
        for r in c.frame().collect():
            got[r.u].add(r.v)
        for u in range(len(query)):
            assert {e[u] for e in want} <= got[u]
        ldf = {(r.u, r.v) for r in filters.ldf(g, query).frame().collect()}
        assert name == "label" or {(u, v) for u, vs in got.items() for v in vs} <= ldf


def test_steady_state_is_within_the_other_filters(spark, cases):
    g, query, _ = cases[0]
    store = Store(spark, "t")
    steady = filters.steady(g, query, store)
    small = {(r.u, r.v) for r in steady.frame().collect()}
    for name in ("nlf", "cfl"):
        c = filters.make(name, g, query, store)
        assert small <= {(r.u, r.v) for r in c.frame().collect()}
        assert 0 <= filters.false_positive_ratio(c, steady) <= 1


def test_matching_by_hall_and_by_paths_agree(spark, cases, monkeypatch):
    for g, query, _ in cases[:1]:
        want = {(r.u, r.v) for r in filters.gql(g, query, Store(spark, "t"), sweeps=1).frame().collect()}
        monkeypatch.setattr(filters, "HALL_SETS", 0)
        assert {(r.u, r.v) for r in filters.gql(g, query, Store(spark, "t"), sweeps=1).frame().collect()} == want
        monkeypatch.undo()


@pytest.fixture(scope="module")
def prepared(spark, cases):
    return [(prepare(g, query, order="ri", store=Store(spark, "t")), want) for g, query, want in cases]


@pytest.mark.parametrize("name", list(engines.ENGINES))
def test_engines_find_what_brute_force_finds(prepared, name):
    for k, (plan, want) in enumerate(prepared):
        for broken in (False, True):
            less = symmetry.constraints(plan.index.candidates.query) if broken else []
            want = [e for e in want if all(e[a] < e[b] for a, b in less)]
            mine = replace(plan, engine=name, constraints=less)
            if name in engines.ENUMERATORS:
                assert sorted(tuple(r) for r in mine.embeddings().collect()) == want
            else:
                assert mine.count().first()[0] == len(want)
            if k and not less:
                break


def test_orders_do_not_change_the_count(prepared):
    plan, want = prepared[0]
    stats = plan.index.stats(paths=True)
    for order in {tuple(make(name, plan.index.candidates.query, stats)) for name in ORDERS}:
        assert replace(plan, order=list(order)).count().first()[0] == len(want)


def test_larger_queries_with_equal_labels(spark):
    for seed, k in ((11, 5), (12, 6)):
        labels, edges, query = random_case(seed, n=11, p=0.4, n_labels=1, k=k)
        g, want = data_graph(spark, labels, edges), embeddings(labels, edges, query)
        plan = prepare(g, query, filter="ldf", order="ri", store=Store(spark, "t"))
        for name in ("kss", "veq", "dpiso"):
            assert replace(plan, engine=name).count().first()[0] == len(want)
        n = replace(plan, engine="kss", constraints=symmetry.constraints(query)).count().first()[0]
        assert n * len(automorphisms(query)) == len(want)
        assert symmetry.automorphism_count(query) == len(automorphisms(query))


def test_veq_forgets_images_merges_classes_and_places_twins(spark):
    from sparkmatch.model import QueryGraph

    queries = [
        QueryGraph.of([0, 1, 1, 1, 0], [(0, 1), (0, 2), (0, 3), (3, 4)]),  # two leaves and a path beside them, one label
        QueryGraph.of([0, 0, 1, 1, 1], [(0, 2), (0, 3), (1, 2), (1, 3), (0, 4), (1, 4)]),  # three twins that are no leaves
        QueryGraph.of([0, 1, 0, 1, 0, 1], [(0, 1), (1, 2), (2, 3), (3, 4), (4, 5)]),  # a path of two labels
    ]
    labels, edges, _ = random_case(8, n=14, p=0.45)
    g = data_graph(spark, labels, edges)
    for query in queries:
        want = embeddings(labels, edges, query)
        plan = prepare(g, query, filter="ldf", order="ri", engine="veq", store=Store(spark, "t"))
        for order in {tuple(plan.order), tuple(make("gql", query, plan.index.stats()))}:
            assert want and replace(plan, order=list(order)).count().first()[0] == len(want)
        less = symmetry.constraints(query)
        assert replace(plan, constraints=less).count().first()[0] == sum(all(e[a] < e[b] for a, b in less) for e in want)
    plan = prepare(g, queries[1], filter="ldf", order=[0, 2, 1, 3, 4], store=Store(spark, "t"))
    assert engines.twins_at_once(plan.index, plan.steps) == ([0, 2, 1, 3, 4], {})  # the first of them comes too early
    plan = prepare(g, queries[0], filter="ldf", order=[0, 3, 4, 1, 2], store=Store(spark, "t"))
    assert engines.twins_at_once(plan.index, plan.steps) == ([0, 3, 4, 1], {4: 1, 1: 2})


def test_dpiso_searches_large_regions_in_pieces(prepared, monkeypatch):
    for most in (0, 3, 12):
        monkeypatch.setattr(engines, "LOCAL_EDGES", most)
        for plan, want in prepared:
            assert sorted(tuple(r) for r in replace(plan, engine="dpiso").embeddings().collect()) == want


def test_hub_of_many_leaves(spark):
    from sparkmatch.model import QueryGraph
    from sparkmatch.sources.transform import star

    n = 100_000
    g = star(spark, n)
    two = QueryGraph.of([1, 0, 1], [(0, 1), (1, 2)])
    plan = prepare(g, two, filter="ldf", order=[1, 0, 2], symmetry_breaking=False)
    for engine in ("kss", "veq"):
        assert replace(plan, engine=engine).count().first()[0] == n * (n - 1)
    one = prepare(g, QueryGraph.of([1, 0], [(0, 1)]), filter="nlf", order=[1, 0])
    for engine in ("lftj", "ceci", "rm"):
        assert replace(one, engine=engine).count().first()[0] == n
    assert replace(one, engine="kss").count_up_to(7) == 7 and one.limited(7).count() == 7
    one.close()


def test_plans_stay_small(spark, sf):
    from sparkmatch import catalog
    from sparkmatch.sources import tables

    fine, coarse = tables.graph(spark, sf), tables.graph(spark, sf, coarse=True)
    for g, query, order in ((fine, catalog.FINE, [1, 2, 3, 0]), (coarse, catalog.HOUSE, [3, 1, 2, 4, 0])):
        plan = prepare(g, query, order=order)
        for engine in ("lftj", "explore", "rm", "ceci"):
            text = replace(plan, engine=engine).embeddings()._jdf.queryExecution().optimizedPlan().toString()
            assert text.count("Join") < 25 and text.count("Relation") < 40
            executed = replace(plan, engine=engine).embeddings()._jdf.queryExecution().executedPlan().toString()
            assert executed.count("Exchange") < 50
        plan.close()


def test_limits_run_the_engine_asked_for(spark, cases, monkeypatch):
    g, query, want = cases[0]
    ran = []
    monkeypatch.setitem(engines.ENUMERATORS, "explore", lambda i, p: ran.append("explore") or engines.explore(i, p))
    monkeypatch.setitem(engines.ENUMERATORS, "lftj", lambda i, p: ran.append("lftj") or engines.lftj(i, p))
    monkeypatch.setitem(engines.COUNTERS, "kss", lambda i, p: ran.append("kss") or engines.kss(i, p))
    for engine in ("explore", "kss"):
        report = match(g, query, engine=engine, limit=2)
        assert report.embeddings == min(2, len(want)) and set(ran) == {engine} and report.engine == engine
        ran.clear()


def test_limit_distribution_levels_and_report(spark, cases, tmp_path):
    g, query, want = cases[0]
    plan = prepare(g, query, order="ri", store=Store(spark, "t"))
    assert plan.limited(3).count() == min(3, len(want)) and plan.limited(10**6).count() == len(want)
    seen = {}
    for e in want:
        for v in e:
            seen[v] = seen.get(v, 0) + 1
    assert {r.v: r.n for r in plan.distribution().collect()} == seen
    levels = {r.level: r.n for r in plan.level_counts().collect()}
    assert levels[len(query)] == len(want)
    report = match(g, query, limit=2, count_calls=True)
    assert report.embeddings == min(2, len(want)) and "embeddings: " in report.lines()
    report.append_csv(spark, f"file://{tmp_path}/runs")
    assert spark.read.csv(f"file://{tmp_path}/runs", header=True).count() == 1
    assert plan.order_from_json(plan.to_json()) == plan.order
    again = Plan.from_json(plan.to_json(), g, query)
    assert again.order == plan.order and again.constraints == plan.constraints and again.count().first()[0] == len(want)
    assert report.memory_mb > 0


def test_spectrum(cases):
    g, query, want = cases[0]
    got = spectrum(g, query, orders_most=2)
    assert [n for _, n, _ in got] == [len(want)] * len(got) and len(got) == 2


def test_single_vertex_and_empty_results(spark, cases):
    from sparkmatch.model import QueryGraph

    g = cases[0][0]
    one = QueryGraph.of([1], [])
    for name in engines.ENGINES:
        assert prepare(g, one, order=[0], engine=name).count().first()[0] == g.vertices.where("label = 1").count()
    none = QueryGraph.of([0, 77, 0], [(0, 1), (1, 2)])
    plan = prepare(g, none, order="ri", store=Store(spark, "t"))
    for name in engines.ENGINES:
        assert replace(plan, engine=name).count().first()[0] == 0
    for name in ("gql", "veq", "steady"):
        filters.make(name, g, none, Store(spark, "t")).frame().count()


def test_unknown_names_and_disconnected_queries(cases):
    from sparkmatch.model import QueryGraph

    g, query, _ = cases[0]
    for bad in ({"filter": "x"}, {"order": "x"}, {"engine": "x"}, {"order": [0, 0, 1, 2]}):
        with pytest.raises(ValueError):
            prepare(g, query, **bad)
    with pytest.raises(ValueError):
        QueryGraph.of([0, 0, 0], [(0, 1)])


def test_steps_need_no_check_between_different_labels():
    from sparkmatch.model import QueryGraph

    plan = steps(QueryGraph.of([0, 1, 0], [(0, 1), (1, 2)]), [0, 1, 2], [])
    assert plan[2].differ == (0,) and plan[1].differ == ()


def test_label_filter_leaves_all_to_the_joins(cases):
    for g, query, want in cases:
        for name in ("explore", "lftj"):
            assert prepare(g, query, filter="label", order="ri", engine=name).count().first()[0] == len(want)


@pytest.fixture(scope="module")
def trade(spark):
    """Two nations (0) with 15 suppliers (1) and 30 customers (2) each, 60 orders (4) of two parts (3) and suppliers."""
    supplier, customer, part, order = (lambda i: 2 + i % 30), (lambda i: 32 + i % 60), (lambda i: 92 + i % 10), lambda i: 102 + i
    labels = [0] * 2 + [1] * 30 + [2] * 60 + [3] * 10 + [4] * 60
    edges = {(i % 2, supplier(i)): None for i in range(30)} | {(i % 2, customer(i)): None for i in range(60)}
    for i in range(60):
        edges[customer(7 * i), order(i)] = None
        for k in (11 * i, 13 * i + 5):
            edges |= {(supplier(k), order(i)): None, (part(k), order(i)): None, (supplier(k), part(k)): None}
    return data_graph(spark, labels, edges), labels, edges


def test_square_is_closed_over_the_shorter_lists(spark, trade):
    from sparkmatch.catalog import SQUARE

    g, labels, edges = trade
    plan = prepare(g, SQUARE, filter="label", order=[0, 3, 2, 1], engine="explore", store=Store(spark, "t"))
    bound = engines._economical_steps(plan.index, plan.steps)
    assert [s.u for s in bound] == plan.order and bound[-1].near == (2, 0)  # two suppliers of an order, 15 of a nation
    assert sorted(map(tuple, plan.embeddings().collect())) == embeddings(labels, edges, SQUARE) != []


@pytest.mark.parametrize("order", [[0, 4, 1, 3, 2], [0, 4, 1, 2, 3]])
def test_house_does_not_pair_suppliers_and_customers_of_a_nation(spark, trade, order):
    from sparkmatch.catalog import HOUSE

    g, labels, edges = trade
    plan = prepare(g, HOUSE, filter="label", order=order, engine="explore", store=Store(spark, "t"))
    bound = [s.u for s in engines._economical_steps(plan.index, plan.steps)]
    assert bound.index(3) < max(bound.index(1), bound.index(4))  # the order between them comes before the later one
    assert sorted(map(tuple, plan.embeddings().collect())) == embeddings(labels, edges, HOUSE) != []


def test_stored_tables_leave_no_shuffle_files(spark):
    import time

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        names = set()
        while found.hasNext():
            names.add(found.next().getName())
        return {x for x in names if x.startswith("shuffle_") and x.endswith(".data")}

    before = files()
    out = Store(spark, "t").put(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count())
    for _ in range(20):  # they are deleted a little later
        if files() <= before:
            break
        time.sleep(0.2)
    assert files() <= before and out.count() == 7


def test_distribution_counts_over_the_shorter_lists(spark, trade):
    from collections import Counter

    from sparkmatch.catalog import SQUARE

    g, labels, edges = trade
    plan = prepare(g, SQUARE, filter="label", order=[0, 3, 2, 1], engine="explore", store=Store(spark, "t"))
    assert {r.v: r.n for r in plan.distribution().collect()} == Counter(v for e in embeddings(labels, edges, SQUARE) for v in e)
    assert engines._economical_steps(plan.index, plan.steps)[-1].near[0] == 2


def test_labelled_and_reified_squares_do_not_pair_within_a_nation(spark, trade):
    from sparkmatch.catalog import LABELLED, SQUARE_REIFIED
    from sparkmatch.sources import transform

    _, labels, edges = trade
    kinds = {(0, 1): 0, (0, 2): 1, (2, 4): 2, (3, 4): 3, (1, 4): 4, (1, 3): 5}
    edges = {(a, b): kinds[labels[a], labels[b]] for a, b in edges}
    g, n = data_graph(spark, labels, edges), len(embeddings(labels, edges, LABELLED))
    plan = prepare(g, LABELLED, filter="label", order=[0, 3, 2, 1], engine="explore", store=Store(spark, "t"))
    assert engines._economical_steps(plan.index, plan.steps)[-1].near[0] == 2 and plan.count().first()[0] == n
    plan = prepare(transform.reify(g, 15, 10**12), SQUARE_REIFIED, filter="label", order="ri", engine="explore", store=Store(spark, "t"))
    bound = [s.u for s in engines._economical_steps(plan.index, plan.steps)]
    assert bound.index(2) < max(bound.index(1), bound.index(3)) and plan.order.index(2) > max(plan.order.index(1), plan.order.index(3)) and plan.count().first()[0] == n


@pytest.mark.parametrize("edges", [[(0, 1), (1, 2), (2, 3), (3, 0)], [(0, 1), (1, 2), (2, 3), (3, 0), (0, 4), (2, 4)]])
def test_twins_are_counted_without_enumerating_them(spark, edges, monkeypatch):
    labels = [3] * 6 + [4] * 40
    q = QueryGraph.of([3, 4, 3, 4, 4][: max(map(max, edges)) + 1], edges)
    data = {(p, o): None for o in range(6, 46) for p in {o % 6, o * o % 5, o // 7 % 6}}
    g, want = data_graph(spark, labels, data), len(embeddings(labels, data, q))
    plan = prepare(g, q, filter="label", order=list(range(len(q))), engine="explore", store=Store(spark, "t"))
    assert want and plan.embeddings().count() == want
    monkeypatch.setitem(engines.ENUMERATORS, "explore", None)  # no embedding is made
    monkeypatch.setattr(engines, "explore", None)
    assert plan.count().first()[0] == want


@pytest.mark.parametrize("at_once", [0, 1 << 60])
def test_a_prepared_plan_reads_each_table_once_and_keeps_no_edges_beside_the_index(spark, sf, monkeypatch, at_once):
    import os

    from sparkmatch import store as stores
    from sparkmatch.catalog import HOUSE
    from sparkmatch.sources import tables

    monkeypatch.setattr(stores, "AT_ONCE", at_once)
    scans, put = [], Store.put
    monkeypatch.setattr(Store, "put", lambda self, df, by=(): scans.append(stores.n_scans(df)) or put(self, df, by))
    g, store = tables.graph(spark, sf, coarse=True), Store(spark, "t")
    plan = prepare(g, HOUSE, filter="ldf", order=[3, 1, 2, 4, 0], engine="explore", store=store)
    assert sum(scans[: 6 if at_once == 0 else 1]) == 6  # one for each kind of edge, not one for each direction
    assert not os.path.exists(f"{store.base.removeprefix('file://')}/edges")
    assert {r.id: r.degree for r in plan.index.candidates.graph.vertices.collect()} == {r.id: r.degree for r in g.vertices.collect()}
    want = prepare(g, HOUSE, filter="label", order=[3, 1, 2, 4, 0]).count().first()[0]
    assert want and plan.count().first()[0] == replace(plan, engine="vf3").count().first()[0] == want


def test_second_multiway_node_extends_over_the_edges_of_the_first(spark, trade, monkeypatch):
    from sparkmatch.catalog import HOUSE, HOUSE_TREE

    g, labels, edges = trade
    plan, sizes, multiway = prepare(g, HOUSE, filter="label", order=[3, 1, 2, 4, 0], store=Store(spark, "t")), [], engines.multiway
    monkeypatch.setattr(engines, "written", lambda index, order: len(set(order) & {2}))  # the triangle makes more rows
    monkeypatch.setattr(engines, "multiway", lambda index, steps: sizes.append(index.sizes()[1][1, 3]) or multiway(index, steps))
    found = sorted(map(tuple, HOUSE_TREE.embeddings(plan.index).collect()))
    assert found == embeddings(labels, edges, HOUSE) != []
    assert sizes[-1] == len({(e[1], e[3]) for e in embeddings(labels, edges, QueryGraph.of([0, 1, 2, 4], [(0, 1), (1, 3), (3, 2), (2, 0)]))}) < sizes[0]


@pytest.mark.parametrize("order", ["rm", "tso"])
def test_named_orders_search_without_stored_edges(spark, sf, order):
    import os

    from sparkmatch.catalog import HOUSE
    from sparkmatch.sources import tables

    store = Store(spark, "t")
    plan = prepare(tables.graph(spark, sf, coarse=True), HOUSE, filter="ldf", order=order, engine="explore", store=store)
    assert not os.path.exists(f"{store.base.removeprefix('file://')}/edges") and plan.order_name == order and plan.count().first()[0] > 0


def test_a_large_index_is_searched_in_stages_and_its_edges_go_pair_by_pair(spark, sf, monkeypatch):
    from sparkmatch import store as stores
    from sparkmatch.catalog import HOUSE
    from sparkmatch.sources import tables

    g = tables.graph(spark, sf, coarse=True)
    want = prepare(g, HOUSE, filter="label", order=[3, 1, 2, 4, 0]).count().first()[0]
    monkeypatch.setattr(stores, "AT_ONCE", 0)
    put, drop, log = Store.put, Store.drop, []
    monkeypatch.setattr(Store, "put", lambda self, df, by=(): log.append(("put", df.columns)) or put(self, df, by))
    monkeypatch.setattr(Store, "drop", lambda self, df: log.append(("drop", df.columns)) or drop(self, df))
    plan = prepare(g, HOUSE, filter="ldf", order="rm", engine="explore", store=Store(spark, "t"))
    assert [x for x, c in log if c[:2] == ["src", "dst"]] == ["put"] * 6 + ["put", "drop"] * 6
    assert [c for x, c in log if "n" in c] == [["src", "n"]] * 6  # degrees, from one pair of labels at a time
    assert {r.id: r.degree for r in plan.index.candidates.graph.vertices.collect()} == {r.id: r.degree for r in g.vertices.collect()}
    log.clear()
    monkeypatch.setattr(engines, "narrows", lambda index, order: 4)
    monkeypatch.setattr(engines, "SLICE", 64)
    assert want and plan.count().first()[0] == want
    assert len(log) > 1 and all(x == "put" and len(c) == 4 for x, c in log)  # slices of the root, before the last vertex


def test_stages_follow_what_a_step_leaves():
    from types import SimpleNamespace

    from sparkmatch.catalog import HOUSE

    n = {0: 25, 1: 60_000, 2: 1_200_000, 3: 9_000_000, 4: 900_000}
    edges = {(0, 1): 60_000, (1, 2): 36_000_000, (2, 3): 36_000_000, (3, 4): 9_000_000, (0, 4): 900_000, (1, 3): 36_000_000}
    index = SimpleNamespace(candidates=SimpleNamespace(query=HOUSE), sizes=lambda: (n, edges))
    assert engines.narrows(index, [1, 3, 4, 0, 2]) == 4  # one in 25 of 36 million rows is left
    assert engines.narrows(index, [3, 1, 2, 4, 0]) == 3  # few parts of an order are its supplier's; the last step needs no stage
    assert engines.narrows(index, [4, 3, 1]) == 0
