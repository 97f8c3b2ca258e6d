import pytest

from sparkmatch.model import QueryGraph
from sparkmatch.operators.tree import ExecutionTree, Node, core_first, left_deep, multiway
from sparkmatch.plans import symmetry
from sparkmatch.session import prepare
from sparkmatch.store import Store
from tests.core.brute import data_graph, embeddings, random_case


@pytest.fixture(scope="module")
def made(spark):
    labels, edges, query = random_case(11, n=11, p=0.4, n_labels=1, k=5)
    g = data_graph(spark, labels, edges)
    return prepare(g, query, filter="ldf", order="ri", store=Store(spark, "t")), embeddings(labels, edges, query)


def test_trees_find_what_brute_force_finds(spark, made):
    plan, want = made
    query = plan.index.candidates.query
    less = symmetry.constraints(query)
    broken = [e for e in want if all(e[a] < e[b] for a, b in less)]
    for make in (multiway, left_deep, core_first):
        tree = make(query, plan.order)
        assert ExecutionTree.from_json(tree.to_json(), query) == tree
        assert sorted(map(tuple, tree.embeddings(plan.index).collect())) == want
        out, report = tree.execute(plan.index, Store(spark, "t"), less)
        assert sorted(map(tuple, out.collect())) == broken and len(report) == len(tree.nodes) and report[-1][2] == len(broken)


def test_bushy_tree_over_two_cycles(spark):
    query = QueryGraph.of([0, 1, 0, 1, 0], [(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (1, 4)])
    labels, edges, _ = random_case(2, n=16, p=0.5)
    want = embeddings(labels, edges, query)
    index = prepare(data_graph(spark, labels, edges), query, filter="nlf", order=[1, 0, 3, 2, 4], store=Store(spark, "t")).index
    tree = ExecutionTree(query, (Node("multiway", (1, 0, 3)), Node("multiway", (3, 4, 1)), Node("pairwise", (0, 1, 3, 4), (0, 1)), Node("scan", (1, 2)), Node("pairwise", (0, 1, 2, 3, 4), (2, 3))))
    assert want and sorted(map(tuple, tree.embeddings(index).collect())) == want


def test_bad_trees():
    query = QueryGraph.of([0, 0, 0], [(0, 1), (1, 2)])
    for nodes in (
        [Node("scan", (0, 2))], [Node("scan", (0, 1))], [Node("multiway", (0, 2, 1))], [Node("x", (0, 1, 2))], [Node("multiway", ())],
        [Node("scan", (0, 1)), Node("scan", (1, 2))], [Node("scan", (0, 1)), Node("pairwise", (0, 1, 2), (0, 1)), Node("scan", (1, 2))],
    ):
        with pytest.raises(ValueError):
            ExecutionTree(query, tuple(nodes))
    assert left_deep(QueryGraph.of([0], []), [0]).nodes == (Node("multiway", (0,)),)
    two = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 6), (6, 4)]  # two triangles and a path between them
    assert core_first(QueryGraph.of([0] * 7, two), [0, 1, 2, 3, 4, 5, 6]).nodes[-1].vertices


def test_look_ahead_leaves_results_and_prunes(spark):
    for seed in (2, 4, 9):
        labels, edges, query = random_case(seed, n=12, p=0.5, n_labels=1, k=5, edge_labels=0 if seed % 2 else 2)
        plan = prepare(data_graph(spark, labels, edges), query, filter="ldf", order="ri", engine="vf3", store=Store(spark, "t"))
        assert sorted(map(tuple, plan.embeddings().collect())) == embeddings(labels, edges, query)
        text = plan.embeddings()._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftOuter" in text  # images of other bound vertices are looked up
    square = QueryGraph.of([0] * 4, [(0, 1), (1, 2), (2, 3), (3, 0)])
    g = data_graph(spark, [0] * 4, {(0, 1): None, (1, 2): None, (0, 2): None, (2, 3): None})
    assert prepare(g, square, filter="label", order=[0, 1, 2, 3], engine="vf3", store=Store(spark, "t")).count().first()[0] == 0
    apart = QueryGraph.of([0, 1, 2], [(0, 1), (1, 2), (2, 0)])
    plan = prepare(g, apart, filter="label", order=[0, 1, 2], engine="vf3", store=Store(spark, "t"))
    assert "LeftOuter" not in plan.embeddings()._jdf.queryExecution().optimizedPlan().toString()


def test_projections(made):
    index = made[0].index
    for u, w in index.candidates.query.edges:
        ends = [r.v for r in index.projection(u, w).collect()]
        assert ends == sorted({r.src for r in index.edges(u, w).collect()})
    got = {(r.u, r.u2, r.v) for r in index.projections().collect()}
    assert got == {(r.u, r.u2, r.v) for r in index.frame().collect()} and len(got) == index.projections().count()


def test_nodes_run_in_slices(spark, made, monkeypatch):
    from sparkmatch.operators import engines

    plan, want = made
    monkeypatch.setattr(engines, "SLICE", 10**6)
    monkeypatch.setattr(engines, "MOST_SLICES", 3)
    tree = multiway(plan.index.candidates.query, plan.order)
    assert len(engines.slices(plan.index, plan.order)) == 3
    out, report = tree.execute(plan.index, Store(spark, "t"))
    assert sorted(map(tuple, out.collect())) == want and report[0][2] == len(want)
