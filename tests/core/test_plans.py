import pytest

from sparkmatch.model import QueryGraph
from sparkmatch.plans import nucleus, symmetry
from sparkmatch.plans import order as O
from sparkmatch.plans.tree import breadth_first
from sparkmatch.sources.text import parse_query
from tests.core.brute import automorphisms, embeddings, random_case


def ring(n):
    return [(i, (i + 1) % n) for i in range(n)]


PETERSEN = ring(5) + [(i, i + 5) for i in range(5)] + [(5 + i, 5 + (i + 2) % 5) for i in range(5)]
TOYS = [
    ([0] * 4, [(a, b) for a in range(4) for b in range(a)], 24),
    ([0] * 4, ring(4), 8),
    ([0, 1, 0, 1], ring(4), 4),
    ([0] * 4, [*ring(4), (0, 2)], 4),
    ([0] * 5, ring(5), 10),
    ([0] * 5, [*ring(5), (0, 2)], 2),
    ([0] * 10, PETERSEN, 120),
]


@pytest.mark.parametrize(("labels", "edges", "size"), TOYS)
def test_automorphisms_of_toys(labels, edges, size):
    q = QueryGraph.of(labels, edges)
    assert symmetry.automorphism_count(q) == size
    less = symmetry.constraints(q)
    assert sum(all(e[a] < e[b] for a, b in less) for e in automorphisms(q)) == 1


def test_pentagons_of_the_petersen_graph():
    q = QueryGraph.of([0] * 5, ring(5))
    found = embeddings([0] * 10, {(min(e), max(e)): None for e in PETERSEN}, q)
    less = symmetry.constraints(q)
    assert len(found) == 120 and sum(all(e[a] < e[b] for a, b in less) for e in found) == 12


def test_edge_labels_break_symmetry():
    assert symmetry.automorphism_count(QueryGraph.of([0] * 3, [(0, 1, 1), (1, 2, 1), (0, 2, 2)])) == 2


@pytest.mark.parametrize("name", list(O.ORDERS))
def test_orders_are_connected_permutations(name):
    for seed in range(25):
        _, _, q = random_case(seed, k=3 + seed % 8)
        edges = {e: 1 + (e[0] * 7 + e[1]) % 5 for a, b in q.edges for e in ((a, b), (b, a))}
        order = O.make(name, q, O.Stats({u: 1 + u * 3 % 7 for u in range(len(q))}, edges, {0: 5, 1: 9}, 14))
        assert all(q.has_edge(u, w) for u, w in O.pivots(q, order).items())


def test_spectrum_lists_different_orders():
    q = QueryGraph.of([0] * 5, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)])
    got = O.spectrum(q, 100)
    assert len({tuple(o) for o in got}) == len(got) == 6
    assert len(O.spectrum(q, 2)) == 2
    for o in got:
        O.check(q, o)


def test_nuclei_of_two_cliques_and_a_tail():
    k4 = [(a, b) for a in range(4) for b in range(a)]
    q = QueryGraph.of([0] * 8, k4 + [(3, 4)] + [(a + 4, b + 4) for a, b in [(0, 1), (1, 2), (2, 0)]] + [(6, 7)])
    assert {n.vertices for n in nucleus.decompose(q, 2)} >= {frozenset({0, 1, 2, 3}), frozenset({4, 5, 6})}
    assert {n.vertices for n in nucleus.decompose(q, 3)} == {frozenset({0, 1, 2, 3})}
    forest = nucleus.hierarchy(q)
    assert all(forest[n.parent].vertices > n.vertices for n in forest if n.parent is not None)
    assert q.core == [3, 3, 3, 3, 2, 2, 2, 1]


def test_trees():
    q = QueryGraph.of([0] * 5, [(0, 1), (0, 2), (1, 2), (1, 3), (2, 4)])
    t = breadth_first(q, 0)
    assert t.order == (0, 1, 2, 3, 4) and t.level[4] == 2 and t.parent[3] == 1
    assert t.paths() == [[0, 1, 3], [0, 2, 4]] and t.before(2) == [0, 1] and t.deeper(1) == [3] and t.preorder() == [0, 1, 3, 2, 4]


def test_queries_from_text():
    q = parse_query("t 3 2\nv 0 5 1\nv 1 6 2\nv 2 5 1\ne 0 1 7\ne 1 2 8\n")
    assert q.labels == (5, 6, 5) and q.edge_label(2, 1) == 8 and q.reified(100).labels == (5, 6, 5, 107, 108)
    with pytest.raises(ValueError):
        QueryGraph.of([0, 0], [(0, 5)])
    with pytest.raises(ValueError):
        QueryGraph.of([0, 0, 0], [(0, 1, 1), (1, 2)])


def test_leaf_classes_and_options():
    from sparkmatch.cli import parser
    from sparkmatch.plans.tree import leaf_classes

    assert leaf_classes(QueryGraph.of([0, 1, 1, 2], [(0, 1), (0, 2), (0, 3)])) == [[1, 2], [3]]
    o = parser().parse_args(["-d", "g", "-q", "q", "-filter", "NLF", "-engine", "KSS", "-symmetry", "1"])
    assert (o.filter, o.order, o.engine, o.num, o.symmetry) == ("nlf", "gql", "kss", "MAX", 1)


def test_roots_from_hand_worked_counts():
    from sparkmatch.plans import tree as T

    q = QueryGraph.of([0, 1, 2, 3, 1], [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)])
    labels = {0: 40, 1: 20, 2: 30, 3: 4}
    # label count by degree: 20, 10, 10, 2, 20; the three least are 3, 1, 2, and 1 and 2 have too common labels but 2 is the last
    assert T.root_by_frequency(q, labels, {3: 9, 1: 1, 2: 8}, 100) == 2
    assert T.root_by_frequency(q, labels, {3: 7, 1: 1, 2: 8}, 100) == 3
    # in the triangle: 1 and 2 (10 each), then 0; by candidates over degree 3 / 2, 6 / 3, 8 / 2
    assert T.root_in_core(q, labels, {0: 8, 1: 3, 2: 6}) == 1
    assert T.root_by_ratio(q, {0: 8, 1: 6, 2: 12, 3: 7, 4: 2}) == 4 and T.root_by_ratio(q, {0: 8, 1: 6, 2: 12, 3: 5, 4: 2}, leaves=False) == 3


def test_path_orders_from_hand_worked_counts():
    # a square 0-1-2-3 with the leaf 4 at 2
    q = QueryGraph.of([0, 1, 0, 1, 2], [(0, 1), (1, 2), (2, 3), (3, 0), (2, 4)])
    cand = {0: 10, 1: 4, 2: 6, 3: 8, 4: 2}
    fan = {(0, 1): 2, (1, 2): 3, (0, 3): 1, (2, 4): 1, (2, 3): 1, (3, 2): 2}
    edges = {}
    for (u, w), k in fan.items():
        edges[u, w] = edges[w, u] = cand[u] * k
    edges[1, 2] = edges[2, 1] = 12
    stats = O.Stats(cand, edges, {0: 60, 1: 40, 2: 3}, 100)
    # labels by degree: 30, 20, 20, 20, 3; the least three are 4, 1, 2; the label of 4 alone is rare, 2 is the last: fewest candidates 4
    assert O.tso_tree(q, stats).order == (4, 2, 1, 3, 0)
    # paths 4-2-1-0 and 4-2-3: edges 4-2: 6, so 6 / 2 a candidate, times 12 / 6, times 20 / 4: 6 * 2 * 5 = 60 over one
    # non-tree edge (3-0) + 1: 30; the other 6 * edges[2, 3] / 6 = 16 over 2: 8, so it goes first
    assert edges[2, 3] == 16 and O.tso(q, stats) == [4, 2, 3, 1, 0]
    # the core has roots 1, 2, 3 (20 each); candidates by degree 2, 2, 4: root 1
    assert O.cfl_tree(q, stats).order[0] == 1 and O.cfl(q, stats)[-1] == 4


def test_an_order_that_writes_more_than_the_index_is_left():
    from types import SimpleNamespace

    from sparkmatch.catalog import HOUSE
    from sparkmatch.operators.engines import economical

    n = {0: 25, 1: 60_000, 2: 1_200_000, 3: 9_000_000, 4: 900_000}
    edges = {(0, 1): 60_000, (1, 2): 36_000_000, (2, 3): 36_000_000, (3, 4): 9_000_000, (0, 4): 900_000, (1, 3): 36_000_000}
    index = SimpleNamespace(candidates=SimpleNamespace(query=HOUSE), sizes=lambda: (n, edges))
    order, mean = economical(index, [1, 2, 3, 0, 4])
    assert order[0] == 1 and order[-1] == 2 and mean[3, 2] == 4  # parts last, over orders: 30 orders of a part came before
    assert economical(index, [3, 4, 0, 1, 2])[0] == [3, 4, 0, 1, 2]
