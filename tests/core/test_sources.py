import numpy as np

from sparkmatch.functions import stats
from sparkmatch.sources import csr, text, transform
from tests.core.brute import data_graph

LINES = """t 6 7
v 0 3 3
v 1 0 2
v 2 3 3
v 3 1 2
v 4 0 3
v 5 1 1
e 0 1
e 1 2
e 2 0
e 0 4
e 2 3
e 3 4
e 4 5
"""


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_text_csr_and_parquet_round_trips(spark, tmp_path, monkeypatch):
    (tmp_path / "g.graph").write_text(LINES)
    g = text.read_graph(spark, f"file://{tmp_path}/g.graph")
    assert rows(g.vertices) == [(0, 3, 3), (1, 0, 2), (2, 3, 3), (3, 1, 2), (4, 0, 3), (5, 1, 1)] and g.edges.count() == 14
    assert g.validate(text.declared_degrees(spark, f"file://{tmp_path}/g.graph")) == []
    assert g.metadata().first().asDict() == {"n_vertices": 6, "n_edges": 7, "n_labels": 4, "max_degree": 3, "max_label_frequency": 2}
    text.write_graph(g, f"file://{tmp_path}/out")
    again = text.read_graph(spark, f"file://{tmp_path}/out")
    assert rows(again.edges) == rows(g.edges)
    csr.write_csr(g, f"{tmp_path}/X")
    assert np.fromfile(f"{tmp_path}/X_deg.bin", "<i4").tolist() == [4, 6, 7, 3, 2, 3, 2, 3, 1]
    monkeypatch.setattr(csr, "BLOCK", 2)
    back = csr.read_csr(spark, f"{tmp_path}/X")
    assert rows(back.vertices) == rows(g.vertices) and rows(back.edges) == rows(g.edges)
    csr.write_parquet(g, f"{tmp_path}/p")
    assert rows(csr.read_parquet(spark, f"{tmp_path}/p").edges) == rows(g.edges)


def test_edge_list_labels_and_samples(spark, tmp_path):
    (tmp_path / "e.txt").write_text("# comment\n0 1\n1\t0\n2 2\n1 2\n\n")
    g = text.read_edge_list(spark, f"file://{tmp_path}/e.txt", labels=3, seed=1)
    assert rows(g.edges.select("src", "dst")) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert rows(g.vertices) == rows(text.read_edge_list(spark, f"file://{tmp_path}/e.txt", labels=3, seed=1).vertices)
    big = transform.clique(spark, 40)
    assert big.edges.count() == 40 * 39 and transform.ring(spark, 6).edges.count() == 12
    some = transform.sample_edges(big, 0.5, seed=3)
    assert 0.35 < some.edges.count() / big.edges.count() < 0.65 and some.validate() == []
    assert {r.label for r in transform.relabel(big, 4).vertices.collect()} <= set(range(4))
    assert {r.label for r in big.unlabelled().vertices.collect()} == {0}


def test_reified_graphs(spark):
    g = data_graph(spark, [0, 0, 1], {(0, 1): 2, (1, 2): 5})
    made = transform.reify(g, 10, 1000)
    assert sorted(r.label for r in made.vertices.collect()) == [0, 0, 1, 12, 15] and made.edges.count() == 8
    ids = {r.id for r in made.vertices.collect()}
    assert {r.dst for r in made.edges.collect()} <= ids and len(ids) == 5


def test_reified_edges_are_scans(spark):
    from sparkmatch.model import DataGraph
    from sparkmatch.store import is_scan

    vertices = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "id long, label int")
    one = spark.createDataFrame([(1, 0, 2, 0, 0), (2, 1, 5, 1, 0), (2, 9, 5, 1, 0)], "a long, b long, elabel int, la int, lb int")
    made = transform.reify(DataGraph.symmetric(vertices, one), 10, 1000)  # there is no vertex 9
    assert is_scan(made.edges) and is_scan(made.between(0, 15))
    near = {}
    for r in made.edges.where("src < 1000").collect():
        near.setdefault((r.dst_label, r.dst), set()).add((r.src, r.src_label, r.elabel))
    assert {label: ends for (label, _), ends in near.items()} == {12: {(0, 0, None), (1, 0, None)}, 15: {(1, 0, None), (2, 1, None)}}
    assert made.validate() == [] and {(r.id, r.label): r.degree for r in made.vertices.collect() if r.id < 1000} == {(0, 0): 1, (1, 0): 2, (2, 1): 1}


def test_toys_as_queries_and_as_data(spark):
    sizes = {"ring 5": (5, 5), "ring 4 of 0 1": (4, 4), "chord 4": (4, 5), "clique 4": (4, 6), "petersen": (10, 15)}
    for name, (n, m) in sizes.items():
        q = transform.toy(name)
        assert (len(q), len(q.edges)) == (n, m)
    assert transform.toy("ring 4 of 0 1").labels == (0, 1, 0, 1) and set(transform.toy("petersen").degree) == {3}
    assert transform.as_data(spark, transform.toy("petersen")).edges.count() == 30


def test_convert_command(spark, tmp_path):
    from sparkmatch.cli import main

    (tmp_path / "g.graph").write_text(LINES)
    main(["convert", f"file://{tmp_path}/g.graph", f"{tmp_path}/Y"])
    assert np.fromfile(f"{tmp_path}/Y_label.bin", "<i4").tolist() == [3, 0, 3, 1, 0, 1]


def test_statistics(spark):
    k5 = transform.clique(spark, 5)
    assert stats.triangles(k5).count() == 10 and stats.four_cliques(k5).count() == 5
    assert {r.core for r in stats.core_numbers(k5).collect()} == {4}
    g = data_graph(spark, [0, 1, 1], {(0, 1): None, (0, 2): None})
    maps = {r.id: r.nlf for r in stats.neighbour_label_maps(g).collect()}
    assert maps == {0: {1: 2}, 1: {0: 1}, 2: {0: 1}}
    able = stats.neighbour_label_maps(g).where(stats.contains_labels(stats.F.col("nlf"), {1: 2}))
    assert [r.id for r in able.collect()] == [0]


def peeled(edges, n):
    """Core numbers by taking away one vertex of the least degree after the other."""
    near = {v: {b for a, b in edges if a == v} | {a for a, b in edges if b == v} for v in range(n)}
    core, k = {}, 0
    while near:
        v = min(near, key=lambda x: len(near[x]))
        k = max(k, len(near[v]))
        core[v] = k
        for w in near.pop(v):
            near[w].discard(v)
    return core


def test_core_numbers_of_several_cores(spark):
    clique = [(a, b) for a in range(6) for b in range(a)]
    wheel = [(6 + i, 6 + (i + 1) % 7) for i in range(7)] + [(13, 6 + i) for i in range(7)]
    ring = [(14 + i, 14 + (i + 1) % 4) for i in range(4)]
    edges = [*clique, *wheel, *ring, (5, 6), (13, 14), (17, 18), (18, 19), (19, 20), (0, 7)]
    g = data_graph(spark, [0] * 22, {e: None for e in edges})
    want = peeled(edges, 22)
    assert set(want.values()) == {0, 1, 2, 3, 5}
    assert {r.id: r.core for r in stats.core_numbers(g).collect()} == want
