import duckdb
import pytest

from sparkmatch import catalog

TABLES = ["nation", "supplier", "customer", "part", "orders", "lineitem"]
SOME = ["graph_metadata", "graph_degree", "graph_nlf", "graph_reify_edge_labels", "graph_four_cliques", "match_clique4", "match_spectrum", "match_fine_labels", "order_gql", "order_qsi", "order_vf3", "order_vf2pp", "order_dpiso", "order_ri", "filter_nlf", "filter_cfl", "index_cardinality", "index_projections", "index_distinct_ends", "execution_tree", "execution_tree_report", "engine_vf3", "engine_vf3_star", "engine_kss", "match_square", "match_symmetry", "match_star", "match_limit", "match_distribution", "match_reified"]


@pytest.mark.parametrize("name", SOME)
def test_queries_equal_their_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name]).df()
    got = catalog.QUERIES[name](spark, sf).toPandas()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))
    assert len(got) and (list(got.columns) != ["n_embeddings"] or got.n_embeddings[0] > 0)  # not vacuous


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL) and len(catalog.QUERIES) > 55


def test_cores_of_the_whole_graph_equal_their_sql(spark, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = dict(con.execute(catalog.ORACLE_SQL["graph_kcore"]).fetchall())
    got = {r.id: r.core for r in catalog.QUERIES["graph_kcore"](spark, sf).collect()}
    assert got == want and max(want.values()) > 2
