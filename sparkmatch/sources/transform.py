"""Graph to graph: sampling, new labels, edge labels as vertices, toy graphs."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sparkmatch.model import DataGraph, QueryGraph
from sparkmatch.sources.text import relabelled
from sparkmatch.store import Store


def sample_edges(graph: DataGraph, p: float, seed: int = 0) -> DataGraph:
    """Keeps each undirected edge with probability p, by a hash of its ends; all vertices stay."""
    keep = F.pmod(F.xxhash64(F.lit(seed), F.least("src", "dst"), F.greatest("src", "dst")), F.lit(1 << 30)) < int(p * (1 << 30))
    return DataGraph.of(graph.vertices, graph.edges.where(keep).where("src < dst"))


def relabel(graph: DataGraph, labels: int, seed: int = 0) -> DataGraph:
    """Uniform labels over 0 .. labels - 1 in place of the graph's own."""
    return DataGraph.of(relabelled(graph.vertices.select("id"), labels, seed), graph.edges.where("src < dst"))


def reify(graph: DataGraph, offset: int, edge_ids: int, store: Store | None = None) -> DataGraph:
    """Each edge becomes a vertex of label ``offset`` + its label, joined to both ends.

    The new vertices have the ids ``edge_ids`` + a number that is unique in the graph; the numbers are written to
    ``store``, or to one of their own, so that all reads see the same.
    """
    store = store or Store(graph.vertices.sparkSession, "reified")
    vertices = graph.vertices if graph.plain is None else graph.plain  # degrees are counted anew
    there = (F.col("src_label") < F.col("dst_label")) | ((F.col("src_label") == F.col("dst_label")) & (F.col("src") < F.col("dst")))
    one = graph.edges.where(there)
    for end in ("src", "dst"):
        one = one.join(vertices.select(F.col("id").alias(end)), end, "left_semi")
    label = (F.coalesce("elabel", F.lit(0)) + F.lit(offset)).cast("int").alias("label")
    one = one.select("src", "dst", "src_label", "dst_label", label, (F.monotonically_increasing_id() + F.lit(edge_ids)).alias("eid"))
    return _reify(vertices, store.put(one))


def _reify(vertices, one) -> DataGraph:
    """The labels of both ends are those of the edge, so that a scan for one pair reads the edges of one label alone."""
    full = vertices.selectExpr("cast(id as long) as id", "cast(label as int) as label").unionAll(one.selectExpr("eid as id", "label"))
    ends = [one.selectExpr(f"{end} as a", "eid as b", "cast(null as int) as elabel", f"{end}_label as la", "label as lb") for end in ("src", "dst")]
    return DataGraph.symmetric(full, ends[0].unionAll(ends[1]))


def ring(spark: SparkSession, n: int) -> DataGraph:
    """A cycle of n vertices of label 0."""
    v = spark.range(n)
    return DataGraph.of(v.select("id", F.lit(0).alias("label")), v.select(F.col("id").alias("src"), F.pmod(F.col("id") + 1, F.lit(n)).alias("dst")))


def clique(spark: SparkSession, n: int) -> DataGraph:
    """A clique of n vertices of label 0; each vertex lists the greater ones."""
    v = spark.range(n)
    edges = v.where(F.col("id") < n - 1).select(F.col("id").alias("src"), F.explode(F.sequence(F.col("id") + 1, F.lit(n - 1))).alias("dst"))
    return DataGraph.of(v.select("id", F.lit(0).alias("label")), edges)


def star(spark: SparkSession, leaves: int) -> DataGraph:
    """Vertex 0 of label 0 beside ``leaves`` vertices of label 1."""
    v = spark.range(leaves + 1)
    return DataGraph.of(v.select("id", F.when(F.col("id") == 0, 0).otherwise(1).alias("label")), v.where("id > 0").select(F.lit(0).alias("src"), F.col("id").alias("dst")))


def toy(name: str) -> QueryGraph:
    """A small query by name: ``ring 5``, ``ring 4 of 0 1`` (labels in turn), ``chord 5`` (a ring with the chord 0-2), ``clique 4``, ``petersen``."""
    kind, *rest = name.split()
    n = int(rest[0]) if rest else 10
    around = lambda k, step=1, at=0: [(at + i, at + (i + step) % k) for i in range(k)]
    if kind == "petersen":
        edges = around(5) + around(5, 2, 5) + [(i, i + 5) for i in range(5)]
    elif kind == "clique":
        edges = [(a, b) for a in range(n) for b in range(a)]
    elif kind in ("ring", "chord"):
        edges = around(n) + [(0, 2)] * (kind == "chord")
    else:
        raise ValueError(f"no toy {name!r}")
    turn = list(map(int, rest[2:])) or [0]
    return QueryGraph.of([turn[i % len(turn)] for i in range(n)], edges)


def as_data(spark: SparkSession, query: QueryGraph) -> DataGraph:
    """A query as a data graph."""
    edges = spark.createDataFrame([(u, w, x) for (u, w), x in query.edges.items()], "src long, dst long, elabel int")
    return DataGraph.of(spark.createDataFrame(list(enumerate(query.labels)), "id long, label int"), edges)
