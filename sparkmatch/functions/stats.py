"""Statistics of data graphs: degrees, label counts, neighbour labels, cores, triangles, degree distribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkmatch.model import DataGraph, QueryGraph
from sparkmatch.store import Store


def degrees(graph: DataGraph) -> DataFrame:
    return graph.vertices.select("id", F.col("degree").cast("long").alias("degree"))


def label_frequency(graph: DataGraph) -> DataFrame:
    return graph.vertices.groupBy("label").agg(F.count("*").alias("n"))


def label_pairs(graph: DataGraph) -> DataFrame:
    """Directed edges of each pair of labels."""
    return graph.edges.groupBy("src_label", "dst_label").agg(F.count("*").alias("n"))


def neighbour_labels(graph: DataGraph) -> DataFrame:
    """(id, label, elabel, n): how many neighbours of each label a vertex has over edges of each label."""
    return graph.edges.groupBy(F.col("src").alias("id"), F.col("dst_label").alias("label"), "elabel").agg(F.count("*").alias("n"))


def neighbour_label_maps(graph: DataGraph) -> DataFrame:
    """(id, nlf): the same as one map from label to count for each vertex, edge labels summed."""
    by_label = graph.edges.groupBy(F.col("src").alias("id"), "dst_label").agg(F.count("*").cast("int").alias("n"))
    return by_label.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("dst_label", "n"))).alias("nlf"))


def contains_labels(nlf: Column, want: dict[int, int]) -> Column:
    """Whether a map of neighbour labels has at least the wanted count of each label."""
    out = F.lit(True)
    for label, n in sorted(want.items()):
        out = out & (F.coalesce(F.try_element_at(nlf, F.lit(label)), F.lit(0)) >= n)
    return out


def profile(graph: DataGraph, query: QueryGraph) -> tuple[DataFrame, dict[tuple[int, int | None], str]]:
    """(id, label, degree, k0, k1, ...) of the vertices with a query label, and the column of each neighbour kind.

    One aggregation counts, for every kind (label, edge label) that some query vertex has a neighbour of, a vertex's neighbours of the kind;
    only edges between query labels are read.  Without edges in the query there are no counts.
    """
    labels = sorted(set(query.labels))
    kinds = sorted({k for c in query.neighbour_kinds for k in c}, key=str)
    names = {k: f"k{i}" for i, k in enumerate(kinds)}
    vertices = graph.vertices.where(F.col("label").isin(labels))
    if not kinds:
        return vertices, names
    match = lambda k: (F.col("dst_label") == k[0]) if k[1] is None else (F.col("dst_label") == k[0]) & (F.col("elabel") == k[1])
    edges = graph.edges.where(F.col("src_label").isin(labels) & F.col("dst_label").isin(labels))
    counts = edges.groupBy("src").agg(*[F.count(F.when(match(k), 1)).alias(name) for k, name in names.items()])
    return vertices.join(counts, vertices.id == counts.src).drop("src"), names


def core_numbers(graph: DataGraph, most: int | None = None) -> DataFrame:
    """(id, core) of every vertex; no core is above ``most`` if given.

    Values start as degrees.  In each round a vertex takes the largest h such that h of its neighbours have values of
    at least h, if that is less than its own; when no value falls any more they are the core numbers.  A round writes one value
    a vertex; a vertex's neighbours are counted by value, never collected.
    """
    store = Store(graph.vertices.sparkSession, "core")
    edges = store.put(graph.edges.select("src", "dst"))
    first = F.col("degree").cast("long")
    values = store.put(graph.vertices.select("id", (first if most is None else F.least(first, F.lit(most))).alias("core")))
    down = Window.partitionBy("src").orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, 0)
    while True:
        ends = edges.join(values.toDF("dst", "cd"), "dst").join(values.toDF("src", "cs"), "src")
        near = ends.groupBy("src", F.least("cd", "cs").alias("value")).agg(F.count("*").alias("n"))
        h = near.withColumn("n", F.sum("n").over(down)).groupBy("src").agg(F.max(F.least("value", "n")).alias("h"))
        new = values.join(h, values.id == h.src, "left").select("id", F.col("core").alias("old"), F.coalesce(F.least("core", "h"), F.lit(0).cast("long")).alias("core"))
        new = store.put(new)
        store.drop(values)
        if not new.where("core < old").limit(1).count():
            store.drop(edges)
            return new.select("id", "core")
        values = store.put(new.select("id", "core"))
        store.drop(new)


def _upwards(graph: DataGraph) -> DataFrame:
    """(x, y): each edge once, from the end of lower degree to that of higher, which bounds the edges that leave a hub."""
    deg = graph.vertices.select("id", "degree")
    e = graph.edges.where("src < dst").select("src", "dst")
    e = e.join(deg.toDF("src", "ds"), "src").join(deg.toDF("dst", "dd"), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    return e.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("x"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("y"))


def _closing(e: DataFrame, a: str, b: str) -> DataFrame:
    """The edges as (a, b) with a < b."""
    return e.select(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b))


def triangles(graph: DataGraph) -> DataFrame:
    """(a, b, c) with a < b < c, pairwise adjacent; found from the vertex of lowest degree."""
    e = _upwards(graph)
    three = e.join(e.toDF("x", "z"), "x").where("y < z").join(_closing(e, "y", "z"), ["y", "z"])
    abc = F.sort_array(F.array("x", "y", "z"))
    return three.select(abc[0].alias("a"), abc[1].alias("b"), abc[2].alias("c"))


def four_cliques(graph: DataGraph) -> DataFrame:
    """(a, b, c, d) ascending, pairwise adjacent; found from the vertex of lowest degree."""
    e = _upwards(graph)
    three = e.join(e.toDF("x", "z"), "x").where("y < z").join(_closing(e, "y", "z"), ["y", "z"])
    four = three.join(e.toDF("x", "t"), "x").where("z < t").join(_closing(e, "y", "t"), ["y", "t"]).join(_closing(e, "z", "t"), ["z", "t"])
    abcd = F.sort_array(F.array("x", "y", "z", "t"))
    return four.select(*[abcd[i].alias(n) for i, n in enumerate("abcd")])


def degree_tail(graph: DataGraph) -> DataFrame:
    """(degree, n, p): number of vertices of each degree and the share of vertices of at least it."""
    n = graph.vertices.groupBy("degree").agg(F.count("*").alias("n"))
    # one row for each distinct degree, so the windows are small
    down = Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, 0)
    return n.select(F.col("degree").cast("long").alias("degree"), "n", (F.sum("n").over(down) / F.sum("n").over(Window.partitionBy())).alias("p"))
