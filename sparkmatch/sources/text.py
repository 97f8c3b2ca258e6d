"""Text graphs: ``t N M``, ``v id label degree`` and ``e src dst [label]`` lines; edge lists; query files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmatch.model import DataGraph, QueryGraph


def read_query(path: str) -> QueryGraph:
    """A query graph from a small local text file."""
    with open(path) as f:
        return parse_query(f.read())


def parse_query(text: str) -> QueryGraph:
    labels, edges = {}, []
    for parts in map(str.split, text.splitlines()):
        if parts[:1] == ["v"]:
            labels[int(parts[1])] = int(parts[2])
        elif parts[:1] == ["e"]:
            edges.append(tuple(map(int, parts[1:4])))
    if sorted(labels) != list(range(len(labels))):
        raise ValueError("the vertices of a query are numbered from 0 without gaps")
    return QueryGraph.of([labels[i] for i in range(len(labels))], edges)


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))


def read_graph(spark: SparkSession, path: str) -> DataGraph:
    """A data graph; degrees are counted, not taken from the file (``declared_degrees`` has those)."""
    f = _fields(spark, path)
    at = lambda i, kind: F.try_element_at("f", F.lit(i)).cast(kind)
    vertices = f.where(F.col("f")[0] == "v").select(at(2, "long").alias("id"), at(3, "int").alias("label"))
    edges = f.where(F.col("f")[0] == "e").select(at(2, "long").alias("src"), at(3, "long").alias("dst"), at(4, "int").alias("elabel"))
    return DataGraph.of(vertices, edges)


def declared_degrees(spark: SparkSession, path: str) -> DataFrame:
    f = _fields(spark, path)
    return f.where(F.col("f")[0] == "v").select(F.col("f")[1].cast("long").alias("id"), F.col("f")[3].cast("int").alias("degree"))


def write_graph(graph: DataGraph, path: str) -> None:
    """The graph as text lines; the header is a file of its own that sorts first."""
    meta = graph.metadata().select(F.format_string("t %d %d", "n_vertices", "n_edges").alias("value"), F.lit(0).alias("k"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    v = graph.vertices.select(F.format_string("v %d %d %d", "id", "label", "degree").alias("value"), F.lit(1).alias("k"), F.col("id").alias("i"), F.lit(0).cast("long").alias("j"))
    line = F.concat_ws(" ", F.lit("e"), F.col("src"), F.col("dst"), F.col("elabel"))
    e = graph.edges.where("src < dst").select(line.alias("value"), F.lit(2).alias("k"), F.col("src").alias("i"), F.col("dst").alias("j"))
    meta.unionAll(v).unionAll(e).orderBy("k", "i", "j").select("value").write.mode("overwrite").text(path)


def read_edge_list(spark: SparkSession, path: str, labels: int = 1, seed: int = 0) -> DataGraph:
    """A graph from ``src dst`` lines; lines that begin with # are comments.

    Vertices are the ends of the edges.  Labels are uniform over 0 .. labels - 1, by a hash of id and seed, so they
    depend neither on partitions nor on the run.
    """
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    f = lines.select(F.split(F.trim("value"), r"\s+").alias("f"))
    edges = f.select(F.col("f")[0].cast("long").alias("src"), F.col("f")[1].cast("long").alias("dst"))
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return DataGraph.of(relabelled(ids, labels, seed), edges)


def relabelled(vertices: DataFrame, labels: int, seed: int = 0) -> DataFrame:
    """``vertices(id)`` with uniform labels, a function of id and seed alone."""
    return vertices.select("id", F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(labels)).cast("int").alias("label"))
