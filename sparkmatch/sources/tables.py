"""The relational tables (region to lineitem) as a property graph.

Vertices: id = type * 10 ** 10 + key for nation 0, supplier 1, customer 2, part 3, order 4.  Labels: nation 0,
supplier 1, customer 10 + rank of its segment, part 20 + rank of its brand, order 50 + rank of its priority; or the
type alone (``coarse``).  Edges, labelled by kind: supplier-nation 0, customer-nation 1, order-customer 2, order-part 3,
order-supplier 4, part-supplier 5.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkmatch.model import DataGraph

BASE = 10**10
NATION, SUPPLIER, CUSTOMER, PART, ORDER = range(5)
KINDS = {"supplier_nation": 0, "customer_nation": 1, "order_customer": 2, "order_part": 3, "order_supplier": 4, "part_supplier": 5}


def _ids(kind: int, key: str):
    return F.col(key).cast("long") + F.lit(kind * BASE)


def _ranked(df: DataFrame, kind: int, key: str, by: str, first: int) -> DataFrame:
    """(id, label) with the rank of ``by`` among its few distinct values, which are joined as a table of their own."""
    rank = df.select(by).distinct().select(by, (F.row_number().over(Window.orderBy(by)) - 1 + first).cast("int").alias("label"))
    return df.join(rank, by).select(_ids(kind, key).alias("id"), "label")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vertices(spark: SparkSession, sf_dir: str, coarse: bool = False) -> dict[int, DataFrame]:
    """(id, label) of each vertex type."""
    t = lambda name: table(spark, sf_dir, name)
    if coarse:
        keys = {NATION: ("nation", "n_nationkey"), SUPPLIER: ("supplier", "s_suppkey"), CUSTOMER: ("customer", "c_custkey"), PART: ("part", "p_partkey"), ORDER: ("orders", "o_orderkey")}
        return {k: t(name).select(_ids(k, key).alias("id"), F.lit(k).alias("label")) for k, (name, key) in keys.items()}
    return {
        NATION: t("nation").select(_ids(NATION, "n_nationkey").alias("id"), F.lit(0).alias("label")),
        SUPPLIER: t("supplier").select(_ids(SUPPLIER, "s_suppkey").alias("id"), F.lit(1).alias("label")),
        CUSTOMER: _ranked(t("customer"), CUSTOMER, "c_custkey", "c_mktsegment", 10),
        PART: _ranked(t("part"), PART, "p_partkey", "p_brand", 20),
        ORDER: _ranked(t("orders"), ORDER, "o_orderkey", "o_orderpriority", 50),
    }


def pairs(spark: SparkSession, sf_dir: str) -> dict[str, tuple[int, int, DataFrame]]:
    """For each kind the types of both ends and its distinct edges (a, b)."""
    t = lambda name: table(spark, sf_dir, name)
    line = t("lineitem")
    return {
        "supplier_nation": (SUPPLIER, NATION, t("supplier").select(_ids(SUPPLIER, "s_suppkey").alias("a"), _ids(NATION, "s_nationkey").alias("b"))),
        "customer_nation": (CUSTOMER, NATION, t("customer").select(_ids(CUSTOMER, "c_custkey").alias("a"), _ids(NATION, "c_nationkey").alias("b"))),
        "order_customer": (ORDER, CUSTOMER, t("orders").select(_ids(ORDER, "o_orderkey").alias("a"), _ids(CUSTOMER, "o_custkey").alias("b"))),
        "order_part": (ORDER, PART, line.select(_ids(ORDER, "l_orderkey").alias("a"), _ids(PART, "l_partkey").alias("b")).distinct()),
        "order_supplier": (ORDER, SUPPLIER, line.select(_ids(ORDER, "l_orderkey").alias("a"), _ids(SUPPLIER, "l_suppkey").alias("b")).distinct()),
        "part_supplier": (PART, SUPPLIER, line.select(_ids(PART, "l_partkey").alias("a"), _ids(SUPPLIER, "l_suppkey").alias("b")).distinct()),
    }


def graph(spark: SparkSession, sf_dir: str, coarse: bool = False, kinds: list[str] | None = None) -> DataGraph:
    """The graph of all kinds of edges or the named ones, edges labelled by kind.

    With ``coarse`` labels the label pair of an edge is a constant of its kind, so a scan for one pair reads the
    tables of that kind alone.
    """
    v = vertices(spark, sf_dir, coarse)
    one = []
    for name, (left, right, edges) in pairs(spark, sf_dir).items():
        if kinds is not None and name not in kinds:
            continue
        if coarse:
            e = edges.select("a", "b", F.lit(KINDS[name]).alias("elabel"), F.lit(left).alias("la"), F.lit(right).alias("lb"))
        else:
            e = edges.join(v[left].toDF("a", "la"), "a").join(v[right].toDF("b", "lb"), "b").select("a", "b", F.lit(KINDS[name]).alias("elabel"), "la", "lb")
        one.append(e)
    types = sorted({t for n, (a, b, _) in pairs(spark, sf_dir).items() if kinds is None or n in kinds for t in (a, b)})
    return DataGraph.symmetric(reduce(DataFrame.unionAll, (v[t] for t in types)), reduce(DataFrame.unionAll, one))


#: Lines of an order between two parts of ``near_parts`` at most.
APART = 3


def near_parts(spark: SparkSession, sf_dir: str) -> DataGraph:
    """Parts, all of label 0, joined where they stand at most APART lines apart in an order.  A line has at most APART edges down."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("src"))
    steps = line.select("l_orderkey", "l_linenumber", F.col("src").alias("dst"), F.explode(F.sequence(F.lit(1), F.lit(APART))).alias("step"))
    below = steps.select("l_orderkey", (F.col("l_linenumber") - F.col("step")).alias("l_linenumber"), "dst")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit(0).alias("label"))
    return DataGraph.of(parts, line.join(below, ["l_orderkey", "l_linenumber"]).select("src", "dst"))
