"""Intermediate tables in a folder that all machines share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables that are estimated at more bytes in all are written one after the other.
AT_ONCE = 1 << 26
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Store:
    """Writes a table and reads it back: cuts the lineage, survives lost executors, and gives the planner true sizes.

    The folder is that of ``spark.checkpoint.dir``; only a local master may do without.  ``clear`` deletes all tables,
    ``drop`` one, when nothing that is still to run reads them.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = f"file://{os.path.abspath('spark-warehouse')}/scratch"
        self.spark, self.base, self.n = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}", 0
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def inner(self, name: str) -> Store:
        """A store in the folder of this one, which can be cleared before it."""
        out = Store(self.spark, name)
        out.base = f"{self.base}/{name}"
        return out

    def put(self, df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
        """The table, read back; ``by`` names columns of few values to make folders of.

        What was shuffled for it is deleted at once, since Spark else keeps it until the driver collects its garbage.
        """
        self.n += 1
        path = f"{self.base}/{self.n}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.partitionBy(*by).parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = out, path
        return out

    def put_all(self, parts: list[DataFrame], name: str, after: Callable[[int], None] = lambda i: None) -> list[DataFrame]:
        """All tables; one after the other if they are large, so that what one shuffles is gone before the next, or else by one job.

        ``name`` is that of a column that tells them apart; ``after`` is told the place of a large one that is written.
        """
        if large(parts):
            out = []
            for i, p in enumerate(parts):
                out.append(self.put(p))
                after(i)
            return out
        table = self.put(reduce(DataFrame.unionAll, (p.withColumn(name, F.lit(i)) for i, p in enumerate(parts))), by=(name,))
        return [table.where(F.col(name) == i).drop(name) for i in range(len(parts))]

    def holds(self, df: DataFrame) -> bool:
        """Whether the table has a folder of its own here, which can be dropped."""
        return id(df) in self.paths

    def drop(self, df: DataFrame) -> None:
        _, path = self.paths.pop(id(df))
        self._delete(path)

    def clear(self) -> None:
        self.paths.clear()
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def is_scan(df: DataFrame) -> bool:
    """Whether the plan is made of file scans with filters, projections and unions at most."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() in ("Project", "Filter", "Union"):
            todo += [node.children().apply(i) for i in range(node.children().size())]
        elif not node.nodeName().startswith("LogicalRelation"):
            return False
    return True


def n_scans(df: DataFrame) -> int:
    """Leaves of the plan that read something."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(leaves.apply(i).nodeName() != "LocalRelation" for i in range(leaves.size()))


def n_bytes(df: DataFrame) -> int:
    """The planner's estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def large(parts: list[DataFrame]) -> bool:
    return sum(map(n_bytes, parts)) > AT_ONCE
