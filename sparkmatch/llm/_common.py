"""Shared plumbing of the training-data operators.

Every row-wise operator of this subpackage is one ``mapInArrow`` pass without a shuffle: the texts reach Python in
Arrow batches, are worked on in blocks of a bounded number of bytes, and only the operator's small output columns go
back.  State that is expensive to build (vocabularies, caches) lives in module-level dictionaries, so that a reused
Python worker builds it once.
"""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one call of an operator's block function sees at most (a longer single text comes alone).
BLOCK_BYTES = 3 << 20
#: Rows and bytes of one Arrow batch between the JVM and Python; a single larger row comes alone.
BATCH_ROWS = 1000
BATCH_BYTES = 4 << 20

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> None:
    """Lets Python workers import this package and bounds the Arrow batches.  Changes nothing else in the session."""
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (_ROOT, env.get("PYTHONPATH", "")) if p)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_holder: list = ["", lambda: None]


def claim(name: str, clear: Callable[[], None]) -> None:
    """Called by an operator in a worker before it fills its caches: those of the operator before are dropped first.

    Workers are reused from stage to stage, and only one operator's vocabulary and cache may fill one at a time.
    """
    if _holder[0] != name:
        _holder[1]()
        _holder[:] = [name, clear]
        _give_back()


def _give_back() -> None:
    """Returns freed memory to the system, so that what one operator needed is not held while the next one runs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named table with just these columns (all without any); the selection reaches the Parquet scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def fold(key: str, parts: int) -> Column:
    """crc32 of the key's text modulo ``parts``; 0 to parts - 1, null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % F.lit(parts)


def held_out(key: str, parts: int, part: int) -> Column:
    """True where the key falls into the held-out part; a null key never does."""
    return F.coalesce(fold(key, parts) == F.lit(part), F.lit(False))


def scratch_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: the one the cluster names, a local one only where none is set."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = os.path.join(os.path.abspath("spark-warehouse"), "scratch")
    spark.sparkContext.setCheckpointDir(own)
    return own


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder of the shared folder; nothing happens if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Store:
    """Tables in the shared folder: each cuts the lineage and outlives the executor that wrote it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.names = spark, []
        self.base = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str = "") -> DataFrame:
        name = name or str(len(self.names))
        self.names.append(name)
        df.write.parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop_all_but(self, *names: str) -> None:
        """Deletes the tables that no result reads any more."""
        for name in [n for n in self.names if n not in names]:
            remove(self.spark, f"{self.base}/{name}")
            self.names.remove(name)


def blocks(batch: pa.RecordBatch, column: int, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts hold at most ``limit`` bytes together, or a single longer text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield batch.slice(start)


def add_columns(
    df: DataFrame,
    read: str,
    out: T.StructType,
    make: Callable[[], Callable[[list], dict]],
    drop: Iterable[str] = (),
) -> DataFrame:
    """Appends the columns ``out``, computed from the text column ``read``, to every row of ``df``.

    ``make`` runs once per task and returns the block function: a list of texts (None for null) to one sequence per
    output column.  Columns of ``df`` that clash with an output (names compare without case) are replaced by it;
    columns in ``drop`` are not returned (``read`` may be one of them).  No shuffle.
    """
    outs = {f.name.lower() for f in out.fields}
    gone = {c.lower() for c in drop} | outs
    kept = [f for f in df.schema.fields if f.name.lower() not in gone]
    names = [f.name for f in kept]
    order = [n for n in names if n != read]
    # plain names on the way in: a name with a dot would be read as a field
    source = df.select(*[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(order)], F.col(f"`{read}`").cast("string").alias("read"))
    at = {n: i for i, n in enumerate(order)}
    col = len(order)
    schema = T.StructType([*(T.StructField(f.name, T.StringType() if f.name == read else f.dataType) for f in kept), *out.fields])
    arrow_types = [(f.name, _arrow_type(f.dataType)) for f in out.fields]

    def run(batches):
        block = make()
        for batch in batches:
            for part in blocks(batch, col):
                texts = part.column(col).to_pylist()
                got = block(texts)
                columns = [part.column(at[n]) if n != read else part.column(col) for n in names]
                columns += [pa.array(got[n], t) for n, t in arrow_types]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *(n for n, _ in arrow_types)])

    return source.mapInArrow(run, schema)


def _arrow_type(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow_type(t.elementType))
    return {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary()}[t.simpleString()]


def fields(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def smallest_hashes(pairs: DataFrame, per_class: int) -> tuple[list[tuple[int, str]], dict]:
    """At most ``per_class`` distinct ids of each class, those of the smallest hashes, and the number of rows of each class.

    ``pairs`` has columns doc_id (long) and y, without nulls; rows may repeat.  Counts by class, combined in each task,
    say below which hash about twice as many ids of a class lie; only those are sorted, so no task holds a class.  A
    class that falls short, as one of many repeated rows may, is asked again with a higher bound.
    """
    spark, width = pairs.sparkSession, 1 << 40
    totals = {r.y: r.n for r in pairs.groupBy("y").agg(F.count("*").alias("n")).collect()}  # one row for each class
    place = F.pmod(F.xxhash64("doc_id"), F.lit(width))
    share = {y: min(1.0, (2 * per_class + 100) / n) for y, n in totals.items()}
    out = []
    while share:
        below = spark.createDataFrame([(y, int(s * width)) for y, s in share.items()], f"y {pairs.schema['y'].dataType.simpleString()}, below long")
        near = pairs.join(F.broadcast(below), "y").where(place < F.col("below")).select("doc_id", "y").distinct()
        w = Window.partitionBy("y").orderBy(place, "doc_id")
        got: dict = {y: [] for y in share}
        for r in near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_class).collect():
            got[r.y].append(r.doc_id)
        done = [y for y in share if len(got[y]) >= per_class or share[y] >= 1]
        out += [(i, y) for y in done for i in got[y]]
        share = {y: min(1.0, 8 * s) for y, s in share.items() if y not in done}
    return out, totals


def label_sample(
    docs: DataFrame, labels: DataFrame, label: str, parts: int, part: int, per_label: int
) -> tuple[list[tuple[str, int]], dict[int, int]]:
    """(text, label) of at most ``per_label`` training documents of each label value, and the full count of each value.

    Labels are read only from documents outside the held-out part.  The choice, the smallest hashes of doc_id, reads
    two narrow columns; texts are fetched afterwards for the chosen ids only, so neither a shuffle nor the driver
    sees more texts than the documented bound.  A null text counts as empty; null labels and ids take no part; a
    doc_id with both labels keeps the larger, one with several texts the smallest.
    """
    spark = docs.sparkSession
    y = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", parts, part))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .join(docs.select("doc_id"), "doc_id", "left_semi")
    )
    rows, totals = smallest_hashes(y, per_label)
    if not rows:
        return [], {}
    small = spark.createDataFrame(rows, "doc_id long, y int")  # at most per_label rows a label value
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(small), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    return [(r.text or "", r.y) for r in sorted(got.collect(), key=lambda r: r.doc_id)], totals
