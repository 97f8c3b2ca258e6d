"""Operator 9: token-ID output in training order.

Every whole text is tokenised, ended by END and cut into sequences of LENGTH ids; the last one of a text is padded.
A sequence's number is its input split and its place in that, so numbers need no counting pass.  A keyed Feistel
permutation of 0 .. DOMAIN - 1, the smallest domain of even bits walked in cycles until the value is below DOMAIN,
gives each number a place that no other has; the slots 0, 1, 2, ... go to the sequences in the order of their places.
Equal ranges of places are the shards: files of fixed-stride records, so slot s lies in the last file whose first slot
is not above s, at byte (s - first slot) * STRIDE.  The order file has the first slots; a reader that stopped at any
slot goes on from there by arithmetic alone.

Plan.  One pass tokenises, numbers and permutes, and sends the ids through one shuffle in which task k gets the k-th
range of places, so that all tasks get as many.  Each sorts its range and writes it as a stream.  A file is written
under a name of its own and then renamed, so a task that runs again after a lost executor leaves the same file.  The
numbers of rows in the files, one a shard, then give the first slots.

A task that runs again must number alike, so the input must be a file scan with filters and projections at most; any
other input is first written to the shared folder.
"""

from __future__ import annotations

import json
import uuid
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from . import token_counts

LENGTH = 512
#: Sequences of a shard, about: their number is reckoned from the bytes of all texts, at so many bytes an id.
SHARD_SLOTS = 8192
ID_BYTES = 3
#: Shards at most; beyond that they are longer.
SHARDS = 1 << 17
#: Input splits and sequences of a split that numbers have room for.
SPLITS, PLACES = 1_000_000, 1 << 32
DOMAIN = SPLITS * PLACES
#: Text bytes that are tokenised together.
BLOCK_BYTES = 8 << 20
ROUNDS = 4
KEY = 0x5DEECE66D


def feistel(index: np.ndarray, m: int, key: int = KEY) -> np.ndarray:
    """Slot of each index below ``m``: a permutation of 0 .. m - 1 that only the key decides."""
    half = max(1, (max(m - 1, 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for r in range(ROUNDS):
            x = right + np.uint64(((key + r) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ (x ^ x >> np.uint64(31)) & mask
        out[todo] = left << shift | right
        todo = todo[out[todo] >= m]  # outside the range: walk on
    return out.astype(np.int64)


@cache
def _table(path: str) -> token_counts.WordTable:
    table = token_counts.WordTable(token_counts.load(path), as_ids=True)
    if table.counter.lib.vocab_size() > 1 << 16:
        raise ValueError("ids of 16 bits are written; the vocabulary is larger")
    return table


def _claimed(path: str) -> token_counts.WordTable:
    """The worker's table, the same for both passes: a reused worker has it warm."""
    C.claim("training_order", _table.cache_clear)
    return _table(path)


def _gathered(batches):
    """Batches with columns (doc_id, text, split), no text null, of about BLOCK_BYTES of text; a longer text comes alone."""
    held, size = [], 0
    for batch in batches:
        for part in C.blocks(batch, 1, BLOCK_BYTES):
            n = pc.sum(pc.binary_length(part.column(1))).as_py() or 0
            if held and size + n > BLOCK_BYTES:
                yield _joined(held)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    columns = [pa.concat_arrays([p.column(i) for p in parts]) for i in range(3)]
    return pa.RecordBatch.from_arrays([columns[0], pc.fill_null(columns[1], ""), columns[2]], names=["doc_id", "text", "split"])


def _cut(ids: np.ndarray, n: np.ndarray, end: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ended ids of all texts, the bounds of their sequences, and each sequence's text and place in it."""
    ended = (n > 0).astype(np.int64)
    size = n + ended
    begin = np.cumsum(size) - size
    out = np.full(int(size.sum()), end, np.uint16)
    out[token_counts.spread(begin, n)] = ids
    count = -(-size // length)
    text = np.repeat(np.arange(len(n)), count)
    place = token_counts.spread(np.zeros(len(n), np.int64), count)
    return out, np.append(begin[text] + place.astype(np.int64) * length, len(out)), text, place


def _is_scan(df: DataFrame) -> bool:
    """Whether the plan is a file scan with filters and projections at most, whose splits are the same in every job."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.nodeName() in ("Project", "Filter"):
        node = node.children().apply(0)
    return node.nodeName().startswith("LogicalRelation") and bool(df.inputFiles())


class Writer:
    """Writes the records of one task, shard by shard."""

    def __init__(self, base: str):
        self.fs, self.base = fs.FileSystem.from_uri(base)
        self.shard, self.out, self.n = None, None, 0

    def add(self, shard: int, records: list[bytes]) -> int:
        """Number of records that the shard had before."""
        if shard != self.shard:
            self.close()
            self.shard, self.n = shard, 0
            self.fs.create_dir(self.base, recursive=True)
            self.part = f"{self.base}/.{shard}-{uuid.uuid4().hex}"
            self.out = self.fs.open_output_stream(self.part)
        self.out.write(b"".join(records))
        self.n += len(records)
        return self.n - len(records)

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.fs.move(self.part, f"{self.base}/{shard_name(self.shard)}")
            self.out = None


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write(docs: DataFrame, path: str, base: str, length: int = LENGTH, key: int = KEY, doc_id: str = "doc_id", text: str = "text", shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Writes the shards below ``base`` and returns their manifest, one row for each sequence.

    Columns: slot, doc_id, part (of the document, from 0), n_tokens (without padding), shard, byte_offset, crc32 of
    the record.  Null and empty texts have no sequence; repeated rows have sequences of their own; a null doc_id is kept.
    An empty table writes an empty order file alone.  Other columns are not read.  Padding is id 0.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    base = base if "://" in base or base.startswith("file:") else f"file://{base}"
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    if not _is_scan(source):
        source.write.mode("overwrite").parquet(f"{base}/input")
        source = spark.read.schema(source.schema).parquet(f"{base}/input")
    stride = 2 * length
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n"), F.count("text").alias("rows")).first()
    shards = min(SHARDS, max(1, -(-(size.n // (ID_BYTES * length) + size.rows // 2) // shard_slots)))
    width = -(-DOMAIN // shards)

    def cut(batches):
        number = None
        for part in _gathered(batches):
            table = _claimed(path)
            if number is None:
                number = part.column(2)[0].as_py() * PLACES
            flat, bounds, of, place = _cut(*table.ids(part.column(1)), table.counter.lib.eos_id(), length)
            if len(of):
                places = feistel(np.arange(number, number + len(of)), DOMAIN, key)
                number += len(of)
                records = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array((places // width).astype(np.int32)), pa.array(places), part.column(0).take(pa.array(of)), pa.array(place, pa.int32()), pa.array(np.diff(bounds), pa.int32()), records],
                    names=["shard", "place", "doc_id", "part", "n_tokens", "record"],
                )

    def store(batches):
        out, pad = Writer(base), bytes(stride)
        for batch in batches:
            shard = batch.column(0).to_numpy()
            records = [r if len(r) == stride else r + pad[len(r) :] for r in batch.column(5).to_pylist()]
            row = np.empty(len(shard), np.int64)
            bounds = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b > a:
                    row[a:b] = np.arange(b - a) + out.add(int(shard[a]), records[a:b])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(row), batch.column(2), batch.column(3), batch.column(4), pa.array(list(map(zlib.crc32, records)), pa.int64())],
                names=["shard", "row", "doc_id", "part", "n_tokens", "crc32"],
            )
        out.close()

    dealt = source.withColumn("split", F.spark_partition_id()).mapInArrow(cut, "shard int, place long, doc_id long, part int, n_tokens int, record binary").repartitionById(shards, "shard")
    written = f"{base}/manifest"
    dealt.sortWithinPartitions("place").mapInArrow(store, "shard int, row long, doc_id long, part int, n_tokens int, crc32 long").write.mode("overwrite").parquet(written)
    manifest = spark.read.parquet(written)
    first, m = [], 0
    for row in sorted(manifest.groupBy("shard").agg(F.count("*").alias("n")).collect()):  # one row for each shard
        first.append((row.shard, m))
        m += row.n
    facts = {"sequences": m, "length": length, "stride": stride, "first": first, "key": key, "dtype": "uint16"}
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/order")
    starts = spark.createDataFrame(first, "shard int, first long")  # at most SHARDS rows
    placed = manifest.join(F.broadcast(starts), "shard")
    return placed.select((F.col("first") + F.col("row")).alias("slot"), "doc_id", "part", "n_tokens", "shard", (F.col("row") * stride).alias("byte_offset"), "crc32")


def read(base: str, start: int = 0, stop: int | None = None):
    """Yields the ids of the slots from ``start`` on, in order; what a trainer does after a restart."""
    files, root = fs.FileSystem.from_uri(base if "://" in base else f"file://{base}")
    order = next(f.path for f in files.get_file_info(fs.FileSelector(f"{root}/order")) if "part-" in f.path and not f.base_name.startswith("."))
    order = json.loads(files.open_input_stream(order).read())
    stride, stop = order["stride"], order["sequences"] if stop is None else min(stop, order["sequences"])
    ends = [n for _, n in order["first"][1:]] + [order["sequences"]]
    for (shard, first), end in zip(order["first"], ends, strict=False):
        a, b = max(start, first), min(stop, end)
        if a < b:
            with files.open_input_file(f"{root}/{shard_name(shard)}") as f:
                f.seek((a - first) * stride)
                for _ in range(b - a):
                    yield np.frombuffer(f.read(stride), np.uint16)
