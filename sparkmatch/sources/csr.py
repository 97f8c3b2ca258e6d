"""Binary CSR graphs: ``X_deg.bin``, ``X_adj.bin`` and ``X_label.bin``, little-endian 32-bit integers.

Reading never loads a file into one task: the layout is cut by byte ranges, each read by its own task through the
files' own file system.  Vertices are numbered from 0; degrees decide where each vertex's neighbours begin, so the
degree file alone is summed block by block first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmatch.model import DataGraph

#: Vertices of one block.
BLOCK = 1 << 20
_INT = np.dtype("<i4")


def _ints(prefix: str, name: str, start: int, count: int) -> np.ndarray:
    files, path = fs.FileSystem.from_uri(prefix if "://" in prefix else f"file://{prefix}")
    with files.open_input_file(f"{path}_{name}.bin") as f:
        f.seek(4 * start)
        return np.frombuffer(f.read(4 * count), _INT)


def read_csr(spark: SparkSession, prefix: str) -> DataGraph:
    """The graph; edges have no labels.  ``prefix`` is the files' common path without ``_deg.bin``."""
    width, n, _ = _ints(prefix, "deg", 0, 3).tolist()
    if width != 4:
        raise ValueError(f"{prefix}: integers of {width} bytes")
    blocks = max(1, -(-n // BLOCK))
    parts = spark.range(0, blocks, 1, blocks)

    def total(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                d = _ints(prefix, "deg", 3 + k * BLOCK, min(BLOCK, n - k * BLOCK))
                yield pa.RecordBatch.from_pydict({"block": [k], "n": [int(d.sum(dtype=np.int64))]})

    first, at = {}, 0
    for row in sorted(parts.mapInArrow(total, "block long, n long").collect()):  # one row for each block of vertices
        first[row.block] = at
        at += row.n

    def edges(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                count = min(BLOCK, n - k * BLOCK)
                degree, start = _ints(prefix, "deg", 3 + k * BLOCK, count), first[k]
                ends = np.cumsum(degree, dtype=np.int64)
                for a in range(0, count, 1 << 16):  # a bounded slice of vertices at a time
                    b = min(count, a + (1 << 16))
                    low = int(ends[a - 1]) if a else 0
                    dst = _ints(prefix, "adj", start + low, int(ends[b - 1]) - low)
                    src = np.repeat(np.arange(k * BLOCK + a, k * BLOCK + b, dtype=np.int64), degree[a:b])
                    yield pa.RecordBatch.from_pydict({"src": src, "dst": dst.astype(np.int64)})

    def vertices(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                label = _ints(prefix, "label", k * BLOCK, min(BLOCK, n - k * BLOCK))
                yield pa.RecordBatch.from_pydict({"id": np.arange(k * BLOCK, k * BLOCK + len(label), dtype=np.int64), "label": label.astype(np.int32)})

    return DataGraph.of(parts.mapInArrow(vertices, "id long, label int"), parts.mapInArrow(edges, "src long, dst long").where("src < dst"))


def write_csr(graph: DataGraph, prefix: str) -> None:
    """Writes the three files, streaming the vertices in order through the driver, one partition at a time.

    The vertices must be numbered from 0 without gaps.  For graphs beyond one machine's disk use Parquet instead.
    """
    adjacency = graph.edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))
    rows = graph.vertices.join(adjacency, graph.vertices.id == adjacency.src, "left").select("id", "label", F.coalesce("nbrs", F.array().cast("array<bigint>")).alias("nbrs")).orderBy("id")
    meta = graph.metadata().first()
    files, path = fs.FileSystem.from_uri(prefix if "://" in prefix else f"file://{prefix}")
    with files.open_output_stream(f"{path}_deg.bin") as deg, files.open_output_stream(f"{path}_adj.bin") as adj, files.open_output_stream(f"{path}_label.bin") as label:
        deg.write(np.array([4, meta.n_vertices, meta.n_edges], _INT).tobytes())
        for want, row in enumerate(rows.toLocalIterator()):
            if row.id != want:
                raise ValueError("vertices must be numbered from 0 without gaps")
            deg.write(np.array([len(row.nbrs)], _INT).tobytes())
            adj.write(np.array(row.nbrs, _INT).tobytes())
            label.write(np.array([row.label], _INT).tobytes())


def write_parquet(graph: DataGraph, path: str) -> None:
    """The canonical form: vertices by label, edges by label pair, sorted so that scans of a label skip row groups."""
    graph.vertices.sortWithinPartitions("label", "id").write.mode("overwrite").parquet(f"{path}/vertices")
    graph.edges.sortWithinPartitions("src_label", "dst_label", "src").write.mode("overwrite").parquet(f"{path}/edges")


def read_parquet(spark: SparkSession, path: str) -> DataGraph:
    return DataGraph(spark.read.parquet(f"{path}/vertices"), spark.read.parquet(f"{path}/edges"))


def convert(spark: SparkSession, text_path: str, prefix: str) -> None:
    """A text graph as binary CSR."""
    from sparkmatch.sources.text import read_graph

    write_csr(read_graph(spark, text_path), prefix)


