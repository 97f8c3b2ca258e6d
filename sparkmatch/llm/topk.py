"""Operator 2: exact top-k search by inner product over an impact-ordered, score-at-a-time index.

Rows are dealt into index blocks of about ``BLOCK_ROWS`` and queries into blocks of about ``QUERY_ROWS``; each pair
of blocks meets in one group of a cogroup, so a task holds one block of either side whatever the number of rows or
queries, and nothing is broadcast or collected.

In a block each dimension's postings are cut into ``LEVELS`` segments by quantised value; a query's segments, taken
over all dimensions, are ordered by descending impact: the most that a posting of the segment can add above the
least value of its dimension.  Segments are processed in that order.  A row's accumulator is a lower bound of its
score; adding, for each dimension not yet seen, the most that the unprocessed segments still hold gives an upper
bound.  The search of a block stops only when no more than a few rows have an upper bound of at least the k-th
largest lower bound, which proves that all others are out, or when all segments are done.  Those possible members
are scored exactly, in integers.  The k best of each block meet per query in one ranked window, which keeps only k
rows of a query in each task before its shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

BLOCK_ROWS = 8192
QUERY_ROWS = 4096
LEVELS = 4
#: Times that the search asks whether to stop, rows that it asks of, and postings as dear as one component scored exactly.
LOOKS, ASKED = 8, 256
DEAR = 1.5
#: Rows beside k that are scored exactly for the threshold.
SEEDS = 32


def quantised(column: str) -> F.Column:
    """floor(1024 * x) of each component, as long."""
    return F.transform(F.col(column), lambda x: F.floor(F.lit(1024.0) * x.cast("double")).cast("long"))


def usable(column: str) -> F.Column:
    """Whether a vector is not null and holds only finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(float("inf")))
    return F.col(column).isNotNull() & ~F.exists(F.col(column), bad)


class ImpactIndex:
    """Postings of one block by dimension and quantised value."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        n, d = rows.shape
        low, high = rows.min(0), rows.max(0)
        step = np.maximum(1, -(-(high - low + 1) // LEVELS))
        self.level = ((rows - low) // step).astype(np.int8)
        self.cell = self.level.astype(np.intp) + np.arange(d) * LEVELS
        self.order = np.argsort(self.level.T, axis=1, kind="stable")
        self.values = np.take_along_axis(rows.T, self.order, 1).astype(np.float32)
        counts = np.stack([(self.level == k).sum(0) for k in range(LEVELS)], 1)
        self.starts = np.concatenate([np.zeros((d, 1), np.int64), counts.cumsum(1)], 1)
        #: A segment that holds many of the block's rows is kept as a vector over all rows, 0 where the row is not in it;
        #: what a posting adds is counted from the least value of its dimension, or from the largest for negative weights.
        self.full: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for f, k in zip(*(x.tolist() for x in np.nonzero(counts > n / 10)), strict=True):
            inside, column = self.level[:, f] == k, rows[:, f]
            self.full[f, k] = tuple(np.where(inside, column - bound, 0).astype(np.float32) for bound in (low[f], high[f]))
        # least and largest value of each segment; an empty one takes its neighbours' bounds
        self.low = np.minimum(low[:, None] + step[:, None] * np.arange(LEVELS), high[:, None]).astype(float)
        self.high = np.minimum(low[:, None] + step[:, None] * np.arange(1, LEVELS + 1) - 1, high[:, None]).astype(float)

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Row positions and exact scores of the k best rows whose id is not ``own``; fewer if there are fewer."""
        n, d = self.rows.shape
        q = query.astype(float)
        up = q >= 0
        floor = np.where(up, q * self.low[:, 0], q * self.high[:, -1])
        most = np.where(up[:, None], q[:, None] * self.high, q[:, None] * self.low)  # of each segment
        gain = most - floor[:, None]
        bounds = np.full(n, floor.sum(), np.float32)
        mine = self.ids == own
        bounds[mine] = -np.inf
        if n - mine.sum() <= k + SEEDS:
            return self._rescore(np.flatnonzero(~mine), query, k)
        dims, levels = np.divmod(np.argsort(-gain, axis=None, kind="stable"), LEVELS)
        looks = {len(dims) * i // LOOKS - 1 for i in range(3, LOOKS)}
        left_over = np.cumsum((self.starts[dims, levels + 1] - self.starts[dims, levels])[::-1])[::-1]
        sample = np.arange(0, n, max(1, n // ASKED))
        slackness = 1 + np.abs(most).sum() * d * 2.0**-22  # covers the rounding of the accumulators
        # levels of a dimension come in order, from the top for a positive weight and from the bottom for a negative one
        weight, base = q.astype(np.float32), floor.astype(np.float32)
        scratch, done = np.empty(n, np.float32), np.zeros(d, np.int64)
        members = np.flatnonzero(~mine)
        for s, (f, level) in enumerate(zip(dims.tolist(), levels.tolist(), strict=True)):
            a, b = self.starts[f, level], self.starts[f, level + 1]
            if (f, level) in self.full:
                np.multiply(self.full[f, level][0 if up[f] else 1], weight[f], out=scratch)
                bounds += scratch
            elif b > a:
                at = self.order[f, a:b]
                bounds[at] += weight[f] * self.values[f, a:b] - base[f]
            done[f] += 1
            if s in looks:
                open_ = done < LEVELS
                nxt = np.where(up, LEVELS - 1 - done, done)
                left = np.where(open_, gain[np.arange(d), np.clip(nxt, 0, LEVELS - 1)], 0.0)
                step = np.arange(LEVELS)
                unseen = (np.where(up[:, None], step <= nxt[:, None], step >= nxt[:, None]) * left[:, None]).astype(np.float32).ravel()
                # the rows of the largest lower bounds, scored exactly, give a score that k rows are known to reach
                top = np.argpartition(bounds, n - k - SEEDS)[n - k - SEEDS :]
                kth = float(np.partition(self._exact(top[~mine[top]], query), -k)[-k]) - slackness
                few = bounds[sample] + unseen[self.cell[sample]].sum(1) >= kth
                if few.mean() * n * d * DEAR < left_over[s + 1]:
                    members = np.flatnonzero(bounds + unseen[self.cell].sum(1) >= kth)
                    break
        else:
            kth = np.partition(bounds, n - k)[n - k]
            members = np.flatnonzero(bounds + slackness >= kth)
        return self._rescore(members[~mine[members]], query, k)

    def _exact(self, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        rows = self.rows[at]
        if len(at) and float(np.abs(rows).max()) * float(np.abs(query).max()) * len(query) >= 2.0**62:
            exact = rows.astype(object) @ query.astype(object)  # beyond 64 bits: exact, then held to the range of long
            return np.array([min(max(int(x), -(2**63)), 2**63 - 1) for x in exact], np.int64)
        return rows @ query

    def _rescore(self, at: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        scores = self._exact(at, query)
        best = np.lexsort((self.ids[at], -scores.astype(object) if len(scores) and scores.min() == -(2**63) else -scores))[:k]
        return at[best], scores[best]


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = vectors.combine_chunks()
    lengths = np.diff(flat.offsets.to_numpy()) if len(flat) else np.zeros(0, int)
    out = np.zeros((len(flat), width), np.int64)
    at = np.arange(width) < lengths[:, None]
    out[at] = flat.flatten().to_numpy(zero_copy_only=False)
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best rows of ``vectors`` for each row of ``queries``: query_id, rank (from 1), the id and score.

    Score: inner product of floor(1024 * x); ties go to the smaller id.  A row is no candidate of a query with its own
    id.  Rows with a null id, and vectors that are null or hold null or non-finite numbers, take no part.  Missing
    components of a shorter vector count as 0.  Repeated rows of an id each are candidates; a repeated query id is
    answered once, for its smallest vector.  No rows or no queries give an empty result.
    """
    spark = vectors.sparkSession
    C.prepare(spark)
    ok = lambda df: df.where(usable(vector) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), quantised(vector).alias("v"))
    rows, asked = ok(vectors), ok(queries).groupBy("id").agg(F.min("v").alias("v"))
    n_rows, n_asked = vectors.count(), queries.count()
    row_blocks, query_blocks = max(1, -(-n_rows // BLOCK_ROWS)), max(1, -(-n_asked // QUERY_ROWS))
    # the product of the two is the number of groups: all rows must meet all queries, block by block
    deal = lambda df, own, n_own, other, n_other: df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(n_own))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))))
    left = deal(rows, "rb", row_blocks, "qb", query_blocks).groupBy("rb", "qb")
    right = deal(asked, "qb", query_blocks, "rb", row_blocks).groupBy("rb", "qb")
    names = ["query_id", "vec_id", "score"]

    def meet(cands: pa.Table, asks: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(cands) and len(asks):
            width = max(int(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max()) for t in (cands, asks))
            index = ImpactIndex(cands["id"].to_numpy(), _matrix(cands["v"], width)) if width else None
            ids = cands["id"].to_numpy()
            for own, query in zip(asks["id"].to_pylist(), _matrix(asks["v"], width), strict=True):
                if index:
                    at, scores = index.search(query, own, k)
                else:
                    at = np.argsort(np.where(ids == own, np.iinfo(np.int64).max, ids), kind="stable")[: min(k, int((ids != own).sum()))]
                    scores = np.zeros(len(at), np.int64)
                out[0] += [own] * len(at)
                out[1] += ids[at].tolist()
                out[2] += scores.tolist()
        return pa.table([pa.array(x, pa.int64()) for x in out], names=names)

    found = left.cogroup(right).applyInArrow(meet, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
