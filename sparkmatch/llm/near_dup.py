"""Operator 3: near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

Similarity.  A text is the multiset of its shingles of five words.  The weight of a shingle is its frequency in the
text times its inverse document frequency over all texts, ln(1 + N / df) in steps of 1 / STEPS.  Two texts are linked
when their weighted Jaccard similarity, sum of minima over sum of maxima, is 0.8 or more; classes are the connected
components of the links.  df is the exact number of rows whose text holds the shingle.

Plan.
1. One pass gives each row the id of its text (64 bits over its word sequence; equal texts are one vertex from here
   on), written to the shared folder.
2. One pass counts df: a task adds up its own shingles and deals them packed, by their upper bits, to parts of about
   PART_SHINGLES; a part returns the shingles of df > 1.  All others have df 1.
3. A bitmap over the shingles of df > 1 tells for certain of most others that no other row holds them.  Each has the
   greatest weight there is, so a text with less than four other elements to each of them is linked to no text.  The
   distinct texts that are left are stored, df > 1 is joined to their shingles, and each is sampled:
   for each of BANDS * ROWS hashes the element (shingle, n-th occurrence) of
   the least ln a of improved consistent weighted sampling; its gamma and uniform variates come from tables of 2 ** 16
   entries picked by a hash, ties going to the lesser hash of the element.  BANDS groups of ROWS samples are the bucket keys; a pair
   of similarity 0.8 shares none with a probability of 0.0004.
4. Each bucket's members are paired with its least member only, and verified; components of the links so far.
5. Buckets that still hold several components are compared in full across components, in square tiles of at most
   TILE members a side; a tile returns only links that join components, so no group is expanded into all its pairs.
6. Components again.  They are found by least-label propagation with pointer jumping, on tables in the shared folder.

No step collects rows to the driver or holds a bucket in one task; the driver sees the bitmap alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from . import shingles as S

THRESHOLD = (4, 5)  # similarity of 0.8 as a fraction, compared in integers
BANDS, ROWS = 20, 5
#: Least and most parts of the df count as powers of two, shingles of a part, and shingles that a task adds up at once.
PART_BITS = (8, 20)
PART_SHINGLES = 1 << 20
HELD_SHINGLES = 1 << 19
#: N / df is told apart up to this: everywhere.
CAP = math.inf
STEPS = 8
TILE = 128
#: Tasks among which the members of one bucket are dealt where they meet its row.
SPREAD = 16
#: Bits of the filter on shingles of df > 1 as powers of two, FILTER_LOAD for each shingle.  A fuller filter lets more
#: texts through, never fewer.
FILTER_BITS = (20, 30)
FILTER_LOAD = 8

_U = np.uint64


def _text_ids(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A 64-bit id of each word sequence."""
    up, _ = S._power(int(counts.max(initial=0)))
    begin = np.cumsum(counts) - counts
    place = np.arange(len(hashes)) - np.repeat(begin, counts)
    sums = np.append(_U(0), np.cumsum(S.mix(hashes * up[place])))
    return S.mix(sums[begin + counts] - sums[begin] + counts.astype(_U) * _U(0xA0761D6478BD642F))


def _elements(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted element hashes of a text's shingles, (shingle, n-th occurrence), and the shingle of each."""
    shingle = np.sort(own)
    first = np.append(True, shingle[1:] != shingle[:-1]) if len(shingle) else np.zeros(0, bool)
    nth = np.arange(len(shingle)) - np.maximum.accumulate(np.where(first, np.arange(len(shingle)), 0))
    element = np.where(nth == 0, shingle, S.mix(shingle + nth.astype(_U) * _U(0x9E3779B97F4A7C15)))
    order = np.argsort(element, kind="stable")
    return element[order], shingle[order]


def _bucket(shingle: np.ndarray) -> np.ndarray:
    """The key under which a shingle's df is counted: all its bits, signed as in Spark."""
    return shingle.view(np.int64)


class Weights:
    """Integer weights by document frequency, and the sampling tables.  Shingles that ``df`` leaves out have a df of 1."""

    def __init__(self, n: int, df: dict[int, int]):
        self.n, self.rare = n, self._step(n, 1)
        self.keys = np.array(list(df), np.int64).view(_U)
        self.df = np.array(list(df.values()), np.int64)
        self._tables = None

    @staticmethod
    def _step(n: int, df: int) -> int:
        return max(1, round(STEPS * float(np.log(1 + max(n, 1) / df))))

    def of(self, shingle: np.ndarray) -> np.ndarray:
        """Weight of each shingle by the df given."""
        if not len(self.keys):
            return np.full(len(shingle), self.rare, np.uint8)
        order = np.argsort(self.keys)
        keys = self.keys[order]
        level = np.maximum(1, np.rint(STEPS * np.log(1 + max(self.n, 1) / self.df[order]))).astype(np.uint8)
        at = np.minimum(np.searchsorted(keys, shingle), len(keys) - 1)
        return np.where(keys[at] == shingle, level[at], np.uint8(self.rare))

    def column(self, df: str) -> F.Column:
        """The same weight of a column of df above 1."""
        return F.greatest(F.lit(1.0), F.rint(F.lit(STEPS) * F.log(1 + F.lit(float(max(self.n, 1))) / F.col(df)))).cast("long")

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """ln a by weight and table entry as integers of the same order, and the odd factor of each hash."""
        if self._tables is None:
            rng = np.random.default_rng(20240229)
            r, c, beta = rng.gamma(2, 1, 1 << 16), rng.gamma(2, 1, 1 << 16), rng.random(1 << 16)
            code = np.empty((self.rare, 1 << 16), np.uint32)
            for w in range(self.rare):  # one weight at a time: the whole table in doubles would be many times its size
                t = np.floor(np.log((w + 1) / STEPS) / r + beta)
                bits = (np.log(c) - r * (t - beta) - r).astype(np.float32).view(np.uint32)
                code[w] = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))  # in the order of the numbers
            code = code.ravel()
            factors = S.mix(np.arange(1, BANDS * ROWS + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F)) | _U(1)
            self._tables = code, factors
        return self._tables

    def bands(self, element: np.ndarray, level: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bucket keys of each text; ``starts`` are the first elements of the texts, none of which is empty."""
        code, factors = self.tables()
        row = (level.astype(_U) - _U(1)) << _U(16)
        out = np.empty((len(starts), BANDS), np.int64)
        n, x, at = len(starts), np.empty_like(element), np.empty_like(element)
        for band in range(BANDS):
            key = np.full(n, band, _U)
            for k in range(band * ROWS, (band + 1) * ROWS):
                np.multiply(element, factors[k], out=x)
                np.right_shift(x, _U(48), out=at)
                at |= row
                least = code[at].astype(_U)
                least <<= _U(32)
                x >>= _U(32)
                least |= x
                key = S.mix(key * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(least, starts))
            out[:, band] = key.view(np.int64)
        return out


def _pieces(texts: list[str]):
    """(index of a text, its id, its shingles) of every text with a word."""
    for start, hashes, counts, own, n in S.blocks(texts):
        ids, ends = _text_ids(hashes, counts), np.cumsum(n)
        for i in np.flatnonzero(counts).tolist():
            yield start + i, int(ids[i].astype(np.int64)), own[ends[i] - n[i] : ends[i]]


def _keys(batches):
    """(doc_id, vid, number of distinct shingles) of each row."""
    C.claim("near_dup", lambda: None)
    for batch in batches:
        for part in C.blocks(batch, 1):
            vid: list = [None] * len(part)
            n = [0] * len(part)
            for i, key, own in _pieces([t or "" for t in part.column(1).to_pylist()]):
                vid[i], n[i] = key, len(own)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vid, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "vid", "n"])


def _counted(shingle: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in order and the sum of ``n``, or the number, of each; there must be one."""
    order = np.argsort(shingle)
    shingle = shingle[order]
    starts = np.flatnonzero(np.append(True, shingle[1:] != shingle[:-1]))
    return shingle[starts], np.diff(starts, append=len(shingle)) if n is None else np.add.reduceat(n[order], starts)


def _dealt(bits: int):
    """Rows (part, packed shingles, packed number of rows that hold each)."""

    def pack(held):
        shingle, n = _counted(np.concatenate(held))
        part = (shingle >> _U(64 - bits)).astype(np.int64)
        cut = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        ends = np.append(cut[1:], len(part))
        n = n.astype(np.uint32)
        at = list(zip(cut.tolist(), ends.tolist(), strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(part[cut], pa.int64()), pa.array([shingle[a:b].tobytes() for a, b in at], pa.binary()), pa.array([n[a:b].tobytes() for a, b in at], pa.binary())], names=["part", "s", "n"]
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in C.blocks(batch, 0):
                for _, _, own in _pieces([t or "" for t in part.column(0).to_pylist()]):
                    held.append(np.unique(own))
                    size += len(held[-1])
                    if size >= HELD_SHINGLES:
                        yield pack(held)
                        held, size = [], 0
        if held:
            yield pack(held)

    return run


def _shared(rows: pa.Table) -> pa.Table:
    """(shingle, df) of the shingles of one part with a df above 1."""
    shingle, df = _counted(np.concatenate([np.frombuffer(x, _U) for x in rows["s"].to_pylist()]), np.concatenate([np.frombuffer(x, np.uint32) for x in rows["n"].to_pylist()]).astype(np.int64))
    more = df > 1
    return pa.table([pa.array(_bucket(shingle[more]), pa.int64()), pa.array(df[more], pa.int64())], names=["shingle", "df"])


def _held(bits: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    """Whether the filter has the bit of each shingle; where not, its df is 1."""
    at = shingle & _U(8 * len(bits) - 1)
    return (bits[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)


def _linkable(shipped):
    """(vid, packed shingles with repetitions) of the texts that may be linked to another."""
    p, q = THRESHOLD

    def run(batches):
        bits = np.frombuffer(shipped.value, np.uint8)
        seen: set[int] = set()
        for batch in batches:
            for part in C.blocks(batch, 0, 4 << 20):
                out: list[tuple] = []
                for _, vid, own in _pieces([t or "" for t in part.column(0).to_pylist()]):
                    if vid in seen:
                        continue
                    rest = int(_held(bits, own).sum())
                    if (q - p) * rest >= p * (len(own) - rest):
                        if len(seen) < 200_000:
                            seen.add(vid)
                        out.append((vid, own.tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["vid", "s"])

    return run


def _exploded(shipped):
    """(vid, shingle, at) of each distinct shingle that may have a df above 1; at is its place among the text's."""

    def run(batches):
        bits = np.frombuffer(shipped.value, np.uint8)
        for batch in batches:
            for part in C.blocks(batch, 1, 4 << 20):
                own = [np.unique(np.frombuffer(x, _U)) for x in part.column(1).to_pylist()]
                sizes = np.array([len(x) for x in own])
                vid = np.repeat(part.column(0).to_numpy(), sizes)
                at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                shingle = np.concatenate(own)
                keep = _held(bits, shingle)
                yield pa.RecordBatch.from_arrays([pa.array(vid[keep], pa.int64()), pa.array(_bucket(shingle[keep]), pa.int64()), pa.array(at[keep], pa.int64())], names=["vid", "shingle", "at"])

    return run


def _sampler(shipped):
    """(vid, total, keys, e, w) of rows (vid, s, known): total weight, bucket keys, elements and their weights.

    ``known`` has, for each shingle of df above 1, its place among the text's shingles and its weight in the low 8 bits.
    """
    p, q = THRESHOLD

    def run(batches):
        C.claim("near_dup", lambda: None)
        weights = shipped.value
        for batch in batches:
            for part in C.blocks(batch, 1, 2 << 20):
                ends = np.cumsum(pc.list_value_length(part.column(2)).to_numpy())
                known = part.column(2).flatten().to_numpy()
                fresh, start = [], 0
                for vid, s, end in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), ends.tolist(), strict=True):
                    own = np.frombuffer(s, _U)
                    element, shingle = _elements(own)
                    distinct = np.unique(own)
                    weight = np.full(len(distinct), weights.rare, np.uint8)
                    rest = np.zeros(len(distinct), bool)
                    at = known[start:end] >> 8
                    weight[at], rest[at] = known[start:end] & 255, True
                    of = np.searchsorted(distinct, shingle)
                    level = weight[of]
                    start, total = end, int(level.sum(dtype=np.int64))
                    if q * int(level[rest[of]].sum(dtype=np.int64)) >= p * total:
                        fresh.append((vid, total, element, level))
                if not fresh:
                    continue
                sizes = [len(e) for *_, e, _ in fresh]
                keys = weights.bands(np.concatenate([e for *_, e, _ in fresh]), np.concatenate([w for *_, w in fresh]), np.cumsum(sizes) - sizes)
                flat = pa.array(keys.ravel(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in fresh], pa.int64()),
                        pa.array([x[1] for x in fresh], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), flat),
                        pa.array([x[2].tobytes() for x in fresh], pa.binary()),
                        pa.array([x[3].tobytes() for x in fresh], pa.binary()),
                    ],
                    names=["vid", "total", "keys", "e", "w"],
                )

    return run


def linked(common, a, b):
    """Whether a common weight makes two texts of the given total weights similar enough; for numbers or arrays."""
    return THRESHOLD[1] * common >= THRESHOLD[0] * (a + b - common)


def _verify(batches):
    """Pairs (a, b) that are linked, of rows (a, b, ea, wa, eb, wb)."""
    for batch in batches:
        keep = []
        for i in range(len(batch)):  # row by row: a batch of long texts is not copied as a whole
            ea, wa, eb, wb = (np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in ((2, _U), (3, np.uint8), (4, _U), (5, np.uint8)))
            at = np.minimum(np.searchsorted(ea, eb), len(ea) - 1)
            if linked(int(wb[ea[at] == eb].sum(dtype=np.int64)), int(wa.sum(dtype=np.int64)), int(wb.sum(dtype=np.int64))):
                keep.append(i)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])


def common_weights(elements: list[np.ndarray], weights: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Common weight of every two texts of a tile, by products of bounded slices of their incidence matrix."""
    n = len(elements)
    owner = np.repeat(np.arange(n), [len(e) for e in elements])
    _, column, count = np.unique(np.concatenate(elements), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column, weight = owner[shared], column[shared], np.concatenate(weights)[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column, weight = owner[order], column[order], weight[order]
    out = np.zeros((n, n))
    for start in range(0, int(column.max(initial=-1)) + 1, columns):
        a, b = np.searchsorted(column, (start, start + columns))
        slice_ = np.zeros((n, columns), np.float32)
        by_weight = np.zeros((n, columns), np.float32)
        slice_[owner[a:b], column[a:b] - start] = 1
        by_weight[owner[a:b], column[a:b] - start] = weight[a:b]
        out += by_weight @ slice_.T
    return np.rint(out).astype(np.int64)


def _tile(rows: pa.Table) -> pa.Table:
    """Links across the components of one tile: enough to join whatever any link of the tile joins."""
    a, b = [], []
    comp = rows["comp"].to_pylist()
    if len(set(comp)) > 1:
        side = np.array(rows["side"].to_pylist())
        vid = rows["vid"].to_pylist()
        elements = [np.frombuffer(x, _U) for x in rows["e"].to_pylist()]
        weights = [np.frombuffer(x, np.uint8) for x in rows["w"].to_pylist()]
        total = np.array([int(w.sum(dtype=np.int64)) for w in weights])
        near = linked(common_weights(elements, weights), total[:, None], total[None, :])
        if rows["i"][0].as_py() != rows["j"][0].as_py():
            near &= side[:, None] != side[None, :]  # pairs of one side are met in its own tile
        root = {c: c for c in comp}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        for x, y in zip(*(v.tolist() for v in np.nonzero(np.triu(near, 1))), strict=True):
            u, v = find(comp[x]), find(comp[y])
            if u != v:
                root[u] = v
                a.append(vid[x])
                b.append(vid[y])
    return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def components(links: DataFrame, store: C.Store) -> DataFrame:
    """(v, comp) of every vertex in a link (a, b); comp is the least vertex of its component.  Links may repeat."""
    pairs = links.where("a <> b")
    edges = store.put(pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = store.put(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).select(F.col("a").alias("v"), "comp"))
    while True:
        around = edges.join(labels, edges.b == labels.v).groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(around, labels.v == around.a).select("v", "comp", F.least("comp", "near").alias("low"))
        # pointer jumping: a label's own label is no larger
        over = labels.select(F.col("v").alias("low"), F.col("comp").alias("jump"))
        new = store.put(step.join(over, "low", "left").select("v", F.col("comp").alias("old"), F.least("low", F.coalesce("jump", "low")).alias("comp")))
        labels = new.select("v", "comp")
        if not new.where("comp <> old").limit(1).count():
            return labels


def _solve(docs: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, DataFrame, C.Store]:
    """(doc_id, vid) of each row, vid null for a text without a word; (vid, comp, least doc_id) of each text; their store."""
    spark = docs.sparkSession
    C.prepare(spark)
    store = C.Store(spark, "near-dup")
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    texts = source.select("text")
    rows = store.put(source.mapInArrow(_keys, "doc_id long, vid long, n long"), "rows")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows = rows.select("doc_id", "vid")
    weights = Weights(n, {})
    shipped = spark.sparkContext.broadcast(weights)

    bits = _bits(total / PART_SHINGLES, PART_BITS)
    shared = store.put(texts.mapInArrow(_dealt(bits), "part long, s binary, n binary").groupBy("part").applyInArrow(_shared, "shingle long, df long"))
    size = 1 << _bits(shared.count() * FILTER_LOAD, FILTER_BITS)
    bit = F.pmod("shingle", F.lit(size)) + 1
    maps = shared.groupBy(F.bitmap_bucket_number(bit).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m")).collect()  # size / 8 bytes
    filled = spark.sparkContext.broadcast(_bitmap(maps, size))
    linkable = store.put(texts.mapInArrow(_linkable(filled), "vid long, s binary").dropDuplicates(["vid"]))
    parts_of = linkable.mapInArrow(_exploded(filled), "vid long, shingle long, at long").join(shared, "shingle")
    known = parts_of.select("vid", F.shiftleft("at", 8).bitwiseOR(weights.column("df")).alias("known")).groupBy("vid").agg(F.collect_list("known").alias("known"))
    samples = store.put(linkable.join(known, "vid").select("vid", "s", "known").mapInArrow(_sampler(shipped), "vid long, total long, keys array<long>, e binary, w binary"))
    unpacked = samples.select("vid", "e", "w")
    member = samples.select(F.explode("keys").alias("key"), "vid", "total").distinct()
    buckets = store.put(
        member.groupBy("key").agg(F.min(F.struct("vid", "total")).alias("head"), F.count("*").alias("size")).where("size > 1")
    )
    held = store.put(member.join(buckets, "key").select("key", "vid", "total", F.col("head.vid").alias("head"), F.col("head.total").alias("head_total"), "size"))
    # a lighter text of less than 0.8 of the heavier one's weight cannot be linked to it
    p, q = THRESHOLD
    light = F.least("total", "head_total") * q >= F.greatest("total", "head_total") * p
    pairs = store.put(held.where((F.col("vid") != F.col("head")) & light).select(F.col("head").alias("a"), F.col("vid").alias("b")).distinct())
    side = lambda v: unpacked.select(F.col("vid").alias(v), F.col("e").alias(f"e{v}"), F.col("w").alias(f"w{v}"))
    links = store.put(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ea", "wa", "eb", "wb").mapInArrow(_verify, "a long, b long"))

    comp = components(links, store)
    placed = held.where("size > 2").join(comp, held.vid == comp.v, "left").select("key", "vid", F.coalesce("comp", "vid").alias("comp"))
    open_ = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi")
    parts = F.ceil(F.col("m") / TILE).cast("int")
    # a hot key's members meet its row in SPREAD tasks, and its tiles are dealt one by one
    salted = placed.withColumn("salt", F.pmod(F.xxhash64(F.lit(1), "vid"), F.lit(SPREAD)))
    open_ = open_.select("key", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("salt"))
    left = salted.join(open_, ["key", "salt"]).withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int"))
    # a member goes to the tiles of its part with every part
    tiles = left.select("key", "vid", "comp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    tiles = tiles.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "vid", "comp")
    several = tiles.groupBy("key", "i", "j").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key", "i", "j")
    tiles = tiles.join(several, ["key", "i", "j"], "left_semi").join(unpacked, "vid")
    more = store.put(tiles.groupBy("key", "i", "j").applyInArrow(_tile, "a long, b long"))
    comp = components(links.unionAll(more), store)

    class_of = rows.where("vid is not null").groupBy("vid").agg(F.min("doc_id").alias("least")).join(comp, F.col("vid") == F.col("v"), "left")
    class_of = store.put(class_of.select("vid", F.coalesce("comp", "vid").alias("comp"), "least"), "texts")
    store.drop_all_but("rows", "texts")
    return rows, class_of, store


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (doc_id, class_id) for each row of ``docs``; class_id is the least doc_id of the row's class.

    Texts without a word (null, empty, marks only) are in a class of their own each.  Texts of the same words are
    one class.  Rows with a null doc_id get the class of their text, which is null if no other row has an id.
    Repeated rows are returned as often.  Other columns are not read.  An empty table gives an empty result.
    """
    rows, class_of, store = _solve(docs, doc_id, text)
    ids = store.put(class_of.groupBy("comp").agg(F.min("least").alias("class_id")), "ids")
    by_text = class_of.join(ids, "comp").select("vid", "class_id")
    alone = rows.where("vid is null").select("doc_id", F.col("doc_id").alias("class_id"))
    return rows.where("vid is not null").join(by_text, "vid").select("doc_id", "class_id").unionAll(alone)


def _bits(least: float, bounds: tuple[int, int]) -> int:
    """The power of two that reaches ``least``, within bounds."""
    return min(max(math.ceil(math.log2(max(least, 1))), bounds[0]), bounds[1])


def _bitmap(maps: list, size: int) -> bytes:
    """The whole filter; bucket k of Spark's bitmap functions, counted from 1, holds 32,768 bits."""
    out = bytearray(size // 8)
    for row in maps:
        start = (row.k - 1) * 4096
        out[start : start + 4096] = row.m
    return bytes(out)


def _vid(texts: list) -> dict:
    out: list = [None] * len(texts)
    for i, key, _ in _pieces([t or "" for t in texts]):
        out[i] = key
    return {"__vid": out}


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without all but one of each class: a row of the least doc_id stays, null ids counting last.

    A row, not an id, is kept or goes: rows that share a doc_id but not a class are judged apart, and of rows with
    the same id (or none) and the same words one stays.  Texts without a word duplicate nothing: all of them stay.
    All columns are returned.  An empty table gives an empty result.
    """
    rows, class_of, store = _solve(docs, doc_id, text)
    one = rows.where("vid is not null").distinct().join(class_of.select("vid", "comp"), "vid")
    best = one.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "vid")).alias("k"))
    kept = store.put(best.select(F.col("k.doc_id").alias("__id"), F.col("k.vid").alias("__of")), "kept")
    # an id of one row decides by itself; only rows of other ids are told apart by their texts
    repeated = store.put(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select(F.col("doc_id").alias("__id")), "repeated")
    mine = F.col(f"`{doc_id}`").cast("long")
    alone = kept.select("__id").unionAll(rows.where("vid is null").select(F.col("doc_id").alias("__id"))).join(repeated, "__id", "left_anti")
    out = docs.join(alone, mine == F.col("__id"), "left_semi")
    if not repeated.limit(1).count():
        return out
    several = C.add_columns(docs.join(repeated, mine.eqNullSafe(F.col("__id")), "left_semi"), text, C.fields("__vid long"), lambda: _vid)
    held = several.join(kept, mine.eqNullSafe(F.col("__id")) & (F.col("__vid") == F.col("__of")), "left_semi").dropDuplicates([doc_id, "__vid"])
    names = [F.col(f"`{c}`") for c in docs.columns]
    return out.unionAll(held.select(*names)).unionAll(several.where("__vid is null").select(*names))
