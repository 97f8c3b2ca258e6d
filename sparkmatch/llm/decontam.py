"""Operator 6: benchmark decontamination by size-partitioned MinHash containment search.

Items of at most ``SHORT`` shingles are too small a part of any window for MinHash: each of their shingles is looked up
by itself, so every document that holds one is a candidate.  The others are partitioned by their number of distinct
shingles into classes (u/2, u] for powers of two u.  For a class the
documents are cut into blocks of u shingles and searched through windows of two blocks, so every run of u shingles lies
inside a window.  An item that a window holds has a Jaccard similarity of about 0.2 or more to it however long the
document is, and one common MinHash value out of ``HASHES`` makes the pair of item and document a candidate: a
containment of 0.8 in one window is missed with a probability below 1e-5.  A window's MinHash is the lesser of its
two blocks' and a block's that of its two halves, so one pass with the smallest block serves all classes.

A candidate is verified by exact shingle containment: the share of the item's distinct shingles which the whole
document holds must be ``THRESHOLD`` or more.

The benchmark side is the query set; it is broadcast only if it has at most ``BROADCAST_ITEMS`` items of at most
``BROADCAST_CHARS`` characters together.  A larger one is cut into groups below that bound by a hash of the item,
and the documents are read once for each group.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from . import shingles as S

THRESHOLD = 0.8
HASHES = 64
#: Shingles of the smallest class, and the most of an item that is looked up exactly.
SMALLEST = 16
SHORT = SMALLEST // 2
BROADCAST_ITEMS = 20_000
BROADCAST_CHARS = 16_000_000

_SEEDS = S.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _minhash(values: np.ndarray, seed: np.uint64) -> np.ndarray:
    """The upper half of a product with an odd factor, as 32 bits."""
    return (values * seed >> np.uint64(32)).astype(np.uint32)


def _matches(values: np.ndarray, items: np.ndarray, asked: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """Pairs (owner of an asked value, item) of the equal ones among the sorted values; in one array, or none."""
    a = np.searchsorted(values, asked, "left")
    hit = np.flatnonzero(values[np.minimum(a, len(values) - 1)] == asked)
    if not len(hit):
        return []
    n = np.searchsorted(values, asked[hit], "right") - a[hit]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a[hit], n)
    return [np.stack([np.repeat(owner[hit], n), items[at]], 1)]


@dataclass
class Index:
    """MinHash values of the items by class and hash, and their exact shingles."""

    ids: list[int]
    shingles: list[np.ndarray]
    #: (class size u, for each hash the sorted values and the item of each)
    classes: list[tuple[int, list[tuple[np.ndarray, np.ndarray]]]]
    #: the sorted shingles of the items of at most SHORT, and the item of each
    short: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def build(items: list[tuple[int, str]]) -> Index:
        ids, sets, by, few = [], [], {}, []
        for item, text in sorted(items, key=lambda x: x[0]):
            own = np.unique(S.shingles(text))
            if not len(own):
                continue
            u = SMALLEST
            while u < len(own):
                u *= 2
            (few if len(own) <= SHORT else by.setdefault(u, [])).append(len(ids))
            ids.append(item)
            sets.append(own)
        classes = []
        for u, members in sorted(by.items()):
            tables = []
            for seed in _SEEDS:
                value = np.array([_minhash(sets[m], seed).min() for m in members], np.uint32)
                order = np.argsort(value, kind="stable")
                tables.append((value[order], np.array(members)[order]))
            classes.append((u, tables))
        value = np.concatenate([np.zeros(0, np.uint64), *(sets[m] for m in few)])
        order = np.argsort(value, kind="stable")
        return Index(ids, sets, classes, (value[order], np.repeat(np.array(few, np.int64), [len(sets[m]) for m in few])[order]))

    def candidates(self, own: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Pairs (position of the text, item) of which some window shares a MinHash value, or the text a shingle of a short item; all texts of a block at once."""
        begin = np.cumsum(counts) - counts
        n_blocks = -(-counts // SMALLEST)
        # starts of the smallest blocks; none spans two texts
        first = np.repeat(begin, n_blocks) + SMALLEST * (np.arange(int(n_blocks.sum())) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks))
        owner = np.repeat(np.arange(len(counts)), n_blocks)
        found = []
        if not len(first):
            return np.zeros((0, 2), np.int64)
        if len(self.short[0]):
            found += _matches(*self.short, own, np.repeat(np.arange(len(counts)), counts))
        plan = self._plan(owner)
        for k, seed in enumerate(_SEEDS if self.classes else []):
            low = np.minimum.reduceat(_minhash(own, seed), first)
            for (u, tables), (grid, pair) in zip(self.classes, plan, strict=True):
                block = np.minimum.reduceat(low, grid) if u > SMALLEST else low
                window = np.where(pair, np.minimum(block, np.append(block[1:], block[-1:])), block)
                found += _matches(*tables[k], window, owner[grid])
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def _plan(self, owner: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each class: the smallest blocks at which its blocks start, and whether the next is of the same text."""
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        out = []
        for u, _ in self.classes:
            grid = np.flatnonzero(place % (u // SMALLEST) == 0)
            same = np.append(owner[grid][1:] == owner[grid][:-1], False)
            out.append((grid, same))
        return out

    def search(self, texts: list[str], threshold: float) -> list[tuple[int, int, int, int]]:
        """(position of the text, item id, shingles found, shingles of the item) of every verified pair."""
        out = []
        for start, _, _, own, counts in S.blocks(texts):
            ends = np.cumsum(counts)
            pairs = self.candidates(own, counts)
            for text in np.unique(pairs[:, 0]).tolist():
                held = np.unique(own[ends[text] - counts[text] : ends[text]])
                for item in pairs[pairs[:, 0] == text, 1].tolist():
                    want = self.shingles[item]
                    at = np.minimum(np.searchsorted(held, want), len(held) - 1)
                    hits = int((held[at] == want).sum())
                    if hits >= threshold * len(want):
                        out.append((start + text, self.ids[item], hits, len(want)))
        return out


def _groups(benchmark: DataFrame) -> list[DataFrame]:
    """The items with an id and a text, in groups below the broadcast bound."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0))).first()
    parts = max(1, -(-n // BROADCAST_ITEMS), -(-chars // BROADCAST_CHARS))
    return [items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == i) for i in range(parts)] if parts > 1 else [items]


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document and item of which the document holds a share of ``threshold`` or more of the shingles.

    Returns doc_id, item_id, n_found, n_shingles, containment.  Texts without a word, null or empty, hold nothing and are held by
    nothing.  Repeated documents each give their rows; an item id with several texts counts as several items.
    No shuffle of documents; their order does not matter.
    """
    spark = docs.sparkSession
    C.prepare(spark)
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    out = None
    for group in _groups(benchmark):
        items = [(r.item_id, r.text) for r in group.collect()]  # at most the broadcast bound
        shipped = spark.sparkContext.broadcast(Index.build(items))

        def run(batches, shipped=shipped):
            C.claim("decontam", lambda: None)
            index = shipped.value
            for batch in batches:
                for part in C.blocks(batch, 1):
                    ids = part.column(0).to_pylist()
                    got = index.search([t or "" for t in part.column(1).to_pylist()], threshold)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[i] for i, *_ in got], pa.int64()),
                            pa.array([x[1] for x in got], pa.int64()),
                            pa.array([x[2] for x in got], pa.int64()),
                            pa.array([x[3] for x in got], pa.int64()),
                            pa.array([x[2] / x[3] for x in got], pa.float64()),
                        ],
                        names=["doc_id", "item_id", "n_found", "n_shingles", "containment"],
                    )

        found = source.mapInArrow(run, "doc_id long, item_id long, n_found long, n_shingles long, containment double")
        out = found if out is None else out.unionAll(found)
    return out


def flag(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text: str = "text", out: str = "n_items") -> DataFrame:
    """Adds to every row of ``docs`` the number of items that its text holds.  No shuffle."""
    spark = docs.sparkSession
    C.prepare(spark)
    for i, group in enumerate(_groups(benchmark)):
        shipped = spark.sparkContext.broadcast(Index.build([(r.item_id, r.text) for r in group.collect()]))
        name = out if i == 0 else f"__{out}_{i}"

        def make(shipped=shipped, name=name):
            C.claim("decontam", lambda: None)

            def block(texts):
                count = np.zeros(len(texts), np.int64)
                for at, *_ in shipped.value.search([t or "" for t in texts], threshold):
                    count[at] += 1
                return {name: count}

            return block

        docs = C.add_columns(docs, text, C.fields(f"`{name}` long"), make)
        if i:
            docs = docs.withColumn(out, F.col(out) + F.col(name)).drop(name)
    return docs
