"""Operator 1: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Each match of the split pattern is merged on its own.  The queue of a run of merges has one bucket per merge rank;
a bucket lists the positions (of a doubly linked list over the bytes) at which a pair of that rank was seen.  A
three-level bitmap over the ranks says which buckets are filled, so the next rank is three find-first-set steps away
whatever the length of the pre-token.  A bucket's entry is stale when its position is gone or now begins another
pair; stale entries are skipped.  Total work is O(n) bucket entries for n bytes, so a pre-token of a million bytes
costs the same per byte as a short one.

One queue serves all pre-tokens of a block: they lie in one list with cuts between them, so the buckets of a rank are
merged for all of them at once, and a merge that makes a pair of a lower rank sends the queue back to that rank.

Results do not depend on batches, and equal pre-tokens are encoded once per worker while the bounded cache has room.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
from array import array
from collections.abc import Callable
from functools import cache, partial

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Pre-tokens whose codes a worker keeps at most; later ones are encoded again when they come again.
CACHE_ENTRIES = 250_000
#: A pre-token of more bytes than this is never cached.
CACHE_BYTES = 64


#: Runs of more bytes keep list and buckets as 32-bit integers: slower to read, but a tenth of the memory.
LISTED = 1 << 20


def _packed(a: np.ndarray) -> array:
    return array("i", a.astype(np.int32).tobytes())


class RankQueue:
    """Buckets of list positions by merge rank, and a bitmap of three levels that finds the lowest filled rank."""

    def __init__(self, ranks: int, make: Callable = list):
        self.make = make
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int] | array] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.fill(rank, self.make((position,)))
        else:
            bucket.append(position)

    def fill(self, rank: int, bucket: list[int]) -> None:
        """Gives an empty rank its bucket."""
        self.buckets[rank] = bucket
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest filled rank with its bucket, which is emptied; None when nothing is left."""
        if not self.top:
            return None
        t = (self.top & -self.top).bit_length() - 1
        m = self.mid[t]
        i = t << 6 | (m & -m).bit_length() - 1
        w = self.low[i]
        rank = i << 6 | (w & -w).bit_length() - 1
        self.low[i] = w & (w - 1)
        if not self.low[i]:
            self.mid[t] = m & (m - 1)
            if not self.mid[t]:
                self.top &= self.top - 1
        return rank, self.buckets.pop(rank)


class ByteBPE:
    """A rank vocabulary: token bytes to rank, the rank being the id.  Every single byte must be a token."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.n = max(ranks.values()) + 1
        self.bytes = [b""] * self.n
        for token, rank in ranks.items():
            self.bytes[rank] = token
        self.decimal = list(map(str, range(self.n)))
        self.code = np.uint16 if self.n <= 1 << 16 else np.uint32
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: Rank of the token that two adjacent ids make, by left << 20 | right.
        self.pairs = {
            ranks[token[:i]] << 20 | ranks[token[i:]]: rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        self.byte_pairs = np.array([[ranks.get(bytes((a, b)), -1) for b in range(256)] for a in range(256)], np.int32)
        self.split = Splitter(pattern)
        self.cache: dict[str, bytes] = {}

    def encode_many(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each pre-token, by one rank queue over all of them."""
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(raw)
        if not n:
            return [np.zeros(0, self.code) for _ in pieces]
        ends = np.cumsum([len(p) for p in pieces])
        last = np.zeros(n, bool)
        last[ends[ends > 0] - 1] = True
        rank = np.full(n, -1, np.int32)
        rank[:-1] = self.byte_pairs[raw[:-1], raw[1:]]
        rank[last] = -1
        # position n is the cut on either side of a pre-token; its id makes no pair
        small = n <= LISTED
        hold = np.ndarray.tolist if small else _packed
        after = hold(np.where(last, n, np.arange(1, n + 1, dtype=np.int32)))
        before = hold(np.where(np.append(True, last[:-1]), n, np.arange(-1, n - 1, dtype=np.int32)))
        before.append(n)
        ids = hold(self.byte_ids[raw])
        ids.append(1 << 19)
        queue = RankQueue(self.n, list if small else partial(array, "i"))
        at = np.flatnonzero(rank >= 0)
        at = at[np.argsort(rank[at], kind="stable")]
        if len(at):
            firsts = np.flatnonzero(np.diff(rank[at], prepend=-1))
            for r, bucket in zip(rank[at[firsts]].tolist(), np.split(at, firsts[1:]), strict=True):
                queue.fill(r, hold(bucket))
        pair, push = self.pairs.get, queue.push
        while (got := queue.pop()) is not None:
            rank, bucket = got
            if small:
                bucket.sort()
            else:
                bucket = _packed(np.sort(np.frombuffer(bucket, np.int32)))
            head = rank << 20
            for k, p in enumerate(bucket):
                if (left := ids[p]) < 0 or pair(left << 20 | ids[q := after[p]]) != rank:
                    continue  # stale: the position is gone or begins another pair by now
                ids[p], ids[q] = rank, -1
                after[p] = q = after[q]
                before[q] = p
                lower = False
                if (new := pair(head | ids[q])) is not None:
                    push(new, p)
                    lower = new < rank
                if (new := pair(ids[q := before[p]] << 20 | rank)) is not None:
                    push(new, q)
                    lower |= new < rank
                if lower:  # that rank goes first; the rest of this bucket comes back later
                    for rest in bucket[k + 1 :]:
                        push(rank, rest)
                    break
        ids = np.array(ids[:n], np.int32)
        keep = ids >= 0
        cuts = np.append(0, np.cumsum(keep))[ends][:-1]
        return np.split(ids[keep].astype(self.code), cuts)

    def encode_texts(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; equal pre-tokens of a block are encoded once."""
        split = [self.split(t) for t in texts]
        known = self.cache
        found = [list(map(known.get, words)) for words in split]
        fresh = list({w for words, got in zip(split, found, strict=True) if None in got for w, g in zip(words, got, strict=True) if g is None})
        local: dict[str, bytes] = {}
        for start in range(0, len(fresh), 25_000):
            part = fresh[start : start + 25_000]
            for word, ids in zip(part, self.encode_many([w.encode("utf-8", "surrogatepass") for w in part]), strict=True):
                local[word] = code = ids.tobytes()
                if len(known) < CACHE_ENTRIES and len(word) <= CACHE_BYTES:
                    known[word] = code
        for i, got in enumerate(found) if fresh else ():
            if None in got:
                found[i] = [local[w] if g is None else g for w, g in zip(split[i], got, strict=True)]
        return [np.frombuffer(b"".join(got), self.code) for got in found]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class Splitter:
    """Splits texts as the pattern does.

    Texts of characters on whose classes Python's faster ``re`` and the pattern's own classes agree are split by
    ``re``; that set is computed, not assumed.  All other texts are split by the ``regex`` library.
    """

    #: The only pattern for which the faster form is known to be the same.
    FAST_FOR = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    FAST = r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"

    def __init__(self, pattern: str):
        self.full = regex.compile(pattern).findall
        self.simple = None
        if pattern == self.FAST_FOR:
            agree = "".join(re.escape(c) for c in map(chr, range(0x250)) if self._agrees(c))
            self.simple, self.fast = re.compile(f"[{agree}]*").fullmatch, re.compile(self.FAST).findall

    @staticmethod
    def _agrees(c: str) -> bool:
        kind = unicodedata.category(c)[0]
        return (
            c in "\t\n\r" or unicodedata.category(c) != "Cc"
        ) and (bool(re.match(r"[^\W\d_]", c)), bool(re.match(r"\d", c)), bool(re.match(r"\s", c))) == (
            kind == "L", kind == "N", c in "\t\n\r" or kind == "Z"
        )

    def __call__(self, text: str) -> list[str]:
        return self.fast(text) if self.simple and self.simple(text) else self.full(text)


@cache
def load(path: str, pattern: str) -> ByteBPE:
    """The vocabulary of a rank file (one base64 token and its rank a line), once per process."""
    with open(path, "rb") as f:
        return ByteBPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}, pattern)


def _digest(texts: list, path: str, pattern: str) -> dict:
    C.claim("bpe", load.cache_clear)
    bpe = load(path, pattern)
    out: dict = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
    for ids in map(np.ndarray.tolist, bpe.encode_texts([t or "" for t in texts])):
        out["n_tokens"].append(len(ids))
        out["ids_sha256"].append(hashlib.sha256(" ".join(map(bpe.decimal.__getitem__, ids)).encode()).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
    return out


def digest(docs: DataFrame, path: str, pattern: str, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Encodes and decodes every whole text; adds n_tokens, ids_sha256 and decoded_sha256 (see ``queries.op1``)."""
    C.prepare(docs.sparkSession)
    out = C.fields("n_tokens long, ids_sha256 string, decoded_sha256 string")
    return C.add_columns(docs, text, out, lambda: lambda texts: _digest(texts, path, pattern), drop=() if keep_text else (text,))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Adds the ids of every whole text as an array; null and empty texts get an empty array."""
    C.prepare(docs.sparkSession)

    def block(texts):
        C.claim("bpe", load.cache_clear)
        return {ids: [x.tolist() for x in load(path, pattern).encode_texts([t or "" for t in texts])]}

    return C.add_columns(docs, text, C.fields(f"`{ids}` array<int>"), lambda: block)


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that each array of ids stands for; null for a null array, an error for an unknown id."""
    C.prepare(tokens.sparkSession)

    @F.pandas_udf("binary")
    def back(column: pd.Series) -> pd.Series:
        table = load(path, pattern)
        return column.map(lambda x: None if x is None else table.decode(list(x)))

    return tokens.withColumn(out, back(F.col(f"`{ids}`")))
