"""Operator 5: language identification by nearest centroids.

A text becomes a vector of its letter n-grams (one to three code points, lower case, everything but letters read as
one space), hashed to ``DIMS`` places, weighted by damped term frequency and inverse document frequency, and scaled
to norm 1.  Each language has several centroids, found by spherical k-means over its training vectors.  A text gets
the language of the centroid with the highest cosine; the cosine is the score.  A text farther from every centroid
than ``REJECT_QUANTILE`` of its language's training texts were from theirs, with some allowance, is marked rejected.

Fitted on a bounded sample of labelled rows (``PER_LANGUAGE`` for each language); the model's size depends on the
number of languages alone.  Scoring covers every whole text, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Training documents of each language at most.
PER_LANGUAGE = 600
DIMS = 4096
CENTROIDS = 4
REJECT_QUANTILE = 0.98
REJECT_SLACK = 1.15
#: Language of a text without a letter.
UNDETERMINED = "und"

_SPACE = 32


@cache
def _letters() -> np.ndarray:
    """Code point to itself in lower case if it is a letter, else to a space; for the basic plane."""
    table = np.full(0x10000, _SPACE, np.uint32)
    for i in range(0x10000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def vector(text: str) -> np.ndarray | None:
    """Damped counts of the hashed n-grams of a text; None without a letter."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters()
    if len(cp) and cp.max() >= 0x10000:
        high = cp >= 0x10000
        far = [ord(c) if c.isalpha() else _SPACE for c in map(chr, cp[high].tolist())]
        cp = table[np.where(high, _SPACE, cp)]
        cp[high] = far
    else:
        cp = table[cp]
    if not len(cp) or (cp == _SPACE).all():
        return None
    cp = np.concatenate(([_SPACE], cp, [_SPACE])).astype(np.uint32)
    cp = cp[np.append(True, (cp[1:] != _SPACE) | (cp[:-1] != _SPACE))]
    one = cp * np.uint32(0x9E3779B1)
    two = one[:-1] ^ cp[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(5) ^ cp[2:] * np.uint32(0xC2B2AE3D)
    shift = np.uint32(32 - DIMS.bit_length() + 1)
    counts = np.bincount(np.concatenate([(h ^ h >> np.uint32(15)) * np.uint32(0x2545F491) >> shift for h in (one, two, three)]), minlength=DIMS)
    return np.sqrt(counts).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-12)


@dataclass
class Centroids:
    """Inverse document frequencies, centroids (rows of norm 1), the language of each, and each one's farthest distance."""

    idf: np.ndarray
    rows: np.ndarray
    langs: list[str]
    reach: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and rejection of each text."""
        vectors = [vector(t or "") for t in texts]
        langs, score, rejected = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        at = [i for i, v in enumerate(vectors) if v is not None]
        if at and self.langs:
            cosine = _unit(np.stack([vectors[i] for i in at]) * self.idf) @ self.rows.T
            best = cosine.argmax(1)
            for i, b in zip(at, best.tolist(), strict=True):
                langs[i] = self.langs[b]
            top = np.clip(cosine[np.arange(len(at)), best], 0, 1)
            score[at], rejected[at] = top, 1 - top > self.reach[best]
        return langs, score, rejected


def fit(rows: list[tuple[str, str]], seed: int = 7) -> Centroids:
    """Centroids from (text, language) rows; texts without a letter take no part."""
    pairs = [(v, lang) for t, lang in rows if (v := vector(t)) is not None]
    if not pairs:
        return Centroids(np.ones(DIMS, np.float32), np.zeros((0, DIMS), np.float32), [], np.zeros(0))
    x = np.stack([v for v, _ in pairs])
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.1).astype(np.float32)
    x = _unit(x * idf)
    of = np.array([lang for _, lang in pairs])
    rows_, langs, reach = [], [], []
    for lang in sorted(set(of.tolist())):
        own = x[of == lang]
        rng = np.random.default_rng(seed)
        centre = [_unit(own.mean(0))]
        while len(centre) < min(CENTROIDS, len(own)):  # farthest-first choice of starts
            away = np.maximum(0, 1 - (own @ np.stack(centre).T).max(1).astype(float))
            centre.append(own[rng.choice(len(own), p=away / away.sum())] if away.sum() > 1e-6 else own[0])
        c = np.stack(centre)
        for _ in range(12):
            near = (own @ c.T).argmax(1)
            c = np.stack([_unit(own[near == k].mean(0)) if (near == k).any() else c[k] for k in range(len(c))])
        top = own @ c.T
        for k in range(len(c)):
            rows_.append(c[k])
            langs.append(lang)
            reach.append(min(1.0, REJECT_SLACK * float(np.quantile(1 - top.max(1), REJECT_QUANTILE))))
    return Centroids(idf, np.stack(rows_).astype(np.float32), langs, np.array(reach))


def train(docs: DataFrame, parts: int = 3, part: int = 1, per_language: int = PER_LANGUAGE) -> Centroids:
    """Fits on at most ``per_language`` documents of each language outside the held-out part, by smallest hash of doc_id.

    Rows with a null doc_id, text or language take no part.  A doc_id of several rows counts once for each language,
    with the least of its texts, so repeated rows add nothing and the driver gets ``per_language`` texts a language at
    most.  No rows give a model that calls every text undetermined.
    """
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~C.held_out("doc_id", parts, part))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("y"), "text")
    chosen, _ = C.smallest_hashes(known.select("doc_id", "y"), per_language)
    if not chosen:
        return fit([])
    small = docs.sparkSession.createDataFrame(chosen, "doc_id long, y string")  # per_language rows a language at most
    got = known.join(F.broadcast(small), ["doc_id", "y"]).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    return fit(sorted((r.text, r.y) for r in got.collect()))


def identify(docs: DataFrame, model: Centroids, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds lang_pred, score and rejected of every whole text.

    A text that is null, empty or without a letter is ``und`` with score 0, and rejected.  Repeated rows are returned as
    often, an empty table empty.  Columns of the results' names are replaced by them.
    """
    C.prepare(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # CENTROIDS * DIMS floats a language

    def make():
        model = shipped.value

        def block(texts):
            langs, score, rejected = model.predict(texts)
            return {"lang_pred": langs, "score": score, "rejected": rejected}

        return block

    return C.add_columns(docs, text, C.fields("lang_pred string, score double, rejected boolean"), make, drop=() if keep_text else (text,))
