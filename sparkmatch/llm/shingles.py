"""Word shingles of whole texts as 64-bit hashes, a block of texts at a time, by vector operations only.

A word is a run of letters and digits of any script, in lower case; everything else separates words.  A text of n
words has n - SIZE + 1 shingles of SIZE words; one of 1 to SIZE - 1 words has one shingle, of all its words; one
without a word has none.  Hashes are the same in every process.
"""

from __future__ import annotations

from functools import cache

import numpy as np

SIZE = 5
#: Code points worked on at once; a longer single text is worked on alone.
CHUNK = 1 << 19

_ODD = np.uint64(0x9E3779B97F4A7C15)


@cache
def _word_chars() -> np.ndarray:
    """Code point of the basic plane to its lower case if it is a letter or digit, else 0."""
    table = np.zeros(0x10000, np.uint32)
    for i in range(0x10000):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd base and of its inverse, modulo 2 ** 64."""
    if len(_powers["up"]) <= n:
        size = max(n + 1, 2 * CHUNK)
        base = 0xD6E8FEB86659FD93
        for key, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            step = np.full(size, b, np.uint64)
            step[0] = 1
            _powers[key] = np.multiply.accumulate(step)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A finishing step that spreads every bit of a 64-bit value."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text."""
    cp = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths + 1)
    table = _word_chars()
    if len(cp) and cp.max() >= 0x10000:
        high = np.flatnonzero(cp >= 0x10000)
        folded = table[np.where(cp >= 0x10000, 32, cp)]
        folded[high] = [ord(c.lower()) if c.isalnum() else 0 for c in map(chr, cp[high].tolist())]
        cp = folded
    else:
        cp = table[cp]
    inside = cp != 0
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power(len(cp))
    sums = np.zeros(len(cp) + 1, np.uint64)
    np.cumsum(cp * up[: len(cp)], out=sums[1:])
    hashes = mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64) * _ODD)
    return hashes, np.diff(np.searchsorted(start, ends), prepend=0)


_FACTORS = np.array([0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xE7037ED1A0B428DB, 0x589965CC75374CC3], np.uint64)


def _shingles(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin = np.cumsum(counts) - counts
    n_out = np.where(counts >= SIZE, counts - SIZE + 1, (counts > 0).astype(counts.dtype))
    if not n_out.sum():
        return np.zeros(0, np.uint64), n_out
    padded = np.concatenate([hashes, np.zeros(SIZE, np.uint64)])
    n = len(hashes)
    total = np.zeros(n, np.uint64)
    for k in range(SIZE):
        total += padded[k : k + n] * _FACTORS[k]
    short = np.flatnonzero((counts > 0) & (counts < SIZE))
    for i in short.tolist():
        own = hashes[begin[i] : begin[i] + counts[i]]
        total[begin[i]] = (own * _FACTORS[: len(own)]).sum() + np.uint64(len(own))
    out_begin = np.cumsum(n_out) - n_out
    at = np.arange(int(n_out.sum())) + np.repeat(begin - out_begin, n_out)
    return mix(total[at]), n_out


def blocks(texts: list[str]):
    """Yields (index of the first text, word hashes, word counts, shingles, shingle counts) for runs of texts."""
    start = total = 0
    for i in range(len(texts) + 1):
        if i == len(texts) or (i > start and total + len(texts[i]) > CHUNK):
            if i > start:
                part = texts[start:i]
                h, c = words(part)
                yield start, h, c, *_shingles(h, c)
            start, total = i, 0
        if i < len(texts):
            total += len(texts[i])


def shingles(text: str) -> np.ndarray:
    """Shingle hashes of one text, in order, with repetitions."""
    return next((s for _, _, _, s, _ in blocks([text])), np.zeros(0, np.uint64))
