"""Operator 10: quality classifier, a generalised additive model with pairwise interactions.

The model is a sum of lookup tables: one per feature, then one per chosen pair of features.  Boosting goes round the
features in turn; each step fits a shallow tree on one feature alone, over its histogram of gradients, and adds the
tree's leaf values to that feature's table.  Pairs are ranked by how much of the remaining gradient a tree of two
cuts on a coarse grid explains; the best are boosted the same way.  A score is bin look-ups and additions, done for a
block of documents at once.

The model is fitted on a bounded sample of labelled rows (``PER_LABEL`` of each label value), weighted back to the
true label counts.  Scoring covers every whole text, without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from . import _common as C

#: Training documents of each label value at most.
PER_LABEL = 3000

FEATURES = (
    "log_bytes", "letters", "upper", "digits", "stops", "spaces", "exclaims", "symbols", "pipes", "brackets", "symbol_kinds",
    "word_bytes", "distinct_words", "same_as_previous", "top_line_words", "distinct_lines", "line_words", "non_ascii",
)

_UPPER, _LOWER, _DIGIT, _STOP, _SPACE, _EXCLAIM, _SYMBOL, _PIPE, _BRACKET, _LEAD, _TAIL, _LINE, _OTHER = range(13)
_CLASS = np.full(256, _OTHER, np.uint8)
for _k, _chars in (
    (_UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (_LOWER, b"abcdefghijklmnopqrstuvwxyz"), (_DIGIT, b"0123456789"), (_STOP, b".,;:'\"-"), (_SPACE, b" \t\r\f\v"),
    (_EXCLAIM, b"!?"), (_SYMBOL, b"#$%&*@^~+=/\\_`"), (_PIPE, b"|"), (_BRACKET, b"()[]{}<>"), (_LEAD, bytes(range(0xC0, 0x100))), (_TAIL, bytes(range(0x80, 0xC0))), (_LINE, b"\n"),
):
    _CLASS[list(_chars)] = _k


def features(text: str) -> list[float]:
    """The features of one whole text; all rates are 0 for an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=13).tolist() if raw else [0] * 13
    letters = kinds[_UPPER] + kinds[_LOWER] + kinds[_LEAD]
    chars = max(1, len(raw) - kinds[_TAIL])
    words = text.split()
    n = max(1, len(words))
    lines = [x for x in text.split("\n") if x]
    m = max(1, len(lines))
    return [
        np.log1p(len(raw)),
        letters / chars,
        kinds[_UPPER] / max(1, letters),
        kinds[_DIGIT] / chars,
        kinds[_STOP] / chars,
        kinds[_SPACE] / chars,
        kinds[_EXCLAIM] / n,
        kinds[_SYMBOL] / n,
        kinds[_PIPE] / n,
        kinds[_BRACKET] / n,
        sum(c in text for c in "#$%&*@|!{}<>"),
        (chars - kinds[_SPACE] - kinds[_LINE]) / n,
        len(set(words)) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        max((x.count(" ") for x in lines), default=0) / n,
        len(set(lines)) / m,
        n / m,
        kinds[_LEAD] / max(1, letters),
    ]


@dataclass
class GAM:
    """Cuts of each feature, its table, and (i, j, coarse cuts, table) for each pair."""

    bias: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of features."""
        out = np.full(len(x), self.bias)
        for f, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cuts, x[:, f], side="right")]
        for i, j, a, b, table in self.pairs:
            out += table[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return _sigmoid(out)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(column: np.ndarray, most: int) -> np.ndarray:
    """Cut points between distinct values, at quantiles where there are many."""
    values = np.unique(column)
    if len(values) > most:
        values = np.unique(np.quantile(column, np.linspace(0, 1, most)))
    return (values[1:] + values[:-1]) / 2


def _tree_1d(g: np.ndarray, h: np.ndarray, depth: int, l2: float, least: float) -> np.ndarray:
    """Leaf value of each bin: greedy cuts of the bins' range, to the given depth."""
    out = np.zeros(len(g))

    def grow(a: int, b: int, left: int) -> None:
        G, H = g[a:b].sum(), h[a:b].sum()
        if left and b - a > 1:
            cg, ch = np.cumsum(g[a : b - 1]), np.cumsum(h[a : b - 1])
            gain = cg**2 / (ch + l2) + (G - cg) ** 2 / (H - ch + l2) - G**2 / (H + l2)
            gain[(ch < least) | (H - ch < least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > 1e-9:
                grow(a, a + k + 1, left - 1)
                grow(a + k + 1, b, left - 1)
                return
        out[a:b] = G / (H + l2)

    grow(0, len(g), depth)
    return out


def _tree_2d(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[np.ndarray, float]:
    """Values of the four quadrants of the best pair of cuts on a grid, and the gain."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    G, H = cg[-1, -1], ch[-1, -1]
    best, at = -1.0, (0, 0)
    quad = lambda c: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    gq, hq = quad(cg), quad(ch)
    gain = sum(a**2 / (b + l2) for a, b in zip(gq, hq, strict=True)) - G**2 / (H + l2)
    gain = np.where(np.minimum.reduce(np.broadcast_arrays(*hq)) < least, -1, gain)
    out = np.zeros_like(g)
    if gain.size:
        at = np.unravel_index(int(np.argmax(gain)), gain.shape)
        best = float(gain[at])
    if best <= 1e-9:
        return out, 0.0
    i, j = at[0] + 1, at[1] + 1
    for k, (r, c) in enumerate(((slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None)))):
        out[r, c] = np.broadcast_to(gq[k], gain.shape)[at] / (np.broadcast_to(hq[k], gain.shape)[at] + l2)
    return out, best


def fit(
    x: np.ndarray, y: np.ndarray, weight: np.ndarray, *, bins: int = 48, rounds: int = 60, pairs: int = 6, pair_bins: int = 12,
    pair_rounds: int = 60, depth: int = 2, rate: float = 0.1, l2: float = 1.0, least: float = 2.0, pair_least: float = 0.2,
) -> GAM:
    """Fits the model; weights are scaled to mean 1.  With one label value the score is that value's smoothed rate."""
    weight = weight / weight.mean()
    p = (weight @ y + 0.5) / (weight.sum() + 1)
    bias = float(np.log(p / (1 - p)))
    k = x.shape[1]
    cuts = [_cuts(x[:, f], bins) for f in range(k)]
    at = [np.searchsorted(cuts[f], x[:, f], side="right") for f in range(k)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    z = np.full(len(y), bias)

    def gradient() -> tuple[np.ndarray, np.ndarray]:
        q = _sigmoid(z)
        return weight * (y - q), weight * q * (1 - q)

    for _ in range(rounds):
        for f in range(k):
            if len(tables[f]) < 2:
                continue
            g, h = gradient()
            n = len(tables[f])
            step = rate * _tree_1d(np.bincount(at[f], g, n), np.bincount(at[f], h, n), depth, l2, least)
            tables[f] += step
            z += step[at[f]]
    coarse = [_cuts(x[:, f], pair_bins) for f in range(k)]
    cat = [np.searchsorted(coarse[f], x[:, f], side="right") for f in range(k)]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = len(coarse[i]) + 1, len(coarse[j]) + 1
        cell = cat[i] * b + cat[j]
        g, h = gradient()
        return cell, np.bincount(cell, g, a * b).reshape(a, b), np.bincount(cell, h, a * b).reshape(a, b)

    ranked = sorted(((_tree_2d(*grid(i, j)[1:], l2, pair_least)[1], i, j) for i in range(k) for j in range(i)), reverse=True)
    chosen = [(i, j) for gain, i, j in ranked[:pairs] if gain > 0]
    tables_2d = {ij: np.zeros((len(coarse[ij[0]]) + 1, len(coarse[ij[1]]) + 1)) for ij in chosen}
    for _ in range(pair_rounds):
        for ij in chosen:
            cell, g, h = grid(*ij)
            step = rate * _tree_2d(g, h, l2, pair_least)[0]
            tables_2d[ij] += step
            z += step.ravel()[cell]
    return GAM(bias, cuts, tables, [(i, j, coarse[i], coarse[j], tables_2d[i, j]) for i, j in chosen])


def train(docs: DataFrame, labels: DataFrame, parts: int = 4, part: int = 2, per_label: int = PER_LABEL) -> GAM:
    """Fits on the bounded sample; without labelled rows the score is 0.5 for every text."""
    rows, totals = C.label_sample(docs, labels, "quality", parts, part, per_label)
    if not rows:
        return GAM(0.0, [np.zeros(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), [])
    y = np.array([v for _, v in rows], float)
    seen = {v: int((y == v).sum()) for v in totals}
    weight = np.array([totals[v] / seen[v] for _, v in rows])
    return fit(np.array([features(t) for t, _ in rows]), (y > 0).astype(float), weight)


def score(docs: DataFrame, model: GAM, threshold: float = 0.7, text: str = "text", keep_text: bool = True, prefix: str = "") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold) of every whole text; null counts as empty.

    Repeated rows are returned as often, an empty table empty.  Columns of the results' names are replaced by them.
    """
    C.prepare(docs.sparkSession)
    s, p = prefix + "score", prefix + "predicted"

    def make():
        C.claim("quality", lambda: None)

        def block(texts):
            got = model.score(np.array([features(t or "") for t in texts]))
            return {s: got, p: (got >= threshold).astype(np.int32)}

        return block

    return C.add_columns(docs, text, C.fields(f"`{s}` double, `{p}` int"), make, drop=() if keep_text else (text,))
