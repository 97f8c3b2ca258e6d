"""Operator 7: toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

Kernel.  A unit is a word without its non-letters, so "id*iot" and "id-iot" are "idiot", or a run of single letters
written apart ("i d i o t").  phi(u) counts every subsequence of three letters, also with gaps, weighted by
LAMBDA ** (letters spanned) up to SPAN letters; k(u, v) = <phi(u), phi(v)> / (|phi(u)| |phi(v)|).  A letter put in
or left out changes few subsequences, so such variants stay close.

Training.  Labels mark whole documents, so a sentence of a clean document is a clean sentence, and a toxic document has
at least one toxic sentence, which the label does not name.  The machine is trained on sentences, each stood for by its
witness, the unit that scores highest: all clean sentences are negative examples, and the sentences of toxic documents
whose witness is scored toxic (or else the document's highest) are positive ones.  The first witnesses are, in toxic
sentences, the units most associated with the label beyond chance and, in clean ones, those closest to these; later
rounds take them by the machine of the round before, and clean witnesses of earlier rounds stay.  The landmarks are
the units that cover most toxic documents and the clean units closest to them.  The machine is linear in the Nystroem
features K(u, landmarks) K(landmarks, landmarks)^(-1/2).

Scoring.  A Nystroem feature is a fixed mix of kernel values, and a kernel value a sum over subsequences, so the
decision folds exactly into one weight per subsequence.  A text's score is the calibrated highest decision over all
its units.  Each distinct word is scored once per worker while the bounded cache has room.
"""

from __future__ import annotations

import math
import re
from array import array
from dataclasses import dataclass, field
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from . import _common as C

#: Training documents of each label value at most.
PER_LABEL = 2000
LANDMARKS = 160
LAMBDA = 0.9
SPAN = 6
#: Cost of a violated margin.
COST = 20.0
#: Longer units are cut into windows of this many letters, each starting half a window after the last.
WINDOW = 24
CACHE_ENTRIES = 250_000

ALPHABET = 64
#: Digits that stand for letters inside a word.
DIGITS = str.maketrans("013457", "oieast")
_APART = re.compile(r"(?<![^\W_])[^\W\d_](?:[\W_]{1,2}[^\W\d_](?![^\W_])){2,}")
_SENTENCE = re.compile(r"(?<=[.!?\u2026])\s+|[\r\n]+")
_NOT_LETTER = re.compile(r"[\W\d_]+")


def units(word: str) -> list[str]:
    """The units of one word between white space: none, one, or the windows of a long one."""
    word = word.lower()
    if not word.isalpha():
        if any(c.isdigit() for c in word) and any(c.isalpha() for c in word):
            word = word.translate(DIGITS)
        word = _NOT_LETTER.sub("", word)
    if len(word) <= WINDOW:
        return [word] if len(word) >= 3 else []
    return [word[i : i + WINDOW] for i in range(0, len(word) - WINDOW // 2, WINDOW // 2)]


def apart(text: str) -> list[str]:
    """Units that are written as single letters with a mark or a space between them."""
    return [u for m in _APART.findall(text) for u in units(re.sub(r"\s", "", m))]


@cache
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the subsequences of three in n letters that span SPAN letters at most, and their weights."""
    at = np.array([(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + SPAN)) for j in range(i + 1, k)], np.int64).reshape(-1, 3)
    return at, (LAMBDA ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)


def phi(words: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the words of each length: their indices, the subsequences of each (sorted) and the weights, of norm 1.

    Equal subsequences of a word are merged into the first of them; the others get weight 0.
    """
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        by.setdefault(len(w), []).append(i)
    out = []
    for n, index in by.items():
        at, weight = _triples(n)
        cp = np.frombuffer("".join(words[i] for i in index).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(index), n).astype(np.int64)
        letter = np.where((cp >= 97) & (cp <= 122), cp - 97, 26 + cp % 38)
        key = (letter[:, at[:, 0]] * ALPHABET + letter[:, at[:, 1]]) * ALPHABET + letter[:, at[:, 2]]
        order = np.argsort(key, axis=1, kind="stable")
        key = np.take_along_axis(key, order, 1)
        w = weight[order]
        first = np.ones(key.shape, bool)
        first[:, 1:] = key[:, 1:] != key[:, :-1]
        if not first.all():
            flat = np.flatnonzero(first)
            merged = np.zeros(key.size, np.float32)
            merged[flat] = np.add.reduceat(w.ravel(), flat)
            w = merged.reshape(key.shape)
        w = w / np.sqrt((w**2).sum(1, keepdims=True))
        out.append((np.array(index), key, w.astype(np.float32)))
    return out


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """k of each word with each landmark."""
    parts = phi(landmarks)
    used = np.unique(np.concatenate([key.ravel() for _, key, _ in parts]))
    dense = np.zeros((len(used) + 1, len(landmarks)), np.float32)
    for index, key, w in parts:
        np.add.at(dense, (np.searchsorted(used, key), index[:, None]), w)
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for index, key, w in phi(words):
        for s in range(0, len(index), 256):
            at = np.minimum(np.searchsorted(used, key[s : s + 256]), len(used) - 1)
            at = np.where(used[at] == key[s : s + 256], at, len(used))
            out[index[s : s + 256]] = np.einsum("wt,wtl->wl", w[s : s + 256], dense[at])
    return out


@dataclass
class Machine:
    """One weight per subsequence, and the calibration of a text's highest decision."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float
    landmarks: list[str] = field(default_factory=list)

    def decide(self, words: list[str]) -> np.ndarray:
        """Decision of each unit of three letters or more."""
        out = np.empty(len(words))
        for index, key, w in phi(words):
            for s in range(0, len(index), 4096):
                out[index[s : s + 4096]] = (self.weights[key[s : s + 4096]] * w[s : s + 4096]).sum(1) + self.bias
        return out

    def probability(self, decision: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * decision + self.offset, -30, 30)))


#: Decision of a text without any unit.
NOTHING = -3.0


class Scorer:
    """Highest decision of each text; keeps the decisions of words seen."""

    def __init__(self, machine: Machine):
        self.machine = machine
        self.known: dict[str, float] = {}
        self.shared: dict[float, float] = {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        known, shared = self.known, self.shared
        split = [t.split() for t in texts]
        fresh = list({w for words in split for w in words if w not in known})
        local: dict[str, float] = {}
        for start in range(0, len(fresh), 50_000):
            part = fresh[start : start + 50_000]
            unit = [units(w) for w in part]
            flat = [u for us in unit for u in us]
            values = iter(np.round(np.maximum(self.machine.decide(flat), NOTHING), 3).tolist()) if flat else iter(())
            for word, us in zip(part, unit, strict=True):
                value = max([next(values) for _ in us], default=NOTHING)
                value = shared.setdefault(value, value)
                if len(known) < CACHE_ENTRIES and len(word) <= 40:
                    known[word] = value
                else:
                    local[word] = value
        get = known.__getitem__ if not local else lambda w: known[w] if w in known else local[w]
        out = np.array([max(map(get, words), default=NOTHING) for words in split])
        for i, t in enumerate(texts):
            if spaced := apart(t):
                out[i] = max(out[i], self.machine.decide(spaced).max())
        return out


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 30) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton's method; the last column of x is the constant."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(len(w))
    ridge[-1, -1] = 1e-3
    for _ in range(steps):
        active = y * (x @ w) < 1
        a = x[active] * cost[active, None]
        new = np.linalg.solve(ridge + a.T @ x[active], a.T @ y[active])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


class Sentences:
    """The sentences of labelled texts as runs of unit numbers; a run of letters written apart is a sentence of its own."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        flat, sizes, text = array("i"), [], []
        for k, t in enumerate(texts):
            for words in [*map(str.split, _SENTENCE.split(t)), None]:
                own = dict.fromkeys(apart(t) if words is None else (u for w in words for u in units(w)))
                if own:
                    flat.extend(number.setdefault(u, len(number)) for u in own)
                    sizes.append(len(own))
                    text.append(k)
        self.names = list(number)
        self.flat, self.text = np.array(flat, np.int64), np.array(text, np.int64)
        self.starts = np.cumsum(sizes, dtype=np.int64) - sizes if sizes else np.zeros(0, np.int64)
        self.sizes = np.array(sizes, np.int64)

    def documents(self, keep: np.ndarray) -> np.ndarray:
        """Number of the texts of the kept sentences that hold each unit."""
        inside, n = np.repeat(keep, self.sizes), max(1, len(self.names))
        return np.bincount(np.unique(np.repeat(self.text, self.sizes)[inside] * n + self.flat[inside]) % n, minlength=n)

    def witnesses(self, value: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit of the highest value of each sentence that is kept, and the sentence."""
        if not len(self.starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        mine = value[self.flat]
        best = np.maximum.reduceat(mine, self.starts)
        at = np.flatnonzero(mine == np.repeat(best, self.sizes))
        _, first = np.unique(np.repeat(np.arange(len(self.starts)), self.sizes)[at], return_index=True)
        which = np.flatnonzero(keep & np.isfinite(best))
        return self.flat[at[first[which]]], which


    def standing(self, value: np.ndarray, keep: np.ndarray, sure: float, least: float) -> np.ndarray:
        """How many of the kept sentences each unit stands for: those whose witness is above ``sure``, or else its text's best above ``least``."""
        witness, which = self.witnesses(value, keep)
        mine, text = value[witness], self.text[which]
        top = np.full(int(self.text.max(initial=-1)) + 1, -np.inf)
        np.maximum.at(top, text, mine)
        stands = (mine > sure) | ((mine == top[text]) & (mine > least))
        return np.bincount(witness[stands], minlength=len(self.names)).astype(float)


def _greatest(words: list[str], landmarks: list[str]) -> np.ndarray:
    """The greatest kernel value of each word with any landmark."""
    parts = [kernel(words[i : i + 10_000], landmarks).max(1) for i in range(0, len(words), 10_000)]
    return np.concatenate(parts) if parts else np.zeros(0, np.float32)


def _decisions(machine: Machine, words: list[str]) -> np.ndarray:
    parts = [machine.decide(words[i : i + 20_000]) for i in range(0, len(words), 20_000)]
    return np.concatenate(parts) if parts else np.zeros(0)


def fit(texts: list[str], labels: list[int], totals: dict[int, int], rounds: int = 4) -> Machine:
    """Fits machine and calibration to labelled texts; deterministic.  Without both labels every text gets the rate seen."""
    n_pos, n_neg = sum(labels), len(labels) - sum(labels)
    rate = (totals.get(1, 0) + 0.5) / (totals.get(0, 0) + totals.get(1, 0) + 1)
    flat = Machine(np.zeros(ALPHABET**3, np.float32), 0.0, 0.0, math.log(rate / (1 - rate)))
    if not n_pos or not n_neg:
        return flat
    toxic = np.array(labels, bool)
    found = Sentences(texts)
    names, in_toxic = found.names, toxic[found.text] if len(found.text) else np.zeros(0, bool)
    pos, neg = found.documents(in_toxic), found.documents(~in_toxic)
    # association beyond chance: the log-likelihood ratio of a unit's labels must exceed that of as many random units
    chance = n_pos / (n_pos + n_neg)
    share = pos / np.maximum(1, pos + neg)
    ratio = pos * np.log(np.maximum(share, 1e-12) / chance) + neg * np.log(np.maximum(1 - share, 1e-12) / (1 - chance))
    linked = (pos > 0) & (share > chance) & (ratio > math.log(max(1, len(names))) - 1)
    # the landmarks for toxic units: greedily, those that cover most toxic documents not yet covered twice
    text = np.repeat(found.text, found.sizes)
    holders: dict[int, np.ndarray] = {}
    at = np.flatnonzero(linked[found.flat] & toxic[text])
    order = at[np.argsort(found.flat[at], kind="stable")]
    for part in np.split(order, np.flatnonzero(np.diff(found.flat[order])) + 1) if len(order) else ():
        holders[int(found.flat[part[0]])] = np.unique(text[part])
    cover = np.zeros(len(texts), np.int64)
    toxic_marks: list[int] = []
    while holders and len(toxic_marks) < LANDMARKS // 2:
        u = max(holders, key=lambda u: ((cover[holders[u]] < 2).sum() * ratio[u] / pos[u], names[u]))
        toxic_marks.append(u)
        cover[holders.pop(u)] += 1
    if not toxic_marks:
        return flat
    clean = np.array(sorted(np.flatnonzero(neg).tolist(), key=lambda u: (-neg[u], names[u])), np.int64)
    near = np.full(len(names), -np.inf)
    near[clean] = _greatest([names[u] for u in clean], [names[u] for u in toxic_marks])
    close = clean[np.argsort(-near[clean], kind="stable")[: LANDMARKS // 2]].tolist()
    marks = [names[u] for u in dict.fromkeys(toxic_marks + close)]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(float))
    root = vectors[:, values > 1e-4] / np.sqrt(values[values > 1e-4])
    negative = np.unique(np.append(found.witnesses(near, ~in_toxic)[0], close))
    strength, sure = np.where(linked, ratio, -np.inf), ratio[linked].max()
    strength[toxic_marks] += sure  # a landmark before any other linked unit
    weight = found.standing(strength, in_toxic, sure, 0.0)
    machine = flat
    for _ in range(rounds):
        positive = np.flatnonzero((weight > 0) & (neg <= 0.02 * n_neg + pos * 0.2))
        if not len(positive):
            break
        own = np.append(positive, negative)
        y = np.append(np.ones(len(positive)), -np.ones(len(negative)))
        cost = COST * np.append(weight[positive], np.ones(len(negative)))  # of each toxic sentence, and of each unit that stands for clean ones
        x = np.hstack([kernel([names[u] for u in own], marks) @ root, np.ones((len(own), 1))])
        w = _svm(x, y, cost)
        beta = root @ w[:-1]
        folded = np.zeros(ALPHABET**3)
        for index, key, v in phi(marks):
            np.add.at(folded, key, v * beta[index][:, None])
        machine = Machine(folded.astype(np.float32), float(w[-1]), 1.0, 0.0, marks)
        decision = _decisions(machine, names)
        # clean sentences whose witness is not safely clean; those of earlier rounds stay
        witness, _ = found.witnesses(decision, ~in_toxic)
        negative = np.union1d(negative, witness[decision[witness] > -1])
        weight = found.standing(np.where(linked, decision, -np.inf), in_toxic, 0.0, -1.0)
    z = Scorer(machine)(texts)
    y = np.array(labels, float)
    seen = {1: n_pos, 0: n_neg}
    machine.slope, machine.offset = _platt(z, y, np.array([totals.get(v, seen[v]) / seen[v] for v in labels]))
    return machine


def _platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Logistic calibration of decisions, with a small ridge on the slope."""
    x = np.stack([z, np.ones(len(z))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - y)) + np.array([1e-2 * w[0], 0])
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(h, g)
        w = w - np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return max(float(w[0]), 0.1), float(w[1])


def train(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, per_label: int = PER_LABEL) -> Machine:
    """Fits on the bounded sample of labelled documents outside the held-out part."""
    rows, totals = C.label_sample(docs, labels, "toxic", parts, part, per_label)
    return fit([t for t, _ in rows], [int(y > 0) for _, y in rows], {int(v > 0): n for v, n in totals.items()})


_scorers: dict[bytes, Scorer] = {}


def _scorer(machine: Machine) -> Scorer:
    """The worker's scorer of this machine; a reused worker keeps it, with what it knows, from task to task."""
    key = machine.weights.tobytes()[:: ALPHABET] + repr((machine.bias, machine.slope, machine.offset)).encode()
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(machine)
    return _scorers[key]


def score(docs: DataFrame, machine: Machine, threshold: float = 0.5, text: str = "text", keep_text: bool = True, prefix: str = "") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold) of every whole text; null counts as empty.

    Repeated rows are returned as often, an empty table empty.  Columns of the results' names are replaced by them.
    """
    C.prepare(docs.sparkSession)
    s, p = prefix + "score", prefix + "predicted"
    shipped = docs.sparkSession.sparkContext.broadcast(machine)  # ALPHABET ** 3 weights: 1 MB at every size

    def make():
        C.claim("toxicity", _scorers.clear)
        scorer = _scorer(shipped.value)

        def block(texts):
            got = scorer.machine.probability(scorer([t or "" for t in texts]))
            return {s: got, p: (got >= threshold).astype(np.int32)}

        return block

    return C.add_columns(docs, text, C.fields(f"`{s}` double, `{p}` int"), make, drop=() if keep_text else (text,))
