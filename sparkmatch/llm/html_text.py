"""Operator 4: main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A page is read once, tolerant of tags left open; its leaf blocks are the runs of text between boundaries of
block-level elements.  Each block has features of its ancestors (tags, words of class, id, role and itemprop) and of
its text (length, share of linked text, sentence ends, place in the page).  The field scores labels main and other by
these features and by pairs of neighbouring labels, apart for neighbours with and without the same ancestors; it is
trained to the highest penalised likelihood on labelled pages (``html_pages``) by forward-backward, and decoded by
Viterbi.  The main blocks, in page order, are the text.

Features are indicators, so a block's score is a sum of weights; ancestors come as paths that repeat in and between
pages, and a path's score is worked out once for each worker.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import cache

import numpy as np
from pyspark.sql import DataFrame

from . import _common as C
from . import html_pages

#: Labelled pages that the field is trained on.
TRAINING_PAGES = 400

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " canvas object math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle semantics annotation".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as part of the page.
HIDDEN = frozenset("script style title textarea noscript iframe template svg audio video noframes".split())
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
#: Parts of class names that tell of a role; a word of an attribute is reduced to those that it begins with.
ROLES = (
    "adv", "ads", "banner", "sponsor", "promo", "nav", "menu", "head", "mast", "foot", "side", "widget", "related", "comment", "reply", "disqus", "cookie", "consent", "gdpr", "notice",
    "popup", "modal", "share", "social", "search", "sub", "sign", "login", "newsletter", "form", "breadcrumb", "pag", "content", "article", "post", "entry", "story", "main", "body", "text", "title", "complementary", "alert", "copyright",
)

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    path: int
    text: str
    linked: int  # characters inside links


class Paths:
    """Interned ancestor paths; each has the features that its elements give, or those of them that are known.

    With known features a path holds no more of them than there are, however deep the page is.
    """

    def __init__(self, known=None):
        self.known = known
        self.index: dict[tuple[int, str, str], int] = {}
        self.features: list[tuple[str, ...]] = [()]

    def child(self, parent: int, tag: str, attributes: str) -> int:
        key = (parent, tag, attributes)
        got = self.index.get(key)
        if got is None:
            names = {f"tag {tag}"}
            for m in _ATTRIBUTE.finditer(attributes):
                for word in _WORD.findall((m[2] or m[3] or m[4] or "").lower()):
                    names.add("role ad" if word == "ad" else f"word {word}" if not (r := [x for x in ROLES if word.startswith(x)]) else f"role {r[0]}")
            base = [f for f in self.features[parent] if not f.startswith("leaf ")]
            got = self.index[key] = len(self.features)
            mine = [*sorted(names), f"leaf {tag}"]
            self.features.append(tuple(dict.fromkeys([*base, *(f for f in mine if self.known is None or f in self.known)])))
        return got


def blocks(page: str, paths: Paths) -> list[Block]:
    """The leaf blocks of a page that have text, in order."""
    out: list[Block] = []
    stack: list[tuple[str, int]] = [("", 0)]
    inside: Counter[str] = Counter()  # open elements by tag: what is not open is not looked for

    def pop(i: int) -> None:
        inside.subtract(t for t, _ in stack[i:])
        del stack[i:]

    parts: list[str] = []
    linked = 0
    in_link = False

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = entities.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if in_link:
                linked += len(raw.strip())

    def flush() -> None:
        nonlocal linked
        if parts:
            whole = " ".join("".join(parts).split())
            if whole:
                out.append(Block(stack[-1][1], whole, linked))
            parts.clear()
            linked = 0

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            if m[0] == "<![CDATA[":
                end = page.find("]]>", at)
                at = n if end < 0 else end + 3
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            elif tag == "br":
                parts.append(" ")
            continue
        if tag in HIDDEN and not closing:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*+>?", re.I).search(page, at) if not attributes.endswith("/") else None
            at = end.end() if end else at if attributes.endswith("/") else n
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1) if inside[tag] > 0 else ():
                if stack[i][0] == tag:
                    pop(i)
                    break
            continue
        if tag in VOID or tag == "html":
            continue
        if stack[-1][0] == "p":
            pop(len(stack) - 1)
        if tag in _CLOSES:
            ends, until = _CLOSES[tag]
            for i in range(len(stack) - 1, 0, -1) if any(inside[t] > 0 for t in ends) else ():
                if stack[i][0] in ends:
                    pop(i)
                    break
                if stack[i][0] in until:
                    break
        if not attributes.endswith("/"):
            stack.append((tag, paths.child(stack[-1][1], tag, attributes)))
            inside[tag] += 1
    flush()
    return out


def _bin(x: float, *cuts: float) -> int:
    return sum(x >= c for c in cuts)


def shape(found: list[Block], i: int) -> tuple[str, ...]:
    """Features of a block's text and place."""
    b = found[i]
    text = b.text
    words = _bin(text.count(" ") + 1, 2, 4, 8, 16, 32, 64)
    linked = _bin(b.linked / max(1, len(text)), 0.01, 0.34, 0.67)
    ends = text[-1] in ".!?…:;\"'»”)"
    mark = "©" in text[:12] or "·" in text
    alike = (i > 0 and found[i - 1].path == b.path) + (i + 1 < len(found) and found[i + 1].path == b.path)
    return (f"words {words}", f"linked {linked}", f"ends {ends} {min(words, 4)}", f"mark {mark}", f"alike {alike} {min(words, 3)}", f"first {i == 0}", f"last {i + 1 == len(found)}")


@dataclass
class Field:
    """Weights of the features for main against other, and of neighbouring labels without and with the same path."""

    weights: dict[str, float]
    bias: float
    pairs: np.ndarray  # [same path][label before][label]
    paths: Paths = field(default=None)
    path_scores: list[float] = field(default_factory=list)
    shape_scores: dict[tuple[str, ...], float] = field(default_factory=dict)

    def __post_init__(self):
        self.paths = self.paths or Paths(self.weights.keys())

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "pairs": self.pairs}

    def __setstate__(self, state):
        self.__init__(**state)

    def decode(self, found: list[Block]) -> list[bool]:
        """Whether each block is main: the most probable labels of the whole chain, by Viterbi."""
        weights, scores = self.weights, self.path_scores
        while len(scores) < len(self.paths.features):
            scores.append(sum(weights.get(f, 0.0) for f in self.paths.features[len(scores)]))
        pairs = self.pairs.tolist()
        other, main, back, before = 0.0, 0.0, [], None
        for i, b in enumerate(found):
            key = shape(found, i)
            value = self.shape_scores.get(key)
            if value is None:
                value = self.shape_scores[key] = sum(weights.get(f, 0.0) for f in key)
            value += scores[b.path] + self.bias
            if i:
                p = pairs[b.path == before]
                from_other, from_main = other + p[0][0], main + p[1][0]
                to_other, to_main = other + p[0][1], main + p[1][1]
                back.append((from_main > from_other, to_main > to_other))
                other, main = max(from_other, from_main), max(to_other, to_main) + value
            else:
                main = value
            before = b.path
        label = main > other
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1] if found else []

    def extract(self, page: str | None) -> str:
        """The main text of a whole page; empty for null, empty or all-other pages."""
        if len(self.paths.features) > 50_000 or len(self.shape_scores) > 50_000:  # a bound on what a worker keeps
            self.paths, self.path_scores, self.shape_scores = Paths(self.weights.keys()), [], {}
        found = blocks(page or "", self.paths)
        return "\n".join(b.text for b, main in zip(found, self.decode(found), strict=True) if main)


def fit(pages: list[str], steps: int = 150, rate: float = 0.1, l2: float = 0.02) -> Field:
    """Trains the field on pages whose leaves are marked (see ``html_pages``), by Adam on the penalised likelihood."""
    paths, rows, vocabulary = Paths(), [], {}
    for page in pages:
        found = blocks(page, paths)
        labels = [html_pages.MAIN in b.text for b in found]
        for b in found:
            b.text = b.text.replace(html_pages.MAIN, "").replace(html_pages.OTHER, "").strip() or "."
        names = [(*paths.features[b.path], *shape(found, i)) for i, b in enumerate(found)]
        same = [i > 0 and found[i - 1].path == b.path for i, b in enumerate(found)]
        if found:
            rows.append((labels, same, [[vocabulary.setdefault(f, len(vocabulary)) for f in x] for x in names]))
    p, n = len(rows), max(len(r[0]) for r in rows)
    x = np.zeros((p, n, len(vocabulary)), np.float32)
    y, same, mask = np.zeros((p, n), int), np.zeros((p, n), int), np.zeros((p, n), bool)
    for k, (labels, alike, names) in enumerate(rows):
        m = len(labels)
        y[k, :m], same[k, :m], mask[k, :m] = labels, alike, True
        for i, at in enumerate(names):
            x[k, i, at] = 1
    flat = x.reshape(p * n, -1)
    theta = np.zeros(len(vocabulary) + 1 + 8)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    step_mask = mask[:, 1:]
    for t in range(1, steps + 1):
        w, bias, pairs = theta[: len(vocabulary)], theta[len(vocabulary)], theta[-8:].reshape(2, 2, 2)
        main = (flat @ w.astype(np.float32)).reshape(p, n) + bias
        unary = np.stack([np.zeros_like(main), main], 2)
        move = pairs[same]  # [page, block, before, label]
        ahead, behind = np.zeros((p, n, 2)), np.zeros((p, n, 2))
        ahead[:, 0] = unary[:, 0]
        for i in range(1, n):
            nxt = np.logaddexp(ahead[:, i - 1, 0, None] + move[:, i, 0], ahead[:, i - 1, 1, None] + move[:, i, 1]) + unary[:, i]
            ahead[:, i] = np.where(mask[:, i, None], nxt, ahead[:, i - 1])
        for i in range(n - 2, -1, -1):
            to = move[:, i + 1] + (unary[:, i + 1] + behind[:, i + 1])[:, None]
            behind[:, i] = np.where(mask[:, i + 1, None], np.logaddexp(to[:, :, 0], to[:, :, 1]), 0)
        z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        p_main = np.exp(np.clip(ahead[..., 1] + behind[..., 1] - z[:, None], -60, 0)) * mask
        both = ahead[:, :-1, :, None] + move[:, 1:] + (unary + behind)[:, 1:, None] - z[:, None, None, None]
        both = np.exp(np.clip(both, -60, 0)) * step_mask[..., None, None]
        seen = np.zeros_like(both)
        a, b = np.nonzero(step_mask)
        seen[a, b, y[a, b], y[a, b + 1]] = 1
        rest = (y * mask - p_main).astype(np.float32)
        g_pairs = np.stack([((seen - both) * (same[:, 1:] == k)[..., None, None]).sum((0, 1)) for k in (0, 1)])
        g = np.concatenate([flat.T @ rest.ravel(), [rest.sum()], g_pairs.ravel()]) / p - l2 * theta * np.append(np.ones(len(vocabulary)), np.full(9, 0.1)) / 10
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        theta = theta + rate * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return Field({f: float(theta[i]) for f, i in vocabulary.items()}, float(theta[len(vocabulary)]), theta[-8:].reshape(2, 2, 2).copy())


@cache
def trained(pages: int = TRAINING_PAGES) -> Field:
    return fit(html_pages.labelled_pages(pages))


def extract(pages: DataFrame, model: Field, html: str = "html", keep_html: bool = True) -> DataFrame:
    """Adds ``text``, the main text, and ``n_chars``, its code points, to every row; null and empty pages have an empty text.

    Repeated rows are returned as often, an empty table empty.  Columns of the table that are named text or n_chars
    are replaced by the results; all others are kept.
    """
    C.prepare(pages.sparkSession)
    shipped = pages.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    def make():
        field_ = shipped.value

        def block(texts):
            got = [field_.extract(t) for t in texts]
            return {"text": got, "n_chars": [len(t) for t in got]}

        return block

    return C.add_columns(pages, html, C.fields("text string, n_chars long"), make, drop=() if keep_html else (html,))
