"""Operator 8: token counts with the whole-token shortcut.

The library's answer for a text is the sum over independent pieces: no vocabulary string holds a space mark after
another character, and none holds certain neighbouring characters at all, so no merge crosses such a boundary
(``SafeCuts`` proves this from the vocabulary).  Offline, once per vocabulary, every string that a piece can be is
encoded alone; those that come out as exactly one token form the shortcut table.  A piece found there counts one
without any merge; only the other pieces are merged, each distinct piece once per worker while the bounded cache lasts.
"""

from __future__ import annotations

import re
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_pb

from . import _common as C

#: Distinct merged pieces whose codes a worker keeps at most.
CACHE_ENTRIES = 500_000
CACHE_CHARS = 48
#: Words between spaces that are looked up together, and words merged by one call of the library.
RUN_WORDS = 1 << 21
MERGED_WORDS = 64

MARK = "▁"  # stands for a space inside the vocabulary


class PieceCounter:
    """Token codes of texts under a sentencepiece BPE model.

    ``whole`` maps each piece that is one token alone to its id; ``split`` cuts a text at places which no vocabulary
    string spans.  Models whose normalisation changes texts, that drop white space or that join a space to the word
    before it are refused, since the cuts would not be proved for them.
    """

    def __init__(self, path: str):
        proto = model_pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kinds = proto.normalizer_spec, model_pb.ModelProto.SentencePiece
        if (
            norm.precompiled_charsmap
            or norm.remove_extra_whitespaces
            or not (norm.add_dummy_prefix and norm.escape_whitespaces)
            or proto.trainer_spec.treat_whitespace_as_suffix
            or proto.trainer_spec.model_type != model_pb.TrainerSpec.BPE
            or any(p.type == kinds.USER_DEFINED for p in proto.pieces)
        ):
            raise ValueError(f"{path}: pieces of this model are not proved independent")
        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [p.piece for p in proto.pieces if p.type == kinds.NORMAL]
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError(f"{path}: a token has a space after another character")
        #: Characters that no token of two or more characters holds: nothing merges with them.
        inside = {c for p in normal if len(p) > 1 for c in p}
        self.alone = [c for c in map(chr, range(0x20)) if c not in inside]
        self.cut = re.compile(f"[^{MARK}{re.escape(''.join(self.alone))}]+|{MARK}+[^{MARK}{re.escape(''.join(self.alone))}]*|[{re.escape(''.join(self.alone))}]")
        #: The proof of the shortcut: strings that the model, given them alone, encodes as themselves.
        self.whole = {p: i for p, i in ((p, self._merge(p)) for p in normal if p == p.lstrip(MARK) or p[0] == MARK) if len(i) == 1}
        self.n_whole = len(self.whole)
        #: By id: whether the token begins with a mark, that is a word.
        self.opens = np.array([p.type == kinds.NORMAL and p.piece[0] == MARK for p in proto.pieces])

    def _merge(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece by the model's merges.  The library puts a mark first, which the piece must then have."""
        if piece[0] == MARK:
            return tuple(self.lib.encode(piece[1:].replace(MARK, " "))) if len(piece) > 1 else (self.lib.piece_to_id(MARK),)
        # no merge crosses a line feed (it is one of ``alone``), so what follows one is encoded without a mark
        return tuple(self.lib.encode("\n" + piece)[self.lead :])

    @property
    def lead(self) -> int:
        if not hasattr(self, "_lead"):
            self._lead = len(self.lib.encode("\n"))
        return self._lead

    def pieces(self, text: str) -> list[str]:
        """The independent pieces of a text, which is first marked as the model does; none for an empty text."""
        return self.cut.findall(MARK + text.replace(" ", MARK)) if text else []

    def ids(self, piece: str) -> tuple[int, ...]:
        return self.whole.get(piece) or self._merge(piece)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that each follow a space, one after the other, and where each word's end; no merge crosses a space."""
        got: list[int] = []
        for at in range(0, len(words), MERGED_WORDS):
            got += self.lib.encode(" ".join(words[at : at + MERGED_WORDS]))
        ids = np.frombuffer(array("I", got), np.uint32)
        begin = np.flatnonzero(self.opens[ids])
        if len(begin) == len(words):
            return ids, np.append(begin[1:], len(ids))
        each = [self.lib.encode(w) for w in words]  # a vocabulary without a mark of its own
        return np.array([i for w in each for i in w], np.uint32), np.cumsum([len(w) for w in each])

    @staticmethod
    def plain(texts: pa.Array) -> np.ndarray:
        """Whether the words of each text between single spaces are independent: no run of spaces, none at an end, no mark."""
        odd = pc.or_(pc.match_substring(texts, "  "), pc.match_substring(texts, MARK))
        odd = pc.or_(odd, pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        return ~pc.or_(odd, pc.equal(pc.binary_length(texts), 0)).to_numpy(zero_copy_only=False)


class WordTable(dict):
    """Word between spaces to the number of its ids, or to the ids themselves as bytes.

    A word holds one independent piece or more (marks that nothing merges with cut it).  For counts only words that
    are not proved whole tokens are merged.  Whole blocks of texts go through Arrow's split and dictionary, so each distinct
    word of a block is looked up once.
    """

    def __init__(self, counter: PieceCounter, as_ids: bool = False):
        super().__init__()
        self.counter, self.as_ids = counter, as_ids

    def of_words(self, words: list[str]) -> list:
        """The value of each word; words hold neither spaces nor marks."""
        out = list(map(self.get, words))
        fresh = [i for i, v in enumerate(out) if v is None]
        merge = fresh
        if not self.as_ids:
            whole, merge = self.counter.whole, []
            for i in fresh:
                if MARK + words[i] in whole:
                    out[i] = 1
                else:
                    merge.append(i)
        if merge:
            ids, ends = self.counter.merged([words[i] for i in merge])
            if self.as_ids:
                raw, ends = ids.tobytes(), (4 * ends).tolist()
                values = map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))
            else:
                values = np.diff(ends, prepend=0).tolist()
            for i, value in zip(merge, values, strict=True):
                out[i] = value
        room = max(0, CACHE_ENTRIES - len(self))
        self.update((words[i], out[i]) for i in fresh[:room] if len(words[i]) <= CACHE_CHARS)
        return out

    def of_text(self, text: str):
        """The value of a text whose words are not independent, piece by piece."""
        ids = [i for p in self.counter.pieces(text) for i in self.counter.ids(p)]
        return np.array(ids, np.uint32).tobytes() if self.as_ids else len(ids)

    def _blocks(self, texts: pa.Array):
        """(which texts are plain, words of each of those, runs of (distinct words, place of each word among them))."""
        ok = np.ones(len(texts), bool)
        lists, runs = _coded(texts)
        if any(_odd(words) for words, _ in runs):
            ok = self.counter.plain(texts)
            lists, runs = _coded(texts.filter(pa.array(ok)))
        return ok, pc.list_value_length(lists).to_numpy(), ((self.of_words(words.to_numpy(zero_copy_only=False).tolist()), at.to_numpy()) for words, at in runs)

    @staticmethod
    def _sums(n: list[np.ndarray], words: np.ndarray) -> np.ndarray:
        """Sums of ``n``, one number for each word, by text; every text has a word."""
        return np.add.reduceat(np.concatenate(n), np.cumsum(words) - words, dtype=np.int64) if len(words) else np.zeros(0, np.int64)

    def totals(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text, none of which is null."""
        ok, words, runs = self._blocks(texts)
        n = [_sizes(values)[at] for values, at in runs]
        out = np.zeros(len(texts), np.int64)
        out[ok] = self._sums(n, words)
        odd = np.flatnonzero(~ok)
        out[odd] = _sizes([self.of_text(texts[i].as_py()) for i in odd.tolist()])
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of each; for a table of ids."""
        ok, words, runs = self._blocks(texts)
        n, flat = [], []
        for values, at in runs:
            own, size = np.frombuffer(b"".join(values), np.uint32), _sizes(values)
            count = size[at]
            flat.append(own[spread((np.cumsum(size) - size)[at], count)])
            n.append(count)
        total = np.zeros(len(texts), np.int64)
        total[ok] = self._sums(n, words)
        odd = {i: np.frombuffer(self.of_text(texts[i].as_py()), np.uint32) for i in np.flatnonzero(~ok).tolist()}
        if not odd:
            return np.concatenate([np.zeros(0, np.uint32), *flat]), total
        total[list(odd)] = [len(x) for x in odd.values()]
        begin = np.cumsum(total) - total
        out = np.empty(int(total.sum()), np.uint32)
        out[spread(begin[ok], total[ok])] = np.concatenate([np.zeros(0, np.uint32), *flat])
        for i, x in odd.items():
            out[begin[i] : begin[i] + len(x)] = x
        return out, total


def _coded(texts: pa.Array) -> tuple[pa.ListArray, list[tuple[pa.Array, pa.Array]]]:
    """The texts cut at single spaces, and their words by dictionary in runs."""
    lists = pc.split_pattern(texts, " ")
    words = lists.flatten()
    runs = [words.slice(at, RUN_WORDS).dictionary_encode() for at in range(0, len(words), RUN_WORDS)]
    return lists, [(r.dictionary, r.indices) for r in runs]


def _odd(words: pa.Array) -> bool:
    """Whether a word is empty (a text is, or has spaces beside each other or at an end) or holds a mark."""
    return bool(pc.any(pc.or_(pc.equal(pc.binary_length(words), 0), pc.match_substring(words, MARK))).as_py())


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... (count[0] of them), begin[1], ..."""
    ends = np.cumsum(count)
    n = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if n < 1 << 30 and begin.max(initial=0) < 1 << 30 else np.int64
    out = np.repeat((begin - (ends - count)).astype(kind), count)
    out += np.arange(n, dtype=kind)
    return out


def _sizes(values: list) -> np.ndarray:
    if values and isinstance(values[0], bytes):
        return np.fromiter(map(len, values), np.int32, len(values)) >> 2
    return np.fromiter(values, np.int32, len(values))


@cache
def load(path: str) -> PieceCounter:
    return PieceCounter(path)


@cache
def counts(path: str) -> WordTable:
    return WordTable(load(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every whole text; null counts as empty."""
    C.prepare(docs.sparkSession)

    def make():
        C.claim("token_counts", counts.cache_clear)
        table = counts(path)

        def block(texts):
            whole = pc.fill_null(pa.array(texts, pa.string()), "")
            n = table.totals(whole)
            return {"n_bytes": pc.binary_length(whole), "n_tokens": n, "over_limit": n > limit}

        return block

    return C.add_columns(docs, text, C.fields("n_bytes long, n_tokens long, over_limit boolean"), make, drop=() if keep_text else (text,))
