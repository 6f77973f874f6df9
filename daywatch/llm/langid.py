"""Language identification by segmentation-marginalised unigrams.

A language has a probability for every piece of a fixed public vocabulary.  A word's
probability is the sum over all its segmentations into pieces of the products of their
probabilities, by the forward algorithm; a text's is the product over its words.  The
piece probabilities are fitted by expectation-maximisation: expected piece counts come
from the forward and backward sums, word types and their counts are summed on Spark.

No piece is left out for its length or rarity, and words of any length are summed end
to end, in logarithms.  The sums of many words run as one array step per position.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from daywatch.llm.common import bounded_sample, id_remainder, stored, text_of
from daywatch.llm.pieces import MARK, model_path

LETTERS = re.compile(r"[^\W\d_]+")
FLOOR = 1e-8          # probability of a character that no piece covers
AT_ONCE = 100_000     # characters of the words whose sums run together


def fixed_vocabulary(path: str | None = None) -> list[str]:
    """Pieces that consist of lower-case letters, some after a word's mark."""
    import sentencepiece
    p = sentencepiece.SentencePieceProcessor(model_file=model_path(path))
    found = {p.id_to_piece(i) for i in range(p.get_piece_size())
             if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))}
    return sorted(s for s in found
                  if s == MARK or (s.lstrip(MARK) == s.lstrip(MARK).lower()
                                   and re.fullmatch(rf"{MARK}?[^\W\d_]+", s)))


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


class Trie:
    """Beginnings of pieces in a hash table of arrays, walked from many places at once."""

    def __init__(self, pieces: list[str]):
        chars = sorted(set("".join(pieces)))
        self.code = np.zeros(0x110000, np.int32)         # 0: in no piece
        self.code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.letters, self.floor = len(chars) + 1, len(pieces)
        node = {"": 0}
        for p in pieces:
            for i in range(1, len(p) + 1):
                node.setdefault(p[:i], len(node))
        self.piece = np.full(len(node), -1)
        self.piece[[node[p] for p in pieces]] = np.arange(len(pieces))
        self.shift = 64 - max(8, (4 * len(node)).bit_length())
        self.key = np.full(1 << (64 - self.shift), -1, np.int64)
        self.to = np.full(len(self.key), -1)
        own = [(node[p[:-1]] * self.letters + int(self.code[ord(p[-1])]), n) for p, n in node.items() if p]
        for (key, n), slot in zip(own, self.slots(np.array([k for k, _ in own], np.int64)).tolist()):
            while self.key[slot] >= 0:
                slot = (slot + 1) % len(self.key)
            self.key[slot], self.to[slot] = key, n

    def slots(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(self.shift)).astype(np.int64)

    def children(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node after `code`, -1 where there is none."""
        key = node * self.letters + code
        slot = self.slots(key)
        there = self.key[slot]
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.key)
            there = self.key[slot[open_]]
            open_ = open_[(there != key[open_]) & (there >= 0)]
        return np.where(self.key[slot] == key, self.to[slot], -1)

    def lattice(self, words: list[str]) -> "Lattice":
        """Every piece at every place of the marked words; the floor piece where no
        single character fits."""
        text = "".join(f"{MARK}{w}\0" for w in words)
        code = self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        last = np.cumsum(size) - 1                       # a word's end, the separator
        inside = np.ones(len(code), bool)
        inside[last] = False
        at = np.flatnonzero(inside)
        begin, end, piece = [], [], []
        start, node, length = at, np.zeros(len(at), np.int64), 0
        while len(start):
            here = code[start + length]                  # separators have no code
            node = np.where(here > 0, self.children(node, here), -1)
            found = np.where(node >= 0, self.piece[node], -1)
            if not length:
                found[found < 0] = self.floor
            hit = found >= 0
            length += 1
            begin.append(start[hit])
            end.append(start[hit] + length)
            piece.append(found[hit])
            start, node = start[node >= 0], node[node >= 0]
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        return Lattice(cat(begin), cat(end), cat(piece), last - size + 1, last, size)


@dataclass
class Lattice:
    """Pieces from `begin` to `end`, and the first and last place of each word."""
    begin: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    first: np.ndarray
    last: np.ndarray
    size: np.ndarray

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """Log of the summed segmentations from a word's first place to every place."""
        depth = self.end - np.repeat(self.first, self.size)[self.begin]
        return self.summed(self.begin, self.end, depth, logs, self.first)

    def backward(self, logs: np.ndarray) -> np.ndarray:
        """The same from every place to a word's last one."""
        depth = np.repeat(self.last, self.size)[self.begin] - self.begin
        return self.summed(self.end, self.begin, depth, logs, self.last)

    def summed(self, source, target, depth, logs, start) -> np.ndarray:
        out = np.full((int(self.size.sum()), logs.shape[1]), -np.inf)
        out[start] = 0.0
        order = np.lexsort((target, depth))
        source, target, logs = source[order], target[order], logs[order]
        steps = np.flatnonzero(np.diff(depth[order], prepend=-1))
        for lo, hi in zip(steps, np.append(steps[1:], len(order))):
            to = target[lo:hi]
            new = np.flatnonzero(np.diff(to, prepend=-1))
            out[to[new]] = _log_sums(out[source[lo:hi]] + logs[lo:hi], new)
        return out


def _log_sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log of the summed exponentials of runs of rows."""
    top = np.maximum.reduceat(x, starts, axis=0)
    size = np.diff(np.append(starts, len(x)))
    return top + np.log(np.add.reduceat(np.exp(x - np.repeat(top, size, axis=0)), starts, axis=0))


def together(words: list[str], most: int = AT_ONCE):
    """Slices of the words with at most `most` characters, or one longer word."""
    lo = total = 0
    for hi, w in enumerate(words):
        if total and total + len(w) > most:
            yield slice(lo, hi)
            lo, total = hi, 0
        total += len(w) + 2
    if total:
        yield slice(lo, len(words))


@dataclass
class Model:
    langs: list[str]
    pieces: dict                      # piece -> tuple of probabilities, one per language
    keep: int = 250_000
    state: dict = field(default_factory=dict)      # tables of a worker, built on first use

    def __getstate__(self):
        return self.langs, self.pieces, self.keep

    def __setstate__(self, state):
        self.langs, self.pieces, self.keep = state
        self.state = {}

    def _tables(self):
        if not self.state:
            width = len(self.langs)
            probs = np.array([*self.pieces.values(), (FLOOR,) * width], float).reshape(-1, width)
            empty = np.empty((0, width))
            self.state = {"trie": Trie(list(self.pieces)), "logs": np.log(probs), "known": {},
                          "rows": empty, "older": {}, "older_rows": empty}
        return self.state

    def words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word in each language, all segmentations summed."""
        t = self._tables()
        out = np.zeros((len(words), len(self.langs)))
        for part in together(words):
            net = t["trie"].lattice(words[part])
            out[part] = net.forward(t["logs"][net.piece])[net.last]
        return out

    def expected(self, lang: np.ndarray, words: list[str], n: np.ndarray) -> np.ndarray:
        """Expected number of each piece in each language; word k counts n[k] times in
        the language numbered lang[k]."""
        t = self._tables()
        out = np.zeros(t["logs"].shape)
        for part in together(words):
            net = t["trie"].lattice(words[part])
            owner = np.repeat(np.arange(len(net.size)), net.size)[net.begin]
            own = lang[part][owner]
            logs = t["logs"][net.piece, own][:, None]
            alpha, beta = net.forward(logs), net.backward(logs)
            share = alpha[net.begin] + logs + beta[net.end] - alpha[net.last][owner]
            np.add.at(out, (net.piece, own), np.exp(share[:, 0]) * n[part][owner])
        return out[:-1]

    def texts(self, texts: list[str]) -> list[np.ndarray | None]:
        """Sums over the words of each text; None for one without letters.

        Known words lie in two tables: when the younger is full it becomes the older, and
        words met again move on, so frequent ones stay.
        """
        t = self._tables()
        if len(t["known"]) > self.keep:
            t["older"], t["older_rows"] = t["known"], t["rows"]
            t["known"], t["rows"] = {}, t["rows"][:0]
        known, older = t["known"], t["older"]
        words = [words_of(x) for x in texts]
        missing = list(set(chain.from_iterable(words)).difference(known))
        if missing:
            old = [w for w in missing if w in older]
            new = [w for w in missing if w not in older]
            known.update((w, len(known)) for w in old + new)
            t["rows"] = np.concatenate((
                t["rows"], t["older_rows"][[older[w] for w in old]], self.words(new)))
        rows = t["rows"]
        return [rows[np.fromiter(map(known.__getitem__, own), np.int64, len(own))].sum(axis=0)
                if own else None for own in words]

    def text(self, text: str) -> np.ndarray | None:
        return self.texts([text])[0]


def _word_counts(batches):
    for b in batches:
        count = Counter()
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            count.update((lang, w) for w in words_of(text))
        lang, word = zip(*count) if count else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(word, pa.string()),
             pa.array(count.values(), pa.int64())], ["lang", "word", "n"])


def _expect(batches, langs, pieces):
    at, model = {x: i for i, x in enumerate(langs)}, Model(langs, pieces)
    total = np.zeros((len(pieces), len(langs)))
    for b in batches:
        lang = np.array([at[x] for x in b.column(0).to_pylist()], np.int64)
        total += model.expected(lang, b.column(1).to_pylist(), b.column(2).to_numpy())
    piece, lang = np.nonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(lang, pa.int32()), pa.array(piece, pa.int32()), pa.array(total[piece, lang])],
        ["lang", "piece", "e"])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        path: str | None = None, bound: int = 8000, rounds: int = 3, smooth: float = 0.05,
        seed: int = 3) -> Model:
    """Fit on at most about `bound` rows with a language whose crc32(id) mod 4 is not 2.

    Repeated rows count as often as they occur.  Without such rows the model knows no
    language.  Other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("lang"),
                       text_of(text_col).alias("text"))
    rows = rows.filter("lang is not null").filter(id_remainder("_id", 4) != 2)
    rows = bounded_sample(rows, "_id", bound, seed).select("lang", "text")
    counts = rows.mapInArrow(_word_counts, "lang string, word string, n bigint")
    counts = stored(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    langs = [r[0] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    vocabulary = fixed_vocabulary(path)
    pieces = {p: (1.0 / len(vocabulary),) * len(langs) for p in vocabulary}
    for _ in range(rounds if langs else 0):
        now = pieces
        found = (counts.mapInArrow(lambda it: _expect(it, langs, now), "lang int, piece int, e double")
                 .groupBy("lang", "piece").agg(F.sum("e").alias("e")).toPandas())
        e = np.full((len(vocabulary), len(langs)), smooth)   # pieces x languages
        e[found["piece"], found["lang"]] += found["e"]
        pieces = dict(zip(vocabulary, map(tuple, (e / e.sum(axis=0)).tolist())))
    return Model(langs, pieces)


def _identify(batches, model):
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            texts = part.column(1).to_pylist()
            lang, score = [], []
            for z in model.texts(texts) if model.langs else [None] * len(texts):
                if z is None:
                    lang.append("und")
                    score.append(0.0)
                    continue
                p = np.exp(z - z.max())
                best = int(z.argmax())
                lang.append(model.langs[best])
                score.append(float(p[best] / p.sum()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                ["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (the posterior of the language).

    Whole texts; memory follows the batch's new words, or the longest word.  `und` with
    score 0 for texts without letters, null and empty ones included, and when nothing
    could be learned.  Ties go to the language first by code point.  Every row is
    answered by itself, so repeated rows get equal answers; an empty table gives no rows.
    A null id is not held out.  Other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    found = rows.mapInArrow(lambda it: _identify(it, model),
                            "doc_id bigint, lang_pred string, score double")
    return found.select("doc_id", F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
                        .alias("held_out"), "lang_pred", "score")
