"""A counterfactually regularised toxicity classifier.

Features are the words a text holds (lower case, runs of letters), presence only, from
a vocabulary chosen by how unlikely a word's counts in both classes are by chance, at a
false discovery rate that is the same at every size.  In every labelled text that names an identity term the terms of its sentences
are swapped for other terms; the squared change of the logit is a penalty of the fit.
So a group's name cannot raise the score by itself.

Fitting reads a bounded, documented sample of labelled rows; word counts are summed on
Spark.  Scoring is a map over whole texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from daywatch.llm.common import bounded_sample, id_remainder, stored, text_of

# Terms that name groups of people.
IDENTITY_TERMS = (
    "women", "men", "woman", "man", "girls", "boys", "mothers", "fathers",
    "muslims", "christians", "jews", "hindus", "buddhists", "atheists",
    "muslim", "christian", "jewish", "hindu", "buddhist", "atheist",
    "black", "white", "asian", "african", "european", "american", "mexican", "arab",
    "gay", "lesbian", "straight", "transgender", "bisexual",
    "immigrants", "refugees", "foreigners", "natives",
    "blind", "deaf", "disabled", "elderly", "young", "old",
)
LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]+")


@dataclass(frozen=True)
class Model:
    weights: dict            # word -> weight
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        get = self.weights.get
        known = self.weights.keys()
        z = [self.bias + sum(map(get, known & set(LETTERS.findall(t.lower())))) for t in texts]
        return 1 / (1 + np.exp(-np.clip(np.array(z, float), -500, 500)))


def _words(batches):
    """(toxic, word, 1) for each distinct word of a text."""
    for b in batches:
        for at in range(0, b.num_rows, 256):
            part = b.slice(at, 256)
            label, word = [], []
            for y, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                own = set(LETTERS.findall(t.lower()))
                word += own
                label += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(word, pa.string())],
                                             ["toxic", "word"])


def swap_terms(sentence_words: list[str], terms=IDENTITY_TERMS, step: int = 1) -> list[str]:
    """The words with every identity term replaced by another one."""
    place = {t: i for i, t in enumerate(terms)}
    n = len(terms)
    return [terms[(place[w] + 1 + (step % (n - 1))) % n] if w in place else w
            for w in sentence_words]


def _encode(batches, vocabulary, terms, swaps):
    """Vocabulary indexes of a text and of its counterfactuals (empty: no term in it)."""
    index, group = {w: i for i, w in enumerate(vocabulary)}, set(terms)
    for b in batches:
        label, own, other = [], [], []
        for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            sentences = [LETTERS.findall(s) for s in SENTENCE.split(t.lower())]
            words = set().union(*sentences) if sentences else set()
            label.append(y)
            own.append(sorted(index[w] for w in words if w in index))
            changed = []
            if words & group:
                for k in range(swaps):
                    w2 = set()
                    for i, s in enumerate(sentences):
                        w2.update(swap_terms(s, terms, 7 * k + i))
                    changed.append(sorted(index[w] for w in w2 if w in index))
            other.append(changed)
        yield pa.RecordBatch.from_arrays(
            [pa.array(label, pa.int32()), pa.array(own, pa.list_(pa.int32())),
             pa.array(other, pa.list_(pa.list_(pa.int32())))], ["toxic", "own", "other"])


def _rows(lists, width):
    """Row and column indexes of a presence matrix."""
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    col = np.concatenate([np.asarray(x, np.int64) for x in lists] or [np.empty(0, np.int64)])
    return row, col.astype(np.int64)


def train(labels, own, other, vocabulary, penalty=1.0, ridge=1e-4, steps=400, rate=0.1) -> Model:
    """Logistic regression with counterfactual penalty, full-batch Adam on the sample."""
    y = np.asarray(labels, float)
    width, n = len(vocabulary), len(y)
    row, col = _rows(own, width)
    pairs = [(i, c) for i, cs in enumerate(other) for c in cs]
    source = np.array([i for i, _ in pairs], np.int64)
    prow, pcol = _rows([c for _, c in pairs], width)
    w, b = np.zeros(width), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = b + np.bincount(row, w[col], n)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        err = (p - y) / n
        g = np.bincount(col, err[row], width) + ridge * w
        if len(pairs):
            # squared logit change between a text and its counterfactual
            delta = (z - b)[source] - np.bincount(prow, w[pcol], len(pairs))
            back = 2 * penalty * delta / len(pairs)
            per_row = np.bincount(source, back, n)
            g += np.bincount(col, per_row[row], width) - np.bincount(pcol, back[prow], width)
        grad = np.append(g, err.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad ** 2
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return Model({x: float(a) for x, a in zip(vocabulary, w)}, float(b))


def labelled_texts(docs, labels, label_col, held_out, id_col, text_col, bound, seed):
    """(label, text) of at most about `bound` labelled rows that are not held out.

    Equal texts count once, so copies carry no extra weight.  The sample of ids is
    bounded by the parameter; it is small enough to broadcast at any input size.
    """
    parts, out = held_out
    marks = (labels.select(F.col("doc_id").alias("_k"), F.col(label_col).cast("int").alias("_y"))
             .filter("_k is not null and _y is not null")
             .filter(id_remainder("_k", parts) != out)
             .groupBy("_k").agg(F.max("_y").alias("_y")))
    marks = stored(bounded_sample(marks, "_k", bound, seed), "label-sample")
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text"))
    both = texts.join(F.broadcast(marks), F.col("_id") == F.col("_k"))
    return (both.groupBy(F.xxhash64("text").alias("_h"))
            .agg(F.max("_y").alias("toxic"), F.first("text").alias("text")).select("toxic", "text"))


def tails(n: int, pos: int, a: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of a word that lies in `a` of `n` texts at random, `pos` of them toxic.

    First: of being in `p` or more toxic texts, or in `p` or fewer, whichever is rarer.
    Second: the smallest such chance that any count of toxic texts could have.
    """
    fact = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, n + 1)))))
    choose = lambda x, y: fact[x] - fact[y] - fact[x - y]      # noqa: E731
    chance, least = np.empty(len(a)), np.empty(len(a))
    for x in np.unique(a):
        lo, hi = max(0, x - (n - pos)), min(x, pos)
        k = np.arange(lo, hi + 1)
        each = np.exp(choose(pos, k) + choose(n - pos, x - k) - choose(n, x))
        up, down = np.cumsum(each[::-1])[::-1], np.cumsum(each)
        own = np.flatnonzero(a == x)
        chance[own] = np.minimum(up, down)[p[own] - lo]
        least[own] = min(each[0], each[-1])
    return chance, least


def telling(n: int, pos: int, a, p, words, rate: float) -> np.ndarray:
    """Which (a, p) pairs, with their numbers of words, tell toxic texts from others.

    The false discovery rate is held at `rate`: the highest chance t is taken at which
    t times the words that could reach t at all is at most `rate` times the words that
    did.  Nothing else gates a word, whatever the number of texts.
    """
    a, p, words = (np.asarray(x, np.int64) for x in (a, p, words))
    chance, least = tails(n, pos, a, p)
    order = np.argsort(chance, kind="stable")
    did = np.cumsum(words[order])
    at = np.argsort(least, kind="stable")
    could = np.concatenate(([0], np.cumsum(words[at])))[np.searchsorted(least[at], chance[order], "right")]
    good = np.flatnonzero(chance[order] * could <= rate * did)
    return chance <= chance[order][good[-1]] if len(good) else np.zeros(len(a), bool)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        bound: int = 20_000, rate: float = 0.1, penalty: float = 1.0, swaps: int = 2,
        terms=IDENTITY_TERMS, seed: int = 5) -> Model:
    """Fit on at most about `bound` labelled rows whose crc32(id) mod 5 is not 0.

    The vocabulary is every word that `telling` lets in, and the identity terms.  Without
    labelled texts of both classes every text gets the share of toxic ones; an empty
    table, a score near 0.  Rows with a null id or label teach nothing, copies once.
    Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    rows = stored(labelled_texts(docs, labels, "toxic", (5, 0), id_col, text_col, bound, seed),
                  "toxic-sample")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("pos")).first()
    n, pos = size["n"], size["pos"]
    if n == 0 or pos == 0 or pos == n:   # nothing to learn: the share of toxic rows
        share = (pos + 0.5) / (n + 1) if n else 0.0
        return Model({}, float(np.log(share / (1 - share))) if share else -20.0)
    counts = stored(rows.mapInArrow(_words, "toxic int, word string").groupBy("word")
                    .agg(F.sum("toxic").alias("p"), F.count(F.lit(1)).alias("a")), "toxic-words")
    pairs = counts.groupBy("a", "p").count().toPandas()    # text counts of the bounded sample
    pairs = pairs[telling(n, pos, pairs["a"], pairs["p"], pairs["count"], rate)][["a", "p"]]
    chosen = spark.createDataFrame(pairs.values.tolist(), "a bigint, p bigint")
    best = counts.join(F.broadcast(chosen), ["a", "p"]).select("word").collect()
    vocabulary = sorted({r[0] for r in best} | set(terms))
    coded = rows.mapInArrow(lambda it: _encode(it, vocabulary, terms, swaps),
                            "toxic int, own array<int>, other array<array<int>>").toPandas()
    coded = coded.sort_values("toxic", kind="stable")
    return train(coded["toxic"], list(coded["own"]), [list(x) for x in coded["other"]], vocabulary,
                 penalty)


def _score(batches, model):
    for b in batches:
        for at in range(0, b.num_rows, 512):
            part = b.slice(at, 512)
            s = model.scores(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(s, pa.float64()),
                 pa.array((s >= 0.5).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.  Whole texts; null counts as empty.

    An empty text has the score of no evidence.  Every row is scored by itself, so
    repeated rows get equal scores; an empty table gives no rows; a null id is not held
    out.  Other columns are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    scored = rows.mapInArrow(lambda it: _score(it, model),
                             "doc_id bigint, score double, predicted int")
    return scored.select("doc_id", F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
                         .alias("held_out"), "score", "predicted")


def clean_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                    text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns, that the classifier does not call toxic."""
    model = fit(docs, labels, id_col, text_col, **options)
    names = docs.columns

    def keep(batches):
        at = names.index(text_col)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                texts = [t or "" for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(model.scores(texts) < 0.5))

    return docs.mapInArrow(keep, docs.schema)
