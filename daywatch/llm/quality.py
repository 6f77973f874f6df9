"""A quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed for all texts in one pass over the bytes of Arrow batches, with
numpy.  Trees are grown on binned statistics of a bounded sample of labelled rows; a
fitted model is four flat arrays, and scoring walks all rows of a batch down a tree at
once, one array step per level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from daywatch.llm.common import (blocks_of, bounded_sample, id_remainder, span_hashes, stored,
                                 text_bytes, word_spans)

PUNCT = np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)


def _classes() -> np.ndarray:
    """Byte class by byte: letters, capitals, digits, white space, line feed, other, non-ASCII."""
    c = np.full(256, 5, np.int64)
    c[97:123], c[65:91], c[48:58] = 0, 1, 2
    c[[32, 9, 11, 12, 13]], c[10], c[128:] = 3, 4, 6
    return c


CLASS = _classes()
NAMES = ("log_bytes", "lower", "upper", "digit", "space", "line", "other", "high",
         *(f"p{chr(x)}" for x in PUNCT), "log_words", "word_len", "word_len_sd", "short_words",
         "long_words", "distinct_words", "top_word", "caps_words", "stop_ends", "log_lines",
         "line_words", "distinct_lines", "repeat_bytes", "sentence_words")


def _ratio(a, b):
    return a / np.maximum(b, 1)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics per text (columns NAMES)."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    row = np.repeat(np.arange(n), size)
    cols = [np.log1p(size)]
    kind = np.bincount(row * 7 + CLASS[data], minlength=n * 7).reshape(n, 7)
    cols += [_ratio(kind[:, k], size) for k in range(7)]
    slot = np.full(256, -1, np.int64)
    slot[PUNCT] = np.arange(len(PUNCT))
    s = slot[data]
    at = s >= 0
    marks = np.bincount(row[at] * len(PUNCT) + s[at], minlength=n * len(PUNCT)).reshape(n, -1)
    start, end, wrow = word_spans(data, offsets)
    words = np.bincount(wrow, minlength=n)
    cols += [_ratio(marks[:, k], words) for k in range(len(PUNCT))]
    length = end - start
    mean = _ratio(np.bincount(wrow, length, n), words)
    sd = np.sqrt(np.maximum(0, _ratio(np.bincount(wrow, length.astype(float) ** 2, n), words) - mean ** 2))
    h = span_hashes(data, start, end)
    distinct, top = _distinct(h, wrow, n)
    first, last = (data[start], data[end - 1]) if len(start) else (np.empty(0, np.uint8),) * 2
    stops = np.bincount(wrow, np.isin(last, np.frombuffer(b".!?", np.uint8)), n)
    cols += [np.log1p(words), mean, sd, _ratio(np.bincount(wrow, length <= 2, n), words),
             _ratio(np.bincount(wrow, length >= 14, n), words), _ratio(distinct, words),
             _ratio(top, words),
             _ratio(np.bincount(wrow, (first >= 65) & (first <= 90), n), words), _ratio(stops, words)]
    # lines: spans between line feeds that hold something
    feed = data == 10
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    inside = ~feed
    begin = np.flatnonzero(inside & (np.concatenate(([True], feed[:-1])) | edge[:-1])) if len(data) else start
    stop = (np.flatnonzero(inside & (np.concatenate((feed[1:], [True])) | edge[1:])) + 1
            if len(data) else start)
    lrow = np.searchsorted(offsets, begin, "right") - 1
    lines = np.bincount(lrow, minlength=n)
    dl, _ = _distinct(span_hashes(data, begin, stop), lrow, n)
    same = np.concatenate(([False], (data[1:] == data[:-1]) & ~edge[1:-1])) if len(data) else feed
    cols += [np.log1p(lines), np.log1p(_ratio(words, lines)), _ratio(dl, lines),
             _ratio(np.bincount(row, same, n), size), np.log1p(_ratio(words, stops))]
    return np.column_stack(cols).astype(np.float64)


def _distinct(h, row, n):
    """Per row: the number of distinct hashes, and how often the most frequent occurs."""
    if not len(h):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (row[1:] != row[:-1]))))
    run, own = np.diff(np.append(new, len(h))), row[new]
    top = np.zeros(n)
    np.maximum.at(top, own, run)
    return np.bincount(own, minlength=n), top


def _measure(batches):
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        for lo, hi in blocks_of(offsets, 1 << 21):
            own = offsets[lo:hi + 1]
            x = statistics(data[own[0]:own[-1]], own - own[0]).astype(np.float32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), flat.cast(pa.list_(pa.float32()))], ["doc_id", "x"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id and the statistics of the whole text (null as empty)."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string"))
    return rows.mapInArrow(_measure, "doc_id bigint, x array<float>")


@dataclass(frozen=True)
class Forest:
    """Complete trees of one depth: inner nodes and leaves by tree, in flat arrays."""
    feature: np.ndarray      # trees x (2^depth - 1)
    cut: np.ndarray          # go right when x > cut
    leaf: np.ndarray         # trees x 2^depth
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            z += leaf[node - inner]
        return z

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1,
         bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> Forest:
    """Newton boosting on binned columns; a node without a useful split sends all left."""
    n, width = x.shape
    share = np.clip(y.mean() if n else 0.5, 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    inner = 2 ** depth - 1
    empty = Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), base)
    if n < 2 * least or y.min() == y.max():
        return empty
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(width)]
    b = np.column_stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)])
    flat = b + np.arange(width) * bins
    z = np.full(n, base)
    feature = np.zeros((trees, inner), np.int64)
    cut = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2 ** level - 1, 2 ** level
            slot = ((node - first)[:, None] * (width * bins) + flat).ravel()
            shape = (count, width, bins)
            hg = np.bincount(slot, np.repeat(g, width), count * width * bins).reshape(shape).cumsum(2)
            hh = np.bincount(slot, np.repeat(h, width), count * width * bins).reshape(shape).cumsum(2)
            hn = np.bincount(slot, minlength=count * width * bins).reshape(shape).cumsum(2)
            tg, th, tn = hg[:, :, -1:], hh[:, :, -1:], hn[:, :, -1:]
            gain = hg ** 2 / (hh + ridge) + (tg - hg) ** 2 / (th - hh + ridge) - tg ** 2 / (th + ridge)
            gain[(hn < least) | (tn - hn < least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            for q in range(count):
                k, at = divmod(int(best[q]), bins)
                if gain[q, k, at] > 1e-9 and at < len(cuts[k]):
                    feature[t, first + q], cut[t, first + q] = k, cuts[k][at]
            node = 2 * node + 1 + (x[np.arange(n), feature[t][node]] > cut[t][node])
        own = node - inner
        value = -np.bincount(own, g, inner + 1) / (np.bincount(own, h, inner + 1) + ridge)
        leaf[t] = rate * value
        z += leaf[t][own]
    return Forest(feature, cut, leaf, base)


def fit(rows: DataFrame, labels: DataFrame, bound: int = 20_000, seed: int = 9, **options) -> Forest:
    """Fit on at most about `bound` labelled rows of `rows` (see `measured`) whose
    crc32(id) mod 4 is not 2."""
    marks = (labels.select(F.col("doc_id").alias("_k"), F.col("quality").cast("int").alias("_y"))
             .filter("_k is not null and _y is not null").filter(id_remainder("_k", 4) != 2)
             .groupBy("_k").agg(F.max("_y").alias("_y")))
    marks = bounded_sample(marks, "_k", bound, seed)
    both = rows.join(marks, F.col("doc_id") == F.col("_k")).groupBy("doc_id").agg(
        F.max("_y").alias("y"), F.max("x").alias("x"))
    data = both.toPandas().sort_values("doc_id")
    if not len(data):
        return grow(np.empty((0, len(NAMES))), np.empty(0))
    return grow(np.array(data["x"].tolist(), float), data["y"].to_numpy(float), **options)


def _score(batches, model):
    for b in batches:
        x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(float)
        s = model.scores(x)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(s, pa.float64()), pa.array((s >= 0.7).astype(np.int32), pa.int32())],
            ["doc_id", "score", "predicted"])


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text", **options) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Whole texts; an empty or null text has the statistics zero and a score like any
    other.  Rows are scored by themselves; a null id is not held out and not learned
    from.  Without usable labels every score is the share of good labels, or 0.5.
    """
    rows = stored(measured(docs, id_col, text_col), "quality-stats")
    model = fit(rows, labels, **options)
    found = rows.mapInArrow(lambda it: _score(it, model), "doc_id bigint, score double, predicted int")
    return found.select("doc_id", F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False))
                        .alias("held_out"), "score", "predicted")
