"""Ranked lexical search: the best documents of every item, by a dual-tree search.

A score is the inner product of an item's term weights and a document's term values, all
whole numbers.  Items form a binary tree, and so do the documents of each batch; a node
holds the largest coordinate of each term below it.  For a pair of nodes the product of
these maxima bounds every score below it, so the pair goes when the bound is under the
weakest kth score that an item of the node has so far.  Surviving leaf pairs are scored
exactly.  Bounds and scores are sums of whole numbers below 2**53 in doubles, or 64-bit
integers where an item is longer, so nothing is lost to rounding.

Spark deals the documents; the items are the query set and come in blocks of bounded size,
each against all documents.  Per block: one pass keeps the postings of the block's terms
and counts them, one pass over a hash sample of the postings gives every item a first kth
score (a true lower bound, since the sample's documents are all candidates), and one pass
searches them all.  A task keeps k rows an item and hands out those at or above the first
bound.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window as W, functions as F

from daywatch.llm.common import blocks_of, span_hashes, stored, text_bytes, text_of
from daywatch.llm.neardup import LOWER

IS_TERM = np.zeros(256, bool)
IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
EXACT = 1 << 53
ROUNDS = 3                # how often the halves of a node are dealt again by their sums
SAMPLE = 16               # one document in so many gives the first bounds
RESULT = "item_id bigint, rank int, doc_id bigint, score bigint"


# ---- terms --------------------------------------------------------------------

def terms_of(data: np.ndarray, offsets: np.ndarray):
    """64-bit hash and row of every term; a term never crosses rows."""
    if not len(data):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    inside = IS_TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    out = ~inside
    start = np.flatnonzero(inside & (np.concatenate(([True], out[:-1])) | edge[:-1]))
    end = np.flatnonzero(inside & (np.concatenate((out[1:], [True])) | edge[1:])) + 1
    return span_hashes(LOWER[data], start, end), np.searchsorted(offsets, start, "right") - 1


def _postings(batches, vocabulary):
    """Per document: its number of terms, and term numbers and counts within the vocabulary."""
    for b in batches:
        data, offsets = text_bytes(b.column(1))
        for lo, hi in blocks_of(offsets, 1 << 21):
            own = offsets[lo:hi + 1]
            h, row = terms_of(data[own[0]:own[-1]], own - own[0])
            size = np.bincount(row, minlength=hi - lo)
            at = np.searchsorted(vocabulary, h)
            known = at < len(vocabulary)
            known[known] = vocabulary[at[known]] == h[known]
            pair, tf = np.unique(row[known] * len(vocabulary) + at[known], return_counts=True)
            doc, term = np.divmod(pair, max(1, len(vocabulary)))
            cut = np.searchsorted(doc, np.arange(hi - lo + 1))
            term, tf = term.astype(np.uint32), tf.astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()),
                 _cells(term, cut), _cells(tf, cut)], ["id", "n", "terms", "tfs"])


def _cells(x: np.ndarray, cut: np.ndarray) -> pa.Array:
    """One binary cell per row."""
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1, [
        None, pa.py_buffer((cut * 4).astype(np.int32)), pa.py_buffer(x.tobytes())])


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of binary cells, and the first place of each row."""
    data, offsets = text_bytes(column.cast(pa.large_binary()).view(pa.large_string()))
    return np.frombuffer(data.tobytes(), np.uint32).astype(np.int64), offsets // 4


def _frequencies(batches, n_terms):
    total = np.zeros(n_terms, np.int64)
    for b in batches:
        total += np.bincount(_flat(b.column(0))[0], minlength=n_terms)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])


# ---- trees --------------------------------------------------------------------

class Sparse:
    """Rows of (term, value): flat arrays and the first place of each row."""

    def __init__(self, term: np.ndarray, value: np.ndarray, first: np.ndarray):
        self.term, self.value, self.first = term, value, first
        self.n = len(first) - 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.first))

    def take(self, order: np.ndarray) -> "Sparse":
        size = np.diff(self.first)[order]
        first = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(self.first[order] - first[:-1], size) + np.arange(first[-1])
        return Sparse(self.term[at], self.value[at], first)


def tree(rows: Sparse, n_terms: int, leaf: int) -> tuple[np.ndarray, int]:
    """An order of the rows and the tree's depth: node j of level l holds the rows
    [n * j >> l, n * (j + 1) >> l) of the order.

    A node is halved by the rows' likeness to two of its rows that are unlike, then to the
    sums of the halves: similar rows end in the same leaf, which keeps the maxima of a node
    close to its rows.
    """
    depth = max(0, int(np.ceil(np.log2(max(1, rows.n) / leaf))))
    order = np.arange(rows.n)
    for level in range(depth):
        edge = rows.n * np.arange((1 << level) + 1) >> level
        new = []
        for lo, hi in zip(edge[:-1], edge[1:]):
            part = rows.take(order[lo:hi])
            own = part.rows()
            norm = np.sqrt(np.bincount(own, part.value.astype(float) ** 2, minlength=part.n))
            mine = part.value / (1 + norm)[own]

            def likeness(chosen):
                wide = np.bincount(part.term[chosen], mine[chosen], minlength=n_terms)
                return np.bincount(own, mine * wide[part.term], minlength=part.n)

            one = int(np.argmin(likeness(own == 0)))
            first = likeness(own == one)
            lean = np.argsort(likeness(own == int(np.argmin(first))) - first, kind="stable")
            for _ in range(ROUNDS):
                left = np.zeros(part.n, bool)
                left[lean[:(rows.n * (2 * len(new) + 1) >> (level + 1)) - lo]] = True
                lean = np.argsort(likeness(~left[own]) - likeness(left[own]), kind="stable")
            new.append(order[lo:hi][lean])
        order = np.concatenate(new)
    return order, depth


def maxima(rows: Sparse, n_terms: int, depth: int) -> list[np.ndarray]:
    """Per level, from the root: [nodes, terms] largest value of each term."""
    edge = rows.n * np.arange((1 << depth) + 1) >> depth
    node = np.repeat(np.searchsorted(edge, np.arange(rows.n), "right") - 1, np.diff(rows.first))
    out = np.zeros((1 << depth) * n_terms)
    np.maximum.at(out, node * n_terms + rows.term, rows.value)
    levels = [out.reshape(1 << depth, n_terms)]
    for _ in range(depth):
        levels.append(np.maximum(levels[-1][::2], levels[-1][1::2]))
    return levels[::-1]


class Items:
    """The items of a block as a tree: rows in tree order, and per node its terms and maxima."""

    def __init__(self, ids: list, rows: Sparse, n_terms: int, leaf: int = 8):
        order, self.depth = tree(rows, n_terms, leaf)
        self.rows, self.ids, self.n_terms = rows.take(order), [ids[i] for i in order], n_terms
        self.nodes = []
        for level in range(self.depth + 1):
            edge = self.rows.n * np.arange((1 << level) + 1) >> level
            self.nodes.append([self._node(lo, hi) for lo, hi in zip(edge[:-1], edge[1:])])

    def _node(self, lo, hi):
        a, b = self.rows.first[lo], self.rows.first[hi]
        term, back = np.unique(self.rows.term[a:b], return_inverse=True)
        top = np.zeros(len(term))
        np.maximum.at(top, back, self.rows.value[a:b])
        return lo, hi, term, top


class Best:
    """The k best documents of every item so far, best first; scores from `floor` on count."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.score, self.doc = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)
        self.floor = np.maximum(floor, 1)

    def weakest(self, lo: int, hi: int) -> int:
        return int(np.maximum(self.score[lo:hi, -1], self.floor[lo:hi]).min())

    def add(self, item: int, score: np.ndarray, doc: np.ndarray) -> None:
        least = max(self.score[item, -1], self.floor[item])
        at = np.flatnonzero(score >= least)
        if len(at):
            score = np.concatenate((self.score[item], score[at]))
            doc = np.concatenate((self.doc[item], doc[at]))
            top = np.lexsort((doc, -score))[:self.score.shape[1]]
            self.score[item], self.doc[item] = score[top], doc[top]


def search_batch(items: Items, docs: Sparse, ids: np.ndarray, best: Best, leaf: int = 32) -> int:
    """Walk the items' tree and the tree of a batch of documents together; returns the
    number of exact scores."""
    order, depth = tree(docs, items.n_terms, leaf)
    docs, ids = docs.take(order), ids[order]
    tops = maxima(docs, items.n_terms, depth)
    edge = docs.n * np.arange((1 << depth) + 1) >> depth
    # postings by term, for the exact scores
    by_term = np.argsort(docs.term, kind="stable")
    row, value = docs.rows()[by_term], docs.value[by_term]
    lead = np.searchsorted(docs.term[by_term], np.arange(items.n_terms + 1))
    scored, rows = 0, items.rows
    stack = [(0, 0, 0, np.zeros(1, np.int64))]
    while stack:
        level, at, down, nodes = stack.pop()
        lo, hi, term, top = items.nodes[level][at]
        if hi == lo:
            continue
        nodes = nodes[tops[down][nodes][:, term] @ top >= best.weakest(lo, hi)]
        if not len(nodes):
            continue
        if down < depth:
            nodes = np.sort(np.concatenate((2 * nodes, 2 * nodes + 1)))
        if level < items.depth:
            stack += [(level + 1, 2 * at + i, min(down + 1, depth), nodes) for i in (1, 0)]
        elif down < depth:
            stack.append((level, at, down + 1, nodes))
        else:
            left = np.zeros(docs.n, bool)
            for a, b in zip(edge[nodes], edge[nodes + 1]):
                left[a:b] = True
            where = np.flatnonzero(left)
            for i in range(lo, hi):
                a, b = rows.first[i], rows.first[i + 1]
                size = lead[rows.term[a:b] + 1] - lead[rows.term[a:b]]
                pos = np.repeat(lead[rows.term[a:b]] - np.cumsum(size) + size, size) \
                    + np.arange(size.sum())
                product = np.repeat(rows.value[a:b], size) * value[pos]
                if product.sum(dtype=float) < EXACT:
                    score = np.bincount(row[pos], product, minlength=docs.n).astype(np.int64)
                else:
                    score = np.zeros(docs.n, np.int64)
                    np.add.at(score, row[pos], product)
                scored += len(where)
                best.add(i, score[where], ids[where])
    return scored


# ---- Spark --------------------------------------------------------------------

def values(tf: np.ndarray, n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """The value of a term with `tf` occurrences in a document of `n` terms."""
    m = 100 - 50 + (50 * n * docs) // total
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def _searched(batches, items, docs, total, k, floor, per_batch, per_terms):
    """Rows (item number, doc_id, score): the task's best documents of each item."""
    best = Best(items.rows.n, k, floor)
    for b in batches:
        ids, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        term, first = _flat(b.column(2))
        tf, _ = _flat(b.column(3))
        value = values(tf, np.repeat(n, np.diff(first)), docs, total)
        at = 0
        while at < len(ids):
            last = int(np.searchsorted(first, first[at] + per_terms, "right")) - 1
            last = min(max(last, at + 1), at + per_batch, len(ids))
            a, z = first[at], first[last]
            part = Sparse(term[a:z], value[a:z], first[at:last + 1] - a)
            search_batch(items, part, ids[at:last], best)
            at = last
    item, place = np.nonzero(best.score > 0)
    yield pa.RecordBatch.from_arrays(
        [pa.array(item), pa.array(best.doc[item, place]), pa.array(best.score[item, place])],
        ["item", "doc_id", "score"])


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _block(texts: DataFrame, items: list, k: int, per_batch: int, per_terms: int) -> DataFrame | None:
    """(item_id, rank, doc_id, score) of the items [(id, text)] against all texts."""
    spark = texts.sparkSession
    ids = sorted({i for i, _ in items}, key=lambda i: (i is None, i or 0))
    number = {i: at for at, i in enumerate(ids)}
    data, offsets = text_bytes(pa.array([t for _, t in items], pa.large_string()))
    h, row = terms_of(data, offsets)
    of = np.array([number[i] for i, _ in items], np.int64)[row]
    vocabulary, term = np.unique(h, return_inverse=True)
    if not len(vocabulary):
        return None
    pair = np.unique(of * len(vocabulary) + term)
    of, term = np.divmod(pair, len(vocabulary))

    seen = Observation()
    rows = texts.mapInArrow(lambda it: _postings(it, vocabulary),
                            "id bigint, n bigint, terms binary, tfs binary")
    rows = rows.observe(seen, F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("total"))
    rows = stored(rows.filter(F.length("terms") > 0), "lexical-postings")
    docs, total = seen.get["docs"], seen.get["total"] or 0
    if not total:
        return None
    width = len(vocabulary)
    df = np.zeros(width, np.int64)
    counts = rows.select("terms").mapInArrow(lambda it: _frequencies(it, width), "term bigint, df bigint")
    for r in counts.groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        df[r["term"]] = r["df"]            # at most the block's terms
    weight = np.floor(1000 * np.log((2 * docs + 2) / (2 * df + 1))).astype(np.int64)
    first = np.searchsorted(of, np.arange(len(ids) + 1))
    block = Items(ids, Sparse(term, weight[term], first), width)

    rows = rows.filter("id is not null")

    def search(part, floor):
        found = part.mapInArrow(
            lambda it: _searched(it, block, docs, total, k, floor, per_batch, per_terms),
            "item bigint, doc_id bigint, score bigint")
        return _top(found, k)

    none = np.zeros(len(ids), np.int64)
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(SAMPLE)) == 0)
    floor = none.copy()
    for r in search(sample, none).filter(F.col("rank") == k).toLocalIterator():
        floor[r["item"]] = r["score"]      # one row an item
    names = spark.createDataFrame([(at, i) for at, i in enumerate(block.ids)], "item bigint, item_id bigint")
    return search(rows, floor).join(F.broadcast(names), "item").select(
        "item_id", "rank", "doc_id", "score")


def best_documents(items: DataFrame, docs: DataFrame, item_col: str = "item_id",
                   id_col: str = "doc_id", text_col: str = "text", k: int = 50,
                   block_chars: int = 512_000, per_batch: int = 4096,
                   per_terms: int = 2_000_000) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's `k` best documents with a score above 0.

    Equal scores rank by ascending doc_id.  Terms are runs of digits, letters A-Z (lowered)
    and a-z and characters from U+0080 on; they are compared by 64-bit hashes.  Items come
    in blocks of about `block_chars` characters (a longer item makes its block longer), each
    searched in all documents.  A null or empty text has no terms: as a document it is
    never found, as an item it finds nothing.  Texts are read whole.  Rows repeating an
    item's id are one item with the terms of all of them, a null item id included.
    Repeated documents are ranked each; a document with a null id counts in all statistics
    but is not ranked.  Other columns are ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    size = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    blocks = -(-size // block_chars)
    found = []
    for at in range(blocks):
        mine = asked.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(blocks)) == at)
        own = [(r["id"], r["text"]) for r in mine.toLocalIterator()]
        one = _block(texts, own, k, per_batch, per_terms)
        if one is not None:
            found.append(one)
    if not found:
        return spark.createDataFrame([], RESULT)
    return reduce(DataFrame.union, found)
