"""Ranked search against a plain ranking, and the bounds of the trees."""

import math
import re
from collections import Counter

import numpy as np

from daywatch.llm import lexical
from tests.llm.frames import docs, prose

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def truth(items, rows, k=50):
    bags = [(i, terms(t)) for i, t, *_ in rows]
    n_docs = sum(1 for _, b in bags if b)
    total = sum(len(b) for _, b in bags)
    df = Counter(x for _, b in bags for x in set(b))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        found = []
        for i, bag in bags:
            tf = Counter(bag)
            m = 100 - 50 + (50 * len(bag) * n_docs) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                        * ((1000000000 * tf[x]) // (1000 * tf[x] + 20 * m)) for x in own if tf[x])
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def found(spark, items, rows, **options):
    asked = spark.createDataFrame(items, "item_id bigint, text string").selectExpr(
        "*", "'x' AS id", "1 AS rank")
    df = lexical.best_documents(asked, docs(spark, rows, clash=True), **options)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, df.collect()), key=repr)


ROWS = ([(i, " ".join(prose(i, 5 + i % 60))) for i in range(300)]
        + [(1000 + i, "Same TEXT, alpha1 beta2; alpha1") for i in range(70)]       # ties
        + [(2000, None), (2001, ""), (2002, " .,;"), (2003, "Ünï ñandú ÉTÉ x_y 漢字"),
           (2004, "alpha1 " * 30000), (None, "alpha1 beta2"), (5, "alpha1"), (5, "alpha1")])
ITEMS = [(i, " ".join(prose(5000 + i, 3 + i % 30))) for i in range(40)] + [
    (100, "same text"), (101, None), (102, "..."), (103, "ñandú, ünï"), (104, "x_y"), (105, "ALPHA1"),
    (106, "missing"), (3, "one more line of item three alpha7"), (None, "beta2 text"),
    (107, "gamma3 " * 4000)]


def test_ranking_equals_brute_force(spark):
    assert found(spark, ITEMS, ROWS) == truth(ITEMS, ROWS)


def test_small_blocks_and_batches_change_nothing(spark):
    small = found(spark, ITEMS, ROWS, k=5, block_chars=2000, per_batch=40, per_terms=300)
    assert small == truth(ITEMS, ROWS, 5)


def test_empty_tables(spark):
    assert found(spark, [], ROWS) == [] and found(spark, ITEMS, []) == []
    assert found(spark, [(1, "...")], ROWS) == [] and found(spark, ITEMS, [(1, ""), (2, None)]) == []


def sparse(seed, rows, n_terms, most):
    r = np.random.default_rng(seed)
    size = r.integers(1, most, rows)
    term = np.concatenate([np.sort(r.choice(n_terms, s, replace=False)) for s in size])
    return lexical.Sparse(term, r.integers(1, 1000, size.sum()), np.concatenate(([0], np.cumsum(size))))


def test_trees_hold_every_row_and_bound_it():
    rows = sparse(1, 500, 80, 20)
    order, depth = lexical.tree(rows, 80, 8)
    assert sorted(order.tolist()) == list(range(500)) and depth == 6
    tops = lexical.maxima(rows.take(order), 80, depth)
    own = rows.take(order)
    for level, top in enumerate(tops):
        edge = 500 * np.arange((1 << level) + 1) >> level
        for j in range(1 << level):
            a, b = own.first[edge[j]], own.first[edge[j + 1]]
            assert (top[j][own.term[a:b]] >= own.value[a:b]).all()


def test_whole_batches_are_pruned():
    """Two vocabularies: an item's search leaves the other half of the documents out."""
    a, b = sparse(1, 400, 50, 12), sparse(2, 400, 50, 12)
    rows = lexical.Sparse(np.concatenate((a.term, b.term + 50)), np.concatenate((a.value, b.value)),
                          np.concatenate((a.first, b.first[1:] + a.first[-1])))
    asked = a.take(np.arange(20))
    items = lexical.Items(list(range(20)), asked, 100)
    best = lexical.Best(20, 10, np.zeros(20, np.int64))
    scored = lexical.search_batch(items, rows, np.arange(800), best)
    assert scored <= 20 * 420
    wide = np.zeros((800, 100), np.int64)
    wide[rows.rows(), rows.term] = rows.value
    for at, own in enumerate(items.ids):
        want = np.zeros(100, np.int64)
        want[asked.term[asked.first[own]:asked.first[own + 1]]] = \
            asked.value[asked.first[own]:asked.first[own + 1]]
        plain = wide @ want
        top = np.lexsort((np.arange(800), -plain))[:10]
        top = top[plain[top] > 0]
        assert best.doc[at][:len(top)].tolist() == top.tolist()


def test_sums_beyond_doubles_are_exact():
    item = lexical.Sparse(np.arange(3), np.full(3, 1 << 40), np.array([0, 3]))
    rows = lexical.Sparse(np.tile(np.arange(3), 2), np.array([1 << 20, 1, 1, 1 << 20, 1, 2]), np.array([0, 3, 6]))
    best = lexical.Best(1, 2, np.zeros(1, np.int64))
    lexical.search_batch(lexical.Items([0], item, 3), rows, np.array([7, 8]), best)
    assert best.score.tolist() == [[(1 << 40) * ((1 << 20) + 3), (1 << 40) * ((1 << 20) + 2)]]
    assert best.doc.tolist() == [[8, 7]]
