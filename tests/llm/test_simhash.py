"""Fingerprints and the trie join against plain versions."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from daywatch.llm import simhash
from daywatch.llm.common import Forest
from tests.llm.frames import docs, near_rows, prose


def print_of(text, words=4):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub(
        "[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    grams = [" ".join(w[k:k + words]) for k in range(len(w) - words + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def truth(rows, errors=4):
    fps = [(i, print_of(t)) for i, t, *_ in rows]
    known = sorted({f for i, f in fps if i is not None})
    comp = {f: f for f in known}

    def root(f):
        while comp[f] != f:
            f = comp[f]
        return f

    for at, a in enumerate(known):
        for b in known[:at]:
            if (a ^ b).bit_count() <= errors:
                comp[root(a)] = root(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    return sorted(((i, f"{f:016x}", None if i is None else least[root(f)]) for i, f in fps), key=repr)


ROWS = near_rows(3) + [(500 + i, "same words here again and again") for i in range(50)] + [
    (600, "long " * 40000), (601, " ".join(prose(9, 30000))), (602, "ÄÖ ü ñ É"), (603, "äö ü ñ é")]


def test_components_equal_brute_force(spark):
    found = simhash.near_copies(docs(spark, ROWS, clash=True))
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, found.collect()), key=repr) == truth(ROWS)


def test_split_subtrees_change_nothing(spark):
    found = simhash.near_copies(docs(spark, ROWS), errors=8, hot=3, per_bucket=20)
    assert sorted(map(tuple, found.collect()), key=repr) == truth(ROWS, 8)


def test_empty_table(spark):
    assert simhash.near_copies(docs(spark, [])).count() == 0
    found = simhash.near_copies(docs(spark, [(None, "a b c d e"), (None, None)])).collect()
    assert sorted(r.fingerprint for r in found) == sorted([f"{print_of('a b c d e'):016x}", "0" * 16])
    assert all(r.component_id is None for r in found)


def test_hash_is_spark_xxhash64(spark):
    """The same hash as Spark's own function with its seed of 42."""
    grams = ["a b c d", "é ü ñ ö", "x" * 100]
    df = spark.createDataFrame([(g,) for g in grams], "g string").select(F.xxhash64("g").alias("h"))
    assert [r.h % (1 << 64) for r in df.collect()] == [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]


def family(seed, n, flips):
    r = random.Random(seed)
    base = r.getrandbits(64)
    out = {base}
    while len(out) < n:
        out.add(base ^ sum(1 << b for b in r.sample(range(64), r.randrange(1, flips + 1))))
    return out


@pytest.mark.parametrize("errors", [1, 2, 4, 7])
def test_tries_find_every_link(errors):
    """All blocks' tries together give the components of all pairs within the distance."""
    r = random.Random(errors)
    fp = np.array(sorted({r.getrandbits(64) for _ in range(1500)} | family(1, 300, 5) | family(2, 300, 12)
                         | {r.getrandbits(12) for _ in range(200)}), np.uint64)
    forest = Forest(len(fp))
    for a in range(len(fp)):
        near = np.flatnonzero(np.bitwise_count(fp ^ fp[a]) <= errors)
        forest.join(np.full(len(near), a), near)
    mine, edges = Forest(len(fp)), simhash.cuts(errors)
    for b in range(errors + 1):
        x = simhash.turned(fp, np.full(len(fp), edges[b]))
        key = (x >> np.uint64(64 - (edges[b + 1] - edges[b]))).astype(np.int64)
        order = np.argsort(x)
        label, _, _ = simhash.joined(key[order], x[order], None, b, errors, chunk=500, small=4)
        mine.join(order, order[label])
    assert np.array_equal(mine.label, forest.label)


def test_dense_family_costs_about_its_size():
    """Entries that hang together are not compared pair by pair."""
    cost = []
    for n in (4000, 16000):
        fp = np.array(sorted(family(5, n, 6)), np.uint64)
        fp = fp[(fp >> np.uint64(51)) == np.bincount((fp >> np.uint64(51)).astype(int)).argmax()]
        label, nodes, pairs = simhash.joined(np.zeros(len(fp), np.int64), fp, None, 0, 4)
        cost.append((len(fp), pairs, nodes))
        assert pairs + nodes < len(fp) ** 2 / 4
    assert (label == 0).sum() > 1


def test_most_pairs_of_strangers_are_pruned():
    r = np.random.default_rng(1)
    fp = np.sort(r.integers(0, 1 << 51, 20000, dtype=np.uint64))      # one subtree of 20,000 strangers
    _, nodes, pairs = simhash.joined(np.zeros(len(fp), np.int64), fp, None, 0, 4)
    assert pairs < len(fp) ** 2 / 50 and nodes < len(fp) * 60
