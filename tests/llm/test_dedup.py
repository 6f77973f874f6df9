import hashlib
import re

import pytest

from daywatch.llm import exact_dedup, neardup, substring
from tests.llm.frames import docs, near_rows, prose


def collect(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- exact ------------------------------------------------------------------

def exact_truth(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in rows]
    out, taken = [], set()
    for (i, t, *_), n in zip(rows, norm):
        same = [(-len(u or ""), j is None, j or 0, j) for (j, u, *_), m in zip(rows, norm) if m == n]
        best = min(same)
        kept = (best[0], best[3]) == (-len(t or ""), i) and (n,) not in taken
        if kept:
            taken.add((n,))
        out.append((i, best[3], len(same), kept, hashlib.sha256(n.encode()).hexdigest()))
    return out


EXACT = [(5, "a b"), (3, "ab"), (9, " a\tb "), (4, " a\tb "), (1, None), (2, ""), (7, " \n"),
         (8, "z" * 3000), (10, "z" * 2999 + "y"), (11, "z" * 3000), (12, "solo"),
         (13, "rep"), (13, "rep"), (None, "ab"), (None, "null id"), (20, "ünï"), (21, "ü nï")]


def test_exact_equals_brute_force(spark):
    found = exact_dedup.exact_duplicates(docs(spark, EXACT, clash=True), digest_all=True)
    assert collect(found) == sorted(exact_truth(EXACT), key=repr)


def test_exact_hashes_survivors_only(spark):
    found = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs(spark, EXACT)).collect()}
    assert found[12].text_sha256 is None and found[8].text_sha256 is not None


def test_exact_many_copies_and_empty(spark):
    rows = [(i, "same text " * 20) for i in range(400)] + [(1000 + i, f"own {i}") for i in range(50)]
    kept = exact_dedup.drop_copies(docs(spark, rows, clash=True))
    assert kept.count() == 51 and "kept" in kept.columns
    assert exact_dedup.exact_duplicates(docs(spark, [])).count() == 0


# ---- near -------------------------------------------------------------------

def near_truth(rows, words, percent=80):
    sets = []
    for i, t, *_ in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub(
            "[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        g = {tuple(w[k:k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else \
            ({tuple(w)} if w else set())
        sets.append(g)
    comp = {i: i for i, *_ in rows if i is not None}

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a, (i, *_x) in enumerate(rows):
        for b, (j, *_y) in enumerate(rows[:a]):
            if i is None or j is None or not sets[a] or not sets[b]:
                continue
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(i), find(j)))
                comp[y] = x
    return sorted(((i, len(g), None if i is None else find(i), i is None or find(i) == i)
                   for (i, *_), g in zip(rows, sets)), key=repr)


def test_near_equals_brute_force(spark):
    rows = near_rows()
    assert collect(neardup.near_duplicates(docs(spark, rows, clash=True), words=2)) == near_truth(rows, 2)


def test_near_large_group_emits_few_pairs(spark):
    """A group of near copies hangs together after the first comparisons."""
    base = prose(1, 80)
    rows = [(i, " ".join(base[:40] + [f"edit{i}"] + base[41:])) for i in range(300)]
    found = neardup.near_duplicates(docs(spark, rows), words=2).collect()
    assert {r.component_id for r in found} == {0} and sum(r.kept for r in found) == 1


def test_near_no_pairs_and_empty(spark):
    rows = [(1, "a b c"), (2, "d e f"), (3, None)]
    assert collect(neardup.near_duplicates(docs(spark, rows), words=5)) == near_truth(rows, 5)
    assert neardup.near_duplicates(docs(spark, [])).count() == 0


def test_pigeonhole_keys_meet():
    """Signatures that differ in 2 * chunks - 1 symbols share a key."""
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = rng.integers(0, 256, 80).astype(np.uint8)
        b = a.copy()
        b[rng.permutation(80)[:31]] ^= 1
        packed = np.stack([a, b]).view(np.int64)
        batch = pa.RecordBatch.from_arrays(
            [pa.array([1, 2]), *[pa.array(packed[:, i].copy()) for i in range(10)]],
            ["rep", *neardup._columns(80)])
        keys = {1: set(), 2: set()}
        for out in neardup._keys([batch], 16, 5):
            for k, i in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
                keys[i].add(k)
        assert keys[1] & keys[2]


def test_halved_symbols_never_exceed_the_distance():
    import numpy as np
    rng = np.random.default_rng(1)
    a = rng.integers(0, 256, (40, 80)).astype(np.uint8)
    b = a.copy()
    for i in range(40):
        b[i, rng.permutation(80)[:2 * i]] ^= np.uint8(rng.integers(1, 256))
    got = neardup._apart(neardup._nibbles(a), neardup._nibbles(b))
    assert got.tolist() == ((a & 15) != (b & 15)).sum(axis=1).tolist()
    assert (got <= (a != b).sum(axis=1)).all()


def family(n, words=100, own=16, seed=1, at=0):
    """n documents with a base in common and `own` words each of its own: about 0.72 alike."""
    base = prose(seed, words)
    rows = []
    for i in range(n):
        w = list(base)
        for k in range(own):
            w[k * words // own] = f"own{seed}x{i}x{k}"
        rows.append((at + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("room", [2_000_000, 3000])
def test_near_families_in_one_or_many_parts(spark, room):
    """Below-threshold families, near copies and strangers; parts change nothing."""
    base = prose(77, 90)
    rows = family(60) + near_rows(5)[:70] + [
        (5000 + i, " ".join(base[:40] + [f"edit{i}"] + base[41:])) for i in range(150)]
    rows = [(1000 + k if i is not None and i < 5000 else i, t) for k, (i, t, *_) in enumerate(rows)]
    found = neardup.near_duplicates(docs(spark, rows), words=2, room=room, hot=40)
    assert collect(found) == near_truth(rows, 2)


def test_near_rows_follow_a_familys_size(spark, monkeypatch):
    """Doubling a family that stays below the threshold doubles the rows between the stages."""
    seen = {}
    plain = neardup.stored

    def counted(df, name):
        kept = plain(df, name)
        seen[name] = seen.get(name, 0) + kept.count()
        return kept

    def counted_too(df, name, *rest):
        kept = counted(df, name)
        return kept, kept.count()

    monkeypatch.setattr(neardup, "stored", counted)
    monkeypatch.setattr(neardup, "stored_and_counted",
                        lambda df, name, which=None: counted_too(df, name) if which is None else
                        (lambda k: (k, k.filter(which).count()))(counted(df, name)))
    totals = []
    for n in (100, 200, 400):
        seen.clear()
        found = neardup.near_duplicates(docs(spark, family(n, 120, 8)), words=5)
        assert found.filter("kept").count() == n          # no link at all
        totals.append({k: v for k, v in seen.items() if k != "near-components"})
    for a, b in zip(totals, totals[1:]):
        assert all(b[k] <= 2.6 * a[k] + 5 for k in a), totals
    assert totals[-1]["near-links"] == 0 and totals[-1]["near-members"] > 300


def test_linked_equals_all_pairs():
    import numpy as np
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(80)]
    sets += [np.append(sets[3], 1000 + i) for i in range(20)]
    first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    grams = np.concatenate(sets).astype(np.uint64)
    found = neardup.linked(grams, first, 70, np.arange(100), np.ones(100, bool))
    comp = list(range(100))
    for a in range(100):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if len(sets[a]) and both * 100 >= 70 * (len(sets[a]) + len(sets[b]) - both):
                comp = [comp[b] if c == comp[a] else c for c in comp]
    mine = list(range(100))
    for a, b in found:
        assert mine[a] != mine[b]                          # every link joins something
        mine = [mine[b] if c == mine[a] else c for c in mine]
    assert {frozenset(i for i in range(100) if comp[i] == c) for c in comp} == \
        {frozenset(i for i in range(100) if mine[i] == c) for c in mine}


# ---- substring --------------------------------------------------------------

def substring_truth(rows, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t, *_ in rows]
    first = {}
    for (i, *_), w in zip(rows, split):
        if i is not None:
            for k in range(len(w) - window + 1):
                g = tuple(w[k:k + window])
                first[g] = min(first.get(g, i), i)
    out = []
    for (i, *_), w in zip(rows, split):
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def substring_rows():
    p, q = prose(1, 70), prose(2, 55)
    rows = [(4, " ".join(prose(3, 30) + p + prose(4, 20))), (2, " ".join(p)),
            (9, "\n".join(prose(5, 10) + p[5:60] + prose(6, 3) + q)), (7, " ".join(q + prose(8, 9))),
            (11, " ".join(p[:49])), (12, " ".join(p[:50])), (13, None), (14, ""), (15, " \t\n"),
            (16, " ".join(["same"] * 200)), (17, " ".join(["same"] * 120)),
            (18, "x" * 4000), (19, " ".join(p + p)), (12, " ".join(p[:50])), (None, " ".join(p))]
    return rows + [(100 + i, " ".join(p[i % 15:] + prose(50 + i, 12))) for i in range(40)]


def test_substring_equals_brute_force(spark):
    rows = substring_rows()
    found = substring.remove_repeats(docs(spark, rows, clash=True))
    assert collect(found) == substring_truth(rows, 50)


def test_substring_window_and_digest(spark):
    rows = substring_rows()
    found = substring.remove_repeats(docs(spark, rows), window=9, digest=True)
    want = [(i, n, k, hashlib.sha256(t.encode()).hexdigest()) for i, n, k, t in substring_truth(rows, 9)]
    assert collect(found) == sorted(want, key=repr)
    assert substring.remove_repeats(docs(spark, [])).count() == 0


def test_drop_copies_matches_by_text(spark):
    """A dropped copy goes even where another text of its id stays."""
    rows = [(0, "aa bb  cc"), (1, "aabbcc"), (1, "quite another text"), (2, "x"), (2, "x"), (3, "X"),
            (4, "x"), (None, "aabbcc"), (None, "nobody"), (None, "nobody"), (5, None), (6, "")]
    kept = exact_dedup.drop_copies(docs(spark, rows, clash=True)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=repr) == sorted(
        [(0, "aa bb  cc"), (1, "quite another text"), (2, "x"), (3, "X"), (None, "nobody"), (5, None)], key=repr)


def test_sieve_holds_all_keys_and_few_others(spark):
    from pyspark.sql import functions as F
    from daywatch.llm.common import Sieve
    sieve = Sieve(spark.range(0, 3000, 3).toDF("k"), F.xxhash64("k"), "sieve")
    rows = sieve.flagged(spark.range(30_000).toDF("k"), F.xxhash64("k")).filter("_maybe").collect()
    found = {r.k for r in rows}
    assert set(range(0, 3000, 3)) <= found and len(found) < 5000
    none = Sieve(spark.range(0).toDF("k"), F.xxhash64("k"), "sieve")
    assert none.flagged(spark.range(9).toDF("k"), F.xxhash64("k")).filter("_maybe").isEmpty()
    text = none.flagged(spark.range(9).toDF("k"), F.xxhash64("k"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in text.split("BroadcastExchange")[0]
