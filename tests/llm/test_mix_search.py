from collections import Counter

import numpy as np
import pytest

from daywatch.llm import ann, mixing
from tests.llm.frames import docs, prose


# ---- mixing -----------------------------------------------------------------

def water_fill(sizes, weights=(5.0, 2.0, 1.0), cap=3.0):
    """Targets by sharing again and again what capped sources leave."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, done = float(sum(sizes.values())), {}
    while True:
        left = total - sum(done.values())
        open_ = [s for s in names if s not in done]
        over = [s for s in open_ if left * w[s] / sum(w[x] for x in open_) > cap * sizes[s]]
        if not over:
            return done | {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        done |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 1000, "b": 5000, "c": 300}, {"a": 10, "b": 20, "c": 90000, None: 7, "é": 4000},
    {"a": 100}, {"a": 0, "b": 50}, {"b": 1, "B": 1, "ä": 1, "z": 1}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
    found = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert found == pytest.approx(water_fill(sizes))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 16, 17, 100, 1000, 4099])
def test_permutation_is_one(spark, n):
    from pyspark.sql import functions as F
    df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit(5)).alias("p"))
    assert sorted(r.p for r in df.collect()) == list(range(n))


def mix_rows():
    rows = [(i, " ".join(prose(i, 20 + i % 90)), "en", f"s{i % 4 if i % 3 else 0}") for i in range(300)]
    return rows + [(900, None, "en", "s0"), (901, "", "en", None), (902, "only one", "en", None),
                   (903, " ".join(prose(9, 9000)), "en", "s1"), (5, rows[5][1], "en", rows[5][3]),
                   (None, " ".join(prose(8, 70)), None, None)]


def test_mix_counts(spark):
    rows = mix_rows()
    df = docs(spark, rows, clash=True)
    found = mixing.taken_words(df, block=8).collect()
    assert len(found) == len(rows)
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len((t or "").split())
    target = water_fill(dict(size))
    taken = Counter()
    for r in found:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == size[r.source]
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= 16 + 0.01 * target[s], s
    again = mixing.taken_words(df.repartition(13), block=8).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))


def test_slots_and_uses_agree(spark):
    placed, uses, slots = mixing.mix_sources(docs(spark, mix_rows()), block=8, shard_slots=100)
    s = slots.collect()
    assert len({r.slot for r in s}) == len(s) and max(Counter(r.shard for r in s).values()) <= 100
    count = Counter((r.source, r.block) for r in s)
    assert count == {(r.source, r.block): r.uses for r in uses.collect()} and max(count.values()) <= 3
    spans = sorted((r.source or "~", r.start, r.size) for r in placed.collect() if r.size)
    at = {}
    for src, start, n in spans:              # documents tile their source's stream
        assert start == at.get(src, 0)
        at[src] = start + n


def test_mixed_documents_hold_the_words_taken(spark):
    rows = mix_rows()
    df = docs(spark, rows, clash=True)
    out = mixing.mixed_documents(df, block=8)
    assert out.columns == df.columns
    got = Counter()
    for r in out.collect():
        assert r.text and (r.n_chars == len(r.text))
        got[r.doc_id] += len(r.text.split())
    want = Counter()
    for r in mixing.taken_words(df, block=8).collect():
        want[r.doc_id] += r.taken
    assert {k: v for k, v in want.items() if v} == dict(got)


@pytest.mark.parametrize("n", [1, 2, 7, 100, 4099])
def test_permutation_and_back(spark, n):
    from pyspark.sql import functions as F
    size = F.lit(n).cast("bigint")
    there = mixing.permuted(F.col("id"), size, F.lit(5))
    df = spark.range(n).withColumn("p", there)
    assert df.filter(mixing.permuted(F.col("p"), size, F.lit(5), back=True) != F.col("id")).isEmpty()


def test_small_sources_meet_their_targets(spark):
    # beside a hot source: capped ones, and (by weight) some that get a few words only
    sizes = {"a": 5, "b": 10, "c": 33, "d": 321, "e": 90000, "f": 1, "g": 64, "h": 700}
    few = {f"s{i:03}": 20 for i in range(60)}
    for size in (sizes, {**few, "t": 900}):
        df = docs(spark, [(i, " ".join(prose(i, n)), "en", s) for i, (s, n) in enumerate(size.items())])
        target, taken = water_fill(size), {r.source: r.taken for r in mixing.taken_words(df).collect()}
        for s, n in size.items():
            if target[s] == 3 * n:
                assert taken[s] == 3 * n, s
            assert abs(taken[s] - target[s]) <= min(16, max(0.5, target[s] / 32)), s
        assert {s for s in size if target[s] == 3 * size[s]} or "t" in size
        got = Counter()
        for r in mixing.mixed_documents(df).collect():
            got[r.source] += len(r.text.split())
        assert got == {s: t for s, t in taken.items() if t}


def test_mix_of_nothing(spark):
    assert mixing.taken_words(docs(spark, [])).count() == 0
    empty = [(1, None, "en", "a"), (2, "", "en", "b")]
    assert [r.taken for r in mixing.taken_words(docs(spark, empty)).collect()] == [0, 0]
    assert mixing.mixed_documents(docs(spark, empty)).count() == 0


# ---- neighbours -------------------------------------------------------------

def brute(vectors, k=10, every=100):
    out = {}
    for i, v in vectors.items():
        if i % every == 0:
            d = sorted((float(np.sqrt(((np.array(v) - np.array(u)) ** 2).sum())), j)
                       for j, u in vectors.items() if j != i)[:k]
            out[i] = d
    return out


def test_search_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32).astype(float)
    x[700:1200] = x[700]                         # a third of all are one vector
    own = {i: x[i].tolist() for i in range(len(x))}
    rows = [(i, v, 0) for i, v in own.items()]
    rows += [(9000, None, 1), (9100, [0.0] * 16, 1), (9200, [float("nan")] + [1.0] * 15, 1),
             (9300, [None] + [1.0] * 15, 1), (9400, [1.0, 2.0], 1), (None, [1.0] * 16, 1),
             (800, own[800], 3), (9500, [float("inf")] + [1.0] * 15, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    found = ann.search(df.selectExpr("*", "1 AS part", "2 AS v", "3 AS i"), cells=16).collect()
    truth = brute(own)
    by = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert set(by) == set(truth)
    hits = sum(len({j for _, j in by[q]} & {j for _, j in truth[q]}) for q in truth)
    assert hits / sum(map(len, truth.values())) >= 0.9
    for q, rows_ in by.items():
        assert rows_ == sorted(rows_) and len(rows_) == 10
        for s, j in rows_:
            assert s == pytest.approx(float(np.sqrt(((x[q] - x[j]) ** 2).sum())), abs=1e-12)
    # ties of equal vectors go to the smaller ids
    assert [j for _, j in by[800]] == list(range(700, 710))


def test_search_few_and_none(spark):
    schema = "vec_id bigint, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 1.0])], schema)
    found = sorted((r.query_id, r.rank, r.vec_id) for r in ann.search(few).collect())
    assert found == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    assert ann.search(few.limit(0)).count() == 0


def test_search_far_from_the_origin_and_every_length(spark):
    rng = np.random.default_rng(2)
    far = 1000 + 1e-5 * rng.normal(size=(600, 16))
    own = {i: far[i].tolist() for i in range(600)}
    one = {1000 + i: [float(x)] for i, x in enumerate(rng.normal(size=150))}
    three = {2000 + i: x.tolist() for i, x in enumerate(rng.normal(size=(120, 3)))}
    df = spark.createDataFrame(list({**own, **one, **three}.items()), "vec_id bigint, embedding array<double>")
    found = ann.search(df, cells=4, recall=1.0).collect()
    truth = brute(own) | brute(one) | brute(three)
    by = {}
    for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append(r.vec_id)
    assert set(by) == set(truth)
    for part in (own, one, three):
        mine = [q for q in truth if q in part]
        assert sum(len(set(by[q]) & {j for _, j in truth[q]}) for q in mine) >= 9 * len(mine)


def test_candidates_survive_rounding():
    import pyarrow as pa
    rng = np.random.default_rng(4)
    x = 1000 + 1e-5 * rng.normal(size=(500, 32))
    entries = pa.table({"vec_id": range(500), "v": x.tolist(), "j": pa.array([0] * 500, pa.int32())})
    queries = pa.table({"query_id": range(0, 500, 10), "q": x[::10].tolist(), "js": [[0]] * 50})
    out = ann.rerank(entries, queries, 10, 1).to_pylist()
    for i in range(0, 500, 10):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        assert [r["vec_id"] for r in out if r["query_id"] == i] == np.argsort(d, kind="stable")[:10].tolist()


def test_cells_are_visited_by_summed_distance():
    rng = np.random.default_rng(3)
    d1, d2 = rng.random(9), rng.random(7)
    count = rng.integers(0, 3, (9, 7))
    out = ann.visited(d1, d2, count, 10 ** 9)
    total = [d1[a] + d2[b] for a, b in out]
    assert total == sorted(total) and len(out) == (count > 0).sum()


def test_recall_on_many_queries(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(0, 40, 6000)] + 0.4 * rng.normal(size=(6000, 24))
    own = {i: x[i].tolist() for i in range(len(x))}
    df = spark.createDataFrame(list(own.items()), "vec_id bigint, embedding array<double>")
    by = {}
    for r in ann.search(df, part_rows=300).collect():
        by.setdefault(r.query_id, set()).add(r.vec_id)
    truth = brute(own)
    assert len(by) == len(truth) == 60
    hits = sum(len(by[q] & {j for _, j in truth[q]}) for q in truth)
    assert hits >= 0.9 * sum(map(len, truth.values()))


def test_entries_are_sent_once_and_parts_are_bounded():
    import pyarrow as pa
    rng = np.random.default_rng(6)
    x, ids = rng.normal(size=(5000, 8)), np.arange(5000)
    x[:2000] += 40                               # one large cell
    index = ann.Index(ids, x, 6, 1, 20)
    cell = index.cell(x - index.mean)
    index.calibrate(np.bincount(cell, minlength=36), [], 0.95, 10)
    assert index.want == 11
    free = index.lay_out(7, 300)
    batch = pa.RecordBatch.from_pydict({"vec_id": ids, "v": x.tolist()})
    entries = pa.Table.from_batches(ann._place([batch], {8: index}))
    assert sorted(entries["id"].to_pylist()) == ids.tolist()
    part = np.bincount(entries["part"].to_numpy(), minlength=free)
    assert part[:7].sum() == 0 and len(part) == free and part.max() < 600
    # a query reaches every part that may hold one of its cells, each once
    index.want = 900
    routed = pa.Table.from_batches(ann._route([batch.slice(0, 70)], {8: index})).to_pylist()
    homes = {c: set(entries["part"].to_numpy()[cell == c].tolist()) for c in set(cell.tolist())}
    for q in range(70):
        own = [r for r in routed if r["id"] == q]
        assert len({r["part"] for r in own}) == len(own)
        for c in {c for r in own for c in r["cells"]}:
            assert homes[c] <= {r["part"] for r in own if c in r["cells"]}


def test_search_of_lengths_in_several_runs(spark):
    rng = np.random.default_rng(7)
    own = {d: {1000 * d + i: rng.normal(size=d).tolist() for i in range(120)} for d in (2, 3, 5)}
    df = spark.createDataFrame([r for v in own.values() for r in v.items()],
                               "vec_id bigint, embedding array<double>")
    found = sorted(tuple(r) for r in ann.search(df, recall=1.0, model_bytes=1).collect())
    assert found == sorted(tuple(r) for r in ann.search(df, recall=1.0).collect())
    truth = {}
    for v in own.values():
        truth |= brute(v)
    hits = sum(j == truth[q][rank - 1][1] for q, rank, j, _ in found)
    assert len(found) == sum(map(len, truth.values())) and hits >= 0.9 * len(found)
