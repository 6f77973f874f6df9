"""Streams with state: late rows, keyed sessions, gap sessions, restarts."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from daywatch.operators.clean import clean_logon
from daywatch.operators.sessions import daily_sessions
from daywatch.params import Params
from daywatch.streaming import daily as S
from daywatch.streaming import sessions as SS
from daywatch.streaming.rollup import DailyRollup

START = dt.date(2024, 3, 1)
EVENT = "id long, user string, day date, value double"


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


# ---- rollup that accounts for every row ------------------------------------------

def feed(seed, batches, per_batch, spread=4):
    """Batches of (id, user, day, value): the day wanders ahead, some events lag behind."""
    r, i, out = random.Random(seed), 0, []
    for b in range(batches):
        rows = []
        for _ in range(per_batch):
            day = START + dt.timedelta(days=b // 3 - (r.randrange(spread) if r.random() < 0.4 else 0))
            rows.append((i, f"u{r.randrange(4)}", day, float(r.randrange(100))))
            i += 1
        out.append(rows)
    return out


def account(batches, lateness=1):
    """(late ids, {(user, day): [events, total, most]}, closed until) by a plain loop."""
    newest = until = None
    late, days = [], {}
    for rows in batches:
        for i, user, day, value in rows:
            if until is not None and day <= until:
                late.append(i)
            else:
                cell = days.setdefault((user, day), [0, 0.0, 0.0])
                cell[:] = cell[0] + 1, cell[1] + value, max(cell[2], value)
        newest = max([r[2] for r in rows] + ([newest] if newest else []))
        until = newest - dt.timedelta(days=1 + lateness)
    return sorted(late), days, until


def rollup_of(tmp_path):
    return DailyRollup(str(tmp_path / "out"), {"total": (F.sum("value"), "sum"),
                                              "most": (F.max("value"), "max")})


def cells(df):
    return {(r.user, r.day): [r["_events"], r.total, r.most] for r in df.collect()}


def check(spark, rollup, batches):
    late, days, until = account(batches)
    assert sorted(r.id for r in rollup.late(spark, EVENT).collect()) == late
    assert cells(rollup.closed(spark)) == {k: v for k, v in days.items() if k[1] <= until}
    assert cells(rollup.open(spark)) == {k: v for k, v in days.items() if k[1] > until}
    done = rollup.progress(spark)
    assert (done.rows, done.late) == (sum(map(len, batches)), len(late)) and done.late > 0
    assert done.closed_until == until.isoformat()


def test_rollup_accounts_for_every_row_across_restarts(spark, tmp_path):
    batches, rollup = feed(1, 12, 30), rollup_of(tmp_path)
    path, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    stream = None
    for part in (batches[:5], batches[5:6], batches[6:]):       # two restarts
        for rows in part:
            put(spark, rows, EVENT, path)
        stream = S.stream_events(spark, path, spark.read.parquet(path).schema, 1)
        rollup.start(stream, mark).awaitTermination()
    check(spark, rollup, batches)


def test_a_batch_run_again_changes_nothing(spark, tmp_path):
    """What a crash before the checkpoint's commit leads to: the last batch once more."""
    batches, rollup = feed(2, 9, 25), rollup_of(tmp_path)
    batches.insert(8, [(900 + k, "u1", START - dt.timedelta(days=9), 1.0) for k in range(3)])   # late alone
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, EVENT)
        rollup(df, i)
        if i in (0, 4, 8, 9):
            rollup(df.repartition(3), i)
    check(spark, rollup, batches)


def test_totals_cover_more_than_a_hundred_batches(spark, tmp_path):
    batches, rollup = feed(3, 105, 3), rollup_of(tmp_path)
    path = str(tmp_path / "in")
    for rows in batches:
        put(spark, rows, EVENT, path)
    stream = S.stream_events(spark, path, spark.read.parquet(path).schema, 1)
    query = rollup.start(stream, str(tmp_path / "mark"))
    query.awaitTermination()
    assert len(query.recentProgress) <= 100          # Spark keeps no more: the record does
    check(spark, rollup, batches)


# ---- logon sessions by keyed state ------------------------------------------------

LOGON = "id string, date timestamp, user string, pc string, activity string"


def logons(seed, days, per_day):
    r, rows = random.Random(seed), []
    for d in range(days):
        for _ in range(per_day):
            at = dt.datetime.combine(START + dt.timedelta(days=d), dt.time()) + dt.timedelta(
                seconds=r.randrange(86400), microseconds=r.randrange(10) * 1000)
            rows.append((f"L{len(rows)}", at, f"u{r.randrange(3)}", "p", r.choice(
                ["Logon", "logon", "LOGOFF", "Logoff", "Other"])))
    return rows


def test_pairing_equals_a_loop():
    r = np.random.default_rng(1)
    on, off = r.integers(0, 10 ** 11, 40), r.integers(0, 10 ** 11, 33)
    want = [max(0.0, (b - a) / 6e7) for a, b in zip(sorted(on), sorted(off))]
    assert SS.pair_lengths(on, off, 600).tolist() == [m for m in want if m < 600]
    assert len(SS.pair_lengths(on, np.empty(0, np.int64), 600)) == 0


def test_groups_of_packed_blocks_pair_like_one_by_one():
    """Users over several blocks, one without logoffs, one whose name is null."""
    r = np.random.default_rng(2)
    events = pd.DataFrame({"user": r.choice(np.array(["a", "b", "c", None], object), 300),
                           "at": r.integers(0, 10 ** 11, 300), "is_logoff": r.random(300) < 0.5})
    events = events[(events["user"] != "c") | ~events["is_logoff"]]
    blocks = [SS.pack(events[:90]), SS.pack(events[90:91]), SS.pack(events[91:])]
    user, names, at, off = SS.unpack(blocks)
    group, minutes = SS.pair_groups(user[~off], at[~off], user[off], at[off], 600)
    assert set(names) == {"a", "b", "c", None}
    for i, name in enumerate(names):
        own = events[events["user"].isna() if name is None else events["user"] == name]
        want = SS.pair_lengths(own["at"][~own["is_logoff"]].to_numpy(), own["at"][own["is_logoff"]].to_numpy(), 600)
        assert minutes[group == i].tolist() == want.tolist()
    assert names.index("c") not in group


def test_a_day_of_many_users_is_a_state_per_slot(spark, tmp_path):
    """2000 users of a day in 8 slots: states do not grow in number with the users."""
    rows = [("x", dt.datetime(2024, 3, 1, 8 + h), f"u{i}", "p", kind) for i in range(2000)
            for h, kind in ((0, "Logon"), (1, "Logoff"))] + [("x", dt.datetime(2024, 3, 9), "u0", "p", "Logon")]
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    put(spark, rows[:-1], LOGON, path)
    put(spark, rows[-1:], LOGON, path)
    stream = S.stream_events(spark, path, spark.read.parquet(path).schema, 1)
    days = SS.stream_sessions(clean_logon(stream), slots=8)
    with SS.keyed_state(spark):
        query = (days.writeStream.format("parquet").option("path", out)
                 .option("checkpointLocation", mark).trigger(availableNow=True).start())
        query.awaitTermination()
    states = max(p.stateOperators[0].numRowsTotal for p in query.recentProgress)
    assert 0 < states <= 3 * (8 + 1)                 # events, timer and its index
    got = spark.read.schema(days.schema).parquet(out)
    assert got.count() == 2000 and got.filter("session_duration_total = 60 AND session_count = 1").count() == 2000


def test_keyed_sessions_equal_the_batch_across_a_restart(spark, tmp_path):
    rows = logons(4, 6, 40)
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    by_day = [[x for x in rows if x[1].date() == START + dt.timedelta(days=d)] for d in range(6)]
    # a day arrives in two files, its later half with the first of the next day
    halves = [h for day in by_day for h in (day[::2], day[1::2])]
    late = [("late", dt.datetime.combine(START, dt.time(5)), "u0", "p", "Logon")] * 3
    dropped = 0
    for part in (halves[:5], halves[5:10] + [late] + halves[10:]):
        for x in part:
            put(spark, x, LOGON, path)
        stream = S.stream_events(spark, path, spark.read.parquet(path).schema, 1)
        days = SS.stream_sessions(clean_logon(stream))
        with SS.keyed_state(spark):
            dropped += S.run_to_files(days, out, mark)
    found = {(r.user, r.day): (round(r.session_duration_total, 6), r.session_count)
             for r in spark.read.schema(days.schema).parquet(out).collect()}
    batch = daily_sessions(clean_logon(spark.createDataFrame(rows, LOGON)))
    want = {(r.user, r.day): (round(r.session_duration_total, 6), r.session_count)
            for r in batch.collect() if r.day < START + dt.timedelta(days=5)}
    assert found == want and len(want) > 8
    assert dropped == 3                              # counted event by event
    assert spark.conf.get(SS.PROVIDER) != SS.ROCKS


# ---- gap sessions -----------------------------------------------------------------

def gap_truth(rows, gap):
    out = []
    for user in {u for u, t in rows if u is not None and t is not None}:
        at = sorted(t for u, t in rows if u == user and t is not None)
        part = [at[0]]
        for t in at[1:]:
            if t - part[-1] > gap:
                out.append((user, part[0], part[-1], len(part)))
                part = []
            part.append(t)
        out.append((user, part[0], part[-1], len(part)))
    return sorted(out)


def gap_rows():
    r = random.Random(6)
    t0 = dt.datetime(2024, 3, 1, 12)
    rows = [(f"u{r.randrange(5)}", t0 + dt.timedelta(seconds=r.randrange(86400 * 3))) for _ in range(400)]
    rows += [("edge", t0), ("edge", t0 + dt.timedelta(minutes=30)),          # exactly the gap: one session
             ("edge", t0 + dt.timedelta(minutes=60, microseconds=1)),        # a microsecond more: two
             ("one", t0), ("same", t0), ("same", t0), (None, t0), ("null", None)]
    return rows


def test_gap_sessions_equal_a_loop(spark):
    rows, gap = gap_rows(), dt.timedelta(minutes=30)
    df = spark.createDataFrame(rows, "user string, date timestamp")
    got = sorted(map(tuple, SS.gap_sessions(df).collect()))
    assert got == gap_truth(rows, gap)
    assert SS.gap_sessions(df.filter("false")).count() == 0


def test_a_hot_user_is_a_row_per_slot(spark):
    """200,000 events of one user reach the shuffle as at most a row per slot and task."""
    df = spark.range(200_000).select(F.lit("hot").alias("user"), F.timestamp_seconds(
        F.lit(1_700_000_000) + F.col("id") % 36_000).alias("date"))
    row = SS.gap_sessions(df).collect()
    assert len(row) == 1 and row[0].events == 200_000
    text = SS.gap_sessions(df)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") <= 3 and "partial_count" in text


@pytest.mark.parametrize("merge", [True, False])
def test_stream_gap_sessions_equal_the_batch(spark, tmp_path, merge):
    rows = [x for x in gap_rows() if None not in x]
    rows += [("end", dt.datetime(2024, 3, 9))]
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    for d in range(1, 10):
        own = [x for x in rows if x[1].date() == dt.date(2024, 3, d)]
        if own:
            put(spark, own, "user string, date timestamp", path)
    stream = S.stream_events(spark, path, spark.read.parquet(path).schema, 1)
    found = SS.stream_gap_sessions(stream)
    with SS.setting(spark, SS.LOCAL_MERGE, str(merge).lower()):
        assert S.run_to_files(found, out, mark) == 0
    got = sorted(map(tuple, spark.read.schema(found.schema).parquet(out).collect()))
    assert got == [x for x in gap_truth(rows, dt.timedelta(minutes=30)) if x[0] != "end"]


def test_params_are_the_batch_ones():
    assert SS._Pairing(Params().session_cap_minutes).cap == 600
