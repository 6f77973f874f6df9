"""Sessions, daily measures, baselines."""

import datetime as dt
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from daywatch import schemas
from daywatch.operators import sessions as S
from daywatch.operators.baseline import with_deviations
from daywatch.operators.clean import clean_device, clean_email, clean_file, clean_logon
from daywatch.operators.daily import daily_behaviour, one_per_user
from daywatch.params import Params

D = dt.date(2010, 1, 4)


def log(spark, rows):
    """rows: (user, activity, 'HH:MM[:SS[.f]]' [, pc])"""
    data = [(str(i), f"2010-01-04 {r[2]}", r[0], r[3] if len(r) > 3 else "PC", r[1])
            for i, r in enumerate(rows)]
    return clean_logon(spark.createDataFrame(data, schemas.LOGON))


def minutes(spark, rows, p=Params()):
    return sorted(r.session_minutes for r in S.sessions(log(spark, rows), p).collect())


PAIRS = [("u", "Logon", "08:00:00"), ("u", "LOGON", "13:00:00"), ("u", "Logoff", "12:00:00"),
         ("u", "logoff", "17:30:00"), ("u", "Logoff", "18:00:00")]


@pytest.mark.parametrize("p", [Params(), Params(hot_group_rows=1, rank_block=2)])
def test_pairing_clamp_cap(spark, p):
    assert minutes(spark, PAIRS, p) == [240, 270]
    assert minutes(spark, [("u", "Logon", "10:00:00"), ("u", "Logoff", "09:00:00")], p) == [0]
    assert minutes(spark, [("u", "Logon", "06:00:00"), ("u", "Logoff", "16:00:00")], p) == []
    assert minutes(spark, [("u", "Logon", "06:00:00")], p) == []
    assert minutes(spark, [("u", "Logoff", "06:00:00"), ("v", "Logon", "05:00:00")], p) == []


def brute(rows):
    out = []
    for u in {r[0] for r in rows}:
        a = sorted(r[2] for r in rows if r[0] == u and r[1] == "Logon")
        b = sorted(r[2] for r in rows if r[0] == u and r[1] == "Logoff")
        for x, y in zip(a, b):
            x, y = (dt.datetime.fromisoformat(f"2010-01-04 {t}") for t in (x, y))
            m = max(0.0, (y - x).total_seconds() / 60)
            if m < 600:
                out.append((u, round(m, 6)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("hot,block", [(10**6, 65536), (1, 4), (20, 7)])
def test_split_path_equals_brute_force(spark, seed, hot, block):
    """One user holds most rows; many equal stamps; split and whole paths agree."""
    rng = random.Random(seed)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b"]), rng.choice(["Logon", "Logoff"]),
             rng.choice(["00:00:00", "09:00:00.25", "09:00:00.5",
                         f"{rng.randrange(24):02}:{rng.randrange(60):02}:00"]))
            for _ in range(300)]
    p = replace(Params(), hot_group_rows=hot, rank_block=block)
    got = sorted((r.user, round(r.session_minutes, 6))
                 for r in S.sessions(log(spark, rows), p).collect())
    assert got == brute(rows)


def test_daily_sessions_weighted(spark):
    p = Params(hot_group_rows=1, rank_block=2)
    rows = [("u", "Logon", "00:00:00")] * 7 + [("u", "Logoff", "01:00:00")] * 5
    r = S.daily_sessions(log(spark, rows), p).first()
    assert (r.session_duration_total, r.session_count) == (300.0, 5)


def frames(spark, directory=True):
    logon = log(spark, PAIRS + [("v", "Logon", "20:00:00")])
    f = spark.createDataFrame([("1", "2010-01-04 19:00:00", "u", "p", "/hr/salary.x", "Open"),
                               ("2", "2010-01-04 10:00:00", "w", "p", "/a", "Open")], schemas.FILE)
    d = spark.createDataFrame([("1", "2010-01-04 19:00:00", "u", "p", "Connect")], schemas.DEVICE)
    e = spark.createDataFrame([("1", "2010-01-04 10:00:00", "u", "p", "a@x.com", "u@dtaa.com",
                                "Send", "3", 1, "")], schemas.EMAIL)
    people = spark.createDataFrame(
        [("u", "N", None, "IT", "Analyst", None, None, None, None),
         ("u", "N", None, "Zoo", "Analyst", None, None, None, None)], schemas.DIRECTORY)
    return logon, clean_file(f), clean_device(d), clean_email(e), people


def test_daily_behaviour(spark):
    rows = {r.user: r for r in daily_behaviour(*frames(spark)).collect()}
    assert set(rows) == {"u", "v"}       # w has no logon row that day
    u = rows["u"]
    assert (u.login_count, u.after_hours_logins, u.unique_pcs) == (5, 1, 1)
    assert (u.session_duration_total, u.session_count) == (510, 2)
    assert (u.files_accessed, u.files_after_hours, u.sensitive_files) == (1, 1, 1)
    assert (u.usb_count, u.usb_after_hours) == (1, 1)
    assert (u.emails_sent, u.emails_external, u.email_attachments) == (1, 1, 3)
    assert (u.department, u.after_hours_ratio, u.files_per_session) == ("IT", 0.2, 0.5)
    assert (u.day_of_week, u.is_weekend) == (0, 0)
    v = rows["v"]
    assert (v.login_hour_std, v.department, v.role) == (0, "Unknown", "Unknown")
    assert (v.files_accessed, v.session_count, v.files_per_session) == (0, 0, 0)


def test_spine_any_and_no_logon(spark):
    logon, f, d, e, people = frames(spark)
    any_day = {r.user: r for r in daily_behaviour(logon, f, d, e, people, spine="any").collect()}
    assert set(any_day) == {"u", "v", "w"} and any_day["w"].login_count == 0
    nothing = logon.filter("false")
    assert daily_behaviour(nothing, f, d, e, people).count() == 0
    assert daily_behaviour(nothing, f, d, e, people, spine="any").count() == 2
    with pytest.raises(ValueError):
        daily_behaviour(logon, f, d, e, people, spine="x")


def test_one_per_user(spark):
    people = frames(spark)[4]
    assert [(r.user, r.department) for r in
            one_per_user(people.select("user_id", "department")).collect()] == [("u", "IT")]


def deviations(spark, values):
    rows = [("u", D + dt.timedelta(days=3 * i), float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "user string, day date, after_hours_ratio double")
    out = with_deviations(df, measures=("after_hours_ratio",)).orderBy("day")
    return [r.after_hours_ratio_deviation for r in out.collect()]


def test_baseline(spark):
    assert deviations(spark, [4]) == [0]
    assert deviations(spark, [2, 2, 5]) == [0, 0, 3]
    got = deviations(spark, [.1] * 5 + [.3, .7, .1])
    assert got[-3:] == pytest.approx([0.2, 6.940221, -0.503953], abs=1e-6)


def test_baseline_uses_one_shuffle(spark):
    plan = with_deviations(spark.range(10).select(
        F.col("id").cast("string").alias("user"), F.current_date().alias("day"),
        *[F.lit(1.0).alias(c) for c in (
            "files_accessed", "usb_count", "emails_external", "after_hours_ratio",
            "sensitive_files", "email_attachments", "session_duration_total")])) \
        ._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
