"""Risk, trend, alerts, triage status and distributed ranking."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from daywatch import schemas
from daywatch.operators import alerts as A
from daywatch.operators.ranking import exact_quantiles, running_totals, sketches
from daywatch.operators.scoring import by_risk, recent, score_days, user_risk
from daywatch.params import Params

D = dt.date(2010, 3, 1)
P = Params()


def scored(spark, series):
    """series: user -> list of (days before D, score, department)."""
    rows = [(u, D - dt.timedelta(days=b), dep, float(s), float(s))
            for u, xs in series.items() for b, s, dep in xs]
    df = spark.createDataFrame(rows, "user string, day date, department string, "
                                     "if_raw double, ae_raw double")
    return score_days(df, stamp=False)


def flat(scores, dep="IT"):
    return [(len(scores) - 1 - i, s, dep) for i, s in enumerate(scores)]


def risk(spark, series, **kw):
    return {r.user: r for r in user_risk(scored(spark, series), **kw).collect()}


def test_score_days_rounds_then_tiers(spark):
    df = spark.createDataFrame([("u", D, "IT", 94.996, 94.996), ("v", D, "IT", 150.0, 100.0)],
                               "user string, day date, department string, "
                               "if_raw double, ae_raw double")
    rows = {r.user: r for r in score_days(df).collect()}
    assert (rows["u"].risk_score, rows["u"].risk_tier) == (95.0, "CRITICAL")
    assert rows["v"].risk_score == 100.0 and rows["v"].scored_at is not None


def test_user_risk_and_trend(spark):
    got = risk(spark, {
        "short": flat([90, 20, 95]),
        "five": flat([10, 20, 30, 40, 50]),
        "up": flat([10] * 7 + [16] * 7),
        "edge": flat([10] * 7 + [15] * 7),
        "down": flat([50] * 7 + [40] * 7),
        "overlap": flat([0] * 5 + [50] * 5),
        "old": [(31, 99, "IT")],
        "in": [(30, 72, None), (31, 99, "HR")],
    })
    assert "old" not in got
    assert {u: r.trend for u, r in got.items()} == {
        "short": "stable", "five": "stable", "up": "up", "edge": "stable", "down": "down",
        "overlap": "up", "in": "stable"}
    r = got["short"]
    assert (r.max_risk_score, r.high_risk_days, r.latest_score, r.total_days_active,
            r.risk_tier) == (95, 2, 95, 3, "CRITICAL")
    r = got["in"]
    assert (r.max_risk_score, r.medium_risk_days, r.total_days_active, r.department) == \
        (72, 1, 1, "HR")


def test_days_are_counted_once_in_one_aggregation(spark):
    s = scored(spark, {"a": [(1, 9, "IT"), (1, 8, "IT"), (0, 7, "IT"), (40, 7, "IT")]})
    s = s.unionByName(s.limit(1).withColumn("day", F.lit(None).cast("date")))
    risk_table = user_risk(s, as_of=D)
    assert risk_table.first().total_days_active == 2
    text = risk_table._jdf.queryExecution().executedPlan().toString()
    assert text.count("Aggregate(") == 2      # before and after the grouping, no distinct one


def test_as_of_and_order(spark):
    df = scored(spark, {"a": [(0, 50, "x")], "b": [(0, 60, "x")], "c": [(0, 60, "x")]})
    assert [r.user for r in by_risk(user_risk(df, as_of=D)).collect()] == ["b", "c", "a"]
    assert recent(df, 5, as_of=D + dt.timedelta(days=6)).count() == 0


def alerting(spark):
    return scored(spark, {"a": flat([10] * 7 + [90, 96, 20, 20, 20, 20, 20]),
                          "b": flat([86]), "c": flat([60] * 7 + [71] * 7), "d": flat([1] * 3)})


def test_alerts(spark):
    s = alerting(spark)
    rows = A.by_score(A.generate_alerts(s, user_risk(s))).collect()
    assert [r.alert_id for r in sorted(rows, key=lambda r: r.alert_id)] == \
        [f"ALT-{i:05}" for i in range(1, 6)]
    by_id = {r.alert_id: r for r in rows}
    assert [by_id[f"ALT-{i:05}"].user_id for i in range(1, 6)] == ["a", "a", "b", "a", "c"]
    first = by_id["ALT-00001"]
    assert first.timestamp == f"{D - dt.timedelta(days=6)}T00:00:00Z"
    assert (first.alert_type, first.status, first.color) == ("DAILY_ANOMALY", "OPEN", "#f87171")
    rising = by_id["ALT-00004"]
    assert rising.alert_type == "RISING_TREND" and rising.if_score is None
    assert rising.risk_score == pytest.approx((70 + 90 + 96 + 100) / 14)
    assert [r.risk_score for r in rows] == sorted((r.risk_score for r in rows), reverse=True)


def test_no_alerts_is_typed_and_empty(spark):
    s = scored(spark, {"d": flat([1] * 3)})
    out = A.generate_alerts(s, user_risk(s))
    assert out.columns == schemas.ALERTS.names and out.count() == 0


def test_rising_needs_medium_tier(spark):
    s = scored(spark, {"low": flat([20] * 7 + [50] * 7)})
    assert user_risk(s).first().trend == "up"
    assert A.rising_alerts(user_risk(s)).count() == 0


def test_numbering_equals_one_sort(spark):
    """Many ranges, and a third of the alerts with one user."""
    rng = random.Random(1)
    series = {f"user{i:03}": flat([rng.choice([50, 90, 97]) for _ in range(10)])
              for i in range(30)} | {"hot": flat([96] * 150)}
    s = scored(spark, series)
    found = {r.alert_id: (r.user_id, r.timestamp) for r in
             A.generate_alerts(s, user_risk(s)).collect()}
    order = sorted(A.all_alerts(s, user_risk(s)).collect(), key=lambda r: r["_key"])
    assert found == {f"ALT-{i:05}": (r.user_id, r.timestamp) for i, r in enumerate(order, 1)}
    assert len(found) > 250


def test_numbering_has_no_python_and_no_single_partition(spark):
    s = alerting(spark)
    text = A.generate_alerts(s, user_risk(s))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text
    # the only one-task window is over one row per range
    for line in text.split("\n"):
        if "SinglePartition" in line:
            assert "_key" not in line and "user" not in line


def test_running_totals_composite_keys(spark):
    rng = random.Random(2)
    rows = [(rng.choice([0.0, 0.5, rng.random()]), f"u{i}", i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "s double, u string, v int")
    got = {(r.s, r.u): (r.n, r.t) for r in
           running_totals(df, ["s", "u"], {"n": F.lit(1), "t": "v"}).collect()}
    total = 0
    for n, (s, u, v) in enumerate(sorted(rows), 1):
        total += v
        assert got[(s, u)] == (n, total)
    down = {r.u: r.n for r in running_totals(
        df, [F.col("s").desc(), F.col("u")], {"n": F.lit(1)}).collect()}
    order = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert [down[u] for _, u, _ in order] == list(range(1, 401))


def test_exact_quantiles(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=3000), np.zeros(2000)])   # a third and more ties
    df = spark.createDataFrame([(float(a), float(a) * 2) for a in x], "a double, b double")
    probs = [0.0, 0.05, 0.5, 0.95, 0.999, 1.0]
    small = exact_quantiles(df, ["a", "b"], probs)
    large = exact_quantiles(df, ["a", "b"], probs, error=0.05)
    none = exact_quantiles(df.withColumn("c", F.lit(None).cast("double")), ["c", "a"], [0.5])
    assert none[("c", 0.5)] is None and none[("a", 0.5)] == pytest.approx(np.quantile(x, 0.5))
    assert exact_quantiles(df.filter("false"), ["a"], [0.5]) == {("a", 0.5): None}
    for q in probs:
        want = float(np.quantile(x, q))
        assert small[("a", q)] == pytest.approx(want, abs=1e-12)
        assert large[("a", q)] == pytest.approx(want, abs=1e-12)
        assert large[("b", q)] == pytest.approx(2 * want, abs=1e-12)


def test_quantiles_narrow_when_little_may_be_kept(spark):
    """Insides above `keep` are sketched again; heavy ties end at the ends of brackets."""
    import numpy as np
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=20000), np.full(9000, 0.25), np.arange(500) / 7])
    df = spark.createDataFrame([(float(a),) for a in x], "a double").repartition(5)
    probs = [0.001, 0.3, 0.5, 0.61, 0.999]
    got = exact_quantiles(df, ["a"], probs, error=0.02, keep=40)
    assert got == {("a", q): pytest.approx(float(np.quantile(x, q)), abs=1e-12) for q in probs}


def test_quantiles_from_stored_sketches(spark):
    """Sketches kept per day give the same values without a first pass over the rows."""
    import numpy as np
    rng = np.random.default_rng(2)
    rows = [(int(d), float(v), None if v > 2 else float(v * v))
            for d, v in zip(rng.integers(0, 9, 5000), rng.normal(size=5000))]
    df = spark.createDataFrame(rows, "day int, a double, b double")
    days = sketches(df, ["a", "b"], ["day"])
    assert days.count() == 9
    probs = [0.1, 0.5, 0.99]
    assert exact_quantiles(df, ["a", "b"], probs, days=days) == exact_quantiles(df, ["a", "b"], probs)
    a = [v for _, v, _ in rows]
    assert exact_quantiles(df, ["a"], probs, days=days)[("a", 0.99)] == pytest.approx(
        float(np.quantile(a, 0.99)), abs=1e-12)


def test_quantiles_do_not_shuffle_rows(spark):
    """Jobs of a quantile call end in one row: no range exchange and no written table."""
    tracker = spark.sparkContext.statusTracker()
    df = spark.range(50_000).selectExpr("cast(id * 7919 % 50000 as double) a")
    spark.sparkContext.setJobGroup("quantile", "quantile")
    try:
        assert exact_quantiles(df, ["a"], [0.25])[("a", 0.25)] == 12499.75
        jobs = tracker.getJobIdsForGroup("quantile")
        stages = [s for j in jobs for s in tracker.getJobInfo(j).stageIds]
        assert len(jobs) <= 4 and len(set(stages)) <= 6
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_status_updates(spark):
    s = alerting(spark)
    alerts = A.generate_alerts(s, user_risk(s))
    t = dt.datetime(2010, 1, 1)
    later = t + dt.timedelta(hours=1)
    updates = spark.createDataFrame([
        ("ALT-00001", "resolved ", t, 1), ("ALT-00001", "IN_PROGRESS", later, 2),
        ("ALT-00002", "RESOLVED", later, 4), ("ALT-00002", "OPEN", later, 3),
        ("ALT-00003", "CLOSED", later, 5), ("ALT-00003", None, later, 7)],
        "alert_id string, status string, ts timestamp, seq bigint")
    events = A.updates_by_id(updates, alerts).unionByName(spark.createDataFrame(
        [("nobody", "2010-01-01", "DAILY_ANOMALY", "OPEN", later, 6)], schemas.STATUS_EVENTS))
    now = {r.alert_id: r.status for r in A.with_current_status(alerts, events).collect()}
    assert now == {"ALT-00001": "IN_PROGRESS", "ALT-00002": "RESOLVED", "ALT-00003": "OPEN",
                   "ALT-00004": "OPEN", "ALT-00005": "OPEN"}
    good, bad = A.split_status_events(events, alerts)
    assert good.count() == 4
    assert {(r.seq, r.reason) for r in bad.collect()} == {
        (5, "invalid status"), (6, "unknown alert"), (7, "invalid status")}


def test_top_alerts_per_user(spark):
    s = alerting(spark)
    top = A.top_alerts_per_user(A.generate_alerts(s, user_risk(s)), 1).collect()
    assert {r.user_id: r.alert_id for r in top}["a"] == "ALT-00002"
