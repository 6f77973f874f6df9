"""State that carries on: baselines day by day, rejects, the status log."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from daywatch import schemas
from daywatch.operators import alerts as A
from daywatch.operators.baseline import advance, last_rows, with_deviations
from daywatch.operators.clean import clean_email, clean_logon, with_reasons
from daywatch.operators.features import META, fit_features
from daywatch.operators.moments import Guard, StartAnew, add_days, refit
from daywatch.operators.recon import fit_recon
from daywatch.params import BASELINE_MEASURES, FEATURES, Params
from daywatch.session import materialise
from daywatch.sources import tables as T

START = dt.date(2024, 3, 1)


# ---- baselines ------------------------------------------------------------------

def daily(spark, users=6, days=20):
    r = random.Random(3)
    rows = [(f"u{u}", START + dt.timedelta(days=d), *[float(r.choice([0, 1, 1, 5, 40])) for _ in
                                                      BASELINE_MEASURES], r.randrange(9))
            for u in range(users) for d in range(days) if r.random() < 0.7 and not (u == 5 and d < 15)]
    return spark.createDataFrame(rows, "user string, day date, " + ", ".join(
        f"{m} double" for m in BASELINE_MEASURES) + ", other int")


@pytest.mark.parametrize("step", [1, 3])
def test_days_one_at_a_time_equal_the_whole(spark, step):
    every = materialise(daily(spark), "daily")
    want = {(r.user, r.day): r.asDict() for r in with_deviations(every).collect()}
    cut = START + dt.timedelta(days=7)
    state = materialise(last_rows(every.filter(F.col("day") <= F.lit(cut))), "state")
    for d in range(8, 20, step):
        days = [START + dt.timedelta(days=d + k) for k in range(step)]
        new = every.filter(F.col("day").isin(days))
        found, state = advance(state, new)
        assert found.columns == [*new.columns, *[f"{m}_deviation" for m in BASELINE_MEASURES]]
        for row in found.collect():
            assert row.asDict() == want[row.user, row.day]
        state = materialise(state, "state")
    rows = state.groupBy("user").count().collect()
    assert all(r["count"] <= Params().baseline_rows for r in rows) and len(rows) == 6
    last = {(r.user, r.day) for r in state.collect()}
    assert last == {(r.user, r.day) for r in last_rows(every).collect()}


def test_the_state_is_cut_before_the_shuffle(spark):
    text = last_rows(daily(spark))._jdf.queryExecution().executedPlan().toString()
    assert text.index("Exchange") < text.rindex("WindowGroupLimit")


# ---- days scored with a published run ----------------------------------------------

def test_streamed_days_equal_the_batch_on_the_same_models(spark, tmp_path):
    """Training ends, three days follow in a stream with a restart and a repeated batch."""
    from daywatch.operators.alerts import daily_alerts
    from daywatch.operators.features import fit_features
    from daywatch.params import FEATURES
    from daywatch.plans.training import fit_detectors
    from daywatch.streaming.daily import stream_events
    from daywatch.streaming.scoring import DayScorer

    r = random.Random(11)
    measured = [f for f in FEATURES if not f.endswith("_deviation")]
    extra = [c for c in ("session_duration_total", "unique_pcs") if c not in measured]
    cols = [*measured, *extra]
    rows = [(f"u{u}", START + dt.timedelta(days=d), "IT" if u % 2 else "HR", "r",
             *[float(r.choice([0, 1, 2, 3, 90 if u == 3 and d > 17 else 4])) if c != "is_weekend"
               else float(d % 7 > 4) for c in cols]) for u in range(12) for d in range(21)]
    every = materialise(spark.createDataFrame(rows, "user string, day date, department string, role string, "
                                              + ", ".join(f"{c} double" for c in cols)), "daily")
    p = Params(trees=20, tree_rows=64)
    cut = F.lit(START + dt.timedelta(days=17))
    past = materialise(with_deviations(every.filter(F.col("day") <= cut), p), "past")
    prep = fit_features(past, p)
    models = fit_detectors(prep.transform(past), prep, p)
    run, target, feed = (str(tmp_path / x) for x in ("run", "target", "feed"))
    models.save(spark, f"{run}/models")
    T.write_table(last_rows(past, p), f"{run}/baseline_state")
    for d in (18, 19, 20):
        day = every.filter(F.col("day") == F.lit(START + dt.timedelta(days=d)))
        day.write.mode("append").parquet(feed)
        scorer = DayScorer(run, target, p)                   # a new process each time
        scorer.start(stream_events(spark, feed, every.schema), str(tmp_path / "mark")).awaitTermination()
    scorer(day, 2)                                           # the last batch once more
    keys = ["user", "day", "if_score", "ae_score", "risk_score", "risk_tier"]
    got = sorted(map(tuple, spark.read.parquet(f"{target}/scored").select(*keys).collect()))
    batch = models.score(prep.transform(with_deviations(every, p).filter(F.col("day") > cut)), p)
    assert got == sorted(map(tuple, batch.select(*keys).collect())) and len(got) == 36
    found = {(x.user_id, x.timestamp) for x in spark.read.parquet(f"{target}/alerts").collect()}
    assert found == {(x.user_id, x.timestamp) for x in daily_alerts(batch, p).collect()}


# ---- rejects --------------------------------------------------------------------

def test_every_row_is_cleaned_or_rejected(spark, tmp_path):
    rows = [("1", "1/4/2010 8:00:00", "u", "p", "Logon"), ("2", "never", "u", "p", "Logon"),
            ("3", None, "u", "p", "Logoff"), ("4", "1/5/2010 9:00", None, "p", "Logon"),
            ("5", None, None, None, None), ("6", "2010-01-06 10:00:00", "v", "p", "Logoff")]
    raw = spark.createDataFrame(rows, "id string, date string, user string, pc string, activity string")
    kept, rejects = T.write_judged(clean_logon(with_reasons(raw)), str(tmp_path / "log"))
    plain = clean_logon(raw)
    assert kept.columns == plain.columns
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, plain.collect()))
    got = {r.row: r.reason for r in rejects.collect()}
    assert len(got) + kept.count() == len(rows)
    assert {v.split('"id":"')[1][0]: r for v, r in got.items()} == {
        "2": "unreadable date", "3": "no date", "4": "no user", "5": "no user"}
    assert any('"date":"never"' in v for v in got)         # as it was read


def test_a_log_without_rejects_or_without_rows(spark, tmp_path):
    schema = "id string, date string, user string, pc string, activity string"
    good = spark.createDataFrame([("1", "1/4/2010 8:00", "u", "p", "Logon")], schema)
    kept, rejects = T.write_judged(clean_logon(with_reasons(good)), str(tmp_path / "good"))
    assert kept.count() == 1 and rejects.isEmpty()
    bad = good.withColumn("date", F.lit("x"))
    kept, rejects = T.write_judged(clean_logon(with_reasons(bad)), str(tmp_path / "bad"))
    assert kept.isEmpty() and rejects.count() == 1
    kept, rejects = T.write_judged(clean_logon(with_reasons(good.filter("false"))), str(tmp_path / "none"))
    assert kept.isEmpty() and rejects.isEmpty()
    mail = spark.createDataFrame([("1", None, "u", "a@x.com", "2")],
                                 "id string, date string, user string, `to` string, attachments string")
    kept, rejects = T.write_judged(clean_email(with_reasons(mail)), str(tmp_path / "mail"))
    assert kept.isEmpty() and rejects.first().reason == "no date"


# ---- status log -----------------------------------------------------------------

def update(n, status, user="u"):
    return (user, "2024-03-01", "DAILY_ANOMALY", status, dt.datetime(2024, 3, 2, 0, n), n)


def put(spark, root, *rows):
    T.append_status(spark.createDataFrame(list(rows), schemas.STATUS_EVENTS), T.status_path(root))


def statuses(spark, root):
    found = A.current_status(T.status_log(spark, root)).collect()
    assert len(found) == len({r.user_id for r in found})
    return {r.user_id: r["_status"] for r in found}


def test_compaction_between_appends_loses_and_repeats_nothing(spark, tmp_path):
    root = str(tmp_path)
    assert T.status_log(spark, root).isEmpty()
    T.compact_status_log(spark, root)                       # nothing to compact
    put(spark, root, update(1, "RESOLVED"), update(2, "bogus"), update(1, "IN_PROGRESS", "v"))
    put(spark, root, update(3, "OPEN", "w"))
    before = statuses(spark, root)
    T.compact_status_log(spark, root)
    assert statuses(spark, root) == before == {"u": "RESOLVED", "v": "IN_PROGRESS", "w": "OPEN"}
    assert T.status_log(spark, root).count() == 3           # the log is the compaction alone
    put(spark, root, update(5, "OPEN"), update(0, "OPEN", "v"))
    assert T.status_log(spark, root).count() == 5
    assert statuses(spark, root) == {"u": "OPEN", "v": "IN_PROGRESS", "w": "OPEN"}
    T.compact_status_log(spark, root)
    T.compact_status_log(spark, root)                       # no append since: nothing to do
    assert T.status_log(spark, root).count() == 3
    assert statuses(spark, root) == {"u": "OPEN", "v": "IN_PROGRESS", "w": "OPEN"}
    put(spark, root, update(9, "RESOLVED", "x"))
    T.compact_status_log(spark, root)                       # the files of the first two go
    assert statuses(spark, root)["x"] == "RESOLVED" and T.status_log(spark, root).count() == 4


def test_an_update_during_a_compaction_counts(spark, tmp_path, monkeypatch):
    """An append that lands after the files were listed is not among the replaced ones."""
    root, plain = str(tmp_path), T.write_table
    put(spark, root, update(1, "RESOLVED"))

    def slow(df, path):
        put(spark, root, update(7, "IN_PROGRESS"))
        return plain(df, path)

    monkeypatch.setattr(T, "write_table", slow)
    T.compact_status_log(spark, root)
    monkeypatch.undo()
    assert statuses(spark, root) == {"u": "IN_PROGRESS"}
    T.compact_status_log(spark, root)
    assert statuses(spark, root) == {"u": "IN_PROGRESS"}


# ---- sums per day -----------------------------------------------------------------

def matrix(spark, days, wild=0.02, departments=("a", "b", "c")):
    r = random.Random(11)
    rows = []
    for d in range(days):
        day = START + dt.timedelta(days=d)
        for u in range(40):
            x = [r.gauss(3, 1) if r.random() > wild else r.choice([1e4, -300.0, None, float("inf"), float("nan")])
                 for _ in FEATURES[:-2]]
            x[1] = x[0] * 2 if x[0] else x[1]
            values = dict(zip(FEATURES, [*x, 7.0, 0.1]))       # two constant features
            values["is_weekend"] = float(day.weekday() >= 5)
            rows.append((f"u{u}", day, departments[u % len(departments)], *[values[n] for n in FEATURES]))
    df = spark.createDataFrame(rows, "user string, day date, department string, " + ", ".join(
        f"{n} double" for n in FEATURES))
    return df.withColumns({c: F.lit(0.0) for c in META if c not in df.columns})


@pytest.mark.parametrize("fit_on", ["all", "train"])
def test_refit_from_sums_equals_the_fit_over_all_days(spark, tmp_path, fit_on):
    import numpy as np
    p, path = Params(fit_on=fit_on), str(tmp_path / "sums")
    every = materialise(matrix(spark, 20), "matrix")
    day = lambda d: F.lit(START + dt.timedelta(days=d))      # noqa: E731
    guard = Guard.within(fit_features(every.filter(F.col("day") < day(17)), p), 0.5)
    add_days(every.filter(F.col("day") < day(17)), guard, path)
    for d in (17, 18, 18, 19):                                # one day twice: it is replaced
        add_days(every.filter(F.col("day") == day(d)), guard, path)
    got, want = refit(spark, path, guard, p), fit_features(every, p)
    for name in ("low", "high", "mean", "scale"):
        assert getattr(got.prep, name) == pytest.approx(getattr(want, name), rel=1e-9, abs=1e-9)
    train = want.transform(every).filter("is_train")
    x = np.array([r.features for r in train.select("features").collect()])
    assert got.rows == len(x)
    assert np.allclose(got.mean, x.mean(axis=0), atol=1e-9)
    assert np.allclose(got.covariance, np.cov(x.T), atol=1e-9)
    recon = fit_recon(train, p)
    both = recon.with_error(train).select("recon_error", got.recon_error(F.col("features"), recon.kept).alias("e"))
    assert all(r.e == pytest.approx(r.recon_error, rel=1e-7, abs=1e-9) for r in both.collect())
    # the newest day's write reads and leaves that day only; few rows are kept whole
    kept = spark.read.parquet(path)
    assert kept.groupBy("day", "is_train").agg(F.count("i").alias("n")).agg(F.max("n")).first()[0] == 1 + 27 + 27 * 14
    assert kept.filter("x is not null").count() < every.count()


def test_sums_ask_for_a_new_start(spark, tmp_path):
    every = matrix(spark, 12, wild=0)
    guard, path = Guard.within(fit_features(every), 0.9), str(tmp_path / "sums")
    with pytest.raises(StartAnew, match="department"):
        add_days(matrix(spark, 1, departments=("a", "new")), guard, path)
    add_days(every, Guard.within(fit_features(every), 1.3), path)
    with pytest.raises(StartAnew, match="guard"):
        refit(spark, path, Guard.within(fit_features(every), 1.3))
    add_days(every.filter("is_weekend = 1"), guard, str(tmp_path / "weekend"))
    with pytest.raises(ValueError, match="no rows"):
        refit(spark, str(tmp_path / "weekend"), guard, Params(fit_on="train"))
