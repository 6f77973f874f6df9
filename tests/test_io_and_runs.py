"""CSV and Parquet sources, exports, snapshots, the whole run, streams, reports."""

import datetime as dt
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from daywatch import schemas
from daywatch.operators import alerts as A
from daywatch.operators import evaluate as E
from daywatch.operators import quality as Q
from daywatch.operators import reports as R
from daywatch.operators.clean import clean_file, unparseable
from daywatch.operators.scoring import score_days, user_risk
from daywatch.params import ALERT_EXPORT, FEATURES, TIERS, USER_EXPORT, Params
from daywatch.plans.training import CLEANERS, Detectors, train_from_files
from daywatch.session import clear_scratch, materialise, scratch_dir
from daywatch.sources import logs as L
from daywatch.sources import tables as T
from daywatch.streaming import daily as S

USERS, DAYS, ODD = 24, 30, 2
START = dt.date(2010, 1, 4)


def write_corpus(root: Path):
    """A small organisation; the first users turn odd in the last ten days."""
    rng = random.Random(9)
    out = {n: [] for n in ("logon", "file", "device", "email")}

    def at(day, hour):
        return f"{day:%m/%d/%Y} {hour:02}:{rng.randrange(60):02}:{rng.randrange(60):02}"

    for i in range(USERS):
        user = f"CER{i:04}"
        for d in range(DAYS):
            day = START + dt.timedelta(days=d)
            if day.weekday() >= 5 and rng.random() < 0.8:
                continue
            bad = i < ODD and d >= DAYS - 10
            out["logon"].append((user, at(day, 22 if bad else 8), f"PC-{i}", "Logon"))
            out["logon"].append((user, at(day, 23 if bad else 17), f"PC-{i}", "Logoff"))
            for _ in range(rng.randrange(3, 6) * (8 if bad else 1)):
                name = "/finance/confidential/x.doc" if bad else "/share/y.doc"
                out["file"].append((user, at(day, 23 if bad else 10), f"PC-{i}", name, "Open"))
            for _ in range(8 if bad else rng.randrange(0, 2)):
                out["device"].append((user, at(day, 23 if bad else 11), f"PC-{i}", "Connect"))
            for _ in range(rng.randrange(1, 4)):
                out["email"].append((user, at(day, 12), f"PC-{i}",
                                     "x@gmail.com" if bad else "b@dtaa.com", f"{user}@dtaa.com",
                                     "Send", 5 if bad else 0, 100, 'say "hi", bye'))
    heads = {"logon": "id,User ,Date,pc,activity", "file": "id,user,date,pc,filename,activity",
             "device": "id,user,date,pc,activity",
             "email": "id,user,date,pc,to,from,activity,attachments,size,content"}
    for name, rows in out.items():
        def cell(v):
            return '"' + v.replace('"', '""') + '"' if isinstance(v, str) and '"' in v else str(v)
        lines = [heads[name]] + [",".join([f"{name[0].upper()}{n:08}", *map(cell, r)])
                                 for n, r in enumerate(rows)]
        (root / L.FILES[name]).write_text("\n".join(lines) + "\n")
    people = ["user_id,name,email,department,role,team,supervisor,start_date,pc"] + [
        f"CER{i:04},Name {i},CER{i:04}@dtaa.com,{['IT', 'HR', 'Sales'][i % 3]},Analyst,T,,"
        f"2009-01-01,PC-{i}" for i in range(USERS)]
    (root / "LDAP.csv").write_text("\n".join(people) + "\n")
    truth = ["user_id,threat_type,trigger_date,is_insider,description"] + [
        f"CER{i:04},{'data_exfiltrator' if i < ODD else 'none'},"
        f"{START + dt.timedelta(days=DAYS - 10) if i < ODD else ''},{i < ODD},x"
        for i in range(USERS)]
    (root / "ground_truth.csv").write_text("\n".join(truth) + "\n")
    return {n: len(r) for n, r in out.items()}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw")
    return root, write_corpus(root)


@pytest.fixture(scope="module")
def run(spark, corpus, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("runs"))
    summary = train_from_files(spark, str(corpus[0]), root, Params(trees=80)).first()
    return root, summary


def test_csv_reader(spark, corpus, tmp_path):
    root, sizes = corpus
    logs = L.read_corpus(spark, str(root))
    assert {n: logs[n].count() for n in sizes} == sizes
    assert logs["logon"].columns == ["id", "date", "user", "pc", "activity"]
    assert logs["email"].first().content == 'say "hi", bye'
    assert logs["ground_truth"].filter("is_insider").count() == ODD
    assert L.missing_sources(spark, str(root)) == []
    assert L.missing_sources(spark, str(tmp_path)) == [
        "logon.csv", "file.csv", "device.csv", "email.csv", "LDAP.csv"]
    empty = L.read_csv(spark, str(tmp_path / "none.csv"), schemas.FILE)
    assert empty.schema == schemas.FILE and empty.isEmpty()
    (tmp_path / "other.csv").write_text("User ID,employee name\nU1,Ann\n")
    renamed = L.read_csv(spark, str(tmp_path / "other.csv"), schemas.DIRECTORY,
                         {"employee_name": "name"})
    assert renamed.columns == ["user_id", "name"] and renamed.first().name == "Ann"
    with pytest.raises(FileNotFoundError):
        train_from_files(spark, str(tmp_path), str(tmp_path))


def test_whole_run(spark, corpus, run):
    root, summary = run
    t = T.load_snapshot(spark, root)
    assert summary.total_users == USERS == t["user_risk"].count()
    assert summary.total_alerts == t["alerts"].count()
    assert spark.table("user_risk").count() == USERS
    assert t["alerts"].columns == schemas.ALERTS.names
    base = f"{root}/{T.current_run(spark, root)}"
    assert "day=" in " ".join(T.read_table(spark, f"{base}/scored").inputFiles())
    daily = T.read_table(spark, f"{base}/daily_behaviour")
    assert set(FEATURES) <= set(daily.columns)
    # detection quality on planted insiders
    truth = L.read_corpus(spark, str(corpus[0]))["ground_truth"]
    labelled = E.label_scores(E.user_scores(t["scored"]), truth)
    assert E.roc_auc(labelled).first().auc_roc > 0.9
    gate = E.detection_rate(t["user_risk"], truth).first()
    assert gate.detection_rate >= 0.5 and gate.maxed_normals == 0
    assert gate.score_std > 1 and gate.normal_share >= 0.5
    features = T.read_table(spark, f"{base}/features")
    again = Detectors.load(spark, f"{base}/models").score(features, Params(trees=80))
    cols = ["user", "day", "if_score", "ae_score", "risk_score", "risk_tier"]
    assert Q.is_subset(again.select(cols), t["scored"].select(cols))
    logs = {n: T.read_table(spark, f"{base}/{n}_log/outcome=clean") for n in ("logon", "email")}
    report = Q.quality_report(logs["logon"], logs["email"], daily, t["scored"], t["user_risk"],
                              t["alerts"], truth)
    assert report.filter("violations > 0").count() == 0


def test_snapshot_switch(spark, run):
    root, _ = run
    first = T.current_run(spark, root)
    T.publish(spark, root, "later")
    assert T.current_run(spark, root) == "later"
    assert T.load_snapshot(spark, root, views=False)["alerts"].count() == 0   # typed, empty
    T.publish(spark, root, first)
    assert T.load_snapshot(spark, root, views=False)["user_risk"].count() == USERS
    assert T.current_run(spark, f"{root}/nowhere") is None


def test_reports(spark, run):
    t = T.load_snapshot(spark, run[0], views=False)
    users = R.named_users(t["user_risk"], t["directory"])
    pages = [R.watchlist(users, page=i, limit=10).collect() for i in (1, 2, 3)]
    assert [len(x) for x in pages] == [10, 10, 4]
    flat = [r.max_risk_score for x in pages for r in x]
    assert flat == sorted(flat, reverse=True)
    a, b = (R.watchlist(users, page=i, limit=10).select("user") for i in (1, 2))
    assert Q.is_disjoint(a, b)
    assert R.watchlist(users, limit=0).count() == 0
    assert R.watchlist(users, limit=None, sort="nonsense").count() == USERS
    assert R.watchlist(users, search="name 1", limit=None).count() == 11
    assert R.watchlist(users, department="HR", limit=None).count() == 8
    up = [r.user for r in R.watchlist(users, sort="user", ascending=True, limit=3).collect()]
    assert up == ["CER0000", "CER0001", "CER0002"]
    worst = flat and pages[0][0].user
    d = R.dossiers(t["user_risk"], t["scored"], t["alerts"], t["directory"], worst).first()
    days = [x.day for x in d.daily_scores]
    assert days == sorted(days) and d.directory.name.startswith("Name")
    assert len(d.alerts) <= 20
    assert R.dossiers(t["user_risk"], t["scored"], t["alerts"], t["directory"], "X").isEmpty()
    assert json.loads(T.to_json_records(R.dossiers(
        t["user_risk"], t["scored"], t["alerts"], t["directory"], worst)).first().record)["user"] \
        == worst
    line = R.user_timeline(t["scored"], worst, 5)
    assert 0 < line.count() <= 6
    assert R.timeline(t["scored"], 30).first().day.startswith("2010-")
    k = R.kpis(t["user_risk"], t["alerts"], t["scored"])
    assert k.first().total_users == USERS
    assert R.threat_level(k).first().threat_level in (*TIERS,)
    assert R.kpi_snapshot(t["user_risk"], t["alerts"], t["scored"]).first().tier_distribution
    assert sum(r.users for r in R.tier_distribution(t["user_risk"]).collect()) == USERS
    m = R.heatmap_matrix(R.heatmap(t["scored"]))
    assert m.columns[1:] == ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday",
                             "Sunday"] and m.count() == 3
    alerts = t["alerts"]
    assert R.alert_page(alerts, tier="critical", limit=None).filter(
        "risk_tier <> 'CRITICAL'").isEmpty()


def test_user_events(spark, corpus):
    from daywatch.plans.training import CLEANERS
    raw = L.read_corpus(spark, str(corpus[0]))
    logs = {n: c(raw[n]) for n, c in CLEANERS.items()}
    one = R.user_events(logs, "CER0003", START, START)
    assert {r.source for r in one.collect()} <= set(logs)
    assert one.filter("source = 'logon'").count() == 2
    assert R.user_events(logs).count() == sum(corpus[1].values())


def test_exports_and_status_log(spark, run, tmp_path):
    t = T.load_snapshot(spark, run[0], views=False)
    users = R.named_users(t["user_risk"], t["directory"])
    T.export_users(users, f"{tmp_path}/users")
    T.export_alerts(t["alerts"], f"{tmp_path}/alerts")
    back = spark.read.csv(f"{tmp_path}/users", header=True)
    assert tuple(back.columns) == USER_EXPORT and back.count() == USERS
    back = spark.read.csv(f"{tmp_path}/alerts", header=True)
    assert back.isEmpty() or tuple(back.columns) == ALERT_EXPORT
    T.write_json(R.kpi_snapshot(t["user_risk"], t["alerts"], t["scored"]), f"{tmp_path}/kpi")
    assert spark.read.json(f"{tmp_path}/kpi").first().total_users == USERS
    now = dt.datetime(2010, 1, 1)
    for i, status in enumerate(["OPEN", "RESOLVED"]):
        T.append_status(spark.createDataFrame(
            [("u", "2010-01-04", "DAILY_ANOMALY", status, now, i)], schemas.STATUS_EVENTS),
            f"{tmp_path}/status")
    T.compact_status(spark, f"{tmp_path}/status", f"{tmp_path}/status2")
    r = spark.read.parquet(f"{tmp_path}/status2").collect()
    assert [(x.user_id, x.status, x.seq) for x in r] == [("u", "RESOLVED", 1)]


def test_status_survives_a_new_run(spark, tmp_path):
    """The second run numbers its alerts anew; the update stays with its alert."""
    root = str(tmp_path)

    def alert(number, user):
        return (number, "2010-01-04T00:00:00Z", user, "IT", 90.0, "HIGH", 1.0, 1.0,
                "DAILY_ANOMALY", "OPEN", "m", "c")

    for run_id, rows in (("one", [alert("ALT-00001", "a"), alert("ALT-00002", "b")]),
                         ("two", [alert("ALT-00001", "b")])):
        T.write_table(spark.createDataFrame(rows, schemas.ALERTS), f"{root}/{run_id}/alerts")
        T.publish(spark, root, run_id)
        if run_id == "one":
            T.append_status(spark.createDataFrame(
                [("b", "2010-01-04", "DAILY_ANOMALY", "resolved", dt.datetime(2010, 1, 5), 1)],
                schemas.STATUS_EVENTS), T.status_path(root))
            now = T.load_snapshot(spark, root, views=False)["alerts"]
            assert {r.user_id: r.status for r in now.collect()} == {"a": "OPEN", "b": "RESOLVED"}
    now = T.load_snapshot(spark, root, views=False)["alerts"].collect()
    assert [(r.alert_id, r.user_id, r.status) for r in now] == [("ALT-00001", "b", "RESOLVED")]


def test_mail_bodies_and_stamps_without_seconds(spark, tmp_path):
    rows = ['id,date,user,pc,to,from,activity,attachments,size,content',
            'E1,1/4/2010 8:00,u,p,a@x.com,u@dtaa.com,Send,1,10,"line one\nline ""two"""',
            'E2,01/04/2010 08:00:30,u,p,a@x.com,u@dtaa.com,Send,1,10,plain',
            'E3,never,u,p,a@x.com,u@dtaa.com,Send,1,10,plain']
    (tmp_path / "email.csv").write_text("\n".join(rows))
    mail = L.read_corpus(spark, str(tmp_path))["email"]
    assert unparseable(mail).first() == (3, 1)
    found = {r.id: r for r in CLEANERS["email"](mail).collect()}
    assert set(found) == {"E1", "E2"} and found["E1"].content == 'line one\nline "two"'
    assert found["E1"].date == dt.datetime(2010, 1, 4, 8)


def test_summary_without_alerts(spark):
    risk = spark.createDataFrame([], schemas.USER_RISK)
    row = T.run_summary(risk, spark.createDataFrame([], schemas.ALERTS)).first()
    assert (row.total_users, row.total_alerts) == (0, 0)


# ---- streams -----------------------------------------------------------------

def file_events(spark, days):
    rows = [(f"F{d}{i}", dt.datetime(2010, 1, 4 + d, 6 + i, 0), f"u{i % 3}", "p",
             "/hr/salary" if i % 2 else "/a", "Open") for d in range(days) for i in range(14)]
    return spark.createDataFrame(rows, "id string, date timestamp, user string, pc string, "
                                       "filename string, activity string")


def measures():
    return [F.count("activity").alias("files"), F.count_if("is_sensitive").alias("sensitive")]


@pytest.fixture()
def stream(spark, tmp_path):
    """Files in event-time order, one per day and batch."""
    df = file_events(spark, 6)
    for d in range(6):
        day = START + dt.timedelta(days=d)
        df.filter(F.to_date("date") == F.lit(day)).coalesce(1).write.mode("append") \
            .parquet(f"{tmp_path}/in")
    return df, S.stream_events(spark, f"{tmp_path}/in", df.schema, files_per_batch=1)


def test_stream_rollup_equals_batch(spark, stream, tmp_path):
    df, source = stream
    days = S.closed_days(clean_file(source), measures())
    S.run_to_files(days, f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {(r.user, r.day): (r.files, r.sensitive) for r in
           spark.read.schema(days.schema).parquet(f"{tmp_path}/out").collect()}
    batch = clean_file(df).groupBy("user", "day").agg(*measures()).collect()
    want = {(r.user, r.day): (r.files, r.sensitive) for r in batch
            if r.day <= START + dt.timedelta(days=3)}       # later days are still open
    assert got == want


def test_stream_alerts_are_idempotent(spark, stream, tmp_path):
    _, source = stream
    days = S.closed_days(clean_file(source), measures())

    def score(batch):
        return score_days(batch.select("user", "day", F.lit("IT").alias("department"),
                                       (F.col("files") * 20.0).alias("if_raw"),
                                       (F.col("files") * 20.0).alias("ae_raw")))

    for _ in range(2):      # a second start finds nothing new
        S.stream_alerts(days, score, f"{tmp_path}/alerts", f"{tmp_path}/cp2").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/alerts")
    ids = [r.alert_id for r in out.collect()]
    assert len(ids) == len(set(ids)) == 4 * 2     # u0, u1: 5 files a day (100); u2: 4 (80)
    assert "ALT-u0-2010-01-04" in ids


def test_scratch_dir_is_below_the_checkpoint_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_dir(spark, "x")
    assert path != scratch_dir(spark, "x")
    assert path.startswith(root or spark.conf.get("daywatch.local.scratch"))


class _Cluster:
    """What scratch_root asks of a session, on a cluster without a shared folder."""
    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        master = "spark://host:7077"


def test_scratch_is_refused_without_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_dir(_Cluster(), "x")


def test_clear_scratch_removes_the_copies(spark):
    kept = materialise(spark.range(3).toDF("i"), "clear")
    assert kept.count() == 3
    clear_scratch(spark)
    again = materialise(spark.range(2).toDF("i"), "clear")
    assert again.count() == 2
    with pytest.raises(Exception):
        spark.read.parquet(*kept.inputFiles()).count()


# ---- rest --------------------------------------------------------------------

def test_labels_and_cohorts(spark):
    threats = spark.createDataFrame(
        [("a", "data_exfiltrator", START, True, "x")], schemas.GROUND_TRUTH)
    users = spark.createDataFrame([("a",), ("b",), ("b",)], "user_id string")
    truth = E.complete_labels(threats, users)
    assert {(r.user_id, r.threat_type, r.is_insider) for r in truth.collect()} == {
        ("a", "data_exfiltrator", True), ("b", "none", False)}
    days = spark.createDataFrame([("a", START, 80.0), ("c", START, 1.0)],
                                 "user string, day date, risk_score double")
    assert {r.user: r.is_insider for r in E.label_days(days, truth).collect()} == {
        "a": True, "c": False}
    assert [r.user for r in E.members(days, truth, True).collect()] == ["a"]
    assert [r.after_trigger for r in E.insider_series(days, truth).collect()] == [True]


def test_quality_counts_violations(spark):
    df = spark.createDataFrame([("Logon",), ("Bad",), (None,)], "activity string")
    got = {r.rule: r.violations for r in Q.check(
        "t", df, {"ok": F.col("activity").isin("Logon", "Logoff")}).collect()}
    assert got == {"not_empty": 0, "ok": 2}
    assert Q.check("t", df.filter("false"), {}).first().violations == 1
    assert Q.missing_columns(df, ("activity", "user")) == ["user"]


def test_alerts_keep_their_schema_after_triage(spark):
    alerts = spark.createDataFrame([], schemas.ALERTS)
    events = spark.createDataFrame([], schemas.STATUS_EVENTS)
    assert A.with_current_status(alerts, events).columns == schemas.ALERTS.names
    assert user_risk(spark.createDataFrame([], schemas.SCORED)).count() == 0
