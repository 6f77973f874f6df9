"""Plan shapes that must hold at any size."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from daywatch.operators import daily as D
from daywatch.operators import evaluate as E
from daywatch.operators.scoring import user_risk
from daywatch.plans.queries import Inputs

SF = "/root/testdata/sf0.001"
# these build models or run streams while the query is built
EAGER = {"full_run", "stream_daily_rollup", "stream_daily_alerts", "iforest_scores",
         "recon_scores", "permutation_importance", "scaled_features", "correlation",
         "describe", "histogram", "recon_energy", "recon_calibration", "iforest_gates",
         "iforest_ends", "detector_report", "full_run_tables", "csv_logs", "csv_dropped",
         "snapshot_alerts", "stream_logon_sessions", "stream_gap_sessions", "stream_late_rows",
         "stream_scored_days", "iforest_labels", "detector_reload", "detector_quality",
         "log_rejects", "incremental_deviation", "compacted_status",
         "refit_scales", "refit_correlation"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, SF)


OWN = {n for n in entry.queries() if not re.match(r"op\d+_|pipeline$", n)}


@pytest.mark.parametrize("name", sorted(OWN - EAGER))
def test_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_filters_and_columns_reach_the_scan(inputs):
    text = plan(D.daily_file(inputs.file))
    assert "EqualTo(event_type,signup)" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {
        "ts", "user_id", "event_type", "props"}
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1


def test_sources_are_combined_without_joins(inputs):
    text = plan(D.daily_behaviour(inputs.logon, inputs.file, inputs.device, inputs.email))
    joins = re.findall(r"(\w*Join) \[", text)
    # only the split of hot session groups joins, against its bounded list
    assert set(joins) <= {"BroadcastHashJoin", "SortMergeJoin"}
    assert "LeftOuter" not in text


def test_user_risk_shuffles_once(inputs):
    text = plan(user_risk(inputs.stored_scored))
    assert len(re.findall(r"Exchange hashpartitioning\(user", text)) == 1


def test_as_of_prunes_partitions(spark, inputs, tmp_path):
    import datetime as dt

    from daywatch.operators.reports import timeline
    from daywatch.sources.tables import write_by_day
    stored = write_by_day(inputs.scored, str(tmp_path))
    text = plan(timeline(stored, 7, as_of=dt.date(2024, 1, 30)))
    assert re.search(r"PartitionFilters: \[[^\]]*day", text)


def test_week_over_week_prunes_partitions(spark, inputs, tmp_path):
    import datetime as dt

    from daywatch.operators.reports import week_over_week
    from daywatch.sources.tables import write_by_day
    stored = write_by_day(inputs.scored, str(tmp_path))
    assert re.search(r"PartitionFilters: \[[^\]]*day", plan(week_over_week(stored)))
    assert re.search(r"PartitionFilters: \[[^\]]*day",
                     plan(week_over_week(stored, dt.date(2024, 1, 30))))


def test_empty_split_path_is_pruned_at_run_time(spark, inputs):
    from daywatch.operators.sessions import sessions
    df = sessions(inputs.logon)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert "LeftAnti" not in final and "block" not in final
    assert len(re.findall(r"Exchange hashpartitioning", final)) == 1


def test_a_hot_user_changes_no_result(spark, inputs):
    """A third of all events with one user on one day, on both session paths."""
    from dataclasses import replace

    from daywatch.operators.clean import clean_logon
    from daywatch.operators.sessions import daily_sessions
    from daywatch.params import Params
    base = inputs.logon.select("id", "date", "user", "pc", "activity")
    n = base.count() // 2
    hot = spark.range(n).select(
        F.concat(F.lit("H"), F.col("id").cast("string")).alias("id"),
        F.timestamp_seconds(F.lit(1705305600) + F.col("id") * 7 % 36000).alias("date"),
        F.lit("hot").alias("user"), F.lit("PC-1").alias("pc"),
        F.when(F.col("id") % 2 == 0, "Logon").otherwise("Logoff").alias("activity"))
    logon = clean_logon(base.unionByName(hot))

    def rows(p):
        return {(r.user, r.day): (round(r.session_duration_total, 6), r.session_count)
                for r in daily_sessions(logon, p).collect()}

    whole = rows(Params())
    assert whole == rows(replace(Params(), hot_group_rows=20, rank_block=16))
    assert sum(c for (u, _), (_, c) in whole.items() if u == "hot") > 50


def test_login_hours_counts_before_the_join(inputs):
    text = plan(E.login_hours(inputs.logon, inputs.truth))
    assert "Exchange hashpartitioning(user" in text


def test_stream_and_batch_of_scored_days_start_from_one_table(spark, monkeypatch):
    """The daily measures are the dearest step: they are computed once for both."""
    built, daily = [], Inputs.daily
    monkeypatch.setattr(Inputs, "daily", lambda t, *a, **k: built.append(1) or daily(t, *a, **k))
    rows = entry.queries()["stream_scored_days"](spark, SF).collect()
    assert len(built) == 1 and len(rows) == 3 and all(r["rows"] == r["same"] > 0 for r in rows)
