"""Cleaning rules and scalar rules on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from daywatch import schemas
from daywatch.functions import columns as C
from daywatch.operators.clean import (clean_device, clean_email, clean_file, clean_logon,
                                      unparseable)
from daywatch.params import Params

P = Params()


def logon(spark, rows):
    return spark.createDataFrame(
        [(str(i), d, u, pc, a) for i, (d, u, pc, a) in enumerate(rows)], schemas.LOGON)


def test_after_hours_bounds(spark):
    rows = logon(spark, [(f"01/04/2010 {h:02}:30:00", "u", "p", "Logon") for h in (7, 8, 17, 18)])
    got = {r.hour: r.is_after_hours for r in clean_logon(rows).collect()}
    assert got == {7: True, 8: False, 17: False, 18: True}


def test_dates_bad_mixed_and_missing_user(spark):
    rows = logon(spark, [("01/04/2010 08:00:00", "u", "p", "Logon"),
                         ("2010-01-05 09:10:11", "u", "p", "Logon"),
                         ("1/6/2010 7:5:3", "u", "p", "Logon"),
                         ("not a date", "u", "p", "Logon"),
                         (None, "u", "p", "Logon"),
                         ("01/04/2010 08:00:00", None, "p", "Logon")])
    days = sorted(r.day for r in clean_logon(rows).collect())
    assert days == [dt.date(2010, 1, 4), dt.date(2010, 1, 5), dt.date(2010, 1, 6)]
    assert unparseable(rows).first() == (6, 2)


def test_sensitive_files(spark):
    names = ["/hr/SALARY.xls", "/x/Credentials.txt", "/x/readme.txt", None]
    rows = spark.createDataFrame(
        [(str(i), "01/04/2010 08:00:00", "u", "p", n, "Open") for i, n in enumerate(names)],
        schemas.FILE)
    assert [r.is_sensitive for r in clean_file(rows).orderBy("id").collect()] == \
        [True, True, False, False]
    assert not clean_file(rows.drop("filename")).first().is_sensitive


@pytest.mark.parametrize("to,external", [
    ("a@dtaa.com", False), (None, True), ("x@gmail.com", True),
    ("a@dtaa.com.evil", True), ("x@gmail.com;a@dtaa.com", False), ("a@dtaaxcom", True)])
def test_external_recipients(spark, to, external):
    row = spark.createDataFrame([(to,)], "to string")
    assert row.select(C.is_external(F.col("to"), P)).first()[0] is external


def test_email_without_recipient_column_and_attachments(spark):
    rows = spark.createDataFrame(
        [(str(i), "01/04/2010 08:00:00", "u", "p", "x@gmail.com", "u@dtaa.com", "Send", a, 1, "")
         for i, a in enumerate(["2.7", "x", None, "3", "nan", "inf"])], schemas.EMAIL)
    got = clean_email(rows).orderBy("id").collect()
    assert [r.attachments for r in got] == [2, 0, 0, 3, 0, 0]
    bare = clean_email(rows.drop("to", "attachments"))
    assert {(r.is_external, r.attachments) for r in bare.collect()} == {(False, 0)}


def test_device_keeps_columns(spark):
    rows = spark.createDataFrame([("1", "01/04/2010 20:00:00", "u", "p", "Connect")],
                                 schemas.DEVICE)
    r = clean_device(rows).first()
    assert (r.hour, r.day, r.is_after_hours) == (20, dt.date(2010, 1, 4), True)


def test_tiers_ensemble_messages(spark):
    rows = spark.createDataFrame(
        [(96.0,), (95.0,), (88.0,), (85.0,), (75.0,), (70.0,), (55.0,), (40.0,), (39.99,)],
        "s double")
    got = [r[0][0] for r in rows.select(C.tier(F.col("s"), P)).collect()]
    assert got == list("CCHHMMLLN")
    pairs = spark.createDataFrame([(20.0, 40.0), (80.0, 60.0), (50.0, 70.0)], "i double, a double")
    mix = [r[0] for r in pairs.select(C.ensemble(F.col("i"), F.col("a"), P)).collect()]
    assert mix == pytest.approx([28, 72, 58])
    text = [r[0].split(":")[0] for r in rows.select(
        C.alert_message(F.col("s"), F.lit("u"), P)).collect()]
    assert text == ["CRITICAL"] * 2 + ["HIGH RISK"] * 2 + ["MEDIUM"] * 2 + ["LOW"] * 3
    strict = Params(tier_critical=99.0)
    assert rows.select(C.alert_message(F.col("s"), F.lit("u"), strict)).first()[0] \
        .startswith("HIGH RISK")
    colors = rows.select(C.tier_color(F.lit("HIGH")), C.tier_color(F.lit("?"))).first()
    assert tuple(colors) == ("#f87171", "#666")


def test_alert_id_and_department_scale(spark):
    got = [r[0] for r in spark.createDataFrame([(1,), (99999,), (123456,)], "n int")
           .select(C.alert_id(F.col("n"))).collect()]
    assert got == ["ALT-00001", "ALT-99999", "ALT-123456"]
    dept = [r[0] for r in spark.createDataFrame(
        [(70.0,), (50.0,), (30.0,), (15.0,), (14.9,)], "s double")
        .select(C.dept_tier(F.col("s"), P)).collect()]
    assert dept == ["CRITICAL", "HIGH", "MEDIUM", "LOW", "NORMAL"]


def test_finite_and_header():
    assert C.normalise_header(" User Id ") == "user_id"


def test_finite(spark):
    rows = spark.createDataFrame([(1.5,), (float("inf"),), (float("-inf"),), (float("nan"),)],
                                 "x double")
    assert [r[0] for r in rows.select(C.finite(F.col("x"))).collect()] == [1.5, None, None, None]
