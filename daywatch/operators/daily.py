"""Cleaned logs to one row per (user, day).

All sources are projected to narrow rows, unioned and reduced by a single
group-by on (user, day): partial aggregation runs before the shuffle, so a user
holding a large share of the events costs no more than any other, and no joins
between the sources are needed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from daywatch.functions import columns as C
from daywatch.operators.sessions import session_runs
from daywatch.params import Params

KEYS = ["user", "day"]


def _logon_rows(clean: DataFrame) -> DataFrame:
    return clean.select(
        *KEYS, F.lit(1).alias("logon_row"), F.col("activity").alias("logon_activity"),
        F.col("hour").alias("logon_hour"), F.col("is_after_hours").alias("logon_late"),
        C.column_or(clean, "pc", F.lit(None).cast("string")).alias("logon_pc"))


def _file_rows(clean: DataFrame) -> DataFrame:
    return clean.select(
        *KEYS, F.col("activity").alias("file_activity"),
        F.col("is_after_hours").alias("file_late"), F.col("is_sensitive").alias("file_sensitive"))


def _device_rows(clean: DataFrame) -> DataFrame:
    return clean.select(*KEYS, F.col("activity").alias("device_activity"),
                        F.col("is_after_hours").alias("device_late"))


def _email_rows(clean: DataFrame) -> DataFrame:
    return clean.select(
        *KEYS, F.col("activity").alias("email_activity"),
        F.col("is_external").alias("email_external"), F.col("attachments").alias("email_files"))


def _session_rows(clean: DataFrame, p: Params) -> DataFrame:
    return session_runs(clean, p).select(
        *KEYS, (F.col("session_minutes") * F.col("n")).alias("session_sum"),
        F.col("n").alias("session_n"))


def logon_measures(distinct_pcs: bool = True):
    out = [F.count("logon_activity").alias("login_count"),
           F.coalesce(F.avg("logon_hour"), F.lit(0.0)).alias("login_hour_mean"),
           F.coalesce(F.stddev_samp("logon_hour"), F.lit(0.0)).alias("login_hour_std"),
           F.count_if("logon_late").alias("after_hours_logins")]
    return out + [F.count_distinct("logon_pc").alias("unique_pcs")] if distinct_pcs else out


def session_measures():
    return [F.coalesce(F.sum("session_sum"), F.lit(0.0)).alias("session_duration_total"),
            F.coalesce(F.sum("session_n"), F.lit(0)).alias("session_count")]


def file_measures():
    return [F.count("file_activity").alias("files_accessed"),
            F.count_if("file_late").alias("files_after_hours"),
            F.count_if("file_sensitive").alias("sensitive_files")]


def device_measures():
    return [F.count("device_activity").alias("usb_count"),
            F.count_if("device_late").alias("usb_after_hours")]


def email_measures():
    return [F.count("email_activity").alias("emails_sent"),
            F.count_if("email_external").alias("emails_external"),
            F.coalesce(F.sum("email_files"), F.lit(0)).alias("email_attachments")]


def daily_logon(clean: DataFrame) -> DataFrame:
    return _logon_rows(clean).groupBy(*KEYS).agg(*logon_measures())


def daily_file(clean: DataFrame) -> DataFrame:
    return _file_rows(clean).groupBy(*KEYS).agg(*file_measures())


def daily_device(clean: DataFrame) -> DataFrame:
    return _device_rows(clean).groupBy(*KEYS).agg(*device_measures())


def daily_email(clean: DataFrame) -> DataFrame:
    return _email_rows(clean).groupBy(*KEYS).agg(*email_measures())


def one_per_user(directory: DataFrame) -> DataFrame:
    """The directory with one row per user, chosen by value (repeatable)."""
    others = [c for c in directory.columns if c != "user_id"]
    return (directory.groupBy(F.col("user_id").alias("user"))
            .agg(F.min(F.struct(*others)).alias("d")).select("user", "d.*"))


def daily_behaviour(logon: DataFrame, file: DataFrame, device: DataFrame, email: DataFrame,
                    directory: DataFrame | None = None, p: Params = Params(),
                    spine: str = "logon") -> DataFrame:
    """All measures per (user, day).

    spine="logon" keeps the days with a logon row; spine="any" keeps every day
    with any activity.  Inputs are cleaned logs.
    """
    parts = [_logon_rows(logon), _session_rows(logon, p), _file_rows(file),
             _device_rows(device), _email_rows(email)]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    daily = rows.groupBy(*KEYS).agg(
        F.count("logon_row").alias("logon_rows"), *logon_measures(), *session_measures(),
        *file_measures(), *device_measures(), *email_measures())
    if spine == "logon":
        daily = daily.filter("logon_rows > 0")
    elif spine != "any":
        raise ValueError(f"spine must be 'logon' or 'any', not {spine!r}")
    daily = daily.drop("logon_rows")
    if directory is None:
        daily = daily.withColumns({"department": F.lit("Unknown"), "role": F.lit("Unknown")})
    else:
        # no hint: the directory grows with the organisation, its size decides
        known = one_per_user(directory.select("user_id", "department", "role"))
        daily = (daily.join(known, "user", "left")
                 .fillna("Unknown", subset=["department", "role"]))
    return daily.withColumns({
        "after_hours_ratio": C.ratio(F.col("after_hours_logins"), F.col("login_count")),
        "files_per_session": C.ratio(F.col("files_accessed"), F.col("session_count")),
        "day_of_week": F.weekday("day"),
        "is_weekend": F.weekday("day").isin(5, 6).cast("int"),
    })
