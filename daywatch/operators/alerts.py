"""Alerts on anomalous days and rising users, and their triage status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from daywatch.functions import columns as C
from daywatch.operators.ranking import running_totals
from daywatch.params import ALERT_STATUSES, ALERTING_TIERS, RISING_TIERS, Params
from daywatch.schemas import ALERTS

_BODY = [c for c in ALERTS.names if c != "alert_id"]


def _stamp(day: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T00:00:00Z"))


def daily_alerts(scored: DataFrame, p: Params = Params()) -> DataFrame:
    """One alert per HIGH or CRITICAL user-day, without id; `_key` orders them."""
    return scored.filter(F.col("risk_tier").isin(*ALERTING_TIERS)).select(
        _stamp(F.col("day")).alias("timestamp"),
        F.col("user").alias("user_id"),
        F.coalesce("department", F.lit("Unknown")).alias("department"),
        "risk_score", "risk_tier", "if_score", "ae_score",
        F.lit("DAILY_ANOMALY").alias("alert_type"),
        F.lit("OPEN").alias("status"),
        C.alert_message(F.col("risk_score"), F.col("user"), p).alias("message"),
        C.tier_color(F.col("risk_tier")).alias("color"),
        F.concat(F.lit("0"), "user", F.lit("\u0001"),
                 F.date_format("day", "yyyy-MM-dd")).alias("_key"))


def rising_alerts(user_risk: DataFrame, p: Params = Params()) -> DataFrame:
    """One alert per user with a rising trend and at least tier MEDIUM, worst first."""
    # max_risk_score has two decimals in [0, 100]: a fixed-width descending key
    rank = F.lpad((F.lit(10_000) - F.round(F.col("max_risk_score") * 100)).cast("int")
                  .cast("string"), 5, "0")
    hit = (F.col("trend") == "up") & F.col("risk_tier").isin(*RISING_TIERS)
    return user_risk.filter(hit).select(
        _stamp(F.col("latest_day")).alias("timestamp"),
        F.col("user").alias("user_id"),
        F.coalesce("department", F.lit("Unknown")).alias("department"),
        F.col("avg_risk_score").alias("risk_score"), "risk_tier",
        F.lit(None).cast("double").alias("if_score"),
        F.lit(None).cast("double").alias("ae_score"),
        F.lit("RISING_TREND").alias("alert_type"),
        F.lit("OPEN").alias("status"),
        C.rising_message(F.col("user")).alias("message"),
        C.tier_color(F.col("risk_tier")).alias("color"),
        F.concat(F.lit("1"), rank, "user").alias("_key"))


def all_alerts(scored: DataFrame, user_risk: DataFrame, p: Params = Params()) -> DataFrame:
    """Both kinds, not numbered: for reports that need no alert id."""
    return daily_alerts(scored, p).unionByName(rising_alerts(user_risk, p))


def number_alerts(alerts: DataFrame, p: Params = Params()) -> DataFrame:
    """Dense ids ALT-00001...: daily alerts by (user, day), then rising users.

    Numbered per key range plus the counts of the lower ranges, never by a
    one-task sort.
    """
    numbered = running_totals(alerts, ["_key"], {"_n": F.lit(1)})
    return numbered.select(C.alert_id(F.col("_n")).alias("alert_id"), *_BODY)


def generate_alerts(scored: DataFrame, user_risk: DataFrame, p: Params = Params()) -> DataFrame:
    """The alert table.  Typed and empty when nothing alerts."""
    return number_alerts(all_alerts(scored, user_risk, p), p)


def by_score(alerts: DataFrame) -> DataFrame:
    return alerts.orderBy(F.col("risk_score").desc(), "alert_id")


# ---- triage status -----------------------------------------------------------

def normal_status(status: Column) -> Column:
    return F.trim(F.upper(F.coalesce(status, F.lit(""))))


STATUS_KEY = ["user_id", "alert_day", "alert_type"]


def keyed(alerts: DataFrame) -> DataFrame:
    """Alerts with `alert_day`, the part of the key that survives a new run."""
    return alerts.withColumn("alert_day", F.substring("timestamp", 1, 10))


def updates_by_id(updates: DataFrame, alerts: DataFrame) -> DataFrame:
    """Updates that name an alert_id of the current run, as status events."""
    known = keyed(alerts).select("alert_id", *STATUS_KEY)
    return updates.join(known, "alert_id").select(*STATUS_KEY, "status", "ts", "seq")


def split_status_events(events: DataFrame, alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) updates; rejected carry a `reason`.

    Only the keys that updates name take part on the alert side, one row each.
    """
    named = events.select(*STATUS_KEY).distinct()
    known = (named.join(keyed(alerts).select(*STATUS_KEY), STATUS_KEY, "left_semi")
             .withColumn("_known", F.lit(True)))
    checked = (events.withColumn("status", normal_status(F.col("status")))
               .join(known, STATUS_KEY, "left")
               .withColumn("reason", F.when(~F.col("status").isin(*ALERT_STATUSES),
                                            F.lit("invalid status"))
                           .when(F.col("_known").isNull(), F.lit("unknown alert")))
               .drop("_known"))
    return (checked.filter("reason IS NULL").drop("reason"),
            checked.filter("reason IS NOT NULL"))


def newest_updates(events: DataFrame) -> DataFrame:
    """The latest valid update per alert (latest by time, then sequence)."""
    valid = events.withColumn("status", normal_status(F.col("status"))) \
        .filter(F.col("status").isin(*ALERT_STATUSES))
    newest = valid.groupBy(*STATUS_KEY).agg(
        F.max_by(F.struct("status", "ts", "seq"), F.struct("ts", "seq")).alias("e"))
    return newest.select(*STATUS_KEY, "e.*")


def current_status(events: DataFrame) -> DataFrame:
    """Latest valid status per alert."""
    return newest_updates(events).select(*STATUS_KEY, F.col("status").alias("_status"))


def with_current_status(alerts: DataFrame, events: DataFrame) -> DataFrame:
    """Alerts with their newest status; alerts never touched keep theirs.

    Updates reduce to one row per alert before the join, so an alert with a
    flood of updates does not skew it.
    """
    return (keyed(alerts).join(current_status(events), STATUS_KEY, "left")
            .withColumn("status", F.coalesce("_status", "status"))
            .select(*alerts.columns))


def top_alerts_per_user(alerts: DataFrame, n: int) -> DataFrame:
    order = W.partitionBy("user_id").orderBy(F.col("risk_score").desc(), "alert_id")
    return (alerts.withColumn("nth", F.row_number().over(order))
            .filter(F.col("nth") <= n))
