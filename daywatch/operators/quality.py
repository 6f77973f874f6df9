"""Data-quality rules and dataset profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from daywatch.params import ALERT_STATUSES, TIERS

# Allowed contents.
LOGON_ACTIVITIES = ("Logon", "Logoff")
THREAT_TYPES = ("data_exfiltrator", "disgruntled_saboteur", "negligent_insider", "none")
TRENDS = ("up", "down", "stable")
ALERT_TYPES = ("DAILY_ANOMALY", "RISING_TREND")


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    return [c for c in required if c not in df.columns]


def check(name: str, df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(table, rule, violations): all rules of a table in one pass, plus `not_empty`.

    A rule holds where it is true; false and null both count as violations.
    """
    one = df.agg(F.count(F.lit(1)).alias("_rows"),
                 *[F.count_if(~F.coalesce(c, F.lit(False))).alias(r) for r, c in rules.items()])
    rows = F.array(
        F.struct(F.lit("not_empty").alias("rule"),
                 (F.col("_rows") == 0).cast("bigint").alias("violations")),
        *[F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in rules])
    return one.select(F.lit(name).alias("table"), F.explode(rows).alias("r")) \
        .select("table", "r.*")


def _finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def quality_report(logon: DataFrame, email: DataFrame, daily: DataFrame, scored: DataFrame,
                   user_risk: DataFrame, alerts: DataFrame, truth: DataFrame) -> DataFrame:
    """Every rule of every table as (table, rule, violations)."""
    numeric = [f.name for f in daily.schema.fields
               if f.dataType.typeName() in ("double", "long", "integer")]
    parts = [
        check("logon", logon, {"activity_allowed": F.col("activity").isin(*LOGON_ACTIVITIES),
                               "user_present": F.col("user").isNotNull()}),
        check("email", email, {"sender_present": F.col("from").isNotNull()}),
        check("daily", daily, {
            "ratio_bounded": F.col("after_hours_ratio").between(0, 1),
            "all_finite": reduce(lambda a, b: a & b, [_finite(c) for c in numeric]),
            "not_all_null": F.coalesce(*[F.col(c).cast("double") for c in numeric]).isNotNull()}),
        check("scored", scored, {"tier_allowed": F.col("risk_tier").isin(*TIERS),
                                 "score_bounded": F.col("risk_score").between(0, 100)}),
        check("user_risk", user_risk, {"trend_allowed": F.col("trend").isin(*TRENDS)}),
        check("alerts", alerts, {"status_allowed": F.col("status").isin(*ALERT_STATUSES),
                                 "type_allowed": F.col("alert_type").isin(*ALERT_TYPES)}),
        check("ground_truth", truth, {
            "threat_type_allowed": F.col("threat_type").isin(*THREAT_TYPES)}),
    ]
    return reduce(DataFrame.unionByName, parts)


def is_subset(left: DataFrame, right: DataFrame) -> bool:
    """True when no row of `left` is missing in `right`."""
    return left.subtract(right).isEmpty()


def is_disjoint(left: DataFrame, right: DataFrame) -> bool:
    return left.intersect(right).isEmpty()


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(metric, value): rows per table, each a count over its own scan."""
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("value"))
          .select(F.lit(f"rows_{name}").alias("metric"), "value")
        for name, df in tables.items()])


def dataset_profile(logs: dict[str, DataFrame], daily: DataFrame, directory: DataFrame,
                    truth: DataFrame) -> DataFrame:
    """(metric, value): rows per log, insiders, users and matrix shape, date range in days."""
    shape = daily.agg(F.count(F.lit(1)).alias("rows_daily"),
                      F.lit(len(daily.columns)).cast("bigint").alias("columns_daily"),
                      F.count_distinct("user").alias("users"),
                      (F.datediff(F.max("day"), F.min("day")) + 1).cast("bigint").alias("span"))
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"))
                     for c in ("rows_daily", "columns_daily", "users", "span")])
    insiders = truth.agg(F.count_if("is_insider").alias("value")) \
        .select(F.lit("insiders").alias("metric"), "value")
    return (row_counts({**logs, "directory": directory}).unionByName(insiders)
            .unionByName(shape.select(F.explode(rows).alias("r")).select("r.*")))


def users_per_department(directory: DataFrame) -> DataFrame:
    return directory.groupBy("department").agg(F.count(F.lit(1)).alias("users"))


def activity_rates(device: DataFrame, email: DataFrame) -> DataFrame:
    """Per user: device events and percent of mail going outside, in one group-by."""
    rows = device.select("user", F.lit(1).alias("usb"), F.lit(None).cast("int").alias("external")) \
        .unionByName(email.select("user", F.lit(None).cast("int").alias("usb"),
                                  F.col("is_external").cast("int").alias("external")))
    return rows.groupBy("user").agg(F.count("usb").alias("usb_events"),
                                    (F.avg("external") * 100.0).alias("external_pct"))
