"""Canonical logs derived from the `events`, `customer`, `nation` and `labels` tables.

Every log is a filter and a projection of `events`: no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Folder and recipient of an event by the number k in its properties.
FOLDERS = ("reports", "confidential", "engineering", "salary", "public",
           "strategy", "marketing", "credentials", "shared", "archive")
DOMAINS = ("dtaa.com", "dtaa.com", "gmail.com", "dtaa.com", "competitor.com")
THREATS = ("data_exfiltrator", "disgruntled_saboteur", "negligent_insider")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_name(key: Column) -> Column:
    return F.concat(F.lit("U"), key.cast("string"))


def _pick(names: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (k % len(names) + 1).cast("int"))


def _events(events: DataFrame, kinds: tuple[str, ...], prefix: str) -> DataFrame:
    return (events.filter(F.col("event_type").isin(*kinds))
            .withColumn("k", F.get_json_object("props", "$.k").cast("int"))
            .withColumn("id", F.concat(F.lit(prefix), F.col("event_id").cast("string")))
            .withColumn("date", F.col("ts").cast("timestamp"))
            .withColumn("user", user_name(F.col("user_id"))))


def _pc() -> Column:
    return F.concat(F.lit("PC-"), (F.col("k") % 7).cast("string"))


def logon(events: DataFrame) -> DataFrame:
    activity = F.when(F.col("event_type") == "view", "Logon").otherwise("Logoff")
    return _events(events, ("view", "click"), "L").select(
        "id", "date", "user", _pc().alias("pc"), activity.alias("activity"))


def file(events: DataFrame) -> DataFrame:
    path = F.concat(F.lit("/"), _pick(FOLDERS, F.col("k")), F.lit("/doc_"),
                    F.col("k").cast("string"), F.lit(".txt"))
    return _events(events, ("signup",), "F").select(
        "id", "date", "user", _pc().alias("pc"), path.alias("filename"),
        F.lit("Open").alias("activity"))


def device(events: DataFrame) -> DataFrame:
    activity = F.when(F.col("event_id") % 2 == 0, "Connect").otherwise("Disconnect")
    return _events(events, ("error",), "D").select(
        "id", "date", "user", _pc().alias("pc"), activity.alias("activity"))


def email(events: DataFrame) -> DataFrame:
    to = F.concat(F.lit("person"), F.col("k").cast("string"), F.lit("@"),
                  _pick(DOMAINS, F.col("k")))
    return _events(events, ("purchase",), "E").select(
        "id", "date", "user", _pc().alias("pc"), to.alias("to"),
        F.concat("user", F.lit("@dtaa.com")).alias("from"), F.lit("Send").alias("activity"),
        F.floor(F.col("value") / 50).cast("string").alias("attachments"),
        F.length("props").cast("bigint").alias("size"), F.col("props").alias("content"))


def directory(customer: DataFrame, nation: DataFrame) -> DataFrame:
    """Customers as employees; the department is the market segment."""
    places = nation.select("n_nationkey", "n_name")
    return customer.join(places, customer.c_nationkey == places.n_nationkey, "left").select(
        user_name(F.col("c_custkey")).alias("user_id"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("department"), F.col("n_name").alias("role"))


def ground_truth(labels: DataFrame) -> DataFrame:
    insider = F.col("toxic") == 1
    return labels.select(
        user_name(F.col("doc_id")).alias("user_id"),
        F.when(insider, _pick(THREATS, F.col("doc_id"))).otherwise("none").alias("threat_type"),
        F.when(insider, F.date_add(F.lit("2024-01-10").cast("date"),
                                   (F.col("doc_id") % 10).cast("int"))).alias("trigger_date"),
        insider.alias("is_insider"),
        F.when(insider, "labelled toxic").otherwise("Normal behavior").alias("description"))


def activity(events: DataFrame) -> DataFrame:
    """Every event as (user, date)."""
    return events.select(user_name(F.col("user_id")).alias("user"),
                         F.col("ts").cast("timestamp").alias("date"))


def write_arrivals(events: DataFrame, path: str, file_rows: int = 2_000_000) -> int:
    """The events as a feed in order of arrival: every eleventh is 1 to 5 days late.

    One write per day of arrival, so files are as old as the order says, and the same
    number of files each day, which is returned: a stream that takes so many at a time
    sees one day per micro-batch.
    """
    user, day = user_name(F.col("user_id")).alias("user"), F.to_date("ts")
    held = F.when(F.col("event_id") % 11 == 0, F.col("event_id") % 5 + 1).otherwise(0).cast("int")
    feed = events.select("event_id", user, day.alias("day"), "value",
                         F.date_add(day, held).alias("arrival"))
    days = [r["arrival"] for r in feed.groupBy("arrival").agg(F.count(F.lit(1)).alias("n"))
            .orderBy("arrival").collect()]            # one row per calendar day
    files = max(1, feed.count() // max(1, len(days)) // file_rows)
    for arrival in days:
        (feed.filter(F.col("arrival") == F.lit(arrival)).drop("arrival").repartition(files)
         .write.mode("append").parquet(path))
    return files


def component_measures() -> list[Column]:
    total = F.sum(F.col("value").cast("decimal(18,2)")).cast("double")
    return [F.least(F.lit(100.0), F.max("value") / F.lit(2.3)).alias("if_raw"),
            F.least(F.lit(100.0), total / F.lit(3.1)).alias("ae_raw")]


def component_scores(events: DataFrame) -> DataFrame:
    """(user, day, if_raw, ae_raw): two scores that plain SQL can recompute.

    They stand in for the detectors where a query is about scoring, alerts or
    reports.  The sum is over exact decimals, so it does not depend on order.
    """
    return events.groupBy(user_name(F.col("user_id")).alias("user"),
                          F.to_date("ts").alias("day")).agg(*component_measures())


def status_events(events: DataFrame) -> DataFrame:
    """Clicks as triage updates of alerts on their user and day; some are invalid."""
    names = ("resolved", "IN_PROGRESS", " open ", "CLOSED")
    return _events(events, ("click",), "").select(
        F.col("user").alias("user_id"), F.date_format("date", "yyyy-MM-dd").alias("alert_day"),
        F.when(F.col("event_id") % 7 == 0, "RISING_TREND").otherwise("DAILY_ANOMALY")
        .alias("alert_type"),
        _pick(names, F.col("event_id")).alias("status"),
        F.col("date").alias("ts"), F.col("event_id").alias("seq"))
