"""Investigation queries over the result tables; each returns a DataFrame."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from daywatch.functions import columns as C
from daywatch.operators.alerts import by_score, top_alerts_per_user
from daywatch.operators.daily import one_per_user
from daywatch.operators.ranking import running_totals
from daywatch.operators.scoring import last_day, recent
from daywatch.params import (ALERT_EXPORT, ALERTING_TIERS, BEHAVIOUR_MAXIMA, TIERS,
                             USER_EXPORT, WEEKDAYS, Params)


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of two one-row results side by side (a scalar subquery, no join)."""
    cell = right.agg(F.first(F.struct(*right.columns))).scalar()
    return left.withColumn("_r", cell).select(*left.columns, "_r.*")


def _page(df: DataFrame, order: list[Column], page: int, limit: int | None) -> DataFrame:
    """One page; the order ends in an id, so pages never overlap.  None = all rows.

    The first page is a top-k.  Rows of later pages are found by their rank, which is
    computed per key range, so a deep page costs no task more than its range.
    """
    if limit is None:
        return df.orderBy(*order)
    if page <= 1:
        return df.orderBy(*order).limit(limit)
    first = (page - 1) * limit
    ranked = running_totals(df, order, {"_nth": F.lit(1)})
    return ranked.filter(F.col("_nth").between(first + 1, first + limit)).orderBy("_nth").drop("_nth")


def with_total(page: DataFrame, matching: DataFrame) -> DataFrame:
    """The page's rows with the number of all matching rows beside them."""
    return page.withColumn("total", matching.agg(F.count(F.lit(1)).alias("n")).scalar())


# ---- KPIs --------------------------------------------------------------------

def week_over_week(scored: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """Mean score of the last 7 days against the 7 before, in percent; one pass."""
    newest = last_day(scored, as_of)
    last = F.col("day") >= F.date_sub(newest, 7)
    # the filter prunes day partitions: 15 days are read
    means = scored.filter(F.col("day") >= F.date_sub(newest, 14)).agg(
        F.avg(F.when(last, F.col("risk_score"))).alias("last7"),
        F.avg(F.when(~last, F.col("risk_score"))).alias("prev7"))
    change = (F.col("last7") - F.col("prev7")) / F.col("prev7") * 100.0
    return means.withColumn(
        "risk_trend_pct", F.when(F.col("prev7") > 0, F.bround(change, 1)).otherwise(F.lit(0.0)))


def tier_distribution(user_risk: DataFrame) -> DataFrame:
    """All five tiers with users and whole percent of users, 0 where absent."""
    counts = user_risk.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("risk_tier") == t).alias(t) for t in TIERS])
    rows = F.array(*[F.struct(F.lit(t).alias("risk_tier"), F.col(t).alias("users"))
                     for t in TIERS])
    return (counts.select("total", F.explode(rows).alias("r")).select(
        "r.*", F.round(F.coalesce(F.try_divide(F.col("r.users") * 100.0, "total"), F.lit(0.0)), 0)
        .cast("bigint").alias("pct")))


def tier_map(user_risk: DataFrame) -> DataFrame:
    """One row: the counts of the tiers that occur, as a map."""
    counts = user_risk.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("users"))
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("risk_tier", "users")))).alias("tier_distribution"))


def alert_summary(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.col("risk_tier") == "CRITICAL").alias("critical_alerts"),
        F.count_if(F.col("risk_tier") == "HIGH").alias("high_alerts"))


def kpis(user_risk: DataFrame, alerts: DataFrame, scored: DataFrame,
         as_of: dt.date | None = None) -> DataFrame:
    users = user_risk.agg(
        F.count_distinct("user").alias("total_users"),
        F.count_if(F.col("risk_tier") == "CRITICAL").alias("critical_users"),
        F.count_if(F.col("risk_tier") == "HIGH").alias("high_risk_users"),
        F.bround(F.avg("avg_risk_score"), 1).alias("avg_risk_score"))
    waiting = alerts.agg(
        F.count_if(F.col("status").isin("OPEN", "IN_PROGRESS")).alias("open_alerts"))
    week = week_over_week(scored, as_of).select("risk_trend_pct")
    return _beside(_beside(users, waiting), week)


def kpi_snapshot(user_risk: DataFrame, alerts: DataFrame, scored: DataFrame,
                 as_of: dt.date | None = None) -> DataFrame:
    """The KPI row with the tier map and a time stamp, ready for a JSON export."""
    return _beside(kpis(user_risk, alerts, scored, as_of), tier_map(user_risk)) \
        .withColumn("last_updated", F.current_timestamp())


def threat_level(kpi: DataFrame) -> DataFrame:
    """Global level and navigation badge from the KPI row."""
    level = (F.when(F.col("critical_users") > 0, F.lit("CRITICAL"))
             .when(F.col("high_risk_users") > 2, F.lit("HIGH"))
             .when(F.col("open_alerts") > 5, F.lit("MEDIUM"))
             .when(F.col("open_alerts") > 0, F.lit("LOW")).otherwise(F.lit("NORMAL")))
    return kpi.select(level.alias("threat_level"),
                      (F.col("critical_users") + F.col("high_risk_users")).alias("badge"))


# ---- alert list and watchlist ------------------------------------------------

def filter_alerts(alerts: DataFrame, tier: str | None = None,
                  search: str | None = None) -> DataFrame:
    if tier:
        alerts = alerts.filter(F.col("risk_tier") == tier.upper())
    if search:
        alerts = alerts.filter(C.contains_any(["user_id", "department", "alert_id"], search))
    return alerts


def alert_page(alerts: DataFrame, tier: str | None = None, search: str | None = None,
               sort: str = "risk_score", ascending: bool = False, page: int = 1,
               limit: int | None = Params.alert_page) -> DataFrame:
    sort = sort if sort in alerts.columns else "risk_score"
    key = F.col(sort).asc() if ascending else F.col(sort).desc()
    return _page(filter_alerts(alerts, tier, search), [key, F.col("alert_id")], page, limit)


def named_users(user_risk: DataFrame, directory: DataFrame) -> DataFrame:
    """Adds name and role, with defaults for users the directory does not know."""
    people = one_per_user(directory.select("user_id", "name", "role"))
    return (user_risk.drop("name", "role").join(people, "user", "left")
            .fillna({"name": "Unknown", "role": ""}))


def filter_users(users: DataFrame, department: str | None = None, tier: str | None = None,
                 search: str | None = None) -> DataFrame:
    if department:
        users = users.filter(F.col("department") == department)
    if tier:
        users = users.filter(F.col("risk_tier") == tier.upper())
    if search:
        users = users.filter(C.contains_any(
            [c for c in ("user", "name", "department") if c in users.columns], search))
    return users


def watchlist(users: DataFrame, department: str | None = None, tier: str | None = None,
              search: str | None = None, sort: str = "max_risk_score",
              ascending: bool = False, page: int = 1,
              limit: int | None = Params.user_page) -> DataFrame:
    """An unknown sort column is ignored: worst users first."""
    sort = sort if sort in users.columns else "max_risk_score"
    key = F.col(sort).asc() if ascending else F.col(sort).desc()
    return _page(filter_users(users, department, tier, search), [key, F.col("user")],
                 page, limit)


def watchlist_summary(users: DataFrame) -> DataFrame:
    return users.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("risk_tier") == "CRITICAL").alias("critical"),
        F.count_if(F.col("risk_tier") == "HIGH").alias("high"),
        F.coalesce(F.avg(F.coalesce("avg_risk_score", F.lit(0.0))), F.lit(0.0)).alias("avg"))


# ---- dossier -----------------------------------------------------------------

def dossier_days(scored: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Day history of the given users (all users without)."""
    return scored if users is None else scored.join(users.select("user"), "user", "left_semi")


def dossiers(user_risk: DataFrame, scored: DataFrame, alerts: DataFrame, directory: DataFrame,
             user: str | None = None, p: Params = Params()) -> DataFrame:
    """Nested record per user: risk, directory row, day history, top alerts.

    With `user` all inputs are filtered first (pushed to the scans); an unknown
    user gives no row.  A history holds one element per day.
    """
    if user is not None:
        user_risk = user_risk.filter(F.col("user") == user)
        scored = scored.filter(F.col("user") == user)
        alerts = alerts.filter(F.col("user_id") == user)
        directory = directory.filter(F.col("user_id") == user)
    people = one_per_user(directory)
    people = people.select("user", F.struct(*[c for c in people.columns if c != "user"])
                           .alias("directory"))
    shown = [c for c in scored.columns if c not in ("user", "day")]
    history = scored.groupBy("user").agg(
        F.sort_array(F.collect_list(F.struct("day", *shown))).alias("daily_scores"))
    top = top_alerts_per_user(alerts, p.dossier_alerts)
    listed = top.groupBy(F.col("user_id").alias("user")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("nth", F.struct(*alerts.columns)
                                                         .alias("a")))),
                    lambda x: x["a"]).alias("alerts"))
    return (user_risk.join(people, "user", "left").join(history, "user", "left")
            .join(listed, "user", "left"))


def behaviour_profile(days: DataFrame, p: Params = Params()) -> DataFrame:
    """Per user: averages of the last `behaviour_rows` days and % of the display maximum."""
    newest = W.partitionBy("user").orderBy(F.col("day").desc())
    last = (days.withColumn("nth", F.row_number().over(newest))
            .withColumn("_in", F.col("nth") <= p.behaviour_rows))
    means = last.groupBy("user").agg(
        F.max("risk_score").alias("peak_score"),
        *[F.avg(F.when(F.col("_in"), F.coalesce(F.col(m).cast("double"), F.lit(0.0)))).alias(m)
          for m in BEHAVIOUR_MAXIMA])
    rows = F.array(*[F.struct(
        F.lit(m).alias("measure"), F.col(m).alias("average"),
        F.least(F.lit(100.0), F.col(m) / F.lit(float(top)) * 100.0).alias("pct"))
        for m, top in BEHAVIOUR_MAXIMA.items()])
    return means.select("user", "peak_score", F.explode(rows).alias("r")) \
        .select("user", "peak_score", "r.*")


# ---- timeline ----------------------------------------------------------------

def population_daily(scored: DataFrame) -> DataFrame:
    return scored.groupBy("day").agg(
        F.avg("risk_score").alias("risk_score_avg"),
        F.max("risk_score").alias("risk_score_max"),
        F.count_if(F.col("risk_tier").isin(*ALERTING_TIERS)).alias("n_anomalies"))


def timeline(scored: DataFrame, days: int = Params.timeline_days,
             as_of: dt.date | None = None) -> DataFrame:
    """Population per day over the last `days` days, day as yyyy-MM-dd."""
    return population_daily(recent(scored, days, as_of)) \
        .withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def user_timeline(scored: DataFrame, user: str | None = None,
                  days: int = Params.timeline_days, as_of: dt.date | None = None) -> DataFrame:
    """Raw daily scores of one user, or of every user."""
    rows = recent(scored, days, as_of)
    if user is not None:
        rows = rows.filter(F.col("user") == user)
    return rows.select("user", F.date_format("day", "yyyy-MM-dd").alias("day"),
                       "risk_score", "if_score", "ae_score", "risk_tier")


def timeline_summary(line: DataFrame) -> DataFrame:
    """Peak, its first date, mean of the daily means, incidents; from a timeline."""
    top = F.round("risk_score_max", 2)
    peak = F.max(F.struct(top.alias("peak"), (-F.datediff(F.to_date("day"), F.lit("1970-01-01")))
                          .alias("early"), F.col("day").alias("day"))).alias("p")
    return line.agg(peak, F.round(F.avg(F.round("risk_score_avg", 2)), 1).alias("mean"),
                    F.sum("n_anomalies").alias("incidents")).select(
        F.round("p.peak", 1).alias("peak"), F.substring("p.day", 6, 5).alias("peak_date"),
        "mean", "incidents")


def incident_calendar(line: DataFrame, p: Params = Params()) -> DataFrame:
    """The newest `calendar_rows` days of a timeline (one row per day: a top-k)."""
    return line.orderBy(F.col("day").desc()).limit(p.calendar_rows)


# ---- heatmap and departments -------------------------------------------------

def heatmap(scored: DataFrame) -> DataFrame:
    """Mean score per department and weekday name, one decimal.

    Scores have two decimals; their exact sum keeps a mean that ends in a half the same in
    every order of the rows.
    """
    total = F.sum(F.col("risk_score").cast("decimal(18,2)")).cast("double")
    return (scored.filter("department IS NOT NULL")
            .groupBy("department", F.date_format("day", "EEEE").alias("dow"))
            .agg(F.bround(total / F.count("risk_score"), 1).alias("avg_risk")))


def heatmap_matrix(heat: DataFrame) -> DataFrame:
    """Departments by weekdays, 0 where no data."""
    return (heat.groupBy("department").pivot("dow", list(WEEKDAYS))
            .agg(F.first("avg_risk")).fillna(0.0))


def heatmap_top(heat: DataFrame, n: int = 6) -> DataFrame:
    return (heat.filter("avg_risk > 0")
            .orderBy(F.col("avg_risk").desc(), "department", "dow").limit(n))


def departments(user_risk: DataFrame, p: Params = Params()) -> DataFrame:
    rollup = user_risk.filter("department IS NOT NULL").groupBy("department").agg(
        F.count("user").alias("user_count"),
        F.bround(F.avg("avg_risk_score"), 2).alias("avg_risk"),
        F.bround(F.max("max_risk_score"), 2).alias("max_risk"),
        F.count_if(F.col("risk_tier") == "CRITICAL").alias("critical_count"),
        F.count_if(F.col("risk_tier") == "HIGH").alias("high_count"))
    return rollup.withColumn("dept_tier", C.dept_tier(F.col("avg_risk"), p))


def top_departments(depts: DataFrame, n: int = 8) -> DataFrame:
    return depts.orderBy(F.col("avg_risk").desc(), "department").limit(n)


def department_totals(depts: DataFrame) -> DataFrame:
    """One row; the hotspot and the department with most critical users, ties to the
    higher mean and then to the earlier name."""
    def first_by(*keys):
        order = F.struct(*[(-F.col(k)).alias(k) for k in keys], F.col("department"))
        return F.min_by("department", order)

    return depts.agg(
        F.sum("user_count").alias("total_users"),
        F.round(F.avg("avg_risk"), 4).alias("avg_risk"),
        first_by("avg_risk").alias("hotspot"),
        first_by("critical_count", "avg_risk").alias("most_critical"))


# ---- raw events --------------------------------------------------------------

def user_events(logs: dict[str, DataFrame], user: str | None = None,
                start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Raw events of a user (or of all) across the cleaned logs, one common shape."""
    detail = {"logon": "pc", "device": "pc", "file": "filename", "email": "to"}
    parts = []
    for source, df in logs.items():
        if user is not None:
            df = df.filter(F.col("user") == user)
        if start is not None:
            df = df.filter(F.col("day") >= F.lit(start))
        if end is not None:
            df = df.filter(F.col("day") <= F.lit(end))
        parts.append(df.select(
            "user", "date", F.lit(source).alias("source"), "id", "activity",
            C.column_or(df, detail[source], F.lit(None).cast("string")).alias("detail")))
    return reduce(DataFrame.unionByName, parts)


# ---- exports -----------------------------------------------------------------

def alert_export(alerts: DataFrame) -> DataFrame:
    return by_score(alerts).select(*ALERT_EXPORT)


def user_export(users: DataFrame) -> DataFrame:
    return users.orderBy(F.col("max_risk_score").desc(), "user").select(*USER_EXPORT)
