"""Detector scores to risk: ensemble, tiers, per-user risk and trend."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from daywatch.functions import columns as C
from daywatch.params import ALERTING_TIERS, Params


def score_days(days: DataFrame, if_raw: str = "if_raw", ae_raw: str = "ae_raw",
               p: Params = Params(), stamp: bool = True) -> DataFrame:
    """Replaces the two raw 0-100 scores by if_score, ae_score, risk_score and risk_tier.

    Scores are rounded to two decimals; the tier looks at the rounded score.
    """
    mix = C.ensemble(F.col(if_raw), F.col(ae_raw), p)
    out = (days.withColumns({
        "if_score": F.bround(if_raw, 2),
        "ae_score": F.bround(ae_raw, 2),
        "risk_score": F.bround(mix, 2)}).drop(if_raw, ae_raw)
        .withColumn("risk_tier", C.tier(F.col("risk_score"), p)))
    return out.withColumn("scored_at", F.current_timestamp()) if stamp else out


def last_day(scored: DataFrame, as_of: dt.date | None = None) -> Column:
    """The newest day as a scalar.  With `as_of` it is a literal, so that a table
    partitioned by day is pruned while planning."""
    if as_of is not None:
        return F.lit(as_of)
    return scored.agg(F.max("day").alias("d")).scalar()


def recent(scored: DataFrame, days: int, as_of: dt.date | None = None) -> DataFrame:
    """Rows of the newest day and the `days` days before it."""
    return scored.filter(F.col("day") >= F.date_sub(last_day(scored, as_of), days))


def user_risk(scored: DataFrame, p: Params = Params(),
              as_of: dt.date | None = None) -> DataFrame:
    """One row per user active in the risk window; the trend sees the full history.

    The row numbers and the aggregate share one shuffle on user; a group holds
    one row per day.
    """
    user = W.partitionBy("user")
    n = p.trend_rows
    since = F.date_sub(last_day(scored, as_of), p.risk_window_days)
    numbered = scored.select(
        "user", "day", "department", "risk_score", "risk_tier",
        F.row_number().over(user.orderBy("day")).alias("nth"),
        F.count(F.lit(1)).over(user).alias("rows"),
        (~F.lag("day").over(user.orderBy("day")).eqNullSafe(F.col("day"))).alias("new_day"),
        (F.col("day") >= since).alias("in_window"))
    back = F.col("rows") - F.col("nth")       # 0 = newest row
    score = F.col("risk_score")
    inside = F.col("in_window")
    older = (F.when(F.col("rows") >= 2 * n, back.between(n, 2 * n - 1))
             .otherwise(F.col("nth") <= n))
    risk = numbered.groupBy("user").agg(
        F.max(F.when(inside, score)).alias("max_risk_score"),
        F.avg(F.when(inside, score)).alias("avg_risk_score"),
        F.count_if(inside & F.col("risk_tier").isin(*ALERTING_TIERS)).alias("high_risk_days"),
        F.count_if(inside & (F.col("risk_tier") == "MEDIUM")).alias("medium_risk_days"),
        F.max_by(score, "day").alias("latest_score"),
        F.max("day").alias("latest_day"),
        F.count_if(inside & F.col("new_day")).alias("total_days_active"),
        F.min_by("department", F.when(F.col("department").isNotNull(), F.col("day")))
         .alias("department"),
        F.max("rows").alias("rows"),
        F.avg(F.when(back < n, score)).alias("newer"),
        F.avg(F.when(older, score)).alias("older"),
    ).filter("total_days_active > 0")
    return risk.withColumn("risk_tier", C.tier(F.col("max_risk_score"), p)) \
        .withColumn("trend", _trend(p)).drop("rows", "newer", "older")


def _trend(p: Params) -> Column:
    delta = F.col("newer") - F.col("older")
    return (F.when(F.col("rows") < p.trend_min_rows, F.lit("stable"))
            .when(delta > p.trend_delta, F.lit("up"))
            .when(delta < -p.trend_delta, F.lit("down"))
            .otherwise(F.lit("stable")))


def by_risk(user_risk_df: DataFrame) -> DataFrame:
    """Worst users first."""
    return user_risk_df.orderBy(F.col("max_risk_score").desc(), "user")
