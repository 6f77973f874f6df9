"""Logon sessions: the i-th logon of a (user, day) with its i-th logoff.

Ordinary groups are ranked in one window with one shuffle.  A (user, day) with
more than `hot_group_rows` events (a service account, a log with day-only
stamps) would overload that task, so it takes an exact split path instead:
equal times collapse to counted runs, ranks come from per-second totals, and
the pairing is done per block of `rank_block` ranks.  No group on either path
grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from daywatch.params import Params

KEYS = ["user", "day"]


def _minutes(login: str, logoff: str):
    gap = F.unix_micros(F.col(logoff)) - F.unix_micros(F.col(login))
    return F.greatest(F.lit(0.0), gap / F.lit(60_000_000.0))


def _pair_whole(events: DataFrame) -> DataFrame:
    """One window per (user, day); the following group-by reuses its shuffle."""
    day = W.partitionBy(*KEYS)
    ranked = events.select(
        *KEYS, "is_logoff", "date",
        (F.row_number().over(day.orderBy("is_logoff", "date"))
         - F.when(F.col("is_logoff"), F.count_if(~F.col("is_logoff")).over(day))
            .otherwise(F.lit(0))).alias("nth"))
    return (ranked.groupBy(*KEYS, "nth")
            .agg(F.min(F.when(~F.col("is_logoff"), F.col("date"))).alias("login_at"),
                 F.min(F.when(F.col("is_logoff"), F.col("date"))).alias("logoff_at"))
            .dropna(subset=["login_at", "logoff_at"])
            .select(*KEYS, "login_at", "logoff_at", F.lit(1).cast("bigint").alias("n")))


def _pair_split(events: DataFrame, block: int) -> DataFrame:
    """The same pairing for hot groups, in bounded pieces."""
    side = [*KEYS, "is_logoff"]
    runs = (events.groupBy(*side, "date").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("second", F.unix_seconds("date")))
    # at most 86 400 seconds per side and day
    totals = runs.groupBy(*side, "second").agg(F.sum("n").alias("in_second"))
    before = F.sum("in_second").over(
        W.partitionBy(*side).orderBy("second").rowsBetween(W.unboundedPreceding, -1))
    totals = totals.select(*side, "second", F.coalesce(before, F.lit(0)).alias("before"))
    # at most a million distinct microseconds per second
    inside = F.sum("n").over(
        W.partitionBy(*side, "second").orderBy("date")
        .rowsBetween(W.unboundedPreceding, -1))
    placed = (runs.withColumn("inside", F.coalesce(inside, F.lit(0)))
              .join(totals, [*side, "second"])
              .withColumn("start", F.col("before") + F.col("inside"))
              .withColumn("stop", F.col("start") + F.col("n")))
    # cut every run at multiples of `block`, so a piece of rank space is bounded
    first = F.expr(f"start div {block}")
    last = F.expr(f"(stop - 1) div {block}")
    pieces = (placed
              .withColumn("block", F.explode(F.sequence(first, last)))
              .withColumn("lo", F.greatest("start", F.col("block") * block))
              .withColumn("hi", F.least("stop", (F.col("block") + 1) * block)))
    group = W.partitionBy(*KEYS, "block")
    order = group.orderBy("lo", "is_logoff")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    login = F.when(~F.col("is_logoff"), F.col("date"))
    logoff = F.when(F.col("is_logoff"), F.col("date"))
    end = F.least(F.max(F.when(~F.col("is_logoff"), F.col("hi"))).over(group),
                  F.max(F.when(F.col("is_logoff"), F.col("hi"))).over(group))
    both = F.count_if("is_logoff").over(group).between(1, F.count(F.lit(1)).over(group) - 1)
    segments = pieces.select(
        *KEYS,
        F.last(login, ignorenulls=True).over(so_far).alias("login_at"),
        F.last(logoff, ignorenulls=True).over(so_far).alias("logoff_at"),
        F.when(both, F.least(F.coalesce(F.lead("lo").over(order), end), end) - F.col("lo"))
         .alias("n"))
    return segments.filter("n > 0 AND login_at IS NOT NULL AND logoff_at IS NOT NULL")


def session_runs(logon: DataFrame, p: Params = Params()) -> DataFrame:
    """(user, day, session_minutes, n): n sessions of the same length."""
    kind = F.lower("activity")
    events = (logon.filter(kind.isin("logon", "logoff"))
              .select(*KEYS, "date", (kind == "logoff").alias("is_logoff")))
    # result-neutral: both paths pair alike; the list's size decides how it is joined
    hot = (events.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("events"))
           .filter(F.col("events") > p.hot_group_rows).select(*KEYS))
    usual = events.join(hot, KEYS, "left_anti")
    heavy = events.join(hot, KEYS, "left_semi")
    pairs = _pair_whole(usual).unionByName(_pair_split(heavy, p.rank_block))
    return (pairs.select(*KEYS, _minutes("login_at", "logoff_at").alias("session_minutes"), "n")
            .filter(F.col("session_minutes") < p.session_cap_minutes))


def sessions(logon: DataFrame, p: Params = Params()) -> DataFrame:
    """One row per session."""
    return (session_runs(logon, p)
            .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))))
            .select(*KEYS, "session_minutes"))


def daily_sessions(logon: DataFrame, p: Params = Params()) -> DataFrame:
    return (session_runs(logon, p).groupBy(*KEYS)
            .agg(F.sum(F.col("session_minutes") * F.col("n")).alias("session_duration_total"),
                 F.sum("n").alias("session_count")))
