"""Deviation of each day from the user's own trailing days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from daywatch.params import BASELINE_MEASURES, Params


def with_deviations(daily: DataFrame, p: Params = Params(),
                    measures: tuple[str, ...] = BASELINE_MEASURES) -> DataFrame:
    """Adds `<measure>_deviation`: z-score against the previous `baseline_rows` rows.

    Rows, not calendar days; today is excluded.  One window spec serves all
    aggregates, hence one shuffle on user and one sort.  A user's group holds
    one row per day, however many events lie behind it.
    """
    prior = W.partitionBy("user").orderBy("day").rowsBetween(-p.baseline_rows, -1)

    def deviation(m: str):
        x = F.col(m)
        # a flat history is recognised exactly, not by a rounded-off std of 0
        flat = F.min(x).over(prior) == F.max(x).over(prior)
        spread = F.when(~flat, F.stddev_samp(x).over(prior))
        z = (x - F.avg(x).over(prior)) / F.coalesce(spread, F.lit(1.0))
        return F.coalesce(z, F.lit(0.0))

    return daily.withColumns({f"{m}_deviation": deviation(m) for m in measures})


def last_rows(daily: DataFrame, p: Params = Params(),
              measures: tuple[str, ...] = BASELINE_MEASURES) -> DataFrame:
    """(user, day, measures): each user's last `baseline_rows` rows, the state of a baseline.

    Kept rows are chosen before the shuffle too, so it moves a bounded number per user and task.
    """
    newest = W.partitionBy("user").orderBy(F.col("day").desc())
    return (daily.select("user", "day", *measures).withColumn("_nth", F.row_number().over(newest))
            .filter(F.col("_nth") <= p.baseline_rows).drop("_nth"))


def advance(state: DataFrame, new: DataFrame, p: Params = Params(),
            measures: tuple[str, ...] = BASELINE_MEASURES) -> tuple[DataFrame, DataFrame]:
    """(new days with deviations, next state), from `last_rows` of all days before.

    Reads the state and the new days only; equal to `with_deviations` over everything, as
    long as no new day of a user comes before one that is there.
    """
    both = state.select("user", "day", *measures, F.lit(False).alias("_new")).unionByName(
        new.withColumn("_new", F.lit(True)), allowMissingColumns=True)
    names = [*new.columns, *[f"{m}_deviation" for m in measures]]
    return with_deviations(both, p, measures).filter("_new").select(*names), last_rows(both, p, measures)
