"""Daily rollups of a stream that account for every row: closed, open or late.

Each micro-batch is split by the days closed so far.  Rows of open days become partial
aggregates in Parquet, by day and batch; rows of closed days go to a side table as they
came.  When newer events close a day, its partials are merged and written once, for
nothing can be added any more.  A progress record per batch carries the totals on, so they
cover any number of micro-batches.

Every step overwrites what the same batch wrote before, and the record comes last: a batch
that is run again after a crash leaves the same files.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import astuple, dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from daywatch.sources.tables import read_table

PROGRESS = "batch long, rows long, late long, newest string, closed_until string"
MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Progress:
    """Totals over all batches so far; days up to `closed_until` are closed."""
    batch: int = -1
    rows: int = 0
    late: int = 0
    newest: str | None = None
    closed_until: str | None = None


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


@dataclass(frozen=True)
class DailyRollup:
    """A rollup of events to (user, day) below `root`.

    `measures`: name to (aggregate of events, how partials merge: sum, min or max).
    `_events` counts the rows.  A day is closed when an event of a day more than
    `lateness_days` after the next one has been read.
    """
    root: str
    measures: dict[str, tuple[Column, str]]
    lateness_days: int = 1

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        """Handle one micro-batch with `user` and `day` (foreachBatch)."""
        spark, before = batch.sparkSession, self.progress(batch.sparkSession, batch_id - 1)
        closed = F.lit(before.closed_until).cast("date")
        late = F.coalesce(F.col("day") <= closed, F.lit(False))
        # a narrow pass of its own: an observation is lost where no row goes on
        found = batch.agg(F.count(F.lit(1)).alias("rows"), F.count_if(late).alias("late"),
                          F.min("day").alias("oldest"), F.max("day").alias("newest")).first()
        parts = batch.filter(~late).groupBy("user", "day").agg(
            F.count(F.lit(1)).alias("_events"), *[a.alias(n) for n, (a, _) in self.measures.items()])
        (parts.withColumn("batch", F.lit(batch_id)).write.partitionBy("day", "batch")
         .mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{self.root}/parts"))
        if found["late"]:
            batch.filter(late).write.mode("overwrite").parquet(f"{self.root}/late/batch={batch_id}")
        newest = max(filter(None, (before.newest, _text(found["newest"]))), default=None)
        until = before.closed_until
        if newest:
            until = _text(dt.date.fromisoformat(newest) - dt.timedelta(days=1 + self.lateness_days))
            after = before.closed_until or _text(found["oldest"] - dt.timedelta(days=1))
            until = max(until, before.closed_until or until)
            self._close(spark, after, until, batch_id)
        now = Progress(batch_id, before.rows + found["rows"], before.late + found["late"], newest, until)
        spark.createDataFrame([astuple(now)], PROGRESS).coalesce(1).write.mode("overwrite").parquet(
            f"{self.root}/progress/nth={batch_id}")

    def _close(self, spark: SparkSession, after: str, until: str, batch_id: int) -> None:
        """Merge the partials of the days after `after` up to `until`."""
        span = (dt.date.fromisoformat(until) - dt.date.fromisoformat(after)).days
        days = [dt.date.fromisoformat(after) + dt.timedelta(days=i + 1) for i in range(max(0, span))]
        paths = [p for p in (f"{self.root}/parts/day={d}" for d in days) if exists(spark, p)]
        if paths:
            parts = spark.read.option("basePath", f"{self.root}/parts").parquet(*paths)
            (self._merged(parts).hint("rebalance", "day").write.mode("overwrite").partitionBy("day")
             .parquet(f"{self.root}/days/batch={batch_id}"))

    def _merged(self, parts: DataFrame) -> DataFrame:
        return parts.groupBy("user", "day").agg(F.sum("_events").alias("_events"), *[
            MERGE[how](n).alias(n) for n, (_, how) in self.measures.items()])

    def start(self, events: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = events.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    # ---- what is there ----------------------------------------------------------

    def progress(self, spark: SparkSession, batch_id: int | None = None) -> Progress:
        """The record of a batch; of the newest one without a number."""
        if batch_id is None:
            batch_id = read_table(spark, f"{self.root}/progress", PROGRESS).agg(F.max("batch")).first()[0]
        if batch_id is None or batch_id < 0:
            return Progress()
        row = spark.read.schema(PROGRESS).parquet(f"{self.root}/progress/nth={batch_id}").first()
        return Progress(*row)

    def closed(self, spark: SparkSession) -> DataFrame:
        """Closed days, each written once."""
        return spark.read.parquet(f"{self.root}/days").drop("batch")

    def open(self, spark: SparkSession) -> DataFrame:
        """Days that may still grow, as they stand."""
        until = self.progress(spark).closed_until
        parts = spark.read.parquet(f"{self.root}/parts")
        return self._merged(parts.filter(F.col("day") > F.lit(until).cast("date")))

    def late(self, spark: SparkSession, schema) -> DataFrame:
        """The events that came after their day was closed, as they came."""
        return read_table(spark, f"{self.root}/late", schema)


def _text(day: dt.date | None) -> str | None:
    return None if day is None else day.isoformat()
