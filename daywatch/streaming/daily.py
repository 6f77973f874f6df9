"""Incremental daily rollups and alerts with Structured Streaming."""

from __future__ import annotations

import threading
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from daywatch.operators.alerts import daily_alerts
from daywatch.params import Params
from daywatch.schemas import ALERTS


def stream_events(spark: SparkSession, path: str, schema, files_per_batch: int | None = None
                  ) -> DataFrame:
    """Parquet files as a stream; `schema` is that of the batch table."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def closed_days(clean: DataFrame, measures: list, lateness: str = "1 day") -> DataFrame:
    """(user, day, measures) per tumbling day, emitted once the watermark passes it.

    Takes a cleaned log stream with `user` and `date`.  State is one partial
    aggregate per user and open day; the map side combines before the shuffle.
    """
    # windows start at midnight UTC: shift by the session's zone and back, so that
    # they are the same days as to_date(date)
    zone = F.current_timezone()
    timed = clean.withColumn("_wall", F.from_utc_timestamp("date", zone))
    window = F.window("_wall", "1 day")
    day = F.to_date(F.to_utc_timestamp("window.start", zone))
    return (timed.withWatermark("_wall", lateness).groupBy(window, "user").agg(*measures)
            .withColumn("day", day).drop("window"))


class LateRows(StreamingQueryListener):
    """Adds up, over all micro-batches of a query, what Spark dropped behind the watermark.

    A query keeps its last progress reports only; a listener hears them all.  An
    aggregation counts its partial rows: `rollup.DailyRollup` counts and keeps the events.
    """

    def __init__(self):
        self.dropped, self.over = {}, threading.Event()

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.dropped[p.batchId] = sum(op.numRowsDroppedByWatermark for op in p.stateOperators)

    def onQueryTerminated(self, event):
        self.over.set()


def run_to_files(stream: DataFrame, target: str, checkpoint: str) -> int:
    """Drain what is available into Parquet (exactly once, through the file sink's log).

    Returns how many rows came too late and are in no day.
    """
    spark, late = stream.sparkSession, LateRows()
    spark.streams.addListener(late)
    try:
        query = (stream.writeStream.format("parquet").outputMode("append")
                 .option("path", target).option("checkpointLocation", checkpoint)
                 .trigger(availableNow=True).start())
        query.awaitTermination()
        late.over.wait(60)
    finally:
        spark.streams.removeListener(late)
    return sum(late.dropped.values())


def stream_alerts(days: DataFrame, score: Callable[[DataFrame], DataFrame], target: str,
                  checkpoint: str, p: Params = Params(), available_now: bool = True
                  ) -> StreamingQuery:
    """Score closed days with `score` and write their daily alerts.

    Ids are made of user and day, so a repeated batch writes the same rows to
    the same folder and nothing is counted twice.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        found = daily_alerts(score(batch), p).withColumn(
            "alert_id", F.concat(F.lit("ALT-"), "user_id", F.lit("-"),
                                 F.substring("timestamp", 1, 10)))
        found.select(*ALERTS.names).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    writer = (days.writeStream.foreachBatch(handle).outputMode("append")
              .option("checkpointLocation", checkpoint))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
