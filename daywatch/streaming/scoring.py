"""New days scored with the models of a published run, as they close."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from daywatch.operators.alerts import daily_alerts
from daywatch.operators.baseline import advance
from daywatch.params import Params
from daywatch.plans.training import Detectors
from daywatch.schemas import ALERTS
from daywatch.sources.tables import write_table


@dataclass
class DayScorer:
    """Scores micro-batches of daily behaviour (a row per user and closed day).

    `run` is the folder of a published run: its models are loaded once, its
    `baseline_state` starts the baselines.  Below `target` every batch leaves its scored
    days, its alerts and the state that the next batch starts from; a batch that is run
    again overwrites them with the same rows.  A batch reads the state (a bounded number of
    rows per user) and its own days, never older ones.  Days must come in order.
    """
    run: str
    target: str
    p: Params = field(default_factory=Params)
    models: Detectors | None = None

    def state(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """Baselines after a batch; of the run before the first."""
        path = f"{self.target}/state/batch={batch_id}" if batch_id >= 0 else f"{self.run}/baseline_state"
        return spark.read.parquet(path)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if self.models is None:
            self.models = Detectors.load(spark, f"{self.run}/models")
        days, state = advance(self.state(spark, batch_id - 1), batch, self.p)
        write_table(state, f"{self.target}/state/batch={batch_id}")
        scored = write_table(self.models.score(self.models.prep.transform(days), self.p),
                             f"{self.target}/scored/batch={batch_id}")
        found = daily_alerts(scored, self.p).withColumn("alert_id", F.concat(
            F.lit("ALT-"), "user_id", F.lit("-"), F.substring("timestamp", 1, 10)))
        write_table(found.select(*ALERTS.names), f"{self.target}/alerts/batch={batch_id}")

    def start(self, days: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        writer = days.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
