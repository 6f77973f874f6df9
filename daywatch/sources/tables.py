"""Result tables: tolerant reads, writes, exports and the snapshot pointer."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from daywatch import schemas
from daywatch.operators.alerts import newest_updates, with_current_status
from daywatch.operators.clean import RAW, REASON
from daywatch.operators.reports import alert_export, tier_map, user_export
from daywatch.sources.logs import path_missing


def read_table(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """A Parquet table; with `schema`, an absent or empty path is a typed empty table."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if schema is None or not (path_missing(e) or e.getCondition() == "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """JSON lines; None when the path is absent."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as e:
        if not path_missing(e):
            raise
        return None


def write_by_day(df: DataFrame, path: str) -> DataFrame:
    """Parquet partitioned by day; returns the written table.

    The rebalance hint lets AQE merge small days into few files and split a day
    too large for one task.  Rows are sorted by user inside a file, so the lookup
    of one user skips most row groups.
    """
    (df.hint("rebalance", "day").sortWithinPartitions("day", "user")
     .write.mode("overwrite").partitionBy("day").parquet(path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_judged(df: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """A cleaned log `with_reasons`, in one pass: usable rows by day, the others beside them.

    Returns (usable rows as `write_by_day` would, rejects as (reason, row, day)).
    """
    bad = F.col(REASON).isNotNull()
    (df.withColumn("outcome", F.when(bad, "rejected").otherwise("clean"))
     .hint("rebalance", "outcome", "day").sortWithinPartitions("outcome", "day", "user")
     .write.mode("overwrite").partitionBy("outcome", "day").parquet(path))
    clean = df.drop(REASON, RAW)
    spark = df.sparkSession
    return (read_table(spark, f"{path}/outcome=clean", clean.schema).select(*clean.columns),
            read_rejects(spark, path))


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The rejects of a log that `write_judged` wrote: why, and the row as it was read."""
    rows = read_table(spark, f"{path}/outcome=rejected", schemas.REJECTS)
    return rows.select(F.col(REASON).alias("reason"), F.col(RAW).alias("row"))


def write_table(df: DataFrame, path: str) -> DataFrame:
    df.hint("rebalance").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_summary(user_risk: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: users, alerts, critical and high alerts, tier map."""
    def count(df, cond=None):
        return df.agg((F.count(F.lit(1)) if cond is None else F.count_if(cond)).alias("n")).scalar()

    tier = F.col("risk_tier")
    return tier_map(user_risk).select(
        F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss").alias("generated_at"),
        user_risk.agg(F.count_distinct("user").alias("n")).scalar().alias("total_users"),
        count(alerts).alias("total_alerts"),
        count(alerts, tier == "CRITICAL").alias("critical_alerts"),
        count(alerts, tier == "HIGH").alias("high_alerts"), "tier_distribution")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_alerts(alerts: DataFrame, path: str) -> None:
    write_csv(alert_export(alerts), path)


def export_users(users: DataFrame, path: str) -> None:
    write_csv(user_export(users), path)


def to_json_records(df: DataFrame) -> DataFrame:
    """Each row as one JSON object with ISO dates (page the input first)."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))


def status_path(root: str) -> str:
    """Where the triage updates of all runs below `root` lie."""
    return f"{root}/status"


def append_status(events: DataFrame, path: str) -> None:
    """Status updates are only ever appended; readers take the newest per alert."""
    events.select(*schemas.STATUS_EVENTS.names).write.mode("append").parquet(path)


def compact_status(spark: SparkSession, path: str, target: str) -> None:
    """Newest valid update per alert into a new folder."""
    write_table(newest_updates(spark.read.schema(schemas.STATUS_EVENTS).parquet(path)), target)


def _base(spark: SparkSession, root: str):
    """The newest compaction: (folder, names of the files it stands for), or None."""
    pointers = read_lines(spark, f"{root}/status_base",
                          "base string, replaced array<string>, published double")
    return pointers and pointers.agg(F.max_by(F.struct("base", "replaced"), "published")).first()[0]


def _live_files(spark: SparkSession, root: str, base) -> list[str]:
    """Files of the status log that no compaction stands for."""
    gone = set(base["replaced"]) if base else set()
    files = read_table(spark, status_path(root), schemas.STATUS_EVENTS).inputFiles()
    return [f for f in files if f.rsplit("/", 1)[-1] not in gone]


def status_log(spark: SparkSession, root: str) -> DataFrame:
    """All triage updates that count: the newest compaction and what was appended since."""
    base = _base(spark, root)
    if base is None:
        return read_table(spark, status_path(root), schemas.STATUS_EVENTS)
    paths = [f"{root}/{base['base']}", *_live_files(spark, root, base)]
    return spark.read.schema(schemas.STATUS_EVENTS).parquet(*paths)


def compact_status_log(spark: SparkSession, root: str) -> None:
    """Newest valid update per alert in place of the log so far; readers switch at once.

    The pointer names the files that the compaction stands for, so an update appended
    meanwhile, or a second compaction at the same time, is neither lost nor counted twice.
    The files go with the next compaction: a reader of the pointer before still finds them.
    """
    before = _base(spark, root)
    files = _live_files(spark, root, before)
    if not files:
        return
    base = f"status_compacted/{uuid.uuid4().hex}"
    parts = [f"{root}/{before['base']}"] if before else []
    events = spark.read.schema(schemas.STATUS_EVENTS).parquet(*parts, *files)
    write_table(newest_updates(events), f"{root}/{base}")
    old = set(before["replaced"]) if before else set()
    names = [f.rsplit("/", 1)[-1] for f in files]
    log = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status_path(root))
    fs = log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    left = [n for n in old if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log, n))]
    now = dt.datetime.now(dt.timezone.utc).timestamp()
    spark.createDataFrame([(base, names + left, now)], "base string, replaced array<string>, "
                          "published double").coalesce(1).write.mode("append").json(f"{root}/status_base")
    for name in left:
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(log, name), False)


# ---- snapshots ---------------------------------------------------------------

def publish(spark: SparkSession, root: str, run_id: str) -> None:
    """Make `run_id` the current run: append a pointer row, nothing is rewritten."""
    now = dt.datetime.now(dt.timezone.utc).timestamp()
    spark.createDataFrame([(run_id, now)], "run_id string, published double") \
        .coalesce(1).write.mode("append").json(f"{root}/current")


def current_run(spark: SparkSession, root: str) -> str | None:
    runs = read_lines(spark, f"{root}/current", "run_id string, published double")
    return runs and runs.agg(F.max_by("run_id", "published")).first()[0]


def load_snapshot(spark: SparkSession, root: str, views: bool = True) -> dict[str, DataFrame]:
    """The result tables of the current run, also as temporary views.

    Alerts carry their newest triage status, also one set in an earlier run.
    Calling it again reloads: readers see a whole run or the one before it.
    """
    run = current_run(spark, root)
    out = {}
    for name, schema in schemas.RESULTS.items():
        df = (read_table(spark, f"{root}/{run}/{name}", schema) if run
              else spark.createDataFrame([], schema))
        if name == "alerts":
            df = with_current_status(df, status_log(spark, root))
        if views:
            df.createOrReplaceTempView(name)
        out[name] = df
    return out
