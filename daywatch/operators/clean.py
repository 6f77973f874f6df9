"""Raw logs to typed events: parse times, drop unusable rows, derive flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from daywatch.functions import columns as C
from daywatch.params import Params


REASON, RAW = "reject_reason", "reject_row"


def _parsed(df: DataFrame, p: Params) -> Column:
    if isinstance(df.schema["date"].dataType, StringType):
        return C.parse_timestamp(F.col("date"), p.date_formats)
    return F.col("date").cast("timestamp")


def with_reasons(df: DataFrame, p: Params = Params()) -> DataFrame:
    """A raw log with why a row cannot be used (null: it can) and, if so, the row as JSON.

    The cleaners keep unusable rows of such a log, for a writer to set aside.
    """
    reason = (F.when(F.col("user").isNull(), "no user").when(F.col("date").isNull(), "no date")
              .when(_parsed(df, p).isNull(), "unreadable date"))
    whole = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    return df.withColumns({REASON: reason, RAW: F.when(reason.isNotNull(), whole)})


def _timed(df: DataFrame, p: Params) -> DataFrame:
    """Parsed `date`, rows without user or date dropped, `hour` and `day` added."""
    timed = df.withColumn("date", _parsed(df, p))
    usable = timed if REASON in df.columns else timed.dropna(subset=["user", "date"])
    return usable.withColumn("hour", F.hour("date")).withColumn("day", F.to_date("date"))


def clean_logon(df: DataFrame, p: Params = Params()) -> DataFrame:
    return _timed(df, p).withColumn("is_after_hours", C.is_after_hours(F.col("hour"), p))


def clean_device(df: DataFrame, p: Params = Params()) -> DataFrame:
    return _timed(df, p).withColumn("is_after_hours", C.is_after_hours(F.col("hour"), p))


def clean_file(df: DataFrame, p: Params = Params()) -> DataFrame:
    name = C.column_or(df, "filename", F.lit(None).cast("string"))
    return (_timed(df, p)
            .withColumn("is_after_hours", C.is_after_hours(F.col("hour"), p))
            .withColumn("is_sensitive", C.is_sensitive(name, p)))


def clean_email(df: DataFrame, p: Params = Params()) -> DataFrame:
    external = C.is_external(F.col("to"), p) if "to" in df.columns else F.lit(False)
    count = C.attachment_count(C.column_or(df, "attachments", F.lit(None).cast("string")))
    return (_timed(df, p)
            .withColumn("is_external", external)
            .withColumn("attachments", count))


def read_counts(df: DataFrame, p: Params = Params()) -> list[Column]:
    """Aggregates over a raw log: rows, rows without a usable date, rows without a user."""
    parsed = _parsed(df, p)
    return [F.count(F.lit(1)).alias("rows"), F.count_if(parsed.isNull()).alias("bad_dates"),
            F.count_if(F.col("user").isNull()).alias("no_user")]


def unparseable(df: DataFrame, p: Params = Params()) -> DataFrame:
    """One row: rows read, and rows whose date fits no known format."""
    return df.agg(*read_counts(df, p)[:2])
