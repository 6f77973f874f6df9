"""Readers for the raw CSV logs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from daywatch import schemas
from daywatch.functions.columns import normalise_header

# File names of the raw corpus.
FILES = {"logon": "logon.csv", "file": "file.csv", "device": "device.csv",
         "email": "email.csv", "directory": "LDAP.csv", "ground_truth": "ground_truth.csv"}
REQUIRED = ("logon", "file", "device", "email", "directory")


def path_missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_csv(spark: SparkSession, path: str, schema: StructType,
             rename: dict[str, str] | None = None, multi_line: bool = False) -> DataFrame:
    """A CSV log by header name; typed and empty when the path does not exist.

    Headers are normalised, `rename` maps other spellings to canonical names.
    Only canonical columns are kept; values that do not fit become null.
    """
    try:
        raw = spark.read.csv(path, header=True, escape='"', mode="PERMISSIVE",
                             multiLine=multi_line)
    except AnalysisException as e:
        if not path_missing(e):
            raise
        return spark.createDataFrame([], schema)
    names = [normalise_header(c) for c in raw.columns]
    names = [(rename or {}).get(n, n) for n in names]
    df = raw.toDF(*names)
    return df.select(*[
        F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name)
        for f in schema.fields if f.name in names])


def read_corpus(spark: SparkSession, root: str,
                renames: dict[str, dict[str, str]] | None = None,
                multi_line: tuple[str, ...] = ("email",)) -> dict[str, DataFrame]:
    """All raw logs below `root`.

    Logs in `multi_line` may hold line breaks inside quotes (mail bodies do).  Such a
    file cannot be split, so a large log of this kind should come as many files.
    """
    return {name: read_csv(spark, f"{root}/{file}", schemas.RAW[name],
                           (renames or {}).get(name), name in multi_line)
            for name, file in FILES.items()}


def missing_sources(spark: SparkSession, root: str) -> list[str]:
    """Required files that are absent or have no rows."""
    return [FILES[name] for name in REQUIRED
            if read_csv(spark, f"{root}/{FILES[name]}", schemas.RAW[name]).isEmpty()]
