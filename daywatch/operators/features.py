"""Daily measures to the detectors' feature vector."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from daywatch.functions import columns as C
from daywatch.params import FEATURES, Params

NAMES = (*FEATURES, "dept_encoded")

# Descriptive columns that scored days keep.
META = ("department", "files_accessed", "usb_count", "emails_external", "after_hours_logins",
        "sensitive_files", "email_attachments", "session_duration_total", "unique_pcs")


@dataclass(frozen=True)
class FeaturePrep:
    """Fitted limits and scales, one entry per feature, and the department index."""
    names: tuple[str, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    departments: StringIndexerModel

    def scaled(self, values: Column) -> Column:
        """The array of all values clipped, centred and scaled; a null counts as 0 after clipping.

        Written out for every feature, it makes a method that the JVM finds too large to
        compile, and then runs far slower than this.
        """
        low, high, mean, scale = map(np.array, (self.low, self.high, self.mean, self.scale))

        @F.arrow_udf("array<double>")
        def scale_rows(rows: pa.Array) -> pa.Array:
            x = rows.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, len(low))
            inside = np.where(np.isnan(x), 0.0, np.minimum(np.maximum(x, low), high))
            out = ((inside - mean) / scale).ravel()
            ends = np.arange(0, out.size + 1, len(low), dtype="int32")
            return pa.ListArray.from_arrays(ends, out)

        return scale_rows(values)

    def transform(self, daily: DataFrame) -> DataFrame:
        """user, day, is_train, the descriptive measures and `features`."""
        weekend = F.col("is_weekend")
        weekend = C.finite(weekend) if "is_weekend" in self.names else weekend
        return self.departments.transform(daily).select(
            "user", "day", (weekend == 0).alias("is_train"), *META,
            self.scaled(values(self.names)).alias("features"))

    def save(self, spark: SparkSession, path: str) -> None:
        rows = list(zip(range(len(self.names)), self.names, self.low, self.high,
                        self.mean, self.scale))
        spark.createDataFrame(
            rows, "position int, feature string, low double, high double, "
                  "mean double, scale double"
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/scales")
        self.departments.write().overwrite().save(f"{path}/departments")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FeaturePrep":
        rows = spark.read.parquet(f"{path}/scales").orderBy("position").collect()
        cols = zip(*[(r.feature, r.low, r.high, r.mean, r.scale) for r in rows])
        return FeaturePrep(*map(tuple, cols), StringIndexerModel.load(f"{path}/departments"))


def encode(daily: DataFrame, departments: StringIndexerModel,
           names: tuple[str, ...] = NAMES) -> DataFrame:
    """Feature columns as finite doubles (null where not finite), department by index."""
    indexed = departments.transform(daily)
    others = [c for c in indexed.columns if c not in names]
    measured = [F.col(c).alias(f"_{c}") for c in META if c in names]  # as measured
    return indexed.select(*others, *measured, *[C.finite(F.col(n)).alias(n) for n in names])


def values(names: tuple[str, ...]) -> Column:
    """The same columns of an indexed table as one array; far cheaper than as columns."""
    return F.array(*[C.finite(F.col(n)) for n in names])


def index_departments(daily: DataFrame) -> StringIndexerModel:
    return StringIndexer(inputCol="department", outputCol="dept_encoded",
                         stringOrderType="alphabetAsc", handleInvalid="keep").fit(daily)


def training_rows(daily: DataFrame) -> DataFrame:
    return daily.filter("is_weekend = 0")


def fit_features(daily: DataFrame, p: Params = Params()) -> FeaturePrep:
    """Two aggregates: limits at mean +- k std, then mean and std after clipping.

    The standard deviation of the limits is the sample one, that of the scale
    the population one; a constant feature is neither clipped nor scaled, also where
    rounding leaves it a tiny deviation.
    """
    names = (*p.features, "dept_encoded")
    departments = index_departments(daily)
    rows = departments.transform(daily if p.fit_on == "all" else training_rows(daily))
    first = _moments(rows.select(*[C.finite(F.col(n)).alias(n) for n in names]),
                     F.array(*names), len(names))
    inf = float("inf")
    low = tuple(m - p.winsor_sigmas * s if s else -inf for m, s, _ in first)
    high = tuple(m + p.winsor_sigmas * s if s else inf for m, s, _ in first)
    clip = FeaturePrep(names, low, high, (0.0,) * len(names), (1.0,) * len(names), departments)
    second = _moments(rows, clip.scaled(values(names)), len(names))
    return FeaturePrep(names, low, high, tuple(m or 0.0 for m, _, _ in second),
                       tuple(s or 1.0 for _, _, s in second), departments)


def _moments(df: DataFrame, x: Column, width: int) -> list[tuple]:
    """(mean, sample std, population std) per position of an array, nulls left out.

    A row per position: as one row, the aggregates have more columns than Spark generates
    code for.
    """
    rows = df.select(F.posexplode(x).alias("at", "v")).groupBy("at").agg(
        F.avg("v").alias("m"), F.stddev_samp("v").alias("s"), F.stddev_pop("v").alias("p")).collect()
    found = {at: (m, s, p) for at, m, s, p in rows}
    found = [found.get(i, (None, None, None)) for i in range(width)]
    return [(m, s, p) if m is None or (p or 0.0) > 1e-12 * abs(m) else (m, 0.0, 0.0)
            for m, s, p in found]
