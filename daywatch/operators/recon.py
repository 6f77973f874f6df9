"""Reconstruction-error detector: distance of a row from its principal subspace."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from daywatch.functions import columns as C
from daywatch.operators.ranking import exact_quantiles
from daywatch.params import Params
from daywatch.session import materialise


@dataclass(frozen=True)
class ReconModel:
    stages: PipelineModel     # centring on the training mean, then a full rotation
    kept: int                 # leading components that count as explained
    threshold: float          # 95 % quantile of the training errors
    score_min: float
    score_max: float          # 99.9 % quantile

    def with_error(self, df: DataFrame) -> DataFrame:
        """Adds `recon_error`, the mean squared difference from the reconstruction.

        Dropping components of an orthogonal rotation loses exactly their
        squares, so no back-projection and no Python is needed.
        """
        rotated = self.stages.transform(df.withColumn("_x", array_to_vector("features")))
        z = vector_to_array("_z")
        lost = F.aggregate(F.slice(z, F.lit(self.kept + 1), F.size(z)),
                           F.lit(0.0), lambda s, v: s + v * v)
        return rotated.withColumn("recon_error", lost / F.size(z)).drop("_x", "_centred", "_z")

    def score(self, error: Column) -> Column:
        span = self.score_max - self.score_min + 1e-10
        return C.clip((error - F.lit(self.score_min)) / F.lit(span) * 100.0, 0.0, 100.0)

    def label(self, error: Column) -> Column:
        """1 for an anomaly, else 0."""
        return (error > F.lit(self.threshold)).cast("int")

    def save(self, spark: SparkSession, path: str) -> None:
        self.stages.write().overwrite().save(f"{path}/stages")
        spark.createDataFrame(
            [(self.kept, self.threshold, self.score_min, self.score_max)],
            "kept int, threshold double, score_min double, score_max double"
        ).coalesce(1).write.mode("overwrite").parquet(f"{path}/calibration")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ReconModel":
        c = spark.read.parquet(f"{path}/calibration").first()
        return ReconModel(PipelineModel.load(f"{path}/stages"), c.kept, c.threshold,
                          c.score_min, c.score_max)


def fit_recon(train: DataFrame, p: Params = Params()) -> ReconModel:
    first = train.select("features").first()
    if first is None:
        raise ValueError("no training rows")
    width = len(first[0])
    vectors = train.select("features", array_to_vector("features").alias("_x"))
    stages = Pipeline(stages=[
        StandardScaler(inputCol="_x", outputCol="_centred", withMean=True, withStd=False),
        PCA(k=width, inputCol="_centred", outputCol="_z"),
    ]).fit(vectors)
    kept = min(p.recon_components, width // 2)
    draft = ReconModel(stages, kept, 0.0, 0.0, 0.0)
    errors = materialise(draft.with_error(train.select("features")).select("recon_error"), "errors")
    low = errors.agg(F.min("recon_error")).first()[0]
    cut = exact_quantiles(errors, ["recon_error"], [0.95, 0.999])
    return ReconModel(stages, kept, cut[("recon_error", 0.95)], low,
                      cut[("recon_error", 0.999)])
