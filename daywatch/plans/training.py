"""The whole run: raw logs to published risk tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from daywatch.operators.alerts import generate_alerts
from daywatch.operators.baseline import last_rows, with_deviations
from daywatch.operators.clean import (clean_device, clean_email, clean_file, clean_logon,
                                      read_counts, with_reasons)
from daywatch.operators.daily import daily_behaviour
from daywatch.operators.evaluate import detector_report
from daywatch.operators.features import META, FeaturePrep, fit_features
from daywatch.operators.iforest import IsolationForestModel, fit_iforest
from daywatch.operators.recon import ReconModel, fit_recon
from daywatch.operators.scoring import score_days, user_risk
from daywatch.params import Params
from daywatch.sources import tables as T
from daywatch.sources.logs import missing_sources, read_corpus

CLEANERS = {"logon": clean_logon, "file": clean_file, "device": clean_device,
            "email": clean_email}


@dataclass(frozen=True)
class Detectors:
    prep: FeaturePrep
    forest: IsolationForestModel
    recon: ReconModel

    def raw_scores(self, features: DataFrame) -> DataFrame:
        """Adds if_raw and ae_raw (0-100, not rounded), if_label and recon_label."""
        raw = self.recon.with_error(features.withColumn(
            "iforest_raw", self.forest.raw_score(features.sparkSession, F.col("features"))))
        return raw.withColumns({
            "if_raw": self.forest.score(F.col("iforest_raw")),
            "ae_raw": self.recon.score(F.col("recon_error")),
            "if_label": self.forest.label(F.col("iforest_raw")),
            "recon_label": self.recon.label(F.col("recon_error"))})

    def score(self, features: DataFrame, p: Params = Params()) -> DataFrame:
        return score_days(self.raw_scores(features).select(
            "user", "day", *META, "if_raw", "ae_raw"), p=p)

    def save(self, spark: SparkSession, path: str) -> None:
        self.prep.save(spark, f"{path}/features")
        self.forest.save(spark, f"{path}/iforest")
        self.recon.save(spark, f"{path}/recon")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Detectors":
        return Detectors(FeaturePrep.load(spark, f"{path}/features"),
                         IsolationForestModel.load(spark, f"{path}/iforest"),
                         ReconModel.load(spark, f"{path}/recon"))


def fit_detectors(features: DataFrame, prep: FeaturePrep, p: Params = Params()) -> Detectors:
    train = features.filter("is_train")
    return Detectors(prep, fit_iforest(train, p), fit_recon(train, p))


def run_training(spark: SparkSession, logs: dict[str, DataFrame], root: str,
                 p: Params = Params(), spine: str = "logon") -> DataFrame:
    """Clean, aggregate, fit, score, alert, publish; returns the one-row summary.

    Each step reads the table the step before has written, so a lost executor
    costs one step and nothing is computed twice.  Rows that cannot be used lie beside the
    cleaned log (`tables.read_rejects`); `baseline_state` lets later days continue from here.  The summary says for each log how
    many rows were read and how many had no usable date or no user; with a ground
    truth among the logs, the run also writes `evaluation`, a row per detector.
    """
    run_id = uuid.uuid4().hex
    out = f"{root}/{run_id}"

    # counted while the logs are cleaned and written, without a further read
    read = {name: Observation(f"{name}-{run_id}") for name in CLEANERS}
    clean = {name: T.write_judged(cleaner(with_reasons(
        logs[name].observe(read[name], *read_counts(logs[name], p)), p), p), f"{out}/{name}_log")[0]
        for name, cleaner in CLEANERS.items()}
    dropped = {name: r.get for name, r in read.items()}
    directory = T.write_table(logs["directory"], f"{out}/directory")

    daily = daily_behaviour(clean["logon"], clean["file"], clean["device"], clean["email"],
                            directory, p, spine)
    daily = T.write_by_day(with_deviations(daily, p), f"{out}/daily_behaviour")
    if daily.isEmpty():
        raise ValueError("no activity to aggregate")
    T.write_table(last_rows(daily, p), f"{out}/baseline_state")

    prep = fit_features(daily, p)
    features = T.write_by_day(prep.transform(daily), f"{out}/features")

    models = fit_detectors(features, prep, p)
    models.save(spark, f"{out}/models")
    scored = T.write_by_day(models.score(features, p), f"{out}/scored")

    newest = scored.agg(F.max("day")).first()[0]
    risk = T.write_table(user_risk(scored, p, as_of=newest), f"{out}/user_risk")
    alerts = T.write_table(generate_alerts(scored, risk, p), f"{out}/alerts")

    truth = logs.get("ground_truth")
    if truth is not None and not truth.isEmpty():
        T.write_table(detector_report(scored, truth), f"{out}/evaluation")

    T.write_json(T.run_summary(risk, alerts).withColumn("read", F.struct(*[
        F.struct(*[F.lit(v).alias(k) for k, v in counts.items()]).alias(name)
        for name, counts in dropped.items()])), f"{out}/summary")
    T.publish(spark, root, run_id)
    return spark.read.json(f"{out}/summary")


def train_from_files(spark: SparkSession, raw_dir: str, root: str,
                     p: Params = Params()) -> DataFrame:
    """`run_training` on a folder of CSV logs; all required logs must be there."""
    missing = missing_sources(spark, raw_dir)
    if missing:
        raise FileNotFoundError(f"missing or empty: {', '.join(missing)}")
    return run_training(spark, read_corpus(spark, raw_dir), root, p)
