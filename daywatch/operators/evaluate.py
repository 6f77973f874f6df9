"""Detection quality against labels, distributions and permutation importance."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, functions as F

from daywatch.operators.iforest import IsolationForestModel
from daywatch.operators.ranking import exact_quantiles, indexed, running_totals
from daywatch.params import Params
from daywatch.session import materialise


# ---- labels ------------------------------------------------------------------

def complete_labels(threats: DataFrame, users: DataFrame) -> DataFrame:
    """Ground truth for everybody: the threats plus the remaining users as normal."""
    rest = users.select("user_id").distinct().join(threats, "user_id", "left_anti")
    return threats.unionByName(rest.select(
        "user_id", F.lit("none").alias("threat_type"),
        F.lit(None).cast("date").alias("trigger_date"), F.lit(False).alias("is_insider"),
        F.lit("Normal behavior").alias("description")))


def user_scores(scored: DataFrame, score: str = "risk_score") -> DataFrame:
    # rounding drops the noise of summation order: equal means are equal scores
    return scored.groupBy("user").agg(F.round(F.avg(score), 9).alias("score"))


def label_scores(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Rows of the users with a label, with is_insider."""
    labels = truth.select(F.col("user_id").alias("user"), "is_insider").distinct()
    return scores.join(labels, "user")


def label_days(daily: DataFrame, truth: DataFrame) -> DataFrame:
    """Every day row with is_insider (false without a label) and threat_type."""
    labels = truth.groupBy(F.col("user_id").alias("user")).agg(
        F.max(F.struct("is_insider", "threat_type")).alias("l")).select("user", "l.*")
    return daily.join(labels, "user", "left").fillna(False, subset=["is_insider"])


def members(rows: DataFrame, truth: DataFrame, insiders: bool) -> DataFrame:
    """Rows of the known insiders, or of the known normal users."""
    chosen = truth.filter(F.col("is_insider") == insiders)
    return rows.join(chosen.select(F.col("user_id").alias("user")), "user", "left_semi")


# ---- ranking quality ---------------------------------------------------------

def _by_score(labelled: DataFrame) -> DataFrame:
    """Equal scores collapse first, so no score value can form a hot group."""
    return labelled.groupBy("score").agg(
        F.count_if("is_insider").alias("pos"), F.count_if(~F.col("is_insider")).alias("neg")
    ).withColumn("_down", -F.col("score"))


def _class_sizes(labelled: DataFrame) -> dict[str, Column]:
    return {"_P": labelled.agg(F.count_if("is_insider").alias("n")).scalar(),
            "_N": labelled.agg(F.count_if(~F.col("is_insider")).alias("n")).scalar()}


def roc_points(labelled: DataFrame) -> DataFrame:
    """(score, fpr, tpr) per distinct score as the threshold; empty without insiders."""
    run = running_totals(_by_score(labelled), ["_down"], {"tp": "pos", "fp": "neg"})
    return (run.withColumns(_class_sizes(labelled)).filter("_P > 0").select(
        "score", (F.try_divide(F.col("fp"), F.col("_N"))).alias("fpr"),
        (F.col("tp") / F.col("_P")).alias("tpr")))


def roc_auc(labelled: DataFrame) -> DataFrame:
    """One row, area under the ROC curve; null unless both classes occur."""
    run = running_totals(_by_score(labelled), ["_down"], {"fp": "neg"})
    sizes = _class_sizes(labelled)
    # each insider beats the normals below it, and ties count one half
    wins = run.withColumns(sizes).agg(
        F.sum(F.col("pos") * (F.col("_N") - F.col("fp") + F.col("neg") / 2.0)).alias("wins"),
        F.max("_P").alias("P"), F.max("_N").alias("N"))
    return wins.select(F.try_divide(F.col("wins"), F.col("P") * F.col("N")).alias("auc_roc"),
                       F.col("P").alias("insiders"), F.col("N").alias("normals"))


def insider_total(truth: DataFrame) -> Column:
    """Insiders in the ground truth, with or without activity."""
    known = truth.filter("is_insider")
    return known.agg(F.count_distinct("user_id").alias("n")).scalar()


def precision_at_k(labelled: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision and recall among the k best scores, for every k (ties by user).

    Recall is over all insiders of the ground truth, also those without a score.
    """
    ranked = running_totals(
        labelled.withColumn("_down", -F.col("score")), ["_down", "user"],
        {"k": F.lit(1), "hits": F.col("is_insider").cast("bigint")})
    return (ranked.withColumn("_T", insider_total(truth)).filter("_T > 0").select(
        "k", "user", "score", "hits", (F.col("hits") / F.col("k")).alias("precision"),
        (F.col("hits") / F.col("_T")).alias("recall")))


def top_k_precision(labelled: DataFrame) -> DataFrame:
    """Precision among the K best scores, K = insiders with a score; empty without any."""
    ranked = running_totals(
        labelled.withColumn("_down", -F.col("score")), ["_down", "user"],
        {"k": F.lit(1), "hits": F.col("is_insider").cast("bigint")})
    at = ranked.withColumn("_K", _class_sizes(labelled)["_P"]).filter(F.col("k") == F.col("_K"))
    return at.select("k", "hits", (F.col("hits") / F.col("k")).alias("precision"))


def detection_report(labelled: DataFrame, truth: DataFrame,
                     ks: tuple[int, ...] = (5, 10, 15, 20)) -> DataFrame:
    """Precision and recall at the chosen k and at k = all insiders of the ground truth."""
    at = precision_at_k(labelled, truth).withColumn("_T", insider_total(truth))
    return at.filter(F.col("k").isin(*ks) | (F.col("k") == F.col("_T"))) \
        .select("k", "hits", "precision", "recall")


def detector_report(scored: DataFrame, truth: DataFrame,
                    scores: tuple[str, ...] = ("if_score", "ae_score", "risk_score")) -> DataFrame:
    """One row per detector: area under the ROC curve and precision among the K best."""
    rows = []
    for name in scores:
        labelled = materialise(label_scores(user_scores(scored, name), truth), "detector")
        best = top_k_precision(labelled).agg(F.max("precision").alias("v")).scalar()
        rows.append(roc_auc(labelled).select(
            F.lit(name).alias("detector"), "auc_roc", "insiders", "normals",
            best.alias("precision_top_k")))
    return reduce(DataFrame.unionByName, rows)


# ---- cohorts -----------------------------------------------------------------

def cohort_means(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("is_insider").agg(
        F.count(F.lit(1)).alias("users"), F.avg("score").alias("mean_score"))


def archetype_stats(truth: DataFrame, user_risk: DataFrame) -> DataFrame:
    insiders = truth.filter("is_insider").select(F.col("user_id").alias("user"), "threat_type")
    return (insiders.join(user_risk.select("user", "max_risk_score"), "user", "left")
            .groupBy("threat_type").agg(F.avg("max_risk_score").alias("mean"),
                                        F.max("max_risk_score").alias("max"),
                                        F.min("max_risk_score").alias("min")))


def insider_dossier(truth: DataFrame, user_risk: DataFrame, directory: DataFrame) -> DataFrame:
    risk = user_risk.select(F.col("user").alias("user_id"), "max_risk_score",
                            "avg_risk_score", "risk_tier", "trend")
    people = directory.select("user_id", "name", "department", "role") \
        .groupBy("user_id").agg(F.min(F.struct("name", "department", "role")).alias("d")) \
        .select("user_id", "d.*")
    return (truth.filter("is_insider").select("user_id", "threat_type", "trigger_date")
            .join(risk, "user_id", "left").join(people, "user_id", "left"))


def insider_series(scored: DataFrame, truth: DataFrame) -> DataFrame:
    """Daily scores of the insiders, flagged from their trigger date on."""
    marks = truth.filter("is_insider").select(
        F.col("user_id").alias("user"), "threat_type", "trigger_date")
    return scored.select("user", "day", "risk_score").join(marks, "user").withColumn(
        "after_trigger", F.coalesce(F.col("day") >= F.col("trigger_date"), F.lit(False)))


def _users(df: DataFrame, col: str) -> DataFrame:
    return df.select(F.col(col).alias("user")).distinct()


def detected_insiders(user_risk: DataFrame, truth: DataFrame) -> DataFrame:
    """Insiders among the top quartile by maximum score."""
    # max_risk_score has two decimals in [0, 100]: percentile sees at most 10 001 values
    cut = user_risk.agg(F.percentile("max_risk_score", 0.75).alias("q")).scalar()
    top = user_risk.filter(F.col("max_risk_score") >= cut)
    return _users(truth.filter("is_insider"), "user_id").intersect(_users(top, "user"))


def detection_rate(user_risk: DataFrame, truth: DataFrame) -> DataFrame:
    """The quality gates in one row."""
    insiders = _users(truth.filter("is_insider"), "user_id")
    maxed = members(user_risk, truth, False).filter("max_risk_score >= 99")
    found = detected_insiders(user_risk, truth)
    return user_risk.agg(
        F.count(F.lit(1)).alias("users"),
        F.avg((F.col("risk_tier") == "NORMAL").cast("int")).alias("normal_share"),
        F.stddev_samp("max_risk_score").alias("score_std")
    ).withColumns({
        "insiders": insiders.agg(F.count(F.lit(1)).alias("n")).scalar(),
        "detected": found.agg(F.count(F.lit(1)).alias("n")).scalar(),
        "maxed_normals": maxed.agg(F.count(F.lit(1)).alias("n")).scalar(),
    }).withColumn("detection_rate",
                  F.try_divide(F.col("detected"), F.col("insiders")))


# ---- distributions -----------------------------------------------------------

def score_quantiles(scored: DataFrame, score: str = "risk_score",
                    probs: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99, 0.999)) -> DataFrame:
    """Exact quantiles of a two-decimal 0-100 score.

    `percentile` keeps a count per distinct value, here at most 10 001.
    """
    q = F.percentile(score, F.array(*map(F.lit, probs)))
    pairs = scored.agg(q.alias("q")).select(
        F.explode(F.arrays_zip(F.array(*map(F.lit, probs)).alias("prob"), "q")).alias("z"))
    return pairs.select(F.col("z.prob").alias("prob"), F.col("z.q").alias("value"))


def score_range(scored: DataFrame, score: str = "risk_score") -> DataFrame:
    return scored.agg(F.min(score).alias("min"), F.avg(score).alias("mean"),
                      F.max(score).alias("max"))


def long_form(df: DataFrame, measures: list[str], keep: list[str]) -> DataFrame:
    """(keep..., measure, value) rows."""
    pairs = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"))
                      for m in measures])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.*")


def describe(df: DataFrame, measures: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max per measure (long form)."""
    kinds = (("n", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))
    row = df.agg(*[f(F.col(m).cast("double")).alias(f"{k}|{m}") for m in measures for k, f in kinds])
    q = exact_quantiles(df, measures, [0.25, 0.5, 0.75])
    one = F.array(*[F.struct(
        F.lit(m).alias("measure"), *[F.col(f"`{k}|{m}`").alias(k) for k, _ in kinds],
        *[F.lit(q[(m, p)]).cast("double").alias(f"p{int(p * 100)}") for p in (0.25, 0.5, 0.75)])
        for m in measures])
    return row.select(F.explode(one).alias("r")).select("r.*")


def correlation(df: DataFrame, measures: list[str]) -> DataFrame:
    """Pearson correlation of all pairs as (f1, f2, r); null where undefined.

    One distributed pass yields a measures x measures matrix.
    """
    x = df.select(array_to_vector(F.array(*[F.col(m).cast("double") for m in measures]))
                  .alias("v"))
    matrix = Correlation.corr(x, "v", "pearson").first()[0].toArray()
    rows = [(a, b, None if math.isnan(matrix[i, j]) else float(matrix[i, j]))
            for i, a in enumerate(measures) for j, b in enumerate(measures)]
    return df.sparkSession.createDataFrame(rows, "f1 string, f2 string, r double")


def feature_correlation(features: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Correlation matrix of a `features` array column."""
    return correlation(features.select(*[F.col("features")[i].alias(n)
                                         for i, n in enumerate(names)]), list(names))


def trim_outliers(df: DataFrame, measures: list[str]) -> DataFrame:
    """Long form without values above twice the normals' 99 % quantile."""
    normal = df.filter(~F.col("is_insider"))
    cut = exact_quantiles(normal, measures, [0.99])
    limits = F.create_map(*[x for m in measures
                            for x in (F.lit(m), F.lit(cut[(m, 0.99)]).cast("double"))])
    rows = long_form(df, measures, ["is_insider"])
    return rows.filter(F.col("value") <= limits[F.col("measure")] * 2.0)


def density_histogram(rows: DataFrame, groups: list[str], bins: Column,
                      weight: str | None = None) -> DataFrame:
    """Equal-width histogram of `value` per group: bin, left edge, count, density.

    A constant group gets the unit interval around its value.  With `weight` a
    row stands for that many equal rows (counted before any join).  `groups` are few
    (measures and cohorts): their spans are broadcast, never the rows, whose files may be
    small enough to pass for a small table.
    """
    rows = rows.dropna(subset=["value"]).withColumn(
        "_w", F.lit(1).cast("bigint") if weight is None else F.col(weight))
    span = rows.groupBy(*groups).agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("_w").alias("n"))
    flat = F.col("lo") == F.col("hi")
    span = span.select(*groups, "n",
                       F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
                       F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
                       bins.cast("int").alias("bins"))
    if groups:
        placed = rows.join(F.broadcast(span), groups)
    else:
        cell = span.agg(F.first(F.struct(*span.columns))).scalar()
        placed = rows.withColumn("_s", cell).select(*rows.columns, "_s.*")
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    spot = F.least(F.floor((F.col("value") - F.col("lo")) / width), F.col("bins") - 1)
    counts = placed.groupBy(*groups, "n", "lo", "hi", "bins", spot.cast("int").alias("bin")) \
        .agg(F.sum("_w").alias("count"))
    return counts.select(*groups, "bin", (F.col("lo") + F.col("bin") * width).alias("edge"),
                         "count", (F.col("count") / (F.col("n") * width)).alias("density"))


def login_hours(logon: DataFrame, truth: DataFrame, bins: int = 24) -> DataFrame:
    """Login-hour histogram of known insiders and known normals.

    Events are counted per user and hour first, so the join with the labels sees
    at most 24 rows per user.
    """
    per_hour = logon.groupBy("user", F.col("hour").cast("double").alias("value")) \
        .agg(F.count(F.lit(1)).alias("events"))
    known = label_scores(per_hour, truth)
    return density_histogram(known, ["is_insider"], F.lit(bins), "events")


def activity_histogram(rates: DataFrame, truth: DataFrame) -> DataFrame:
    """Histograms of device events and external mail rate per user, by cohort."""
    rows = long_form(label_scores(rates, truth), ["usb_events", "external_pct"], ["is_insider"])
    return density_histogram(rows, ["measure", "is_insider"],
                             F.when(F.col("is_insider"), 10).otherwise(20))


# ---- permutation importance --------------------------------------------------

def permutation_importance(features: DataFrame, model: IsolationForestModel,
                           names: tuple[str, ...], p: Params = Params(),
                           rows_per_task: int = 5000) -> DataFrame:
    """Mean absolute score change when one feature is shuffled, per feature.

    Every column is permuted as a whole.  Rows are numbered in a pseudorandom order, and
    row i takes the replaced value of each column from row i + s, modulo the rows.  Columns
    are replaced one at a time, so one drawn shift serves them all: a row meets one other
    row, in one join dealt into tasks of about `rows_per_task` rows, and all features are
    scored in one pass that walks a tree again only where the replaced value turns off.
    """
    spark, width = features.sparkSession, len(names)
    rows = materialise(indexed(features.select("user", "day", "features"), ["user", "day"], p.seed)
                       .select("_idx", "features"), "importance")
    n = rows.count()
    shift = int(np.random.default_rng(p.seed).integers(1, max(2, n)))
    tasks = n // rows_per_task + 1           # scoring costs far more than the rows weigh
    other = rows.select(F.pmod(F.col("_idx") - shift, F.lit(max(1, n))).alias("_to"),
                        F.col("features").alias("other")).repartition(tasks, "_to")
    # dealt once for the join and the scoring; small files must not pass for a small table
    both = rows.repartition(tasks, "_idx").hint("merge").join(
        other, F.col("_idx") == F.col("_to")).select("features", "other")
    shared = spark.sparkContext.broadcast(model.forest())
    low, span = model.score_min, model.score_max - model.score_min + 1e-10

    def change(batches):
        def score(raw):
            return np.clip((1 - (raw - low) / span) * 100, 0, 100)

        total, seen = np.zeros(width), 0
        for part in batches:
            if not len(part):
                continue
            base, changed = shared.value.raw_replaced(
                np.stack(part["features"].to_numpy()), np.stack(part["other"].to_numpy()))
            seen += len(part)
            total += np.abs(score(changed) - score(base)[:, None]).sum(axis=0)
        yield pd.DataFrame({"position": range(width), "total": total, "n": seen})

    parts = both.mapInPandas(change, "position int, total double, n bigint")
    label = F.create_map(*[x for i, name in enumerate(names) for x in (F.lit(i), F.lit(name))])
    found = parts.groupBy("position").agg(F.try_divide(F.sum("total"), F.sum("n")).alias("importance")) \
        .select(label[F.col("position")].alias("feature"), "importance").collect()
    shared.destroy()                         # one row per feature is kept
    return spark.createDataFrame(found, "feature string, importance double")


def top_importances(importance: DataFrame, n: int = 10) -> DataFrame:
    return importance.orderBy(F.col("importance").desc(), "feature").limit(n)
