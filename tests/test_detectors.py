"""Feature preparation, both detectors, importance, evaluation."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from daywatch import schemas
from daywatch.operators import evaluate as E
from daywatch.operators.features import NAMES, FeaturePrep, fit_features
from daywatch.operators.iforest import (IsolationForestModel, draw_samples, fit_iforest,
                                        path_norm)
from daywatch.operators.recon import ReconModel, fit_recon
from daywatch.params import FEATURES, Params

N, ODD = 1200, 12
P = Params(trees=60, tree_rows=128)


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(N, 6))
    x[:, 5] = x[:, 4] * 2 + 0.01 * rng.normal(size=N)
    x[:ODD] += 9 * rng.choice([-1, 1], size=(ODD, 6))
    day = dt.date(2010, 1, 4)
    rows = [(f"u{i}", day + dt.timedelta(days=i % 28), [float(v) for v in r])
            for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "user string, day date, features array<double>").cache()


@pytest.fixture(scope="module")
def forest(vectors):
    return fit_iforest(vectors, P)


def odd(user):
    return int(user[1:]) < ODD


def test_path_norm():
    assert list(path_norm([0, 1, 2])) == [0, 0, 1]
    assert path_norm(256) == pytest.approx(10.2448, abs=1e-3)


def test_samples_are_full_and_without_replacement(vectors):
    drawn, size = draw_samples(vectors, ["user", "day"], P)
    rows = drawn.groupBy("tree_id").agg(F.count("nth").alias("n"),
                                        F.count_distinct("features").alias("d")).collect()
    assert size == 128 and len(rows) == P.trees
    assert all(r.n == r.d == 128 for r in rows)


def test_samples_are_even(vectors):
    """Every row has the same chance: the draws of 300 trees spread like a fair draw."""
    p = Params(trees=300, tree_rows=120)
    drawn, _ = draw_samples(vectors, ["user", "day"], p)
    uses = [r["count"] for r in drawn.groupBy("features").count().collect()]
    assert len(uses) == N                        # 30 uses expected, deviation sqrt(27)
    assert np.std(uses) == pytest.approx(np.sqrt(300 * 0.1 * 0.9), rel=0.2)


def test_a_small_pool_still_fills_every_tree(vectors):
    p = Params(trees=4, tree_rows=50, pool_rows=300)
    drawn, size = draw_samples(vectors, ["user", "day"], p)
    again, _ = draw_samples(vectors.repartition(9), ["user", "day"], p)
    rows = sorted((r.tree_id, r.nth, r.features) for r in drawn.collect())
    assert rows == sorted((r.tree_id, r.nth, r.features) for r in again.collect())
    assert len(rows) == 4 * 50 and len({(t, tuple(f)) for t, _, f in rows}) == 4 * 50
    short, _ = draw_samples(vectors, ["user", "day"], p, margin=0.2)
    assert short.count() < 4 * 50                # what fit_iforest answers with a wider margin


def test_draw_neither_sorts_nor_writes_the_training_rows(vectors):
    text = draw_samples(vectors, ["user", "day"], P)[0]._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in text and "WindowGroupLimit" in text
    assert text.index("Filter") > 0 and "ranges" not in text


def test_forest_scores(spark, vectors, forest):
    raw = vectors.select("user", forest.raw_score(spark, F.col("features")).alias("raw"))
    rows = raw.select("user", "raw", forest.score(F.col("raw")).alias("s"),
                      forest.label(F.col("raw")).alias("l")).collect()
    scores = [r.s for r in rows]
    assert min(scores) == pytest.approx(0, abs=1e-6) and max(scores) == pytest.approx(100)
    worst = sorted(rows, key=lambda r: -r.s)[:ODD]
    assert all(odd(r.user) for r in worst)
    assert sum(r.l == -1 for r in rows) == pytest.approx(0.05 * N, abs=2)
    assert {r.l for r in rows} == {-1, 1}
    assert np.mean([s > 70 for s in scores]) < 0.25


def test_forest_does_not_depend_on_partitioning(spark, vectors, forest, tmp_path):
    again = fit_iforest(vectors.repartition(7), P)
    cols = ["tree_id", "node_id"]
    a, b = (m.nodes.sort_values(cols).reset_index(drop=True) for m in (forest, again))
    assert a.equals(b)
    forest.save(spark, str(tmp_path))
    back = IsolationForestModel.load(spark, str(tmp_path))
    assert back.offset == forest.offset
    x = np.zeros((3, 6))
    assert list(back.forest().raw(x)) == list(forest.forest().raw(x))


def test_forest_score_matches_a_walk(forest):
    nodes = {(r.tree_id, r.node_id): r for r in forest.nodes.itertuples()}
    x = np.random.default_rng(5).normal(size=(4, 6)) * 3
    for row, raw in zip(x, forest.forest().raw(x)):
        lengths = []
        for t in range(P.trees):
            n = nodes[(t, 0)]
            while n.feature >= 0:
                n = nodes[(t, n.left if row[n.feature] <= n.threshold else n.right)]
            lengths.append(n.depth + float(path_norm(n.size)))
        assert raw == pytest.approx(-2 ** (-np.mean(lengths) / float(path_norm(128))))


def test_recon(spark, vectors, tmp_path):
    model = fit_recon(vectors, P)
    x = np.array([r.features for r in vectors.orderBy("user").collect()])
    got = np.array([r.recon_error for r in model.with_error(vectors).orderBy("user").collect()])
    mean = x.mean(axis=0)
    _, _, axes = np.linalg.svd(x - mean, full_matrices=False)
    kept = axes[:3]
    back = (x - mean) @ kept.T @ kept + mean
    want = ((x - back) ** 2).mean(axis=1)
    assert got == pytest.approx(want, abs=1e-9)
    assert model.kept == 3 and model.threshold == pytest.approx(np.percentile(want, 95))
    assert model.score_max == pytest.approx(np.percentile(want, 99.9))
    out = model.with_error(vectors).select(model.score(F.col("recon_error")).alias("s"),
                                           model.label(F.col("recon_error")).alias("l")).collect()
    assert all(0 <= r.s <= 100 for r in out)
    assert np.mean([r.s < 50 for r in out]) > 0.7
    assert sum(r.l for r in out) == sum(want > np.percentile(want, 95))
    model.save(spark, str(tmp_path))
    again = ReconModel.load(spark, str(tmp_path)).with_error(vectors).orderBy("user").collect()
    assert [r.recon_error for r in again] == pytest.approx(list(got))


def test_permutation_importance(vectors, forest):
    names = tuple(f"f{i}" for i in range(6))
    got = E.permutation_importance(vectors, forest, names, P)
    rows = {r.feature: r.importance for r in got.collect()}
    assert set(rows) == set(names) and all(v > 0 for v in rows.values())
    assert E.top_importances(got, 2).count() == 2
    flat = vectors.withColumn("features", F.transform("features", lambda x, i: F.when(
        i == 2, F.lit(1.0)).otherwise(x)))
    zero = {r.feature: r.importance for r in
            E.permutation_importance(flat, forest, names, P).collect()}
    assert zero["f2"] == 0
    again = {r.feature: r.importance for r in
             E.permutation_importance(vectors.repartition(7), forest, names, P).collect()}
    assert again == pytest.approx(rows)      # partitions decide nothing
    small = {r.feature: r.importance for r in
             E.permutation_importance(vectors, forest, names, P, rows_per_task=50).collect()}
    assert small == pytest.approx(rows)      # nor does the size of a task


def test_permutation_importance_equals_shifted_columns(vectors, forest):
    """Against plain numpy: each column shifted as a whole, the others left alone."""
    from daywatch.operators.ranking import indexed
    names = tuple(f"f{i}" for i in range(6))
    rows = indexed(vectors.select("user", "day", "features"), ["user", "day"], P.seed)
    x = np.array([r.features for r in rows.orderBy("_idx").collect()])
    shift = int(np.random.default_rng(P.seed).integers(1, len(x)))
    low, span = forest.score_min, forest.score_max - forest.score_min + 1e-10

    def score(m):
        return np.clip((1 - (forest.forest().raw(m) - low) / span) * 100, 0, 100)

    want = {}
    for i, name in enumerate(names):
        mixed = x.copy()
        mixed[:, i] = np.roll(x[:, i], -shift)
        assert sorted(mixed[:, i]) == sorted(x[:, i])
        want[name] = np.abs(score(mixed) - score(x)).mean()
    got = {r.feature: r.importance for r in E.permutation_importance(vectors, forest, names, P).collect()}
    assert got == pytest.approx(want)


def test_replaced_columns_are_scored_as_whole_rows(forest):
    """Against scoring every changed row from its roots, over blocks, ties and far values."""
    f, rng = forest.forest(), np.random.default_rng(3)
    x = np.round(rng.normal(size=(700, 6)) * 2, 1)
    other = np.where(rng.random(x.shape) < 0.3, x, x[rng.permutation(700)])
    other[5], other[6] = np.inf, -1e300
    base, changed = f.raw_replaced(x, other)
    assert base == pytest.approx(f.raw(x), abs=1e-14)
    for i in range(6):
        mixed = x.copy()
        mixed[:, i] = other[:, i]
        assert changed[:, i] == pytest.approx(f.raw(mixed), abs=1e-12)
    assert f.raw_replaced(x[:0], other[:0])[1].shape == (0, 6)


def test_importance_meets_rows_in_one_join_without_a_third_shuffle(vectors, forest, monkeypatch):
    plans, collect = [], type(vectors).collect

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return collect(df)

    monkeypatch.setattr(type(vectors), "collect", kept)
    E.permutation_importance(vectors, forest, tuple(f"f{i}" for i in range(6)), P, rows_per_task=50)
    text = next(x for x in plans if "MapInPandas" in x)
    assert "Broadcast" not in text and text.count("SortMergeJoin") == 1
    assert text.count("REPARTITION_BY_NUM") == 2 and text.count("Exchange") == 3   # and the sums


def test_empty_training_set_is_refused(vectors):
    for fit in (fit_iforest, fit_recon):
        with pytest.raises(ValueError, match="no training rows"):
            fit(vectors.filter("false"))


@pytest.fixture(scope="module")
def daily(spark):
    rng = np.random.default_rng(4)
    day = dt.date(2010, 1, 4)
    rows = []
    for i in range(140):
        d = day + dt.timedelta(days=i % 14)
        base = {f: float(rng.normal()) for f in FEATURES}
        base |= {"usb_count": 7.0, "is_weekend": float(d.weekday() >= 5)}
        if i == 0:
            base["files_accessed"] = 1000.0
        if i == 1:
            base["emails_sent"] = float("inf")
        rows.append((f"u{i // 14}", d, ["IT", "HR", "Unknown"][i % 3], *base.values()))
    return spark.createDataFrame(
        rows, "user string, day date, department string, "
        + ", ".join(f"{f} double" for f in FEATURES)).cache()


def test_features_follow_the_rules(spark, daily, tmp_path):
    prep = fit_features(daily)
    out = prep.transform(daily).orderBy("user", "day").collect()
    raw = daily.orderBy("user", "day").toPandas()
    raw["dept_encoded"] = raw["department"].map({"HR": 0.0, "IT": 1.0, "Unknown": 2.0})
    x = raw[list(NAMES)].replace([np.inf, -np.inf], np.nan)
    for c in x:
        s, m = x[c].std(), x[c].mean()
        if s > 0:
            x[c] = x[c].clip(m - 5 * s, m + 5 * s)
    x = x.fillna(0)
    s = x.std(ddof=0).replace(0, 1)
    want = ((x - x.mean()) / s).to_numpy()
    assert np.array([r.features for r in out]) == pytest.approx(want, abs=1e-9)
    assert sum(r.is_train for r in out) == 100
    assert max(r.files_accessed for r in out) == 1000.0       # described as measured
    prep.save(spark, str(tmp_path))
    again = FeaturePrep.load(spark, str(tmp_path)).transform(daily)
    assert [r.features for r in again.orderBy("user", "day").collect()] == \
        [r.features for r in out]


def test_features_fit_on_train(daily):
    a, b = fit_features(daily), fit_features(daily, Params(fit_on="train"))
    assert a.mean != b.mean


def test_feature_list_is_a_parameter(daily):
    prep = fit_features(daily, Params(features=("login_count", "usb_count")))
    row = prep.transform(daily).first()
    assert prep.names == ("login_count", "usb_count", "dept_encoded")
    assert len(row.features) == 3 and row.is_train in (True, False)


def test_unseen_department_is_kept(daily):
    prep = fit_features(daily)
    new = daily.limit(1).withColumn("department", F.lit("New"))
    assert len(prep.transform(new).first().features) == len(NAMES)


def test_a_feature_is_a_row_of_the_fit_and_a_position_of_the_scaling(daily, monkeypatch):
    wide, kind = [], type(daily)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: wide.append(len(df.columns)) or collect(df))
    prep = fit_features(daily)
    assert wide and max(wide) < 10        # beyond a hundred, Spark generates no code
    text = prep.transform(daily)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in text and "greatest" not in text


def test_features_of_nulls_and_of_no_rows(daily):
    holes = daily.withColumn("login_count", F.lit(None).cast("double"))
    prep = fit_features(holes)
    at = NAMES.index("login_count")
    assert (prep.mean[at], prep.scale[at]) == (0.0, 1.0)
    assert {r.features[at] for r in prep.transform(holes).collect()} == {0.0}
    none = fit_features(daily.filter("is_weekend = 1"), Params(fit_on="train"))
    assert set(none.mean) == {0.0} and set(none.scale) == {1.0}
    assert prep.transform(daily.filter("false")).count() == 0


# ---- evaluation --------------------------------------------------------------

def labelled(spark, rows):
    return spark.createDataFrame(rows, "user string, score double, is_insider boolean")


def brute_auc(rows):
    pos = [s for _, s, y in rows if y]
    neg = [s for _, s, y in rows if not y]
    return np.mean([1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg])


def truth_of(spark, insiders, normals=()):
    return spark.createDataFrame(
        [(u, "x", None, i, "") for us, i in ((insiders, True), (normals, False)) for u in us],
        schemas.GROUND_TRUTH)


def test_ranking_quality(spark):
    rng = np.random.default_rng(6)
    rows = [(f"u{i:03}", float(np.round(rng.random() * (1.5 if i < 12 else 1), 1 + i % 3)), i < 12)
            for i in range(90)]
    df = labelled(spark, rows)
    assert E.roc_auc(df).first().auc_roc == pytest.approx(brute_auc(rows))
    points = sorted((r.fpr, r.tpr) for r in E.roc_points(df).collect())
    area = np.trapezoid([0] + [t for _, t in points], [0] + [f for f, _ in points])
    assert area == pytest.approx(brute_auc(rows))
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    # eighteen insiders are known, twelve of them have a score
    truth = truth_of(spark, [f"u{i:03}" for i in range(12)] + [f"x{i}" for i in range(6)])
    at = {r.k: r for r in E.precision_at_k(df, truth).collect()}
    hits = np.cumsum([r[2] for r in order])
    for k, h in enumerate(hits, 1):
        assert (at[k].hits, at[k].precision, at[k].recall) == (h, h / k, h / 18)
    top = E.top_k_precision(df).first()
    assert (top.k, top.hits) == (12, hits[11])
    assert {r.k for r in E.detection_report(df, truth).collect()} == {5, 10, 15, 18, 20}


def test_evaluation_without_insiders(spark):
    df = labelled(spark, [("a", 1.0, False), ("b", 2.0, False)])
    assert E.roc_points(df).count() == 0 and E.top_k_precision(df).count() == 0
    assert E.roc_auc(df).first().auc_roc is None


def test_histogram(spark):
    rows = spark.createDataFrame([("m", float(v)) for v in [0, 1, 2, 3, 4, 4]] + [("c", 5.0)] * 2,
                                 "measure string, value double")
    got = E.density_histogram(rows, ["measure"], F.lit(4)).collect()
    counts = {r.bin: r["count"] for r in got if r.measure == "m"}
    want, edges = np.histogram([0, 1, 2, 3, 4, 4], bins=4)
    assert [counts[i] for i in range(4)] == list(want)
    assert {r.bin: r.edge for r in got if r.measure == "m"}[1] == edges[1]
    assert [(r.bin, r["count"], r.density) for r in got if r.measure == "c"] == [(2, 2, 4.0)]


def test_histogram_never_broadcasts_its_rows(spark, tmp_path):
    """Millions of equal values fit into a file below the broadcast limit."""
    spark.range(200_000).select(F.lit("m").alias("measure"), (F.col("id") % 3).cast("double").alias("value")) \
        .coalesce(1).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    got = E.density_histogram(rows, ["measure"], F.lit(3))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BuildRight" in plan and "BuildLeft" not in plan and "SortMergeJoin" not in plan
    assert {r.bin: r["count"] for r in got.collect()} == {0: 66_667, 1: 66_667, 2: 66_666}


def test_detector_report_equals_brute_force(spark):
    """AUC by all pairs, precision among the K best by sorting, for three score columns."""
    rng = np.random.default_rng(8)
    day = dt.date(2010, 1, 4)
    users = [f"u{i}" for i in range(60)]
    bad = set(users[:9])
    rows = [(u, day + dt.timedelta(days=d), *[float(rng.integers(0, 12) * 7 + 9 * (u in bad))
                                             for _ in range(3)]) for u in users for d in range(5)]
    scored = spark.createDataFrame(rows, "user string, day date, if_score double, ae_score double, "
                                         "risk_score double")
    truth = spark.createDataFrame([(u, "t" if u in bad else "none", day, u in bad, "x") for u in users],
                                  schemas.GROUND_TRUTH)
    got = {r.detector: r for r in E.detector_report(scored, truth).collect()}
    for at, name in enumerate(("if_score", "ae_score", "risk_score")):
        best = {u: r.score for u, r in ((r.user, r) for r in E.user_scores(scored, name).collect())}
        wins = [(best[a] > best[b]) + (best[a] == best[b]) / 2 for a in bad for b in users if b not in bad]
        top = sorted(users, key=lambda u: (-best[u], u))[:9]
        assert got[name].auc_roc == pytest.approx(np.mean(wins))
        assert got[name].precision_top_k == pytest.approx(np.mean([u in bad for u in top]))
        assert (got[name].insiders, got[name].normals) == (9, 51)
