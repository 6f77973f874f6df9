"""One named query per operator, over the driver's tables.

Every function takes (spark, sf_dir) and reads whole tables.  `shaped` turns
days and times into text, integers into bigint and rounds floats, so that
results compare across engines.
"""

from __future__ import annotations

from functools import cached_property, reduce
from typing import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from daywatch.operators import alerts as A
from daywatch.operators import daily as D
from daywatch.operators import evaluate as E
from daywatch.operators import quality as Q
from daywatch.operators import reports as R
from daywatch.operators.baseline import advance, last_rows, with_deviations
from daywatch.operators.clean import (clean_device, clean_email, clean_file, clean_logon,
                                      unparseable, with_reasons)
from daywatch.operators.features import NAMES, fit_features, training_rows
from daywatch.operators.iforest import fit_iforest
from daywatch.operators.moments import Guard, add_days, refit
from daywatch.operators.recon import fit_recon
from daywatch.operators.scoring import score_days, user_risk
from daywatch.operators.sessions import daily_sessions, sessions
from daywatch.params import ALERT_EXPORT, BEHAVIOUR_MAXIMA, COMPARED, FEATURES, USER_EXPORT
from daywatch.plans.training import CLEANERS, Detectors, fit_detectors, run_training
from daywatch.schemas import ALERTS
from daywatch.session import materialise, scratch_dir
from daywatch.sources import adapters, tables as T
from daywatch.sources.logs import FILES, read_corpus
from daywatch.sources.tables import read_table, run_summary, to_json_records
from daywatch.streaming import daily as S
from daywatch.streaming import sessions as SS
from daywatch.streaming.rollup import DailyRollup
from daywatch.streaming.scoring import DayScorer

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Minutes come from microseconds: three decimals leave no exact halves to round.
PLACES = {c: 3 for c in ("session_minutes", "session_duration_total",
                         "session_duration_total_deviation")}


def shaped(df: DataFrame, decimals: int = 6) -> DataFrame:
    def one(f):
        c, kind = F.col(f"`{f.name}`"), f.dataType.typeName()
        if kind == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "timestamp":
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind in ("integer", "short", "byte"):
            c = c.cast("bigint")
        elif kind == "double":
            c = F.round(c, PLACES.get(f.name, decimals) if decimals == 6 else decimals)
        return c.alias(f.name)

    return df.select(*[one(f) for f in df.schema.fields])


class Inputs:
    """The frames the queries start from, built on first use (all lazy)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return adapters.table(self.spark, self.sf_dir, name)

    @cached_property
    def events(self):
        return self.table("events")

    @cached_property
    def logon(self):
        return clean_logon(adapters.logon(self.events))

    @cached_property
    def file(self):
        return clean_file(adapters.file(self.events))

    @cached_property
    def device(self):
        return clean_device(adapters.device(self.events))

    @cached_property
    def email(self):
        return clean_email(adapters.email(self.events))

    @property
    def any_activity(self):
        return adapters.activity(self.events)

    @property
    def logs(self):
        return {"logon": self.logon, "file": self.file, "device": self.device,
                "email": self.email}

    @cached_property
    def directory(self):
        return adapters.directory(self.table("customer"), self.table("nation"))

    @cached_property
    def truth(self):
        return adapters.ground_truth(self.table("labels"))

    def daily(self, spine="logon"):
        return D.daily_behaviour(self.logon, self.file, self.device, self.email,
                                 self.directory, spine=spine)

    @cached_property
    def matrix(self):
        """Daily measures with deviations."""
        return with_deviations(self.daily())

    @cached_property
    def stored_matrix(self):
        """The matrix as a written table, for queries that fit on it in several passes."""
        return materialise(self.matrix, "matrix")

    @cached_property
    def scored(self):
        people = D.one_per_user(self.directory.select("user_id", "department"))
        days = adapters.component_scores(self.events).join(people, "user", "left")
        return score_days(days.fillna("Unknown", ["department"]), stamp=False)

    @cached_property
    def stored_scored(self):
        """The scored days as a written table, for queries that read it repeatedly."""
        return materialise(self.scored, "scored")

    @cached_property
    def risk(self):
        return user_risk(self.stored_scored)

    @cached_property
    def stored_risk(self):
        """The user risk as a written table, for queries that use it repeatedly."""
        return materialise(self.risk, "risk")

    @cached_property
    def alerts(self):
        return A.generate_alerts(self.stored_scored, self.stored_risk)

    @cached_property
    def status_events(self):
        return adapters.status_events(self.events)

    @cached_property
    def triaged(self):
        return A.with_current_status(self.alerts, self.status_events)

    @cached_property
    def users(self):
        return R.named_users(self.risk, self.directory)

    @cached_property
    def labelled(self):
        return E.label_scores(E.user_scores(self.scored), self.truth)

    @cached_property
    def stored_labelled(self):
        """The labelled scores as a written table: rank queries pass over them repeatedly."""
        return materialise(self.labelled, "labelled")

    @cached_property
    def prep(self):
        return fit_features(self.stored_matrix)

    @cached_property
    def features(self):
        """Scaled feature vectors, written once."""
        return materialise(self.prep.transform(self.stored_matrix), "features")

    @cached_property
    def detectors(self):
        return fit_detectors(self.features, self.prep)


def query(decimals: int = 6):
    def add(fn: Callable[[Inputs], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shaped(fn(Inputs(spark, sf_dir)), decimals)
        QUERIES[fn.__name__] = run
        return fn
    return add


# ---- cleaning and daily measures --------------------------------------------

@query()
def clean_logon_events(t):
    return t.logon


@query()
def clean_file_events(t):
    return t.file


@query()
def clean_device_events(t):
    return t.device


@query()
def clean_email_events(t):
    return t.email


def _csv_corpus(t, only=None):
    """The derived logs as CSV files: mail with line breaks, stamps in three styles, some unusable."""
    root, n = scratch_dir(t.spark, "csv"), F.substring("id", 2, 20).cast("bigint")
    stamp = (F.when(n % 50 == 0, "n/a").when(n % 3 == 0, F.date_format("date", "M/d/yyyy H:mm"))
             .when(n % 3 == 1, F.date_format("date", "M/d/yyyy H:mm:ss"))
             .otherwise(F.date_format("date", "yyyy-MM-dd HH:mm:ss")))
    for name in [only] if only else CLEANERS:
        raw = getattr(adapters, name)(t.events).withColumn("date", stamp)
        if name == "email":
            raw = raw.withColumn("content", F.concat("content", F.lit('\nsecond line, "quoted"')))
        T.write_csv(raw, f"{root}/{FILES[name]}")
    return read_corpus(t.spark, root)[only] if only else read_corpus(t.spark, root)


@query()
def csv_logs(t):
    """The CSV corpus read back and cleaned: no row with a usable stamp is lost."""
    corpus, parts = _csv_corpus(t), []
    for name, clean in CLEANERS.items():
        rows = clean(corpus[name])
        chars = F.length("content") if name == "email" else F.lit(None)
        parts.append(rows.select(F.lit(name).alias("log"), "id", "user", F.date_format(
            "date", "yyyy-MM-dd HH:mm:ss").alias("date"), chars.cast("bigint").alias("chars")))
    return reduce(DataFrame.unionByName, parts)


@query()
def csv_dropped(t):
    """Rows per CSV log, and how many have no usable date."""
    return reduce(DataFrame.unionByName, [
        unparseable(df).withColumn("log", F.lit(name)) for name, df in _csv_corpus(t).items()
        if name in CLEANERS])


@query()
def log_rejects(t):
    """Per CSV log: rows read, rows cleaned and rows set aside, by reason."""
    parts = []
    for name, clean in CLEANERS.items():
        raw = _csv_corpus(t, name)
        kept, rejects = T.write_judged(clean(with_reasons(raw)), scratch_dir(t.spark, f"judged-{name}"))
        parts += [kept.agg(F.count(F.lit(1)).alias("rows")).withColumn("outcome", F.lit("clean")),
                  rejects.groupBy(F.col("reason").alias("outcome")).agg(F.count(F.lit(1)).alias("rows"))]
        parts[-2:] = [x.select(F.lit(name).alias("log"), "outcome", "rows") for x in parts[-2:]]
    return reduce(DataFrame.union, parts)


@query()
def session_list(t):
    return sessions(t.logon)


@query()
def daily_logon(t):
    return D.daily_logon(t.logon)


@query()
def daily_session(t):
    return daily_sessions(t.logon)


@query()
def daily_file(t):
    return D.daily_file(t.file)


@query()
def daily_device(t):
    return D.daily_device(t.device)


@query()
def daily_email(t):
    return D.daily_email(t.email)


@query()
def daily_behavior(t):
    return t.daily()


@query()
def daily_behavior_any_spine(t):
    return t.daily("any")


@query()
def rolling_deviation(t):
    return t.matrix.select("user", "day", *[c for c in FEATURES if c.endswith("_deviation")])


@query()
def incremental_deviation(t):
    """The last five days, each from the state that the days before have left."""
    daily = materialise(t.daily(), "daily")
    t.matrix = with_deviations(daily)        # the batch run starts from the same table
    newest = daily.agg(F.max("day")).first()[0]
    start = F.date_sub(F.lit(newest), 5)
    state, out = materialise(last_rows(daily.filter(F.col("day") <= start)), "state"), []
    for back in range(4, -1, -1):
        new = daily.filter(F.col("day") == F.date_sub(F.lit(newest), back))
        found, state = advance(state, new)
        out.append(found.select("user", "day", *[c for c in FEATURES if c.endswith("_deviation")]))
        state = materialise(state, "state")
    return reduce(DataFrame.unionByName, out)


# ---- features and detectors --------------------------------------------------

@query(4)
def scaled_features(t):
    m = t.stored_matrix
    rows = fit_features(m).transform(m)
    return rows.select("user", "day", "is_train",
                       *[F.col("features")[i].alias(n) for i, n in enumerate(NAMES)])


def _refitted(t):
    """Sums of all days but the newest, kept on storage; then the newest day alone."""
    m = t.stored_matrix
    newest = m.agg(F.max("day")).first()[0]
    before = m.filter(F.col("day") < F.lit(newest))
    guard, path = Guard.within(fit_features(before)), scratch_dir(t.spark, "day-sums")
    add_days(before, guard, path)
    add_days(m.filter(F.col("day") == F.lit(newest)), guard, path)
    return refit(t.spark, path, guard)


@query()
def refit_scales(t):
    """Limits and scales after a new day, from sums per day."""
    f = _refitted(t).prep
    finite = lambda x: round(x, 6) if abs(x) < float("inf") else None
    rows = [(n, *map(finite, x)) for n, *x in zip(f.names, f.low, f.high, f.mean, f.scale)]
    return t.spark.createDataFrame(
        rows, "feature string, low double, high double, mean double, scale double")


@query()
def refit_correlation(t):
    """Correlations of the training rows' features after a new day, from the same sums."""
    r = _refitted(t).correlation()
    rows = [(a, b, None if r[i, j] != r[i, j] else round(float(r[i, j]), 4))
            for i, a in enumerate(NAMES) for j, b in enumerate(NAMES)]
    return t.spark.createDataFrame(rows, "f1 string, f2 string, r double")


@query()
def training_set(t):
    return training_rows(t.daily()).select("user", "day", "department", "login_count")


@query()
def iforest_scores(t):
    model = fit_iforest(t.features.filter("is_train"))
    raw = t.features.select("user", "day", model.raw_score(t.spark, F.col("features"))
                            .alias("raw"))
    return raw.select("user", "day", model.score(F.col("raw")).alias("if_score"),
                      model.label(F.col("raw")).alias("label"))


@query()
def recon_scores(t):
    model = fit_recon(t.features.filter("is_train"))
    return model.with_error(t.features).select(
        "user", "day", model.score(F.col("recon_error")).alias("ae_score"),
        model.label(F.col("recon_error")).alias("label"))


@query(3)
def recon_energy(t):
    """Squares kept and lost by the rotation: the squared distance from the training mean."""
    rotated = t.detectors.recon.stages.transform(
        t.features.withColumn("_x", array_to_vector("features")))
    energy = F.aggregate(vector_to_array("_z"), F.lit(0.0), lambda s, v: s + v * v)
    return rotated.select("user", "day", energy.alias("energy"))


@query()
def recon_calibration(t):
    """How many training rows lie above the two calibrating quantiles."""
    model = t.detectors.recon
    errors = model.with_error(t.features.filter("is_train"))
    return errors.agg(F.count(F.lit(1)).alias("training"),
                      F.count_if(F.col("recon_error") > model.threshold).alias("above_p95"),
                      F.count_if(F.col("recon_error") > model.score_max).alias("above_p999"))


@query()
def iforest_gates(t):
    """Every user-day has a forest score within bounds."""
    rows = t.detectors.raw_scores(t.features)
    return rows.select("user", "day", F.col("if_raw").between(0.0, 100.0).alias("in_range"), "is_train")


@query(4)
def iforest_ends(t):
    """The most ordinary and the oddest training row."""
    rows = t.detectors.raw_scores(t.features.filter("is_train"))
    return rows.agg(F.min("if_raw").alias("ordinary"), F.max("if_raw").alias("oddest"))


@query()
def detector_report(t):
    """Classes behind each detector's evaluation, on real detector scores."""
    scored = t.detectors.score(t.features)
    return E.detector_report(scored, t.truth).select("detector", "insiders", "normals")


@query()
def iforest_labels(t):
    """Training rows that the forest calls anomalies: those under the contamination quantile."""
    rows = t.detectors.raw_scores(t.features.filter("is_train"))
    return rows.agg(F.count(F.lit(1)).alias("training"),
                    F.count_if(F.col("if_label") == -1).alias("anomalies"))


@query()
def detector_reload(t):
    """Rows whose features, scores and labels are the same after saving and loading the models."""
    path = scratch_dir(t.spark, "models")
    t.detectors.save(t.spark, path)
    again = Detectors.load(t.spark, path)
    keys, figures = ["user", "day"], ["iforest_raw", "if_label", "recon_error", "recon_label"]
    before = t.detectors.raw_scores(t.features).select(*keys, F.col("features").alias("_f"), *figures)
    after = again.raw_scores(again.prep.transform(t.stored_matrix)).select(
        *keys, "features", *[F.col(c).alias(f"_{c}") for c in figures])
    both = before.join(after, keys)
    return both.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("_f") == F.col("features")).alias("features"),
        *[F.count_if(F.col(c) == F.col(f"_{c}")).alias(c) for c in figures])


@query()
def detector_quality(t):
    """Area under the ROC curve and precision among the K best, of real detector scores."""
    return E.detector_report(t.detectors.score(t.features), t.truth)


@query()
def permutation_importance(t):
    model = fit_iforest(t.features.filter("is_train"))
    return E.permutation_importance(t.features, model, NAMES)


@query(4)
def correlation(t):
    return E.feature_correlation(t.features, NAMES)


# ---- scoring -----------------------------------------------------------------

@query(2)
def ensemble_tiers(t):
    return t.scored


@query()
def user_risk_table(t):
    return t.risk


@query()
def user_trend(t):
    return t.risk.select("user", "trend")


@query(2)
def alerts_daily(t):
    return A.daily_alerts(t.scored).drop("_key")


@query()
def alerts_rising(t):
    return A.rising_alerts(t.risk).drop("_key")


@query()
def alerts_all(t):
    return t.alerts


@query()
def alert_status_current(t):
    return t.triaged.select("alert_id", "user_id", "alert_type", "status")


@query()
def snapshot_alerts(t):
    """Updates made in an earlier run reach the readers of the current one."""
    root = scratch_dir(t.spark, "snapshot")
    every = A.all_alerts(t.stored_scored, t.stored_risk)
    T.write_table(A.number_alerts(every), f"{root}/first/alerts")
    T.publish(t.spark, root, "first")
    T.append_status(t.status_events, T.status_path(root))
    newest = t.stored_scored.agg(F.max("day")).scalar()
    late = every.filter(F.to_date(F.substring("timestamp", 1, 10)) >= F.date_sub(newest, 10))
    T.write_table(A.number_alerts(late), f"{root}/second/alerts")     # numbered anew
    T.publish(t.spark, root, "second")
    return T.load_snapshot(t.spark, root, views=False)["alerts"].select(
        "user_id", "timestamp", "alert_type", "status")


@query()
def compacted_status(t):
    """Newest status per alert from a log that was compacted between and after its appends."""
    root, events = scratch_dir(t.spark, "triage"), t.status_events
    for part in range(3):
        T.append_status(events.filter(F.col("seq") % 3 == part), T.status_path(root))
        if part:
            T.compact_status_log(t.spark, root)
    valid = A.current_status(T.status_log(t.spark, root))
    return valid.select("user_id", "alert_day", "alert_type", F.col("_status").alias("status"))


@query()
def alert_status_rejects(t):
    return A.split_status_events(t.status_events, t.alerts)[1]


# ---- reports -----------------------------------------------------------------

@query()
def kpis(t):
    return R.kpis(t.stored_risk, t.triaged, t.stored_scored)


@query()
def week_over_week(t):
    return R.week_over_week(t.stored_scored)


@query()
def threat_level(t):
    return R.threat_level(R.kpis(t.stored_risk, t.triaged, t.stored_scored))


@query()
def alerts_page(t):
    return R.alert_page(t.alerts, page=2, limit=50)


@query()
def alerts_search(t):
    return R.filter_alerts(t.alerts, tier="critical", search="ma")


@query()
def watchlist(t):
    return R.watchlist(t.users, page=1, limit=100)


@query()
def watchlist_page2_by_trend(t):
    return R.watchlist(t.users, sort="trend", ascending=True, page=2, limit=20)


@query()
def page_total(t):
    page = R.alert_page(t.alerts, tier="critical", page=2, limit=5)
    return R.with_total(page, R.filter_alerts(t.alerts, tier="critical")).select("alert_id", "total")


@query()
def watchlist_search(t):
    return R.filter_users(t.users, tier="critical", search="bui")


@query()
def watchlist_summary(t):
    return R.watchlist_summary(t.users)


@query(2)
def dossier_daily(t):
    return R.dossier_days(t.stored_scored, t.risk)


@query()
def dossier_alerts_top20(t):
    return A.top_alerts_per_user(t.alerts, 20).select("user_id", "nth", "alert_id", "risk_score")


@query()
def dossier_overview(t):
    d = R.dossiers(t.stored_risk, t.stored_scored, t.alerts, t.directory)
    days = F.col("daily_scores")
    return d.select("user", F.col("directory.name").alias("name"), F.size(days).alias("days"),
                    days[0]["day"].alias("first_day"), days[0]["risk_score"].alias("first_score"),
                    F.coalesce(F.size("alerts"), F.lit(0)).alias("alerts"),
                    F.get("alerts", 0)["alert_id"].alias("top_alert"))


@query()
def behaviour_profile(t):
    measures = t.daily("any").select("user", "day", *BEHAVIOUR_MAXIMA)
    return R.behaviour_profile(t.scored.select("user", "day", "risk_score")
                               .join(measures, ["user", "day"], "left"))


@query()
def timeline(t):
    return R.timeline(t.stored_scored, 20)


@query()
def timeline_user(t):
    return R.user_timeline(t.stored_scored, days=7)


@query()
def timeline_summary(t):
    return R.timeline_summary(R.timeline(t.stored_scored, 30))


@query()
def incident_calendar(t):
    return R.incident_calendar(R.timeline(t.stored_scored, 365))


@query()
def population_daily(t):
    return R.population_daily(t.scored)


@query()
def heatmap(t):
    return R.heatmap(t.scored)


@query()
def heatmap_matrix(t):
    return R.heatmap_matrix(R.heatmap(t.scored))


@query()
def heatmap_top(t):
    return R.heatmap_top(R.heatmap(t.scored))


@query(2)
def departments(t):
    return R.departments(t.risk)


@query()
def departments_top(t):
    return R.top_departments(R.departments(t.risk)).select("department", "avg_risk")


@query()
def department_totals(t):
    return R.department_totals(R.departments(t.risk))


@query()
def tier_distribution(t):
    return R.tier_distribution(t.risk)


@query()
def alert_summary(t):
    return R.alert_summary(A.all_alerts(t.stored_scored, t.risk))


@query()
def user_events(t):
    return R.user_events(t.logs)


@query()
def export_alerts(t):
    return A.by_score(t.alerts).select(*ALERT_EXPORT)


@query()
def export_users(t):
    return t.users.select(*USER_EXPORT)


@query()
def alert_records(t):
    return to_json_records(A.daily_alerts(t.scored).select("user_id", "timestamp", "risk_tier"))


@query()
def run_report(t):
    s = run_summary(t.stored_risk, A.all_alerts(t.stored_scored, t.stored_risk))
    return s.select("total_users", "total_alerts", "critical_alerts", "high_alerts",
                    F.to_json("tier_distribution").alias("tier_distribution"))


# ---- evaluation --------------------------------------------------------------

@query()
def user_scores(t):
    return t.labelled


@query()
def complete_labels(t):
    return E.complete_labels(t.truth.filter("is_insider"), t.directory)


@query()
def roc_points(t):
    return E.roc_points(t.stored_labelled)


@query()
def roc_auc(t):
    return E.roc_auc(t.stored_labelled)


@query()
def precision_at_k(t):
    return E.precision_at_k(t.stored_labelled, t.truth)


@query()
def top_k_precision(t):
    return E.top_k_precision(t.stored_labelled)


@query()
def detection_report(t):
    return E.detection_report(t.stored_labelled, t.truth)


@query()
def user_means(t):
    """Mean score of every user, labelled or not."""
    return E.user_scores(t.scored)


@query()
def score_quantiles(t):
    return E.score_quantiles(t.scored)


@query()
def score_range(t):
    return E.score_range(t.scored)


@query(4)
def describe(t):
    return E.describe(t.stored_matrix, list(FEATURES))


@query()
def login_hours_histogram(t):
    return E.login_hours(t.logon, t.truth)


@query()
def activity_histogram(t):
    rates = materialise(Q.activity_rates(t.device, t.email), "rates")
    return E.activity_histogram(rates, t.truth)


@query()
def risk_histogram(t):
    return E.density_histogram(
        t.stored_risk.select(F.col("max_risk_score").alias("value")), [], F.lit(25))


@query()
def histogram(t):
    rows = E.trim_outliers(E.label_days(t.stored_matrix, t.truth), list(COMPARED))
    rows = materialise(rows.withColumn("value", F.round("value", 6)), "histogram")
    return E.density_histogram(rows, ["measure", "is_insider"],
                               F.when(F.col("is_insider"), 15).otherwise(30))


@query()
def archetype_stats(t):
    return E.archetype_stats(t.truth, t.risk)


@query()
def insider_dossier(t):
    return E.insider_dossier(t.truth, t.risk, t.directory)


@query()
def insider_series(t):
    return E.insider_series(t.scored, t.truth)


@query()
def cohort_means(t):
    return E.cohort_means(t.labelled)


@query()
def detected_insiders(t):
    return E.detected_insiders(t.stored_risk, t.truth)


@query()
def detection_rate(t):
    return E.detection_rate(t.stored_risk, t.truth)


# ---- quality -----------------------------------------------------------------

@query()
def dataset_profile(t):
    return Q.dataset_profile(t.logs, t.daily(), t.directory, t.truth)


@query()
def department_sizes(t):
    return Q.users_per_department(t.directory)


@query()
def activity_rates(t):
    return Q.activity_rates(t.device, t.email)


@query()
def quality_report(t):
    return Q.quality_report(t.logon, t.email, t.matrix, t.stored_scored, t.stored_risk,
                            A.all_alerts(t.stored_scored, t.stored_risk), t.truth)


# ---- whole run and streams ---------------------------------------------------

@query()
def full_run(t):
    e = t.events
    logs = {"logon": adapters.logon(e), "file": adapters.file(e), "device": adapters.device(e),
            "email": adapters.email(e), "directory": t.directory}
    return run_training(t.spark, logs, scratch_dir(t.spark, "run")) \
        .select("total_users", "total_alerts", "critical_alerts", "high_alerts")


@query()
def full_run_tables(t):
    """Rows of the tables that a whole run publishes."""
    e, root = t.events, scratch_dir(t.spark, "run")
    logs = {"logon": adapters.logon(e), "file": adapters.file(e), "device": adapters.device(e),
            "email": adapters.email(e), "directory": t.directory}
    run_training(t.spark, logs, root)
    out = f"{root}/{T.current_run(t.spark, root)}"
    tables = {n: t.spark.read.parquet(f"{out}/{n}")
              for n in ("daily_behaviour", "features", "scored", "user_risk")}
    tables["training"] = tables["features"].filter("is_train")
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit(n))
        for n, df in tables.items()])


def _closed(t, clean, measures):
    """Closed days of the whole events stream, drained through the file sink."""
    target = scratch_dir(t.spark, "stream")
    days = S.closed_days(clean, measures)
    S.run_to_files(days, target, scratch_dir(t.spark, "stream-progress"))
    return t.spark.read.schema(days.schema).parquet(target)


@query()
def stream_daily_rollup(t):
    stream = S.stream_events(t.spark, f"{t.sf_dir}/events*.parquet", t.events.schema)
    return _closed(t, clean_file(adapters.file(stream)), [
        F.count("activity").alias("files_accessed"),
        F.count_if("is_after_hours").alias("files_after_hours"),
        F.count_if("is_sensitive").alias("sensitive_files")])


@query()
def stream_daily_alerts(t):
    """Closed days scored in micro-batches, their alerts collected from the target."""
    stream = S.stream_events(t.spark, f"{t.sf_dir}/events*.parquet", t.events.schema)
    timed = stream.select(adapters.user_name(F.col("user_id")).alias("user"), "value",
                          F.col("ts").cast("timestamp").alias("date"))
    days = S.closed_days(timed, adapters.component_measures())
    people = D.one_per_user(t.directory.select("user_id", "department"))

    def score(batch):
        return score_days(batch.join(people, "user", "left").fillna("Unknown", ["department"]),
                          stamp=False)

    target = scratch_dir(t.spark, "stream-alerts")
    S.stream_alerts(days, score, target, scratch_dir(t.spark, "stream-progress")) \
        .awaitTermination()
    return read_table(t.spark, target, ALERTS).select(*ALERTS.names)


@query(3)
def stream_logon_sessions(t):
    """Closed days of logon pairs by keyed state, drained through the file sink."""
    stream = S.stream_events(t.spark, f"{t.sf_dir}/events*.parquet", t.events.schema)
    target = scratch_dir(t.spark, "stream")
    days = SS.stream_sessions(clean_logon(adapters.logon(stream)))
    with SS.keyed_state(t.spark):
        S.run_to_files(days, target, scratch_dir(t.spark, "stream-progress"))
    return t.spark.read.schema(days.schema).parquet(target)


@query()
def gap_sessions(t):
    """Activity sessions that end with six hours of silence."""
    return SS.gap_sessions(t.any_activity, "6 hours")


@query()
def stream_gap_sessions(t):
    """The same from a stream, as far as the watermark has closed them."""
    stream = S.stream_events(t.spark, f"{t.sf_dir}/events*.parquet", t.events.schema)
    target = scratch_dir(t.spark, "stream")
    found = SS.stream_gap_sessions(adapters.activity(stream), "6 hours")
    with SS.merged_before_shuffle(t.spark):
        S.run_to_files(found, target, scratch_dir(t.spark, "stream-progress"))
    return t.spark.read.schema(found.schema).parquet(target)


@query()
def stream_late_rows(t):
    """Every event of a feed with stragglers is in a closed day, in an open day, or late."""
    feed, root = scratch_dir(t.spark, "feed"), scratch_dir(t.spark, "rollup")
    files = adapters.write_arrivals(t.events, feed)
    cents = F.col("value").cast("decimal(18,2)")
    rollup = DailyRollup(root, {"spent": (F.sum(cents), "sum"), "dearest": (F.max("value"), "max")})
    stream = S.stream_events(t.spark, feed, t.spark.read.parquet(feed).schema, files)
    rollup.start(stream, scratch_dir(t.spark, "stream-progress")).awaitTermination()
    late = rollup.late(t.spark, stream.schema).select("day", F.lit("late").alias("kind"),
                                                      F.lit(1).cast("bigint").alias("_events"), cents.alias("spent"))
    kept = [df.select("day", F.lit(kind).alias("kind"), "_events", "spent")
            for kind, df in (("closed", rollup.closed(t.spark)), ("open", rollup.open(t.spark)))]
    return reduce(DataFrame.union, kept, late).groupBy("day", "kind").agg(
        F.sum("_events").alias("events"), F.sum("spent").cast("double").alias("spent"))


@query()
def stream_scored_days(t):
    """The last three days from a stream, scored with saved models and carried-on baselines:
    rows, and rows whose scores are those of the batch run on the same models."""
    spark, run, target, feed, mark = t.spark, *[scratch_dir(t.spark, n) for n in (
        "run", "scored", "days", "stream-progress")]
    daily = materialise(t.daily(), "daily")
    t.matrix = with_deviations(daily)        # the batch run starts from the same table
    newest = daily.agg(F.max("day")).first()[0]
    start = F.date_sub(F.lit(newest), 3)
    t.detectors.save(spark, f"{run}/models")
    T.write_table(last_rows(daily.filter(F.col("day") <= start)), f"{run}/baseline_state")
    scorer = DayScorer(run, target)
    for back in (2, 1, 0):       # a restart for each day that closes
        daily.filter(F.col("day") == F.date_sub(F.lit(newest), back)).write.mode("append").parquet(feed)
        scorer.start(S.stream_events(spark, feed, daily.schema), mark).awaitTermination()
    figures = ["if_score", "ae_score", "risk_score", "risk_tier"]
    batch = t.detectors.score(t.features).filter(F.col("day") > start)
    batch = batch.select("user", "day", *[F.col(c).alias(f"_{c}") for c in figures])
    both = spark.read.parquet(f"{target}/scored").join(batch, ["user", "day"])
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_{c}") for c in figures])
    return both.groupBy("day").agg(F.count(F.lit(1)).alias("rows"), F.count_if(same).alias("same"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)
