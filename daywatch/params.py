"""Thresholds, windows, patterns and weights, in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass

# Tier names from worst to best, and the colour shown for each.
TIERS = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "NORMAL")
TIER_COLORS = {
    "NORMAL": "#4ade80",
    "LOW": "#facc15",
    "MEDIUM": "#fb923c",
    "HIGH": "#f87171",
    "CRITICAL": "#dc2626",
}
ALERT_STATUSES = ("OPEN", "IN_PROGRESS", "RESOLVED")
ALERTING_TIERS = ("HIGH", "CRITICAL")
RISING_TIERS = ("MEDIUM", "HIGH", "CRITICAL")
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")

# Measures compared with the user's own trailing baseline.
BASELINE_MEASURES = (
    "files_accessed",
    "usb_count",
    "emails_external",
    "after_hours_ratio",
    "sensitive_files",
    "email_attachments",
    "session_duration_total",
)

# The detector's features, in the order of the feature vector.
FEATURES = (
    "login_count", "login_hour_mean", "login_hour_std", "after_hours_logins",
    "after_hours_ratio", "unique_pcs",
    "session_duration_total", "session_count",
    "files_accessed", "files_after_hours", "sensitive_files", "files_per_session",
    "usb_count", "usb_after_hours",
    "emails_sent", "emails_external", "email_attachments",
    "day_of_week", "is_weekend",
    *(f"{m}_deviation" for m in BASELINE_MEASURES),
)

# Measures whose distributions are compared between cohorts.
COMPARED = ("files_accessed", "usb_count", "emails_external", "after_hours_ratio",
            "sensitive_files", "email_attachments", "files_accessed_deviation",
            "usb_count_deviation")

# Behaviour measures of a dossier with the value shown as 100 %.
BEHAVIOUR_MAXIMA = {
    "files_accessed": 80,
    "usb_count": 10,
    "emails_external": 20,
    "after_hours_logins": 5,
    "sensitive_files": 8,
    "email_attachments": 15,
    "session_duration_total": 600,
    "unique_pcs": 5,
}

# Exported columns.
ALERT_EXPORT = ("alert_id", "user_id", "department", "risk_tier", "risk_score",
                "alert_type", "status", "timestamp")
USER_EXPORT = ("user", "name", "department", "risk_tier", "max_risk_score",
               "avg_risk_score", "trend")


@dataclass(frozen=True)
class Params:
    # cleaning
    business_start: int = 8
    business_end: int = 18
    date_formats: tuple[str, ...] = ("M/d/yyyy H:m:s", "M/d/yyyy H:m")
    sensitive_pattern: str = "confidential|secret|private|salary|credential|strategy"
    internal_domains: tuple[str, ...] = ("dtaa.com",)
    # sessions
    session_cap_minutes: float = 600.0
    hot_group_rows: int = 1_000_000   # a larger (user, day) takes the split path
    rank_block: int = 65_536          # ranks per task on the split path
    # baseline and features
    baseline_rows: int = 7
    features: tuple[str, ...] = FEATURES
    winsor_sigmas: float = 5.0
    fit_on: str = "all"               # or "train"
    # isolation forest
    trees: int = 200
    tree_rows: int = 256
    pool_rows: int = 409_600        # rows that pass the first hash, at any table size
    contamination: float = 0.05
    seed: int = 42
    # reconstruction model
    recon_components: int = 8
    # scoring
    weight_iforest: float = 0.6
    weight_recon: float = 0.4
    tier_low: float = 40.0
    tier_medium: float = 70.0
    tier_high: float = 85.0
    tier_critical: float = 95.0
    risk_window_days: int = 30
    trend_rows: int = 7
    trend_min_rows: int = 4
    trend_delta: float = 5.0
    # department page, a scale of its own
    dept_low: float = 15.0
    dept_medium: float = 30.0
    dept_high: float = 50.0
    dept_critical: float = 70.0
    # reports
    timeline_days: int = 30
    alert_page: int = 50
    user_page: int = 100
    dossier_alerts: int = 20
    behaviour_rows: int = 30
    calendar_rows: int = 60
    # exact quantiles: error of the approximate bracket around each
    quantile_error: float = 1e-3
