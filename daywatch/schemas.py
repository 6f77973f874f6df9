"""Schemas of the raw logs and of the result tables."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampType(),
          "double": T.DoubleType(), "bigint": T.LongType(), "boolean": T.BooleanType()}


def _struct(columns: str) -> T.StructType:
    """`name type, name type` without needing a running session."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in pairs])


# Raw logs keep `date` and `attachments` as text: cleaning decides what is valid.
LOGON = _struct("id string, date string, user string, pc string, activity string")
FILE = _struct("id string, date string, user string, pc string, filename string, activity string")
DEVICE = _struct("id string, date string, user string, pc string, activity string")
EMAIL = _struct(
    "id string, date string, user string, pc string, to string, from string, "
    "activity string, attachments string, size bigint, content string")
DIRECTORY = _struct(
    "user_id string, name string, email string, department string, role string, "
    "team string, supervisor string, start_date date, pc string")
GROUND_TRUTH = _struct(
    "user_id string, threat_type string, trigger_date date, is_insider boolean, "
    "description string")

RAW = {"logon": LOGON, "file": FILE, "device": DEVICE, "email": EMAIL,
       "directory": DIRECTORY, "ground_truth": GROUND_TRUTH}

ALERTS = _struct(
    "alert_id string, timestamp string, user_id string, department string, "
    "risk_score double, risk_tier string, if_score double, ae_score double, "
    "alert_type string, status string, message string, color string")
SCORED = _struct(
    "user string, department string, if_score double, ae_score double, "
    "risk_score double, risk_tier string, scored_at timestamp, day date")
USER_RISK = _struct(
    "user string, max_risk_score double, avg_risk_score double, high_risk_days bigint, "
    "medium_risk_days bigint, latest_score double, latest_day date, "
    "total_days_active bigint, department string, risk_tier string, trend string")
# Updates name an alert by what it is about, not by its number: numbers change with every run.
STATUS_EVENTS = _struct("user_id string, alert_day string, alert_type string, status string, "
                        "ts timestamp, seq bigint")

REJECTS = _struct("reject_reason string, reject_row string")

RESULTS = {"scored": SCORED, "user_risk": USER_RISK, "alerts": ALERTS,
           "directory": DIRECTORY}
