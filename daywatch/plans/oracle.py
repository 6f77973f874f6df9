"""The SQL twins of the queries, for DuckDB on the same tables.

`CTES` holds named building blocks; a query lists none of them explicitly, it
gets those its text mentions (and theirs in turn).
"""

from __future__ import annotations

import re

from daywatch.params import BASELINE_MEASURES, BEHAVIOUR_MAXIMA, COMPARED, FEATURES, WEEKDAYS

FMT = "'%Y-%m-%d %H:%M:%S.%f'"


def _stamp(c: str) -> str:
    return f"strftime({c}, {FMT})"


def _log(prefix: str, kinds: str, columns: str) -> str:
    return (f"SELECT '{prefix}' || event_id AS id, ts AS date, \"user\", {columns}, "
            f"hour, day FROM ev WHERE event_type IN ({kinds})")


LATE = "NOT (hour BETWEEN 8 AND 17) AS is_after_hours"

CTES = {
    "ev": """SELECT *, 'U' || user_id AS "user", json_extract_string(props, '$.k')::int AS k,
        ts::date AS day, hour(ts) AS hour FROM events""",
    "logon": _log("L", "'view','click'", f"""'PC-' || (k % 7) AS pc,
        CASE WHEN event_type = 'view' THEN 'Logon' ELSE 'Logoff' END AS activity, {LATE}"""),
    "filelog": "SELECT *, regexp_matches(lower(filename), "
               "'confidential|secret|private|salary|credential|strategy') AS is_sensitive FROM ("
               + _log("F", "'signup'", f"""'PC-' || (k % 7) AS pc,
        '/' || (['reports','confidential','engineering','salary','public','strategy',
        'marketing','credentials','shared','archive'])[k % 10 + 1] || '/doc_' || k || '.txt'
        AS filename, 'Open' AS activity, {LATE}""") + ")",
    "device": _log("D", "'error'", f"""'PC-' || (k % 7) AS pc,
        CASE WHEN event_id % 2 = 0 THEN 'Connect' ELSE 'Disconnect' END AS activity, {LATE}"""),
    "email": """SELECT *, split_part("to", '@', 2) <> 'dtaa.com' AS is_external FROM ("""
             + _log("E", "'purchase'", """'PC-' || (k % 7) AS pc, 'person' || k || '@' ||
        (['dtaa.com','dtaa.com','gmail.com','dtaa.com','competitor.com'])[k % 5 + 1] AS "to",
        "user" || '@dtaa.com' AS "from", 'Send' AS activity,
        floor(value / 50)::bigint AS attachments, length(props)::bigint AS size,
        props AS content""") + ")",
    "directory": """SELECT 'U' || c_custkey AS user_id, c_name AS name,
        c_mktsegment AS department, n_name AS role
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "truth": """SELECT 'U' || doc_id AS user_id, CASE WHEN toxic = 1 THEN
        (['data_exfiltrator','disgruntled_saboteur','negligent_insider'])[doc_id % 3 + 1]
        ELSE 'none' END AS threat_type, CASE WHEN toxic = 1 THEN
        DATE '2024-01-10' + (doc_id % 10)::int END AS trigger_date, toxic = 1 AS is_insider,
        CASE WHEN toxic = 1 THEN 'labelled toxic' ELSE 'Normal behavior' END AS description
        FROM labels""",
    "gaps": """SELECT "user", min(ts) AS start, max(ts) AS last, count(*) AS events FROM (
        SELECT "user", ts, sum(pause::int) OVER (PARTITION BY "user" ORDER BY ts, event_id) AS part
        FROM (SELECT "user", ts, event_id, coalesce(ts - lag(ts) OVER (
            PARTITION BY "user" ORDER BY ts, event_id) > INTERVAL 6 HOUR, false) AS pause FROM ev))
        GROUP BY "user", part""",
    "arrivals": """SELECT *, day + (CASE WHEN event_id % 11 = 0 THEN event_id % 5 + 1 ELSE 0 END)::int
        AS arrival FROM ev""",
    "arrival_days": """SELECT arrival, max(max(day)) OVER (ORDER BY arrival
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 2 AS shut FROM arrivals GROUP BY arrival""",
    "arrived": """SELECT day, value, coalesce(day <= shut, false) AS late
        FROM arrivals JOIN arrival_days USING (arrival)""",
    "nth": """SELECT "user", day, activity, date, row_number() OVER (
        PARTITION BY "user", day, activity ORDER BY date) AS rn FROM logon""",
    "sess": """SELECT "user", day, session_minutes FROM (SELECT a."user", a.day,
        greatest(0.0::double, (epoch_us(b.date) - epoch_us(a.date)) / 60000000.0::double)
        AS session_minutes FROM nth a JOIN nth b ON a."user" = b."user" AND a.day = b.day
        AND a.rn = b.rn AND a.activity = 'Logon' AND b.activity = 'Logoff')
        WHERE session_minutes < 600""",
    "d_logon": """SELECT "user", day, count(activity) AS login_count,
        avg(hour) AS login_hour_mean, coalesce(stddev_samp(hour), 0) AS login_hour_std,
        count(*) FILTER (is_after_hours) AS after_hours_logins,
        count(DISTINCT pc) AS unique_pcs FROM logon GROUP BY ALL""",
    "d_session": """SELECT "user", day, sum(session_minutes) AS session_duration_total,
        count(*) AS session_count FROM sess GROUP BY ALL""",
    "d_file": """SELECT "user", day, count(activity) AS files_accessed,
        count(*) FILTER (is_after_hours) AS files_after_hours,
        count(*) FILTER (is_sensitive) AS sensitive_files FROM filelog GROUP BY ALL""",
    "d_device": """SELECT "user", day, count(activity) AS usb_count,
        count(*) FILTER (is_after_hours) AS usb_after_hours FROM device GROUP BY ALL""",
    "d_email": """SELECT "user", day, count(activity) AS emails_sent,
        count(*) FILTER (is_external) AS emails_external,
        sum(attachments)::bigint AS email_attachments FROM email GROUP BY ALL""",
}

MEASURES = ("login_count", "login_hour_mean", "login_hour_std", "after_hours_logins",
            "unique_pcs", "session_duration_total", "session_count", "files_accessed",
            "files_after_hours", "sensitive_files", "usb_count", "usb_after_hours",
            "emails_sent", "emails_external", "email_attachments")


def _daily(spine: str) -> str:
    filled = ", ".join(f"coalesce({m}, 0) AS {m}" for m in MEASURES)
    return f"""SELECT m.*, coalesce(department, 'Unknown') AS department,
        coalesce(role, 'Unknown') AS role,
        CASE WHEN login_count > 0 THEN after_hours_logins / login_count::double ELSE 0 END
        AS after_hours_ratio,
        CASE WHEN session_count > 0 THEN files_accessed / session_count::double ELSE 0 END
        AS files_per_session, isodow(day) - 1 AS day_of_week,
        CASE WHEN isodow(day) >= 6 THEN 1 ELSE 0 END AS is_weekend
        FROM (SELECT "user", day, {filled} FROM ({spine}) s
        LEFT JOIN d_logon USING ("user", day) LEFT JOIN d_session USING ("user", day)
        LEFT JOIN d_file USING ("user", day) LEFT JOIN d_device USING ("user", day)
        LEFT JOIN d_email USING ("user", day)) m LEFT JOIN directory ON user_id = m."user\""""


CTES["daily"] = _daily('SELECT DISTINCT "user", day FROM logon')
CTES["daily_any"] = _daily('SELECT DISTINCT "user", day FROM ev WHERE event_type IN '
                           "('view','click','signup','error','purchase')")
CTES["matrix"] = "SELECT *, " + ", ".join(
    f"""coalesce(({m} - avg({m}) OVER w) / CASE WHEN coalesce(stddev_samp({m}) OVER w, 0) = 0
    OR min({m}) OVER w = max({m}) OVER w THEN 1 ELSE stddev_samp({m}) OVER w END, 0)
    AS {m}_deviation""" for m in BASELINE_MEASURES) + """ FROM daily WINDOW w AS (
    PARTITION BY "user" ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""

TIER = """CASE WHEN {0} >= 95 THEN 'CRITICAL' WHEN {0} >= 85 THEN 'HIGH'
    WHEN {0} >= 70 THEN 'MEDIUM' WHEN {0} >= 40 THEN 'LOW' ELSE 'NORMAL' END"""
COLOR = """CASE risk_tier WHEN 'NORMAL' THEN '#4ade80' WHEN 'LOW' THEN '#facc15'
    WHEN 'MEDIUM' THEN '#fb923c' WHEN 'HIGH' THEN '#f87171' WHEN 'CRITICAL' THEN '#dc2626'
    ELSE '#666' END AS color"""
MESSAGE = """CASE WHEN risk_score >= 95 THEN 'CRITICAL: ' || "user" ||
    ' exhibits extreme behavioral anomaly. Immediate investigation required.'
    WHEN risk_score >= 85 THEN 'HIGH RISK: ' || "user" ||
    ' shows significant deviation from baseline. Escalate to security team.'
    WHEN risk_score >= 70 THEN 'MEDIUM: ' || "user" ||
    ' has notable behavioral changes. Schedule review.'
    ELSE 'LOW: ' || "user" || ' shows minor behavioral deviation.' END AS message"""

CTES |= {
    "raw_scores": """SELECT "user", day, least(100.0::double, max(value) / 2.3::double) AS i,
        least(100.0::double, sum(value::decimal(18,2))::double / 3.1::double) AS a
        FROM ev GROUP BY ALL""",
    "scored": f"""SELECT *, {TIER.format('risk_score')} AS risk_tier FROM (
        SELECT r."user", r.day, coalesce(department, 'Unknown') AS department,
        round(i, 2) AS if_score, round(a, 2) AS ae_score,
        round(least(100.0::double, greatest(0.0::double, (0.6::double * i + 0.4::double * a)
        / (0.6::double + 0.4::double))), 2) AS risk_score
        FROM raw_scores r LEFT JOIN directory ON user_id = r."user")""",
    "newest": "SELECT max(day) AS d FROM scored",
    "numbered": """SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY day) AS nth,
        row_number() OVER (PARTITION BY "user" ORDER BY day DESC) AS back,
        count(*) OVER (PARTITION BY "user") AS n FROM scored""",
    "trend": """SELECT "user", CASE WHEN any_value(n) < 4 THEN 'stable'
        WHEN avg(risk_score) FILTER (back <= 7) - avg(risk_score) FILTER (
        CASE WHEN n >= 14 THEN back BETWEEN 8 AND 14 ELSE nth <= 7 END) > 5 THEN 'up'
        WHEN avg(risk_score) FILTER (back <= 7) - avg(risk_score) FILTER (
        CASE WHEN n >= 14 THEN back BETWEEN 8 AND 14 ELSE nth <= 7 END) < -5 THEN 'down'
        ELSE 'stable' END AS trend FROM numbered GROUP BY "user\"""",
    "risk": f"""SELECT r.*, trend, {TIER.format('max_risk_score')} AS risk_tier FROM (
        SELECT "user", max(risk_score) AS max_risk_score, avg(risk_score) AS avg_risk_score,
        count(*) FILTER (risk_tier IN ('HIGH', 'CRITICAL')) AS high_risk_days,
        count(*) FILTER (risk_tier = 'MEDIUM') AS medium_risk_days,
        arg_max(risk_score, day) AS latest_score, max(day) AS latest_day,
        count(DISTINCT day) AS total_days_active, min(department) AS department
        FROM scored WHERE day >= (SELECT d FROM newest) - 30 GROUP BY "user") r
        JOIN trend USING ("user")""",
    "day_alerts": f"""SELECT day::varchar || 'T00:00:00Z' AS timestamp, "user" AS user_id,
        department, risk_score, risk_tier, if_score, ae_score,
        'DAILY_ANOMALY' AS alert_type, 'OPEN' AS status, {MESSAGE}, {COLOR},
        row_number() OVER (ORDER BY "user", day) AS n
        FROM scored WHERE risk_tier IN ('HIGH', 'CRITICAL')""",
    "rise_alerts": f"""SELECT latest_day::varchar || 'T00:00:00Z' AS timestamp,
        "user" AS user_id, department, avg_risk_score AS risk_score, risk_tier,
        NULL::double AS if_score, NULL::double AS ae_score, 'RISING_TREND' AS alert_type,
        'OPEN' AS status, 'User ' || "user" ||
        ' shows escalating risk trend over past 14 days.' AS message, {COLOR},
        row_number() OVER (ORDER BY max_risk_score DESC, "user") AS n
        FROM risk WHERE trend = 'up' AND risk_tier IN ('MEDIUM', 'HIGH', 'CRITICAL')""",
    "alerts": """SELECT 'ALT-' || CASE WHEN length(n::varchar) >= 5 THEN n::varchar
        ELSE lpad(n::varchar, 5, '0') END AS alert_id, * EXCLUDE (n) FROM (
        SELECT * FROM day_alerts UNION ALL
        SELECT * REPLACE (n + (SELECT count(*) FROM day_alerts) AS n) FROM rise_alerts)""",
    "updates": """SELECT "user" AS user_id, day::varchar AS alert_day,
        CASE WHEN event_id % 7 = 0 THEN 'RISING_TREND' ELSE 'DAILY_ANOMALY' END AS alert_type,
        upper(trim((['resolved', 'IN_PROGRESS', ' open ', 'CLOSED'])[event_id % 4 + 1]))
        AS status, ts, event_id AS seq FROM ev WHERE event_type = 'click'""",
    "latest": """SELECT user_id, alert_day, alert_type, arg_max(status, (ts, seq)) AS newest_status
        FROM updates WHERE status IN ('OPEN', 'IN_PROGRESS', 'RESOLVED') GROUP BY ALL""",
    "triaged": """SELECT alerts.* REPLACE (coalesce(newest_status, status) AS status)
        FROM alerts LEFT JOIN latest l ON l.user_id = alerts.user_id
        AND l.alert_type = alerts.alert_type AND alert_day = substr(timestamp, 1, 10)""",
    "people": """SELECT risk.*, coalesce(d.name, 'Unknown') AS name, coalesce(d.role, '') AS role
        FROM risk LEFT JOIN directory d ON user_id = "user\"""",
    "wow": """SELECT avg(risk_score) FILTER (day >= d - 7) AS last7,
        avg(risk_score) FILTER (day >= d - 14 AND day < d - 7) AS prev7 FROM scored, newest""",
    "kpi": """SELECT (SELECT count(*) FROM risk) AS total_users,
        (SELECT count(*) FROM risk WHERE risk_tier = 'CRITICAL') AS critical_users,
        (SELECT count(*) FROM risk WHERE risk_tier = 'HIGH') AS high_risk_users,
        (SELECT round_even(avg(avg_risk_score), 1) FROM risk) AS avg_risk_score,
        (SELECT count(*) FROM triaged WHERE status IN ('OPEN', 'IN_PROGRESS')) AS open_alerts,
        (SELECT CASE WHEN prev7 > 0 THEN round_even((last7 - prev7) / prev7 * 100, 1) ELSE 0 END
        FROM wow) AS risk_trend_pct""",
    "perday": """SELECT day, avg(risk_score) AS risk_score_avg, max(risk_score)
        AS risk_score_max, count(*) FILTER (risk_tier IN ('HIGH', 'CRITICAL')) AS n_anomalies
        FROM scored GROUP BY day""",
    "heat": """SELECT department, dayname(day) AS dow, round_even(
        sum(risk_score::decimal(18, 2))::double / count(risk_score), 1) AS avg_risk
        FROM scored GROUP BY ALL""",
    "dept": """SELECT department, count(*) AS user_count, round_even(avg(avg_risk_score), 2)
        AS avg_risk, round_even(max(max_risk_score), 2) AS max_risk,
        count(*) FILTER (risk_tier = 'CRITICAL') AS critical_count,
        count(*) FILTER (risk_tier = 'HIGH') AS high_count FROM risk GROUP BY department""",
    "labelled": """SELECT "user", score, is_insider FROM (
        SELECT "user", round(avg(risk_score), 9) AS score FROM scored GROUP BY "user") JOIN (SELECT DISTINCT user_id, is_insider FROM truth)
        ON user_id = "user\"""",
    "sizes": """SELECT count(*) FILTER (is_insider) AS p, count(*) FILTER (NOT is_insider) AS n
        FROM labelled""",
    "insiders": "SELECT count(DISTINCT user_id) AS t FROM truth WHERE is_insider",
    "roc": """SELECT score, sum(count(*) FILTER (NOT is_insider)) OVER o AS fp,
        sum(count(*) FILTER (is_insider)) OVER o AS tp FROM labelled GROUP BY score
        WINDOW o AS (ORDER BY score DESC)""",
    "topk": """SELECT "user", score, row_number() OVER o AS k, (sum(is_insider::int) OVER o)::bigint
        AS hits FROM labelled WINDOW o AS (ORDER BY score DESC, "user")""",
    "rates": """SELECT "user", count(usb) AS usb_events, avg(ext) * 100 AS external_pct FROM (
        SELECT "user", 1 AS usb, NULL::int AS ext FROM device UNION ALL
        SELECT "user", NULL, is_external::int FROM email) GROUP BY "user\"""",
    "labelled_days": """SELECT m.*, coalesce(is_insider, false) AS is_insider
        FROM matrix m LEFT JOIN truth ON user_id = m."user\"""",
    "top_users": """SELECT "user" FROM risk WHERE max_risk_score >=
        (SELECT quantile_cont(max_risk_score, 0.75) FROM risk)""",
    "found": """SELECT user_id AS "user" FROM truth WHERE is_insider
        INTERSECT SELECT "user" FROM top_users""",
}


def with_ctes(body: str) -> str:
    """Prefix `body` with the building blocks it mentions, directly or not."""
    names = list(CTES)

    def mentioned(text: str) -> set[str]:
        return {n for n in names if re.search(rf"\b(FROM|JOIN|,)\s+{n}\b", text)}

    need, todo = set(), mentioned(body)
    while todo:
        need |= todo
        todo = set().union(*(mentioned(CTES[n]) for n in todo)) - need
    used = [n for n in names if n in need]
    return ("WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in used) + "\n" if used else "") + body


def _r(cols: str, decimals: int) -> str:
    return ", ".join(f"round({c}, {decimals}) AS {c}" for c in cols.split())


NAMES = (*FEATURES, "dept_encoded")


def _scaled() -> dict[str, str]:
    """The feature preparation as three building blocks."""
    moments = ", ".join(f"avg({n}) AS m_{n}, stddev_samp({n}) AS s_{n}" for n in NAMES)
    clipped = ", ".join(
        f"CASE WHEN s_{n} > 0 THEN least(greatest({n}, m_{n} - 5 * s_{n}), m_{n} + 5 * s_{n}) "
        f"ELSE {n} END AS {n}" for n in NAMES)
    second = ", ".join(f"avg({n}) AS m_{n}, stddev_pop({n}) AS s_{n}" for n in NAMES)
    scaled = ", ".join(f"(c.{n} - m_{n}) / CASE WHEN s_{n} > 0 THEN s_{n} ELSE 1 END AS {n}"
                       for n in NAMES)
    return {
        "encoded": "SELECT *, dense_rank() OVER (ORDER BY department) - 1 AS dept_encoded "
                   "FROM matrix",
        "winsored": f'SELECT "user", day, is_weekend = 0 AS is_train, {clipped} '
                    f"FROM encoded JOIN (SELECT {moments} FROM encoded) ON true",
        "scaled": f'SELECT "user", day, is_train, {scaled} FROM winsored c '
                  f"JOIN (SELECT {second} FROM winsored) ON true",
    }


CTES |= _scaled()


def _long(table: str, names, extra: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT {extra}'{n}' AS measure, {n}::double AS value FROM {table}" for n in names)


def _correlation(rows: str = "scaled") -> str:
    pairs = ", ".join(f"{{'f1': '{a}', 'f2': '{b}', 'r': corr({a}, {b})}}"
                      for a in NAMES for b in NAMES)
    return with_ctes(f"""SELECT u.f1, u.f2, CASE WHEN isnan(u.r) THEN NULL
        ELSE round(u.r, 4) END AS r FROM (SELECT unnest([{pairs}]) AS u FROM {rows})""")


def _refit() -> dict[str, str]:
    """Limits of the encoded matrix, means and scales of the clipped one; correlations of
    training rows, which scaling does not change."""
    first = ", ".join(f"{{'feature': '{n}', 'm': avg({n}), 's': stddev_samp({n})}}" for n in NAMES)
    second = ", ".join(f"{{'feature': '{n}', 'mean': avg({n}), 'scale': stddev_pop({n})}}" for n in NAMES)
    scales = f"""SELECT feature, CASE WHEN a.s > 0 THEN round(a.m - 5 * a.s, 6) END AS low,
        CASE WHEN a.s > 0 THEN round(a.m + 5 * a.s, 6) END AS high, round(b.mean, 6) AS mean,
        CASE WHEN b.scale > 0 THEN round(b.scale, 6) ELSE 1 END AS scale
        FROM (SELECT unnest([{first}], recursive := true) FROM encoded) a
        JOIN (SELECT unnest([{second}], recursive := true) FROM winsored) b USING (feature)"""
    return {"refit_scales": with_ctes(scales),
            "refit_correlation": _correlation("winsored WHERE is_train")}


def _histogram(rows: str, groups: str, bins: str) -> str:
    lead = f"{groups}, " if groups else ""
    over = f"PARTITION BY {groups}" if groups else ""
    return f"""SELECT {lead}bin::bigint AS bin, round(lo + bin * width, 6) AS edge,
        count(*) AS count, round(count(*) / (n * width), 6) AS density FROM (
        SELECT *, least(floor((value - lo) / width), bins - 1) AS bin FROM (
        SELECT *, (hi - lo) / bins AS width FROM (SELECT {lead}value, n, bins,
        CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
        CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM (
        SELECT *, min(value) OVER g AS lo0, max(value) OVER g AS hi0, count(*) OVER g AS n,
        {bins} AS bins FROM ({rows}) WINDOW g AS ({over})))))
        GROUP BY {lead}bin, lo, width, n"""


TRIMMED = ("SELECT measure, is_insider, round(value, 6) AS value FROM ("
           + _long("labelled_days", COMPARED, "is_insider, ") + ") l JOIN ("
           "SELECT measure, quantile_cont(value, 0.99) AS cut FROM ("
           + _long("labelled_days", COMPARED, "is_insider, ")
           + ") WHERE NOT is_insider GROUP BY measure) c USING (measure) "
             "WHERE value <= cut * 2")

ALERT_COLS = ("timestamp, user_id, department, round(risk_score, 6) AS risk_score, risk_tier, "
              "if_score, ae_score, alert_type, status, message, color")
RISK_COLS = ('"user", max_risk_score, round(avg_risk_score, 6) AS avg_risk_score, '
             "high_risk_days, medium_risk_days, latest_score, latest_day::varchar AS latest_day, "
             "total_days_active, department, risk_tier, trend")
LOG_COLS = f'id, {_stamp("date")} AS date, "user", pc, activity, hour, day::varchar AS day'

BODIES = {
    "clean_logon_events": f"SELECT {LOG_COLS}, is_after_hours FROM logon",
    "clean_file_events": f"SELECT {LOG_COLS}, filename, is_after_hours, is_sensitive FROM filelog",
    "clean_device_events": f"SELECT {LOG_COLS}, is_after_hours FROM device",
    "clean_email_events": f"""SELECT {LOG_COLS}, "to", "from", attachments, size, content,
        is_external FROM email""",
    "session_list": """SELECT "user", day::varchar AS day,
        round(session_minutes, 3) AS session_minutes FROM sess""",
    "daily_logon": f"""SELECT "user", day::varchar AS day, login_count,
        {_r('login_hour_mean login_hour_std', 6)}, after_hours_logins, unique_pcs FROM d_logon""",
    "daily_session": f"""SELECT "user", day::varchar AS day, {_r('session_duration_total', 3)},
        session_count FROM d_session""",
    "daily_file": 'SELECT * REPLACE (day::varchar AS day) FROM d_file',
    "daily_device": 'SELECT * REPLACE (day::varchar AS day) FROM d_device',
    "daily_email": 'SELECT * REPLACE (day::varchar AS day) FROM d_email',
    "rolling_deviation": f"""SELECT "user", day::varchar AS day,
        {', '.join(f'round({m}_deviation, {3 if m == "session_duration_total" else 6}) '
                   f'AS {m}_deviation' for m in BASELINE_MEASURES)}
        FROM matrix""",
    "training_set": """SELECT "user", day::varchar AS day, department, login_count
        FROM daily WHERE is_weekend = 0""",
    "ensemble_tiers": """SELECT "user", day::varchar AS day, department, if_score, ae_score,
        risk_score, risk_tier FROM scored""",
    "user_risk_table": f"SELECT {RISK_COLS} FROM risk",
    "user_trend": 'SELECT "user", trend FROM risk',
    "alerts_daily": f"SELECT {ALERT_COLS} FROM day_alerts",
    "alerts_rising": f"SELECT {ALERT_COLS} FROM rise_alerts",
    "alerts_all": f"SELECT alert_id, {ALERT_COLS} FROM alerts",
    "alert_status_current": "SELECT alert_id, user_id, alert_type, status FROM triaged",
    "alert_status_rejects": f"""SELECT user_id, alert_day, alert_type, status, {_stamp('ts')} AS ts, seq,
        CASE WHEN status NOT IN ('OPEN', 'IN_PROGRESS', 'RESOLVED') THEN 'invalid status'
        ELSE 'unknown alert' END AS reason FROM updates
        WHERE status NOT IN ('OPEN', 'IN_PROGRESS', 'RESOLVED')
        OR (user_id, alert_day, alert_type) NOT IN (
        SELECT (user_id, substr(timestamp, 1, 10), alert_type) FROM alerts)""",
    "snapshot_alerts": """SELECT user_id, timestamp, alert_type, status FROM triaged, newest
        WHERE substr(timestamp, 1, 10)::date >= d - 10""",
    "watchlist_page2_by_trend": f"""SELECT {RISK_COLS}, name, role FROM (SELECT * FROM people
        ORDER BY trend, "user" LIMIT 20 OFFSET 20)""",
    "page_total": """SELECT alert_id, (SELECT count(*) FROM alerts WHERE risk_tier = 'CRITICAL')
        AS total FROM (SELECT * FROM alerts WHERE risk_tier = 'CRITICAL'
        ORDER BY risk_score DESC, alert_id LIMIT 5 OFFSET 5)""",
    "csv_logs": " UNION ALL ".join(
        f"""SELECT '{name}' AS log, '{prefix}' || event_id AS id, "user", strftime(CASE
        WHEN event_id % 3 = 0 THEN date_trunc('minute', ts) ELSE date_trunc('second', ts) END,
        '%Y-%m-%d %H:%M:%S') AS date, {chars} AS chars FROM ev
        WHERE event_type IN ({kinds}) AND event_id % 50 <> 0""" for name, prefix, kinds, chars in (
            ("logon", "L", "'view','click'", "NULL::bigint"), ("file", "F", "'signup'", "NULL::bigint"),
            ("device", "D", "'error'", "NULL::bigint"), ("email", "E", "'purchase'", "length(props) + 22"))),
    "csv_dropped": " UNION ALL ".join(
        f"""SELECT '{name}' AS log, count(*) AS rows, count(*) FILTER (event_id % 50 = 0)
        AS bad_dates FROM ev WHERE event_type IN ({kinds})""" for name, kinds in (
            ("logon", "'view','click'"), ("file", "'signup'"), ("device", "'error'"),
            ("email", "'purchase'"))),
    "log_rejects": " UNION ALL ".join(
        f"""SELECT '{name}' AS log, CASE WHEN event_id % 50 = 0 THEN 'unreadable date' ELSE 'clean' END
        AS outcome, count(*) AS rows FROM ev WHERE event_type IN ({kinds}) GROUP BY ALL"""
        for name, kinds in (("logon", "'view','click'"), ("file", "'signup'"), ("device", "'error'"),
                            ("email", "'purchase'"))),
    "incremental_deviation": f"""SELECT "user", day::varchar AS day,
        {', '.join(f'round({m}_deviation, {3 if m == "session_duration_total" else 6}) '
                   f'AS {m}_deviation' for m in BASELINE_MEASURES)}
        FROM matrix, (SELECT max(day) AS newest FROM daily) WHERE day > newest - 5""",
    "compacted_status": "SELECT user_id, alert_day, alert_type, newest_status AS status FROM latest",
    "recon_energy": 'SELECT "user", day::varchar AS day, round(' + " + ".join(
        f"(s.{n} - m.{n}) ** 2" for n in NAMES) + ", 3) AS energy FROM scaled s JOIN (SELECT "
        + ", ".join(f"avg({n}) AS {n}" for n in NAMES) + " FROM scaled WHERE is_train) m ON true",
    "recon_calibration": """SELECT count(*) AS training,
        count(*) - floor(0.95 * (count(*) - 1))::bigint - 1 AS above_p95,
        count(*) - floor(0.999 * (count(*) - 1))::bigint - 1 AS above_p999
        FROM matrix WHERE is_weekend = 0""",
    "iforest_labels": """SELECT count(*) AS training, ceil(0.05 * (count(*) - 1))::bigint AS anomalies
        FROM matrix WHERE is_weekend = 0""",
    "detector_reload": "SELECT count(*) AS rows, " + ", ".join(
        f"count(*) AS {c}" for c in ("features", "iforest_raw", "if_label", "recon_error",
                                     "recon_label")) + " FROM matrix",
    "iforest_gates": """SELECT "user", day::varchar AS day, true AS in_range,
        is_weekend = 0 AS is_train FROM matrix""",
    "iforest_ends": "SELECT 0.0::double AS ordinary, 100.0::double AS oddest",
    "full_run_tables": """SELECT 'daily_behaviour' AS "table", count(*) AS rows FROM daily
        UNION ALL SELECT 'features', count(*) FROM daily
        UNION ALL SELECT 'training', count(*) FROM daily WHERE is_weekend = 0
        UNION ALL SELECT 'scored', count(*) FROM daily UNION ALL SELECT 'user_risk',
        count(DISTINCT "user") FROM daily WHERE day >= (SELECT max(day) FROM daily) - 30""",
    "detector_report": """SELECT unnest(['if_score', 'ae_score', 'risk_score']) AS detector,
        count(*) FILTER (is_insider) AS insiders, count(*) FILTER (NOT is_insider) AS normals
        FROM (SELECT DISTINCT "user", is_insider FROM daily JOIN truth ON user_id = "user")""",
    "kpis": "SELECT * FROM kpi",
    "week_over_week": """SELECT round(last7, 6) AS last7, round(prev7, 6) AS prev7,
        CASE WHEN prev7 > 0 THEN round_even((last7 - prev7) / prev7 * 100, 1) ELSE 0 END
        AS risk_trend_pct FROM wow""",
    "threat_level": """SELECT CASE WHEN critical_users > 0 THEN 'CRITICAL'
        WHEN high_risk_users > 2 THEN 'HIGH' WHEN open_alerts > 5 THEN 'MEDIUM'
        WHEN open_alerts > 0 THEN 'LOW' ELSE 'NORMAL' END AS threat_level,
        critical_users + high_risk_users AS badge FROM kpi""",
    "alerts_page": f"""SELECT alert_id, {ALERT_COLS} FROM (SELECT * FROM alerts
        ORDER BY risk_score DESC, alert_id LIMIT 50 OFFSET 50)""",
    "alerts_search": f"""SELECT alert_id, {ALERT_COLS} FROM alerts WHERE risk_tier = 'CRITICAL'
        AND (lower(user_id) LIKE '%ma%' OR lower(department) LIKE '%ma%'
        OR lower(alert_id) LIKE '%ma%')""",
    "watchlist": f"""SELECT {RISK_COLS}, name, role FROM (SELECT * FROM people
        ORDER BY max_risk_score DESC, "user" LIMIT 100)""",
    "watchlist_search": f"""SELECT {RISK_COLS}, name, role FROM people
        WHERE risk_tier = 'CRITICAL' AND (lower("user") LIKE '%bui%'
        OR lower(name) LIKE '%bui%' OR lower(department) LIKE '%bui%')""",
    "watchlist_summary": """SELECT count(*) AS total,
        count(*) FILTER (risk_tier = 'CRITICAL') AS critical,
        count(*) FILTER (risk_tier = 'HIGH') AS high, round(avg(avg_risk_score), 6) AS avg
        FROM people""",
    "dossier_daily": """SELECT "user", day::varchar AS day, department, if_score, ae_score,
        risk_score, risk_tier FROM scored WHERE "user" IN (SELECT "user" FROM risk)""",
    "dossier_alerts_top20": """SELECT user_id, nth, alert_id, round(risk_score, 6) AS risk_score
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id
        ORDER BY risk_score DESC, alert_id) AS nth FROM alerts) WHERE nth <= 20""",
    "dossier_overview": """SELECT "user", name, days, first_day, first_score,
        coalesce(n_alerts, 0) AS alerts, top_alert FROM people JOIN (SELECT "user",
        count(*) AS days, min(day)::varchar AS first_day, arg_min(risk_score, day)
        AS first_score FROM scored GROUP BY "user") h USING ("user")
        LEFT JOIN (SELECT user_id, least(count(*), 20) AS n_alerts,
        arg_min(alert_id, (-risk_score, alert_id)) AS top_alert FROM alerts GROUP BY user_id) a
        ON a.user_id = "user\"""",
    "behaviour_profile": """SELECT "user", round(max(peak) , 6) AS peak_score, measure,
        round(avg(v), 6) AS average, round(least(100, avg(v) / any_value(top) * 100), 6) AS pct
        FROM (""" + " UNION ALL ".join(
            f"""SELECT "user", '{m}' AS measure, {top}.0::double AS top, nth, peak,
            coalesce({m}, 0)::double AS v FROM (SELECT s."user", s.day,
            max(risk_score) OVER (PARTITION BY s."user") AS peak, row_number() OVER (
            PARTITION BY s."user" ORDER BY s.day DESC) AS nth, {m}
            FROM scored s LEFT JOIN daily_any d ON d."user" = s."user" AND d.day = s.day)"""
            for m, top in BEHAVIOUR_MAXIMA.items())
        + """) WHERE nth <= 30 GROUP BY "user", measure""",
    "timeline": f"""SELECT day::varchar AS day, {_r('risk_score_avg risk_score_max', 6)},
        n_anomalies FROM perday WHERE day >= (SELECT d FROM newest) - 20""",
    "timeline_user": """SELECT "user", day::varchar AS day, risk_score, if_score, ae_score,
        risk_tier FROM scored WHERE day >= (SELECT d FROM newest) - 7""",
    "timeline_summary": """SELECT round(max(top), 1) AS peak,
        substr(arg_min(day, (-top, day))::varchar, 6, 5) AS peak_date,
        round(avg(mean), 1) AS mean, sum(n_anomalies)::bigint AS incidents FROM (
        SELECT day, round(risk_score_max, 2) AS top, round(risk_score_avg, 2) AS mean,
        n_anomalies FROM perday WHERE day >= (SELECT d FROM newest) - 30)""",
    "incident_calendar": f"""SELECT day::varchar AS day, {_r('risk_score_avg risk_score_max', 6)},
        n_anomalies FROM (SELECT * FROM perday WHERE day >= (SELECT d FROM newest) - 365
        ORDER BY day DESC LIMIT 60)""",
    "population_daily": f"""SELECT day::varchar AS day,
        {_r('risk_score_avg risk_score_max', 6)}, n_anomalies FROM perday""",
    "heatmap": "SELECT * FROM heat",
    "heatmap_matrix": "SELECT department, " + ", ".join(
        f"coalesce(max(avg_risk) FILTER (dow = '{d}'), 0) AS \"{d}\"" for d in WEEKDAYS)
        + " FROM heat GROUP BY department",
    "heatmap_top": """SELECT * FROM heat WHERE avg_risk > 0
        ORDER BY avg_risk DESC, department, dow LIMIT 6""",
    "departments": """SELECT *, CASE WHEN avg_risk >= 70 THEN 'CRITICAL' WHEN avg_risk >= 50
        THEN 'HIGH' WHEN avg_risk >= 30 THEN 'MEDIUM' WHEN avg_risk >= 15 THEN 'LOW'
        ELSE 'NORMAL' END AS dept_tier FROM dept""",
    "departments_top": """SELECT department, avg_risk FROM dept
        ORDER BY avg_risk DESC, department LIMIT 8""",
    "department_totals": """SELECT sum(user_count)::bigint AS total_users,
        round(avg(avg_risk), 6) AS avg_risk,
        arg_min(department, (-avg_risk, department)) AS hotspot,
        arg_min(department, (-critical_count, -avg_risk, department)) AS most_critical
        FROM dept""",
    "tier_distribution": """SELECT risk_tier, count("user") AS users,
        round(count("user") * 100.0::double / (SELECT count(*) FROM risk), 0)::bigint AS pct
        FROM (SELECT unnest(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'NORMAL']) AS risk_tier)
        LEFT JOIN risk USING (risk_tier) GROUP BY risk_tier""",
    "alert_summary": """SELECT count(*) AS total_alerts,
        count(*) FILTER (risk_tier = 'CRITICAL') AS critical_alerts,
        count(*) FILTER (risk_tier = 'HIGH') AS high_alerts FROM alerts""",
    "user_events": " UNION ALL ".join(
        f"""SELECT "user", {_stamp('date')} AS date, '{s}' AS source, id, activity,
        {d} AS detail FROM {t}""" for s, t, d in (
            ("logon", "logon", "pc"), ("file", "filelog", "filename"),
            ("device", "device", "pc"), ("email", "email", '"to"'))),
    "export_alerts": """SELECT alert_id, user_id, department, risk_tier,
        round(risk_score, 6) AS risk_score, alert_type, status, timestamp FROM alerts""",
    "export_users": """SELECT "user", name, department, risk_tier, max_risk_score,
        round(avg_risk_score, 6) AS avg_risk_score, trend FROM people""",
    "alert_records": """SELECT '{"user_id":"' || user_id || '","timestamp":"' || timestamp ||
        '","risk_tier":"' || risk_tier || '"}' AS record FROM day_alerts""",
    "run_report": """SELECT (SELECT count(*) FROM risk) AS total_users, count(*) AS total_alerts,
        count(*) FILTER (risk_tier = 'CRITICAL') AS critical_alerts,
        count(*) FILTER (risk_tier = 'HIGH') AS high_alerts,
        (SELECT '{' || string_agg('"' || risk_tier || '":' || n, ',' ORDER BY risk_tier) || '}'
        FROM (SELECT risk_tier, count(*) AS n FROM risk GROUP BY risk_tier)) AS tier_distribution
        FROM alerts""",
    "user_scores": 'SELECT "user", round(score, 6) AS score, is_insider FROM labelled',
    "complete_labels": """SELECT user_id, threat_type, trigger_date::varchar AS trigger_date,
        is_insider, description FROM truth WHERE is_insider UNION ALL SELECT user_id, 'none',
        NULL, false, 'Normal behavior' FROM directory
        WHERE user_id NOT IN (SELECT user_id FROM truth WHERE is_insider)""",
    "roc_points": """SELECT round(score, 6) AS score, round(fp / nullif(n, 0)::double, 6) AS fpr,
        round(tp / p::double, 6) AS tpr FROM roc, sizes WHERE p > 0""",
    "roc_auc": """SELECT (SELECT round(avg(CASE WHEN a.score > b.score THEN 1.0::double
        WHEN a.score = b.score THEN 0.5::double ELSE 0 END), 6) FROM labelled a, labelled b
        WHERE a.is_insider AND NOT b.is_insider) AS auc_roc, p AS insiders, n AS normals
        FROM sizes""",
    "precision_at_k": """SELECT k, "user", round(score, 6) AS score, hits,
        round(hits / k::double, 6) AS "precision", round(hits / t::double, 6) AS recall
        FROM topk, insiders WHERE t > 0""",
    "top_k_precision": """SELECT k, hits, round(hits / k::double, 6) AS "precision"
        FROM topk, sizes WHERE k = p""",
    "detection_report": """SELECT k, hits, round(hits / k::double, 6) AS "precision",
        round(hits / t::double, 6) AS recall FROM topk, insiders
        WHERE t > 0 AND (k IN (5, 10, 15, 20) OR k = t)""",
    "user_means": """SELECT "user", round(avg(risk_score), 6) AS score FROM scored
        GROUP BY "user\"""",
    "score_quantiles": " UNION ALL ".join(
        f"SELECT {q}::double AS prob, round(quantile_cont(risk_score, {q}), 6) AS value "
        "FROM scored" for q in (0.5, 0.9, 0.95, 0.99, 0.999)),
    "score_range": """SELECT min(risk_score) AS min, round(avg(risk_score), 6) AS mean,
        max(risk_score) AS max FROM scored""",
    "describe": " UNION ALL ".join(
        f"""SELECT '{m}' AS measure, count({m}) AS n, round(avg({m}), 4) AS mean,
        round(stddev_samp({m}), 4) AS std, round(min({m})::double, 4) AS min,
        round(max({m})::double, 4) AS max,
        {', '.join(f"round(quantile_cont({m}::double, {q}), 4) AS p{int(q * 100)}"
                   for q in (0.25, 0.5, 0.75))} FROM matrix""" for m in FEATURES),
    "login_hours_histogram": _histogram(
        'SELECT hour::double AS value, is_insider FROM logon JOIN truth ON user_id = "user"',
        "is_insider", "24"),
    "risk_histogram": _histogram(
        "SELECT max_risk_score AS value FROM risk", "", "25"),
    "activity_histogram": _histogram(
        "SELECT is_insider, measure, value FROM truth JOIN ("
        + " UNION ALL ".join(f"SELECT \"user\", '{m}' AS measure, {m}::double AS value FROM rates "
                             f"WHERE {m} IS NOT NULL" for m in ("usb_events", "external_pct"))
        + ") ON user_id = \"user\"", "measure, is_insider",
        "CASE WHEN is_insider THEN 10 ELSE 20 END"),
    "histogram": _histogram(TRIMMED, "measure, is_insider",
                            "CASE WHEN is_insider THEN 15 ELSE 30 END"),
    "archetype_stats": """SELECT threat_type, round(avg(max_risk_score), 6) AS mean,
        max(max_risk_score) AS max, min(max_risk_score) AS min
        FROM truth LEFT JOIN risk ON user_id = "user" WHERE is_insider GROUP BY threat_type""",
    "insider_dossier": """SELECT t.user_id, threat_type, trigger_date::varchar AS trigger_date,
        max_risk_score, round(avg_risk_score, 6) AS avg_risk_score, risk_tier, trend, d.name,
        d.department, d.role FROM truth t LEFT JOIN risk r ON r."user" = t.user_id
        LEFT JOIN directory d ON d.user_id = t.user_id WHERE is_insider""",
    "insider_series": """SELECT "user", day::varchar AS day, risk_score, threat_type,
        trigger_date::varchar AS trigger_date, day >= trigger_date AS after_trigger
        FROM scored JOIN truth ON user_id = "user" WHERE is_insider""",
    "cohort_means": """SELECT is_insider, count(*) AS users, round(avg(score), 6) AS mean_score
        FROM labelled GROUP BY is_insider""",
    "detected_insiders": "SELECT * FROM found",
    "detection_rate": """SELECT count(*) AS users,
        round(avg((risk_tier = 'NORMAL')::int), 6) AS normal_share,
        round(stddev_samp(max_risk_score), 6) AS score_std,
        (SELECT count(*) FROM truth WHERE is_insider) AS insiders,
        (SELECT count(*) FROM found) AS detected,
        (SELECT count(*) FROM risk WHERE max_risk_score >= 99 AND "user" IN (
        SELECT user_id FROM truth WHERE NOT is_insider)) AS maxed_normals,
        (SELECT round(count(*) / nullif((SELECT count(*) FROM truth WHERE is_insider), 0)::double,
        6) FROM found) AS detection_rate FROM risk""",
    "dataset_profile": " UNION ALL ".join(
        f"SELECT 'rows_{n}' AS metric, count(*) AS value FROM {t}" for n, t in (
            ("logon", "logon"), ("file", "filelog"), ("device", "device"), ("email", "email"),
            ("directory", "directory"), ("daily", "daily")))
        + """ UNION ALL SELECT 'insiders', count(*) FROM truth WHERE is_insider
        UNION ALL SELECT 'columns_daily', 23
        UNION ALL SELECT 'users', count(DISTINCT "user") FROM daily
        UNION ALL SELECT 'span', max(day) - min(day) + 1 FROM daily""",
    "department_sizes": "SELECT department, count(*) AS users FROM directory GROUP BY department",
    "activity_rates": """SELECT "user", usb_events, round(external_pct, 6) AS external_pct
        FROM rates""",
    "quality_report": " UNION ALL ".join(
        f"SELECT '{t}' AS \"table\", '{r}' AS rule, {bad} AS violations FROM {src}"
        for t, src, rules in (
            ("logon", "logon", (("activity_allowed", "activity NOT IN ('Logon', 'Logoff')"),
                                ("user_present", '"user" IS NULL'))),
            ("email", "email", (("sender_present", '"from" IS NULL'),)),
            ("daily", "matrix", (
                ("ratio_bounded", "NOT after_hours_ratio BETWEEN 0 AND 1"),
                ("all_finite", " OR ".join(f"{m} IS NULL OR isnan({m}::double) OR "
                                           f"isinf({m}::double)" for m in FEATURES)),
                ("not_all_null", "login_count IS NULL"))),
            ("scored", "scored", (
                ("tier_allowed", "risk_tier NOT IN ('CRITICAL','HIGH','MEDIUM','LOW','NORMAL')"),
                ("score_bounded", "NOT risk_score BETWEEN 0 AND 100"))),
            ("user_risk", "risk", (("trend_allowed", "trend NOT IN ('up','down','stable')"),)),
            ("alerts", "alerts", (
                ("status_allowed", "status NOT IN ('OPEN','IN_PROGRESS','RESOLVED')"),
                ("type_allowed", "alert_type NOT IN ('DAILY_ANOMALY','RISING_TREND')"))),
            ("ground_truth", "truth", (
                ("threat_type_allowed", "threat_type NOT IN ('data_exfiltrator',"
                 "'disgruntled_saboteur','negligent_insider','none')"),)))
        for r, bad in (("not_empty", "(count(*) = 0)::bigint"),
                       *((n, f"count(*) FILTER ({cond})") for n, cond in rules))),
    "stream_daily_alerts": f"""SELECT 'ALT-' || user_id || '-' || substr(timestamp, 1, 10)
        AS alert_id, {ALERT_COLS} FROM day_alerts, (SELECT max(ts) AS m FROM ev)
        WHERE substr(timestamp, 1, 10)::date + 1 <= m - INTERVAL 1 DAY""",
    "stream_logon_sessions": """SELECT "user", day::varchar AS day,
        round(session_duration_total, 3) AS session_duration_total, session_count
        FROM d_session, (SELECT max(day) AS newest FROM logon) WHERE day < newest""",
    "gap_sessions": """SELECT "user", strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start,
        strftime(last, '%Y-%m-%d %H:%M:%S.%f') AS last, events FROM gaps""",
    "stream_gap_sessions": """SELECT "user", strftime(start, '%Y-%m-%d %H:%M:%S.%f') AS start,
        strftime(last, '%Y-%m-%d %H:%M:%S.%f') AS last, events
        FROM gaps, (SELECT max(ts) AS newest FROM ev)
        WHERE last + INTERVAL 6 HOUR <= newest - INTERVAL 1 DAY""",
    "stream_scored_days": """SELECT day::varchar AS day, count(*) AS rows, count(*) AS same
        FROM matrix, (SELECT max(day) AS newest FROM daily) WHERE day > newest - 3 GROUP BY ALL""",
    "stream_late_rows": """SELECT day::varchar AS day,
        CASE WHEN late THEN 'late' WHEN day <= until THEN 'closed' ELSE 'open' END AS kind,
        count(*) AS events, round(sum(value::decimal(18, 2))::double, 6) AS spent
        FROM arrived, (SELECT max(day) - 2 AS until FROM ev) GROUP BY ALL""",
    "stream_daily_rollup": """SELECT "user", day::varchar AS day, files_accessed,
        files_after_hours, sensitive_files FROM d_file, (SELECT max(date) AS m FROM filelog)
        WHERE day + 1 <= m - INTERVAL 1 DAY""",
}


def _daily_body(table: str) -> str:
    floats = "login_hour_mean login_hour_std after_hours_ratio files_per_session"
    whole = [m for m in MEASURES if m not in (*floats.split(), "session_duration_total")]
    return (f'SELECT "user", day::varchar AS day, {", ".join(whole)}, {_r(floats, 6)}, '
            f"{_r('session_duration_total', 3)}, department, role, day_of_week, is_weekend "
            f"FROM {table}")


def oracle_sql() -> dict[str, str]:
    out = {name: with_ctes(body) for name, body in BODIES.items()}
    out["daily_behavior"] = with_ctes(_daily_body("daily"))
    out["daily_behavior_any_spine"] = with_ctes(_daily_body("daily_any"))
    out["scaled_features"] = with_ctes(
        f'SELECT "user", day::varchar AS day, is_train, {_r(" ".join(NAMES), 4)} FROM scaled')
    out["correlation"] = _correlation()
    out |= _refit()
    return out
