"""Scalar rules as Column expressions (all stay inside code generation)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from daywatch.params import TIER_COLORS, Params


def normalise_header(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def column_or(df: DataFrame, name: str, default: Column) -> Column:
    """The named column, or `default` when the source does not carry it."""
    return F.col(f"`{name}`") if name in df.columns else default


def parse_timestamp(col: Column, formats: tuple[str, ...]) -> Column:
    """First format that fits, then ISO; null when nothing fits (never raises)."""
    tries = [F.try_to_timestamp(col, F.lit(f)) for f in formats]
    return F.coalesce(*tries, F.try_to_timestamp(col))


def is_after_hours(hour: Column, p: Params) -> Column:
    return ~hour.between(p.business_start, p.business_end - 1)


def is_sensitive(filename: Column, p: Params) -> Column:
    return F.coalesce(filename.rlike(f"(?i)({p.sensitive_pattern})"), F.lit(False))


def is_external(recipients: Column, p: Params) -> Column:
    """True unless some `;`-separated address lies in an internal domain."""
    internal = F.exists(
        F.split(recipients, ";"),
        lambda a: F.substring_index(F.trim(a), "@", -1).isin(*p.internal_domains))
    return ~F.coalesce(internal, F.lit(False))


def attachment_count(raw: Column) -> Column:
    """Numeric text truncated to an integer, anything else 0."""
    number = F.nanvl(raw.try_cast("double"), F.lit(0.0))
    return F.coalesce(number.try_cast("bigint"), F.lit(0).cast("bigint"))


def ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def finite(col: Column) -> Column:
    """Null for NaN and infinities, which Spark aggregates would propagate."""
    x = col.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def clip(col: Column, low: float, high: float) -> Column:
    # greatest and least skip nulls, so a null needs its own branch
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def ensemble(if_score: Column, ae_score: Column, p: Params) -> Column:
    total = p.weight_iforest + p.weight_recon
    mix = F.lit(p.weight_iforest) * if_score + F.lit(p.weight_recon) * ae_score
    return clip(mix / F.lit(total), 0.0, 100.0)


def _ladder(score: Column, steps: list[tuple[float, str]]) -> Column:
    head = F.when(score >= steps[0][0], F.lit(steps[0][1]))
    return reduce(lambda c, s: c.when(score >= s[0], F.lit(s[1])), steps[1:], head
                  ).otherwise(F.lit("NORMAL"))


def tier(score: Column, p: Params) -> Column:
    return _ladder(score, [(p.tier_critical, "CRITICAL"), (p.tier_high, "HIGH"),
                           (p.tier_medium, "MEDIUM"), (p.tier_low, "LOW")])


def dept_tier(score: Column, p: Params) -> Column:
    return _ladder(score, [(p.dept_critical, "CRITICAL"), (p.dept_high, "HIGH"),
                           (p.dept_medium, "MEDIUM"), (p.dept_low, "LOW")])


def tier_color(tier_col: Column) -> Column:
    pairs = [F.lit(x) for kv in TIER_COLORS.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[tier_col], F.lit("#666"))


def alert_message(score: Column, user: Column, p: Params) -> Column:
    # The wording of each step.
    return (
        F.when(score >= p.tier_critical, F.concat(
            F.lit("CRITICAL: "), user, F.lit(" exhibits extreme behavioral anomaly. "
                                             "Immediate investigation required.")))
        .when(score >= p.tier_high, F.concat(
            F.lit("HIGH RISK: "), user, F.lit(" shows significant deviation from baseline. "
                                              "Escalate to security team.")))
        .when(score >= p.tier_medium, F.concat(
            F.lit("MEDIUM: "), user, F.lit(" has notable behavioral changes. Schedule review.")))
        .otherwise(F.concat(F.lit("LOW: "), user, F.lit(" shows minor behavioral deviation.")))
    )


def rising_message(user: Column) -> Column:
    # Fixed value: the wording.
    return F.concat(F.lit("User "), user,
                    F.lit(" shows escalating risk trend over past 14 days."))


def alert_id(number: Column) -> Column:
    """ALT- and at least five digits; longer numbers keep all their digits."""
    digits = number.cast("string")
    return F.concat(F.lit("ALT-"),
                    F.when(F.length(digits) >= 5, digits).otherwise(F.lpad(digits, 5, "0")))


def contains_any(cols: list[str], text: str) -> Column:
    """Case-insensitive substring search over several columns."""
    hits = [F.coalesce(F.lower(F.col(c)).contains(text.lower()), F.lit(False)) for c in cols]
    return reduce(lambda a, b: a | b, hits)
