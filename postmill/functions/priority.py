"""The eight priority signals and the score built from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rules
from .entities import moment
from .matching import IGNORE_CASE, holds_any, may_hold
from .sql import first_of, map_of, text_literal
from .words import SIGNALS, Seen


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """Value of a small literal table, or the default."""
    value = F.try_element_at(F.expr(map_of(table)), key)
    return value if default is None else F.coalesce(value, default)


def lowered_for_signals(seen: Seen, raw: str) -> Column:
    """The text in lower case where a signal may match; null where no pattern reads it."""
    return F.when(F.expr(may_hold(seen, SIGNALS)), F.lower(raw))


def action_detected(seen: Seen, lowered: str) -> Column:
    return F.expr(holds_any(seen, lowered, rules.ACTION_PATTERNS))


def from_organization(sender: Column) -> Column:
    """An organization's domain; only the free mail providers are excluded."""
    return F.coalesce(
        F.contains(sender, F.lit("@")) & sender.rlike(IGNORE_CASE + rules.ORGANIZATION_SENDER), F.lit(False)
    )


def _tiers(condition_points_reasons: list[tuple[Column, int, str]]) -> tuple[Column, Column]:
    """First tier that holds, as a points column and a reason column."""
    points = reason = None
    for condition, value, text in condition_points_reasons:
        points = F.when(condition, value) if points is None else points.when(condition, value)
        reason = F.when(condition, F.lit(text)) if reason is None else reason.when(condition, F.lit(text))
    return points, reason


def add_priority(
    df: DataFrame,
    lowered: str,
    seen: Seen,
    slug: str,
    sender: str,
    as_of: datetime | Column,
    action: str | None = None,
    deadline_text: str | None = None,
    deadline_time: str | None = None,
) -> DataFrame:
    """Add factors, reasons, score, level, urgency and the action flag.

    ``lowered`` is the lower-cased raw subject and body (``lowered_for_signals``), ``seen`` its words.  ``action``,
    ``deadline_text`` and ``deadline_time`` are optional columns with what is
    already known; a null there means "not known" and the text decides.
    """
    known_action = F.col(action) if action else F.lit(None).cast("boolean")
    known_text = F.col(deadline_text) if deadline_text else F.lit(None).cast("string")
    known_time = F.col(deadline_time) if deadline_time else F.lit(None).cast("timestamp")

    hours = (F.unix_micros(known_time) - F.unix_micros(moment(as_of))) / F.lit(3_600_000_000)
    tiers = first_of(
        (holds_any(seen, lowered, patterns), str(number))
        for number, (patterns, _, _) in enumerate(rules.DEADLINE_TIERS)
    )
    urgent = ", ".join(f"CASE WHEN {seen.any([w])} THEN {text_literal(w)} END" for w in rules.URGENCY_WORDS)
    flagged = lambda patterns: F.expr(holds_any(seen, lowered, patterns))

    # first projection: everything that scans the text, each computed once
    df = df.withColumns({
        "_urgent": F.expr(f"array_compact(array({urgent}))"),
        "_tier": F.when(known_time.isNull(), F.expr(tiers)),
        "_hours": hours,
        "_detected": F.when(known_action.isNull(), action_detected(seen, lowered)),
        "_event": flagged(rules.EVENT_PATTERNS),
        "_security": flagged(rules.SECURITY_PATTERNS),
        "_pressing": flagged(rules.TIME_SENSITIVE_PATTERNS),
        "_organization": from_organization(F.col(sender)),
    })

    by_date = _tiers([
        (F.lit(True) if limit is None else F.col("_hours") <= limit, points, reason)
        for limit, points, reason in rules.DEADLINE_HOURS
    ])
    by_text = _tiers([
        (F.col("_tier") == number, points, reason)
        for number, (_, points, reason) in enumerate(rules.DEADLINE_TIERS)
    ])
    dated = known_time.isNotNull()
    zero = F.lit(0)
    flag = lambda name, points: F.when(F.col(name), points).otherwise(zero)
    points = [
        F.least(F.size("_urgent") * rules.URGENCY_POINTS_EACH, F.lit(rules.URGENCY_POINTS_MAX)),
        F.coalesce(F.when(dated, by_date[0]).otherwise(by_text[0]), zero),
        F.when(F.coalesce(known_action, F.col("_detected")), rules.ACTION_POINTS).otherwise(zero),
        lookup(F.col(slug), rules.CATEGORY_POINTS, F.lit(rules.DEFAULT_CATEGORY_POINTS)),
        flag("_event", rules.FLAG_POINTS),
        flag("_security", rules.FLAG_POINTS),
        flag("_pressing", rules.FLAG_POINTS),
        flag("_organization", rules.SENDER_POINTS),
    ]
    reasons = [
        F.when(F.size("_urgent") > 0, F.concat(F.lit(rules.URGENCY_REASON + "'"), F.get("_urgent", F.lit(0)), F.lit("'"))),
        F.coalesce(
            F.when(dated, by_date[1]).otherwise(by_text[1]),
            F.when(known_text != "", F.concat(F.lit(rules.DEADLINE_MENTIONED), known_text)),
        ),
        F.when(known_action, F.lit(rules.ACTION_REASON_GIVEN)).when(
            F.col("_detected"), F.lit(rules.ACTION_REASON_DETECTED)
        ),
        lookup(F.col(slug), rules.CATEGORY_REASONS),
        F.when(F.col("_event"), F.lit(rules.EVENT_REASON)),
        F.when(F.col("_security"), F.lit(rules.SECURITY_REASON)),
        F.when(F.col("_pressing"), F.lit(rules.TIME_SENSITIVE_REASON)),
        F.when(F.col("_organization"), F.lit(rules.SENDER_REASON)),
    ]
    df = df.withColumns({
        "priority_factors": F.struct(*[p.cast("int").alias(n) for p, n in zip(points, rules.FACTORS)]),
        "ai_explanation": F.array_compact(F.array(*reasons)),
        "_action": F.coalesce(known_action, F.col("_detected")),
    })
    total = sum((F.col(f"priority_factors.{name}") for name in rules.FACTORS[1:]), F.col(f"priority_factors.{rules.FACTORS[0]}"))
    df = df.withColumn("priority_score", F.least(total, F.lit(rules.SCORE_MAX)))
    score = F.col("priority_score")
    df = df.withColumns({
        "priority_level": F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low"),
        "urgency_level": F.when(score >= 90, "critical")
        .when((score >= 70) | score.between(55, 69), "elevated")
        .otherwise("normal"),
        "action_required": F.col("_action") | ((score >= 70) & F.col("_event")),
    })
    return df.drop("_urgent", "_tier", "_hours", "_detected", "_event", "_security", "_pressing", "_organization", "_action")


def factors_json(factors: Column) -> Column:
    """The factors as a JSON object of whole numbers, with a blank after each comma and colon, in their order."""
    pairs = [F.concat(F.lit(f'"{name}": '), factors[name].cast("string")) for name in rules.FACTORS]
    return F.when(factors.isNotNull(), F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}")))


def factors_from_json(text: Column) -> Column:
    """The factors of such a text; null if it is none."""
    return F.from_json(text, ", ".join(f"{name} int" for name in rules.FACTORS))
