"""Batch job: validate analyzed emails and aggregate them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ANALYZED_EMAILS

REQUIRED = ANALYZED_EMAILS.fieldNames()
LEVELS = ["low", "medium", "high"]
SENTIMENTS = ["positive", "neutral", "negative"]


def _text(raw: Column) -> Column:
    return F.trim(raw.cast("string"))


def _keyword(raw: Column) -> Column:
    return F.lower(_text(raw))


def _filled(value: Column) -> Column:
    return value != ""


def _any(value: Column) -> Column:
    return value.isNotNull()


#: Of each column: its typed value, and what the value must fulfil.
RULES = {
    "email_id": (_text, _filled),
    "received_at": (lambda raw: F.try_to_timestamp(raw).cast("timestamp"), _any),
    "category": (_text, _filled),
    "priority_score": (lambda raw: raw.try_cast("double"), lambda value: (value >= 0) & (value <= 100)),  # NaN is above all numbers
    "priority_level": (_keyword, lambda value: value.isin(LEVELS)),
    "sentiment": (_keyword, lambda value: value.isin(SENTIMENTS)),
    "action_required": (lambda raw: raw.try_cast("boolean"), _any),
    "intent": (_text, _filled),
}


def analyzed_emails(emails: DataFrame, analysis: DataFrame) -> DataFrame:
    """The batch input: emails that have an analysis, all users."""
    return emails.select("email_id", "received_at").join(
        analysis.select(
            "email_id", F.col("category_name").alias("category"), "priority_score",
            "priority_level", "sentiment", "action_required", "intent",
        ),
        "email_id",
    )


def _check_columns(df: DataFrame) -> None:
    absent = [name for name in sorted(RULES) if name not in df.columns]
    if absent:
        raise ValueError("no column " + ", ".join(absent))


def judged_emails(df: DataFrame) -> DataFrame:
    """Input rows as ``raw``, their typed values as ``typed``, and ``reject_reason``.

    The reason names the first column, in the order of the contract, that is
    missing or does not fulfil its rule; it is null for valid rows.
    """
    _check_columns(df)
    typed = F.struct(*(convert(F.col(name)).alias(name) for name, (convert, _) in RULES.items()))
    judged = df.select(F.struct(*df.columns).alias("raw"), typed.alias("typed"))
    broken = [F.when(~F.coalesce(holds(F.col(f"typed.{name}")), F.lit(False)), F.lit(name)) for name, (_, holds) in RULES.items()]
    return judged.withColumn("reject_reason", F.coalesce(*broken))


def clean_emails(df: DataFrame) -> DataFrame:
    """Valid rows with typed columns and ``received_date``; further columns stay as they are.

    Plain columns, so that a job's scan and its rows hold no more than it uses.
    """
    _check_columns(df)
    typed = df.select(*(RULES[c][0](F.col(c)).alias(c) if c in RULES else F.col(c) for c in df.columns))
    valid = typed.where(reduce(lambda x, y: x & y, (holds(F.col(name)) for name, (_, holds) in RULES.items())))
    return valid.withColumn("received_date", F.to_date("received_at"))



def rejected_emails(df: DataFrame) -> DataFrame:
    """The rows that :func:`clean_emails` leaves out, as they came in, with ``reject_reason``."""
    return judged_emails(df).where("reject_reason IS NOT NULL").select("raw.*", "reject_reason")


AGGREGATES = {
    "daily_email_volume": ("received_date", "email_count"),
    "category_distribution": ("category", "email_count"),
    "priority_distribution": ("priority_level", "email_count"),
    "average_priority_by_category": ("category", "average_priority_score"),
    "sentiment_distribution": ("sentiment", "email_count"),
}


def aggregate_batch(df: DataFrame) -> dict[str, DataFrame]:
    """The six aggregates of the cleaned input, each its own lazy plan."""
    cleaned = clean_emails(df)
    results = {}
    for name, (key, measure) in AGGREGATES.items():
        value = F.count("email_id") if measure == "email_count" else F.avg("priority_score")
        results[name] = cleaned.groupBy(key).agg(value.alias(measure))
    results["action_required_count"] = cleaned.agg(
        F.count_if("action_required").alias("action_required_count")
    )
    return results


def email_cube(df: DataFrame) -> DataFrame:
    """All aggregates in one scan and one small shuffle, by grouping sets.

    ``dimension`` names the grouping and ``key`` its value as text; the total
    has the dimension ``all``.
    """
    dimensions = ["received_date", "category", "priority_level", "sentiment"]
    cleaned = clean_emails(df)
    sets = [[name] for name in dimensions] + [[]]
    grouped = cleaned.groupingSets(sets, *dimensions).agg(
        F.count("email_id").alias("email_count"),
        F.avg("priority_score").alias("average_priority_score"),
        F.count_if("action_required").alias("action_required_count"),
        *[F.grouping(name).alias(f"_no_{name}") for name in dimensions],
    )
    dimension = F.lit("all")
    key = F.lit(None).cast("string")
    for name in dimensions:
        present = F.col(f"_no_{name}") == 0
        dimension = F.when(present, name).otherwise(dimension)
        key = F.when(present, F.col(name).cast("string")).otherwise(key)
    return grouped.select(
        dimension.alias("dimension"), key.alias("key"),
        "email_count", "average_priority_score", "action_required_count",
    )


def from_cube(cube: DataFrame) -> dict[str, DataFrame]:
    """The six aggregates cut out of a computed cube."""
    results = {}
    for name, (key, measure) in AGGREGATES.items():
        value = F.col("key").cast("date") if key == "received_date" else F.col("key")
        results[name] = cube.filter(F.col("dimension") == key).select(value.alias(key), measure)
    results["action_required_count"] = cube.filter(F.col("dimension") == "all").select("action_required_count")
    return results
