"""Bulk enrichment: emails to analysis rows and entity rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.entities import add_entities, add_relative_deadline, entity_deadline, moment
from ..functions import intent as intents
from ..functions.priority import action_detected, add_priority, lowered_for_signals
from ..functions.words import Seen, add_seen, drop_seen
from .classify import add_keyword_category
from .sentiment import score_sentiment


def _raw(subject: str = "subject", body: str = "body") -> Column:
    return F.concat(F.coalesce(subject, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))


def clean_corpus(df: DataFrame, columns: dict[str, str], unterminated: bool = True) -> DataFrame:
    """Add cleaned copies of any text columns.

    ``unterminated`` decodes references without semicolon too, as browsers do;
    without it a text cut within a reference keeps what is left of it.
    """
    return text.add_clean_text(df, columns, unterminated=unterminated)


def _decoded(emails: DataFrame) -> DataFrame:
    """Add ``_subject`` and ``_body`` without nulls and HTML entities, and both as ``_both``."""
    df = emails.withColumns({"_subject": F.coalesce("subject", F.lit("")), "_body": F.coalesce("body", F.lit(""))})
    df = df.withColumns({name: text.decode_entities(F.col(name)) for name in ("_subject", "_body")})
    return df.withColumn("_both", F.concat("_subject", F.lit("\n\n"), "_body"))


def add_entity_text(emails: DataFrame) -> DataFrame:
    """Add ``entity_text``."""
    return text.add_entity_text(_decoded(emails), "_both", "entity_text").drop("_subject", "_body", "_both")


def add_text_variants(emails: DataFrame) -> DataFrame:
    """Add ``body_clean``, ``classification_text`` and ``entity_text``."""
    df = text.add_entity_text(_decoded(emails), "_both", "entity_text")
    df = text.add_clean_text(df, {"_subject": "_subject_clean", "_body": "body_clean"}, decoded=True)
    return df.withColumn(
        "classification_text", text.classification_text(F.col("_subject_clean"), F.col("body_clean"))
    ).drop("_subject", "_body", "_both", "_subject_clean")


def extract_entities(emails: DataFrame) -> DataFrame:
    """One row per entity of each email, numbered in extraction order."""
    df = add_entity_text(emails).select("email_id", "entity_text")
    df = add_seen(df, {"entity_text": "_words"})
    return entity_rows(add_entities(df, "entity_text", Seen("_words")))


def entity_rows(df: DataFrame) -> DataFrame:
    """Explode an ``entities`` array into rows.

    The outer form is deliberate: for the inner one the optimizer adds a filter
    on the array's size and pushes it, extraction included, down to the scan,
    so that every text would be searched twice.
    """
    return df.select("email_id", F.posexplode_outer("entities").alias("entity_no", "e")).filter("e is not null").select(
        "email_id", "entity_no", "e.entity_type", "e.entity_text", "e.confidence", "e.char_position"
    )


def distinct_entities(entities: DataFrame) -> DataFrame:
    """First occurrence of each (type, text ignoring case) in an email; known types only."""
    trimmed = F.regexp_replace("entity_text", f"(?U)^{text.SPACE}+|{text.SPACE}+$", "")
    return (
        entities.filter(F.col("entity_type").isin(rules.ENTITY_TYPES))
        .withColumn("_text", trimmed)
        .groupBy("email_id", "entity_type", F.lower("_text").alias("_key"))
        .agg(F.min_by(F.struct("_text", "confidence", "char_position"), F.struct("char_position", "entity_no")).alias("e"))
        .select("email_id", "entity_type", F.col("e._text").alias("entity_text"), "e.confidence", "e.char_position")
    )


def add_deadline(emails: DataFrame, as_of: datetime | Column) -> DataFrame:
    """Add ``deadline_text`` and ``deadline_datetime`` of the relative deadline."""
    df = add_seen(add_entity_text(emails), {"entity_text": "_words"})
    return drop_seen(add_relative_deadline(df, "entity_text", Seen("_words"), as_of), "_words")


def add_intent(emails: DataFrame, slug: str = "slug") -> DataFrame:
    """Add the intent of each email."""
    df = add_seen(emails.withColumn("_raw", _raw()), {"_raw": "_words"})
    return drop_seen(intents.add_intent(df, "_raw", Seen("_words"), slug), "_words").drop("_raw")


def score_priority(
    emails: DataFrame,
    as_of: datetime | Column,
    slug: str = "slug",
    action: str | None = None,
    deadline_text: str | None = None,
    deadline_time: str | None = None,
) -> DataFrame:
    """Add priority score, level, urgency, action flag, reasons and factors."""
    df, seen = add_seen(emails.withColumn("_raw", _raw()), {"_raw": "_words"}, signals_only=True), Seen("_words")
    df = df.withColumn("_lowered", lowered_for_signals(seen, "_raw"))
    df = add_priority(
        df, "_lowered", seen, slug, "sender_email", as_of, action, deadline_text, deadline_time
    )
    return drop_seen(df, "_words").drop("_raw", "_lowered")


def key_points(entities: Column) -> Column:
    """Short facts about an analyzed email, in a fixed order."""

    def mentioned(kind: str, label: str) -> Column:
        names = F.slice(F.transform(F.filter(entities, lambda e: e["entity_type"] == kind), lambda e: e["entity_text"]), 1, 2)
        return F.when(F.size(names) > 0, F.concat(F.lit(label), F.array_join(names, ", ")))

    return F.array_compact(F.array(
        F.when(F.col("intent") != rules.DEFAULT_INTENT, F.concat(F.lit(rules.POINT_INTENT), "intent")),
        F.when(F.col("deadline_text") != "", F.concat(F.lit(rules.POINT_DEADLINE), "deadline_text")),
        F.when(F.col("action_required"), F.lit(rules.POINT_ACTION)),
        F.when(F.col("sentiment") == "negative", F.lit(rules.POINT_NEGATIVE)),
        F.when(F.col("sentiment") == "positive", F.lit(rules.POINT_POSITIVE)),
        mentioned("ORG", rules.POINT_ORGANIZATION),
        mentioned("PERSON", rules.POINT_PERSON),
    ))


def enrich_rows(
    emails: DataFrame,
    as_of: datetime | Column,
    classify=None,
    lexicon: DataFrame | None = None,
    sentiment_chars: int | None = None,
) -> DataFrame:
    """Emails with every analysis column and the ``entities`` array.

    Everything happens inside the row: no shuffle.  Only the sentiment by a
    large lexicon joins words; without a lexicon all mail is neutral.
    ``classify`` adds ``category_name``, ``slug`` and ``category_confidence``
    from ``classification_text``; the default is the keyword classifier.
    """
    if lexicon is None:
        df = emails.withColumns({"sentiment": F.lit("neutral"), "sentiment_score": F.lit(0.0)})
    else:
        df = score_sentiment(emails, lexicon, "email_id", "body", sentiment_chars)
    df = add_text_variants(df).withColumn("_raw", _raw())
    df = add_seen(df, {"_raw": "_w", "classification_text": "_w_class", "entity_text": "_w_entity"})
    raw, of_class, of_entity = Seen("_w"), Seen("_w_class"), Seen("_w_entity")
    df = add_entities(df, "entity_text", of_entity)
    df = add_relative_deadline(df, "entity_text", of_entity, as_of, "_relative", "deadline_datetime")
    df = df.withColumns({
        "deadline_text": F.coalesce("_relative", entity_deadline(F.col("entities"))),
        "_lowered": lowered_for_signals(raw, "_raw"),
    })
    df = add_keyword_category(df, seen=of_class) if classify is None else classify(df)
    df = intents.add_intent(df, "_raw", raw, "slug")
    df = df.withColumn("_wanted", action_detected(raw, "_lowered"))
    df = add_priority(df, "_lowered", raw, "slug", "sender_email", as_of, "_wanted", "deadline_text", "deadline_datetime")
    df = df.withColumns({
        "key_points": key_points(F.col("entities")),
        "analyzed_at": moment(as_of),
    })
    return drop_seen(df, "_w", "_w_class", "_w_entity").drop("_relative", "_raw", "_lowered", "_wanted")


ANALYSIS_COLUMNS = [
    "email_id", "category_name", "category_confidence", "intent", "priority_level", "priority_score",
    "urgency_level", "sentiment", "sentiment_score", "action_required", "deadline_text", "deadline_datetime",
    "key_points", "ai_explanation", "priority_factors", "analyzed_at",
]


def enrich_emails(emails: DataFrame, as_of: datetime | Column, **options) -> tuple[DataFrame, DataFrame]:
    """Analysis rows and entity rows of all given emails.

    To write both from one pass, write :func:`enrich_rows` once and take the
    two tables from that (``analysis_rows``, ``entity_rows``).
    """
    rows = enrich_rows(emails, as_of, **options)
    return analysis_rows(rows), entity_rows(rows)


def analysis_rows(rows: DataFrame) -> DataFrame:
    return rows.select(*ANALYSIS_COLUMNS)
