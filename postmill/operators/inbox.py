"""Inbox views: search, pages, action queue, detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


LIST_ITEM = [
    "email_id", "sender_name", "sender_email", "subject", "received_at", "is_analyzed",
    "category_name", "priority_level", "priority_score", "action_required", "intent",
]
ANALYSIS_FIELDS = ["category_name", "priority_level", "priority_score", "action_required", "intent"]
NEWEST_FIRST = ("received_at", "email_id")


def _like(term: str) -> str:
    # "%" and "_" keep their meaning; a backslash is an ordinary character
    return "%" + term.replace("\\", "\\\\") + "%"


def search_inbox(
    emails: DataFrame,
    analysis: DataFrame,
    user_id=None,
    category: str | None = None,
    priority: str | None = None,
    action_required: bool | None = None,
    search: str | None = None,
) -> DataFrame:
    """List items that pass all given filters; of one user, or of all."""
    if user_id is not None:
        emails = emails.filter(F.col("user_id") == user_id)
    if search:
        pattern = _like(search)
        fields = ["subject", "body", "sender_name", "sender_email"]
        found = F.lit(False)
        for field in fields:
            found = found | F.col(field).ilike(pattern)
        emails = emails.filter(found)

    conditions = []
    if category:
        conditions.append(F.col("category_name").ilike(_like(category)))
    if priority:
        conditions.append(F.col("priority_level") == priority.lower())
    if action_required is not None:
        conditions.append(F.col("action_required") == action_required)
    for condition in conditions:
        analysis = analysis.filter(condition)
    # a filter on the analysis drops emails without one
    how = "inner" if conditions else "left"
    return emails.join(analysis.select("email_id", *ANALYSIS_FIELDS), "email_id", how).select("user_id", *LIST_ITEM)


def _check_page(page: int, size: int) -> None:
    if page < 1 or not 1 <= size <= 100:
        raise ValueError("page starts at 1 and page_size is between 1 and 100")


def _newest_first() -> list[Column]:
    return [F.col("received_at").desc(), F.col("email_id")]


def inbox_page(items: DataFrame, page: int = 1, page_size: int = 20, by: str | None = "user_id") -> DataFrame:
    """One page, newest first; of every user (``by``) or of the whole input.

    Pages of users come ordered by user.  There Spark keeps only the leading
    rows of each partition before the exchange as long as the page allows it.
    For a page of the whole input the rows are counted per span of time, in
    finer and finer spans, until those that hold the page are few; only these
    rows are sorted.
    """
    _check_page(page, page_size)
    first, last = (page - 1) * page_size, page * page_size
    order = _newest_first()
    if by is not None:
        rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
        ranked = items.withColumn("_rank", rank).filter(F.col("_rank") <= last).filter(F.col("_rank") > first)
        return ranked.orderBy(by, "_rank").drop("_rank")
    span, before = _span_of_ranks(items, first, last)
    return items.filter(span).orderBy(*order).offset(first - before).limit(page_size)


#: Spans that a page is looked for in, and the number of rows that is few enough to sort.
SPANS, FEW_ROWS = ("day", "hour", "minute", "second"), 10_000


def _span_of_ranks(items: DataFrame, first: int, last: int) -> tuple[Column, int]:
    """A condition for rows that hold the ranks from ``first`` + 1 to ``last`` by descending time, and the rows before them.

    Rows without time come last.
    """
    held, before = F.lit(True), 0
    for unit in SPANS:
        start = F.date_trunc(unit, "received_at")
        counts = items.filter(held).groupBy(start.alias("start")).agg(F.count("*").alias("n"))
        after = F.sum("n").over(Window.orderBy(F.desc_nulls_last("start"))) + before  # one row per span
        ranked = counts.withColumn("to", after).withColumn("from", F.col("to") - F.col("n"))
        hit = ranked.filter((F.col("to") > first) & (F.col("from") < last))
        found = hit.agg(F.min("start").alias("low"), F.max("start").alias("high"), F.min("from").alias("before"), F.sum("n").alias("n"),
                        F.bool_or(F.col("start").isNull()).alias("untimed")).first()
        if found["n"] is None:  # a page behind the end
            return F.lit(False), 0
        inside = F.lit(False) if found["low"] is None else F.col("received_at").between(F.lit(found["low"]), F.lit(found["high"]) + F.expr(f"INTERVAL 1 {unit}") - F.expr("INTERVAL 1 MICROSECOND"))
        held, before = inside | (F.col("received_at").isNull() if found["untimed"] else F.lit(False)), found["before"]
        if found["n"] <= FEW_ROWS:
            break
    return held, before


def page_totals(items: DataFrame, page_size: int = 20) -> DataFrame:
    """Number of rows and pages per user."""
    _check_page(1, page_size)
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / page_size)).cast("long")
    return items.groupBy("user_id").agg(F.count("*").alias("total")).withColumn("total_pages", pages)


def action_queue(items: DataFrame, n: int = 5, by: str = "user_id") -> DataFrame:
    """The newest ``n`` emails of each user that need an action."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*_newest_first()))
    ranked = items.filter("action_required").withColumn("_rank", rank).filter(F.col("_rank") <= n)
    return ranked.orderBy(by, "_rank").drop("_rank")


REPLY_FIELDS = ["current_content", "tone", "status", "is_user_edited"]
DETAIL_ANALYSIS = [
    "category_name", "category_confidence", "intent", "priority_level", "priority_score", "urgency_level",
    "sentiment", "sentiment_score", "action_required", "deadline_text", "key_points", "ai_explanation",
]


def email_detail(emails: DataFrame, analysis: DataFrame, entities: DataFrame, replies: DataFrame) -> DataFrame:
    """Emails with analysis and reply, one row per entity (one row if none).

    Flat on purpose: no group of entities is gathered into one value.
    """
    parts = [c for c in DETAIL_ANALYSIS if c in analysis.columns]
    drafts = replies.select("email_id", *[F.col(c).alias(f"reply_{c}") for c in REPLY_FIELDS if c in replies.columns])
    return (
        emails.join(analysis.select("email_id", *parts), "email_id", "left")
        .join(drafts, "email_id", "left")
        .join(entities.select("email_id", "entity_type", "entity_text", "confidence"), "email_id", "left")
    )


def nested_details(emails: DataFrame, analysis: DataFrame, entities: DataFrame, replies: DataFrame) -> DataFrame:
    """All emails with their analysis, list of entities and reply: one row per email.

    ``analysis`` and ``reply`` are structs, null if there is none; ``entities``
    is an empty array then.  A list is bounded by the text it was taken from.
    Tables stored by ``sinks.write_bucketed`` on the email's id meet where they
    are: no email is moved.
    """
    nested = lambda table, name: table.select("email_id", F.struct(*[c for c in table.columns if c != "email_id"]).alias(name))
    fields = [c for c in ENTITY_FIELDS if c in entities.columns]
    listed = entities.groupBy("email_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("entities"))
    rows = emails.join(nested(analysis, "analysis"), "email_id", "left").join(listed, "email_id", "left").join(nested(replies, "reply"), "email_id", "left")
    return rows.withColumn("entities", F.coalesce("entities", F.array().cast(listed.schema["entities"].dataType)))


ENTITY_FIELDS = ("entity_no", "entity_type", "entity_text", "confidence", "char_position")


def one_email(
    email_id: str, emails: DataFrame, analysis: DataFrame, entities: DataFrame, replies: DataFrame, user_id=None
) -> DataFrame:
    """Nested detail of a single email; empty if it is unknown or not the user's.

    The entity list is null when there are none.  It is bounded by the text of
    the one email it was taken from.
    """
    mine = emails.filter(F.col("email_id") == email_id)
    if user_id is not None:
        mine = mine.filter(F.col("user_id") == user_id)
    here = lambda table: table.filter(F.col("email_id") == email_id)
    nested = lambda table, name: here(table).select(
        "email_id", F.struct(*[c for c in table.columns if c != "email_id"]).alias(name)
    )
    fields = [c for c in ("entity_no", "entity_type", "entity_text", "confidence") if c in entities.columns]
    listed = here(entities).groupBy("email_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("entities"))
    return (
        mine.join(nested(analysis, "analysis"), "email_id", "left")
        .join(listed, "email_id", "left")
        .join(nested(replies, "reply"), "email_id", "left")
    )
