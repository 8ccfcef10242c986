"""Inbox analytics per user: summary, trends, insights."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules
from ..functions.entities import moment
from ..functions.text import round_exact

USER = "user_id"


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, round_exact(part / whole * 100, 1)).otherwise(F.lit(0.0))


def inbox_summary(emails: DataFrame, analysis: DataFrame, replies: DataFrame) -> DataFrame:
    """One row of totals per user."""
    drafted = replies.groupBy("email_id").agg(F.count("*").alias("_replies"))
    rows = (
        emails.select("email_id", USER, "is_analyzed")
        .join(analysis.select("email_id", "priority_level", "priority_score", "action_required"), "email_id", "left")
        .join(drafted, "email_id", "left")
    )
    level = F.col("priority_level")
    totals = rows.groupBy(USER).agg(
        F.count("*").alias("total_emails"),
        F.count_if(level == "high").alias("high_priority"),
        F.count_if(level == "medium").alias("medium_priority"),
        F.count_if(level == "low").alias("low_priority"),
        F.count_if("action_required").alias("action_required"),
        F.count_if("is_analyzed").alias("analyzed"),
        F.coalesce(F.sum("_replies"), F.lit(0)).alias("replies_generated"),
        F.avg("priority_score").alias("_mean"),
    )
    return totals.select(
        *totals.columns[:-1],
        round_exact(F.coalesce("_mean", F.lit(0.0)), 1).alias("avg_priority_score"),
        _percent(F.col("action_required"), F.col("analyzed")).alias("action_required_percentage"),
    )


def trend_daily_volume(emails: DataFrame, as_of: datetime | Column, period: int = 30) -> DataFrame:
    """Emails per user and day in the last ``period`` days, analyzed or not.

    Of a table partitioned by ``received_date`` only those days are read.
    """
    if not 7 <= period <= 365:
        raise ValueError("period must be between 7 and 365 days")
    since = moment(as_of) - F.expr(f"INTERVAL {int(period)} DAYS")
    if "received_date" in emails.columns:
        emails = emails.filter(F.col("received_date") >= F.to_date(since))
    return (
        emails.filter(F.col("received_at") >= since)
        .groupBy(USER, F.date_format("received_at", "yyyy-MM-dd").alias("date"))
        .agg(F.count("*").alias("count"))
        .orderBy(USER, "date")
    )


def _share_of_user(emails: DataFrame, analysis: DataFrame, column: str) -> DataFrame:
    """Count per user and value, with the share of the user's total."""
    counted = (
        emails.select("email_id", USER).join(analysis.select("email_id", column), "email_id")
        .groupBy(USER, column).agg(F.count("*").alias("count"))
    )
    total = F.sum("count").over(Window.partitionBy(USER))  # over the few counted rows
    return counted.withColumn("percentage", _percent(F.col("count"), total))


def trend_category_distribution(emails: DataFrame, analysis: DataFrame) -> DataFrame:
    """Emails per user and category, most frequent first; all time."""
    shares = _share_of_user(emails, analysis, "category_name")
    return shares.select(
        USER, F.coalesce("category_name", F.lit("Other")).alias("category"), "count", "percentage"
    ).orderBy(USER, F.desc("count"), "category")


def trend_priority_distribution(emails: DataFrame, analysis: DataFrame) -> DataFrame:
    """Emails per user and priority level, in the order high, medium, low."""
    shares = _share_of_user(emails, analysis, "priority_level")
    place = F.array_position(F.lit(["high", "medium", "low"]), F.col("level"))
    return shares.select(
        USER, F.coalesce("priority_level", F.lit("unknown")).alias("level"), "count", "percentage"
    ).orderBy(USER, F.when(place > 0, place).otherwise(4), "level")


def _category_means(emails: DataFrame, analysis: DataFrame) -> DataFrame:
    return (
        emails.select("email_id", USER).join(analysis.select("email_id", "category_name", "priority_score"), "email_id")
        .groupBy(USER, "category_name").agg(F.avg("priority_score").alias("_mean"))
        .select(USER, F.coalesce("category_name", F.lit("Other")).alias("category"), "_mean")
    )


def trend_avg_priority(emails: DataFrame, analysis: DataFrame) -> DataFrame:
    """Mean priority per user and category, highest (unrounded) mean first."""
    means = _category_means(emails, analysis).orderBy(USER, F.desc_nulls_last("_mean"), "category")
    return means.select(USER, "category", round_exact(F.coalesce("_mean", F.lit(0.0)), 1).alias("avg_priority"))


def top_categories(emails: DataFrame, analysis: DataFrame, n: int = 8) -> DataFrame:
    """The ``n`` most frequent categories of each user."""
    counted = (
        emails.select("email_id", USER).join(analysis.select("email_id", "category_name"), "email_id")
        .groupBy(USER, "category_name").agg(F.count("*").alias("count"))
        .select(USER, F.coalesce("category_name", F.lit("Other")).alias("category"), "count")
    )
    rank = F.row_number().over(Window.partitionBy(USER).orderBy(F.desc("count"), "category"))
    return counted.withColumn("_rank", rank).filter(F.col("_rank") <= n).orderBy(USER, "_rank").drop("_rank")


def inbox_insights(
    emails: DataFrame, analysis: DataFrame, replies: DataFrame, users: DataFrame | None = None
) -> DataFrame:
    """Ordered insight sentences per user: ``(user_id, seq, insight, type)``.

    Emails and analysis are joined and grouped once, by user and category; the
    summary and both category rankings come from those few rows.  ``users``
    adds the users without any email.
    """
    drafted = replies.groupBy("email_id").agg(F.count("*").alias("_replies"))
    rows = (
        emails.select("email_id", USER, "is_analyzed")
        .join(
            analysis.select("email_id", "category_name", "priority_level", "priority_score", "action_required")
            .withColumn("_joined", F.lit(True)),
            "email_id", "left",
        )
        .join(drafted, "email_id", "left")
    )
    groups = rows.groupBy(USER, "_joined", "category_name").agg(
        F.count("*").alias("_n"),
        F.count_if("is_analyzed").alias("_analyzed"),
        F.count_if(F.col("priority_level") == "high").alias("_high"),
        F.count_if("action_required").alias("_action"),
        F.sum("priority_score").alias("_score"),
        F.count("priority_score").alias("_scored"),
        F.sum("_replies").alias("_replies"),
    ).withColumns({
        "category": F.coalesce("category_name", F.lit("Other")),
        "_mean": F.col("_score") / F.nullif("_scored", F.lit(0)),
    })
    joined = F.col("_joined").isNotNull()
    per_user = groups.groupBy(USER).agg(
        F.sum("_n").alias("total"),
        F.sum("_analyzed").alias("analyzed"),
        F.sum("_high").alias("high"),
        F.sum("_action").alias("action"),
        F.coalesce(F.sum("_replies"), F.lit(0)).alias("replies"),
        (F.sum("_score") / F.nullif(F.sum("_scored"), F.lit(0))).alias("mean"),
        F.sum(F.when(joined, F.col("_n"))).alias("joined"),
        F.min(F.when(joined, F.struct((-F.col("_n")).alias("n"), "category"))).alias("frequent"),
        F.min(
            F.when(joined, F.struct(F.coalesce(-F.col("_mean"), F.lit(1.0)).alias("order"), "category", "_mean"))
        ).alias("important"),
    )
    if users is not None:
        per_user = users.select(USER).join(per_user, USER, "left")

    def filled(sentence: str, **values: Column) -> Column:
        out = F.lit(sentence)
        for name, value in values.items():
            out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
        return out

    row = lambda kind, sentence: F.struct(sentence.alias("insight"), F.lit(kind).alias("type"))
    counted = lambda forms, n: F.when(n > 1, filled(forms[1], n=n)).otherwise(filled(forms[0], n=n))
    mean = round_exact(F.coalesce("mean", F.lit(0.0)), 1)
    share = _percent(-F.col("frequent.n"), F.col("joined"))
    rate = round_exact(F.col("replies") / F.nullif("analyzed", F.lit(0)) * 100, 0).cast("long")
    best = round_exact(F.coalesce("important._mean", F.lit(0.0)), 1)
    action, high = F.col("action"), F.col("high")
    sentences = F.array_compact(F.array(
        F.when(action > 0, row("warning", counted(rules.INSIGHT_ACTION, action))),
        F.when(high > 0, row("warning", counted(rules.INSIGHT_HIGH, high))),
        F.when(F.col("frequent").isNotNull(), row("info", filled(
            rules.INSIGHT_FREQUENT, share=share, category=F.col("frequent.category")))),
        F.when(F.col("important").isNotNull(), row("info", filled(
            rules.INSIGHT_IMPORTANT, mean=best, category=F.col("important.category")))),
        F.when(mean > 65, row("warning", filled(rules.INSIGHT_ABOVE, mean=mean)))
        .when(mean < 35, row("info", filled(rules.INSIGHT_BELOW, mean=mean))),
        F.when(F.col("analyzed") > 0, row("info", filled(rules.INSIGHT_REPLIES, rate=rate))),
    ))
    nothing = F.array(row("info", F.lit(rules.INSIGHT_NOTHING)))
    return per_user.select(
        USER, F.posexplode(F.when(F.col("total") > 0, sentences).otherwise(nothing)).alias("_seq", "_row")
    ).select(USER, (F.col("_seq") + 1).alias("seq"), "_row.insight", "_row.type")
