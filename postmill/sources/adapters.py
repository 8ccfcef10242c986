"""Email tables derived by Spark from the generic star-schema test tables.

Every table grows with its source: emails with ``events`` and ``documents``,
replies with ``conversations``, users with ``customer``.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.priority import lookup
from .readers import small_table

AS_OF = datetime(2024, 1, 31, tzinfo=timezone.utc)

#: (k, subject, body, sender address, category slug): joined to the invented
#: prose, which would hardly trigger any rule on its own
WRITTEN = [
    (0, "Interview scheduled tomorrow", "Please confirm your slot for the interview.", "hr@acme.com", "job_career"),
    (1, "URGENT security alert", "Unauthorized access detected. Verify your account immediately.",
     "alerts@mybank.com", "finance_banking"),
    (2, "Weekly digest", "Our newsletter brings a coupon for you.", None, "promotions_marketing"),
    (3, "URGENT: interview scheduled today", "Please respond asap. Final notice, account blocked.",
     "hr@acme.com", "job_career"),
    (4, "Project status", "Please send the project status in two days.", None, "work_professional"),
    (5, "Invoice due", "Payment due by Friday. Only 3 days left.", "billing@shop.org", "finance_banking"),
    (6, "Hello", "Thanks for the note.", "a@gmail.com", "other"),
    (7, "Order &amp; delivery",
     "<p>Your order has <b>shipped</b>. Total $1,200.00, arriving 03/05/2025 at 10:00 am.</p>",
     None, "ecommerce_shopping"),
]
#: Texts for the signals whose patterns are more than words in order, and texts that just miss one.
SIGNALS = [
    "It is due by end of day.", "Send it by EOD please.", "We close by close of business.", "Upload it before midnight.", "Within 24 hours.",
    "The day after tomorrow at the latest.", "You have within 48 hours.", "It ends in 2 days.", "It ends in two days.", "Sometime this week.",
    "Come within a week.", "Pay by Monday.", "Pay before Saturday.", "Reply by March 12.", "It is due on arrival.", "It is due before noon.",
    "Please respond.", "Please let us know.", "This requires your approval.", "It requires a response.", "Action required.", "Respond by mail.",
    "Your confirmation is needed.", "Your reply is requested.", "Kindly submit the form.", "I am requesting for a sick leave.", "I requested leave.",
    "Grant me the leave.", "Approve my sick leave.", "We are waiting for your reply.", "Verify the details.", "Please validate this.",
    "The exam is scheduled.", "Meeting confirmed.", "A scheduled appointment.", "See you at 5 pm.", "Be there on 11:30 am.", "The meeting starts at 14:05.",
    "Tomorrow we have an interview.", "There was unusual login.", "Your account locked.", "A suspicious transaction.", "Verification account.",
    "Verify your identity.", "It expires tonight.", "Only 12 hours left.", "Last chance.", "Limited time.", "Don't miss it.", "Final reminder.",
    "This is overdue.", "Send it by tomorrow.", "A suspicious login.", "Seen yesterday, on Sunday and on 7-8-24.", "Signed Sept 3rd, 2024 and dec 12 2023.", "At 9:15pm or 7 am.",
    "It costs $5, ₹1,20,000.50 or £30.00.", "Kindly review the draft by Friday.", "Please provide the list within a day.", "Please approve it...",
    "please submit THE REPORT in time", "Time-sensitive: prompt answer without delay, right away, as soon as possible.",
]
NEAR = [
    "The todays and tomorrows.", "It is by the end of daytime.", "Within 480 hours.", "It ends in 22 days.", "By sundays.", "By mondayish.",
    "Pleases confirm.", "Action is required.", "Kindlysubmit it.", "Verify identities.", "Leave granted.", "Examscheduled.", "See you at 555 pm.",
    "Unauthorizedly accessing.", "Accounting blocked.", "Expired by nobody.", "Only some days left.", "Lastly chances.", "Dont miss.", "Overdues.",
    "On 1/2/3 or 123/4/2024.", "Mayor 5 2024, june 2024.", "At 9:1 or 12:345.", "It costs $ or 5$.", "Interviews, projects, bankers, examples.",
    "Unsuccess is no success.", "Eticket, cofee, lunches.", "Nourgent, uncritical.", "Sender at x@acme.community.",
]
_SENDERS = [None, "hr@acme.com", "a@gmail.com", "b@mail.org", "office@city.gov", "C@ACME.COM", "info@yahoo.net", "x@9to5.com", "news@shop.co", ""]


def _alternatives(pattern: str) -> list[str]:
    """A text for each alternative of a pattern of words, "." and ".*"."""
    return [part.replace(".*", " we say ").replace(".", " ") for part in pattern.split("|")]


def _all_phrases() -> list[tuple]:
    """The written phrases, then one for every alternative of every rule, each in turn with another sender and category."""
    texts = [text for pattern, _, _ in rules.INTENTS for text in _alternatives(pattern)]
    texts += [f"About {word} only." for words in rules.CATEGORY_KEYWORDS.values() for word in words]
    texts += ["All of " + ", ".join(words) for words in rules.CATEGORY_KEYWORDS.values()]
    texts += [f"The {word} again" for pattern, _, _ in rules.CATEGORY_HINTS for word in pattern[3:-3].split("|")]
    texts += [f"It is {word}." for word in rules.URGENCY_WORDS]
    texts += SIGNALS + NEAR + [text.upper() for text in SIGNALS[::3]]
    slugs = [slug for _, slug, _, _ in rules.CATEGORIES]
    made = [("Note" if n % 3 else text, text + "\n" if n % 4 else text, _SENDERS[n % len(_SENDERS)], slugs[n % len(slugs)]) for n, text in enumerate(texts)]
    return WRITTEN + [(len(WRITTEN) + n, *row) for n, row in enumerate(made)]


PHRASES = _all_phrases()
NAMES = {slug: name for name, slug, _, _ in rules.CATEGORIES}

#: (word, valence): a small lexicon for the sentiment job
LEXICON = [
    ("please", 1.3), ("thanks", 1.9), ("confirm", 0.5), ("interview", 0.4), ("newsletter", 0.2),
    ("urgent", -0.8), ("unauthorized", -1.7), ("blocked", -1.5), ("alert", -0.6), ("final", -0.3), ("due", -0.9),
]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _utc(column: str) -> Column:
    return F.col(column).cast("timestamp")


def phrases(spark: SparkSession) -> DataFrame:
    return small_table(spark, PHRASES, "k int, subject string, phrase string, sender_email string, slug string")


def lexicon(spark: SparkSession) -> DataFrame:
    return small_table(spark, LEXICON, "word string, valence double")


def _events_with_phrase(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    return events.withColumn("k", (F.col("event_id") % len(PHRASES)).cast("int")).join(
        F.broadcast(phrases(spark)), "k"  # some hundred fixed rows
    )


def _header(source: DataFrame) -> dict[str, Column]:
    number = F.col("event_id")
    return {
        "email_id": number.cast("string"),
        "sender_name": F.when(number % 11 != 0, F.concat(F.lit("Sender "), (number % 50).cast("string"))),
        "received_at": _utc("ts"),
        "is_analyzed": number % 10 != 0,
    }


HEADER = ["email_id", "user_id", "sender_name", "sender_email", "subject", "received_at", "is_analyzed", "slug"]


def email_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Emails without their body, for jobs that never read it."""
    source = _events_with_phrase(spark, folder)
    return source.withColumns(_header(source)).select(*HEADER)


def _with_body(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """Add ``body``: the phrase followed by the whole text of a document."""
    documents = table(spark, folder, "documents").select("doc_id", "text")
    how_many = documents.agg(F.count("*")).scalar()
    rows = rows.withColumn("doc_id", F.col("event_id") % how_many)
    # Spread the emails over all tasks before their text is added: by their size
    # now, adaptive execution would put them into very few.
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    return rows.join(documents, "doc_id").withColumn("body", F.concat_ws("\n", "phrase", "text"))


def emails(spark: SparkSession, folder: str, known: DataFrame | None = None) -> DataFrame:
    """Emails: a phrase followed by the whole text of a document.

    ``known`` has more columns by ``email_id``; emails without it are left out.
    It is joined before the texts, so that these never move.
    """
    source = _events_with_phrase(spark, folder)
    rows, more = source.withColumns(_header(source)), []
    if known is not None:
        rows, more = rows.join(known, "email_id"), [c for c in known.columns if c != "email_id"]
    return _with_body(spark, folder, rows).select(*HEADER, "body", *more)


def analysis(spark: SparkSession, folder: str) -> DataFrame:
    """Stored analysis of the analyzed emails, with gaps in some columns."""
    number = F.col("event_id")
    source = _events_with_phrase(spark, folder).filter(number % 10 != 0)
    score = F.when(number % 41 != 0, F.least(F.floor("value"), F.lit(100)).cast("int"))
    return source.withColumn("priority_score", score).select(
        number.cast("string").alias("email_id"),
        F.when(number % 37 != 0, lookup(F.col("slug"), NAMES)).alias("category_name"),
        "slug",
        ((number * 7 % 100) / 100).alias("category_confidence"),
        F.concat(F.col("event_type"), F.lit(" notice")).alias("intent"),
        F.when(F.col("priority_score") >= 70, "high").when(F.col("priority_score") >= 40, "medium")
        .when(F.col("priority_score").isNotNull(), "low").alias("priority_level"),
        "priority_score",
        F.get(F.lit(["positive", "neutral", "negative", "neutral"]), (number % 4).cast("int")).alias("sentiment"),
        (number % 3 == 0).alias("action_required"),
        F.get(F.lit(["tomorrow", "by Friday", None, ""]), (F.floor(number / 8) % 4).cast("int")).alias("deadline_text"),
        F.concat_ws("|||", "event_type", F.lit(" "), F.when(number % 2 == 0, F.lit("Even number"))).alias("ai_explanation"),
    )


def replies(spark: SparkSession, folder: str) -> DataFrame:
    """Drafts of three quarters of the analyzed emails."""
    number = F.col("event_id")
    return table(spark, folder, "events").filter((number % 10 != 0) & (number % 4 != 3)).select(
        number.cast("string").alias("email_id"),
        F.concat(F.lit("r"), number.cast("string")).alias("reply_id"),
        F.concat(F.lit("Draft about "), "event_type").alias("current_content"),
        F.lit("formal").alias("tone"),
        F.when(number % 5 == 0, "sent").otherwise("draft").alias("status"),
        (number % 6 == 0).alias("is_user_edited"),
    )


def reply_events(spark: SparkSession, folder: str) -> DataFrame:
    """Version events of replies: one conversation is one reply."""
    minute = F.make_dt_interval(mins=F.floor(F.col("turn") / 2).cast("int"))
    return table(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("reply_id"),
        F.col("text").alias("content"),
        F.when(F.col("role") == "user", "user_edit").when(F.col("role") == "system", "generated")
        .otherwise("regenerated").alias("change_type"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + minute).alias("created_at"),
        F.col("turn").alias("seq"),
        F.when((F.col("role") == "user") & (F.col("turn") % 3 == 0), "sent").alias("status"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.col("c_name"), F.lit("@example.com")).alias("email"),
        F.col("c_name").alias("name"),
        (F.col("c_custkey") % 13 != 0).alias("is_active"),
    )


def incoming(spark: SparkSession, folder: str) -> DataFrame:
    """Incoming mail, some of it to be rejected."""
    number = F.col("event_id")
    address = F.concat(F.lit("customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0"), F.lit("@EXAMPLE.com"))
    return _with_body(spark, folder, _events_with_phrase(spark, folder)).select(
        number.cast("string").alias("email_id"),
        F.coalesce("sender_email", F.when(number % 16 == 2, "").otherwise("someone@web.net")).alias("sender"),
        F.when(number % 17 == 0, "nobody@example.com").otherwise(address).alias("recipient"),
        "subject",
        F.when(number % 19 == 0, "").otherwise(F.col("body")).alias("body"),
        _utc("ts").alias("received_at"),
    )


def raw_analyzed(spark: SparkSession, folder: str) -> DataFrame:
    """Analyzed emails as they arrive, deliberately dirty."""
    number = F.col("event_id")
    level = F.get(F.lit([" High ", "MEDIUM", "low", "medium"]), (number % 5).cast("int"))
    return table(spark, folder, "events").select(
        F.when(number % 101 != 0, number.cast("string")).alias("email_id"),
        F.when(number % 103 == 0, "not-a-date").otherwise(
            F.date_format(_utc("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("received_at"),
        F.when(number % 89 == 0, "   ").otherwise(F.col("event_type")).alias("category"),
        F.col("value").alias("priority_score"),
        F.coalesce(level, F.when(number % 25 == 4, "urgent").otherwise("low")).alias("priority_level"),
        F.get(F.lit(["Positive", "neutral", " negative", "neutral"]), (number % 4).cast("int")).alias("sentiment"),
        (number % 3 == 0).alias("action_required"),
        F.when(number % 97 != 0, F.concat("event_type", F.lit(" notice"))).alias("intent"),
    )


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a class built from their quality and toxicity labels."""
    labels = table(spark, folder, "labels").select(
        "doc_id", F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("label")
    )
    return table(spark, folder, "documents").select("doc_id", "text").join(labels, "doc_id")


CLASSES = ["q0t0", "q0t1", "q1t0", "q1t1"]


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """A fixed prediction per labelled document: quality flipped for some."""
    flip = F.when(F.col("doc_id") % 7 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    return table(spark, folder, "labels").select(
        "doc_id",
        F.concat(F.lit("q"), "quality", F.lit("t"), "toxic").alias("label"),
        F.concat(F.lit("q"), flip, F.lit("t"), F.when(F.col("doc_id") % 11 == 0, 1).otherwise(F.col("toxic"))).alias("prediction"),
    )


def public_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Label arrays in the vocabulary of the public corpus, some unknown."""
    names = F.lit(["Unknown", *rules.PUBLIC_LABELS, "Spam"])
    at = lambda n: F.get(names, (n % (len(rules.PUBLIC_LABELS) + 2)).cast("int"))
    number = F.col("event_id")
    return table(spark, folder, "events").select(
        number.cast("string").alias("email_id"),
        F.when(number % 23 == 0, F.array().cast("array<string>")).otherwise(
            F.array(at(number), at(F.floor(number / 5)), at(F.floor(number / 3)))).alias("labels"),
    )


def probabilities(spark: SparkSession, folder: str, classes: list[str]) -> DataFrame:
    """Emails with a fixed probability per class, as a model would give."""
    number = F.col("event_id")
    weight = lambda i: (number * (7 * i + 3) % 101 + F.when(number % 14 == i, 400).otherwise(1)).cast("double")
    weights = F.array(*[weight(i) for i in range(len(classes))])
    source = _events_with_phrase(spark, folder).withColumn("_weights", weights)
    source = source.withColumn("_sum", F.aggregate("_weights", F.lit(0.0), lambda a, b: a + b))
    return source.select(
        number.cast("string").alias("email_id"),
        F.concat_ws(" ", "subject", "phrase").alias("text"),
        F.transform("_weights", lambda w: w / F.col("_sum")).alias("probabilities"),
    )
