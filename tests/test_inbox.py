import pytest
from conftest import AS_OF
from pyspark.sql import Window
from pyspark.sql import functions as F

from postmill.operators import analytics, inbox
from postmill.operators.ranking import add_row_number

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    from postmill.sources import adapters as src
    return src.email_headers(spark, SF).cache(), src.analysis(spark, SF).cache(), src.replies(spark, SF).cache()


def test_row_numbers_of_hot_keys(spark):
    # one key holds a third of the rows, with many equal order values
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, None).otherwise((F.col("id") % 50).cast("string")).alias("k"),
        (F.col("id") % 7).alias("t"), F.col("id"))
    order = [F.col("t").desc(), F.col("id")]
    expected = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("long"))
    got = add_row_number(df, ["k"], order, "rn")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, expected.collect()), key=str)


def test_pages_partition_the_inbox(tables):
    items = inbox.search_inbox(tables[0], tables[1])
    ids, page = [], 1
    while True:
        rows = inbox.inbox_page(items, page, 100, by=None).collect()
        if not rows:
            break
        ids += [r.email_id for r in rows]
        page += 1
    expected = [r.email_id for r in items.orderBy(F.desc("received_at"), "email_id").collect()]
    assert ids == expected


def test_pages_of_users_are_ordered(tables):
    items = inbox.search_inbox(tables[0], tables[1])
    rows = [(r.user_id, r.received_at, r.email_id) for r in inbox.inbox_page(items, 2, 2).collect()]
    every = sorted(((r.user_id, r.received_at, r.email_id) for r in items.collect()), key=lambda r: (r[0], -r[1].timestamp(), r[2]))
    by_user = {}
    for row in every:
        by_user.setdefault(row[0], []).append(row)
    assert rows == [row for user in sorted(by_user) for row in by_user[user][2:4]] != []


def test_queue_and_categories_are_per_user(tables):
    items = inbox.search_inbox(tables[0], tables[1])
    queue = inbox.action_queue(items, 2).collect()
    assert max(sum(r.user_id == u for r in queue) for u in {r.user_id for r in queue}) == 2
    assert {r.user_id for r in queue} == {r.user_id for r in items.filter("action_required").select("user_id").distinct().collect()}
    top = analytics.top_categories(tables[0], tables[1], 1).collect()
    assert len(top) == len({r.user_id for r in top}) == tables[0].join(tables[1], "email_id").select("user_id").distinct().count()


def test_shallow_page_plan_limits_before_the_exchange(tables):
    plan = inbox.inbox_page(inbox.search_inbox(tables[0], tables[1]), 2, 10)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_page_arguments(tables):
    for page, size in ((0, 20), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            inbox.inbox_page(tables[0], page, size)


def test_search(spark, emails):
    mails = emails(("50% off", "a\\b", "x@y.z", "o"), ("Other", "body", "q@y.z", "o")).withColumns(
        {"received_at": F.lit(AS_OF).cast("timestamp"), "is_analyzed": F.lit(True)})
    analysis = spark.createDataFrame(
        [("0", "Work / Professional", "high", 80, True, "i")],
        "email_id string, category_name string, priority_level string, priority_score int, action_required boolean, intent string")
    ids = lambda **f: sorted(r.email_id for r in inbox.search_inbox(mails, analysis, **f).collect())
    assert ids() == ["0", "1"]
    assert ids(search="a\\b") == ["0"] and ids(search="Q@Y") == ["1"] and ids(search="5_%") == ["0"]
    assert ids(category="professional") == ["0"] and ids(priority="HIGH") == ["0"]
    assert ids(action_required=False) == [] and ids(user_id="u2") == []


def test_detail_of_one_email(spark, tables):
    emails, analysis, replies = tables
    entities = spark.createDataFrame([("1", 1, "DATE", "b", 0.7), ("1", 0, "DATE", "a", 0.7)],
                                     "email_id string, entity_no int, entity_type string, entity_text string, confidence double")
    row = inbox.one_email("1", emails, analysis, entities, replies).first()
    assert [e.entity_text for e in row.entities] == ["a", "b"] and row.analysis.intent and row.reply.reply_id == "r1"
    assert inbox.one_email("2", emails, analysis, entities, replies).first().entities is None
    assert inbox.one_email("1", emails, analysis, entities, replies, user_id=-1).isEmpty()
    assert inbox.one_email("nope", emails, analysis, entities, replies).isEmpty()


def test_shares_and_totals(tables):
    emails, analysis, replies = tables
    shares = analytics.trend_category_distribution(emails, analysis).groupBy("user_id").agg(F.sum("percentage").alias("p"))
    assert all(abs(r.p - 100) < 1 for r in shares.collect())
    total = analytics.inbox_summary(emails, analysis, replies).agg(F.sum("total_emails"), F.sum("replies_generated")).first()
    assert tuple(total) == (emails.count(), replies.count())
    with pytest.raises(ValueError):
        analytics.trend_daily_volume(emails, AS_OF, 3)


def test_insights(spark):
    emails = spark.createDataFrame([("1", "u", True), ("2", "u", True), ("3", "u", False), ("4", "w", False)], "email_id string, user_id string, is_analyzed boolean")
    analysis = spark.createDataFrame([("1", "Travel", "high", 90, True), ("2", None, "high", 60, False)],
                                     "email_id string, category_name string, priority_level string, priority_score int, action_required boolean")
    replies = spark.createDataFrame([("1",)], "email_id string")
    users = spark.createDataFrame([("u",), ("w",), ("z",)], "user_id string")
    rows = analytics.inbox_insights(emails, analysis, replies, users).orderBy("user_id", "seq").collect()
    assert [(r.insight, r.type) for r in rows if r.user_id == "u"] == [
        ("1 email currently require your response.", "warning"), ("2 high-priority emails are in your inbox.", "warning"),
        ("'Other' is your most frequent email category (50.0% of inbox).", "info"),
        ("'Travel' emails have the highest average priority score (90.0/100).", "info"),
        ("Your inbox average priority is 75.0/100 — above normal.", "warning"),
        ("AI has generated replies for 50% of your analyzed emails.", "info")]
    assert [r.insight for r in rows if r.user_id == "w"] == ["Your inbox average priority is 0.0/100 — mostly low-priority content."]
    assert [r.insight for r in rows if r.user_id == "z"] == ["No emails analyzed yet. Add emails to see insights."]


def test_trend_reads_only_its_days(spark, tables, tmp_path):
    from postmill.sources.sinks import write_by_day

    write_by_day(tables[0], str(tmp_path / "mail"))
    days = spark.read.parquet(str(tmp_path / "mail"))
    trend = analytics.trend_daily_volume(days, AS_OF, 7)
    plan = trend._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(received_date" in plan and "(received_date" in plan.split("PartitionFilters")[1]
    assert sorted(map(tuple, trend.collect())) == sorted(map(tuple, analytics.trend_daily_volume(tables[0], AS_OF, 7).collect()))


def test_page_of_all_by_spans(spark, monkeypatch):
    """Ranks over ties, a crowded second and rows without time; little more than the page is sorted."""
    import random

    monkeypatch.setattr(inbox, "FEW_ROWS", 40)
    rng = random.Random(7)
    times = [f"2024-01-{rng.randint(1, 28):02d} {rng.randint(0, 23):02d}:{rng.randint(0, 59):02d}:{rng.randint(0, 59):02d}" for _ in range(3000)]
    times += ["2024-01-15 12:00:00"] * 300 + [None] * 90
    rows = [(f"e{i:05d}", t, f"s{i}") for i, t in enumerate(times)]
    items = spark.createDataFrame(rows, "email_id string, time string, subject string").withColumn("received_at", F.col("time").cast("timestamp")).repartition(5)
    dated = sorted((r for r in rows if r[1]), key=lambda r: r[0])
    dated.sort(key=lambda r: r[1], reverse=True)
    order = [r[0] for r in dated] + [r[0] for r in sorted(rows) if r[1] is None]
    for page in (1, 2, 30, 75, 166, 167, 169, 170, 400):
        got = [r.email_id for r in inbox.inbox_page(items, page, 20, by=None).collect()]
        assert got == order[(page - 1) * 20 : page * 20], page
    for first in (0, 600, 3100):
        span, before = inbox._span_of_ranks(items, first, first + 20)
        assert items.filter(span).count() <= 0.02 * len(rows) + 20 and before <= first


def test_nested_details_move_no_email(spark):
    from postmill.operators import enrich
    from postmill.sources import adapters as src
    from postmill.sources import sinks

    sf = "/root/testdata/sf0.001"
    parts = [src.emails(spark, sf).drop("slug"), src.analysis(spark, sf).drop("slug"), enrich.extract_entities(src.emails(spark, sf)), src.replies(spark, sf).drop("reply_id")]
    tables = [sinks.write_bucketed(df, f"nested_{i}", buckets=4) for i, df in enumerate(parts)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        nested = inbox.nested_details(*tables)
        assert "Exchange" not in nested._jdf.queryExecution().executedPlan().toString()
        rows = nested.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for i in range(len(tables)):
            spark.sql(f"DROP TABLE nested_{i}")
    assert len(rows) == parts[0].count() == len({r.email_id for r in rows})
    assert sum(len(r.entities) for r in rows) == parts[2].count() > 0
    assert all([e.entity_no for e in r.entities] == list(range(len(r.entities))) for r in rows)
    assert sum(r.analysis is not None for r in rows) == parts[1].count() and sum(r.reply is not None for r in rows) == parts[3].count()


def test_wide_rows_go_into_buckets_without_an_exchange(spark, monkeypatch):
    """whole mails were shuffled before they were stored, and written with weaker compression."""
    from postmill.sources import sinks

    mails = spark.range(0, 300, 1, 3).select((F.col("id") % 97).cast("string").alias("email_id"), F.repeat(F.lit("text "), 50).alias("body"))
    notes = spark.range(97).select(F.col("id").cast("string").alias("email_id"), F.lit(1).alias("n"))
    with monkeypatch.context() as m:
        m.setattr(type(mails), "repartition", lambda *_: 1 / 0)
        stored = sinks.write_bucketed(mails, "wide_mails", buckets=4, moved=False)
    small = sinks.write_bucketed(notes, "narrow_notes", buckets=4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = stored.join(small, "email_id", "left")
        assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()
        assert met.filter("n = 1").count() == 300 and stored.exceptAll(mails).isEmpty() and mails.exceptAll(stored).isEmpty()
        assert all(".zstd." in path for path in stored.inputFiles())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("wide_mails", "narrow_notes"):
            spark.sql(f"DROP TABLE {name}")
