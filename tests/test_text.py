import html
import unicodedata

from conftest import AS_OF
from pyspark.sql import functions as F

from postmill.functions import text
from postmill.operators import enrich
from postmill.operators.enrich import clean_corpus


def clean(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "n int, t string")
    return [r.c for r in clean_corpus(df, {"t": "c"}).orderBy("n").collect()]


def test_cleaning(spark):
    given = [
        "<p>Hello <b>World</b></p>", "", None, "Hello &amp; World &lt;test&gt; &hellip; &#233;",
        "See https://a.b/c?d now\nwww.x.y z", "Hi\n-- \nJohn\nCEO", "Hi\n__________\nx",
        "Yes\nOn Mon, Bob wrote:\n> old", "A\nFrom: x\nSent: y\nTo: z\nrest", "a  b\x1c c\t\td",
        "&amp;lt;b&amp;gt;",
    ]
    assert clean(spark, *given) == [
        "hello world", "", "", "hello & world … é", "see url now url z", "hi", "hi", "yes > old", "a", "a b c d", "&lt;b&gt;",
    ]


def test_entities_decode_like_the_standard(spark):
    cases = ["&amp;&lt;&copy;&middot;", "&eacute;&notit;", "&amp;copy;", "&#8364; &#x20AC", "a & b &", "&nbsp;x", "&unknown; &amp", "&quot;&#39;"]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert [r[0] for r in df.select(text.decode_entities(F.col("t"))).collect()] == [html.unescape(c) for c in cases]


def test_training_text_and_tokens(spark):
    df = spark.createDataFrame([("Ｆull <b>Ｗidth</b>  ﬁne &amp; dandy",)], "t string")
    assert text.add_training_text(df, "t", "o").first().o == unicodedata.normalize("NFKC", "full width fine & dandy")
    df = df.select(F.lit("a bb ccc_1 é dd2").alias("t")).withColumn("w", text.word_tokens(F.col("t")))
    assert df.select(text.with_bigrams(F.col("w"))).first()[0] == ["bb", "ccc_1", "dd2", "bb ccc_1", "ccc_1 dd2"]


def test_rounding_is_pythons(spark):
    numbers = [0.025, 0.125, 0.295, 2.675, -0.025, 6.25, 1 / 3]
    df = spark.createDataFrame([(n,) for n in numbers], "x double")
    assert [r[0] for r in df.select(text.round_exact(F.col("x"), 2)).collect()] == [round(n, 2) for n in numbers]


def test_delimited_lists(spark):
    df = spark.createDataFrame([("a||| |||b",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.split_items(F.col("t"))).collect()] == [["a", "b"], [], []]


def test_entities_with_positions(spark, emails):
    body = "<p>Your order has <b>shipped</b>. Total $1,200.00, arriving 03/05/2025 at 10:00 am.</p> Mar 3rd, 2025 £5 ₹1,0"
    mail = emails(("Order &amp; delivery", body, None, "other"), ("x", "TODAY or today, Monday", None, "other"), ("n", "none", None, "other"))
    rows = enrich.extract_entities(mail).orderBy("email_id", "entity_no").collect()
    first = [(r.entity_type, r.entity_text) for r in rows if r.email_id == "0"]
    assert first == [("DATE", "03/05/2025"), ("DATE", "Mar 3rd, 2025"), ("TIME", "10:00 am"), ("TIME", "00 am"),
                     ("MONEY", "$1,200.00"), ("MONEY", "₹1,0"), ("MONEY", "£5")]
    cleaned = {r.email_id: r.entity_text for r in enrich.add_entity_text(mail).collect()}
    for r in rows:
        assert cleaned[r.email_id][r.char_position:r.char_position + len(r.entity_text)] == r.entity_text
    assert [r.entity_text for r in rows if r.email_id == "1"] == ["TODAY", "today", "Monday"]
    kept = enrich.distinct_entities(enrich.extract_entities(mail)).filter("email_id = '1'").collect()
    assert sorted(r.entity_text for r in kept) == ["Monday", "TODAY"]


def test_deadlines(emails):
    bodies = ["Send it in two days.", "In 2 days", "within 48 Hours", "Call me tomorrow", "by Friday", "Before wednesday", "someday"]
    rows = enrich.add_deadline(emails(*[("s", b, None, "other") for b in bodies]), AS_OF).orderBy("email_id").collect()
    assert [r.deadline_text for r in rows] == ["in two days", "In 2 days", "within 48 Hours", "tomorrow", "by Friday", "Before wednesday", None]
    assert [r.deadline_datetime and r.deadline_datetime.strftime("%d %H:%M:%S.%f") for r in rows] == [
        "02 00:00:00.000000"] * 3 + ["01 00:00:00.000000", "02 23:59:59.999999", "07 23:59:59.999999", None]


def test_batches_for_python_are_small(spark):
    """Workers held 10,000 texts or 64 MB at a time, each several times over."""
    df = spark.createDataFrame([(str(i), "s", "b" * 100) for i in range(10)], "email_id string, subject string, body string")
    enrich.extract_entities(df)
    most = [int(spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")) for name in ("maxBytesPerBatch", "maxRecordsPerBatch")]
    assert 0 < most[0] <= 4 << 20 and 0 < most[1] <= 1000


def test_cut_references_are_kept_on_demand(spark):
    """a page text that ends in "&amp" keeps it, as in the query's SQL; whole references are decoded."""
    given = ["ver&amp<style>p</style>", "a &amp; b &hellip; &#233; &eacute; &nosuch; &ampx; &lt"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "n int, t string")
    rows = clean_corpus(df, {"t": "c"}, unterminated=False).orderBy("n").collect()
    assert [r.c for r in rows] == ["ver&amp p", "a & b … é é &nosuch; &ampx; &lt"]


def test_white_space_is_collapsed_in_one_pass(spark):
    """Tests and expressions of the JVM read every text some fifteen times."""
    spaces = [chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
    texts = [f"{s}a{s}b{s}{s}c {s} d{s}" for s in spaces] + ["", "   ", "a​b﻿", None, "a\r\n\tb"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    made = text.add_entity_text(df, "t", "out")
    assert "\u3000" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert [r.out for r in made.orderBy("i").collect()] == [None if t is None else " ".join(t.split()) for t in texts]
