import re

from conftest import AS_OF
from pyspark.sql import functions as F

from postmill.functions import rules
from postmill.operators import classify, enrich
from postmill.sources.adapters import PHRASES, WRITTEN

FACTORS = [
    ([0, 22, 15, 9, 10, 0, 0, 5], 61, "medium", "elevated"), ([10, 0, 15, 10, 0, 10, 0, 5], 50, "medium", "normal"),
    ([0, 0, 0, 1, 0, 0, 0, 0], 1, "low", "normal"), ([10, 25, 15, 9, 10, 10, 10, 5], 94, "high", "critical"),
    ([0, 0, 15, 7, 0, 0, 0, 0], 22, "low", "normal"), ([0, 8, 0, 10, 0, 0, 10, 5], 33, "low", "normal"),
    ([0, 0, 0, 3, 0, 0, 0, 0], 3, "low", "normal"), ([0, 0, 0, 4, 10, 0, 0, 0], 14, "low", "normal"),
]
INTENTS = ["Interview Invitation", "Security Alert", "Newsletter", "Interview Invitation", "Work Communication",
           "Payment Due", "General Information", "Shipping Update"]
CATEGORIES = ["Job / Career", "Finance / Banking", "Promotions / Marketing", "Job / Career", "Work / Professional",
              "Finance / Banking", "Other", "E-commerce / Shopping"]


def phrase_mails(emails):
    return emails(*[(subject, body, sender, slug) for _, subject, body, sender, slug in WRITTEN])


def test_priority_of_phrases(emails):
    rows = enrich.score_priority(phrase_mails(emails), AS_OF).orderBy("email_id").collect()
    got = [(list(r.priority_factors), r.priority_score, r.priority_level, r.urgency_level) for r in rows]
    assert got == FACTORS
    assert rows[3].ai_explanation[0] == "Urgency language detected: 'urgent'"
    assert len(rows[3].ai_explanation) == 8


def test_intent_of_phrases(emails):
    rows = enrich.add_intent(phrase_mails(emails)).orderBy("email_id").collect()
    assert [r.intent for r in rows] == INTENTS


def test_whole_enrichment(emails):
    rows = enrich.enrich_rows(phrase_mails(emails).drop("slug"), AS_OF).orderBy("email_id").collect()
    assert [r.category_name for r in rows] == CATEGORIES
    assert [r.intent for r in rows] == INTENTS
    assert rows[0].priority_score == 64 and rows[4].priority_score == 44 and rows[4].priority_level == "medium"
    assert rows[7].deadline_text == "03/05/2025 at 10:00 am"
    assert rows[4].key_points == ["Email intent: Work Communication", "Key deadline/time: in two days", "Action is required from the recipient"]
    assert all(0 <= r.priority_score <= 100 and r.sentiment == "neutral" for r in rows)
    assert all(r.priority_score == min(100, sum(r.priority_factors)) for r in rows)


def test_examples(emails):
    mails = emails(
        ("Offer Letter", "We are pleased to offer you the position. Please review the job offer attached.", None, "job_career"),
        ("s", "I am feeling unwell and would like to request sick leave for today. Kindly grant me leave for the day.", None, "other"),
        ("Report shared", "Thanks for sharing the report.", None, "other"),
        ("SALE: 70% off everything", "Shop our amazing sale with great deals and discounts on all products.", None, "promotions_marketing"),
        ("URGENT URGENT today asap deadline immediately", "urgent asap immediately today deadline action required confirm please", None, "finance_banking"),
        ("day after tomorrow", "urgently", None, "other"),
        ("a\nb interview", "x\nscheduled", None, "other"),
    )
    rows = enrich.add_intent(enrich.score_priority(mails, AS_OF)).orderBy("email_id").collect()
    assert rows[0].intent == "Job Offer"
    assert rows[1].action_required
    assert not rows[2].action_required and rows[2].priority_factors.action_required == 0
    assert rows[3].priority_level == "low" and rows[3].priority_score < 40
    assert 0 <= rows[4].priority_score <= 100
    assert rows[5].priority_factors.deadline_proximity == 22 and rows[5].priority_factors.urgency_words == 10
    assert rows[6].intent == "General Information"  # "." stops at a line break


def test_known_action_and_deadline(spark, emails):
    mail = emails(("s", "please confirm", None, "other")).withColumns({
        "act": F.lit(False), "txt": F.lit("Monday"), "due": F.lit(None).cast("timestamp")})
    row = enrich.score_priority(mail, AS_OF, action="act", deadline_text="txt", deadline_time="due").first()
    assert not row.action_required and row.ai_explanation == ["Deadline detected: Monday"]
    for hours, points in ((-5, 25), (24, 25), (25, 22), (48, 22), (168, 8), (169, 5)):
        due = F.lit(AS_OF).cast("timestamp") + F.make_dt_interval(hours=F.lit(hours))
        row = enrich.score_priority(mail.withColumn("due", due), AS_OF, deadline_time="due").first()
        assert row.priority_factors.deadline_proximity == points


def test_senders(spark):
    cases = {"hr@acme.com": 5, "a@gmail.com": 0, "A@ACME.ORG": 5, "x@gmailcorp.com": 0, "x@a-b.com": 0, "x@acme.io": 0, None: 0}
    from postmill.functions.priority import from_organization
    df = spark.createDataFrame([(k,) for k in cases], "s string").withColumn("o", from_organization(F.col("s")))
    assert {r.s: 5 if r.o else 0 for r in df.collect()} == cases


def test_keyword_categories(spark):
    cases = {
        "interview invitation job offer position candidate hiring resume": "Job / Career",
        "assignment exam semester university professor grade homework lecture": "Education",
        "bank account transaction credit card debit suspicious fraud OTP": "Finance / Banking",
        "order delivery shipment tracking amazon purchase refund cart product": "E-commerce / Shopping",
        "flight booking hotel reservation itinerary boarding airline trip": "Travel",
        "appointment doctor hospital prescription medical health clinic": "Healthcare",
        "sale discount offer coupon deal limited time exclusive promo": "Promotions / Marketing",
        "": "Other",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    rows = classify.add_keyword_category(df, "t").collect()
    assert {r.t: r.category_name for r in rows} == cases
    for r in rows:
        points = {n: sum(w in r.t.lower() for w in ws) for n, ws in rules.CATEGORY_KEYWORDS.items()}
        total = sum(points.values())
        assert r.category_confidence == (round(max(points.values()) / total, 2) if total else 0.0)


def test_hints_over_a_model(spark):
    classes = ["Customer Support", "Education", "Finance / Banking", "Travel", "Work / Professional"]  # no jobs
    rows = [("project meeting", [0.9, 0.025, 0.025, 0.025, 0.025]), ("my manager", [0.9, 0.1, 0.0, 0.0, 0.0]),
            ("my manager", [0.6, 0.4, 0.0, 0.0, 0.0]), ("hiring now", [0.6, 0.4, 0.0, 0.0, 0.0]), ("hello", [0.1, 0.5, 0.4, 0.0, 0.0])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, text string, probabilities array<double>")
    got = classify.apply_hints(df, classes).orderBy("n").collect()
    assert [(r.category_name, r.category_confidence, r.needs_review) for r in got] == [
        ("Work / Professional", 0.03, True), ("Customer Support", 0.9, False), ("Work / Professional", 0.0, True),
        ("Job / Career", 1.0, False), ("Education", 0.5, True)]
    assert classify.add_hints(df, "text", "o").orderBy("n").first().o == "project meeting work professional"


def all_mails(emails):
    return emails(*[(subject, body, sender, slug) for _, subject, body, sender, slug in PHRASES])


def test_phrases_trigger_every_rule(emails):
    """Plain regular expressions over the same texts; each rule has a text that it fires on and texts that it does not."""
    texts = [f"{subject} {body}" for _, subject, body, _, _ in PHRASES]
    hits = lambda pattern: sum(bool(re.search(pattern, t.lower())) for t in texts)
    signals = [p for patterns, _, _ in rules.DEADLINE_TIERS for p in patterns]
    signals += [*rules.ACTION_PATTERNS, *rules.EVENT_PATTERNS, *rules.SECURITY_PATTERNS, *rules.TIME_SENSITIVE_PATTERNS]
    signals += [p for p, _, _ in rules.INTENTS] + [p for p, _, _ in rules.CATEGORY_HINTS] + list(rules.STRONG_PHRASES.values())
    signals += [p for _, p, _ in rules.ENTITY_PATTERNS]
    signals += [rules.DEADLINE_TWO_DAYS, rules.DEADLINE_48_HOURS, rules.DEADLINE_TOMORROW, rules.DEADLINE_WEEKDAY, rules.REQUEST_PATTERN]
    assert all(0 < hits(p) < len(texts) for p in signals), [p for p in signals if not hits(p)]
    assert all(any(word in t.lower() for t in texts) for words in rules.CATEGORY_KEYWORDS.values() for word in words)
    assert {slug for *_, slug in PHRASES} == {slug for _, slug, _, _ in rules.CATEGORIES}


def test_intents_of_all_phrases(emails):
    expected = {}
    for i, (_, subject, body, _, slug) in enumerate(PHRASES):
        found = [(-priority, n, label) for n, (pattern, label, priority) in enumerate(rules.INTENTS) if re.search(pattern, f"{subject} {body}", re.I)]
        expected[str(i)] = min(found)[2] if found else rules.INTENT_BY_CATEGORY.get(slug, rules.DEFAULT_INTENT)
    got = {r.email_id: r.intent for r in enrich.add_intent(all_mails(emails)).collect()}
    assert got == expected
    # an intent is missing only if a text with all it needs always has one of higher priority too
    assert len({label for _, label, _ in rules.INTENTS} - set(got.values())) <= 3


def test_entities_of_all_phrases(emails):
    rows = enrich.add_entity_text(all_mails(emails)).select("email_id", "entity_text").collect()
    expected = [(r.email_id, kind, m.group(), m.start()) for r in rows for kind, pattern, _ in rules.ENTITY_PATTERNS for m in re.finditer(pattern, r.entity_text, re.I)]
    got = [(r.email_id, r.entity_type, r.entity_text, r.char_position) for r in enrich.extract_entities(all_mails(emails)).collect()]
    assert sorted(got) == sorted(expected) and {kind for _, kind, _, _ in got} == {"DATE", "TIME", "MONEY"}
