"""The registered queries as independent SQL for the comparison engine.

Written from the meaning of each job, not from Spark's plans.  Pattern and word
lists come from the same fixed values.  Queries without an entry (trained
models) are checked by tests instead.
"""

from __future__ import annotations

from ..functions import rules
from ..sources import adapters as src
from .catalog import CLASS_NAMES, FIXED_TERMS

SQL: dict[str, str] = {}
AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def q(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def values(rows) -> str:
    cell = lambda v: str(v) if isinstance(v, (int, float)) else q(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(cell, row)) + ")" for row in rows)


def case_of(expr: str, table: dict, default: str = "NULL") -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {v if isinstance(v, int) else q(v)}" for k, v in table.items())
    return f"CASE {expr} {whens} ELSE {default} END"


def stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


def matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def any_match(text: str, patterns) -> str:
    return "(" + " OR ".join(matches(text, p) for p in patterns) + ")"


# ---- shared tables ----------------------------------------------------------

PHRASE = f"phrase(k, subject, phrase, sender_email, slug) AS ({values(src.PHRASES)})"
HEADERS = f"""{PHRASE}, headers AS (
  SELECT e.event_id, CAST(e.event_id AS VARCHAR) AS email_id, e.user_id,
         CASE WHEN e.event_id % 11 <> 0 THEN 'Sender ' || (e.event_id % 50) END AS sender_name,
         p.sender_email, p.subject, e.ts AS received_at, e.event_id % 10 <> 0 AS is_analyzed, p.slug, p.phrase
  FROM events e JOIN phrase p ON p.k = e.event_id % {len(src.PHRASES)})"""
EMAILS = f"""{HEADERS}, emails AS MATERIALIZED (
  SELECT h.*, h.phrase || chr(10) || d.text AS body
  FROM headers h JOIN documents d ON d.doc_id = h.event_id % (SELECT count(*) FROM documents))"""
ANALYSIS = f"""analysis AS (
  SELECT event_id, email_id, category_name, slug, category_confidence, intent,
         CASE WHEN priority_score >= 70 THEN 'high' WHEN priority_score >= 40 THEN 'medium'
              WHEN priority_score IS NOT NULL THEN 'low' END AS priority_level,
         priority_score, sentiment, action_required, deadline_text, ai_explanation
  FROM (SELECT e.event_id, CAST(e.event_id AS VARCHAR) AS email_id, p.slug,
               CASE WHEN e.event_id % 37 <> 0 THEN {case_of('p.slug', src.NAMES)} END AS category_name,
               (e.event_id * 7 % 100) / 100.0::DOUBLE AS category_confidence,
               e.event_type || ' notice' AS intent,
               CASE WHEN e.event_id % 41 <> 0 THEN CAST(least(floor(e.value), 100) AS INTEGER) END AS priority_score,
               (['positive', 'neutral', 'negative', 'neutral'])[e.event_id % 4 + 1] AS sentiment,
               e.event_id % 3 = 0 AS action_required,
               (['tomorrow', 'by Friday', NULL, ''])[(e.event_id // 8) % 4 + 1] AS deadline_text,
               concat_ws('|||', e.event_type, ' ', CASE WHEN e.event_id % 2 = 0 THEN 'Even number' END) AS ai_explanation
        FROM events e JOIN phrase p ON p.k = e.event_id % {len(src.PHRASES)} WHERE e.event_id % 10 <> 0))"""
REPLIES = """replies AS (
  SELECT CAST(event_id AS VARCHAR) AS email_id, 'r' || event_id AS reply_id, 'Draft about ' || event_type AS current_content,
         'formal' AS tone, CASE WHEN event_id % 5 = 0 THEN 'sent' ELSE 'draft' END AS status,
         event_id % 6 = 0 AS is_user_edited
  FROM events WHERE event_id % 10 <> 0 AND event_id % 4 <> 3)"""
INBOX = f"{HEADERS}, {ANALYSIS}"


def add(name: str, sql: str) -> None:
    SQL[name] = sql


# ---- batch ------------------------------------------------------------------

RAW = """raw AS (
  SELECT CASE WHEN event_id % 101 <> 0 THEN CAST(event_id AS VARCHAR) END AS email_id,
         CASE WHEN event_id % 103 = 0 THEN 'not-a-date' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS received_at,
         CASE WHEN event_id % 89 = 0 THEN '   ' ELSE event_type END AS category,
         value AS priority_score,
         CASE event_id % 5 WHEN 0 THEN ' High ' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'low' WHEN 3 THEN 'medium'
              ELSE CASE WHEN event_id % 25 = 4 THEN 'urgent' ELSE 'low' END END AS priority_level,
         CASE event_id % 4 WHEN 0 THEN 'Positive' WHEN 2 THEN ' negative' ELSE 'neutral' END AS sentiment,
         event_id % 3 = 0 AS action_required,
         CASE WHEN event_id % 97 <> 0 THEN event_type || ' notice' END AS intent
  FROM events)"""
VALID = f"""{RAW}, typed AS (
  SELECT email_id, TRY_CAST(received_at AS TIMESTAMP) AS received_at, category, TRY_CAST(priority_score AS DOUBLE) AS priority_score,
         lower(trim(priority_level)) AS priority_level, lower(trim(sentiment)) AS sentiment, action_required, intent
  FROM raw), valid AS (
  SELECT trim(email_id) AS email_id, received_at, trim(category) AS category, priority_score, priority_level, sentiment,
         action_required, trim(intent) AS intent, CAST(received_at AS DATE) AS received_date
  FROM typed
  WHERE trim(email_id) <> '' AND received_at IS NOT NULL AND trim(category) <> '' AND trim(intent) <> ''
    AND NOT isnan(priority_score) AND priority_score BETWEEN 0 AND 100 AND action_required IS NOT NULL
    AND priority_level IN ('low', 'medium', 'high') AND sentiment IN ('positive', 'neutral', 'negative'))"""
add("clean_valid_emails", f"""WITH {VALID} SELECT email_id, {stamp('received_at')} AS received_at, category, priority_score,
  priority_level, sentiment, action_required, intent, CAST(received_date AS VARCHAR) AS received_date FROM valid""")
add("rejected_email_count", f"WITH {VALID} SELECT (SELECT count(*) FROM raw) - (SELECT count(*) FROM valid) AS rejected")
add("analyzed_emails", f"""WITH {INBOX} SELECT h.email_id, {stamp('h.received_at')} AS received_at, a.category_name AS category,
  a.priority_score, a.priority_level, a.sentiment, a.action_required, a.intent FROM headers h JOIN analysis a USING (email_id)""")
add("daily_email_volume", f"WITH {VALID} SELECT CAST(received_date AS VARCHAR) AS received_date, count(*) AS email_count FROM valid GROUP BY 1")
for _name, _key in [("category_distribution", "category"), ("priority_distribution", "priority_level"), ("sentiment_distribution", "sentiment")]:
    add(_name, f"WITH {VALID} SELECT {_key}, count(*) AS email_count FROM valid GROUP BY 1")
add("average_priority_by_category", f"""WITH {VALID} SELECT category, round(avg(priority_score), 6) AS average_priority_score
  FROM valid GROUP BY 1""")
add("action_required_count", f"WITH {VALID} SELECT count(*) FILTER (WHERE action_required) AS action_required_count FROM valid")
_measures = """count(*) AS email_count, round(avg(priority_score), 6) AS average_priority_score,
  count(*) FILTER (WHERE action_required) AS action_required_count FROM valid"""
add("email_cube", f"WITH {VALID} " + " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS key, {_measures} GROUP BY {d}"
    for d in ("received_date", "category", "priority_level", "sentiment")
) + f" UNION ALL SELECT 'all', NULL, {_measures}")

# ---- analytics --------------------------------------------------------------


def fixed(expr: str, digits: int) -> str:
    """Rounded to the nearest decimal of the exact binary value."""
    return f"CAST(format('{{:.{digits}f}}', CAST({expr} AS DOUBLE)) AS DOUBLE)"


SUMMARY = f"""{INBOX}, {REPLIES}, summary AS (
  SELECT h.user_id, count(*) AS total_emails, count(*) FILTER (WHERE priority_level = 'high') AS high_priority,
         count(*) FILTER (WHERE priority_level = 'medium') AS medium_priority,
         count(*) FILTER (WHERE priority_level = 'low') AS low_priority,
         count(*) FILTER (WHERE action_required) AS action_required, count(*) FILTER (WHERE is_analyzed) AS analyzed,
         count(r.email_id) AS replies_generated, coalesce(avg(priority_score), 0) AS mean
  FROM headers h LEFT JOIN analysis a USING (email_id) LEFT JOIN replies r USING (email_id) GROUP BY 1)"""
add("inbox_summary", f"""WITH {SUMMARY} SELECT * EXCLUDE (mean), {fixed('mean', 1)} AS avg_priority_score,
  CASE WHEN analyzed > 0 THEN {fixed('action_required / analyzed * 100', 1)} ELSE 0.0 END AS action_required_percentage FROM summary""")
add("trend_daily_volume", f"""WITH {HEADERS} SELECT user_id, strftime(received_at, '%Y-%m-%d') AS date, count(*) AS count
  FROM headers WHERE received_at >= {AS_OF} - INTERVAL 7 DAYS GROUP BY 1, 2""")


def share(column: str, alias: str, default: str) -> str:
    return f"""SELECT user_id, coalesce({column}, '{default}') AS {alias}, n AS count, {fixed('n / total * 100', 1)} AS percentage
      FROM (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total FROM (
        SELECT user_id, {column}, count(*) AS n FROM headers JOIN analysis USING (email_id) GROUP BY 1, 2))"""


add("trend_category_distribution", f"WITH {INBOX} {share('category_name', 'category', 'Other')}")
add("trend_priority_distribution", f"WITH {INBOX} {share('priority_level', 'level', 'unknown')}")
MEANS = """means AS (SELECT user_id, coalesce(category_name, 'Other') AS category, avg(priority_score) AS mean
  FROM headers JOIN analysis USING (email_id) GROUP BY user_id, category_name)"""
add("trend_avg_priority", f"WITH {INBOX}, {MEANS} SELECT user_id, category, {fixed('coalesce(mean, 0)', 1)} AS avg_priority FROM means")
add("top_categories", f"""WITH {INBOX} SELECT user_id, category, count FROM (
  SELECT user_id, coalesce(category_name, 'Other') AS category, count(*) AS count FROM headers JOIN analysis USING (email_id)
  GROUP BY user_id, category_name) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY count DESC, category) <= 8""")
add("inbox_insights", f"""WITH {SUMMARY}, {MEANS}, users AS (SELECT c_custkey AS user_id FROM customer),
frequent AS (SELECT DISTINCT ON (user_id) user_id, category, percentage FROM ({share('category_name', 'category', 'Other')})
             ORDER BY user_id, count DESC, category),
important AS (SELECT DISTINCT ON (user_id) user_id, category, mean FROM means ORDER BY user_id, mean DESC NULLS LAST, category),
line AS (
  SELECT user_id, 0 AS place, 'info' AS type, 'No emails analyzed yet. Add emails to see insights.' AS insight
  FROM users WHERE user_id NOT IN (SELECT user_id FROM summary)
  UNION ALL SELECT user_id, 1, 'warning', action_required || ' email' || CASE WHEN action_required > 1 THEN 's' ELSE '' END
    || ' currently require your response.' FROM summary WHERE action_required > 0
  UNION ALL SELECT user_id, 2, 'warning', high_priority || ' high-priority email' || CASE WHEN high_priority > 1 THEN 's are' ELSE ' is' END
    || ' in your inbox.' FROM summary WHERE high_priority > 0
  UNION ALL SELECT user_id, 3, 'info', '''' || category || ''' is your most frequent email category (' || percentage || '% of inbox).' FROM frequent
  UNION ALL SELECT user_id, 4, 'info', '''' || category || ''' emails have the highest average priority score ('
    || {fixed('coalesce(mean, 0)', 1)} || '/100).' FROM important
  UNION ALL SELECT user_id, 5, CASE WHEN {fixed('mean', 1)} > 65 THEN 'warning' ELSE 'info' END,
    'Your inbox average priority is ' || {fixed('mean', 1)} || '/100 — '
    || CASE WHEN {fixed('mean', 1)} > 65 THEN 'above normal.' ELSE 'mostly low-priority content.' END
    FROM summary WHERE {fixed('mean', 1)} > 65 OR {fixed('mean', 1)} < 35
  UNION ALL SELECT user_id, 6, 'info', 'AI has generated replies for ' || format('{{:.0f}}', replies_generated / analyzed * 100)
    || '% of your analyzed emails.' FROM summary WHERE analyzed > 0)
SELECT l.user_id, CAST(row_number() OVER (PARTITION BY l.user_id ORDER BY place) AS INTEGER) AS seq, insight, type
FROM line l JOIN users USING (user_id)""")

# ---- inbox ------------------------------------------------------------------

ITEM = f"""h.user_id, h.email_id, h.sender_name, h.sender_email, h.subject, {stamp('h.received_at')} AS received_at, h.is_analyzed,
  a.category_name, a.priority_level, a.priority_score, a.action_required, a.intent"""
FOUND = " OR ".join(f"contains(lower(h.{c}), '{{0}}')" for c in ("subject", "body", "sender_name", "sender_email")).join("()")
add("inbox_search", f"""WITH {EMAILS}, {ANALYSIS} SELECT {ITEM} FROM emails h JOIN analysis a USING (email_id)
  WHERE a.category_name ILIKE '%career%' AND a.action_required AND {FOUND.format('please')}""")
add("inbox_search_text", f"""WITH {EMAILS}, {ANALYSIS} SELECT {ITEM} FROM emails h LEFT JOIN analysis a USING (email_id)
  WHERE {FOUND.format('security')}""")
add("inbox_page", f"""WITH {INBOX} SELECT * EXCLUDE (rn) FROM (
  SELECT {ITEM}, row_number() OVER (PARTITION BY h.user_id ORDER BY h.received_at DESC, h.email_id) AS rn
  FROM headers h LEFT JOIN analysis a USING (email_id)) WHERE rn BETWEEN 11 AND 20""")
add("inbox_page_deep", f"""WITH {INBOX} SELECT {ITEM} FROM headers h LEFT JOIN analysis a USING (email_id)
  ORDER BY h.received_at DESC, h.email_id LIMIT 100 OFFSET 1400""")
add("inbox_page_totals", f"""WITH {INBOX} SELECT user_id, count(*) AS total, CAST(greatest(1, ceil(count(*) / 10)) AS BIGINT) AS total_pages
  FROM headers JOIN analysis USING (email_id) WHERE priority_level = 'high' GROUP BY 1""")
add("action_queue", f"""WITH {INBOX} SELECT * EXCLUDE (rn) FROM (
  SELECT {ITEM}, row_number() OVER (PARTITION BY h.user_id ORDER BY h.received_at DESC, h.email_id) AS rn
  FROM headers h JOIN analysis a USING (email_id) WHERE a.action_required) WHERE rn <= 5""")
add("needs_review", f"""WITH {PHRASE}, {ANALYSIS} SELECT email_id, category_confidence, category_confidence < 0.55 AS needs_review FROM analysis""")
add("category_lookup", f"""WITH {PHRASE}, {ANALYSIS}, dim(name, slug) AS ({values([(n, s) for n, s, _, _ in rules.CATEGORIES])})
  SELECT a.email_id, coalesce(d.name, 'Other') AS category, coalesce(d.slug, 'other') AS slug
  FROM analysis a LEFT JOIN dim d ON d.name = a.category_name""")
add("pending_emails", f"""WITH {INBOX} SELECT email_id, user_id, sender_name, sender_email, subject, {stamp('received_at')} AS received_at, is_analyzed
  FROM headers WHERE NOT is_analyzed AND email_id NOT IN (SELECT email_id FROM analysis)""")

# ---- text -------------------------------------------------------------------

ENTITIES_OF_HTML = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]


def decoded(expr: str) -> str:
    for entity, char in ENTITIES_OF_HTML:
        expr = f"replace({expr}, {q(entity)}, {q(char)})"
    return expr


def untagged(expr: str, url: str) -> str:
    expr = f"regexp_replace({expr}, '<[^>]+>', ' ', 'g')"
    return f"regexp_replace({expr}, 'https?://\\S+|www\\.\\S+', '{url}', 'g')"


def collapsed(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def cleaned(expr: str) -> str:
    expr = untagged(decoded(f"coalesce({expr}, '')"), " URL ")
    expr = f"regexp_replace({expr}, '(?s)\\n[-_]{{2,}}.*', '', 'g')"
    expr = f"regexp_replace({expr}, '(?s)(On .+wrote:|From:.+\\nSent:.+\\nTo:.+)', '', 'g')"
    return f"lower({collapsed(expr)})"


def entity_text(subject: str = "subject", body: str = "body") -> str:
    return collapsed(untagged(decoded(f"({subject} || chr(10) || chr(10) || {body})"), ""))


CLEANED = f"{EMAILS}, cleaned AS (SELECT *, {cleaned('subject')} AS subject_clean, {cleaned('body')} AS body_clean, {entity_text()} AS entity_text FROM emails)"
VARIANTS = f"{CLEANED}, variants AS (SELECT *, trim(subject_clean || ' ' || subject_clean || ' ' || body_clean) AS classification_text FROM cleaned)"
add("clean_text", f"WITH {CLEANED} SELECT email_id, subject_clean, md5(body_clean) AS body_md5, CAST(length(body_clean) AS INTEGER) AS body_length FROM cleaned")
add("clean_pages", f"SELECT page_id, md5(c) AS clean_md5, CAST(length(c) AS INTEGER) AS clean_length FROM (SELECT page_id, {cleaned('html')} AS c FROM pages)")
add("classification_text", f"WITH {VARIANTS} SELECT email_id, md5(classification_text) AS classification_md5, md5(entity_text) AS entity_md5 FROM variants")

def _listed(kind: str, pattern: str, confidence: float) -> str:
    """Matches with their places: the lengths of the texts between them and of the matches before, added up."""
    found, parts = f"regexp_extract_all(entity_text, {q('(?i)' + pattern)})", f"regexp_split_to_array(entity_text, {q('(?i)' + pattern)})"
    before = lambda items, to: f"coalesce(list_sum(list_transform({items}[1:{to}], lambda y: length(y))), 0)"
    return (f"list_transform({found}, lambda m, i: {{'t': '{kind}', 'x': m, 'c': {confidence}::DOUBLE, "
            f"'at': ({before(parts, 'i')} + {before(found, 'i - 1')})::INTEGER}})")


_found = " || ".join(_listed(kind, pattern, confidence) for kind, pattern, confidence in rules.ENTITY_PATTERNS)
FOUND_ENTITIES = f"""{CLEANED}, listed AS (SELECT *, {_found} AS entities FROM cleaned), entity AS (
  SELECT email_id, n - 1 AS entity_no, e.t AS entity_type, e.x AS entity_text, e.c AS confidence, e.at AS char_position
  FROM (SELECT email_id, unnest(entities) AS e, generate_subscripts(entities, 1) AS n FROM listed))"""
add("extract_entities", f"WITH {FOUND_ENTITIES} SELECT email_id, CAST(entity_no AS INTEGER) AS entity_no, entity_type, entity_text, confidence, char_position FROM entity")
add("entity_type_counts", f"WITH {FOUND_ENTITIES} SELECT entity_type, count(*) AS count FROM entity GROUP BY 1")
add("distinct_entities", f"""WITH {FOUND_ENTITIES} SELECT email_id, entity_type, lower(trim(entity_text)) AS entity_text, max(confidence) AS confidence
  FROM entity GROUP BY ALL""")
add("email_detail", f"""WITH {FOUND_ENTITIES}, {ANALYSIS}, {REPLIES}
  SELECT m.email_id, m.user_id, m.sender_name, m.sender_email, m.subject, {stamp('m.received_at')} AS received_at, m.is_analyzed, md5(m.body) AS body,
    a.category_name, a.category_confidence, a.intent, a.priority_level, a.priority_score, a.sentiment, a.action_required, a.deadline_text, a.ai_explanation,
    r.current_content AS reply_current_content, r.tone AS reply_tone, r.status AS reply_status, r.is_user_edited AS reply_is_user_edited,
    e.entity_type, e.entity_text, e.confidence
  FROM emails m LEFT JOIN analysis a USING (email_id) LEFT JOIN replies r USING (email_id) LEFT JOIN entity e USING (email_id)""")

add("email_details_nested", f"""WITH {FOUND_ENTITIES}, {ANALYSIS}, {REPLIES}
  SELECT m.email_id, m.subject, md5(m.body) AS body_md5, a.category_name, a.priority_score, CAST(len(l.entities) AS INTEGER) AS entities,
    md5(array_to_string(list_transform(l.entities, lambda e, i: concat_ws('|', i - 1, e.t, e.x, e.at)), chr(10))) AS entities_md5,
    r.current_content AS reply, a.email_id IS NULL AS pending
  FROM emails m JOIN listed l USING (email_id) LEFT JOIN analysis a USING (email_id) LEFT JOIN replies r USING (email_id)""")


def first_match(pattern: str, group: int = 0) -> str:
    return f"nullif(regexp_extract(entity_text, {q('(?i)' + pattern)}, {group}), '')"


_ahead = f"(list_position({rules.WEEKDAYS}, lower({first_match(rules.DEADLINE_WEEKDAY, 1)})) - 1 - (isodow({AS_OF}) - 1) + 7) % 7"
DEADLINE = f"""deadline AS (
  SELECT *, CASE WHEN two IS NOT NULL OR h48 IS NOT NULL THEN {AS_OF} + INTERVAL 48 HOURS
                 WHEN tomorrow IS NOT NULL THEN {AS_OF} + INTERVAL 24 HOURS
                 WHEN weekday IS NOT NULL THEN date_trunc('day', {AS_OF}) + to_days(CAST(CASE ahead WHEN 0 THEN 7 ELSE ahead END + 1 AS INTEGER))
                      - INTERVAL 1 MICROSECOND END AS deadline_datetime,
         coalesce(two, h48, tomorrow, weekday) AS relative_text
  FROM (SELECT *, {first_match(rules.DEADLINE_TWO_DAYS)} AS two, {first_match(rules.DEADLINE_48_HOURS)} AS h48,
               {first_match(rules.DEADLINE_TOMORROW)} AS tomorrow, {first_match(rules.DEADLINE_WEEKDAY)} AS weekday,
               {_ahead} AS ahead FROM {{source}}))"""
add("extract_deadline", f"""WITH {CLEANED}, {DEADLINE.format(source='cleaned')}
  SELECT email_id, relative_text AS deadline_text, {stamp('deadline_datetime')} AS deadline_datetime FROM deadline""")

_ranked = sorted(rules.INTENTS, key=lambda rule: -rule[2])


def intent_sql(text: str, slug: str) -> str:
    whens = " ".join(f"WHEN {matches(text, pattern)} THEN {q(label)}" for pattern, label, _ in _ranked)
    return f"CASE {whens} ELSE {case_of(slug, rules.INTENT_BY_CATEGORY, q(rules.DEFAULT_INTENT))} END"


LOWERED = f"{EMAILS}, lowered AS (SELECT *, lower(subject || ' ' || body) AS t FROM emails)"
INTENT = f"{LOWERED}, intended AS (SELECT *, {intent_sql('t', 'slug')} AS intent FROM lowered)"
add("intent", f"WITH {INTENT} SELECT email_id, intent FROM intended")
add("intent_distribution", f"WITH {INTENT} SELECT intent, count(*) AS count FROM intended GROUP BY 1")

_valence = "CASE w " + " ".join(f"WHEN {q(w)} THEN CAST({v} AS DECIMAL(18, 6))" for w, v in src.LEXICON) + " ELSE 0 END"


def toned(source: str) -> str:
    """Tables ``total`` and ``tone`` (compound score ``c`` of each row) of a table of emails."""
    return f"""total AS (SELECT *, coalesce(CAST(list_sum(list_transform(regexp_extract_all(lower(body), '[\\p{{L}}\\p{{N}}_'']+'), lambda w: {_valence})) AS DOUBLE), 0) AS tone_sum
  FROM {source}), tone AS (SELECT *, tone_sum / sqrt(tone_sum * tone_sum + 15.0) AS c FROM total)"""


TONE = "CASE WHEN c >= 0.05 THEN 'positive' WHEN c <= -0.05 THEN 'negative' ELSE 'neutral' END"
add("sentiment_band", f"WITH {EMAILS}, {toned('emails')} SELECT email_id, {TONE} AS sentiment, {fixed('c', 4)} AS sentiment_score FROM tone")
add("explanation_counts", f"""WITH {PHRASE}, {ANALYSIS} SELECT item, count(*) AS count FROM (
  SELECT unnest(string_split(ai_explanation, '|||')) AS item FROM analysis) WHERE trim(item) <> '' GROUP BY 1""")

# ---- priority ---------------------------------------------------------------

_urgent = "list_filter([" + ", ".join(
    f"CASE WHEN contains(t, {q(w)}) THEN {q(w)} END" for w in rules.URGENCY_WORDS) + "], lambda w: w IS NOT NULL)"
_tiers = [(any_match("t", patterns), points, reason) for patterns, points, reason in rules.DEADLINE_TIERS]
_by_text = lambda which: "CASE " + " ".join(f"WHEN {c} THEN {p if which == 'points' else q(r)}" for c, p, r in _tiers) + " END"
_by_date = lambda which: "CASE " + " ".join(
    ("ELSE " if limit is None else f"WHEN hours <= {limit} THEN ") + (str(points) if which == "points" else q(reason))
    for limit, points, reason in rules.DEADLINE_HOURS) + " END"
_providers = "(?i)@(gmail|yahoo|hotmail|outlook|proton|icloud)"


def priority_sql(source: str, known: bool) -> str:
    """Columns of the score; ``known`` uses action and deadline columns of the source."""
    detected = any_match("t", rules.ACTION_PATTERNS)
    points = f"CASE WHEN deadline_datetime IS NOT NULL THEN {_by_date('points')} ELSE {_by_text('points')} END" if known else _by_text("points")
    reason = (f"CASE WHEN deadline_datetime IS NOT NULL THEN {_by_date('reason')} ELSE coalesce({_by_text('reason')}, "
              f"{q(rules.DEADLINE_MENTIONED)} || nullif(deadline_text, '')) END") if known else _by_text("reason")
    action_reason = rules.ACTION_REASON_GIVEN if known else rules.ACTION_REASON_DETECTED
    flag = lambda patterns: f"CASE WHEN {any_match('t', patterns)} THEN 10 ELSE 0 END"
    return f"""signals AS (SELECT *, {_urgent} AS urgent, coalesce({points}, 0) AS deadline_proximity, {reason} AS deadline_reason,
      CASE WHEN {detected} THEN 15 ELSE 0 END AS action_points, {case_of('slug', rules.CATEGORY_POINTS, '3')} AS category_importance,
      {flag(rules.EVENT_PATTERNS)} AS event_scheduled, {flag(rules.SECURITY_PATTERNS)} AS security_alert,
      {flag(rules.TIME_SENSITIVE_PATTERNS)} AS time_sensitive,
      CASE WHEN {matches('sender_email', '(?i)@[a-z]+[.](com|org|edu|gov|net|in)' + chr(92) + 'b')}
            AND NOT {matches('sender_email', _providers)} THEN 5 ELSE 0 END AS sender_importance FROM {source}),
    summed AS (SELECT *, least(len(urgent) * 5, 15) AS urgency_words,
      least(least(len(urgent) * 5, 15) + deadline_proximity + action_points + category_importance + event_scheduled + security_alert
        + time_sensitive + sender_importance, 100) AS score FROM signals),
    scored AS (SELECT *, CAST(score AS INTEGER) AS priority_score,
      CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS priority_level,
      CASE WHEN score >= 90 THEN 'critical' WHEN score >= 70 OR (score >= 55 AND score < 70) THEN 'elevated' ELSE 'normal' END AS urgency_level,
      action_points > 0 OR (score >= 70 AND event_scheduled > 0) AS action_required,
      array_to_string(list_filter([
        CASE WHEN len(urgent) > 0 THEN {q(rules.URGENCY_REASON + "'")} || urgent[1] || '''' END, deadline_reason,
        CASE WHEN action_points > 0 THEN {q(action_reason)} END, {case_of('slug', rules.CATEGORY_REASONS)},
        CASE WHEN event_scheduled > 0 THEN {q(rules.EVENT_REASON)} END, CASE WHEN security_alert > 0 THEN {q(rules.SECURITY_REASON)} END,
        CASE WHEN time_sensitive > 0 THEN {q(rules.TIME_SENSITIVE_REASON)} END, CASE WHEN sender_importance > 0 THEN {q(rules.SENDER_REASON)} END
      ], lambda r: r IS NOT NULL), '|||') AS ai_explanation FROM summed)"""


SCORED = f"{LOWERED}, {priority_sql('lowered', False)}"
_factors = [f for f in rules.FACTORS if f != "action_required"]
add("priority_scores", f"""WITH {SCORED} SELECT email_id, priority_score, priority_level, urgency_level, action_required,
  {', '.join(f'CAST({f} AS INTEGER) AS {f}' for f in _factors)}, action_points, ai_explanation FROM scored""")
add("priority_levels", f"WITH {SCORED} SELECT priority_level, urgency_level, count(*) AS count FROM scored GROUP BY 1, 2")
_factor = {f: "action_points" if f == "action_required" else f for f in rules.FACTORS}
add("priority_factors_json", f"""WITH {SCORED} SELECT email_id, '{{' || concat_ws(', ', {', '.join(f"""'"{f}": ' || CAST({c} AS INTEGER)""" for f, c in _factor.items())}) || '}}' AS factors, TRUE AS read_back FROM scored""")
add("priority_factor_totals", f"""WITH {SCORED} SELECT {', '.join(f'avg({f}) AS {f}' for f in _factors)},
  avg(action_points) AS action_required FROM scored""")

# ---- classification ---------------------------------------------------------

_names = list(rules.CATEGORY_KEYWORDS)
_points = "[" + ", ".join(
    "(" + " + ".join(f"contains(c, {q(w)})::INT" for w in words) + ")" for words in rules.CATEGORY_KEYWORDS.values()) + "]"


def keyword_sql(source: str, text: str) -> str:
    return f"""pointed AS (SELECT *, {_points.replace('(c,', f'({text},')} AS points FROM {source}),
    shared AS (SELECT *, CASE WHEN list_sum(points) > 0 THEN list_max(points) / list_sum(points) ELSE 0.0 END AS share FROM pointed),
    keyword AS (SELECT *, CASE WHEN list_sum(points) > 0 THEN ({[*_names]})[list_position(points, list_max(points))] ELSE 'Other' END AS k_name,
      {fixed('share', 2)} AS k_confidence, share < 0.55 AS k_review FROM shared)"""


SLUG_OF = {name: slug for name, slug, _, _ in rules.CATEGORIES}
KEYWORD = f"{VARIANTS}, {keyword_sql('variants', 'classification_text')}"
add("keyword_category", f"""WITH {KEYWORD} SELECT email_id, k_name AS category_name, {case_of('k_name', SLUG_OF)} AS slug,
  k_confidence AS category_confidence, k_review AS needs_review FROM keyword""")
add("keyword_category_distribution", f"WITH {KEYWORD} SELECT k_name AS category_name, count(*) AS count FROM keyword GROUP BY 1")

_weights = "[" + ", ".join(
    f"CAST(h.event_id * {7 * i + 3} % 101 + CASE WHEN h.event_id % 14 = {i} THEN 400 ELSE 1 END AS DOUBLE)" for i in range(len(CLASS_NAMES))) + "]"
_hinted = "CASE " + " ".join(f"WHEN {matches('t', p)} THEN {q(c)}" for p, _, c in rules.CATEGORY_HINTS) + " END"
_strong = "CASE hinted " + " ".join(f"WHEN {q(c)} THEN {matches('t', p)}" for c, p in rules.STRONG_PHRASES.items()) + " ELSE FALSE END"
add("hybrid_override", f"""WITH {HEADERS}, weighed AS (SELECT email_id, lower(subject || ' ' || phrase) AS t, {_weights} AS w FROM headers h),
prob AS (SELECT *, list_transform(w, lambda x: x / list_sum(w)) AS p, {_hinted} AS hinted FROM weighed),
model AS (SELECT *, ({CLASS_NAMES})[list_position(p, list_max(p))] AS predicted, {_strong} AS strong FROM prob),
final AS (SELECT *, CASE WHEN hinted <> predicted AND (list_max(p) < 0.70 OR strong) THEN hinted ELSE predicted END AS name FROM model)
SELECT email_id, name AS category_name, {case_of('name', SLUG_OF)} AS slug,
  {fixed(f'p[list_position({CLASS_NAMES}, name)]', 2)} AS category_confidence, p[list_position({CLASS_NAMES}, name)] < 0.55 AS needs_review FROM final""")
add("hint_text", f"""WITH {EMAILS}, t AS (SELECT email_id, subject || ' ' || body AS x, lower(subject || ' ' || body) AS t FROM emails)
  SELECT email_id, md5(concat_ws(' ', x, {', '.join(f"CASE WHEN {matches('t', p)} THEN {q(w)} END" for p, w, _ in rules.CATEGORY_HINTS)})) AS hint_md5 FROM t""")

_public = ["Unknown", *rules.PUBLIC_LABELS, "Spam"]
_at = lambda n: f"({_public})[{n} % {len(_public)} + 1]"
add("label_map", f"""WITH l AS (SELECT CAST(event_id AS VARCHAR) AS email_id, CASE WHEN event_id % 23 = 0 THEN []
    ELSE [{_at('event_id')}, {_at('(event_id // 5)')}, {_at('(event_id // 3)')}] END AS labels FROM events),
  mapped AS (SELECT email_id, list_filter(list_transform(labels, lambda x: {case_of('x', rules.PUBLIC_LABELS)}), lambda x: x IS NOT NULL) AS m FROM l)
  SELECT email_id, m[1] AS label FROM mapped""")
_untagged = "regexp_replace(" + decoded("text") + ", '<[^>]+>', ' ', 'g')"
_norm = f"lower({collapsed(_untagged)})"
add("dedup_labeled_text", f"""SELECT label, doc_id, md5(t) AS text_md5 FROM (SELECT lang AS label, min(doc_id) AS doc_id, t
  FROM (SELECT doc_id, lang, {_norm} AS t FROM documents) WHERE length(t) >= 12 AND lang <> '' GROUP BY lang, t)""")
LABELLED = """labelled AS (SELECT doc_id, 'q' || quality || 't' || toxic AS label FROM labels JOIN documents USING (doc_id))"""
add("class_counts", f"WITH {LABELLED} SELECT label, count(*) AS count FROM labelled GROUP BY 1")
add("stratified_split", f"""WITH {LABELLED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM labelled),
sized AS (SELECT *, floor(n * 0.2 + 0.5) AS n_test FROM ranked)
SELECT doc_id, label, CASE WHEN rn <= n_test THEN 'test' WHEN rn <= n_test + floor((n - n_test) * 0.25 + 0.5) THEN 'validation' ELSE 'fit' END AS part FROM sized""")
PREDICTED = """predicted AS (SELECT doc_id, 'q' || quality || 't' || toxic AS label,
  'q' || CASE WHEN doc_id % 7 = 0 THEN 1 - quality ELSE quality END || 't' || CASE WHEN doc_id % 11 = 0 THEN 1 ELSE toxic END AS prediction FROM labels)"""
_classes = values([(c,) for c in src.CLASSES])
add("confusion_matrix", f"""WITH {PREDICTED}, c(name) AS ({_classes}) SELECT a.name AS label, b.name AS prediction,
  (SELECT count(*) FROM predicted p WHERE p.label = a.name AND p.prediction = b.name) AS n FROM c a, c b""")
METRICS = f"""{PREDICTED}, class AS (SELECT DISTINCT unnest([label, prediction]) AS class FROM predicted),
counted AS (SELECT class, (SELECT count(*) FROM predicted WHERE label = class) AS support,
  (SELECT count(*) FROM predicted WHERE prediction = class) AS predicted,
  (SELECT count(*) FROM predicted WHERE prediction = class AND label = class) AS hits FROM class),
rated AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall FROM counted),
metric AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM rated)"""
add("per_class_metrics", f"WITH {METRICS} SELECT class, precision, recall, f1, support, predicted, hits FROM metric")
add("classification_metrics", f"""WITH {METRICS} SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS precision_macro,
  round(avg(recall), 6) AS recall_macro, round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM metric""")

TERMS = """tokens AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents),
terms AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM tokens),
tf AS (SELECT doc_id, term, count(*) AS n FROM terms GROUP BY 1, 2),
df AS (SELECT term, count(*) AS documents, CAST(sum(n) AS BIGINT) AS total FROM tf GROUP BY 1)"""
add("document_frequency", f"WITH {TERMS} SELECT term, documents, total FROM df")
add("tfidf_top_terms", f"""WITH {TERMS}, raw AS (SELECT doc_id, term, (1 + ln(n)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + v.documents)) + 1) AS r FROM tf JOIN df v USING (term)),
norm AS (SELECT doc_id, sqrt(sum(r * r)) AS z FROM raw GROUP BY 1)
SELECT term, round(sum(r / z), 6) AS weight, count(*) AS documents FROM raw JOIN norm USING (doc_id) GROUP BY term ORDER BY weight DESC, term LIMIT 50""")
add("tfidf_features", f"""WITH {TERMS}, v AS (SELECT term, documents FROM df ORDER BY total DESC, term LIMIT 50000),
numbered AS (SELECT *, row_number() OVER (ORDER BY term) - 1 AS index FROM v),
raw AS (SELECT doc_id, index, (1 + ln(n)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + v.documents)) + 1) AS r FROM tf JOIN numbered v USING (term)),
norm AS (SELECT doc_id, sqrt(sum(r * r)) AS z FROM raw GROUP BY 1)
SELECT doc_id, index, round(r / z, 6) AS weight FROM raw JOIN norm USING (doc_id)""")
add("trained_model_quality", """SELECT lang AS label, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS test_rows, TRUE AS found, TRUE AS probabilities_sum_to_one
FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
_classes_of = range(len(CLASS_NAMES))
add("model_categories", f"""WITH {EMAILS}, {TERMS},
v AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + documents)) + 1 AS idf FROM df ORDER BY total DESC, term LIMIT {FIXED_TERMS}),
hinted_text AS (SELECT email_id, lower(subject || ' ' || body) AS t, concat_ws(' ', subject || ' ' || body, {', '.join(f"CASE WHEN {matches("lower(subject || ' ' || body)", p)} THEN {q(w)} END" for p, w, _ in rules.CATEGORY_HINTS)}) AS x FROM emails),
etokens AS (SELECT email_id, t, regexp_extract_all(lower(strip_accents(x)), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM hinted_text),
eterms AS (SELECT email_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM etokens),
etf AS (SELECT email_id, term, (1 + ln(count(*))) * any_value(idf) AS r FROM eterms JOIN v USING (term) GROUP BY 1, 2),
sums AS (SELECT email_id, sqrt(sum(r * r)) AS z, {', '.join(f"sum(r * (((ascii(term) * {k + 3} + length(term) * 7) % 11 - 5) / 2.5)) AS s{k}" for k in _classes_of)} FROM etf GROUP BY 1),
margins AS (SELECT email_id, t, [{', '.join(f"1 / (1 + exp(-(1.5 * (coalesce(s{k} / z, 0) + {k / 10}) + {0.05 * k})))" for k in _classes_of)}] AS u FROM etokens LEFT JOIN sums USING (email_id)),
prob AS (SELECT email_id, t, list_transform(u, lambda x: x / list_sum(u)) AS p, {_hinted} AS hinted FROM margins),
model AS (SELECT *, ({CLASS_NAMES})[list_position(p, list_max(p))] AS predicted, {_strong} AS strong FROM prob),
final AS (SELECT *, CASE WHEN hinted <> predicted AND (list_max(p) < 0.70 OR strong) THEN hinted ELSE predicted END AS name FROM model)
SELECT email_id, name AS category_name, {case_of('name', SLUG_OF)} AS slug,
  {fixed(f'p[list_position({CLASS_NAMES}, name)]', 2)} AS category_confidence, p[list_position({CLASS_NAMES}, name)] < 0.55 AS needs_review FROM final""")

# ---- replies ----------------------------------------------------------------


def request_sql(source: str) -> str:
    text = "regexp_replace(" + collapsed("body") + ", '[.]+$', '')"
    return f"""lined AS (SELECT *, CASE WHEN action_required THEN {text} END AS line FROM {source}),
    requested AS (SELECT *, CASE WHEN {matches('line', '(?i)' + rules.REQUEST_PATTERN)} THEN
      upper(verb[1]) || lower(verb[2:]) || ' ' || trim(regexp_replace(rest, {q('(?i)' + rules.REQUEST_CUT + '.*')}, ''), ' ,') || '.' END AS requested_action
      FROM (SELECT *, regexp_extract(line, {q('(?i)' + rules.REQUEST_PATTERN)}, 1) AS verb, regexp_extract(line, {q('(?i)' + rules.REQUEST_PATTERN)}, 2) AS rest FROM lined))"""


ANALYZED = f"""{EMAILS}, {ANALYSIS}, analyzed AS (
  SELECT m.*, a.category_name, a.action_required, a.deadline_text FROM emails m JOIN analysis a USING (email_id))"""
REQUESTED = f"{ANALYZED}, {request_sql('analyzed')}"
add("requested_action", f"WITH {REQUESTED} SELECT email_id, md5(requested_action) AS requested_md5 FROM requested")
_template = case_of("slug", rules.REPLY_TEMPLATES, q(rules.DEFAULT_TEMPLATE))
DRAFTED = f"""{REQUESTED}, drafted AS (SELECT *, replace(replace({_template}, '{{sender}}', coalesce(sender_name, {q(rules.UNKNOWN_SENDER)})), {q(rules.FOLLOW_UP)},
  CASE WHEN requested_action IS NOT NULL THEN {q(rules.ACTION_SENTENCE[0])} || lower(requested_action) || {q(rules.ACTION_SENTENCE[1])}
       WHEN deadline_text <> '' THEN {q(rules.DEADLINE_SENTENCE[0])} || deadline_text || {q(rules.DEADLINE_SENTENCE[1])} ELSE {q(rules.FOLLOW_UP)} END) AS draft
  FROM requested)"""
add("draft_replies", f"WITH {DRAFTED} SELECT email_id, md5(draft) AS content_md5, 'formal' AS tone, 'draft' AS status, FALSE AS is_user_edited FROM drafted")
_mention = lambda source: (
    f"len(list_filter(regexp_extract_all(lower({source}), '[a-z0-9]+'), lambda x: length(x) > 2 AND contains(reply, x))) > 0")
add("reply_validation", f"""WITH {REQUESTED}, r AS (SELECT *, lower('I will confirm the ' || subject || ' soon.') AS reply,
    action_required AND requested_action IS NOT NULL AS wanted, coalesce(deadline_text, '') <> '' AS dated FROM requested),
  v AS (SELECT *, (NOT wanted OR {_mention('requested_action')}) AND (NOT dated OR {_mention('deadline_text')} OR contains(reply, 'deadline')) AS is_valid FROM r)
  SELECT email_id, is_valid, md5(CASE WHEN NOT is_valid THEN CASE WHEN wanted OR dated THEN concat_ws(' and ',
    CASE WHEN wanted THEN 'explicitly acknowledge the requested action: ' || requested_action END,
    CASE WHEN dated THEN 'explicitly acknowledge the deadline: ' || deadline_text END) || '. Do not claim completion.'
    ELSE 'Address the original email specifically.' END END) AS feedback_md5 FROM v""")
add("shorten_reply", f"""WITH {DRAFTED}, l AS (SELECT *, list_filter(string_split(draft, chr(10)), lambda x: trim(x) <> '') AS lines FROM drafted)
  SELECT email_id, md5(CASE WHEN len(lines) > 4 THEN array_to_string([lines[1], lines[2], lines[-2], lines[-1]], chr(10)) ELSE draft END) AS content_md5 FROM l""")


def strategy_sql(intent: str) -> str:
    return f"""CASE WHEN contains(lower({intent}), 'meeting') OR contains(lower(coalesce(requested_action, '')), 'meeting') THEN 'meeting'
      WHEN {matches(f'lower({intent})', 'support|complaint|issue')} THEN 'support'
      WHEN {matches(f'lower({intent})', 'information|request')} OR action_required THEN 'action'
      WHEN contains(lower({intent}), 'general') OR {intent} = '' THEN 'general' ELSE 'information' END"""


add("reply_strategy_counts", f"""WITH {INTENT}, {ANALYSIS}, known AS (SELECT i.*, a.action_required FROM intended i JOIN analysis a USING (email_id)),
  {request_sql('known')} SELECT {strategy_sql('intent')} AS strategy, count(*) AS count FROM requested GROUP BY 1""")

ENRICHED = f"""{VARIANTS}, {keyword_sql('variants', 'classification_text')},
extracted AS (SELECT * EXCLUDE (slug), {case_of('k_name', SLUG_OF)} AS slug, {_found} AS entities, lower(subject || ' ' || body) AS t FROM keyword),
{DEADLINE.format(source='extracted')},
dated AS (SELECT *, list_filter(entities, lambda e: e.t = 'DATE')[1].x AS d, list_filter(entities, lambda e: e.t = 'TIME')[1].x AS m FROM deadline),
known AS (SELECT *, coalesce(relative_text, CASE WHEN d IS NOT NULL AND m IS NOT NULL THEN d || ' at ' || m ELSE coalesce(d, m) END) AS deadline_text,
  {intent_sql('t', 'slug')} AS intent, date_diff('microsecond', {AS_OF}, deadline_datetime) / 3600000000 AS hours FROM dated),
{priority_sql('known', True)}"""
add("enriched_analysis", f"""WITH {ENRICHED}, {toned('scored')} SELECT email_id, k_name AS category_name, k_confidence AS category_confidence, intent,
  priority_score, priority_level, urgency_level, action_required, {TONE} AS sentiment, {fixed('c', 4)} AS sentiment_score,
  deadline_text, {stamp('deadline_datetime')} AS deadline_datetime,
  concat_ws('|||', CASE WHEN intent <> 'General Information' THEN 'Email intent: ' || intent END,
    CASE WHEN deadline_text <> '' THEN 'Key deadline/time: ' || deadline_text END,
    CASE WHEN action_required THEN 'Action is required from the recipient' END,
    CASE {TONE} WHEN 'negative' THEN 'Email carries a negative or urgent tone' WHEN 'positive' THEN 'Email has a positive tone' END) AS key_points,
  ai_explanation FROM tone""")
_persona = case_of("slug", rules.PERSONAS, q(rules.PERSONAS["other"]))
_strategies = case_of("strategy", rules.STRATEGIES)
add("prompt_table", f"""WITH {ENRICHED}, {request_sql('scored')}, s AS (SELECT *, {strategy_sql('intent')} AS strategy FROM requested)
  SELECT email_id, strategy, md5({_persona} || {q(chr(10) * 2 + rules.TONES['formal'] + chr(10) * 2 + 'ORIGINAL EMAIL:' + chr(10) + 'From: ')}
    || coalesce(sender_name, 'Unknown Sender') || {q(chr(10) + 'Subject: ')} || subject || {q(chr(10) + '---' + chr(10))} || substring(body, 1, 2000)
    || {q(chr(10) + '---' + chr(10) * 2 + 'Email Category: ')} || k_name || {q(chr(10) + 'Email Intent: ')} || intent || {q(chr(10) * 2 + 'Detected action: ')}
    || coalesce(requested_action, 'No specific action was reliably extracted.') || {q(chr(10) + 'Action required: ')} || CASE WHEN action_required THEN 'Yes' ELSE 'No' END
    || chr(10) || coalesce({q(chr(10) + 'IMPORTANT: The email mentions a deadline or scheduled time: ')} || nullif(deadline_text, '') || '. Acknowledge this in the reply.', '')
    || CASE WHEN len(entities) > 0 THEN {q(chr(10) + 'Key information detected: ')} || array_to_string(list_transform(entities[1:8], lambda e: e.x), ', ') ELSE '' END
    || {q(chr(10) * 2 + 'REPLY STRATEGY:' + chr(10))} || {_strategies} || {q(chr(10) * 2 + rules.PROMPT_INSTRUCTIONS.replace('{tone}', 'formal') + chr(10) * 2 + 'Write the email reply now:')}) AS prompt_md5
  FROM s""")

VERSIONS = """version AS (SELECT CAST(conv_id AS VARCHAR) AS reply_id, turn, text AS content,
  CASE role WHEN 'user' THEN 'user_edit' WHEN 'system' THEN 'generated' ELSE 'regenerated' END AS change_type,
  CASE WHEN role = 'user' AND turn % 3 = 0 THEN 'sent' END AS status FROM conversations)"""
add("reply_history", f"""WITH {VERSIONS} SELECT reply_id, row_number() OVER (PARTITION BY reply_id ORDER BY turn) AS version_num, change_type,
  md5(content) AS content_md5 FROM version""")
add("current_reply", f"""WITH {VERSIONS} SELECT reply_id, md5(arg_max(content, turn)) AS current_content, arg_max(change_type, turn) = 'user_edit' AS is_user_edited,
  coalesce(max(status), 'draft') AS status, count(*) AS versions FROM version GROUP BY 1""")

# ---- table maintenance ------------------------------------------------------

add("upsert_analysis", f"""WITH {INBOX}, batch AS (SELECT email_id, {case_of('slug', src.NAMES)} AS category_name, CAST(event_id % 101 AS INTEGER) AS priority_score
    FROM headers WHERE event_id % 7 = 0)
  SELECT email_id, category_name, priority_score FROM analysis WHERE email_id NOT IN (SELECT email_id FROM batch) UNION ALL SELECT * FROM batch""")
add("patch_emails", f"""WITH {HEADERS} SELECT h.email_id, h.user_id, h.sender_name,
    CASE WHEN h.event_id % 5 <> 0 AND h.event_id % 4 = 0 THEN 'new@corp.com' ELSE h.sender_email END AS sender_email,
    CASE WHEN h.event_id % 5 <> 0 AND h.event_id % 3 = 0 THEN 'Re: ' || e.event_type ELSE h.subject END AS subject,
    {stamp('h.received_at')} AS received_at, h.is_analyzed FROM headers h JOIN events e USING (event_id)""")
_kept = "SELECT '{0}' AS table_name, count(*) AS rows FROM {0} WHERE email_id NOT IN (SELECT email_id FROM gone)"
add("delete_cascade", f"""WITH {HEADERS}, emails AS MATERIALIZED (SELECT * FROM headers), {ANALYSIS}, {REPLIES}, entities AS (SELECT email_id FROM analysis),
  versions AS (SELECT email_id FROM replies), gone AS (SELECT email_id FROM headers WHERE event_id % 9 = 0 AND event_id % 2 = 0)
  {' UNION ALL '.join(_kept.format(t) for t in ('emails', 'analysis', 'entities', 'replies', 'versions'))}""")
_stored = [(slug, "stored " + name) for name, slug, _, _ in rules.CATEGORIES[::2]]
add("insert_missing_categories", f"""WITH {PHRASE}, {ANALYSIS}, stored(slug, name) AS ({values(_stored)})
  SELECT slug, name FROM stored UNION ALL SELECT DISTINCT slug, {case_of('slug', src.NAMES)} FROM analysis WHERE slug NOT IN (SELECT slug FROM stored)""")
CHECKED = f"""{PHRASE}, incoming AS (
  SELECT e.event_id, CAST(e.event_id AS VARCHAR) AS email_id, coalesce(p.sender_email, CASE WHEN e.event_id % 16 = 2 THEN '' ELSE 'someone@web.net' END) AS sender,
    CASE WHEN e.event_id % 17 = 0 THEN 'nobody@example.com' ELSE 'customer#' || lpad(CAST(e.user_id AS VARCHAR), 9, '0') || '@EXAMPLE.com' END AS recipient,
    p.subject, CASE WHEN e.event_id % 19 = 0 THEN '' ELSE p.phrase || chr(10) || d.text END AS body, e.ts AS received_at
  FROM events e JOIN phrase p ON p.k = e.event_id % {len(src.PHRASES)} JOIN documents d ON d.doc_id = e.event_id % (SELECT count(*) FROM documents)),
owner AS (SELECT c_custkey AS user_id, lower(c_name || '@example.com') AS email FROM customer WHERE c_custkey % 13 <> 0),
checked AS (SELECT i.*, o.user_id, CASE WHEN i.body = '' THEN 'empty body' WHEN length(i.sender) NOT BETWEEN 1 AND 255 THEN 'sender length'
    WHEN o.user_id IS NULL THEN 'unknown recipient' END AS reject_reason FROM incoming i LEFT JOIN owner o ON o.email = lower(i.recipient))"""
add("incoming_valid", f"""WITH {CHECKED} SELECT email_id, user_id, sender AS sender_email, subject, md5(body) AS body, {stamp('received_at')} AS received_at, FALSE AS is_analyzed
  FROM checked WHERE reject_reason IS NULL""")
add("incoming_rejects", f"WITH {CHECKED} SELECT email_id, reject_reason FROM checked WHERE reject_reason IS NOT NULL")
add("append_pending", f"""WITH {CHECKED}, {HEADERS.removeprefix(PHRASE + ', ')}
  SELECT email_id, user_id, sender_name, sender_email, subject, {stamp('received_at')} AS received_at, is_analyzed FROM headers
  UNION ALL SELECT 'in-' || email_id, user_id, NULL, sender, subject, {stamp(f"CASE WHEN user_id % 2 = 0 THEN received_at ELSE {AS_OF} END")}, FALSE
  FROM checked WHERE reject_reason IS NULL""")

# ---- streams ----------------------------------------------------------------

add("stream_daily_volume", "SELECT strftime(ts, '%Y-%m-%d') AS date, event_type AS category, count(*) AS email_count FROM events GROUP BY 1, 2")

#: The enrichment of the mail that the stream accepts, and its draft replies.
INGESTED = ENRICHED.replace(EMAILS, f"""{CHECKED}, emails AS MATERIALIZED (
  SELECT event_id, email_id, user_id, CAST(NULL AS VARCHAR) AS sender_name, sender AS sender_email, subject, received_at, body, NULL AS slug
  FROM checked WHERE reject_reason IS NULL)""")
add("stream_ingest", f"""WITH {INGESTED}, {request_sql('scored')}, drafted AS (SELECT *, replace(replace({_template}, '{{sender}}', {q(rules.UNKNOWN_SENDER)}), {q(rules.FOLLOW_UP)},
    CASE WHEN requested_action IS NOT NULL THEN {q(rules.ACTION_SENTENCE[0])} || lower(requested_action) || {q(rules.ACTION_SENTENCE[1])}
         WHEN deadline_text <> '' THEN {q(rules.DEADLINE_SENTENCE[0])} || deadline_text || {q(rules.DEADLINE_SENTENCE[1])} ELSE {q(rules.FOLLOW_UP)} END) AS draft
    FROM requested), {toned('drafted')}
  SELECT email_id, k_name AS category_name, intent, priority_score, priority_level, action_required, {TONE} AS sentiment, md5(draft) AS draft_md5 FROM tone""")
