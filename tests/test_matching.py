"""The cheap tests in front of the patterns must never reject a match."""

import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from postmill.functions import rules, words

ASCII = st.characters(min_codepoint=9, max_codepoint=126)
PATTERNS = [
    *[p for patterns, _, _ in rules.DEADLINE_TIERS for p in patterns],
    *rules.ACTION_PATTERNS, *rules.EVENT_PATTERNS, *rules.SECURITY_PATTERNS, *rules.TIME_SENSITIVE_PATTERNS,
]


def test_every_signal_pattern_has_its_words():
    assert set(PATTERNS) == set(words.NEEDS)
    assert all(word in words._NUMBER for groups in words.NEEDS.values() for group in groups for word in group)


@settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_signal_words_are_necessary(data):
    pattern = data.draw(st.sampled_from(PATTERNS))
    match = data.draw(st.from_regex(re.compile(pattern), alphabet=ASCII)).lower()
    if re.search(pattern, match):
        assert all(any(word in match for word in group) for group in words.NEEDS[pattern])


@settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_intent_words_are_necessary_and_sufficient_for_literals(data):
    pattern, _, _ = data.draw(st.sampled_from(rules.INTENTS))
    alternative = data.draw(st.sampled_from(pattern.split("|")))
    match = data.draw(st.from_regex(re.compile(alternative), alphabet=ASCII)).lower()
    pieces = words.literal_pieces(alternative)
    if re.search(alternative, match):
        assert all(piece in match for piece in pieces)
    if pieces == [alternative]:
        assert not set(".*|") & set(alternative)


def test_the_scan_finds_the_words():
    import pandas as pd

    texts = pd.Series(["Please confirm ASAP", "", None, "İnterview ſcheduled", "$5 by 10:00 am", "é" * 50])
    found = words._scanner(words.WORDS, words.BITS, words.FIELDS)(texts)
    for row, text in zip(found.itertuples(index=False), texts):
        mask = sum(getattr(row, f"lower{i}") << (words.BITS * i) for i in range(words.FIELDS))
        assert [w for n, w in enumerate(words.WORDS) if mask >> n & 1] == [w for w in words.WORDS if w in (text or "").lower()]


def screened(texts):
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.match_substring_regex(pc.ascii_lower(pa.array(texts, pa.string())), words.SCREEN).to_pylist()


@settings(max_examples=400, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_the_screen_lets_every_signal_pass(data):
    pattern = data.draw(st.sampled_from(PATTERNS))
    match = data.draw(st.from_regex(re.compile(pattern)))
    if re.search(pattern, match.lower()):
        assert screened([match, match.upper() if match.upper().lower() == match.lower() else match]) == [True, True]
    start = words.first_letters(pattern)
    assert start is None or re.search(f"(?=[{start}]){pattern}", match.lower()) or not re.search(pattern, match.lower())


def test_only_texts_with_signals_are_scanned():
    import pandas as pd
    import pyarrow as pa

    scan, scanned = words._scanner(words.WORDS, words.BITS, words.FIELDS), []

    def watched(texts):
        scanned.extend(texts)
        return scan(texts)

    # the first texts hold words of the signals, but no signal
    texts = ["By the way, at noon on the sea", None, "", "an exam and a test on sets", "Please CONFIRM", "by the 31", "Kindly reply", "Respond İn time"]
    found = words._screened(watched, words.SCREEN, words.SCHEMA.names)(pa.array(texts))
    assert scanned == texts[4:]
    assert found.slice(4).to_pylist() == scan(pd.Series(texts[4:])).to_dict("records")
    assert all(bits == 0 for row in found.slice(0, 4).to_pylist() for bits in row.values())


def test_nothing_is_lowered_for_texts_without_signals(emails):
    from postmill.functions.priority import lowered_for_signals
    from postmill.functions.words import Seen, add_seen

    df = add_seen(emails(("s", "By the way", None, "other"), ("s", "PLEASE Confirm", None, "other")), {"body": "_w"}, signals_only=True)
    rows = df.select("body", lowered_for_signals(Seen("_w"), "body").alias("lowered")).collect()
    assert [r.lowered for r in rows] == [None, "please confirm"]


ODD = ["İ", "ı", "ſ", "K", "é", "₹", "£", "\U0001f600", "ß", "Σ", "\n", " "]


@settings(max_examples=60, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(st.none(), st.lists(st.one_of(st.sampled_from(words.WORDS), st.sampled_from(words.WORDS).map(str.upper), st.sampled_from(ODD), st.text(max_size=3)), max_size=8).map("".join)), max_size=9), st.integers(0, 1500))
def test_the_scan_in_lanes_finds_what_the_scan_by_text_finds(texts, pad):
    """one pass per text and match in Python took most of the scan's time."""
    import pandas as pd
    import pyarrow as pa

    texts = ["x" * pad, *texts, "x" * pad + words.WORDS[pad % len(words.WORDS)]]  # words across the lanes' ends
    by_text = words._scanner(words.WORDS, words.BITS, words.FIELDS)(pd.Series(texts, dtype=object))
    whole = pa.array(["due", *texts, "due"], pa.string())
    found = words._lane_scanner(words.WORDS, words.BITS, words.FIELDS)(whole.slice(1, len(texts)))
    assert found.to_pylist() == by_text.to_dict("records")
    assert len(words._lane_scanner(words.WORDS, words.BITS, words.FIELDS)(pa.array([], pa.string()))) == 0
