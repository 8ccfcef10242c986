"""Entities and deadlines as columns over cleaned text."""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType

from . import rules
from .matching import IGNORE_CASE
from .sql import literal, text_literal
from .words import MONTHS, Seen

#: What a match of each entity pattern starts with.  Tested before the word
#: boundary, which costs far more per character.
STARTS = ["[ty]", "[mtwfs]", r"\d", "[jfmasond]", r"\d", r"\d", None, None, None]

ENTITY = "struct<entity_type:string,entity_text:string,confidence:double,char_position:int>"


def _may_match(seen: Seen, has_digit: str) -> list[str]:
    """For each entity pattern, a cheap test it cannot match without."""
    has = lambda *words: seen.any(words, fold=True)
    digit_and = lambda *words: f"({has_digit} AND {has(*words)})"
    money = lambda sign: f"({digit_and(sign)} OR {has(sign + ',')})"
    return [
        has("today", "tomorrow", "yesterday"),
        has("day"),
        digit_and("/", "-"),
        digit_and(*MONTHS),
        digit_and(":"),
        digit_and("am", "pm"),
        money("$"), money("₹"), money("£"),
    ]


def _steps(text: str, pattern: str, matches: str) -> str:
    """From each match's start the way to the next: the text between them, and the match itself.

    There is one more gap than matches; the last step leads to the end of the text.
    """
    gaps = f"transform(split({text}, {text_literal(pattern)}, -1), g -> char_length(g))"
    widths = f"concat(array(0), transform({matches}, m -> char_length(m)))"
    return f"zip_with({gaps}, {widths}, (g, w) -> g + w)"


def _added_up(lists: pa.Array) -> pa.Array:
    """Running sums within each inner list of an array of lists of lists."""
    inner = lists.flatten()
    sizes = inner.value_lengths().to_numpy(zero_copy_only=False)
    total = np.cumsum(inner.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(sizes)
    before = np.where(ends > sizes, np.append(0, total)[ends - sizes], 0)
    sums = pa.array((total - np.repeat(before, sizes)).astype(np.int32))
    inner = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), sums)
    outer = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
    return pa.ListArray.from_arrays(pa.array(outer.astype(np.int32)), inner)


# evaluated once: the optimizer takes a nondeterministic function neither apart nor twice
_running = arrow_udf(_added_up, ArrayType(ArrayType(IntegerType()))).asNondeterministic()


def add_entities(df: DataFrame, text: str, seen: Seen, out: str = "entities") -> DataFrame:
    """Add the array of entities of a cleaned text, by type, pattern and place.

    The list is as long as the text allows and stays in the row.
    """
    numbered = [
        (f"_m{i}", kind, IGNORE_CASE + (f"(?={start})" if start else "") + pattern, confidence)
        for i, (start, (kind, pattern, confidence)) in enumerate(zip(STARTS, rules.ENTITY_PATTERNS))
    ]
    df = df.withColumn("_digit", F.coalesce(F.col(text).rlike(r"\p{Nd}"), F.lit(False)))
    guards = _may_match(seen, "_digit")
    df = df.withColumns({
        name: F.expr(
            f"CASE WHEN {guard} THEN regexp_extract_all({text}, {text_literal(pattern)}, 0) "
            "ELSE cast(array() AS array<string>) END"
        )
        for guard, (name, _, pattern, _) in zip(guards, numbered)
    })
    none = "cast(array() AS array<int>)"
    steps = [f"CASE WHEN size({name}) > 0 THEN {_steps(text, pattern, name)} ELSE {none} END" for name, _, pattern, _ in numbered]
    df = df.withColumn("_steps", F.expr(f"array({', '.join(steps)})")).withColumn("_at", _running("_steps"))
    parts = []
    for i, (name, kind, _, confidence) in enumerate(numbered):
        listed = (
            f"transform({name}, (m, n) -> named_struct('entity_type', {text_literal(kind)}, 'entity_text', m, "
            f"'confidence', {literal(confidence)}, 'char_position', get(get(_at, {i}), n)))"
        )
        parts.append(f"CASE WHEN size({name}) > 0 THEN {listed} ELSE cast(array() AS array<{ENTITY}>) END")
    df = df.withColumn(out, F.expr(f"concat({', '.join(parts)})"))
    return df.drop("_digit", "_steps", "_at", *[name for name, *_ in numbered])


def entity_deadline(entities: Column) -> Column:
    """Deadline text from entities: first date and first time, or either."""
    date = F.get(F.filter(entities, lambda e: e["entity_type"] == "DATE"), F.lit(0))["entity_text"]
    time = F.get(F.filter(entities, lambda e: e["entity_type"] == "TIME"), F.lit(0))["entity_text"]
    return F.when(date.isNotNull() & time.isNotNull(), F.concat(date, F.lit(" at "), time)).otherwise(
        F.coalesce(date, time)
    )


def moment(as_of: datetime | Column) -> Column:
    """The job's clock as a timestamp column."""
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp")


def add_relative_deadline(
    df: DataFrame,
    text: str,
    seen: Seen,
    as_of: datetime | Column,
    text_out: str = "deadline_text",
    time_out: str = "deadline_datetime",
) -> DataFrame:
    """Add the first relative deadline found in the text, and its moment."""
    now = moment(as_of)

    def found(pattern: str, *guards: Column, group: int = 0) -> Column:
        match = F.nullif(F.regexp_extract(F.col(text), IGNORE_CASE + pattern, group), F.lit(""))
        for guard in reversed(guards):
            match = F.when(guard, match)
        return match

    has = lambda *words: F.expr(seen.any(words, fold=True))
    df = df.withColumns({
        "_two_days": found(rules.DEADLINE_TWO_DAYS, has("day"), has("2", "two")),
        "_48_hours": found(rules.DEADLINE_48_HOURS, has("within"), has("48")),
        "_tomorrow": found(rules.DEADLINE_TOMORROW, has("tomorrow")),
        "_weekday": found(rules.DEADLINE_WEEKDAY, has("day"), has("by", "before")),
    })
    # the weekday is the last word of its match
    name = F.element_at(F.split(F.lower("_weekday"), " "), -1)
    target = F.array_position(F.lit(rules.WEEKDAYS), name).cast("int") - 1
    ahead = F.pmod(target - F.weekday(now), F.lit(7))
    ahead = F.when(ahead == 0, 7).otherwise(ahead)
    end_of_day = F.date_trunc("day", now) + F.make_dt_interval(days=ahead + 1) - F.expr("INTERVAL 1 MICROSECOND")
    return df.withColumns({
        text_out: F.coalesce("_two_days", "_48_hours", "_tomorrow", "_weekday"),
        time_out: F.when(F.col("_two_days").isNotNull() | F.col("_48_hours").isNotNull(), now + F.expr("INTERVAL 2 DAYS"))
        .when(F.col("_tomorrow").isNotNull(), now + F.expr("INTERVAL 1 DAY"))
        .when(F.col("_weekday").isNotNull(), end_of_day),
    }).drop("_two_days", "_48_hours", "_tomorrow", "_weekday")
