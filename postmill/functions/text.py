"""Text columns: entity decoding, cleaning, normalization, tokens, rounding."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable
from functools import cache, reduce
from html import entities

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..session import small_batches

# Whitespace as Python's str methods see it: Unicode plus the four separators.
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"

# Entities that are decoded inside the JVM ("&amp;" must be last)
COMMON_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]
# an "&" that may start an entity and is not one of the above
RARE_ENTITY = (
    "&(?!(?:" + "|".join(entity[1:-1] for entity, _ in COMMON_ENTITIES) + ");)"
    r"[^\t\n\f <&;]"
)


def _text_function(change):
    """An Arrow function over strings, sent to the workers as it is.

    Declared nondeterministic so that it is evaluated once: the optimizer takes
    Python functions for free and would copy the call, with all that computes
    its argument, into every expression that reads the result.
    """

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(change, na_action="ignore")

    return pandas_udf(each, StringType()).asNondeterministic()


def _unescape(text: Column) -> Column:
    return _text_function(html.unescape)(text)


def _unescape_terminated(text: Column) -> Column:
    def known(match) -> str:
        name = match.group(0)[1:]
        return html.unescape(match.group(0)) if name[0] == "#" or name in entities.html5 else match.group(0)

    return _text_function(lambda t: re.sub(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{0,31});", known, t))(text)


def _nfkc(text: Column) -> Column:
    return _text_function(lambda t: unicodedata.normalize("NFKC", t))(text)


@cache
def _base() -> np.ndarray:
    """Whether a character is none of the combining marks, by its number."""
    return np.array([not unicodedata.combining(c) for c in map(chr, range(0x110000))])


def _without_accents(text: Column) -> Column:
    def strip(t: str) -> str:
        numbers = np.frombuffer(unicodedata.normalize("NFKD", t).encode("utf-32-le"), np.uint32)
        return numbers[_base()[numbers]].tobytes().decode("utf-32-le")

    return _text_function(strip)(text)


def _single_spaces(text: Column) -> Column:
    return _text_function(lambda t: " ".join(t.split()))(text)


def has_rare_entity(text: Column) -> Column:
    return F.contains(text, F.lit("&")) & text.rlike(RARE_ENTITY)


def decode_entities(text: Column, unterminated: bool = True) -> Column:
    """HTML entities decoded, once, over the whole text.

    Common entities are replaced in the JVM.  Only texts with another entity
    cross to Python; the rest are sent as null, which costs nothing.  References
    without semicolon count if ``unterminated``.
    """
    common = text
    for entity, char in COMMON_ENTITIES:
        common = F.replace(common, F.lit(entity), F.lit(char))
    decoded = (_unescape if unterminated else _unescape_terminated)(F.when(has_rare_entity(text), text))
    return F.when(F.contains(text, F.lit("&")), F.coalesce(decoded, common)).otherwise(text)


def nfkc(text: Column) -> Column:
    """Compatibility composition; pure ASCII is left in the JVM."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def strip_accents(text: Column) -> Column:
    """Base letters without combining marks; pure ASCII is left in the JVM."""
    return F.coalesce(_without_accents(F.when(F.octet_length(text) != F.length(text), text)), text)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]+>", " ")


def replace_urls(text: Column, by: str) -> Column:
    return F.regexp_replace(text, rf"(?U)https?://{NOT_SPACE}+|www\.{NOT_SPACE}+", by)


def cut_signature(text: Column) -> Column:
    """Drop everything from the first line that starts with two dashes or underscores."""
    return F.regexp_replace(text, r"(?s)\n[-_]{2,}.*", "")


def cut_quoted_header(text: Column) -> Column:
    """Drop quoted-reply and forwarded-mail headers, greedily."""
    return F.regexp_replace(text, r"(?s)(On .+wrote:|From:.+\nSent:.+\nTo:.+)", "")


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"(?U){SPACE}+", " "))


def _has(text: Column, *literals: str) -> Column:
    tests = [F.contains(text, F.lit(literal)) for literal in literals]
    return reduce(lambda a, b: a | b, tests)


def _each(df: DataFrame, columns: Iterable[str], needed, change) -> DataFrame:
    """Change the texts that need it, as a projection of its own.

    The test is a byte scan; most texts then skip the regular expression.
    """
    return df.withColumns({
        name: F.when(needed(F.col(name)), change(F.col(name))).otherwise(F.col(name)) for name in columns
    })


def _without_markup(df: DataFrame, columns: Iterable[str], url: str) -> DataFrame:
    df = _each(df, columns, lambda t: _has(t, "<"), strip_tags)
    return _each(df, columns, lambda t: _has(t, "://", "www."), lambda t: replace_urls(t, url))


def _collapsed(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Each run of white space as one space, none at the ends.

    ``SPACE`` is what ``str.split`` splits at: one pass in Python, where tests and
    regular expressions of the JVM read every text some fifteen times.
    """
    small_batches(df.sparkSession)
    return df.withColumns({name: _single_spaces(F.col(name)) for name in columns})


def add_clean_text(df: DataFrame, columns: dict[str, str], decoded: bool = False, unterminated: bool = True) -> DataFrame:
    """Add cleaned, lower-case copies of text columns (``{input: output}``).

    ``decoded`` says the inputs have their HTML entities decoded already; else
    references without semicolon are decoded if ``unterminated``.
    """
    outs = list(columns.values())
    df = df.withColumns({out: F.coalesce(F.col(name), F.lit("")) for name, out in columns.items()})
    if not decoded:
        df = df.withColumns({out: decode_entities(F.col(out), unterminated) for out in outs})
    df = _without_markup(df, outs, " URL ")
    df = _each(df, outs, lambda t: _has(t, "\n-", "\n_"), cut_signature)
    quoted = lambda t: _has(t, "wrote:") | (_has(t, "\nSent:") & _has(t, "\nTo:"))
    df = _each(df, outs, quoted, cut_quoted_header)
    df = _collapsed(df, outs)
    return df.withColumns({out: F.lower(out) for out in outs})


def add_entity_text(df: DataFrame, decoded: str, out: str) -> DataFrame:
    """Lighter cleaning that keeps case and signature, for entity extraction."""
    df = df.withColumn(out, F.col(decoded))
    return _collapsed(_without_markup(df, [out], ""), [out])


def classification_text(subject_clean: Column, body_clean: Column) -> Column:
    """The subject counts twice against the body."""
    return F.trim(F.concat(subject_clean, F.lit(" "), subject_clean, F.lit(" "), body_clean))


def add_training_text(df: DataFrame, column: str, out: str) -> DataFrame:
    """Normalized text for training: decode, NFKC, tags to spaces, collapse, lower."""
    df = df.withColumn(out, F.coalesce(F.col(column), F.lit("")))
    df = df.withColumn(out, decode_entities(F.col(out)))
    df = df.withColumn(out, nfkc(F.col(out)))
    return df.withColumn(out, F.lower(collapse_space(strip_tags(F.col(out)))))


def word_tokens(text: Column) -> Column:
    """Runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def with_bigrams(tokens: Column) -> Column:
    """Single words followed by pairs of neighbours.

    Pass a materialized column: it is read once per word.
    """
    pairs = F.transform(
        F.slice(tokens, F.lit(2), F.size(tokens)),
        lambda word, i: F.concat_ws(" ", F.get(tokens, i), word),
    )
    return F.concat(tokens, pairs)


def split_items(text: Column) -> Column:
    """A ``|||``-delimited list as an array without blank items."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\|\|\|"), lambda item: ~item.rlike(f"(?U)^{SPACE}*$"))


def join_items(items: Column) -> Column:
    return F.concat_ws("|||", items)


def round_exact(value: Column, digits: int) -> Column:
    """Round to the nearest decimal of the exact binary value, ties to even.

    ``round`` and ``bround`` work on the shortest decimal text of the double
    instead, and differ for values such as 0.025.
    """
    return F.regexp_replace(F.format_number(value, digits), ",", "").cast("double")
