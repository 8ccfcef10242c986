"""Which of the rules' fixed words occur in a text, found in one scan.

The rules test hundreds of literals against every text.  As that many
substring tests the text is read hundreds of times; here one pass of a
multi-word matcher over an Arrow batch returns bit masks, and the rules test
bits.  The batch is read in many lanes at once, a byte of each a step, so that
Python does some array operations per step and nothing per text or match.
Where only the priority signals are wanted, one expression for all of them
first tells which texts need the scan.
"""

from __future__ import annotations

import re
import re._constants as re_constants
import re._parser as re_parser
from collections.abc import Iterable
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType, StructField, StructType

from ..session import small_batches
from . import rules
from .sql import all_of, any_of

#: Patterns of the priority signals; each is tested behind the words it needs.
SIGNALS = [
    *(pattern for patterns, _, _ in rules.DEADLINE_TIERS for pattern in patterns),
    *rules.ACTION_PATTERNS, *rules.EVENT_PATTERNS, *rules.SECURITY_PATTERNS, *rules.TIME_SENSITIVE_PATTERNS,
]


def needed_words(pattern: str) -> list[list[str]]:
    """Groups of literals the pattern cannot match without.

    Every group must hold; a group holds if any of its words occurs.  Read off
    the parsed pattern: runs of plain characters are needed as they stand, a
    choice needs a word of one of its branches, and what may be left out needs
    nothing.
    """
    return _needed(re_parser.parse(pattern))


def _needed(parts) -> list[list[str]]:
    groups: list[list[str]] = []
    run = ""
    for code, value in [*parts, (None, None)]:
        if code == re_constants.LITERAL:
            run += chr(value)
            continue
        if code == re_constants.AT:  # takes no characters
            continue
        if len(run.strip()) > 1:
            groups.append([run])
        run = ""
        if code == re_constants.SUBPATTERN:
            groups += _needed(value[3])
        elif code == re_constants.MAX_REPEAT and value[0] > 0:
            groups += _needed(value[2])
        elif code == re_constants.BRANCH:
            branches = [_needed(branch) for branch in value[1]]
            if all(branches):  # each branch's group of longest words
                groups.append([word for found in branches for word in max(found, key=lambda group: min(map(len, group)))])
    return groups


def first_letters(pattern: str) -> str | None:
    """The characters a match can start with; none if that is not a choice of plain ones."""
    found = _first(re_parser.parse(pattern))
    return "".join(sorted(found)) if found else None


def _first(parts) -> set[str]:
    for code, value in parts:
        if code == re_constants.AT:
            continue
        if code == re_constants.LITERAL:
            return {chr(value)}
        if code == re_constants.SUBPATTERN:
            return _first(value[3])
        if code == re_constants.BRANCH:
            branches = [_first(branch) for branch in value[1]]
            return set().union(*branches) if all(branches) else set()
        break
    return set()


#: ASCII characters of each class; all others count as every class.
CLASSES = {re_constants.CATEGORY_SPACE: r"\x00-\x20", re_constants.CATEGORY_WORD: "0-9A-Za-z_", re_constants.CATEGORY_DIGIT: "0-9"}


def loosened(pattern: str) -> str:
    """A linear-time (RE2) expression that matches wherever the pattern does, and maybe elsewhere.

    Word boundaries are dropped, what is not ASCII counts as space, letter and
    digit, and long repeats have no upper bound.
    """
    return _loosened(re_parser.parse(pattern))


def _loosened(parts) -> str:
    out = ""
    for code, value in parts:
        if code == re_constants.LITERAL:
            out += re.escape(chr(value))
        elif code == re_constants.ANY:
            out += "(?s:.)"
        elif code == re_constants.IN:
            kinds = [CLASSES[item] if kind == re_constants.CATEGORY else re.escape(chr(item)) for kind, item in value]
            out += f"[{''.join(kinds)}\\x{{80}}-\\x{{10ffff}}]"
        elif code == re_constants.SUBPATTERN:
            out += f"(?:{_loosened(value[3])})"
        elif code == re_constants.BRANCH:
            out += f"(?:{'|'.join(map(_loosened, value[1]))})"
        elif code == re_constants.MAX_REPEAT:
            least, most, repeated = value
            out += f"(?:{_loosened(repeated)}){{{least},{most if most < 4 else ''}}}"
        elif code != re_constants.AT:
            raise ValueError(f"{code} cannot be loosened")
    return out


#: What lower-cased text must match for any signal or urgent word to be in it.  The letters
#: at the end are those outside ASCII that become ASCII in lower case: their texts are always scanned.
SCREEN = "|".join([*map(loosened, SIGNALS), *map(re.escape, rules.URGENCY_WORDS), "[\u0130\u212a]"])


MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
ENTITY_WORDS = ["today", "tomorrow", "yesterday", "day", "/", "-", ":", "am", "pm", "$", "$,", "₹", "₹,", "£", "£,", *MONTHS]
DEADLINE_WORDS = ["day", "2", "two", "within", "48", "tomorrow", "by", "before"]


def literal_pieces(alternative: str) -> list[str]:
    """Literals a pattern made of literals, ``.`` and ``.*`` cannot match without.

    Short pieces occur everywhere; they are left to the regular expression
    unless there is nothing longer.
    """
    pieces = [piece for piece in re.split(r"\.\*?", alternative) if piece]
    return [piece for piece in pieces if len(piece) > 3] or [max(pieces, key=len)]


def hint_words(pattern: str) -> list[str]:
    """Words of a pattern of the form ``\\b(one|two)\\b``."""
    return pattern.removeprefix(r"\b(").removesuffix(r")\b").split("|")


NEEDS = {pattern: needed_words(pattern) for pattern in SIGNALS}


def _collect() -> list[str]:
    """All words, those tested together next to each other."""
    groups = list(rules.CATEGORY_KEYWORDS.values())
    groups += [hint_words(pattern) for pattern, _, _ in rules.CATEGORY_HINTS]
    groups += [hint_words(pattern) for pattern in rules.STRONG_PHRASES.values()]
    groups += [rules.URGENCY_WORDS, ENTITY_WORDS, DEADLINE_WORDS]
    groups += [literal_pieces(alt) for pattern, _, _ in rules.INTENTS for alt in pattern.split("|")]
    groups += [group for needed in NEEDS.values() for group in needed]
    return list(dict.fromkeys(word for group in groups for word in group))


WORDS = _collect()
BITS = 60  # per field; a long has 63 that are not the sign
FIELDS = -(-len(WORDS) // BITS)
SCHEMA = StructType([StructField(f"{kind}{i}", LongType()) for kind in ("lower", "fold") for i in range(FIELDS)])


#: Letters that are ASCII in lower case, or count as ASCII where case is ignored: their texts are scanned one by one.
ODD_LETTERS = "[\u0130\u0131\u017f\u212a]"
#: Bytes that one lane of the scan reads, steps whose letters are laid out at once, classes of bytes.
LANE, STEPS, ROW = 512, 128, 64


@cache
def _automaton(words: tuple[str, ...], bits: int, fields: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray, int]:
    """Aho-Corasick over UTF-8 bytes: the class of each byte, next states (times ROW) by state and class, the
    first state at which words end, the bit masks of the words per such state, and the length of the longest word.

    States are numbered so that those at which a word ends come last.
    """
    used = sorted({byte for word in words for byte in word.encode()})  # all others are class 0
    kinds = np.zeros(256, np.uint8)
    kinds[used] = np.arange(1, len(used) + 1)
    if len(used) >= ROW:
        raise ValueError(f"words of more than {ROW - 1} different bytes")
    children: list[dict[int, int]] = [{}]
    ends: list[set[int]] = [set()]
    for number, word in enumerate(words):
        at = 0
        for kind in kinds[list(word.encode())].tolist():
            if kind not in children[at]:
                children[at][kind] = len(children)
                children.append({})
                ends.append(set())
            at = children[at][kind]
        ends[at].add(number)
    table, fail, queue = np.zeros((len(children), ROW), np.int64), [0] * len(children), [0]
    for at in queue:  # nearest states first: what a state falls back to is done before it
        if at:
            table[at] = table[fail[at]]
            ends[at] |= ends[fail[at]]
        for kind, child in children[at].items():
            fail[child] = int(table[fail[at], kind]) if at else 0
            table[at, kind] = child
            queue.append(child)
    order = sorted(range(len(children)), key=lambda at: bool(ends[at]))  # the root has no words: it stays the first
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    first = sum(not found for found in ends)
    held = np.zeros((len(order) - first, fields), np.int64)
    for at in order[first:]:
        for number in ends[at]:
            held[place[at] - first, number // bits] |= 1 << number % bits
    return kinds, place[table[order]].ravel() * ROW, first, held, max(len(word.encode()) for word in words)


def _occurrences(texts: pa.Array, words: tuple[str, ...], bits: int, fields: int) -> np.ndarray:
    """Bit masks (text, field) of the words that occur in each text; all lanes of the batch read one byte a step.

    The texts are cut into lanes of equal length, whatever their own, that run
    into the next one by less than the longest word.
    """
    kinds, table, first, held, longest = _automaton(words, bits, fields)
    out = np.zeros((len(texts), fields), np.int64)
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    starts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if starts[-1] == starts[0]:
        return out
    # every text is followed by a byte that no word has, so none goes from one into the next
    ends = starts[1:] - starts[0] + np.arange(1, len(texts) + 1)
    lanes = -(-int(ends[-1]) // LANE)
    letters, inside = np.zeros((lanes + 1) * LANE + longest, np.uint8), np.ones(ends[-1], bool)
    inside[ends - 1] = False
    letters[:ends[-1]][inside] = kinds[np.frombuffer(texts.buffers()[2], np.uint8)[starts[0]:starts[-1]]]
    rows = np.lib.stride_tricks.as_strided(letters, (lanes, LANE + longest - 1), (LANE, 1))
    state, at, found = np.zeros(lanes, np.int64), np.empty(lanes, np.int64), []
    for low in range(0, rows.shape[1], STEPS):
        for step, column in enumerate(np.ascontiguousarray(rows[:, low:low + STEPS].T), low):
            np.add(state, column, out=at)
            np.take(table, at, out=state, mode="clip")
            hits = np.flatnonzero(state >= first * ROW)
            if len(hits):
                found.append((hits * LANE + step, state[hits]))
    if found:
        places, states = (np.concatenate(part) for part in zip(*found))
        pairs = np.unique(np.searchsorted(ends, places, "right") * len(held) + states // ROW - first)
        text, begin = np.unique(pairs // len(held), return_index=True)
        out[text] = np.bitwise_or.reduceat(held[pairs % len(held)], begin)
    return out


def _scanner(words: list[str], bits: int, fields: int):
    """The scan as a function that carries all it needs to the workers."""

    def masks(texts: pd.Series) -> pd.DataFrame:
        import ahocorasick

        # building it takes less than a millisecond per batch
        automaton = ahocorasick.Automaton()
        for number, word in enumerate(words):
            automaton.add_word(word, 1 << number)
        automaton.make_automaton()

        def scan(text: str) -> int:
            mask = 0
            for _, bit in automaton.iter(text):
                mask |= bit
            return mask

        part = (1 << bits) - 1

        def row(text: str | None) -> list[int]:
            if text is None:
                text = ""
            lowered = text.lower()
            mask = scan(lowered)
            folded = mask
            if not text.isascii():
                # letters that ignore-case matching treats as ASCII
                plain = text.replace("İ", "i").lower().replace("ı", "i").replace("ſ", "s")
                if plain != lowered:
                    folded = scan(plain)
            return [m >> shift & part for m in (mask, folded) for shift in range(0, bits * fields, bits)]

        names = [f"{kind}{i}" for kind in ("lower", "fold") for i in range(fields)]
        return pd.DataFrame([row(text) for text in texts], columns=names, dtype="int64")

    return masks


def _lane_scanner(words: list[str], bits: int, fields: int):
    """The scan of an Arrow batch, with the results of ``_scanner``."""
    names = [f"{kind}{i}" for kind in ("lower", "fold") for i in range(fields)]
    one_by_one = _scanner(words, bits, fields)

    def masks(texts: pa.Array) -> pa.Array:
        # the words are ASCII or no letters, so but for the odd letters lower case matters in ASCII alone
        found = _occurrences(pc.ascii_lower(texts), tuple(words), bits, fields)
        columns = [np.ascontiguousarray(column) for column in (*found.T, *found.T)]
        odd = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, ODD_LETTERS), False).to_numpy(zero_copy_only=False))
        if len(odd):
            exact = one_by_one(texts.take(pa.array(odd)).to_pandas())
            columns = [column.copy() for column in columns]
            for name, column in zip(names, columns):
                column[odd] = exact[name]
        return pa.StructArray.from_arrays([pa.array(column) for column in columns], names)

    return masks


def _screened(masks, expression: str, names: list[str]):
    """The scan of those texts alone that match an expression in lower case; the others get no bits."""

    def some(texts: pa.Array) -> pa.Array:
        at = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(pc.ascii_lower(texts), expression), False))
        found = masks(texts.take(at).to_pandas())
        columns = []
        for name in names:
            column = np.zeros(len(texts), np.int64)
            column[at.to_numpy()] = found[name]
            columns.append(pa.array(column))
        return pa.StructArray.from_arrays(columns, names)

    return some


# Declared nondeterministic so that it is evaluated once: the optimizer takes
# Python functions for free and would copy the call, with all that computes its
# argument, into every expression that reads the result.
_masks = arrow_udf(_lane_scanner(WORDS, BITS, FIELDS), SCHEMA).asNondeterministic()
_signal_masks = arrow_udf(_screened(_scanner(WORDS, BITS, FIELDS), SCREEN, SCHEMA.names), SCHEMA).asNondeterministic()
_NUMBER = {word: i for i, word in enumerate(WORDS)}


class Seen:
    """Word tests, as SQL, on the masks of one text."""

    def __init__(self, column: str):
        self.column = column

    def _masks(self, words: Iterable[str], fold: bool) -> list[tuple[str, int]]:
        """The words as bits, per mask column that holds any of them."""
        bits: dict[int, int] = {}
        for word in words:
            field, bit = divmod(_NUMBER[word], BITS)
            bits[field] = bits.get(field, 0) | 1 << bit
        kind = "fold" if fold else "lower"
        return [(f"{self.column}_{kind}{field}", mask) for field, mask in bits.items()]

    def any(self, words: Iterable[str], fold: bool = False) -> str:
        """Does one of the words occur in the lower-cased (or case-folded) text?"""
        return any_of(f"({column} & {mask}L) != 0L" for column, mask in self._masks(words, fold))

    def all(self, words: Iterable[str], fold: bool = False) -> str:
        """Do all of the words occur?"""
        return all_of(f"({column} & {mask}L) = {mask}L" for column, mask in self._masks(words, fold))

    def count(self, words: Iterable[str], fold: bool = False) -> str:
        """How many of the words occur?"""
        return " + ".join(f"bit_count({column} & {mask}L)" for column, mask in self._masks(words, fold))

    @property
    def columns(self) -> list[str]:
        return [f"{self.column}_{kind}{field}" for kind in ("lower", "fold") for field in range(FIELDS)]


def add_seen(df: DataFrame, columns: dict[str, str], signals_only: bool = False) -> DataFrame:
    """Scan text columns for the words: ``{text column: name for Seen}``.

    All texts of a row cross to Python together, once, in small batches.  With
    ``signals_only`` a text that holds neither a signal nor an urgent word counts
    as one without words.
    """
    small_batches(df.sparkSession)
    masks = _signal_masks if signals_only else _masks
    df = df.withColumns({name: masks(F.col(text)) for text, name in columns.items()})
    flat = [
        f"coalesce({name}.{column.removeprefix(name + '_')}, 0L) AS {column}"
        for name in columns.values() for column in Seen(name).columns
    ]
    kept = [column for column in df.columns if column not in columns.values()]
    return df.selectExpr(*kept, *flat)


def drop_seen(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[column for name in names for column in Seen(name).columns])
