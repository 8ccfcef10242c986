"""Rules as SQL tests: words first, regular expressions only where they pass."""

from __future__ import annotations

from collections.abc import Iterable

from .sql import all_of, any_of, text_literal
from .words import NEEDS, Seen, first_letters, hint_words, literal_pieces

#: Java flags that give Python's meaning to the shared patterns: Unicode
#: character classes, and "." stopping at "\n" only.
CASE_SENSITIVE = "(?Ud)"
IGNORE_CASE = "(?iuUd)"


def found(column: str, regex: str) -> str:
    return f"rlike({column}, {text_literal(regex)})"


def may_hold(seen: Seen, patterns: Iterable[str]) -> str:
    """Has the text the words that one of the signal patterns needs?"""
    return any_of(all_of(seen.any(group) for group in NEEDS[pattern]) for pattern in patterns)


def holds(seen: Seen, lowered: str, pattern: str) -> str:
    """Does the signal pattern occur in the lower-cased text column?

    The first letter is tested before the word boundary, which costs far more
    per character.
    """
    start = first_letters(pattern)
    regex = CASE_SENSITIVE + (f"(?=[{start}])" if start else "") + pattern
    return all_of([*(seen.any(group) for group in NEEDS[pattern]), found(lowered, regex)])


def holds_any(seen: Seen, lowered: str, patterns: Iterable[str]) -> str:
    return any_of(holds(seen, lowered, pattern) for pattern in patterns)


def loose_match(seen: Seen, text: str, pattern: str) -> str:
    """Match, ignoring case, a pattern built only from literals, ``.``, ``.*`` and ``|``.

    Each alternative is tested on its own: a pure literal is a word test; the
    others first need all their literal pieces somewhere in the text.
    """
    tests = []
    for alternative in pattern.split("|"):
        pieces = literal_pieces(alternative)
        present = seen.all(pieces, fold=True)
        whole = pieces == [alternative]
        tests.append(present if whole else all_of([present, found(text, IGNORE_CASE + alternative)]))
    return any_of(tests)


def phrase_occurs(seen: Seen, lowered: str, pattern: str) -> str:
    """Does a phrase pattern (whole words) occur in the lower-cased text column?"""
    return all_of([seen.any(hint_words(pattern)), found(lowered, CASE_SENSITIVE + pattern)])
