"""Expressions as SQL text.

Rule chains have thousands of nodes.  Built node by node through the Python
API they take seconds per query to assemble; as one SQL expression they are
parsed in milliseconds.
"""

from __future__ import annotations

from collections.abc import Iterable


def text_literal(value: str | None) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(value) -> str:
    if isinstance(value, float):
        return f"{value!r}D"
    return str(value) if isinstance(value, int) else text_literal(value)


def any_of(tests: Iterable[str]) -> str:
    return "(" + " OR ".join(tests) + ")"


def all_of(tests: Iterable[str]) -> str:
    return "(" + " AND ".join(tests) + ")"


def first_of(cases: Iterable[tuple[str, str]], default: str = "NULL") -> str:
    """Value of the first condition that holds."""
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in cases) + f" ELSE {default} END"


def map_of(table: dict) -> str:
    return "map(" + ", ".join(f"{literal(k)}, {literal(v)}" for k, v in table.items()) + ")"
