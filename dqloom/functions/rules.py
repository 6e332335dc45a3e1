"""Row predicates as Spark SQL text.

A rule is a boolean expression that is true for a *violating* row.  NULL means
"not violating", so rules follow SQL's three-valued logic.  Text (rather than
``Column``) keeps suites plain data: they can be declared at import time, stored
in configuration and shown in reports.  All numeric conversions are the ``try_``
kind because ANSI mode turns a bad value into a job failure otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable


def quoted(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def any_null(*columns: str) -> str:
    return " OR ".join(f"{c} IS NULL" for c in columns)


def outside(column: str, low, high) -> str:
    return f"{column} IS NOT NULL AND ({column} < {low} OR {column} > {high})"


def not_in(column: str, allowed: Iterable) -> str:
    return f"{column} IS NOT NULL AND {column} NOT IN ({', '.join(quoted(v) for v in allowed)})"


def ratio_outside(numerator: str, denominator: str, low=0, high=1) -> str:
    """A zero or missing denominator gives NULL, which is not a violation."""
    ratio = f"try_divide({numerator}, {denominator})"
    return f"({ratio} < {low} OR {ratio} > {high})"


def digits_outside(column: str, low: int, high: int) -> str:
    """For untyped text: not a plain non-negative integer, or outside the bounds."""
    number = f"try_cast({column} AS DECIMAL(38,0))"
    return (
        f"{column} IS NOT NULL AND "
        f"(NOT {column} RLIKE '^[0-9]+$' OR coalesce({number} < {low} OR {number} > {high}, true))"
    )


def same(left: str, right: str) -> str:
    """Equal and both present."""
    return f"{left} = {right}"


def negative(*columns: str) -> str:
    return " OR ".join(f"{c} < 0" for c in columns)


def equals(column: str, value) -> str:
    return f"{column} = {quoted(value)}"


def reversed_period(start: str, end: str) -> str:
    return f"{start} > {end}"
