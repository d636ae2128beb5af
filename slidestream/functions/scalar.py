"""Scalar columns: wall clock, comparison strategies, text of numbers, predicates given as text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Strategy = Callable[[Column, Column], Column]


def now_millis() -> Column:
    """Milliseconds since 1970; one value for a batch or micro-batch."""
    return F.unix_millis(F.current_timestamp())


def diff(left: Column, right: Column) -> Column:
    return left - right


def greater(left: Column, right: Column) -> Column:
    """The greater of two; the other if one is null."""
    return F.greatest(left, right)


def money(value: Column) -> Column:
    """Exact addition whatever the order of rows."""
    return value.cast("decimal(18,2)")


def fixed(value: Column, places: int = 6) -> Column:
    return F.format_string(f"%.{places}f", value)


def translated(expression: str) -> str:
    """Predicates may use C-style ``&&``, ``||`` and ``!``, which SQL doesn't have or reads otherwise. Text in quotes stays."""
    parts = re.split(r"('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")", expression)
    for k in range(0, len(parts), 2):
        p = parts[k].replace("&&", " AND ").replace("||", " OR ")
        parts[k] = re.sub(r"!(?!=)", " NOT ", p)
    return "".join(parts)


def split_tokens(line: Column) -> Column:
    """White-space separated tokens of a line."""
    return F.filter(F.split(line, r"\s+"), lambda x: x != "")
