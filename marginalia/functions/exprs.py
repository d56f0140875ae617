"""Small building blocks for column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as Python's str.isspace sees it, for patterns compiled with (?U).
SPACE = r"[\s\x1c-\x1f]"
NOT_SPACE = r"[^\s\x1c-\x1f]"


def as_col(value: Column | str) -> Column:
    """A column as is, anything else as a literal."""
    return value if isinstance(value, Column) else F.lit(value)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times within one expression."""
    return F.transform(F.array(value), body)[0]


def strip(text: Column) -> Column:
    """Trim whitespace at both ends; the lookbehind keeps the scan linear."""
    head = F.regexp_replace(text, rf"(?U)\A{SPACE}+", "")
    return F.regexp_replace(head, rf"(?U)(?<!{SPACE}){SPACE}++\z", "")


def collapse_spaces(text: Column) -> Column:
    """Each run of whitespace to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, rf"(?U){SPACE}+", " "))


def count_newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
