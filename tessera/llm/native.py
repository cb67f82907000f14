"""Column builders shared by the operators that stay in DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
_SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, whatever the optimizer inlines."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def space_words(text: Column) -> Column:
    """Array of the words of a text, separated by white space as above."""
    return F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")


def count_words(text: Column) -> Column:
    """Number of such words, without building more than the split."""
    edge = lambda c: F.when(F.instr(F.lit(_SPACES), c) > 0, 1).otherwise(0)
    return F.when(text == "", 0).otherwise(F.size(F.split(text, SPACE_CLASS)) - edge(F.substring(text, 1, 1)) - edge(F.substring(text, -1, 1))).cast("long")


def uniform(*parts: Column) -> Column:
    """A double in [0, 1) that depends on the parts alone."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(2**53))
