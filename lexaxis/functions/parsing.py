"""Parsers of annotation values, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_parse(s: Column, default: int | None = None) -> Column:
    """A decimal integer; what is none gives `default`, or an error without one. Null counts as invalid."""
    valid = F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint"))
    return F.coalesce(valid, F.lit(default)) if default is not None else F.coalesce(valid, F.raise_error(F.concat(F.lit("not an integer: "), F.coalesce(s, F.lit("null")))).cast("bigint"))


def set_parse(s: Column) -> Column:
    """The sorted distinct members of a |-separated string, without empty ones; null gives an empty set."""
    parts = F.filter(F.split(F.trim(F.coalesce(s, F.lit(""))), r"\|"), lambda x: x != "")
    return F.array_sort(F.array_distinct(parts))


def pointer_parse(cpos: Column, head: Column, base: int = 1, start: Column | None = None) -> Column:
    """The absolute position of a head given relative to its token's unit: 0 is the token itself, unparsable is null.

    `start` is where counting begins (default: the token); h counts from `base` there.
    """
    h = F.when(head.rlike(r"^[+-]?[0-9]+$"), head.try_cast("bigint"))
    return F.when(h == 0, cpos).when(h.isNotNull(), (cpos if start is None else start) + h - base)


def _integer(s: Column) -> Column:
    return F.when(s.rlike(r"^[+-]?[0-9]+$"), s.try_cast("bigint"))


def pointer_from(cpos: Column, head: Column, base: Column) -> Column:
    """The position that a head leads to, where the token itself has the number `base` in its unit: 0 is the token, no number nowhere."""
    h, b = _integer(head), _integer(base)
    return F.when((h == 0) & b.isNotNull(), cpos).when(h.isNotNull() & b.isNotNull(), cpos + (h - b))
