"""Canonical spellings of codes and numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_key(c: Column) -> Column:
    """Upper case, without anything but letters, digits and hyphens; blank is NULL."""
    return F.nullif(F.regexp_replace(F.upper(c), r"[^A-Z0-9-]", ""), F.lit(""))


def finite(c: Column) -> Column:
    """NaN and the infinities become NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def days(c: Column) -> Column:
    """A date as whole days since 1970-01-01."""
    return F.unix_date(c.cast("date"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
