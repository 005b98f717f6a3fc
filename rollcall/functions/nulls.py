"""Three-valued null rules shared by every operator."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def if_na(cond: Column, yes, no) -> Column:
    """``yes`` / ``no`` by ``cond``; null where ``cond`` is null."""
    return F.when(cond, yes).when(~cond, no)


def strict(agg: Callable[[Column], Column], col: Column) -> Column:
    """Aggregate that is null as soon as one input of the group is null."""
    return F.when(F.count(F.lit(1)) == F.count(col), agg(col))


def total(col: Column) -> Column:
    """Sum that skips nulls and gives 0 for a group of nulls only."""
    return F.coalesce(F.sum(col), F.lit(0))


def is_in(col: Column, values: Sequence) -> Column:
    """Membership that is never null: a null value is in no list."""
    return F.coalesce(col.isin(list(values)), F.lit(False))


def not_in(col: Column, values: Sequence) -> Column:
    return ~is_in(col, values)


def n_distinct(col: Column) -> Column:
    """Distinct count in which null counts as one more value."""
    return F.count_distinct(col) + F.max(F.when(col.isNull(), 1).otherwise(0))


def ratio(num: Column, den: Column) -> Column:
    """Quotient that is null, not an error, on a zero denominator."""
    return F.try_divide(num.cast("double"), den.cast("double"))
