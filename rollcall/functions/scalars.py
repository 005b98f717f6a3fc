"""Column helpers for text, time and ordering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollcall.functions.nulls import if_na

MICROS_PER_MINUTE = 60_000_000


def minutes_between(start: Column, end: Column) -> Column:
    """Minutes from ``start`` to ``end``, always in minutes whatever the span."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(float(MICROS_PER_MINUTE))


def net_minutes(start: Column, end: Column, suspend: Column, restart: Column) -> Column:
    """Observation length without the pause; a null pause removes nothing."""
    whole = minutes_between(start, end)
    return if_na(suspend.isNull(), whole, whole - minutes_between(suspend, restart))


def season(code: Column, marker: str = "^nm") -> Column:
    """'nonmating' for period codes that carry the marker, else 'mating'."""
    return if_na(code.rlike(marker), F.lit("nonmating"), F.lit("mating"))


def period_code(day: Column, prefix: str = "m") -> Column:
    """Prefix plus the last two digits of the year."""
    return F.concat(F.lit(prefix), F.substring(F.year(day).cast("string"), 3, 2))


def replace_all(col: Column, rules: Mapping[str, str]) -> Column:
    """Regex replacements applied one after another, in the order given."""
    for pattern, replacement in rules.items():
        col = F.regexp_replace(col, pattern, replacement)
    return col


def level_index(col: Column, levels: Sequence[str]) -> Column:
    """Position of a value in a custom level list; unlisted values come last."""
    found = F.array_position(F.array(*[F.lit(v) for v in levels]), col)
    return F.when(found > 0, found).otherwise(len(levels) + 1)


def split_right(col: Column, n: int) -> tuple[Column, Column]:
    """Cut ``n`` characters off the right end: (head, tail)."""
    head = F.substring(col, F.lit(1), F.length(col) - n)
    tail = F.substring(col, F.length(col) - n + 1, F.lit(n))
    return head, tail


def interval_label(lo: Column, hi: Column, digits: int = 2) -> Column:
    return F.format_string(f"[%.{digits}f, %.{digits}f]", lo, hi)


def share_label(n: Column, of: Column) -> Column:
    """'0.83(10/12)'."""
    return F.format_string("%.2f(%d/%d)", n.cast("double") / of.cast("double"), n, of)


def inverse_logit(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def draw_index(name: Column) -> Column:
    """12 from 'p[12]'."""
    return F.regexp_extract(name, r"\[(\d+)\]", 1).cast("int")
