"""Calendar completion, previous-day lookups, level grids."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def day_span(df: DataFrame, day: str = "day") -> Column:
    """First and last day of a table as a one-row scalar subquery (struct lo, hi)."""
    return df.select(F.struct(F.min(day).alias("lo"), F.max(day).alias("hi"))).scalar()


def calendar(df: DataFrame, day: str = "day") -> DataFrame:
    """Every day from the first to the last of ``df``: one aggregate row, exploded."""
    one = df.agg(F.min(day).alias("_lo"), F.max(day).alias("_hi"))
    return one.select(F.explode(F.sequence("_lo", "_hi")).alias(day))


def join_days(df: DataFrame, days: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table that has a fixed few rows per calendar day.

    Such a table cannot outgrow the calendar (a century is 36 525 days), so
    it is broadcast: the large side keeps its partitioning and a busy day is
    not gathered. Never use it for tables that grow with the entities.
    """
    return df.join(F.broadcast(days), list(on), how)


def complete_calendar(df: DataFrame, day: str, by: Sequence[str] = (), span: Column | None = None) -> DataFrame:
    """Add the missing days, with nulls in the value columns.

    With ``by``, each series runs from its own first to its own last day, or
    over ``span`` (struct lo, hi) when given. Rows are filled forward from the
    next row of their series, so no calendar has to be joined: one shuffle on
    the series key. ``df`` holds one row per series and day, which bounds a
    series by the length of the calendar.
    """
    if not by:
        return calendar(df, day).join(df, [day], "left")
    w = W.partitionBy(*by).orderBy(day)
    here = F.col(day)
    nxt = F.lead(day).over(w)
    if span is None:
        until, start = F.coalesce(F.date_sub(nxt, 1), here), here
    else:
        until = F.coalesce(F.date_sub(nxt, 1), span.getField("hi"))
        start = F.when(F.row_number().over(w) == 1, span.getField("lo")).otherwise(here)
    values = [c for c in df.columns if c not in (*by, day)]
    filled = df.withColumn("_from", start).withColumn("_to", until)
    filled = filled.withColumn("_day", F.explode(F.sequence("_from", F.greatest("_to", day))))
    own = F.col("_day") == F.col(day)
    return filled.select(
        *by, F.col("_day").alias(day), *[F.when(own, F.col(c)).alias(c) for c in values]
    )


def prev_day(df: DataFrame, keys: Sequence[str], day: str, cols: Sequence[str], suffix: str = "_pre") -> DataFrame:
    """Values of the calendar day before, null when that day has no row.

    A day range frame, not a row lag: a gap gives null. ``df`` holds one row
    per (keys, day). Without keys the table is a day table and is joined to
    itself instead of being sorted in one task.
    """
    if not keys:
        return shift_join(df, df.select(day, *cols), [], day, cols, suffix)
    w = W.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(-1, -1)
    return df.withColumns({f"{c}{suffix}": F.max(c).over(w) for c in cols})


def shift_join(df: DataFrame, other: DataFrame, keys: Sequence[str], day: str, cols: Sequence[str],
               suffix: str = "_pre", days: int = 1) -> DataFrame:
    """Attach columns that another table holds for the day before."""
    shifted = other.select(*keys, F.date_add(day, days).alias(day),
                           *[F.col(c).alias(f"{c}{suffix}") for c in cols])
    return df.join(shifted, [*keys, day], "left")


def complete(df: DataFrame, nesting: Sequence[str], levels: Mapping[str, Sequence], fill: Mapping | None = None) -> DataFrame:
    """Every observed ``nesting`` tuple with every combination of listed levels.

    The levels are short literal lists, exploded per tuple; measured rows are
    attached by an equi-join. Rows with a level that is not listed stay.
    """
    frame = df.select(*nesting).distinct()
    for name, values in levels.items():
        frame = frame.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    out = frame.join(df, [*nesting, *levels], "full")
    return out.fillna(dict(fill)) if fill else out


def cross_days(entities: DataFrame, days: DataFrame, day: str = "day") -> DataFrame:
    """Every entity on every observed day.

    Each entity explodes the day range and keeps the days present in ``days``
    (a per-day table, so bounded by the calendar): linear in the result.
    """
    span = day_span(days, day)
    grid = entities.withColumn(day, F.explode(F.sequence(span.getField("lo"), span.getField("hi"))))
    return join_days(grid, days, [day])


def grid(start: DataFrame, axes: Mapping[str, Column]) -> DataFrame:
    """Product of axes given as array columns (literal lists or sequences)."""
    out = start
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(values))
    return out
