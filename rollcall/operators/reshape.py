"""Wide and long forms, column selection, stacking."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def cols_between(df: DataFrame, first: str, last: str) -> list[str]:
    """Names from ``first`` to ``last`` in column order, both included."""
    names = df.columns
    return names[names.index(first): names.index(last) + 1]


def cols_matching(df: DataFrame, prefix: str | None = None, contains: str | None = None,
                  any_of: Sequence[str] | None = None) -> list[str]:
    """Names that satisfy every given condition; absent ``any_of`` names are ignored."""
    return [
        c for c in df.columns
        if (prefix is None or c.startswith(prefix))
        and (contains is None or contains in c)
        and (any_of is None or c in any_of)
    ]


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    """One row per (ids, column); null values are kept."""
    return df.unpivot([F.col(c) for c in ids], [F.col(f"`{c}`") for c in cols], name, value)


def levels_of(df: DataFrame, name: str, most: int = 10_000) -> list:
    """All values of a column but null, in order: the columns of a wide form. More than ``most`` raise."""
    found = [r[0] for r in df.select(name).filter(F.col(name).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{name} has more than {most} values")
    return sorted(found)


def listed(col: Column, levels: Sequence, name: str) -> Column:
    """``col``; a value that is neither listed nor null raises where it is met."""
    other = F.raise_error(F.concat(F.lit(f"{name} has a value that is not listed: "), col.cast("string")))
    return F.when(col.isNull() | col.isin(list(levels)), col).otherwise(other)


def to_wide(df: DataFrame, keys: Sequence[str], name: str, value: str, levels: Sequence | None = None,
            agg=F.first) -> DataFrame:
    """One column per level: of all that the column holds, or of the listed ones,
    which spares a pass to find them; a level that is not listed raises."""
    if levels is None:
        levels = levels_of(df, name)
    else:
        df = df.withColumn(name, listed(F.col(name), levels, name).cast(df.schema[name].dataType))
    if not levels:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).pivot(name, list(levels)).agg(agg(value))


def to_wide_many(df: DataFrame, keys: Sequence[str], name: str, levels: Sequence | None,
                 aggs: Mapping[str, Column]) -> DataFrame:
    """Several statistics per level, named ``<stat>_<level>``; levels as for ``to_wide``."""
    if levels is None:
        levels = levels_of(df, name)
    else:
        df = df.withColumn(name, listed(F.col(name), levels, name).cast(df.schema[name].dataType))
    if not levels:
        return df.select(*keys).distinct()
    named = [expr.alias(stat) for stat, expr in aggs.items()]
    wide = df.groupBy(*keys).pivot(name, list(levels)).agg(*named)
    renames = {f"{lv}_{stat}": f"{stat}_{lv}" for lv in levels for stat in aggs}
    if len(aggs) == 1:
        only = next(iter(aggs))
        renames = {str(lv): f"{only}_{lv}" for lv in levels}
    return wide.withColumnsRenamed(renames)


def require_unique(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Collapse to one row per key; fail the job where a key has two values."""
    lo, hi = F.min(value), F.max(value)
    checked = F.when(lo.eqNullSafe(hi), lo).otherwise(
        F.raise_error(F.lit(f"{value} is not constant within {', '.join(keys)}")).cast(df.schema[value].dataType)
    )
    return df.groupBy(*keys).agg(checked.alias(value))


def round_numeric(df: DataFrame, digits: int = 0) -> DataFrame:
    """Half-even rounding of every floating column."""
    floating = (T.DoubleType, T.FloatType, T.DecimalType)
    return df.select(*[
        F.bround(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, floating) else F.col(f.name)
        for f in df.schema.fields
    ])


def sum_across(cols: Sequence[str]) -> Column:
    """Row-wise sum in which null counts as 0."""
    out = F.lit(0)
    for c in cols:
        out = out + F.coalesce(F.col(c), F.lit(0))
    return out


def dummies(col: Column, values: Sequence, prefix: str) -> dict[str, Column]:
    """0/1 columns for the listed values; null stays null."""
    return {f"{prefix}{v}": F.when(col == v, 1).when(col != v, 0) for v in values}


def edges_to_matrix(edges: DataFrame, a: str, b: str, w: str, levels: Sequence | None = None) -> DataFrame:
    """Display form of an edge table: a row and a column per node; levels as for ``to_wide``."""
    both = edges.select(F.col(a), F.col(b), F.col(w)).unionByName(
        edges.select(F.col(b).alias(a), F.col(a).alias(b), F.col(w)))
    return to_wide(both, [a], b, w, levels)
