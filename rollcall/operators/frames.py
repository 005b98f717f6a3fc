"""Model frames: standardisation, orthogonal polynomials, grids, state frames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rollcall.operators.calendar import complete_calendar, grid
from rollcall.operators.reshape import dummies


def frame_stats(df: DataFrame, cols: Sequence[str]) -> Column:
    """Mean and sd of every column of the current frame, as one scalar
    subquery: struct(col -> struct(m, s)). One pass for all columns."""
    return df.select(F.struct(*[
        F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in cols])).scalar()


def standardize(df: DataFrame, cols: Sequence[str], suffix: str = "_std") -> tuple[DataFrame, Column]:
    """(x - mean) / sd over the frame as it is now, and the statistics.

    The statistics belong to this frame: standardise again after a filter.
    """
    stats = frame_stats(df, cols)
    return df.withColumns({
        f"{c}{suffix}": F.try_divide(F.col(c) - stats.getField(c).getField("m"), stats.getField(c).getField("s"))
        for c in cols}), stats


def unstandardize(z: Column, stats: Column, col: str) -> Column:
    """Back to the raw axis with the statistics of the same frame."""
    return z * stats.getField(col).getField("s") + stats.getField(col).getField("m")


def poly_columns(df: DataFrame, col: str, degree: int, prefix: str) -> DataFrame:
    """Orthonormal polynomial columns ``prefix1..degree`` over the frame.

    One aggregate of scaled central moments gives the recurrence; runs one job.
    """
    one = df.select(F.struct(F.avg(col).alias("m"), F.stddev_pop(col).alias("s"))).scalar()
    z = (F.col(col) - one.getField("m")) / one.getField("s")
    row = df.filter(F.col(col).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.avg(col).alias("m"), F.stddev_pop(col).alias("s"),
        *[F.avg(F.pow(z, F.lit(float(k)))).alias(f"p{k}") for k in range(1, 2 * degree + 1)]).first()
    moments = [1.0] + [row[f"p{k}"] for k in range(1, 2 * degree + 1)]

    def inner(u: np.ndarray, v: np.ndarray) -> float:
        return sum(a * b * moments[i + j] for i, a in enumerate(u) for j, b in enumerate(v))

    basis = [np.array([1.0])]
    for k in range(1, degree + 1):
        nxt = np.zeros(k + 1)
        nxt[k] = 1.0
        for b in basis:
            nxt[: len(b)] -= inner(nxt, b) / inner(b, b) * b
        basis.append(nxt)
    zc = (F.col(col) - float(row["m"])) / float(row["s"])
    out = {}
    for k in range(1, degree + 1):
        scale = np.sqrt(inner(basis[k], basis[k]) * row["n"])
        expr = F.lit(0.0)
        for c in reversed(basis[k]):
            expr = expr * zc + float(c / scale)
        out[f"{prefix}{k}"] = expr
    return df.withColumns(out)


def prediction_grid(start: DataFrame, axes: Mapping[str, Column], stats: Column, standardized: Sequence[str] = (),
                    at_mean: Sequence[str] = ()) -> DataFrame:
    """Product of axes, other covariates at their mean, standardised with the
    statistics of the fitted frame."""
    out = grid(start, axes)
    out = out.withColumns({c: stats.getField(c).getField("m") for c in at_mean}) if at_mean else out
    return out.withColumns({
        f"{c}_std": F.try_divide(F.col(c) - stats.getField(c).getField("m"), stats.getField(c).getField("s"))
        for c in standardized})


def state_frame(df: DataFrame, day: str, obs: str, covariates: Sequence[str], label: str, levels: Sequence[str],
                by: Sequence[str] = ()) -> DataFrame:
    """Completed daily frame for a state-space model.

    ``t_index`` numbers the days, ``obs_index`` the observed ones (null when
    missing); the label becomes 0/1 columns that stay null on missing days.
    One row per day and series.
    """
    full = complete_calendar(df.select(*by, day, obs, *covariates, label), day, by)
    keys = list(by) or ["_series"]
    full = full if by else full.withColumn("_series", F.lit(1))
    w = W.partitionBy(*keys).orderBy(day).rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = F.col(obs).isNotNull()
    out = full.withColumns({
        "t_index": F.count(F.lit(1)).over(w),
        "obs_index": F.when(seen, F.count(obs).over(w)),
        **dummies(F.col(label), levels, f"{label}_"),
    })
    return out.drop("_series", label)
