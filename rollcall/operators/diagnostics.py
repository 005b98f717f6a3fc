"""Residual diagnostics per series, with missing days passed over.

A series holds at most one row per day, so its length is bounded by the
calendar; every series is handled by the same grouped plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from rollcall.functions.tails import chi_square_upper, ratio_below_zero
from rollcall.operators.draws import uniform


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    if by:
        return df, list(by)
    return df.withColumn("_series", F.lit(1)), ["_series"]


def _centred(df: DataFrame, day: str, value: str, by: list[str]) -> DataFrame:
    w = W.partitionBy(*by)
    return df.filter(F.col(value).isNotNull()).select(
        *by, F.unix_date(day).alias("_t"), (F.col(value) - F.avg(value).over(w)).alias("_d"))


def acf_arrays(df: DataFrame, day: str, value: str, by: Sequence[str] = (), max_lag: int = 20) -> DataFrame:
    """One row per series with ``n`` and ``acf`` (lags 0..max_lag).

    Covariance at lag k is the sum over the pairs of days k apart divided by
    (pairs + k). Lagged values come from day range frames over one sort of
    the series, so a gap gives no pair.
    """
    df, keys = _keyed(df, by)
    base = _centred(df, day, value, keys)
    w = W.partitionBy(*keys).orderBy("_t")
    lagged = base.withColumns({f"_l{k}": F.max("_d").over(w.rangeBetween(-k, -k)) for k in range(1, max_lag + 1)})
    sums = [F.count(F.lit(1)).alias("n"), (F.sum(F.col("_d") * F.col("_d")) / F.count(F.lit(1))).alias("_c0")]
    for k in range(1, max_lag + 1):
        pair = F.col("_d") * F.col(f"_l{k}")
        sums.append((F.sum(pair) / (F.count(pair) + k)).alias(f"_c{k}"))
    arrays = lagged.groupBy(*keys).agg(*sums).select(
        *keys, "n", F.array(*[F.try_divide(F.col(f"_c{k}"), F.col("_c0")) for k in range(max_lag + 1)]).alias("acf"))
    return arrays.drop("_series")


def acf(df: DataFrame, day: str, value: str, by: Sequence[str] = (), max_lag: int = 20) -> DataFrame:
    """Autocorrelation by lag; null where no pair of days is that far apart."""
    return acf_arrays(df, day, value, by, max_lag).select(*by, "n", F.posexplode("acf").alias("lag", "acf"))


def pacf(df: DataFrame, day: str, value: str, by: Sequence[str] = (), max_lag: int = 20) -> DataFrame:
    """Partial autocorrelation, by the Durbin-Levinson recursion.

    The recursion runs over a whole batch of series at once.
    """
    arrays = acf_arrays(df, day, value, by, max_lag).select(*by, "acf")
    schema = arrays.drop("acf").schema.add("pacf", T.ArrayType(T.DoubleType()))

    def recurse(batches):
        for pdf in batches:
            r = np.array([np.asarray(a, dtype=float) for a in pdf["acf"]]).reshape(len(pdf), max_lag + 1)
            out = np.full((len(pdf), max_lag), np.nan)
            phi = np.zeros((len(pdf), max_lag + 1))
            with np.errstate(invalid="ignore", divide="ignore"):
                for k in range(1, max_lag + 1):
                    back = phi[:, 1:k]
                    num = r[:, k] - (back * r[:, k - 1:0:-1]).sum(axis=1) if k > 1 else r[:, 1]
                    den = 1 - (back * r[:, 1:k]).sum(axis=1) if k > 1 else np.ones(len(pdf))
                    now = num / den
                    if k > 1:
                        phi[:, 1:k] = back - now[:, None] * back[:, ::-1]
                    phi[:, k] = now
                    out[:, k - 1] = now
            values = [[None if not np.isfinite(v) else float(v) for v in row] for row in out]
            yield pd.DataFrame({**{c: pdf[c] for c in by}, "pacf": values})

    flat = arrays.mapInPandas(recurse, schema)
    return flat.select(*by, F.posexplode("pacf").alias("_i", "pacf")).select(*by, (F.col("_i") + 1).alias("lag"), "pacf")


def ljung_box(df: DataFrame, day: str, value: str, by: Sequence[str] = (), lag: int = 5) -> DataFrame:
    """Ljung-Box statistic over the first ``lag`` lags and its p-value."""
    arrays = acf_arrays(df, day, value, by, lag)
    n = F.col("n").cast("double")
    terms = F.lit(0.0)
    for k in range(1, lag + 1):
        terms = terms + F.coalesce(F.try_divide(F.col("acf")[k] * F.col("acf")[k], n - k), F.lit(0.0))
    stat = n * (n + 2.0) * terms
    return arrays.select(*by, "n", stat.alias("q")).withColumn("p_value", chi_square_upper(F.col("q"), lag))


def durbin_watson(df: DataFrame, day: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Squared steps over squared size of the mean-centred series."""
    df, keys = _keyed(df, by)
    base = _centred(df, day, value, keys)
    step = F.col("_d") - F.lag("_d").over(W.partitionBy(*keys).orderBy("_t"))
    out = base.withColumn("_s", step).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.sum(F.col("_s") * F.col("_s")), F.sum(F.col("_d") * F.col("_d"))).alias("dw"))
    return out.drop("_series")


def durbin_watson_test(df: DataFrame, day: str, value: str, by: Sequence[str] = ()) -> DataFrame:
    """The statistic with its exact p-values for independent normal values.

    The statistic is a ratio of quadratic forms whose eigenvalues depend on the
    length of the series alone. ``p_positive`` is the chance of a smaller one,
    ``p_value`` counts both sides; both are null for fewer than three values.
    """
    out = durbin_watson(df, day, value, by)
    n = F.col("n")
    weights = F.transform(F.sequence(F.lit(1).cast("bigint"), n - 1), lambda j: 2 - 2 * F.cos(math.pi * j / n) - F.col("dw"))
    out = out.withColumn("p_positive", F.when((n > 2) & F.col("dw").isNotNull(), ratio_below_zero(weights)))
    both = F.least(2 * F.least(F.col("p_positive"), 1 - F.col("p_positive")), F.lit(1.0))
    return out.withColumn("p_value", F.when(F.col("p_positive").isNotNull(), both))


def regrouped(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Residuals summed per key (a day, an entity), before a test of the sums."""
    return df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.sum(value).alias(value))


def scaled_residuals(sim: DataFrame, observed: DataFrame, keys: Sequence[str], y: str, seed: int) -> DataFrame:
    """Share of simulated values below the observed one; ties are spread by a
    seeded uniform number per row key."""
    keys = list(keys)
    joined = sim.select(*keys, F.col("y").alias("_sim")).join(observed.select(*keys, F.col(y).alias("_obs")), keys)
    u = uniform(seed, *keys)
    shares = joined.groupBy(*keys).agg(
        F.avg(F.when(F.col("_sim") < F.col("_obs"), 1.0).otherwise(0.0)).alias("below"),
        F.avg(F.when(F.col("_sim") == F.col("_obs"), 1.0).otherwise(0.0)).alias("tied"))
    return shares.withColumn("scaled", F.col("below") + u * F.col("tied"))


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Variance inflation: all correlations in one aggregate, the small
    correlation matrix is inverted on the driver. Runs one job."""
    cols = list(cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    row = df.dropna(subset=cols).agg(*[F.corr(cols[i], cols[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    r = np.eye(len(cols))
    for i, j in pairs:
        r[i, j] = r[j, i] = row[f"c{i}_{j}"]
    inflation = np.diag(np.linalg.inv(r))
    return df.sparkSession.createDataFrame(
        [(c, float(v)) for c, v in zip(cols, inflation)], "variable string, vif double")
