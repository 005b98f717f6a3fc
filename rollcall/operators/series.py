"""Daily level filters and smoothers with gaps: Gaussian stand-ins for the sampled models.

A series is one row per day, so an array of it is bounded by the calendar; many
series run in parallel and a batch of them is filtered at once. Variances and
covariate effects are estimated by EM: a round is one pass over the series, of
which a few sums reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.operators.calendar import complete_calendar
from rollcall.session import cut_lineage

# Prior variance of the first state.
DIFFUSE = 1e6


def local_level(df: DataFrame, day: str, value: str, by: Sequence[str] = (), q: float = 0.1, r: float = 1.0) -> DataFrame:
    """Random-walk level: filtered mean and variance for every calendar day.
    A missing day predicts only."""
    return _filter(df, day, value, by, LEVEL, _noise(LEVEL, q), r)


def smooth_trend(df: DataFrame, day: str, value: str, by: Sequence[str] = (), q: float = 0.01, r: float = 1.0) -> DataFrame:
    """Level whose step changes slowly: mu_t = 2 mu_(t-1) - mu_(t-2) + noise."""
    return _filter(df, day, value, by, TREND, _noise(TREND, q), r)


LEVEL, TREND = np.array([[1.0]]), np.array([[2.0, -1.0], [1.0, 0.0]])


def smoothed_level(df: DataFrame, day: str, value: str, by: Sequence[str] = (), q: float = 0.1, r: float = 1.0,
                   trend: bool = False) -> DataFrame:
    """Level of every calendar day given the whole series, with its variance: a pass back over the filtered days."""
    step = TREND if trend else LEVEL
    return _filter(df, day, value, by, step, _noise(step, q), r, smooth=True)


def _noise(step: np.ndarray, q: float) -> np.ndarray:
    return np.diag([q, *[0.0] * (len(step) - 1)])


def _packed(df: DataFrame, day: str, value: str, by: Sequence[str], covariates: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """One row per series: arrays of its calendar days, its values (null: none) and its covariates."""
    keys = list(by) or ["_series"]
    full = complete_calendar(df.select(*by, day, F.col(value).cast("double").alias("_y"), *covariates), day, by)
    full = full if by else full.withColumn("_series", F.lit(1))
    entry = F.struct(F.col(day).alias("d"), F.col("_y").alias("y"), F.array(*[F.col(c).cast("double") for c in covariates]).alias("x"))
    packed = full.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("s"))
    return packed.select(*keys, F.col("s.d").alias("_days"), F.transform("s", lambda e: e["y"]).alias("_y"), F.transform("s", lambda e: e["x"]).alias("_xs")), keys


def _padded(rows) -> tuple[list[int], np.ndarray]:
    lengths = [len(y) for y in rows]
    y = np.full((len(rows), max(lengths, default=0)), np.nan)
    for i, values in enumerate(rows):
        y[i, : lengths[i]] = np.asarray(values, dtype=float)
    return lengths, y


def _filter(df: DataFrame, day: str, value: str, by: Sequence[str], step: np.ndarray, noise: np.ndarray, r: float,
            smooth: bool = False) -> DataFrame:
    packed, keys = _packed(df, day, value, by)
    packed = packed.drop("_xs")
    numbers = T.ArrayType(T.DoubleType())
    schema = packed.drop("_y").schema.add("_mean", numbers).add("_var", numbers)

    def run(batches):
        for pdf in batches:
            lengths, y = _padded(pdf["_y"])
            if smooth:
                mean, var = (x[..., 0].T if x.ndim == 3 else x[..., 0, 0].T for x in smoother(y, step, noise, r)[:2])
            else:
                mean, var = kalman(y, step, noise, r)
            yield pd.DataFrame({
                **{k: pdf[k] for k in keys}, "_days": pdf["_days"],
                "_mean": [mean[i, :n].tolist() for i, n in enumerate(lengths)],
                "_var": [var[i, :n].tolist() for i, n in enumerate(lengths)]})

    filtered = packed.mapInPandas(run, schema)
    rows = filtered.select(*keys, F.explode(F.arrays_zip("_days", "_mean", "_var")).alias("z"))
    out = rows.select(*keys, F.col("z._days").alias(day), F.col("z._mean").alias("level"), F.col("z._var").alias("level_var"))
    return out.drop("_series")


def smoother(y: np.ndarray, step: np.ndarray, noise: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(means, variances, covariances with the day before, log likelihood per series) of a batch of padded series.

    All but the last are by day, series and state. What is missing, or padded,
    is predicted and tells nothing.
    """
    n, length = y.shape
    k = len(step)
    m, p = np.zeros((n, k)), np.broadcast_to(np.eye(k) * DIFFUSE, (n, k, k)).copy()
    ahead, spread, mean, var, ll = [], [], [], [], np.zeros(n)
    for t in range(length):
        if t:
            m, p = m @ step.T, step @ p @ step.T + noise
        ahead.append(m)
        spread.append(p)
        seen = ~np.isnan(y[:, t])
        s = p[:, 0, 0] + r
        v = np.where(seen, np.nan_to_num(y[:, t]) - m[:, 0], 0.0)
        ll += np.where(seen, -0.5 * (np.log(2 * np.pi * s) + v * v / s), 0.0)
        gain = np.where(seen[:, None], p[:, :, 0] / s[:, None], 0.0)
        m, p = m + gain * v[:, None], p - gain[:, :, None] * p[:, :1, :]
        mean.append(m)
        var.append(p)
    ms, ps, cross = np.array(mean), np.array(var), np.zeros((length, n, k, k))
    for t in range(length - 2, -1, -1):
        back = np.swapaxes(np.linalg.solve(spread[t + 1], step @ var[t]), 1, 2)
        ms[t] = mean[t] + np.einsum("nij,nj->ni", back, ms[t + 1] - ahead[t + 1])
        ps[t] = var[t] + back @ (ps[t + 1] - spread[t + 1]) @ np.swapaxes(back, 1, 2)
        cross[t + 1] = ps[t + 1] @ np.swapaxes(back, 1, 2)
    return ms, ps, cross, ll


@dataclass
class Level:
    """Estimates of a level model: variances of its steps and of the values around it, effects of covariates."""

    q: float
    r: float
    beta: np.ndarray
    covariates: list[str]
    trend: bool
    history: list[float] = field(default_factory=list)


def fit_level(df: DataFrame, day: str, value: str, by: Sequence[str] = (), covariates: Sequence[str] = (), trend: bool = False,
              start: tuple[float, float] = (1.0, 1.0), tol: float = 1e-7, most: int = 1000) -> Level:
    """Variances and effects of greatest likelihood, common to all series, by EM.

    A value is the level, the effects of the day's covariates and noise; a day
    without a value, or without a covariate, tells nothing of them. Each round
    smooths all series and never lowers the likelihood (``history``); it ends
    when two rounds add less than ``tol`` per value, and raises after ``most``.
    EM nears its end slowly, so what is left to gain may be many times that.
    """
    packed = cut_lineage(_packed(df, day, value, by, covariates)[0].select("_y", "_xs"))
    step, p = TREND if trend else LEVEL, len(covariates)
    model = Level(start[0], start[1], np.zeros(p), list(covariates), trend)
    names = ["n", "steps", "r", "q", "ll", *[f"b{i}" for i in range(p)], *[f"a{i}_{j}" for i in range(p) for j in range(p)]]

    def sums(q: float, r: float, beta: np.ndarray):
        noise = _noise(step, q)

        def run(batches):
            for pdf in batches:
                lengths, y = _padded(pdf["_y"])
                x = np.zeros((*y.shape, p))
                for i, rows in enumerate(pdf["_xs"]):
                    if p:
                        x[i, : lengths[i]] = np.array([np.asarray(v, dtype=float) for v in rows])
                y = np.where(np.isnan(x).any(axis=2), np.nan, y)
                x = np.nan_to_num(x)
                ms, ps, cross, ll = smoother(y - x @ beta, step, noise, r)
                seen, level = ~np.isnan(y), ms[..., 0].T
                rest = np.where(seen, np.nan_to_num(y) - level, 0.0)
                both = ps + np.einsum("tni,tnj->tnij", ms, ms)
                lag = cross[1:] + np.einsum("tni,tnj->tnij", ms[1:], ms[:-1])
                moved = both[1:] - step @ np.swapaxes(lag, 2, 3) - lag @ step.T + step @ both[:-1] @ step.T
                real = np.arange(1, y.shape[1])[:, None] < np.array(lengths)[None, :]
                xs, used = x[seen], rest[seen]
                noise_r = ((used - xs @ beta) ** 2).sum() + ps[..., 0, 0].T[seen].sum()
                yield pd.DataFrame([[seen.sum(), real.sum(), noise_r, moved[..., 0, 0][real].sum(), ll.sum(), *(xs.T @ used), *(xs.T @ xs).ravel()]],
                                   columns=names).astype(float)

        got = packed.mapInPandas(run, ", ".join(f"{n} double" for n in names)).agg(*[F.sum(n).alias(n) for n in names]).first()
        return {n: got[n] for n in names}

    for _ in range(most):
        s = sums(model.q, model.r, model.beta)
        if not s["n"]:
            raise ValueError("no values to fit")
        model.history.append(s["ll"])
        if len(model.history) > 2 and model.history[-1] - model.history[-3] < tol * s["n"]:
            return model
        if p and len(model.history) % 2:  # effects and variances in turn: each raises the likelihood by itself
            model.beta = np.linalg.lstsq(np.array([[s[f"a{i}_{j}"] for j in range(p)] for i in range(p)]), np.array([s[f"b{i}"] for i in range(p)]), rcond=None)[0]
        else:
            model.q, model.r = s["q"] / max(s["steps"], 1), s["r"] / s["n"]
    raise RuntimeError(f"variances not settled after {most} rounds")


def kalman(y: np.ndarray, step: np.ndarray, noise: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Filtered first state and its variance for a batch of padded series."""
    n, length = y.shape
    k = len(step)
    m = np.zeros((n, k))
    p = np.broadcast_to(np.eye(k) * DIFFUSE, (n, k, k)).copy()
    means, variances = np.empty((n, length)), np.empty((n, length))
    for t in range(length):
        if t:
            m = m @ step.T
            p = step @ p @ step.T + noise
        seen = ~np.isnan(y[:, t])
        gain = np.where(seen[:, None], p[:, :, 0] / (p[:, 0, 0] + r)[:, None], 0.0)
        m = m + gain * np.where(seen, np.nan_to_num(y[:, t]) - m[:, 0], 0.0)[:, None]
        p = p - gain[:, :, None] * p[:, :1, :]
        means[:, t], variances[:, t] = m[:, 0], p[:, 0, 0]
    return means, variances
