"""Likelihood fits by Newton steps: beta-binomial and negative-binomial counts,
proportional hazards.

A step is one aggregate over the rows: the log likelihood, its gradient and its
curvature are sums that Spark combines map-side, and only these few numbers
reach the driver. A fit that does not settle raises.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rollcall.functions.tails import rising
from rollcall.operators.regress import Design, Fit, make_design, model_terms, with_covariance
from rollcall.session import cut_lineage


#: What a parameter may change by in a step, and the logarithm of a shape may come to.
LONGEST, FARTHEST = 1.5, 14.0


def newton(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], start: np.ndarray, what: str,
           most: int = 100, tol: float = 1e-9, shape: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(maximum, gradient, curvature) of a function that ``evaluate`` gives with its derivatives.

    A step changes no parameter by more than ``LONGEST``; one that lowers the
    value is halved; a curvature that is not negative is made so first. Raises
    where nothing settles, or a parameter runs away.
    """
    at = start
    value, gradient, curvature = evaluate(at)
    for _ in range(most):
        roots = np.linalg.eigvalsh(curvature)
        ridge = 0.0 if roots[-1] < 0 else roots[-1] + 1e-3 * max(1.0, abs(roots).max())
        step = -np.linalg.solve(curvature - ridge * np.eye(len(at)), gradient)
        if shape and abs(at[-1]) > FARTHEST:
            raise RuntimeError(f"{what}: the shape runs away, to {np.exp(at[-1]):.3g}")
        if not ridge and float(gradient @ step) < tol ** 2 * max(1.0, abs(value)):
            return at, gradient, curvature
        step = step / max(1.0, np.abs(step).max() / LONGEST)
        for halving in range(40):
            now = evaluate(at + step)
            if np.isfinite(now[0]) and now[0] >= value - 1e-12 * abs(value):
                break
            step = step / 2
        else:
            # no step rises any more: rounding of the sums is all that is left, or the fit has failed
            if not ridge and float(gradient @ np.linalg.solve(-curvature, gradient)) < 1e-10:
                return at, gradient, curvature
            raise RuntimeError(f"{what}: no step raises the likelihood")
        at, (value, gradient, curvature) = at + step, now
    raise RuntimeError(f"{what}: not settled after {most} steps")


def _sums(rows: DataFrame, p: int, x: Callable[[int], Column], parts: dict[str, Column]) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, gradient and curvature by ``p`` coefficients and one shape, from the rows' derivatives.

    ``parts``: ll, s (by the linear predictor), t (by the shape), ss, st, tt.
    """
    rows = rows.withColumns({f"_{k}": c for k, c in parts.items()})
    aggs = [F.sum("_ll").alias("ll"), F.sum("_t").alias("t"), F.sum("_tt").alias("tt")]
    for i in range(p):
        aggs += [F.sum(F.col("_s") * x(i)).alias(f"g{i}"), F.sum(F.col("_st") * x(i)).alias(f"c{i}")]
        aggs += [F.sum(F.col("_ss") * x(i) * x(j)).alias(f"h{i}_{j}") for j in range(i, p)]
    got = rows.agg(*aggs).first()
    if any(v is None for v in got):
        raise ValueError("no rows to fit")
    h = np.zeros((p + 1, p + 1))
    for i in range(p):
        h[i, p] = h[p, i] = got[f"c{i}"]
        for j in range(i, p):
            h[i, j] = h[j, i] = got[f"h{i}_{j}"]
    h[p, p] = got["tt"]
    return float(got["ll"]), np.array([*(got[f"g{i}"] for i in range(p)), got["t"]]), h


def _prepared(df: DataFrame, formula: str, others: Sequence[str]) -> tuple[Design, list[str], DataFrame]:
    """Design, names and the rows that a fit passes over: design array ``_x``, ``_y`` and the other columns."""
    response, terms = model_terms(formula)
    df = cut_lineage(df.select(*dict.fromkeys([response, *(c for t in terms for c in t), *others])).dropna())
    design = make_design(df, formula)
    names, coded = zip(*design.coded())
    rows = df.withColumns({"_x": F.array(*coded, F.lit(1.0)), "_y": F.col(response).cast("double")})
    return design, [*names, "(Intercept)"], rows


def _at(rows: DataFrame, values: np.ndarray) -> DataFrame:
    """The rows with the parameters as the array ``_p``: a scalar subquery, so all steps run the same compiled code."""
    one = rows.sparkSession.createDataFrame([([float(v) for v in values],)], "_p array<double>")
    return rows.withColumn("_p", one.scalar())


def _eta(p: int) -> Column:
    return sum((F.col("_x")[i] * F.col("_p")[i] for i in range(p)), F.lit(0.0))


def fit_beta_binomial(df: DataFrame, formula: str, trials: str) -> tuple[Fit, float]:
    """Counts out of ``trials`` with a share that varies by a beta distribution: fit and precision.

    The share of a row has the mean inverse-logit(x b) and the precision phi, so
    phi grows without bound as the counts come down to binomial ones; then the
    fit raises. Equal rows are folded first. Errors come from the curvature of
    coefficients and precision together.
    """
    design, names, rows = _prepared(df, formula, [trials])
    rows = cut_lineage(rows.groupBy("_x", "_y", F.col(trials).cast("double").alias("_n")).agg(F.count(F.lit(1)).alias("_w")))
    p = len(names)
    total = rows.agg(F.sum(F.col("_w") * F.col("_y")) / F.sum(F.col("_w") * F.col("_n"))).first()[0]
    if total is None or not 0 < total < 1:
        raise ValueError(f"{formula}: counts are all of the trials, or none")

    def evaluate(at: np.ndarray):
        phi, w, y, n = F.col("_phi"), F.col("_w"), F.col("_y"), F.col("_n")
        mu = F.greatest(F.least(1 / (1 + F.exp(-_eta(p))), F.lit(1 - 1e-12)), F.lit(1e-12))
        ready = _at(rows, np.r_[at[:p], np.exp(at[p])]).withColumns({"_mu": mu, "_phi": F.col("_p")[p]})
        ready = ready.withColumns({"_a": F.col("_mu") * phi, "_b": (1 - F.col("_mu")) * phi})
        ready = ready.withColumns({"_ra": rising(F.col("_a"), y), "_rb": rising(F.col("_b"), n - y), "_rn": rising(phi, n)})
        a, b, slope = F.col("_a"), F.col("_b"), phi * F.col("_mu") * (1 - F.col("_mu"))
        s = lambda k, of: F.col(f"_r{of}.s{k}")
        apart, shape = s(1, "a") - s(1, "b"), a * s(1, "a") + b * s(1, "b") - phi * s(1, "n")
        return _sums(ready, p, lambda i: F.col("_x")[i], {
            "ll": w * (s(0, "a") + s(0, "b") - s(0, "n")), "s": w * slope * apart, "t": w * shape,
            "ss": w * (-slope * slope * (s(2, "a") + s(2, "b")) + slope * (1 - 2 * F.col("_mu")) * apart),
            "st": w * slope * (apart - a * s(2, "a") + b * s(2, "b")),
            "tt": w * (shape - a * a * s(2, "a") - b * b * s(2, "b") + phi * phi * s(2, "n"))})

    start = np.zeros(p + 1)
    start[p - 1], start[p] = np.log(total / (1 - total)), np.log(10.0)
    at, _, curvature = newton(evaluate, start, f"beta-binomial fit of {formula}", shape=True)
    cov = np.linalg.inv(-curvature)[:p, :p]
    phi = float(np.exp(at[p]))
    return Fit(design, names, at[:p], cov, "betabinomial", "logit", 1 / (1 + phi)), phi


def fit_negbin_likelihood(df: DataFrame, formula: str, offset: str | None = None,
                          cluster: str | Sequence[str] | None = None) -> tuple[Fit, float]:
    """Negative-binomial counts (variance mu + alpha mu^2): fit and alpha, both of greatest likelihood.

    The covariance is that of the coefficients at the fitted alpha, by clusters
    if any are given. Counts that vary no more than Poisson ones have no such
    alpha; the fit raises then.
    """
    clusters = [cluster] if isinstance(cluster, str) else list(cluster or [])
    design, names, rows = _prepared(df, formula, [*([offset] if offset else []), *clusters])
    p, shift = len(names), F.col(offset) if offset else F.lit(0.0)
    rate = rows.agg(F.sum("_y") / F.sum(F.exp(shift))).first()[0]
    if not rate:
        raise ValueError(f"{formula}: no counts above zero")

    def evaluate(at: np.ndarray):
        k, y = F.col("_k"), F.col("_y")
        mu, r = F.col("_mu"), lambda i: F.col(f"_r.s{i}")
        ready = _at(rows, np.r_[at[:p], np.exp(at[p])]).withColumns({"_mu": F.exp(_eta(p) + shift), "_k": F.col("_p")[p]})
        ready = ready.withColumn("_r", rising(k, y))
        both = mu + k
        by_k = r(1) + F.log(k) + 1 - F.log(both) - (y + k) / both
        return _sums(ready, p, lambda i: F.col("_x")[i], {
            "ll": r(0) + k * F.log(k) - (y + k) * F.log(both) + y * F.log(mu), "s": k * (y - mu) / both, "t": k * by_k,
            "ss": -k * mu * (y + k) / (both * both), "st": k * (y - mu) * mu / (both * both),
            "tt": k * by_k + k * k * (-r(2) + 1 / k - 1 / both - (mu - y) / (both * both))})

    start = np.zeros(p + 1)
    start[p - 1] = np.log(rate)
    at, _, _ = newton(evaluate, start, f"negative-binomial fit of {formula}", shape=True)
    alpha = float(np.exp(-at[p]))
    fit = Fit(design, names, at[:p], np.zeros((p, p)), "negbin", "log", 1.0, offset)
    return with_covariance(fit, rows.drop("_x", "_y"), cluster=clusters or None, alpha=alpha), alpha


def fit_cox(df: DataFrame, dur: str, event: str, covariates: Sequence[str], slices: int = 256) -> Fit:
    """Proportional hazards without a baseline: partial likelihood, ties by Efron's rule.

    ``event`` is 1 where the duration ended in one and 0 where it was cut off;
    rows with an unknown value are dropped. Each step folds the rows to one per
    distinct time. The sums over all who are still at risk are running sums from
    the last time on, made slice by slice of the time range with the totals of
    the later slices carried over, so no task orders all times. The terms of a
    time with many ties have a closed form, so no row stands for one of them.
    """
    p, xs = len(covariates), [f"_x{i}" for i in range(len(covariates))]
    rows = df.select(F.col(dur).cast("double").alias("_t"), F.col(event).cast("int").alias("_d"),
                     *[F.col(c).cast("double").alias(x) for c, x in zip(covariates, xs)]).dropna()
    rows = cut_lineage(rows)
    low, high, events = rows.agg(F.min("_t"), F.max("_t"), F.sum("_d")).first()
    if not events:
        raise ValueError("no events to fit")
    width = (high - low) / slices or 1.0
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    risk = {"s": F.lit(1.0), **{f"s{i}": F.col(xs[i]) for i in range(p)}, **{f"s{i}_{j}": F.col(xs[i]) * F.col(xs[j]) for i, j in upper}}
    hit = F.col("_d").cast("double")

    def evaluate(beta: np.ndarray):
        eta = sum((F.col(x) * F.col("_p")[i] for i, x in enumerate(xs)), F.lit(0.0))
        e = F.col("_e")
        folded = _at(rows, beta).withColumn("_eta", eta).withColumn("_e", F.exp("_eta")).groupBy("_t").agg(
            *[F.sum(e * c).alias(n) for n, c in risk.items()], *[F.sum(hit * e * c).alias(f"d{n}") for n, c in risk.items()],
            *[F.sum(hit * F.col(x)).alias(f"v{i}") for i, x in enumerate(xs)], F.sum(hit).alias("n"), F.sum(hit * F.col("_eta")).alias("eta"))
        cut = cut_lineage(folded.withColumn("_slice", F.floor((F.col("_t") - low) / width)))
        later = W.orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)  # one row per slice
        carried = cut.groupBy("_slice").agg(*[F.sum(n).alias(n) for n in risk]).select(
            "_slice", *[F.coalesce(F.sum(n).over(later), F.lit(0.0)).alias(f"c{n}") for n in risk])
        inside = W.partitionBy("_slice").orderBy(F.desc("_t")).rowsBetween(W.unboundedPreceding, W.currentRow)
        at_risk = cut.join(F.broadcast(carried), "_slice").withColumns({f"r{n}": F.sum(n).over(inside) + F.col(f"c{n}") for n in risk})
        at_risk = at_risk.filter("n > 0")
        # the l-th of n tied denominators is (ds / n) (c - l) with c = rs n / ds
        n, share = F.col("n"), F.col("ds") / F.col("n")
        at_risk = at_risk.withColumn("_k", rising(F.col("rs") / share - n + 1, n))
        one, two = F.col("_k.s1") / share, F.col("_k.s2") / (share * share)
        ratio = F.col("rs") / F.col("ds")
        u = [F.col(f"rs{i}") - ratio * F.col(f"ds{i}") for i in range(p)]
        v = [F.col(f"ds{i}") / F.col("ds") for i in range(p)]
        aggs = [F.sum(F.col("eta") - n * F.log(share) - F.col("_k.s0")).alias("ll")]
        aggs += [F.sum(F.col(f"v{i}") - n * v[i] - u[i] * one).alias(f"g{i}") for i in range(p)]
        for i, j in upper:
            square = (F.col(f"rs{i}_{j}") - ratio * F.col(f"ds{i}_{j}")) * one + n * F.col(f"ds{i}_{j}") / F.col("ds")
            aggs.append(F.sum(u[i] * u[j] * two + (u[i] * v[j] + u[j] * v[i]) * one + n * v[i] * v[j] - square).alias(f"h{i}_{j}"))
        got = at_risk.agg(*aggs).first()
        h = np.array([[got[f"h{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
        return float(got["ll"]), np.array([got[f"g{i}"] for i in range(p)]), h

    beta, _, curvature = newton(evaluate, np.zeros(p), f"proportional hazards of {dur}")
    return Fit(Design(dur, [(c,) for c in covariates], {}), list(covariates), beta, np.linalg.inv(-curvature), "cox", "log", 1.0)
