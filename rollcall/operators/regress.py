"""Regressions on Spark ML: point estimates instead of posterior samples.

Coefficients come from distributed weighted least squares inside
``GeneralizedLinearRegression``, or, for binomial fits of very many rows, from
column sums (``binomial_scoring``). They do not reproduce the numbers of a
Bayesian fit with random effects; grouping factors enter through
cluster-robust standard errors. Fitting runs jobs.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions.scalars import interval_label, inverse_logit, level_index, replace_all
from rollcall.functions.tails import normal_cdf
from rollcall.session import cut_lineage, shared_table

# Fixed value: the 97.5 % quantile of the normal distribution.
Z95 = 1.959963984540054


@dataclass
class Design:
    """Model terms with treatment coding: the first level is the reference.

    ``terms`` are tuples of column names, more than one for an interaction.
    ``levels`` lists the non-reference levels of the text columns. Interactions
    multiply the coded columns, so they are never collinear with their parts.
    """

    response: str
    terms: list[tuple[str, ...]]
    levels: dict[str, list[str]]

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for t in self.terms for c in t))

    def coded(self) -> list[tuple[str, Column]]:
        out: list[tuple[str, Column]] = []
        for term in self.terms:
            parts: list[tuple[str, Column]] = [("", F.lit(1.0))]
            for c in term:
                if c in self.levels:
                    own = [(f"{c}_{v}", F.when(F.col(c) == v, 1.0).otherwise(0.0)) for v in self.levels[c]]
                else:
                    own = [(c, F.col(c).cast("double"))]
                parts = [(f"{n}:{m}" if n else m, x * z) for n, x in parts for m, z in own]
            out += parts
        return out


def model_terms(formula: str) -> tuple[str, list[tuple[str, ...]]]:
    """Response and terms of 'y ~ a + b + a:b'."""
    response, right = (part.strip() for part in formula.split("~"))
    return response, [tuple(c.strip() for c in t.split(":")) for t in right.split("+")]


def fold_patterns(df: DataFrame, response: str, covariates: Sequence[str], weight: str = "n") -> DataFrame:
    """Mean response and count per covariate pattern.

    A binomial likelihood only needs these cells, so an iterative fit passes
    over the patterns instead of the rows; the fold is one map-side combined
    aggregate.
    """
    return df.groupBy(*covariates).agg(F.avg(response).alias(response), F.count(F.lit(1)).cast("double").alias(weight))


def make_design(df: DataFrame, formula: str, max_levels: int = 1000) -> Design:
    """Terms of the formula; the levels of text columns are read from the frame.

    The design is dense and solved on the driver, so ``max_levels`` is a limit
    of the method: a text covariate with more levels raises. A factor of that
    size belongs into ``cluster``, or into a numeric column.
    """
    response, terms = model_terms(formula)
    text = {c for t in terms for c in t if isinstance(df.schema[c].dataType, T.StringType)}
    levels = {}
    for c in sorted(text):
        found = [r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().limit(max_levels + 1).collect()]
        if len(found) > max_levels:
            raise ValueError(f"{c} has more than {max_levels} levels")
        levels[c] = sorted(found)[1:]
    return Design(response, terms, levels)


@dataclass
class Fit:
    """A fitted model: design, names (intercept last), coefficients, covariance."""

    design: Design
    names: list[str]
    beta: np.ndarray
    cov: np.ndarray
    family: str
    link: str
    dispersion: float
    offset: str | None = None

    def with_design(self, df: DataFrame) -> DataFrame:
        """Adds the array column ``_x`` (intercept last)."""
        return df.withColumn("_x", F.array(*[x for _, x in self.design.coded()], F.lit(1.0)))

    def linear(self, x: Column) -> Column:
        out = F.lit(0.0)
        for i, b in enumerate(self.beta):
            out = out + x[i] * float(b)
        return out

    def se(self, x: Column) -> Column:
        out = F.lit(0.0)
        p = len(self.beta)
        for i in range(p):
            for j in range(p):
                out = out + x[i] * x[j] * float(self.cov[i, j])
        return F.sqrt(F.greatest(out, F.lit(0.0)))

    def mean(self, eta: Column) -> Column:
        if self.link == "logit":
            return inverse_logit(eta)
        if self.link == "cloglog":
            return F.lit(1.0) - F.exp(-F.exp(eta))
        if self.link == "log":
            return F.exp(eta)
        return eta


def _variance(family: str, mu: Column, alpha: float) -> Column:
    return {"binomial": mu * (1.0 - mu), "poisson": mu, "gamma": mu * mu,
            "negbin": mu + mu * mu * float(alpha)}.get(family, F.lit(1.0))


def _mean_slope(link: str, eta: Column, mu: Column) -> Column:
    """Derivative of the mean by the linear predictor."""
    if link == "logit":
        return mu * (1.0 - mu)
    if link == "cloglog":
        return (F.lit(1.0) - mu) * F.exp(eta)
    if link == "log":
        return mu
    return F.lit(1.0)


def fit_glm(df: DataFrame, formula: str, family: str, link: str, offset: str | None = None,
            weight: str | None = None, cluster: str | Sequence[str] | None = None, alpha: float = 0.0,
            covariance: bool = True, keep: bool = True, overdispersed: bool = False, steps: int = 100,
            many: bool = False) -> Fit:
    """Fit and return coefficients with their covariance.

    The covariance is the inverse information, or the cluster-robust sandwich
    when ``cluster`` is given: one column, or two that cross (see
    ``clustered_meat``). A fit that has not settled after ``steps`` raises. Families with a scale of their own (gamma, gaussian) are scaled
    by the Pearson dispersion. Binomial fits are not, so rows folded to counts
    per pattern give the errors of the rows themselves; ``overdispersed`` asks
    for the scaling, for true counts out of trials. The frame
    is written once to the checkpoint folder (``keep``), only with the columns
    of the model: the solver passes over it many times and must not recompute
    what produced it. ``many`` is for binomial rows by the hundred million:
    the same steps as column sums over Parquet (``binomial_scoring``).
    """
    if many and family != "binomial":
        raise ValueError("many rows are for binomial fits")
    clusters = cluster_columns(cluster)
    df = _kept(df, formula, offset, weight, *clusters, write=shared_table if many else cut_lineage) if keep else df
    design = make_design(df, formula)
    names, coded = zip(*design.coded())
    df = df.dropna(subset=[design.response, *design.columns, *[c for c in (offset, weight, *clusters) if c]])
    if many:
        beta = binomial_scoring(df, design, link, offset, weight, steps, formula)
        fit = Fit(design, [*names, "(Intercept)"], beta, np.zeros((len(beta), len(beta))), family, link, 1.0, offset)
        return with_covariance(fit, df, weight, clusters, alpha, overdispersed) if covariance else fit
    ready = df.withColumns({"_features": array_to_vector(F.array(*coded)), "_label": F.col(design.response).cast("double")})
    glm_family = "poisson" if family == "negbin" else family
    params = dict(featuresCol="_features", labelCol="_label", family=glm_family, link=link, maxIter=steps, tol=1e-8)
    if offset:
        params["offsetCol"] = offset
    if family == "negbin":
        params["weightCol"] = "_nbw"
    elif weight:
        params["weightCol"] = weight
    model = GeneralizedLinearRegression(**params).fit(ready)
    if model.summary.numIterations >= steps:
        raise RuntimeError(f"{formula}: not settled after {steps} steps")
    beta = np.append(np.asarray(model.coefficients.toArray()), model.intercept)
    fit = Fit(design, [*names, "(Intercept)"], beta, np.zeros((len(beta), len(beta))), family, link, 1.0, offset)

    return with_covariance(fit, df, weight, clusters, alpha, overdispersed) if covariance else fit


def binomial_scoring(df: DataFrame, design: Design, link: str, offset: str | None, weight: str | None,
                     steps: int, formula: str, tol: float = 1e-8) -> np.ndarray:
    """Coefficients (intercept last) of a binomial fit by Fisher scoring.

    The steps of Spark ML's solver, start and end included, but each is one
    aggregate of plain columns, which Spark compiles, where the solver makes
    an object of every row. The parameters are a scalar subquery.
    """
    xs = [x for _, x in design.coded()]
    p = len(xs) + 1
    rows = df.select(*[x.alias(f"_x{i}") for i, x in enumerate(xs)], F.lit(1.0).alias(f"_x{p - 1}"),
                     F.col(design.response).cast("double").alias("_y"),
                     (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_n"),
                     (F.col(offset).cast("double") if offset else F.lit(0.0)).alias("_o"))
    rows = rows.filter(F.col("_n") > 0)
    y, n = F.col("_y"), F.col("_n")
    begin = (n * y + 0.5) / (n + 1.0)
    begin = F.log(-F.log1p(-begin)) if link == "cloglog" else F.log(begin / (1.0 - begin))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]

    def step(eta: Column, source: DataFrame) -> np.ndarray:
        source = source.withColumn("_eta", eta)
        source = source.withColumn("_mu", inverse_logit(F.col("_eta")) if link == "logit" else -F.expm1(-F.exp("_eta")))
        slope = _mean_slope(link, F.col("_eta"), F.col("_mu"))
        source = source.withColumn("_s", slope).withColumn("_v", _variance("binomial", F.col("_mu"), 0.0))
        source = source.withColumn("_w", n * F.col("_s") * F.col("_s") / F.col("_v"))
        # the working response times its weight
        source = source.withColumn("_z", F.col("_w") * (F.col("_eta") - F.col("_o")) + n * (y - F.col("_mu")) * F.col("_s") / F.col("_v"))
        row = source.agg(*[F.sum(F.col("_w") * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"a{i}_{j}") for i, j in pairs],
                         *[F.sum(F.col("_z") * F.col(f"_x{i}")).alias(f"b{i}") for i in range(p)]).first()
        if any(v is None for v in row):
            raise ValueError(f"{formula}: no rows to fit")
        a, b = _symmetric(row, "a", p), np.array([row[f"b{i}"] for i in range(p)])
        scale = 1.0 / np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
        return scale * (np.linalg.pinv(a * np.outer(scale, scale), hermitian=True) @ (b * scale))

    beta = step(begin, rows)
    for _ in range(1, steps):
        one = rows.sparkSession.createDataFrame([([float(v) for v in beta],)], "_p array<double>")
        given = rows.withColumn("_p", one.scalar())
        eta = sum((F.col(f"_x{i}") * F.col("_p")[i] for i in range(p)), F.col("_o"))
        beta, before = step(eta, given), beta
        if np.abs(beta - before).max() < tol:
            return beta
    raise RuntimeError(f"{formula}: not settled after {steps} steps")


def cluster_columns(cluster: str | Sequence[str] | None) -> list[str]:
    """One or two grouping columns as a list; more than two raise."""
    out = [cluster] if isinstance(cluster, str) else list(cluster or [])
    if len(out) > 2:
        raise ValueError("errors cross two groupings at most")
    return out


def clustered_meat(rows: DataFrame, clusters: Sequence[str], scores: Sequence[Column]) -> np.ndarray:
    """Sum of the products of the clusters' score sums.

    Two groupings that cross: the matrix by the one, plus that by the other,
    less that by both together, for what is in the same group of either counts
    once. The rows are folded to pairs of groups first, which both roll up.
    """
    names = [f"_g{i}" for i in range(len(scores))]
    pairs = [(i, j) for i in range(len(scores)) for j in range(i, len(scores))]

    def products(df: DataFrame) -> np.ndarray:
        row = df.agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"m{i}_{j}") for i, j in pairs]).first()
        return _symmetric(row, "m", len(names))

    folded = rows.groupBy(*clusters).agg(*[F.sum(s).alias(n) for n, s in zip(names, scores)])
    if len(clusters) == 1:
        return products(folded)
    folded = cut_lineage(folded)
    by = lambda c: products(folded.groupBy(c).agg(*[F.sum(n).alias(n) for n in names]))
    return by(clusters[0]) + by(clusters[1]) - products(folded)


def nearest_covariance(cov: np.ndarray) -> np.ndarray:
    """``cov`` with its negative eigenvalues, which a difference of matrices can have, set to zero."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    return cov if values[0] >= 0 else (vectors * np.maximum(values, 0)) @ vectors.T


def _kept(df: DataFrame, formula: str, *others: str | None, write=cut_lineage) -> DataFrame:
    response, terms = model_terms(formula)
    return write(df.select(*dict.fromkeys([response, *(c for t in terms for c in t), *(c for c in others if c)])))


def with_covariance(fit: Fit, df: DataFrame, weight: str | None = None, cluster: str | Sequence[str] | None = None,
                    alpha: float = 0.0, overdispersed: bool = False) -> Fit:
    """Covariance of a fit over its frame: one aggregate, two with clusters, four with crossed ones."""
    family, link, offset, beta = fit.family, fit.link, fit.offset, fit.beta
    x = F.col("_x")
    rows = fit.with_design(df).withColumn("_y", F.col(fit.design.response).cast("double"))
    eta = fit.linear(x) + (F.col(offset) if offset else F.lit(0.0))
    rows = rows.withColumn("_eta", eta).withColumn("_mu", fit.mean(F.col("_eta")))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    mu, var = F.col("_mu"), _variance(family, F.col("_mu"), alpha)
    slope = _mean_slope(link, F.col("_eta"), mu)
    rows = rows.withColumns({"_w": w * slope * slope / var, "_s": w * (F.col("_y") - mu) * slope / var,
                             "_r": w * (F.col("_y") - mu) * (F.col("_y") - mu) / var}).filter(F.col("_w").isNotNull())
    p = len(beta)
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    info = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("_r").alias("r"),
                    *[F.sum(F.col("_w") * x[i] * x[j]).alias(f"i{i}_{j}") for i, j in upper]).first()
    bread = np.linalg.pinv(_symmetric(info, "i", p))
    fit.dispersion = float(info["r"]) / max(info["n"] - p, 1)
    if clusters := cluster_columns(cluster):
        fit.cov = nearest_covariance(bread @ clustered_meat(rows, clusters, [F.col("_s") * x[i] for i in range(p)]) @ bread)
    else:
        scaled = overdispersed or family not in ("binomial", "poisson", "negbin")
        fit.cov = bread * (fit.dispersion if scaled else 1.0)
    return fit


def _symmetric(row, prefix: str, p: int) -> np.ndarray:
    return np.array([[row[f"{prefix}{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], dtype=float)


def fit_negbin(df: DataFrame, formula: str, offset: str | None = None, cluster: str | None = None,
               rounds: int = 100, tol: float = 1e-6) -> tuple[Fit, float]:
    """Negative-binomial counts: Poisson fits with weights 1 / (1 + alpha mu),
    alpha from the moment equation, repeated until alpha settles; raises if it
    does not. The fixed point solves the score equations of the quadratic-variance
    model. ``likelihood.fit_negbin_likelihood`` has the alpha of greatest likelihood."""
    df = _kept(df, formula, offset, cluster)
    alpha, quiet = 0.0, dict(covariance=False, keep=False)
    fit = fit_glm(df.withColumn("_nbw", F.lit(1.0)), formula, "negbin", "log", offset, **quiet)
    for _ in range(rounds):
        rows = fit.with_design(df)
        mu = F.exp(fit.linear(F.col("_x")) + (F.col(offset) if offset else F.lit(0.0)))
        y = F.col(fit.design.response).cast("double")
        got = rows.select(F.sum((y - mu) * (y - mu) - mu).alias("a"), F.sum(mu * mu).alias("b")).first()
        new = max(float(got["a"]) / float(got["b"]), 0.0)
        done = abs(new - alpha) < tol * max(new, 1e-6)
        alpha = new
        weighted = rows.withColumn("_nbw", 1.0 / (1.0 + alpha * mu)).select(*df.columns, "_nbw")
        fit = fit_glm(weighted, formula, "negbin", "log", offset, **quiet)
        if done:
            return with_covariance(fit, df, cluster=cluster, alpha=alpha), alpha
    raise RuntimeError(f"{formula}: alpha not settled after {rounds} rounds")


def coef_table(spark, fit: Fit) -> DataFrame:
    """One row per coefficient: estimate, standard error, 95 % interval."""
    se = np.sqrt(np.maximum(np.diag(fit.cov), 0.0))
    return spark.createDataFrame(
        [(n, float(b), float(s), float(b - Z95 * s), float(b + Z95 * s)) for n, b, s in zip(fit.names, fit.beta, se)],
        "term string, estimate double, se double, lo double, hi double")


def predict(fit: Fit, frame: DataFrame) -> DataFrame:
    """Fitted means with a delta-method interval on the link scale."""
    rows = fit.with_design(frame)
    eta, se = fit.linear(F.col("_x")), fit.se(F.col("_x"))
    out = rows.withColumns({"_eta": eta, "_se": se})
    return out.withColumns({
        "fit": fit.mean(F.col("_eta")), "fit_lo": fit.mean(F.col("_eta") - Z95 * F.col("_se")),
        "fit_hi": fit.mean(F.col("_eta") + Z95 * F.col("_se"))}).drop("_eta", "_se", "_x")


def contrasts(fit: Fit, frame: DataFrame, level: str, axes: Sequence[str]) -> DataFrame:
    """Differences of the linear predictor between the levels of ``level`` at
    every point of ``axes``. ``frame`` is a prediction grid: the levels of a
    point are a listed few, so the join is as small as the grid."""
    rows = fit.with_design(frame).select(*axes, F.col(level).alias("_l"), F.col("_x").alias("_v"))
    one = rows.select(*axes, F.col("_l").alias("level1"), F.col("_v").alias("_v1"))
    two = rows.select(*axes, F.col("_l").alias("level2"), F.col("_v").alias("_v2"))
    pairs = one.join(two, list(axes)).filter(F.col("level1") < F.col("level2"))
    pairs = pairs.withColumn("_d", F.zip_with("_v1", "_v2", lambda p, q: p - q)).drop("_v1", "_v2")
    est, se = fit.linear(F.col("_d")), fit.se(F.col("_d"))
    return pairs.withColumns({"estimate": est, "se": se}).withColumns({
        "lo": F.col("estimate") - Z95 * F.col("se"), "hi": F.col("estimate") + Z95 * F.col("se")}).drop("_d")


def marginal_means(fit: Fit, frame: DataFrame, level: str) -> DataFrame:
    """Estimated mean of the linear predictor per level, averaged over the grid.

    ``frame`` is a prediction grid with every level at the same points, so each
    combination of the other factors counts alike. Columns ``level``, estimate,
    se, lo, hi on the link scale and ``mean`` on the response scale.
    """
    mean_x = [F.avg(F.col("_x")[i]).alias(f"_x{i}") for i in range(len(fit.beta))]
    rows = fit.with_design(frame).groupBy(level).agg(*mean_x)
    rows = rows.select(level, F.array(*[F.col(f"_x{i}") for i in range(len(fit.beta))]).alias("_x"))
    out = rows.withColumns({"estimate": fit.linear(F.col("_x")), "se": fit.se(F.col("_x"))})
    return out.withColumns({"lo": F.col("estimate") - Z95 * F.col("se"), "hi": F.col("estimate") + Z95 * F.col("se"),
                            "mean": fit.mean(F.col("estimate"))}).drop("_x")


def slopes(fit: Fit, frame: DataFrame, covariate: str, step: float = 1e-3) -> DataFrame:
    """Finite-difference slope of the fitted mean along ``covariate``: both
    means come from the same row."""
    here = fit.mean(fit.linear(F.col("_x")))
    low = fit.with_design(frame).withColumn("_f0", here).withColumn("_at", F.col(covariate))
    high = fit.with_design(low.withColumn(covariate, F.col("_at") + step)).withColumn("_f1", here)
    return high.withColumns({covariate: F.col("_at"), "slope": (F.col("_f1") - F.col("_f0")) / step}).select(*frame.columns, "slope")


def coef_report(coefs: DataFrame, labels: Mapping[str, str], order: Sequence[str], digits: int = 2) -> DataFrame:
    """Labelled, ordered coefficient lines with interval text and the
    probability of direction (normal approximation), in percent."""
    label = replace_all(F.col("term"), labels)
    pd_pct = F.when(F.col("se") > 0, normal_cdf(F.abs(F.col("estimate") / F.col("se"))) * 100.0)
    return (coefs.withColumn("label", label).withColumn("position", level_index(F.col("label"), order))
            .select("position", "label", "estimate", interval_label(F.col("lo"), F.col("hi"), digits).alias("ci"),
                    pd_pct.alias("pd_pct"))
            .orderBy("position", "label"))
