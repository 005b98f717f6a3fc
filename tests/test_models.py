"""Draws, diagnostics, networks, filters and regressions against NumPy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.operators import diagnostics as dg
from rollcall.operators import draws as dr
from rollcall.operators import network as nw
from rollcall.operators import regress as rg
from rollcall.operators import series as se
from rollcall.operators.frames import poly_columns


def series(spark, values, key=1):
    rows = [(key, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(rows, "k int, day date, v double")


def test_acf_with_and_without_gap(spark):
    full = {r.lag: r.acf for r in dg.acf(series(spark, [1, 2, 3, 4]), "day", "v", ["k"], 2).collect()}
    gap = {r.lag: r.acf for r in dg.acf(series(spark, [1, None, 3, 4]), "day", "v", [], 2).collect()}
    assert full[1] == pytest.approx(0.25)
    assert gap[1] == pytest.approx(1 / 7)


def test_ljung_box_and_durbin_watson(spark):
    df = series(spark, [1, 2, 3, 4])
    assert dg.ljung_box(df, "day", "v", ["k"], 1).first().q == pytest.approx(0.5)
    assert dg.durbin_watson(df, "day", "v", ["k"]).first().dw == pytest.approx(0.6)


def test_pacf_solves_the_yule_walker_equations(spark):
    values = list(np.random.default_rng(1).normal(size=60).cumsum())
    r = [x.acf for x in dg.acf(series(spark, values), "day", "v", ["k"], 4).orderBy("lag").collect()]
    got = [x.pacf for x in dg.pacf(series(spark, values), "day", "v", ["k"], 4).orderBy("lag").collect()]
    for k in range(1, 5):
        toeplitz = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        assert got[k - 1] == pytest.approx(np.linalg.solve(toeplitz, np.array(r[1: k + 1]))[-1])


def draw_table(spark, n=200):
    rng = np.random.default_rng(5)
    values = {v: rng.normal(i, 1, size=(4, n)) for i, v in enumerate(["a", "b", "c"])}
    rows = [(c + 1, i + 1, v, float(x[c, i])) for v, x in values.items() for c in range(4) for i in range(n)]
    return spark.createDataFrame(rows, "chain int, iteration int, variable string, value double"), values


def test_draw_summaries_and_contrasts(spark):
    df, values = draw_table(spark)
    for r in dr.summarize_draws(df).collect():
        x = values[r.variable].ravel()
        assert (r.mean, r.sd, r.median) == pytest.approx((x.mean(), x.std(ddof=1), np.median(x)))
        assert (r.q2_5, r.q97_5) == pytest.approx(tuple(np.quantile(x, [0.025, 0.975])))
        assert r.mad == pytest.approx(1.4826 * np.median(np.abs(x - np.median(x))))
    got = {(r.level1, r.level2): (r.mean, r.lo, r.hi) for r in dr.pairwise_contrasts(df).collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    d = (values["a"] - values["c"]).ravel()
    assert got[("a", "c")] == pytest.approx((d.mean(), *np.quantile(d, [0.025, 0.975])))


def test_direction(spark):
    df = spark.createDataFrame([("v", -1.0), ("v", 1.0), ("v", 2.0), ("v", 3.0)], "variable string, value double")
    assert dr.direction(df).first().pd == 0.75


def test_rhat_and_ess(spark):
    df, values = draw_table(spark)
    halves = {v: np.vstack([x[:, :100], x[:, 100:]]) for v, x in values.items()}
    for r in dr.rhat(df).collect():
        x = halves[r.variable]
        w, b = x.var(axis=1, ddof=1).mean(), x.mean(axis=1).var(ddof=1)
        assert r.rhat == pytest.approx(np.sqrt((99 / 100 * w + b) / w))

    def by_hand(x, max_lag):
        m, n = x.shape
        d = x - x.mean(axis=1, keepdims=True)
        c = [np.mean([(d[i, k:] * d[i, : n - k]).sum() / n for i in range(m)]) for k in range(max_lag + 1)]
        w = c[0] * n / (n - 1)
        plus = c[0] + x.mean(axis=1).var(ddof=1)
        rho = [1.0] + [1 - (w - c[k] * n / (n - 1)) / plus for k in range(1, max_lag + 1)]
        total = 0.0
        for t in range((max_lag + 1) // 2):
            pair = rho[2 * t] + rho[2 * t + 1]
            if pair <= 0:
                break
            total += pair
        return n * m / (2 * total - 1)

    # small blocks: several tasks per chain must give the same sums
    for block in (1024, 32):
        for r in dr.ess(df, 10, block).collect():
            assert r.ess == pytest.approx(by_hand(values[r.variable], 10)), block


def test_simulation_repeats_and_follows_the_mean(spark):
    rows = [(c, i, t, 0.3) for c in range(2) for i in range(300) for t in (1, 2)]
    draws = spark.createDataFrame(rows, "chain int, iteration int, t int, value double")
    data = spark.createDataFrame([(1, 50, 12), (2, 80, 30)], "t int, size int, y int")
    one = dr.simulate_counts(draws, data, "t", "size", 40.0, 200, 3)
    two = dr.simulate_counts(draws.repartition(7), data, "t", "size", 40.0, 200, 3)
    a, b = sorted(map(tuple, one.collect())), sorted(map(tuple, two.collect()))
    assert a == b and len(a) == 400
    assert np.mean([r[3] for r in a if r[0] == 1]) == pytest.approx(15, abs=1.5)
    scaled = {r.t: r.scaled for r in dg.scaled_residuals(one, data, ["t"], "y", 1).collect()}
    assert all(0 <= v <= 1 for v in scaled.values()) and scaled[2] > scaled[1]
    assert dr.predictive_long(one, data, "t", "y").count() == 402


def test_vif(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    x[:, 2] += x[:, 0]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double")
    want = np.diag(np.linalg.inv(np.corrcoef(x.T)))
    got = {r.variable: r.vif for r in dg.vif(df, ["a", "b", "c"]).collect()}
    assert [got[c] for c in "abc"] == pytest.approx(list(want))


def test_polynomials_are_orthonormal(spark):
    df = spark.range(100).select((F.col("id") * F.col("id") / 50.0).alias("x"))
    out = np.array(poly_columns(df, "x", 3, "t").select("t1", "t2", "t3").collect())
    assert out.T @ out == pytest.approx(np.eye(3), abs=1e-8)
    assert out.sum(axis=0) == pytest.approx(np.zeros(3), abs=1e-8)


def small_graph(spark):
    groups = [(0, 1, 2, 3), (10, 11, 12, 13)]
    edges = [(a, b, 5.0) for g in groups for a in g for b in g if a < b] + [(3, 10, 1.0)]
    return spark.createDataFrame(edges, "a int, b int, w double"), edges


def test_centrality_against_eigh(spark):
    df, edges = small_graph(spark)
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    m = np.zeros((8, 8))
    for a, b, w in edges:
        i, j = nodes.index(a), nodes.index(b)
        m[i, j] = m[j, i] = w
    v = np.abs(np.linalg.eigh(m)[1][:, -1])
    got = {r.node: r.centrality for r in nw.eigen_centrality(df, tol=1e-10, every=20).collect()}
    assert [got[n] for n in nodes] == pytest.approx(list(v / v.max()), abs=1e-4)


def test_communities_and_modularity(spark):
    df, edges = small_graph(spark)
    named = nw.communities(df.select(F.format_string("n%02d", "a").alias("a"), F.format_string("n%02d", "b").alias("b"), "w"), 10)
    assert len({r.label for r in named.collect()}) == 2
    found = nw.communities(df, 10)
    labels = {r.node: r.label for r in found.collect()}
    assert len({labels[n] for n in (0, 1, 2, 3)}) == 1 and labels[0] != labels[10]
    m2 = 2 * sum(w for _, _, w in edges)
    deg = {}
    for a, b, w in edges:
        deg[a], deg[b] = deg.get(a, 0) + w, deg.get(b, 0) + w
    inside = sum(2 * w for a, b, w in edges if labels[a] == labels[b])
    want = inside / m2 - sum(sum(d for n, d in deg.items() if labels[n] == c) ** 2 for c in set(labels.values())) / m2**2
    assert nw.modularity(df, found).first().q == pytest.approx(want)


def test_qap_coefficients_and_p_values(spark):
    rng = np.random.default_rng(8)
    n = 16
    z = rng.normal(size=n)
    rows = [(0, i, j, abs(z[i] - z[j]), rng.normal()) for i in range(n) for j in range(i + 1, n)]
    rows = [(u, a, b, float(2 * x1 + 0.3 * rng.normal()), float(x1), float(x2)) for u, a, b, x1, x2 in rows]
    df = spark.createDataFrame(rows, "u int, a int, b int, y double, x1 double, x2 double")
    got = {r.predictor: r for r in nw.qap(df, "y", ["x1", "x2"], ["u"], 60, 4).collect()}
    x = np.array([[1.0, r[4], r[5]] for r in rows])
    beta = np.linalg.lstsq(x, np.array([r[3] for r in rows]), rcond=None)[0]
    assert (got["x1"].coef, got["x2"].coef) == pytest.approx((beta[1], beta[2]))
    assert got["x1"].n_perm == 60 and got["x1"].p_value < 0.05 < got["x2"].p_value


def test_permutations_are_bijections(spark):
    nodes = spark.range(30).select((F.col("id") % 2).alias("u"), F.col("id").alias("e"))
    rows = nw.permuted_nodes(nodes, ["u"], "e", range(1, 4), 1).collect()
    assert len(rows) == 90
    for p in (1, 2, 3):
        for u in (0, 1):
            part = [r for r in rows if r.perm == p and r.u == u]
            assert {r.image for r in part} == {r.e for r in part} == {e for e in range(30) if e % 2 == u}


def irls(x, y, w, link, family, offset=0.0, alpha=0.0):
    beta = np.zeros(x.shape[1])
    beta[0] = {"logit": 0.0, "cloglog": -1.0}.get(link, np.log(np.average(y, weights=w)) - np.mean(offset))
    for _ in range(100):
        eta = x @ beta + offset
        if link == "logit":
            mu = 1 / (1 + np.exp(-eta)); d = mu * (1 - mu)
        elif link == "cloglog":
            mu = 1 - np.exp(-np.exp(eta)); d = (1 - mu) * np.exp(eta)
        else:
            mu = np.exp(eta); d = mu
        v = {"binomial": mu * (1 - mu), "poisson": mu, "gamma": mu**2, "negbin": mu + alpha * mu**2}[family]
        ww = w * d * d / v
        beta = beta + np.linalg.solve(x.T @ (ww[:, None] * x), x.T @ (w * d * (y - mu) / v))
    return beta, np.linalg.inv(x.T @ (ww[:, None] * x)), mu


def regression_data(n=800):
    rng = np.random.default_rng(12)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    g = rng.integers(0, 40, size=n)
    off = np.log(rng.uniform(0.5, 3, size=n))
    eta = 0.3 + 0.6 * x1 - 0.4 * x2
    mu = np.exp(eta + off)
    return rng, x1, x2, g, off, eta, mu


def frame(spark, **cols):
    names = list(cols)
    rows = [tuple(float(cols[c][i]) for c in names) for i in range(len(cols[names[0]]))]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in names))


@pytest.mark.parametrize("link", ["logit", "cloglog"])
def test_bernoulli_and_clustered_errors(spark, link):
    rng, x1, x2, g, *_ , eta, _mu = regression_data()
    y = (rng.uniform(size=len(x1)) < 1 / (1 + np.exp(-eta))).astype(float)
    fit = rg.fit_glm(frame(spark, y=y, x1=x1, x2=x2, g=g), "y ~ x1 + x2", "binomial", link, cluster="g")
    x = np.column_stack([np.ones_like(x1), x1, x2])
    beta, bread, mu = irls(x, y, np.ones_like(y), link, "binomial")
    assert fit.names == ["x1", "x2", "(Intercept)"]
    assert list(fit.beta) == pytest.approx([beta[1], beta[2], beta[0]], abs=1e-4)
    d = mu * (1 - mu) if link == "logit" else (1 - mu) * -np.log(1 - mu)
    score = x * ((y - mu) * d / (mu * (1 - mu)))[:, None]
    sums = np.array([score[g == k].sum(axis=0) for k in np.unique(g)])
    cov = bread @ (sums.T @ sums) @ bread
    assert np.sqrt(np.diag(fit.cov)) == pytest.approx(np.sqrt(np.diag(cov))[[1, 2, 0]], rel=1e-3)


def test_gamma_with_offset(spark):
    rng, x1, x2, _, off, _, mu = regression_data()
    y = rng.gamma(3.0, mu / 3.0)
    fit = rg.fit_glm(frame(spark, y=y, x1=x1, x2=x2, off=off), "y ~ x1 + x2", "gamma", "log", offset="off")
    beta, *_ = irls(np.column_stack([np.ones_like(x1), x1, x2]), y, np.ones_like(y), "log", "gamma", off)
    assert list(fit.beta) == pytest.approx([beta[1], beta[2], beta[0]], abs=1e-4)


def test_negative_binomial_solves_its_score_equations(spark):
    rng, x1, x2, _, off, _, mu = regression_data(2000)
    y = rng.poisson(mu * rng.gamma(2.0, 0.5, size=len(mu))).astype(float)
    fit, alpha = rg.fit_negbin(frame(spark, y=y, x1=x1, x2=x2, off=off), "y ~ x1 + x2", "off")
    x = np.column_stack([x1, x2, np.ones_like(x1)])
    m = np.exp(x @ fit.beta + off)
    score = x.T @ ((y - m) / (1 + alpha * m))
    assert np.abs(score).max() < 1e-2 * len(y) ** 0.5
    assert alpha == pytest.approx(0.5, abs=0.15)
    assert list(fit.beta) == pytest.approx([0.6, -0.4, 0.3], abs=0.12)


def test_predictions_contrasts_and_slopes(spark):
    rng, x1, x2, _, _, eta, _ = regression_data()
    y = (rng.uniform(size=len(x1)) < 1 / (1 + np.exp(-eta))).astype(float)
    df = frame(spark, y=y, x1=x1).withColumn("g", F.when(F.col("x1") > 0.2, "p").otherwise("q"))
    fit = rg.fit_glm(df, "y ~ x1 + g", "binomial", "logit")
    grid = spark.createDataFrame([(v, g) for v in (-1.0, 1.0) for g in ("p", "q")], "x1 double, g string")
    rows = rg.predict(fit, grid).collect()
    assert all(r.fit_lo < r.fit < r.fit_hi for r in rows)
    by = {(r.x1, r.g): r.fit for r in rows}
    logit = lambda p: np.log(p / (1 - p))
    for r in rg.contrasts(fit, grid, "g", ["x1"]).collect():
        assert (r.level1, r.level2) == ("p", "q")
        assert r.estimate == pytest.approx(logit(by[(r.x1, "p")]) - logit(by[(r.x1, "q")]))
    for r in rg.slopes(fit, grid, "x1").collect():
        mu = by[(r.x1, r.g)]
        assert r.slope == pytest.approx(fit.beta[fit.names.index("x1")] * mu * (1 - mu), rel=1e-2)
    report = rg.coef_report(rg.coef_table(spark, fit), {"^x1$": "Slope"}, ["(Intercept)", "Slope"]).collect()
    assert [r.label for r in report][:2] == ["(Intercept)", "Slope"]


def test_local_level_by_hand(spark):
    values = [1.0, None, 3.0, 2.0]
    out = se.local_level(series(spark, values), "day", "v", ["k"], q=0.5, r=1.0).orderBy("day").collect()
    m, p, want = 0.0, se.DIFFUSE, []
    for t, v in enumerate(values):
        p = p + 0.5 if t else p
        if v is not None:
            k = p / (p + 1.0)
            m, p = m + k * (v - m), (1 - k) * p
        want.append((m, p))
    assert np.array([(r.level, r.level_var) for r in out]) == pytest.approx(np.array(want), rel=1e-6)


def test_smooth_trend_follows_a_line(spark):
    out = se.smooth_trend(series(spark, [float(i) for i in range(12)]), "day", "v", [], q=1e-6, r=1e-3).orderBy("day").collect()
    assert out[-1].level == pytest.approx(11.0, abs=1e-2)


def test_interactions_are_coded_against_a_reference(spark):
    rng, x1, *_ , eta, _mu = regression_data()
    g = np.where(x1 > 0.2, 1.0, 0.0)
    y = (rng.uniform(size=len(x1)) < 1 / (1 + np.exp(-eta))).astype(float)
    df = frame(spark, y=y, x1=x1, g=g).withColumn("g", F.when(F.col("g") == 1, "q").otherwise("p"))
    fit = rg.fit_glm(df, "y ~ x1 + g + x1:g", "binomial", "logit")
    assert fit.names == ["x1", "g_q", "x1:g_q", "(Intercept)"]
    beta, bread, mu = irls(np.column_stack([np.ones_like(x1), x1, g, x1 * g]), y, np.ones_like(y), "logit", "binomial")
    assert list(fit.beta) == pytest.approx([beta[1], beta[2], beta[3], beta[0]], abs=1e-5)
    assert np.sqrt(np.diag(fit.cov)) == pytest.approx(np.sqrt(np.diag(bread))[[1, 2, 3, 0]], rel=1e-4)
    scale = ((y - mu) ** 2 / (mu * (1 - mu))).sum() / (len(y) - 4)
    wide = rg.fit_glm(df, "y ~ x1 + g + x1:g", "binomial", "logit", overdispersed=True)
    assert np.sqrt(np.diag(wide.cov)) == pytest.approx(np.sqrt(np.diag(bread) * scale)[[1, 2, 3, 0]], rel=1e-4)
