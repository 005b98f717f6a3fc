"""Likelihood fits, crossed clusters, hazards, communities, permutations and checkable simulation against NumPy."""

import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.functions.tails import ratio_below_zero, rising
from rollcall.operators import diagnostics as dg
from rollcall.operators import draws as dr
from rollcall.operators import likelihood as lk
from rollcall.operators import network as nw
from rollcall.operators import ranks as rk
from rollcall.operators import regress as rg
from rollcall.operators import reshape as rs


def frame(spark, **cols):
    return spark.createDataFrame([tuple(float(v[i]) for v in cols.values()) for i in range(len(next(iter(cols.values()))))],
                                 ", ".join(f"{c} double" for c in cols))


def test_rising_sums(spark):
    cases = [(a, float(n)) for a in (1e-3, 0.7, 3.0, 250.0) for n in (0, 1, 19, 20, 21, 300)]
    df = spark.createDataFrame(cases, "a double, n double")
    for r in df.select("a", "n", rising(F.col("a"), F.col("n")).alias("r")).collect():
        terms = [r.a + j for j in range(int(r.n))]
        want = (sum(map(math.log, terms)), sum(1 / t for t in terms), sum(1 / t**2 for t in terms))
        assert tuple(r.r) == pytest.approx(want, rel=1e-12, abs=1e-12)


def numeric(loglik, at, h=1e-4):
    """Gradient and curvature by differences."""
    n = len(at)
    e = np.eye(n) * h
    g = np.array([(loglik(at + e[i]) - loglik(at - e[i])) / (2 * h) for i in range(n)])
    c = np.array([[(loglik(at + e[i] + e[j]) - loglik(at + e[i] - e[j]) - loglik(at - e[i] + e[j]) + loglik(at - e[i] - e[j])) / (4 * h * h)
                   for j in range(n)] for i in range(n)])
    return g, c


def test_beta_binomial(spark):
    rng = np.random.default_rng(3)
    x, n = rng.normal(size=400), rng.integers(1, 60, size=400)
    mu = 1 / (1 + np.exp(-(0.4 + 0.7 * x)))
    y = rng.binomial(n, rng.beta(6 * mu, 6 * (1 - mu)))
    fit, phi = lk.fit_beta_binomial(frame(spark, y=y, n=n, x=x), "y ~ x", "n")
    lg = np.vectorize(math.lgamma)

    def loglik(t):
        m, f = 1 / (1 + np.exp(-(t[1] + t[0] * x))), np.exp(t[2])
        a, b = m * f, (1 - m) * f
        return float((lg(a + y) - lg(a) + lg(b + n - y) - lg(b) - lg(f + n) + lg(f)).sum())

    at = np.array([*fit.beta, np.log(phi)])
    g, c = numeric(loglik, at)
    assert np.abs(g).max() < 1e-3 and phi == pytest.approx(6, rel=0.3)
    assert fit.cov == pytest.approx(np.linalg.inv(-c)[:2, :2], rel=1e-3)
    for _ in range(20):  # no other point is better
        assert loglik(at + rng.normal(0, 0.05, 3)) <= loglik(at) + 1e-9


def test_binomial_counts_have_no_beta_binomial_fit(spark):
    n = np.full(300, 20)
    y = np.tile([9, 10, 11], 100)  # vary less than binomial counts
    with pytest.raises(RuntimeError):
        lk.fit_beta_binomial(frame(spark, y=y, n=n, x=np.tile([0.0, 1.0], 150)), "y ~ x", "n")


def test_negative_binomial_by_likelihood(spark):
    rng = np.random.default_rng(4)
    x, off = rng.normal(size=600), np.log(rng.uniform(0.5, 3, size=600))
    mu = np.exp(1.0 + 0.5 * x + off)
    y = rng.poisson(mu * rng.gamma(2.0, 0.5, size=600))
    fit, alpha = lk.fit_negbin_likelihood(frame(spark, y=y, x=x, off=off), "y ~ x", "off")
    lg = np.vectorize(math.lgamma)

    def loglik(t):
        m, k = np.exp(t[1] + t[0] * x + off), np.exp(-t[2])
        return float((lg(k + y) - lg(k) + k * np.log(k / (k + m)) + y * np.log(m / (k + m))).sum())

    at = np.array([*fit.beta, np.log(alpha)])
    g, _ = numeric(loglik, at, 1e-5)
    assert np.abs(g).max() < 1e-4 and alpha == pytest.approx(0.5, rel=0.25)


def test_fits_that_do_not_settle_raise(spark):
    df = frame(spark, y=[0.0] * 10 + [1.0] * 10, x=[*range(20)])
    with pytest.raises(RuntimeError, match="not settled"):
        rg.fit_glm(df, "y ~ x", "binomial", "logit", steps=3)
    with pytest.raises(RuntimeError, match="not settled"):
        lk.newton(lambda b: (float(b[0]), np.array([1.0]), np.array([[-1e-9]])), np.zeros(1), "a line", most=5)


def test_errors_over_crossed_groups(spark):
    rng = np.random.default_rng(5)
    n = 1500
    x, g, h = rng.normal(size=n), rng.integers(0, 25, n), rng.integers(0, 18, n)
    eta = 0.3 * x + rng.normal(size=25)[g] * 0.6 + rng.normal(size=18)[h] * 0.6
    y = (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(float)
    fit = rg.fit_glm(frame(spark, y=y, x=x, g=g, h=h), "y ~ x", "binomial", "logit", cluster=["g", "h"])
    design = np.column_stack([x, np.ones(n)])
    mu = 1 / (1 + np.exp(-design @ fit.beta))
    bread = np.linalg.inv(design.T @ (design * (mu * (1 - mu))[:, None]))
    score = design * (y - mu)[:, None]

    def meat(keys):
        _, at = np.unique(keys, axis=0, return_inverse=True)
        sums = np.zeros((at.max() + 1, 2))
        np.add.at(sums, at.ravel(), score)
        return sums.T @ sums

    want = bread @ (meat(g[:, None]) + meat(h[:, None]) - meat(np.column_stack([g, h]))) @ bread
    assert fit.cov == pytest.approx(want, rel=1e-5)
    one = rg.fit_glm(frame(spark, y=y, x=x, g=g, h=h), "y ~ x", "binomial", "logit", cluster="g")
    assert one.cov == pytest.approx(bread @ meat(g[:, None]) @ bread, rel=1e-5)
    with pytest.raises(ValueError, match="two groupings"):
        rg.cluster_columns(["a", "b", "c"])


def test_covariances_get_no_negative_eigenvalue():
    bad = np.array([[1.0, 2.0], [2.0, 1.0]])
    good = rg.nearest_covariance(bad)
    assert np.linalg.eigvalsh(good).min() > -1e-12 and good == pytest.approx(np.full((2, 2), 1.5))
    assert (rg.nearest_covariance(np.eye(2)) == np.eye(2)).all()


@pytest.mark.parametrize("slices", [1, 7, 256])
def test_proportional_hazards(spark, slices):
    rng = np.random.default_rng(6)
    n = 300
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 2, n)])
    t = np.ceil(4 * rng.exponential(np.exp(-x @ [0.8, -0.5])))  # many ties
    d = (rng.random(n) < 0.7).astype(int)
    rows = [(float(a), int(b), float(c), float(e)) for a, b, (c, e) in zip(t, d, x)] + [(None, 1, 0.0, 0.0), (3.0, None, 0.0, 0.0)]
    fit = lk.fit_cox(spark.createDataFrame(rows, "t double, d int, a double, b double"), "t", "d", ["a", "b"], slices=slices)

    def loglik(beta):
        eta, out = x @ beta, 0.0
        for v in np.unique(t[d == 1]):
            tied, risk = np.flatnonzero((t == v) & (d == 1)), np.exp(eta[t >= v]).sum()
            own = np.exp(eta[tied]).sum()
            out += eta[tied].sum() - sum(math.log(risk - k / len(tied) * own) for k in range(len(tied)))
        return out

    g, c = numeric(loglik, fit.beta)
    assert np.abs(g).max() < 1e-5 and fit.cov == pytest.approx(np.linalg.inv(-c), rel=1e-4)
    with pytest.raises(ValueError, match="no events"):
        lk.fit_cox(spark.createDataFrame([(1.0, 0, 2.0)], "t double, d int, a double"), "t", "d", ["a"])


def edges_of(spark, rows):
    return spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in rows], "a long, b long, w double")


def modularity_of(rows, labels):
    m2 = 2 * sum(w for *_, w in rows)
    k = {}
    for a, b, w in rows:
        k[a], k[b] = k.get(a, 0) + w, k.get(b, 0) + w
    inside = sum(2 * w for a, b, w in rows if labels[a] == labels[b])
    return inside / m2 - sum(sum(v for n, v in k.items() if labels[n] == c) ** 2 for c in set(labels.values())) / m2**2


def partitions(items):
    if not items:
        yield []
        return
    for p in partitions(items[1:]):
        yield [[items[0]], *p]
        for i in range(len(p)):
            yield [*p[:i], [items[0], *p[i]], *p[i + 1:]]


@pytest.mark.parametrize("seed", [1, 2])
def test_communities_of_small_graphs_are_the_best(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(a, b, int(rng.integers(1, 6))) for a, b in itertools.combinations(range(8), 2) if rng.random() < 0.45]
    nodes = sorted({v for a, b, _ in rows for v in (a, b)})
    best = max(modularity_of(rows, {v: i for i, part in enumerate(p) for v in part}) for p in partitions(nodes))
    labels = {r.node: r.label for r in nw.communities(edges_of(spark, rows)).collect()}
    assert modularity_of(rows, labels) == pytest.approx(best) and set(labels) == set(nodes)
    assert all(labels[v] == min(n for n in nodes if labels[n] == labels[v]) for v in nodes)


def graphs():
    rng = np.random.default_rng(9)
    cliques = [(10 * c + i, 10 * c + j, 1) for c in range(6) for i, j in itertools.combinations(range(5), 2)]
    yield "ring of cliques", cliques + [(10 * c, 10 * ((c + 1) % 6) + 1, 1) for c in range(6)], 6
    block = [(a, b, 1) for a, b in itertools.combinations(range(36), 2) if rng.random() < (0.6 if a // 12 == b // 12 else 0.04)]
    yield "blocks", block, 3
    yield "chain", [(i, i + 1, 1) for i in range(16)], None
    yield "random", [(a, b, int(rng.integers(1, 9))) for a, b in itertools.combinations(range(14), 2) if rng.random() < 0.3], None


@pytest.mark.parametrize("name,rows,n", list(graphs()), ids=lambda v: v if isinstance(v, str) else "")
def test_communities_that_no_move_improves(spark, name, rows, n):
    df = edges_of(spark, rows)
    found = nw.communities(df)
    labels = {r.node: r.label for r in found.collect()}
    q = modularity_of(rows, labels)
    assert nw.modularity(df, found).first().q == pytest.approx(q)
    assert nw.raising_moves(df, found).count() == 0
    for v in labels:  # every single move, to any community or to none
        for to in {*labels.values(), -1}:
            assert modularity_of(rows, {**labels, v: to}) <= q + 1e-9
    for a, b in itertools.combinations(set(labels.values()), 2):
        assert modularity_of(rows, {v: a if c == b else c for v, c in labels.items()}) <= q + 1e-9
    assert n is None or len(set(labels.values())) == n
    other = {r.node: r.label for r in nw.label_propagation(df).collect()}
    assert q >= modularity_of(rows, other) - 1e-12


def test_propagation_and_centrality_reach_the_end_of_a_chain(spark):
    n = 80
    rows = [(i, i + 1, 1.0 + (i < 5)) for i in range(n)]
    df = edges_of(spark, rows)
    with pytest.raises(RuntimeError, match="not settled"):
        nw.eigen_centrality(df, most=20)
    got = {r.node: r.centrality for r in nw.eigen_centrality(df, tol=1e-10, every=20, most=3000).collect()}
    a = np.zeros((n + 1, n + 1))
    for i, j, w in rows:
        a[i, j] = a[j, i] = w
    v = np.abs(np.linalg.eigh(a)[1][:, -1])
    assert np.allclose([got[i] for i in range(n + 1)], v / v.max(), atol=1e-5)
    with pytest.raises(RuntimeError, match="not settled"):
        nw.label_propagation(df, most=1)


def orders(seed, perm, nodes):
    return sorted(nodes, key=lambda v: hashlib.md5(f"{seed}:{perm}:{v}".encode()).hexdigest())


def test_binomial_permutation_regression(spark):
    rng = np.random.default_rng(7)
    rows = []
    for u in range(2):
        for a, b in itertools.combinations(range(10 * u, 10 * u + 9), 2):
            x1, x2, w = float(rng.integers(0, 2)), float(abs(a - b)), int(rng.integers(5, 25))
            p = 1 / (1 + math.exp(-(-0.5 + 1.2 * x1)))
            rows.append((u, a, b, rng.binomial(w, p) / w, float(w), x1, x2))
    df = spark.createDataFrame(rows, "u long, a long, b long, y double, w double, x1 double, x2 double")
    got = {r.predictor: r for r in nw.permutation_regression(df, "y", ["x1", "x2"], ["u"], 40, 3, "w", chunk=15).collect()}

    def z(x, y, w):
        beta = np.zeros(3)
        for _ in range(30):
            mu = 1 / (1 + np.exp(-x @ beta))
            h = np.linalg.inv(x.T @ (x * (w * mu * (1 - mu))[:, None]))
            beta = beta + h @ x.T @ (w * (y - mu))
        return beta, beta / np.sqrt(np.diag(h))

    arr = np.array(rows)
    x, y, w = np.column_stack([np.ones(len(rows)), arr[:, 5:]]), arr[:, 3], arr[:, 4]
    beta, obs = z(x, y, w)
    at = {(r[1], r[2]): i for i, r in enumerate(rows)}
    resid = {}
    for j in (1, 2):
        rest = np.delete(x, j, axis=1)
        root = np.sqrt(w)[:, None]
        resid[j] = x[:, j] - rest @ np.linalg.lstsq(rest * root, x[:, j] * root[:, 0], rcond=None)[0]
    above = np.zeros(3)
    for perm in range(1, 41):
        image = {}
        for u in range(2):
            nodes = range(10 * u, 10 * u + 9)
            image |= dict(zip(orders(3, perm, nodes), orders(3, 0, nodes)))
        move = np.array([at[tuple(sorted((image[r[1]], image[r[2]])))] for r in rows])
        above[0] += abs(z(x, y[move], w[move])[1][0]) >= abs(obs[0])
        for j in (1, 2):
            xp = x.copy()
            xp[:, j] = resid[j][move]
            above[j] += abs(z(xp, y, w)[1][j]) >= abs(obs[j])
    for j, name in enumerate(["(Intercept)", "x1", "x2"]):
        assert (got[name].coef, got[name].z_obs) == pytest.approx((beta[j], obs[j]), rel=1e-6)
        assert got[name].p_value == pytest.approx(above[j] / 40) and got[name].n_perm == 40


def test_simulated_counts_are_quantiles_of_shared_numbers(spark):
    draws = spark.createDataFrame([(c, i, t, 0.1 * t, 5.0 * c) for c in (1, 2) for i in range(1, 151) for t in (1, 5, 9)],
                                  "chain long, iteration long, t long, value double, phi double")
    data = spark.createDataFrame([(1, 40), (5, 900), (9, 0)], "t long, size long")
    got = dr.simulate_counts(draws, data, "t", "size", "phi", 1000, 4).collect()
    assert len(got) == 900
    for r in got[:120]:
        n, p, phi = {1: 40, 5: 900, 9: 0}[r.t], 0.1 * r.t, 5.0 * r.chain
        u = (int(hashlib.md5(f"4:{r.t}:{r.chain}:{r.iteration}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        a, b = p * phi, (1 - p) * phi
        lb = lambda i, j: math.lgamma(i) + math.lgamma(j) - math.lgamma(i + j)
        pmf = [math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + lb(k + a, n - k + b) - lb(a, b)) for k in range(n + 1)]
        assert r.y == min(int((np.cumsum(pmf) < u).sum()), n)
    y = np.array([r.y for r in got if r.t == 5 and r.chain == 2])
    assert y.mean() == pytest.approx(450, rel=0.1)


def test_uniform_numbers(spark):
    u = np.array([r[0] for r in spark.range(20_000).select(dr.uniform(1, "id")).collect()])
    assert 0 < u.min() and u.max() < 1 and abs(np.histogram(u, 20, (0, 1))[0] - 1000).max() < 160


def test_serial_correlation_probabilities(spark):
    rng = np.random.default_rng(8)
    z = rng.normal(size=(400_000, 9)) ** 2
    for n, dw in ((4, 1.1), (7, 1.6), (10, 2.4)):
        w = 2 - 2 * np.cos(np.pi * np.arange(1, n) / n) - dw
        want = (z[:, :n - 1] @ w < 0).mean()
        got = spark.range(1).select(ratio_below_zero(F.array(*[F.lit(float(v)) for v in w]))).first()[0]
        assert got == pytest.approx(want, abs=0.004)
    half = 2 - 2 * np.cos(np.pi * np.arange(1, 12) / 12) - 2  # symmetric about 2
    assert spark.range(1).select(ratio_below_zero(F.array(*[F.lit(float(v)) for v in half]))).first()[0] == pytest.approx(0.5, abs=1e-9)


def test_serial_correlation_by_length(spark):
    import datetime as dt

    rng = np.random.default_rng(2)
    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for k in range(3) for i, v in enumerate(rng.normal(size=20).cumsum() if k == 1 else rng.normal(size=20))]
    rows += [(9, dt.date(2024, 1, 1), 1.0), (9, dt.date(2024, 1, 2), 2.0)]
    got = {r.k: r for r in dg.durbin_watson_test(spark.createDataFrame(rows, "k int, day date, v double"), "day", "v", ["k"]).collect()}
    assert got[1].p_value < 0.01 < min(got[0].p_value, got[2].p_value) and got[9].p_value is None
    day = dg.regrouped(spark.createDataFrame(rows, "k int, day date, v double"), ["day"], "v")
    assert day.count() == 20


def test_contrasts_of_many_levels(spark, monkeypatch):
    rng = np.random.default_rng(1)
    values = rng.normal(size=(60, 80))
    rows = [(1, i + 1, f"p{v:02d}", float(values[v, i])) for v in range(60) for i in range(80) if not (v == 3 and i % 2)]
    df = spark.createDataFrame(rows, "chain int, iteration int, variable string, value double")
    for size in (1 << 23, 5000):
        monkeypatch.setattr(dr, "TILE_BYTES", size)
        got = {(r.level1, r.level2): (r.mean, r.lo, r.hi) for r in dr.pairwise_contrasts(df).collect()}
        assert len(got) == 60 * 59 // 2
        for a, b in ((0, 1), (3, 59), (10, 20)):
            d = (values[a] - values[b])[::2 if a == 3 else 1]
            assert got[f"p{a:02d}", f"p{b:02d}"] == pytest.approx((d.mean(), *np.quantile(d, [0.025, 0.975])))
    with pytest.raises(Exception, match="two values"):
        dr.pairwise_contrasts(df.unionAll(df.limit(1))).collect()


def test_numbers_of_crowded_groups(spark):
    rng = np.random.default_rng(4)
    rows = [(0 if i % 3 else int(rng.integers(1, 9)), [1.5, 2.5][i % 2] if i % 5 else None, i) for i in range(5000)]
    df = spark.createDataFrame(rows, "g int, t double, e int")
    got = {r.e: r.n for r in rk.sorted_row_number(df, ["g"], [F.col("t").asc_nulls_last(), F.col("e")], "n").collect()}
    for g in range(9):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, r[1] or 0, r[2]))
        assert [got[r[2]] for r in order] == list(range(1, len(order) + 1))


def test_wide_forms_take_all_levels(spark):
    df = spark.createDataFrame([(1, p, float(p)) for p in range(4)] + [(2, None, 1.0)], "k int, p int, v double")
    many = rs.to_wide_many(df, ["k"], "p", None, {"n": F.count("v"), "s": F.sum("v")})
    assert set(many.columns) == {"k", *(f"{s}_{p}" for s in "ns" for p in range(4))}
    assert rs.to_wide(df, ["k"], "p", "v").filter("k = 1").first().asDict() == {"k": 1, "0": 0.0, "1": 1.0, "2": 2.0, "3": 3.0}
    for wide in (lambda: rs.to_wide(df, ["k"], "p", "v", [0, 1]), lambda: rs.to_wide_many(df, ["k"], "p", [0, 1], {"n": F.count("v"), "s": F.sum("v")})):
        with pytest.raises(Exception, match="not listed"):
            wide().collect()
    with pytest.raises(ValueError, match="more than 3"):
        rs.levels_of(df, "p", 3)
    square = rs.edges_to_matrix(spark.createDataFrame([(5, 6, 1.0), (6, 7, 2.0)], "a int, b int, w double"), "a", "b", "w")
    assert square.columns == ["a", "5", "6", "7"] and square.count() == 3


def test_unlisted_states_of_targets_raise(spark):
    from rollcall.operators.rates import rate_by_actor

    inc = spark.createDataFrame([(1, "x", 0), (1, "x", 2)], "day int, actor string, rs int")
    days = spark.createDataFrame([(1, 60.0)], "day int, dur double")
    free = spark.createDataFrame([], "day int, actor_class string, available int")
    with pytest.raises(Exception, match="not listed"):
        rate_by_actor(inc, days, ["day"], "actor", "rs", ["x"], [0, 1], free).collect()
    assert rate_by_actor(inc, days, ["day"], "actor", "rs", ["x"], [0, 1, 2], free).agg(F.sum("n_inc")).first()[0] == 2


def level_series(rng, n, length, q, r, trend=False):
    out = []
    for k in range(n):
        steps = rng.normal(0, q**0.5, size=length)
        level = np.cumsum(np.cumsum(steps) if trend else steps) + rng.normal(0, 3)
        out.append(level + rng.normal(0, r**0.5, size=length))
    return np.array(out)


def level_loglik(y, x, q, r, beta):
    """Log likelihood of the local level model by the joint normal density."""
    out = 0.0
    for row, xs in zip(y, x):
        t = np.flatnonzero(~np.isnan(row))
        cov = 1e6 + q * np.minimum.outer(t, t) + r * np.eye(len(t))
        v = (row - xs * beta)[t]
        out -= 0.5 * (len(t) * math.log(2 * math.pi) + np.linalg.slogdet(cov)[1] + v @ np.linalg.solve(cov, v))
    return out


def level_rows(spark, y, x):
    import datetime as dt

    rows = [(k, dt.date(2024, 1, 1) + dt.timedelta(days=t), float(v), float(x[k, t])) for k in range(len(y)) for t, v in enumerate(y[k]) if not np.isnan(v)]
    return spark.createDataFrame(rows, "k int, day date, v double, x double")


def test_smoothed_levels_are_conditional_means(spark):
    from rollcall.operators.series import smoothed_level

    rng = np.random.default_rng(3)
    y = level_series(rng, 2, 12, 0.5, 2.0)
    y[0, [3, 4, 9]] = np.nan
    got = {}
    for r in smoothed_level(level_rows(spark, y, np.zeros_like(y)), "day", "v", ["k"], 0.5, 2.0).collect():
        got[r.k, (r.day.toordinal() - 738886)] = (r.level, r.level_var)
    t = np.arange(12)
    prior = 1e6 + 0.5 * np.minimum.outer(t, t)
    for k in range(2):
        seen = np.flatnonzero(~np.isnan(y[k]))
        gain = prior[:, seen] @ np.linalg.inv(prior[np.ix_(seen, seen)] + 2.0 * np.eye(len(seen)))
        mean, var = gain @ y[k, seen], prior - gain @ prior[seen]
        days = sorted(d for kk, d in got if kk == k)
        assert [got[k, d][0] for d in days] == pytest.approx(list(mean), abs=1e-4)
        assert [got[k, d][1] for d in days] == pytest.approx(list(np.diag(var)), abs=1e-3)


@pytest.mark.parametrize("trend", [False, True])
def test_level_variances_by_em(spark, trend):
    from rollcall.operators.series import fit_level

    rng = np.random.default_rng(5)
    y = level_series(rng, 6, 60, 0.3 if not trend else 0.02, 1.0, trend)
    x = rng.integers(0, 2, y.shape).astype(float)
    y = y + 1.5 * x
    y[rng.random(y.shape) < 0.15] = np.nan
    fit = fit_level(level_rows(spark, y, x), "day", "v", ["k"], ["x"], trend=trend, start=(0.1, 0.5), tol=1e-7 if trend else 1e-8)
    rise = np.diff(fit.history)
    assert (rise > -1e-8 * np.abs(fit.history[:-1])).all()
    assert fit.beta[0] == pytest.approx(1.5, abs=0.25) and fit.r == pytest.approx(1.0, rel=0.3)
    if not trend:
        at = level_loglik(y, x, fit.q, fit.r, fit.beta[0])
        assert at == pytest.approx(fit.history[-1], abs=0.01)
        for q, r, b in ((1.1, 1, 1), (0.9, 1, 1), (1, 1.05, 1), (1, 0.95, 1), (1, 1, 1.05), (1, 1, 0.95)):
            assert level_loglik(y, x, q * fit.q, r * fit.r, b * fit.beta[0]) < at + 0.05  # what EM leaves at this tolerance


def test_neighbours_that_swap_labels_part(spark):
    rows = [(0, 10, 3.0), (0, 11, 1.0), (1, 10, 3.0), (1, 11, 1.0)]
    df = edges_of(spark, rows)
    with pytest.raises(RuntimeError):  # all vote together: both sides take each other's label for ever
        nw.label_propagation(df, F.lit(0), most=12)
    labels = {r.node: r.label for r in nw.label_propagation(df).collect()}
    assert set(labels) == {0, 1, 10, 11} and len(set(labels.values())) == 1
