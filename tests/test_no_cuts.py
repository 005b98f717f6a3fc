"""Data beyond the limits that operators once had."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.operators import regress as rg
from rollcall.operators.attendance import histogram_cdf
from rollcall.operators.calendar import complete
from rollcall.operators.draws import ess, rhat
from rollcall.operators.transitions import max_pair_value


def chains(spark, rho, n=600, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for c in range(2):
        v = 0.0
        for i in range(n):
            v = rho * v + r.normal()
            rows.append((c + 1, i + 1, "a", float(v)))
    return rows, spark.createDataFrame(rows, "chain int, iteration int, variable string, value double")


def plain_ess(rows, n):
    x = np.array([[r[3] for r in rows if r[0] == c] for c in (1, 2)])
    d = x - x.mean(1, keepdims=True)
    c = np.array([(d[:, k:] * d[:, :n - k]).sum(1).mean() / n for k in range(n)])
    within, plus = c[0] * n / (n - 1), c[0] + x.mean(1).var(ddof=1)
    rho = 1 - (within - c * n / (n - 1)) / plus
    rho[0] = 1
    total = 0.0
    for t in range(n // 2):
        p = rho[2 * t] + rho[2 * t + 1]
        if p <= 0:
            break
        total += p
    return n * 2 / (2 * total - 1)


@pytest.mark.parametrize("rho", [0.0, 0.9, 0.99])
def test_ess_has_no_largest_lag(spark, rho):
    rows, df = chains(spark, rho)
    assert ess(df, step=8, block=64).first().ess == pytest.approx(plain_ess(rows, 600), rel=1e-6)


@pytest.mark.parametrize("measure", [ess, rhat])
def test_unequal_chains_raise(spark, measure):
    _, df = chains(spark, 0.1, n=60)
    with pytest.raises(Exception, match="unequal length"):
        measure(df.filter("not (chain = 2 and iteration > 30)")).collect()


def test_histogram_reaches_the_largest_value(spark):
    df = spark.createDataFrame([(1.0,), (10.0,), (560.2,), (None,)], "v double")
    got = histogram_cdf(df, "v", 10, 500).collect()
    assert len(got) == 57 and sum(r.n for r in got) == 3 and max(r.bin for r in got if r.n) == 56
    with pytest.raises(Exception, match="negative"):
        histogram_cdf(df.unionAll(spark.createDataFrame([(-1.0,)], "v double")), "v", 10).collect()


def test_complete_keeps_unlisted_levels(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "z", 7)], "k int, level string, n int")
    got = {(r.k, r.level): r.n for r in complete(df, ["k"], {"level": ["a", "b"]}, {"n": 0}).collect()}
    assert got == {(1, "a"): 5, (1, "b"): 0, (1, "z"): 7}


def test_an_entity_is_not_its_own_relative(spark):
    events = spark.createDataFrame([(1, 1, 1), (1, 2, 0)], "day int, entity int, left int")
    pairs = spark.createDataFrame([(1, 1, 1.0), (2, 1, 0.5)], "entity int, entity2 int, kin double")
    got = {r.entity: (r.n_others, r.max_kin) for r in max_pair_value(events, pairs, "entity", ["day"], "left", "kin", strict=False).collect()}
    assert got == {1: (0, None), 2: (1, 0.5)}


def test_folded_rows_have_the_errors_of_the_rows(spark):
    r = np.random.default_rng(2)
    x, g = r.integers(0, 5, 3000), r.integers(0, 7, 3000)
    y = (r.random(3000) < 1 / (1 + np.exp(1 - 0.4 * x))).astype(float)
    df = spark.createDataFrame(list(zip(x.astype(float).tolist(), g.astype(float).tolist(), y.tolist())), "x double, g double, y double")
    whole = rg.fit_glm(df, "y ~ x", "binomial", "logit")
    for by in (["x"], ["x", "g"]):
        folded = rg.fit_glm(rg.fold_patterns(df, "y", by), "y ~ x", "binomial", "logit", weight="n")
        assert np.allclose(folded.cov, whole.cov, rtol=1e-4) and np.allclose(folded.beta, whole.beta, rtol=1e-4)


def test_slope_of_a_row(spark):
    df = spark.createDataFrame([(float(i % 7), float(2 * (i % 7))) for i in range(50)], "x double, y double")
    fit = rg.fit_glm(df, "y ~ x", "gaussian", "identity")
    got = rg.slopes(fit, df.select("x").distinct(), "x")
    assert got.columns == ["x", "slope"] and all(abs(r.slope - 2) < 1e-6 for r in got.collect())
    assert got.filter(F.col("x") == 3).count() == 1


def test_departures_of_seen(spark, days):
    from rollcall.operators.transitions import departures_of_seen

    seen = days([(1, 1), (2, 1), (4, 1), (5, 2)], "day int, entity int")
    last = F.lit("2024-01-05").cast("date")
    got = {(r.entity, r.day.day): r.departure for r in departures_of_seen(seen, "entity", "day", last).collect()}
    assert got == {(1, 2): 0, (1, 3): 1, (1, 5): 1}


@pytest.mark.parametrize("text", [True, False])
def test_arrivals_of_a_crowded_minute_are_split_by_id(spark, text):
    from rollcall.operators.attendance import arrival_rank

    ids = [f"user_{i:05d}" if text else i for i in range(400)]
    rows = [(1, e, 3.5 if k % 3 else None) for k, e in enumerate(ids)] + [(2, e, k * 0.004) for k, e in enumerate(ids)]
    df = spark.createDataFrame(rows, f"day int, entity {'string' if text else 'int'}, dur double")
    got = {(r.day, r.entity): r.arrival for r in arrival_rank(df, "day", "dur", "entity").collect()}
    for day in (1, 2):
        order = sorted((r for r in rows if r[0] == day), key=lambda r: (r[2] is None, r[2] or 0, r[1]))
        assert [got[day, r[1]] for r in order] == list(range(1, 401))


def test_normal_quantile(spark):
    from statistics import NormalDist

    from rollcall.functions.tails import normal_quantile

    p = [1e-9, 0.001, 0.02425, 0.1, 0.5, 0.7, 0.98, 1 - 1e-7]
    got = spark.createDataFrame([(v,) for v in p], "p double").select("p", normal_quantile(F.col("p")).alias("z")).collect()
    assert all(abs(r.z - NormalDist().inv_cdf(r.p)) < 1e-7 * max(1, abs(r.z)) for r in got)


def test_ranks_share_ties(spark):
    from statistics import NormalDist

    from rollcall.operators.draws import rank_normalised

    df = spark.createDataFrame([(1, i, "a", v) for i, v in enumerate([5.0, 1.0, 1.0, 9.0, 1.0])], "chain int, iteration int, variable string, value double")
    got = {r.iteration: r.value for r in rank_normalised(df).collect()}
    want = {i: NormalDist().inv_cdf((r - 0.375) / 5.25) for i, r in enumerate([4, 2, 2, 5, 2])}
    assert all(abs(got[i] - want[i]) < 1e-7 for i in want)
