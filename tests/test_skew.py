"""A third of all rows in one group: results must stay whole and equal to brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollcall.operators import attendance as at
from rollcall.operators import draws as dr
from rollcall.operators import rates as rt
from rollcall.operators import transitions as tr
from rollcall.operators.pairs import association_index
from rollcall.operators.ranks import exact_quantiles, scale_by_max


@pytest.fixture(scope="module")
def hot(spark):
    """12 000 sightings; day 0 holds 4 000 of them, many at the same minute."""
    ids = spark.range(12_000)
    day = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 7 + 1)
    dur = F.when(F.col("id") % 2 == 0, 30.0).otherwise((F.col("id") * 37 % 600) / 1.3)
    return ids.select(day.cast("int").alias("day"), F.when(F.col("id") % 11 > 0, dur).alias("dur"), F.col("id").alias("entity"))


def test_arrival_order_on_a_hot_day(spark, hot):
    out = at.arrival_rank(hot, "day", "dur", "entity", "n").toPandas()
    want = out.assign(k=out["dur"].fillna(np.inf)).sort_values(["day", "k", "entity"])
    want["m"] = want.groupby("day").cumcount() + 1
    assert (want["n"] == want["m"]).all() and len(want) == 12_000


def test_quantiles_of_a_hot_group(spark, hot):
    data = hot.toPandas()
    for r in exact_quantiles(hot, ["day"], "dur", {"a": 0.1, "b": 0.5, "c": 0.99}, accuracy=200).collect():
        x = data.loc[data["day"] == r.day, "dur"].dropna()
        assert (r.a, r.b, r.c) == pytest.approx(tuple(np.quantile(x, [0.1, 0.5, 0.99])))


def test_rates_of_a_hot_day(spark, hot):
    exposure = spark.createDataFrame([(d, 60.0 * (d + 1)) for d in range(10)], "day int, dur double")
    incidents = hot.select("day", (F.col("entity") % 500).alias("no"))
    data = incidents.toPandas().groupby("day")["no"].nunique()
    for r in rt.incident_rate(incidents, exposure, ["day"], distinct_on="no").collect():
        assert r.rate == pytest.approx(data.get(r.day, 0) / (r.day + 1))


def test_relatives_on_a_hot_day(spark, hot):
    events = hot.select("day", "entity", (F.col("entity") % 5 < 2).cast("int").alias("left"))
    kin = spark.range(12_000).select(F.col("id").alias("entity"), F.explode(F.array(F.col("id") + 3, F.col("id") - 3, F.col("id") + 21)).alias("entity2"))
    kin = kin.withColumn("kin", F.when(F.abs(F.col("entity") - F.col("entity2")) == 3, 0.5).otherwise(0.25))
    out = tr.max_pair_value(events, kin, "entity", ["day"], "left", "kin", strict=False, fill=0.0).toPandas()
    left = {(r.day, r.entity) for r in events.filter("left = 1").collect()}
    for r in out.itertuples():
        want = max([v for d, v in ((3, 0.5), (-3, 0.5), (21, 0.25)) if (r.day, r.entity + d) in left], default=0.0)
        assert r.max_kin == want
    assert len(out) == 12_000


def test_scaled_rank_of_a_hot_group(spark, hot):
    out = scale_by_max(hot, "entity", ["day"], "s").toPandas()
    assert len(out) == 12_000 and out.groupby("day")["s"].max().eq(1.0).all()


def test_pairs_of_a_large_unit_are_complete(spark):
    n, t = 120, 70
    present = (np.random.default_rng(0).uniform(size=(n, t)) < 0.4).astype(int)
    rows = [(0 if e < 90 else 1, e, d, int(present[e, d])) for e in range(n) for d in range(t)]
    df = spark.createDataFrame(rows, "unit int, e int, d int, present int")
    got = association_index(df, "e", F.col("d"), ["unit"]).toPandas()
    assert len(got) == 90 * 89 // 2 + 30 * 29 // 2
    for r in got.itertuples():
        a, b = present[r.a], present[r.b]
        assert r.sri == pytest.approx((a & b).sum() / (a | b).sum())


def test_contrasts_with_one_long_chain(spark):
    rows = spark.range(6000).select((F.col("id") % 3 % 2).alias("chain"), F.col("id").alias("iteration"),
                                    F.explode(F.array(F.lit("a"), F.lit("b"))).alias("variable"))
    df = rows.withColumn("value", F.pmod(F.xxhash64("variable", "iteration"), F.lit(1000)) / 1000.0)
    data = df.toPandas().pivot(index=["chain", "iteration"], columns="variable", values="value")
    d = data["a"] - data["b"]
    r = dr.pairwise_contrasts(df).first()
    assert (r.mean, r.lo, r.hi) == pytest.approx((d.mean(), *np.quantile(d, [0.025, 0.975])))
