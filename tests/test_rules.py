"""Hand-computed mini tables for the null, order and arithmetic rules."""

import math

import pytest
from pyspark.sql import functions as F

from rollcall.functions import nulls, scalars, tails
from rollcall.operators import reshape
from rollcall.operators.frames import standardize, unstandardize
from rollcall.operators.ranks import exact_quantiles, split_row_number


def column(df, name):
    return [r[name] for r in df.collect()]


def test_flag_keeps_null(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "i int, c boolean").orderBy("i")
    assert column(df.select(nulls.if_na(F.col("c"), 1, 0).alias("f")), "f") == [1, 0, None]


def test_strict_and_loose_sums(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", None), ("b", None)], "k string, x int")
    out = df.groupBy("k").agg(nulls.strict(F.sum, F.col("x")).alias("s"), nulls.total(F.col("x")).alias("t")).orderBy("k").collect()
    assert [(r.s, r.t) for r in out] == [(None, 1), (None, 0)]


def test_not_in_keeps_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    assert set(column(df.filter(nulls.not_in(F.col("x"), ["b"])), "x")) == {"a", None}
    assert column(df.filter(nulls.is_in(F.col("x"), ["b"])), "x") == ["b"]


def test_distinct_counts_null_once(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "x int")
    assert df.agg(nulls.n_distinct(F.col("x")).alias("n")).first().n == 2


def test_ratio_by_zero_is_null(spark):
    assert spark.range(1).select(nulls.ratio(F.lit(1), F.lit(0)).alias("r")).first().r is None


def test_quantile_type_seven(spark):
    df = spark.createDataFrame([(0.1,), (0.25,), (0.5,)], "x double")
    assert exact_quantiles(df, [], "x", {"q": 0.025}).first().q == pytest.approx(0.1075)


@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_quantiles_match_numpy_on_ties_skew_and_small_groups(spark, accuracy):
    import numpy as np

    rng = np.random.default_rng(3)
    data = {"hot": rng.normal(size=20_000).round(1), "one": np.array([4.0]), "two": np.array([1.0, 2.0]),
            "ten": np.arange(10.0), "same": np.full(500, 7.0), "tail": np.exp(rng.normal(size=3000) * 3),
            "mid": rng.normal(size=1500)}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, x double")
    probs = {"p0": 0.0, "p025": 0.025, "p15": 0.15, "p5": 0.5, "p975": 0.975, "p1": 1.0}
    got = exact_quantiles(df, ["k"], "x", probs, accuracy=accuracy, extra={"m": F.avg("x")})
    for row in got.collect():
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.quantile(data[row.k], p), rel=1e-12, abs=1e-12), (row.k, name)
        assert row.m == pytest.approx(data[row.k].mean())


def test_split_row_number_equals_row_number(spark):
    from pyspark.sql.window import Window as W

    df = spark.range(5000).select((F.col("id") % 2).alias("g"), (F.col("id") * 37 % 101).alias("x"), "id")
    got = split_row_number(df, ["g"], [F.col("x"), F.col("id")], {"_s": F.floor(F.col("x") / 10)}, "n")
    want = df.withColumn("m", F.row_number().over(W.partitionBy("g").orderBy("x", "id")))
    assert got.join(want, "id").filter("n != m").count() == 0
    assert got.count() == 5000


def test_standardize_and_back(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "x double")
    out, stats = standardize(df, ["x"])
    assert column(out.orderBy("x"), "x_std") == [-1.0, 0.0, 1.0]
    assert column(out.orderBy("x").select(unstandardize(F.col("x_std"), stats, "x").alias("b")), "b") == [1.0, 2.0, 3.0]


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(2.5, 1), (3.5, 2)], "x double, i int")
    assert column(reshape.round_numeric(df).orderBy("i"), "x") == [2.0, 4.0]


def test_net_minutes(spark):
    df = spark.sql("""select timestamp'2024-01-01 08:00' a, timestamp'2024-01-01 15:00' b,
        timestamp'2024-01-01 11:00' s, timestamp'2024-01-01 12:30' r, cast(null as timestamp) z""")
    out = df.select(scalars.net_minutes(F.col("a"), F.col("b"), F.col("s"), F.col("r")).alias("p"),
                    scalars.net_minutes(F.col("a"), F.col("b"), F.col("z"), F.col("z")).alias("q")).first()
    assert (out.p, out.q) == (330.0, 420.0)


def test_text_helpers(spark):
    df = spark.createDataFrame([("m2019",)], "k string")
    head, tail = scalars.split_right(F.col("k"), 2)
    row = df.select(head.alias("h"), tail.alias("t"), scalars.season(F.lit("nm20")).alias("s"),
                    scalars.draw_index(F.lit("p[12]")).alias("i"), scalars.share_label(F.lit(10), F.lit(12)).alias("l"),
                    scalars.level_index(F.lit("z"), ["a", "b"]).alias("o"),
                    scalars.replace_all(F.lit("red"), {"red": "blue", "blue": "green"}).alias("c")).first()
    assert tuple(row) == ("m20", "19", "nonmating", 12, "0.83(10/12)", 3, "green")


def test_tails_against_closed_forms(spark):
    row = spark.range(1).select(
        tails.normal_cdf(F.lit(1.96)).alias("n"), tails.normal_cdf(F.lit(-1.0)).alias("m"),
        tails.chi_square_upper(F.lit(3.841458820694124), 1).alias("c1"),
        tails.chi_square_upper(F.lit(5.991464547107979), 2).alias("c2"),
        tails.chi_square_upper(F.lit(11.070497693516351), 5).alias("c5")).first()
    assert row.n == pytest.approx(0.5 * math.erfc(-1.96 / math.sqrt(2)), abs=1e-6)
    assert row.m == pytest.approx(0.5 * math.erfc(1 / math.sqrt(2)), abs=1e-6)
    assert (row.c1, row.c2, row.c5) == pytest.approx((0.05, 0.05, 0.05), abs=1e-6)


def test_pivots_and_unpivots(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "a", 3.0)], "k int, n string, v double")
    wide = reshape.to_wide(df, ["k"], "n", "v", ["a", "b"])
    assert [tuple(r) for r in wide.orderBy("k").collect()] == [(1, 1.0, None), (2, 3.0, None)]
    assert reshape.to_long(wide, ["k"], ["a", "b"], "n", "v").count() == 4
    many = reshape.to_wide_many(df, ["k"], "n", ["a", "b"], {"n": F.count("v"), "m": F.avg("v")})
    assert set(many.columns) == {"k", "n_a", "n_b", "m_a", "m_b"}


def test_unique_exposure_is_enforced(spark):
    ok = spark.createDataFrame([(1, 5.0), (1, 5.0)], "k int, dur double")
    assert reshape.require_unique(ok, ["k"], "dur").first().dur == 5.0
    bad = spark.createDataFrame([(1, 5.0), (1, 6.0)], "k int, dur double")
    with pytest.raises(Exception, match="not constant"):
        reshape.require_unique(bad, ["k"], "dur").collect()


def test_column_selection(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "a int, b int, c int, d int")
    assert reshape.cols_between(df, "b", "d") == ["b", "c", "d"]
    assert reshape.cols_matching(df, any_of=["a", "zz"]) == ["a"]
    row = spark.createDataFrame([(1, None)], "a int, b int").select(reshape.sum_across(["a", "b"]).alias("s")).first()
    assert row.s == 1
