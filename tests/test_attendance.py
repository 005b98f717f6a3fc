"""Attendance, transition, rate, survival and dyad operators on mini tables."""

import pytest
from pyspark.sql import functions as F

from rollcall.operators import attendance as at
from rollcall.operators import calendar as cal
from rollcall.operators import pairs as pr
from rollcall.operators import rates as rt
from rollcall.operators import survival as sv
from rollcall.operators import transitions as tr


def test_decode_sightings(days):
    df = days([(1, "a", "?"), (1, "b", "DD"), (1, "c", None), (1, "d", "08:05")], "day int, entity string, code string")
    out = {r.entity: (r.confirmed, r.found_time) for r in at.decode_sightings(df).collect()}
    assert set(out) == {"c", "d"}
    assert out["c"] == (0, None)
    assert out["d"][0] == 1 and str(out["d"][1]) == "2024-01-01 08:05:00"


def test_departure_and_return_need_the_calendar_day_before(days):
    df = days([(1, "a", 1), (2, "a", 0), (4, "a", 1)], "day int, entity string, present int")
    dep = {r.day.day: r.departure for r in tr.transitions(df, "entity", "day", "departure").collect()}
    ret = {r.day.day: r["return"] for r in tr.transitions(df, "entity", "day", "return").collect()}
    assert dep == {1: None, 2: 1, 4: None}
    assert ret == {1: None, 2: 0, 4: None}


def test_four_states(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (3, 0, 1), (4, 0, 0), (5, None, 1)], "i int, p int, n int")
    out = df.orderBy("i").select(tr.state_labels(F.col("p"), F.col("n"), "state4").alias("s"))
    assert [r.s for r in out.collect()] == ["stay", "out", "return", "absent", None]


def test_max_kin_strict_and_filled(spark):
    events = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 1), (2, "a", 1), (2, "b", 0)], "day int, e string, left int")
    kin = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.5)], "e string, e2 string, kin double")
    strict = tr.max_pair_value(events, kin, "e", ["day"], "left", "kin", strict=True)
    got = {(r.day, r.e): (r.n_others, r.max_kin) for r in strict.collect()}
    assert got[(1, "a")] == (2, None)  # c left too and is not listed
    assert got[(2, "b")] == (1, 0.5)
    assert got[(2, "a")] == (0, None)
    loose = tr.max_pair_value(events, kin, "e", ["day"], "left", "kin", strict=False, fill=0.0)
    got = {(r.day, r.e): r.max_kin for r in loose.collect()}
    assert got == {(1, "a"): 0.5, (1, "b"): 0.0, (1, "c"): 0.0, (2, "a"): 0.0, (2, "b"): 0.5}


def test_rates_keep_zero_days_and_drop_unobserved_ones(spark):
    exposure = spark.createDataFrame([(1, 90.0), (2, 60.0)], "day int, dur double")
    incidents = spark.createDataFrame([(1, 7), (1, 8), (1, 9), (3, 10), (3, 11)], "day int, no int")
    out = {r.day: r.rate for r in rt.incident_rate(incidents, exposure, ["day"], distinct_on="no").collect()}
    assert out == {1: 2.0, 2: 0.0}


def test_leave_out_totals(spark):
    rows = spark.createDataFrame([(1, 1, 1), (1, 0, 1), (1, 0, None)], "day int, back int, rs int")
    row = tr.leave_out_totals(rows, ["day"], "back", {"n": F.lit(1), "rs": F.col("rs")}).first()
    assert (row.n, row.n_other, row.rs, row.rs_other) == (3, 2, 2, 1)


def test_life_table(spark):
    df = spark.createDataFrame([(1.0, 1), (2.0, 1), (2.0, 0)], "dur double, event int").withColumn("g", F.lit(1))
    out = sv.life_table(df, "dur", "event", 1.0, ["g"]).orderBy("bin").collect()
    assert [r.hazard for r in out] == pytest.approx([1 / 3, 1 / 2])
    assert [r.cum_detect for r in out] == pytest.approx([1 / 3, 2 / 3])


def test_person_period_expansion(spark):
    df = spark.createDataFrame([("a", 2.7, 10.0, 1), ("b", None, 10.0, 1), ("c", 10.0, 3.0, 0), ("d", -1.0, 9.0, 1)],
                               "e string, dur double, follow double, event int")
    out = sorted((r.e, r.time, r.hit) for r in sv.person_period(df, "dur", "follow", 1.0, "event").collect())
    assert out == [("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("c", 1, 0), ("c", 2, 0), ("c", 3, 0)]


def test_life_table_agrees_with_expansion(spark):
    df = spark.range(300).select((F.col("id") * 7 % 41 + 0.5).alias("dur"), F.lit(60.0).alias("follow"),
                                 (F.col("id") % 3 > 0).cast("int").alias("event"), F.lit(1).alias("g"))
    table = {r.bin: r.events / r.at_risk for r in sv.life_table(df, "dur", "event", 5.0, ["g"]).collect()}
    rows = sv.person_period(df, "dur", "follow", 5.0, "event").groupBy("time").agg(F.avg("hit").alias("h"))
    assert {r.time: r.h for r in rows.collect()} == pytest.approx(table)


def test_cumulative_detection(spark):
    from pyspark.sql.window import Window as W

    df = spark.createDataFrame([(1, 0.5), (2, 0.25), (3, 0.1)], "t int, p double").withColumn("g", F.lit(1))
    run = W.partitionBy("g").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    out = df.select("t", sv.cumulative_detection(F.col("p"), run).alias("c")).orderBy("t")
    assert [r.c for r in out.collect()] == pytest.approx([0.5, 0.625, 0.6625])


def test_calendar_completion(days):
    df = days([(2, "a", 1), (5, "a", 2), (3, "b", 9)], "day int, e string, v int")
    out = sorted((r.e, r.day.day, r.v) for r in cal.complete_calendar(df, "day", ["e"]).collect())
    assert out == [("a", 2, 1), ("a", 3, None), ("a", 4, None), ("a", 5, 2), ("b", 3, 9)]
    spanned = cal.complete_calendar(df, "day", ["e"], cal.day_span(df))
    assert sorted((r.e, r.day.day, r.v) for r in spanned.collect()) == [
        ("a", 2, 1), ("a", 3, None), ("a", 4, None), ("a", 5, 2), ("b", 2, None), ("b", 3, 9), ("b", 4, None), ("b", 5, None)]
    whole = cal.complete_calendar(df.filter("e = 'a'").drop("e"), "day")
    assert sorted((r.day.day, r.v) for r in whole.collect()) == [(2, 1), (3, None), (4, None), (5, 2)]


def test_arrival_rank_orders_null_last_and_ties_by_entity(spark):
    df = spark.createDataFrame([(1, 5.0, 2), (1, None, 3), (1, 5.0, 1), (1, 5.25, 0), (1, 4.9, 9), (1, None, 0), (1, 5.9, 4)],
                               "day int, dur double, e int")
    out = at.arrival_rank(df, "day", "dur", "e", "n")
    assert [(r.e, r.dur) for r in out.orderBy("n").collect()] == [
        (9, 4.9), (1, 5.0), (2, 5.0), (0, 5.25), (4, 5.9), (0, None), (3, None)]


def test_arrival_rank_with_text_ids(spark):
    df = spark.createDataFrame([(1, 5.0, "kun"), (1, 5.0, "kil"), (1, None, "b"), (1, None, "a"), (1, 4.5, "zzz")], "day int, dur double, e string")
    out = at.arrival_rank(df, "day", "dur", "e", "n")
    assert [r.e for r in out.orderBy("n").collect()] == ["zzz", "kil", "kun", "a", "b"]


def test_complete_days(days):
    df = days([(1, 3, 3), (2, 3, 3), (3, 2, 3), (5, 3, 3)], "day int, n_entity int, max_entity int")
    assert [r.day.day for r in at.complete_days(df).collect()] == [2]


def test_histogram_bins_are_closed_on_the_right(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.1,), (30.0,)], "x double")
    out = [(r.bin, r.n, r.cdf) for r in at.histogram_cdf(df, "x", 10, 30).orderBy("bin").collect()]
    assert out == [(0, 2, 0.5), (1, 1, 0.75), (2, 1, 1.0)]


def test_stay_levels(spark):
    df = spark.createDataFrame([(0, 200.0), (1, 60.0), (2, 0.5), (3, None)], "i int, m double")
    out = at.presence_by_stay(df, "m", [(180, 1), (1, 2)], "p").orderBy("i")
    assert [r.p for r in out.collect()] == [1, 2, 0, None]


def test_simple_ratio_index(spark):
    seen = {1: "ab", 2: "a", 3: "bc"}
    rows = [(d, e, int(e in present), 1) for d, present in seen.items() for e in "abc"]
    df = spark.createDataFrame(rows, "d int, e string, present int, unit int")
    out = pr.association_index(df, "e", F.col("d"), ["unit"])
    got = {(r.a, r.b): r.sri for r in out.collect()}
    assert got == pytest.approx({("a", "b"): 1 / 3, ("b", "c"): 1 / 2, ("a", "c"): 0.0})


@pytest.mark.parametrize("block", [1000, 7])
def test_pairs_are_emitted_once_whatever_the_block(spark, block):
    df = spark.range(40).select(F.lit(1).alias("u"), F.col("id").alias("e"), (F.col("id") * 2).alias("v"))
    rows = pr.pairs_within(df, ["u"], "e", ["v"], block=block).collect()
    assert len(rows) == 40 * 39 // 2
    assert {(r.a, r.b) for r in rows} == {(a, b) for a in range(40) for b in range(a + 1, 40)}
    assert all(r.v_a == 2 * r.a and r.v_b == 2 * r.b for r in rows)


def test_association_over_many_days_against_brute_force(spark):
    rows = [(d, e, int((d * 7 + e * 13 + d * e) % 11 < 5), 0) for d in range(150) for e in range(12)]
    df = spark.createDataFrame(rows, "d int, e int, present int, unit int")
    by = {e: {d for d, x, p, _ in rows if x == e and p} for e in range(12)}
    for r in pr.association_index(df, "e", F.col("d"), ["unit"]).collect():
        assert r.sri == pytest.approx(len(by[r.a] & by[r.b]) / len(by[r.a] | by[r.b]))


def test_co_event_index_only_counts_shared_risk(spark):
    rows = [(1, "a", 1, 0), (1, "b", 1, 0), (2, "a", 1, 0), (2, "b", None, 0), (3, "a", 0, 0), (3, "b", 1, 0)]
    df = spark.createDataFrame(rows, "d int, e string, left int, unit int")
    r = pr.co_event_index(df, "e", F.col("d"), ["unit"], "left").first()
    assert (r.days_both, r.together, r.denom, r.sri) == (2, 1, 2, 0.5)


def test_pair_standardisation_uses_both_triangles(spark):
    import numpy as np

    values = [1.0, 4.0, 9.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    cells = np.array(values * 2)
    want = (np.array(values) - cells.mean()) / cells.std(ddof=1)
    got = [r.v_std for r in pr.standardize_pairs(df, ["v"]).orderBy("i").collect()]
    assert got == pytest.approx(list(want))


def test_sociality_index(spark):
    rows = [(1, 1, 2, "g", 4.0), (1, 1, 2, "n", 2.0), (1, 1, 3, "n", 6.0)]
    df = spark.createDataFrame(rows, "p int, a int, b int, kind string, minutes double")
    out = {r.b: r.csi for r in pr.sociality_index(df, ["p"], F.col("kind") == "g", F.col("kind") == "n").collect()}
    assert out == pytest.approx({2: (4 / 2 + 2 / 4) / 2, 3: (0 + 6 / 4) / 2})
