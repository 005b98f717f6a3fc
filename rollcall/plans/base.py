"""Base tables of the test queries, derived from the driver tables by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.functions.scalars import net_minutes
from rollcall.operators import attendance as at
from rollcall.operators.calendar import calendar, day_span, join_days, prev_day
from rollcall.operators.transitions import transition_flags
from rollcall.plans import registry
from rollcall.session import shared_table

EXCLUDED_GROUPS = ["g20240108_1"]
TROOP = 50  # members of a social unit at most, by construction of the ids


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def period_of(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("2024-01-01").cast("date")) / 10)


def ev(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "events")
    out = raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("entity"),
                     "event_type", "value", F.to_date("ts").alias("day"))
    return out.withColumn("period", period_of(F.col("day")))


_FOLDED: dict[tuple[str, str], DataFrame] = {}
registry.ON_START.append(_FOLDED.clear)


def entity_days(spark: SparkSession, sf: str) -> DataFrame:
    """The events folded to one row per entity and day, written once for all branches of a query."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FOLDED:
        _FOLDED[key] = shared_table(seen(spark, sf))
    return _FOLDED[key]


def users(spark: SparkSession, sf: str) -> DataFrame:
    return entity_days(spark, sf).select("entity").distinct()


def span(spark: SparkSession, sf: str) -> Column:
    return day_span(entity_days(spark, sf))


def seen(spark: SparkSession, sf: str) -> DataFrame:
    return ev(spark, sf).groupBy("entity", "day").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        F.max(F.when(F.col("event_type") == "purchase", 1).otherwise(0)).alias("bought"),
        F.avg("value").alias("mean_value"), F.count(F.lit(1)).alias("n_ev"))


def seen_days(spark: SparkSession, sf: str) -> DataFrame:
    return entity_days(spark, sf).select("entity", "day", period_of(F.col("day")).alias("period"))


def presence(spark: SparkSession, sf: str) -> DataFrame:
    days = seen_days(spark, sf).drop("period")
    return at.presence_grid(days, "entity", "day", span(spark, sf)).withColumn("period", period_of(F.col("day")))


def presence_timed(spark: SparkSession, sf: str) -> DataFrame:
    """Presence grid that keeps first and last sighting (null when absent)."""
    from rollcall.operators.calendar import complete_calendar

    first_last = entity_days(spark, sf).select("entity", "day", "first_seen", "last_seen")
    full = complete_calendar(first_last, "day", ["entity"], span(spark, sf))
    return full.withColumns({"present": F.col("first_seen").isNotNull().cast("int"), "period": period_of(F.col("day"))})


def att(spark: SparkSession, sf: str) -> DataFrame:
    s = span(spark, sf)
    periods = F.sequence(period_of(s.getField("lo")), period_of(s.getField("hi")))
    return users(spark, sf).select(
        F.explode(periods).alias("period"), "entity", (F.col("entity") % 15).alias("age"), (F.col("entity") + 1).alias("rank"))


def sightings(spark: SparkSession, sf: str) -> DataFrame:
    return sighting_codes(presence_timed(spark, sf))


def sighting_codes(rows: DataFrame) -> DataFrame:
    e, here = F.col("entity"), F.col("present") == 1
    code = (F.when(e % 23 == 0, at.DEAD).when(e % 15 < 6, at.TOO_YOUNG)
            .when(here & (e % 17 == 0), at.TIME_UNKNOWN).when(here, F.date_format("first_seen", "HH:mm")))
    return rows.select("entity", "day", "period", code.alias("code"))


def day_obs(spark: SparkSession, sf: str) -> DataFrame:
    """One row per observed day (bounded by the calendar)."""
    days = entity_days(spark, sf).groupBy("day").agg(F.min("first_seen").alias("start"), F.max("last_seen").alias("fin"))
    paused = F.dayofmonth("day") % 7 == 0
    return days.select("day", period_of(F.col("day")).alias("period"), "start", "fin",
                       F.when(paused, F.col("start") + F.expr("interval 4 hours")).alias("suspend"),
                       F.when(paused, F.col("start") + F.expr("interval 5 hours")).alias("restart"))


def group_nos() -> Column:
    return F.explode(F.when(F.dayofmonth("day") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))


def group_id() -> Column:
    return F.concat(F.lit("g"), F.date_format("day", "yyyyMMdd"), F.lit("_"), F.col("group_no").cast("string"))


def period_label() -> Column:
    return F.concat(F.when(F.col("period") % 2 == 0, "m").otherwise("nm"), (F.col("period") + 19).cast("string"))


def group_days(spark: SparkSession, sf: str) -> DataFrame:
    return (day_obs(spark, sf).withColumn("group_no", group_nos())
            .withColumns({"group_id": group_id(), "code": period_label(),
                          "dur": net_minutes(F.col("start"), F.col("fin"), F.col("suspend"), F.col("restart"))}))


def members(spark: SparkSession, sf: str, grid: DataFrame | None = None) -> DataFrame:
    """Long roster: every entity in every observed group of the day."""
    grid = presence(spark, sf) if grid is None else grid
    e, dom = F.col("entity"), F.dayofmonth("day")
    in_group = (F.col("present") == 1) & ((dom % 5 != 0) | ((e % 4 == 0) == (F.col("group_no") == 2)))
    return (grid.withColumn("group_no", group_nos())
            .withColumns({"group_id": group_id(), "code": period_label(), "age": e % 15, "rank": e + 1,
                          "presence": F.when((e % 29 == 0) & (dom % 9 == 0), None).when(in_group, 1).otherwise(0)})
            .drop("present"))


def is_eligible() -> Column:
    return (F.col("age") >= 6) & (F.col("entity") % 23 != 0)


def eligible(spark: SparkSession, sf: str, grid: DataFrame | None = None) -> DataFrame:
    return members(spark, sf, grid).filter(is_eligible())


def roster(spark: SparkSession, sf: str) -> DataFrame:
    return at.roster_size(sightings(spark, sf))


def sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Group sizes with roster and minutes; one row per observed group.

    Absent rows add nothing to a group, so they are not built here, and the
    roster is the same every day: both come without the full grid.
    """
    here = seen_days(spark, sf).withColumn("present", F.lit(1))
    counted = at.group_size(eligible(spark, sf, here), ["group_id"])
    days = group_days(spark, sf).select("group_id", "day", "period", "code", "dur")
    return (days.join(counted, ["group_id"], "left").fillna({"n_entity": 0})
            .withColumn("max_entity", roster_total(spark, sf)))


def roster_total(spark: SparkSession, sf: str) -> Column:
    e = F.col("entity")
    return users(spark, sf).filter((e % 23 != 0) & (e % 15 >= 6)).select(F.count(F.lit(1))).scalar()


def mgd(spark: SparkSession, sf: str) -> DataFrame:
    return at.main_group_days(sizes(spark, sf), 0.5, 240.0, EXCLUDED_GROUPS)


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Eligible roster rows of the main-group days, one per entity and day."""
    days = mgd(spark, sf).select("group_id", "dur")
    return join_days(eligible(spark, sf), days, ["group_id"]).select(
        "day", "period", "code", "group_id", "entity", "age", "rank", "presence", "dur")


def trans(spark: SparkSession, sf: str) -> DataFrame:
    """Panel with yesterday's presence and the two flags."""
    base = prev_day(panel(spark, sf), ["entity"], "day", ["presence"]).withColumnRenamed("presence_pre", "pre")
    flags = transition_flags(F.col("pre"), F.col("presence"))
    return base.withColumns({"departure": flags["departure"], "returned": flags["return"]})


def state(spark: SparkSession, sf: str) -> DataFrame:
    return entity_days(spark, sf).select("entity", "day", F.when(F.col("entity") % 19 != 0, F.col("bought")).alias("rs"))


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("event_id")
    mark = lambda k: F.when(i % k == 0, "?").otherwise("")
    return ev(spark, sf).filter(F.col("event_type") == "error").select(
        i.alias("no"), "day", "period", "entity",
        F.concat(F.lit("U"), (i % 7).cast("string"), mark(6)).alias("actor"),
        F.concat(F.when(i % 11 == 0, "multi").otherwise(F.col("entity").cast("string")), mark(5)).alias("target"))


def kin(spark: SparkSession, sf: str) -> DataFrame:
    """Listed relatives: a few rows per entity."""
    top = entity_days(spark, sf).select(F.max("entity")).scalar()
    rel = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(k).alias("k")) for d, k in ((10, 0.5), (-10, 0.5), (5, 0.25), (-5, 0.25))])
    return (users(spark, sf).withColumn("r", F.explode(rel))
            .select("entity", (F.col("entity") + F.col("r.d")).alias("entity2"), F.col("r.k").alias("kin"))
            .filter(F.col("entity2").between(0, top)))


def focal(spark: SparkSession, sf: str) -> DataFrame:
    return ev(spark, sf).select((F.col("event_id") % 3).alias("session"), "day", F.col("entity").alias("subject"),
                                F.col("value").alias("time"))


def keyed(spark: SparkSession, sf: str) -> DataFrame:
    """Daily presence of the two named key entities (k1, k2)."""
    key_days = entity_days(spark, sf).filter(F.col("entity").isin(1, 2)).groupBy("day").agg(
        F.max(F.when(F.col("entity") == 1, 1)).alias("k1"), F.max(F.when(F.col("entity") == 2, 1)).alias("k2"))
    return join_days(calendar(entity_days(spark, sf)), key_days, ["day"], "left").fillna({"k1": 0, "k2": 0})


def bouts(spark: SparkSession, sf: str) -> DataFrame:
    """Interaction minutes of two individuals, by year and kind."""
    items = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_quantity")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("period"))
    return (items.join(orders, items.l_orderkey == orders.o_orderkey).filter(F.col("l_suppkey") != F.col("o_custkey"))
            .select("period", F.least("l_suppkey", "o_custkey").alias("a"), F.greatest("l_suppkey", "o_custkey").alias("b"),
                    F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("minutes")))


def graph(spark: SparkSession, sf: str) -> DataFrame:
    return bouts(spark, sf).filter(F.col("kind") == "R").groupBy("a", "b").agg(F.sum("minutes").alias("w"))


def draws(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors read as posterior draws: one iteration per vector, p[i] per element."""
    wide = table(spark, sf, "embeddings").select(
        (F.col("vec_id") % 4 + 1).alias("chain"), (F.floor(F.col("vec_id") / 4) + 1).alias("iteration"),
        F.posexplode("embedding").alias("i", "value"))
    return wide.select("chain", "iteration", F.concat(F.lit("p["), (F.col("i") + 1).cast("string"), F.lit("]")).alias("variable"),
                       F.col("value").cast("double").alias("value"))


def draws_wide(spark: SparkSession, sf: str) -> DataFrame:
    """The same draws as a sampler writes them: one column per variable."""
    t = table(spark, sf, "embeddings")
    width = t.agg(F.max(F.size("embedding"))).first()[0] or 0
    return t.select((F.col("vec_id") % 4 + 1).alias("chain"), (F.floor(F.col("vec_id") / 4) + 1).alias("iteration"),
                    *[F.get("embedding", F.lit(i)).cast("double").alias(f"p[{i + 1}]") for i in range(width)])


def tday(spark: SparkSession, sf: str) -> DataFrame:
    days = entity_days(spark, sf)
    lo = day_span(days).getField("lo")
    return calendar(days).select("day", period_of(F.col("day")).alias("period"),
                                 (F.datediff("day", lo) + 1).cast("bigint").alias("t"))


def found(spark: SparkSession, sf: str) -> DataFrame:
    """Confirmed sightings with their time, on the observed days."""
    hits = at.decode_sightings(sighting_codes(entity_days(spark, sf).withColumns(
        {"present": F.lit(1), "period": period_of(F.col("day"))}))).filter(F.col("confirmed") == 1)
    return join_days(hits, day_obs(spark, sf).drop("period"), ["day"]).withColumn("max_entity", roster_total(spark, sf))


def roster_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Group roster joined with decoded sightings and group hours."""
    rows = eligible(spark, sf, presence_timed(spark, sf)).filter(F.col("entity") % 17 != 0)
    code = F.when(F.col("first_seen").isNotNull(), F.date_format("first_seen", "HH:mm"))
    rows = at.decode_sightings(rows.withColumn("code_time", code), "code_time").drop("day_pre", "code_time", "last_seen", "first_seen")
    hours = group_days(spark, sf).select("group_id", "start", "fin", "suspend", "restart")
    return join_days(rows, hours, ["group_id"])


def durations(spark: SparkSession, sf: str) -> DataFrame:
    return at.censored_durations(roster_rows(spark, sf), ["g20240110_2"])


