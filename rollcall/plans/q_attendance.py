"""Attendance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.functions.nulls import if_na, not_in
from rollcall.functions.scalars import minutes_between, season
from rollcall.operators import attendance as at
from rollcall.operators.calendar import join_days, prev_day
from rollcall.plans import base as b
from rollcall.plans.registry import query
from rollcall.plans.sqlbase import MIN, NA, R


@query("D1 F6", """select entity, cast(day as varchar) as day, case when code is null then 0 else 1 end as confirmed,
    case when code is not null then cast(substr(code, 1, 2) as bigint) * 60 + cast(substr(code, 4, 2) as bigint) end as minute_of_day,
    cast(day - 1 as varchar) as day_pre from sightings where code is null or code not in ('?', 'DD', 'NS')""")
def decode_sightings(spark, sf):
    """Sighting codes to times; unknown, dead and too young are dropped."""
    out = at.decode_sightings(b.sightings(spark, sf))
    minute = F.hour("found_time") * 60 + F.minute("found_time")
    return out.select("entity", "day", "confirmed", minute.alias("minute_of_day"), "day_pre")


@query("D3 W2", "select cast(day as varchar) as day, max_entity from roster")
def roster_size(spark, sf):
    return b.roster(spark, sf)


@query("D4", "select cast(day as varchar) as day, group_id, cast(coalesce(sum(presence), 0) as bigint) as n_entity from eligible group by 1, 2")
def group_size(spark, sf):
    return at.group_size(b.eligible(spark, sf), ["day", "group_id"])


@query("D5 F7", f"select cast(day as varchar) as day, group_id, {R('dur')} as dur from group_days")
def net_minutes(spark, sf):
    return b.group_days(spark, sf).select("day", "group_id", "dur")


@query("D6 P7", f"""select cast(day as varchar) as day, group_id, cast(n_entity as bigint) as n_entity, cast(max_entity as bigint) as max_entity,
    {R('dur')} as dur, {R('prop')} as prop from mgd""")
def main_group_days(spark, sf):
    return b.mgd(spark, sf).select("day", "group_id", "n_entity", "max_entity", "dur", "prop")


@query("D7", f"""select g.code, count(*) as n_days, count(m.day) as n_main, {R('count(m.day) / count(*)')} as share
    from (select distinct code, day from group_days) g left join (select distinct day from mgd) m on m.day = g.day group by 1""")
def main_group_share(spark, sf):
    return at.main_group_share(b.group_days(spark, sf), b.mgd(spark, sf), ["code"])


@query("D8 J6", """, unit as (select entity // 3 as troop, day, count(*) as max_entity, sum(present) as n_entity from presence group by 1, 2)
    select u.troop, cast(u.day as varchar) as day, u.max_entity, cast(u.n_entity as bigint) as n_entity
    from unit u join unit p on p.troop = u.troop and p.day = u.day - 1
    where u.max_entity = u.n_entity and p.max_entity = p.n_entity""")
def complete_days(spark, sf):
    """Days on which a small unit was complete today and yesterday."""
    unit = b.presence(spark, sf).groupBy(F.floor(F.col("entity") / 3).alias("troop"), "day").agg(
        F.count(F.lit(1)).alias("max_entity"), F.sum("present").alias("n_entity"))
    return at.complete_days(unit, by=["troop"]).select("troop", "day", "max_entity", "n_entity")


@query("D9", f"""select cast(f.day as varchar) as day, {NA('d.suspend is null', '0', NA('f.last_found < d.suspend', '0', '1'))} as exclude,
    {R(MIN('d.start', 'f.last_found'))} as last_minutes
    from (select day, max(found_time) as last_found from found group by day) f join day_obs d on d.day = f.day""")
def pause_screen(spark, sf):
    days = b.day_obs(spark, sf).select("day", "start", "suspend")
    out = at.pause_ok(b.found(spark, sf).select("day", "found_time"), days, ["day"])
    return out.select("day", "exclude", minutes_between(F.col("start"), F.col("last_found")).alias("last_minutes"))


@query("D10", f"""select entity, cast(day as varchar) as day, {R('dur')} as dur, arrival, {R('arrival / max_entity')} as prop from (
    select *, row_number() over (partition by day order by dur, entity) as arrival
    from (select *, {MIN('start', 'found_time')} as dur from found))""")
def arrival_curve(spark, sf):
    found = b.found(spark, sf).select("entity", "day", "start", "found_time", "max_entity")
    out = at.arrival_curve(found)
    return out.select("entity", "day", "dur", "arrival", "prop")


@query("W1 R5 R11", f"""select entity, cast(day as varchar) as day,
    row_number() over (partition by day order by {MIN('day_start', 'first_seen')} nulls last, entity) as arrival
    from (select p.*, d.start as day_start from presence p join day_obs d on d.day = p.day)""")
def arrival_rank(spark, sf):
    """Arrival order of the whole roster, absent entities last."""
    rows = join_days(b.presence_timed(spark, sf), b.day_obs(spark, sf).select("day", "start"), ["day"])
    rows = rows.select("entity", "day", minutes_between(F.col("start"), F.col("first_seen")).alias("dur"))
    return at.arrival_rank(rows, "day", "dur", "entity", "arrival").select("entity", "day", "arrival")


@query("D11", f"""select cast(day as varchar) as day, group_id, entity, {R('dur')} as dur, {R('dur_follow')} as dur_follow,
    cast(confirmed as bigint) as confirmed from durations""")
def censored_durations(spark, sf):
    return b.durations(spark, sf).select("day", "group_id", "entity", "dur", "dur_follow", "confirmed")


@query("D12", f"""select cast(m.day as varchar) as day, m.group_id, m.entity, {R(MIN('g.start', 'f.found_time'))} as dur
    from eligible m join group_days g on g.group_id = m.group_id join found f on f.entity = m.entity and f.day = m.day
    where m.entity % 17 <> 0 and m.presence = 1 and (g.suspend is null or f.found_time <= g.suspend) and m.group_id not in ('g20240110_2')""")
def confirmed_durations(spark, sf):
    out = at.confirmed_durations(b.roster_rows(spark, sf), ["g20240110_2"])
    return out.filter(F.col("presence") == 1).select("day", "group_id", "entity", "dur")


@query("D13 A10 W4", f""", last as (select day, max({MIN('start', 'found_time')}) as last_time from found group by day),
    counted as (select greatest(cast(ceil(last_time / 60.0) as bigint) - 1, 0) as bin, count(*) as n from last
        where last_time is not null group by 1),
    bins as (select unnest(range(0, greatest((select max(bin) from counted) + 1, 24))) as bin)
    select cast(b.bin as bigint) as bin, {R('b.bin * 60.0')} as lower, coalesce(c.n, 0) as n,
      {R("sum(coalesce(c.n, 0)) over (order by b.bin) / sum(coalesce(c.n, 0)) over ()")} as cdf
    from bins b left join counted c on c.bin = b.bin""")
def last_arrival_cdf(spark, sf):
    timed = b.found(spark, sf).select("day", minutes_between(F.col("start"), F.col("found_time")).alias("dur"))
    return at.histogram_cdf(at.last_arrival(timed), "last_time", 60, 1440)


@query("A10", f""", counted as (select greatest(cast(ceil(value / 10.0) as bigint) - 1, 0) as bin, count(*) as n from ev where value is not null group by 1),
    bins as (select unnest(range(0, (select max(bin) from counted) + 1)) as bin)
    select cast(b.bin as bigint) as bin, {R('b.bin * 10.0')} as lower, coalesce(c.n, 0) as n,
      {R("sum(coalesce(c.n, 0)) over (order by b.bin) / sum(coalesce(c.n, 0)) over ()")} as cdf
    from bins b left join counted c on c.bin = b.bin""")
def hist_cdf(spark, sf):
    return at.histogram_cdf(b.ev(spark, sf), "value", 10)


@query("D14", f"""select code, entity, count(*) as possible, cast(coalesce(sum(presence), 0) as bigint) as n,
    {R('coalesce(sum(presence), 0) / count(*)')} as prop from panel
    where code || '_' || entity not in ('m19_8', 'nm20_9') group by 1, 2""")
def attendance_rate(spark, sf):
    return at.attendance_rate(b.panel(spark, sf), ["code", "entity"], impossible={"code+entity": ["m19_8", "nm20_9"]})


@query("D15 F5 H2", """, r as (select code, entity, count(*) as possible, cast(coalesce(sum(presence), 0) as bigint) as n from panel group by 1, 2),
    l as (select *, printf('%.2f(%d/%d)', n / possible, n, possible) as label from r)
    select entity, max(case when code = 'm19' then label end) as m19, max(case when code = 'nm20' then label end) as nm20,
      max(case when code = 'm21' then label end) as m21 from l group by entity""")
def attendance_table(spark, sf):
    rates = at.attendance_rate(b.panel(spark, sf), ["code", "entity"])
    return at.attendance_table(rates, "entity", "code")


def _stays(spark, sf):
    return b.presence_timed(spark, sf).withColumn("minutes", minutes_between(F.col("first_seen"), F.col("last_seen")))


@query("D16", f"""select entity, cast(day as varchar) as day, case when minutes >= 60 then 1 when minutes is not null then 0 end as presence
    from (select *, {MIN('first_seen', 'last_seen')} as minutes from presence)""")
def presence_1h(spark, sf):
    return at.presence_by_stay(_stays(spark, sf), "minutes", [(60, 1)], "presence").select("entity", "day", "presence")


@query("D17", f"""select entity, cast(day as varchar) as day,
    case when minutes >= 180 then 1 when minutes >= 1 then 2 when minutes is not null then 0 end as presence
    from (select *, {MIN('first_seen', 'last_seen')} as minutes from presence)""")
def presence_3h(spark, sf):
    return at.presence_by_stay(_stays(spark, sf), "minutes", [(180, 1), (1, 2)], "presence").select("entity", "day", "presence")


@query("D18 D20", f"""select entity, season, count(*) as n, cast(sum(absent) as bigint) as sum_flag, {R('avg(absent) * 10')} as rate from (
    select entity, case when code like 'nm%' then 'nonmating' else 'mating' end as season, 1 - presence as absent from panel where presence is not null)
    group by 1, 2""")
def absence_rate(spark, sf):
    rows = b.panel(spark, sf).select("entity", season(F.col("code")).alias("season"), (1 - F.col("presence")).alias("absent"))
    return at.frequency_per(rows, ["entity", "season"], "absent")


@query("D19", f""", d as (select k.day, {NA('p.k1 is null', 'null', NA('p.k1 = 1 and k.k1 = 0', '1', '0'))} as out1,
      {NA('p.k2 is null', 'null', NA('p.k2 = 1 and k.k2 = 0', '1', '0'))} as out2
      from keyed k left join keyed p on p.day = k.day - 1)
    select count(*) as n, cast(coalesce(sum(case when out2 = 1 then 1 else 0 end), 0) as bigint) as together,
      {R('avg(case when out2 = 1 then 1.0 else 0.0 end)')} as prop from d where out1 = 1 and out2 is not null""")
def joint_leave(spark, sf):
    k = prev_day(b.keyed(spark, sf), [], "day", ["k1", "k2"])
    out = lambda i: if_na(F.col(f"{i}_pre").isNull(), F.lit(None).cast("int"),
                          if_na((F.col(f"{i}_pre") == 1) & (F.col(i) == 0), 1, 0))
    joint = at.joint_rate(k.withColumns({"out1": out("k1"), "out2": out("k2")}), "out1", "out2")
    return joint.withColumn("together", F.coalesce("together", F.lit(0)))


@query("D21", """select p.code, p.entity, case when coalesce(sum(s.rs), 0) > 0 then 1 else 0 end as any_state
    from panel p left join state s on s.entity = p.entity and s.day = p.day group by 1, 2""")
def any_flag(spark, sf):
    rows = b.panel(spark, sf).join(b.state(spark, sf), ["entity", "day"], "left")
    return at.any_flag(rows, ["code", "entity"], "rs", "any_state")


@query("D22", f"""select p.code, p.entity, {R('avg(s.rs)')} as prop_rs, count(*) as n_present
    from panel p left join state s on s.entity = p.entity and s.day = p.day where p.presence = 1 group by 1, 2""")
def state_share(spark, sf):
    rows = b.panel(spark, sf).join(b.state(spark, sf), ["entity", "day"], "left")
    return at.state_share(rows, ["code", "entity"], "presence", "rs", "prop_rs")


@query("D23 J9", f""", a as (select p.code, p.entity, max(p.rank) as rank, count(*) as possible, cast(coalesce(sum(p.presence), 0) as bigint) as n,
      case when coalesce(sum(s.rs), 0) > 0 then 1 else 0 end as any_state, avg(case when p.presence = 1 then s.rs end) as prop_rs
      from panel p left join state s on s.entity = p.entity and s.day = p.day group by 1, 2)
    select code, entity, possible, n, any_state, {R('prop_rs')} as prop_rs, {R('rank / max(rank) over (partition by code)')} as rank_scaled from a""")
def entity_panel(spark, sf):
    """Per-period panel of an entity: attendance, state, scaled rank, in one aggregate."""
    from rollcall.operators.ranks import scale_by_max

    rows = b.panel(spark, sf).join(b.state(spark, sf), ["entity", "day"], "left")
    a = rows.groupBy("code", "entity").agg(
        F.max("rank").alias("rank"), F.count(F.lit(1)).alias("possible"),
        F.coalesce(F.sum("presence"), F.lit(0)).alias("n"), (F.coalesce(F.sum("rs"), F.lit(0)) > 0).cast("int").alias("any_state"),
        F.avg(F.when(F.col("presence") == 1, F.col("rs"))).alias("prop_rs"))
    return scale_by_max(a, "rank", ["code"], "rank_scaled", b.att(spark, sf).filter(b.is_eligible()).withColumn(
        "code", b.period_label())).drop("rank")


@query("P7 R4", """select cast(day as varchar) as day, group_id from group_days
    where group_id not in ('g20240105_2', 'g20240110_2') and coalesce(cast(suspend as varchar), '') <> 'x'""")
def exclude_list(spark, sf):
    return b.group_days(spark, sf).filter(not_in(F.col("group_id"), ["g20240105_2", "g20240110_2"])).select("day", "group_id")
