"""Transition, rate and calendar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.functions.nulls import if_na, n_distinct, ratio, strict, total
from rollcall.functions.scalars import replace_all, season
from rollcall.operators import attendance as at
from rollcall.operators import calendar as cal
from rollcall.operators import rates as rt
from rollcall.operators import transitions as tr
from rollcall.operators.frames import standardize
from rollcall.operators.ranks import scale_by_max
from rollcall.operators.reshape import sum_across
from rollcall.plans import base as b
from rollcall.plans.registry import query
from rollcall.plans.sqlbase import NA, R
from rollcall.session import cut_lineage

DEP = """, d as (select t.*, q.present as pre from presence t left join presence q on q.entity = t.entity and q.day = t.day - 1)"""


@query("T1 J6 J8 Z6", f"""{DEP} select period, count(*) as at_risk, cast(sum(case when present = 0 then 1 else 0 end) as bigint) as n_left,
    {R('avg(case when present = 0 then 1.0 else 0.0 end) * 10')} as rate10 from d where pre = 1 group by period""")
def departures(spark, sf):
    """Flagship: present yesterday, absent today, per 10 days and period."""
    seen = b.seen_days(spark, sf).drop("period")
    moves = tr.departures_of_seen(seen, "entity", "day", b.span(spark, sf).getField("hi")).withColumn("period", b.period_of(F.col("day")))
    return (at.frequency_per(moves, ["period"], "departure", name="rate10")
            .select("period", F.col("n").alias("at_risk"), F.col("sum_flag").alias("n_left"), "rate10"))


@query("T2", f"""select code, count(*) as at_risk, cast(sum(returned) as bigint) as n_back, {R('avg(returned) * 10')} as rate10
    from trans where pre = 0 and returned is not null group by code""")
def returns(spark, sf):
    rows = b.trans(spark, sf).filter(F.col("pre") == 0)
    return (at.frequency_per(rows, ["code"], "returned", name="rate10")
            .select("code", F.col("n").alias("at_risk"), F.col("sum_flag").alias("n_back"), "rate10"))


@query("T3", f"""{DEP} select entity, cast(day as varchar) as day,
    case when pre = 1 and present = 1 then 'stay' when pre = 1 and present = 0 then 'out' when pre = 0 then 'absent' end as state3_out,
    case when pre = 0 and present = 1 then 'return' when pre = 0 and present = 0 then 'absent' when pre = 1 then 'present' end as state3_in from d""")
def state3(spark, sf):
    rows = tr.transitions(b.presence(spark, sf), "entity", "day", "state3_out")
    return rows.select("entity", "day", "state3_out",
                       tr.state_labels(F.col("present_pre"), F.col("present"), "state3_in").alias("state3_in"))


@query("T4 P9", """select entity, cast(day as varchar) as day, coalesce(case when pre = 1 and presence = 1 then 'stay'
    when pre = 1 and presence = 0 then 'out' when pre = 0 and presence = 1 then 'return' when pre = 0 and presence = 0 then 'absent' end, 'unknown') as state4 from trans""")
def state4(spark, sf):
    rows = tr.transitions(b.panel(spark, sf), "entity", "day", "state4", "presence")
    return rows.select("entity", "day", "state4").fillna({"state4": "unknown"})


@query("T5", """select cast(day as varchar) as day, case when k1 = 1 and k2 = 1 then 'Both' when k1 = 1 and k2 = 0 then 'A only'
    when k1 = 0 and k2 = 1 then 'B only' when k1 = 0 and k2 = 0 then 'None' end as joint from keyed""")
def joint_state(spark, sf):
    return b.keyed(spark, sf).select("day", tr.joint_state(F.col("k1"), F.col("k2"), "A", "B").alias("joint"))


LEAVE = """, l as (select t.entity, case when t.code like 'nm%' then 'nonmating' else 'mating' end as season, coalesce(s.rs, 0) as rs_pre, t.departure
    from trans t left join state s on s.entity = t.entity and s.day = t.day - 1 where t.pre = 1 and t.departure is not null)"""


@query("T6", f"""{LEAVE} select entity, season, cast(rs_pre as bigint) as rs_pre, count(*) as n, cast(sum(departure) as bigint) as sum_flag,
    {R('avg(departure) * 10')} as rate10 from l group by 1, 2, 3""")
def leave_rate10(spark, sf):
    rows = cal.shift_join(b.trans(spark, sf).filter(F.col("pre") == 1), b.state(spark, sf), ["entity"], "day", ["rs"])
    rows = rows.fillna({"rs_pre": 0}).withColumn("season", season(F.col("code")))
    return at.frequency_per(rows, ["entity", "season", "rs_pre"], "departure", name="rate10")


@query("T7 J5 A3", """, ev2 as (select day, group_id, entity, departure from trans where pre = 1),
    others as (select e.day, e.group_id, e.entity, count(*) as n_others, count(k.kin) as listed, max(k.kin) as best
      from ev2 e join ev2 o on o.group_id = e.group_id and o.entity <> e.entity and o.departure = 1
      left join kin k on k.entity = e.entity and k.entity2 = o.entity group by 1, 2, 3)
    select cast(e.day as varchar) as day, e.group_id, e.entity, coalesce(o.n_others, 0) as n_others,
      case when o.listed = o.n_others then o.best end as max_strict, coalesce(o.best, 0) + 0.0 as max_kin,
      case when coalesce(o.best, 0) > 0 then 1 else 0 end as kin_01
    from ev2 e left join others o on o.group_id = e.group_id and o.entity = e.entity""")
def kin_left(spark, sf):
    """Largest relatedness among the others that left the same day."""
    ev2 = cut_lineage(b.trans(spark, sf).filter(F.col("pre") == 1).select("day", "group_id", "entity", "departure"))
    kin, keys = b.kin(spark, sf), ["day", "group_id"]
    both = tr.max_pair_value(ev2, kin, "entity", keys, "departure", "kin", strict=True, keep_loose="max_any")
    return both.select(*keys, "entity", "n_others", F.col("max_kin").alias("max_strict"),
                       F.coalesce("max_any", F.lit(0.0)).alias("max_kin"),
                       (F.coalesce("max_any", F.lit(0.0)) > 0).cast("int").alias("kin_01"))


@query("T8", """, r as (select t.day, t.group_id, count(*) as back, sum(s.rs) as back_rs from trans t left join state s on s.entity = t.entity and s.day = t.day
      where t.pre = 0 and t.returned = 1 group by 1, 2),
    tot as (select p.day, p.group_id, sum(p.presence) as n_entity, sum(s.rs) as n_rs from panel p left join state s on s.entity = p.entity and s.day = p.day
      where p.presence = 1 group by 1, 2)
    select cast(t.day as varchar) as day, t.group_id, cast(t.n_entity as bigint) as n_entity, cast(t.n_rs as bigint) as n_rs,
      cast(t.n_entity - coalesce(r.back, 0) as bigint) as n_entity_other, cast(t.n_rs - coalesce(r.back_rs, 0) as bigint) as n_rs_other
    from tot t left join r on r.group_id = t.group_id""")
def leave_out_counts(spark, sf):
    """Group and state totals without the entities that came back that day."""
    rows = b.trans(spark, sf).join(b.state(spark, sf), ["entity", "day"], "left")
    here = rows.filter(F.col("presence") == 1)
    return tr.leave_out_totals(here, ["day", "group_id"], "returned", {"n_entity": F.col("presence"), "n_rs": F.col("rs")})


@query("T9 W7 R9", f"""{LEAVE}, m as (select l.season, l.rs_pre, l.departure, l.entity, entity % 15 as age from l where season = 'mating')
    select entity, cast(rs_pre as bigint) as rs_pre, departure, {R('(age - avg(age) over ()) / stddev_samp(age) over ()')} as age_std
    from m where rs_pre = 0""")
def split_standardize(spark, sf):
    """One state and season only, standardised again after the filter."""
    rows = cal.shift_join(b.trans(spark, sf).filter((F.col("pre") == 1) & F.col("departure").isNotNull()),
                          b.state(spark, sf), ["entity"], "day", ["rs"]).fillna({"rs_pre": 0})
    part = rows.filter((season(F.col("code")) == "mating") & (F.col("rs_pre") == 0))
    out, _ = standardize(part, ["age"])
    return out.select("entity", "rs_pre", "departure", "age_std")


@query("J6", """select p.entity, cast(p.day as varchar) as day, p.presence, q.presence as presence_pre
    from panel p left join panel q on q.entity = p.entity and q.day = p.day - 1""")
def prev_day(spark, sf):
    return cal.prev_day(b.panel(spark, sf), ["entity"], "day", ["presence"]).select("entity", "day", "presence", "presence_pre")


@query("J7", f"""select t.entity, cast(t.day as varchar) as day, s.rs as rs_pre, {R('g.prop')} as prop_pre
    from trans t left join state s on s.entity = t.entity and s.day = t.day - 1 left join mgd g on g.day = t.day - 1""")
def prev_day_covariates(spark, sf):
    rows = cal.shift_join(b.trans(spark, sf), b.state(spark, sf), ["entity"], "day", ["rs"])
    return cal.shift_join(rows, b.mgd(spark, sf), [], "day", ["prop"]).select("entity", "day", "rs_pre", "prop_pre")


def _exposure(spark, sf):
    return b.mgd(spark, sf).select("day", "group_id", "code", "dur")


@query("Z1 J4 R14", f""", n as (select day, count(distinct no) as n_inc from incidents group by day)
    select cast(m.day as varchar) as day, m.group_id, coalesce(n.n_inc, 0) as n_inc, {R('coalesce(n.n_inc, 0) * 60 / m.dur')} as rate
    from mgd m left join n on n.day = m.day""")
def rate_zero_fill(spark, sf):
    out = rt.incident_rate(b.incidents(spark, sf), _exposure(spark, sf), ["day"], distinct_on="no")
    return out.select("day", "group_id", "n_inc", "rate")


@query("Z2 F2 F3", f""", i as (select day, no, replace(target, '?', '') as label, entity from incidents),
    n as (select day, count(distinct no) as n_inc from i where regexp_matches(label, 'multi') or entity % 15 >= 6 group by day)
    select cast(m.day as varchar) as day, m.group_id, coalesce(n.n_inc, 0) as n_inc, {R('coalesce(n.n_inc, 0) * 60 / m.dur')} as rate
    from mgd m left join n on n.day = m.day""")
def rate_qualified(spark, sf):
    """Incidents whose target is old enough or labelled as several."""
    i = b.incidents(spark, sf).withColumn("label", replace_all(F.col("target"), {r"\?": ""}))
    keep = rt.qualifying(i, (F.col("entity") % 15 >= 6) | F.col("label").rlike("multi"))
    out = rt.incident_rate(keep, _exposure(spark, sf), ["day"], distinct_on="no")
    return out.select("day", "group_id", "n_inc", "rate")


@query("Z3 J8", f""", n as (select day, entity, count(*) as n_inc from incidents group by 1, 2)
    select u.entity, cast(m.day as varchar) as day, coalesce(n.n_inc, 0) as n_inc, {R('coalesce(n.n_inc, 0) * 60 / m.dur')} as rate
    from users u cross join mgd m left join n on n.day = m.day and n.entity = u.entity where u.entity % 15 >= 6""")
def rate_per_entity(spark, sf):
    """Rate of every grown entity on every observed day, zeros included."""
    grown = b.users(spark, sf).filter(F.col("entity") % 15 >= 6)
    exposure = cal.cross_days(grown, _exposure(spark, sf).select("day", "dur"))
    out = rt.incident_rate(b.incidents(spark, sf), exposure, ["day", "entity"])
    return out.select("entity", "day", "n_inc", "rate")


@query("Z4 J8", """, n as (select day, event_type, entity % 3 as class, count(*) as n from ev group by 1, 2, 3)
    select cast(g.day as varchar) as day, e.event_type, c.class, coalesce(n.n, 0) as n
    from (select distinct day from ev) g cross join (values ('click'), ('error'), ('purchase'), ('signup'), ('view')) e(event_type)
    cross join (values (0), (1), (2)) c(class) left join n on n.day = g.day and n.event_type = e.event_type and n.class = c.class""")
def complete_nesting(spark, sf):
    counted = b.ev(spark, sf).groupBy("day", "event_type", (F.col("entity") % 3).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return cal.complete(counted, ["day"], {"event_type": ["click", "error", "purchase", "signup", "view"], "class": [0, 1, 2]}, {"n": 0})


ACTORS = ["U0", "U1", "U2", "U3"]


@query("Z5", f""", c as (select i.day, case when replace(i.actor, '?', '') in ('U0', 'U1', 'U2', 'U3') then replace(i.actor, '?', '') else 'other' end as actor_class, s.rs
      from incidents i left join state s on s.entity = i.entity and s.day = i.day where replace(i.actor, '?', '') <> 'U6'),
    n as (select day, actor_class, rs, count(*) as n_inc from c where rs is not null group by 1, 2, 3),
    av as (select day, 'U1' as actor_class, k1 as available from keyed union all select day, 'U2', k2 from keyed)
    select cast(m.day as varchar) as day, a.actor_class, s.rs, coalesce(n.n_inc, 0) as n_inc, {R('coalesce(n.n_inc, 0) * 60 / m.dur')} as rate
    from (select day, dur from mgd where code not like 'nm%') m cross join (values ('U0'), ('U1'), ('U2'), ('U3'), ('other')) a(actor_class)
    cross join (values (0), (1)) s(rs) left join n on n.day = m.day and n.actor_class = a.actor_class and n.rs = s.rs
    left join av on av.day = m.day and av.actor_class = a.actor_class where coalesce(av.available, 1) = 1""")
def rate_by_actor(spark, sf):
    """Rate by actor class and target state, on days the actor was around."""
    i = b.incidents(spark, sf).withColumn("actor", replace_all(F.col("actor"), {r"\?": ""})).filter(F.col("actor") != "U6")
    i = i.join(b.state(spark, sf), ["entity", "day"], "left")
    exposure = _exposure(spark, sf).filter(~F.col("code").rlike("^nm")).select("day", "dur")
    available = b.keyed(spark, sf).unpivot(["day"], ["k1", "k2"], "k", "available").select(
        "day", F.when(F.col("k") == "k1", "U1").otherwise("U2").alias("actor_class"), "available")
    return rt.rate_by_actor(i, exposure, ["day"], "actor", "rs", ACTORS, [0, 1], available).drop("dur")


@query("Z6", f"""select cast(c.day as varchar) as day, {R('m.prop')} as prop from cal c left join mgd m on m.day = c.day
    where c.day between (select min(day) from mgd) and (select max(day) from mgd)""")
def calendar_complete(spark, sf):
    return cal.complete_calendar(b.mgd(spark, sf).select("day", "prop"), "day")


@query("Z7", f""", s as (select entity, min(day) as lo, max(day) as hi from seen group by entity)
    select s.entity, cast(c.day as varchar) as day, {R('v.mean_value')} as mean_value from s join cal c on c.day between s.lo and s.hi
    left join seen v on v.entity = s.entity and v.day = c.day""")
def calendar_by_entity(spark, sf):
    return cal.complete_calendar(b.seen(spark, sf).select("entity", "day", "mean_value"), "day", ["entity"])


@query("Z8", """select cast(p.day as varchar) as day, p.group_id, cast(sum(case when p.presence = 1 and s.rs = 1 then 1 else 0 end) as bigint) as n_rs,
    cast(sum(case when p.presence = 0 then 1 else 0 end) as bigint) as n_outside, cast(sum(case when p.presence = 1 and p.age >= 10 then 1 else 0 end) as bigint) as n_old
    from panel p left join state s on s.entity = p.entity and s.day = p.day group by 1, 2""")
def headcounts(spark, sf):
    rows = b.panel(spark, sf).join(b.state(spark, sf), ["entity", "day"], "left")
    here = F.col("presence") == 1
    return rt.headcounts(rows, ["day", "group_id"], {
        "n_rs": here & (F.col("rs") == 1), "n_outside": F.col("presence") == 0, "n_old": here & (F.col("age") >= 10)})


@query("P12", """select cast(day as varchar) as day, case when period % 2 = 0 then coalesce(w, 0) + coalesce(c, 0) + coalesce(e, 0) else coalesce(w, 0) + coalesce(c, 0) end as n
    from (select day, min(period) as period, cast(sum(case when event_type = 'view' then 1 end) as bigint) as w, cast(sum(case when event_type = 'click' then 1 end) as bigint) as c,
      cast(sum(case when event_type = 'error' then 1 end) as bigint) as e from ev group by day)""")
def rowwise_sum(spark, sf):
    one = lambda k: F.sum(F.when(F.col("event_type") == k, 1))
    wide = b.ev(spark, sf).groupBy("day", "period").agg(one("view").alias("w"), one("click").alias("c"), one("error").alias("e"))
    return wide.select("day", if_na(F.col("period") % 2 == 0, sum_across(["w", "c", "e"]), sum_across(["w", "c"])).alias("n"))


FOCAL = """, f as (select day, subject, sum(m) as dur_focal from (select session, day, subject, max(time) as m from focal group by 1, 2, 3) group by 1, 2)"""


@query("A6", f"{FOCAL} select cast(day as varchar) as day, subject, {R('dur_focal')} as dur_focal from f")
def session_time(spark, sf):
    return rt.two_level(b.focal(spark, sf), ["session", "day", "subject"], "time", ["day", "subject"], "dur_focal")


@query("Z9", f"""{FOCAL} select p.entity, cast(p.day as varchar) as day, {R('coalesce(f.dur_focal, 0) / p.dur')} as prop_focal
    from panel p left join f on f.subject = p.entity and f.day = p.day""")
def focal_share(spark, sf):
    focal = rt.two_level(b.focal(spark, sf), ["session", "day", "subject"], "time", ["day", "subject"], "dur_focal")
    rows = b.panel(spark, sf).join(focal.withColumnRenamed("subject", "entity"), ["entity", "day"], "left").fillna({"dur_focal": 0.0})
    return rows.select("entity", "day", ratio(F.col("dur_focal"), F.col("dur")).alias("prop_focal"))


@query("Z10", f""", n as (select day, entity, count(*) as n_inc from incidents group by 1, 2),
    r as (select p.*, coalesce(n.n_inc, 0) * 60 / p.dur as rate, s.rs, case when k.k1 = 1 and p.presence = 1 then 1 else 0 end as with_k1
      from panel p left join n on n.day = p.day and n.entity = p.entity left join state s on s.day = p.day and s.entity = p.entity
      left join keyed k on k.day = p.day where p.presence = 1)
    select code, entity, {R('avg(rate)')} as mean_rate, {R('sum(rate)')} as sum_rate, {R('case when count(rs) = count(*) then avg(rs) end')} as prop_rs,
      {R('sum(dur)')} as dur_sum, {R('avg(with_k1)')} as prop_k1, count(*) as n from r group by 1, 2""")
def entity_rates(spark, sf):
    panel = b.panel(spark, sf).filter(F.col("presence") == 1)
    rows = rt.incident_rate(b.incidents(spark, sf).select("entity", "day"), panel, ["day", "entity"])
    rows = rows.join(b.state(spark, sf), ["entity", "day"], "left").join(b.keyed(spark, sf).select("day", "k1"), "day", "left")
    together = if_na((F.col("k1") == 1) & (F.col("presence") == 1), 1, 0)
    return rows.groupBy("code", "entity").agg(
        F.avg("rate").alias("mean_rate"), F.sum("rate").alias("sum_rate"), strict(F.avg, F.col("rs")).alias("prop_rs"),
        F.sum("dur").alias("dur_sum"), F.avg(together).alias("prop_k1"), F.count(F.lit(1)).alias("n"))


@query("Z11 P8", f""", n as (select day, entity, count(*) as n_inc from incidents group by 1, 2)
    select p.entity, cast(p.day as varchar) as day, {R('coalesce(n.n_inc, 0) * 60 / p.dur')} as rate, s.rs as outcome
    from panel p join state s on s.day = p.day and s.entity = p.entity left join n on n.day = p.day and n.entity = p.entity where s.rs is not null""")
def outcome_frame(spark, sf):
    rows = rt.incident_rate(b.incidents(spark, sf).select("entity", "day"), b.panel(spark, sf), ["day", "entity"])
    rows = rows.join(b.state(spark, sf).withColumnRenamed("rs", "outcome"), ["entity", "day"], "left")
    return rows.select("entity", "day", "rate", "outcome").dropna()


@query("J9 W3 P9", f""", n as (select day, count(distinct no) as n_inc from incidents group by day),
    ri as (select m.day, coalesce(n.n_inc, 0) * 60 / m.dur as rate from mgd m left join n on n.day = m.day),
    cs as (select period, b as entity, sum(minutes) as csi from bouts group by 1, 2),
    c1 as (select entity, max(csi) as csi from cs group by entity),
    k as (select e.day, e.entity, max(k.kin) as max_kin from trans e join kin k on k.entity = e.entity
      join trans o on o.entity = k.entity2 and o.group_id = e.group_id and o.departure = 1 and o.pre = 1 where e.pre = 1 group by 1, 2)
    select t.entity, cast(t.day as varchar) as day, t.departure, s.rs as rs_pre, {R('g.prop')} as prop_pre, {R('ri.rate')} as rate_pre,
      {R('coalesce(c1.csi, 0)')} as csi, {R('coalesce(k.max_kin, 0)')} as max_kin, case when coalesce(k.max_kin, 0) > 0 then 1 else 0 end as kin_01,
      ky.k1 as k1_pre, ky.k2 as k2_pre, {R('t.rank / max(t.rank) over (partition by t.code)')} as rank_scaled
    from (select * from trans where pre = 1) t left join state s on s.entity = t.entity and s.day = t.day - 1
    left join mgd g on g.day = t.day - 1 left join ri on ri.day = t.day - 1 left join c1 on c1.entity = t.entity
    left join k on k.entity = t.entity and k.day = t.day left join keyed ky on ky.day = t.day - 1""")
def model_frame(spark, sf):
    """Assembly of all covariates of the departure model.

    The transition rows feed several branches, so they are written once.
    """
    rows = cut_lineage(b.trans(spark, sf).filter(F.col("pre") == 1))
    days = _exposure(spark, sf)
    rate = rt.incident_rate(b.incidents(spark, sf), days, ["day"], distinct_on="no")
    per_day = b.mgd(spark, sf).select("day", "prop").join(rate.select("day", "rate"), "day").join(b.keyed(spark, sf), "day", "right")
    csi = (b.bouts(spark, sf).groupBy("period", F.col("b").alias("entity")).agg(F.sum("minutes").alias("csi"))
           .groupBy("entity").agg(F.max("csi").alias("csi")))
    out = tr.max_pair_value(rows, b.kin(spark, sf), "entity", ["day", "group_id"], "departure", "kin", strict=False, fill=0.0)
    out = cal.shift_join(out, b.state(spark, sf), ["entity"], "day", ["rs"])
    out = cal.shift_join(out, per_day, [], "day", ["prop", "rate", "k1", "k2"])
    out = out.join(csi, "entity", "left").fillna({"csi": 0.0})
    out = scale_by_max(out, "rank", ["code"], "rank_scaled", rows).withColumn("kin_01", if_na(F.col("max_kin") > 0, 1, 0))
    return out.select("entity", "day", "departure", "rs_pre", "prop_pre", "rate_pre", "csi", "max_kin", "kin_01", "k1_pre", "k2_pre", "rank_scaled")


@query("A4 R14", """select entity, count(distinct actor) + max(case when actor is null then 1 else 0 end) as n_actors, count(distinct no) as n_inc from incidents group by entity""")
def distinct_incidents(spark, sf):
    return b.incidents(spark, sf).groupBy("entity").agg(
        n_distinct(F.col("actor")).alias("n_actors"), n_distinct(F.col("no")).alias("n_inc"))


@query("A3 R2 R3", f"""select p.code, p.entity, cast(case when count(s.rs) = count(*) then sum(s.rs) end as bigint) as strict_sum,
    cast(coalesce(sum(s.rs), 0) as bigint) as loose_sum, {R('case when count(s.rs) = count(*) then avg(s.rs) end')} as strict_mean,
    case when count(s.rs) = count(*) then max(s.rs) end as strict_max from panel p left join state s on s.entity = p.entity and s.day = p.day group by 1, 2""")
def strict_vs_narm(spark, sf):
    rs = F.col("rs")
    return b.panel(spark, sf).join(b.state(spark, sf), ["entity", "day"], "left").groupBy("code", "entity").agg(
        strict(F.sum, rs).alias("strict_sum"), total(rs).alias("loose_sum"), strict(F.avg, rs).alias("strict_mean"),
        strict(F.max, rs).alias("strict_max"))


@query("P10 R1", f"""select entity, cast(day as varchar) as day, {NA('rs is null', 'null', NA('rs = 1', '1', '0'))} as flag,
    {NA('rs = 1 and present = 1', "'yes'", "'no'")} as word from (select p.entity, p.day, p.present, s.rs from presence p left join state s on s.entity = p.entity and s.day = p.day)""")
def if_na_flags(spark, sf):
    rows = b.presence(spark, sf).join(b.state(spark, sf), ["entity", "day"], "left")
    flag = if_na(F.col("rs").isNull(), F.lit(None).cast("int"), if_na(F.col("rs") == 1, 1, 0))
    return rows.select("entity", "day", flag.alias("flag"), if_na((F.col("rs") == 1) & (F.col("present") == 1), F.lit("yes"), F.lit("no")).alias("word"))


@query("J5 R7", """select p.period, p.entity, q.entity as entity2, k.kin from att p join kin k on k.entity = p.entity
    join att q on q.entity = k.entity2 and q.period = p.period where p.age >= 6 and q.age >= 6 and p.entity <> q.entity""")
def dyads_in_period(spark, sf):
    """Related dyads whose members are both on the roster of a period; led by
    the pair list, so no period is paired with itself."""
    roster = b.att(spark, sf).filter(F.col("age") >= 6).select("period", "entity")
    return (roster.join(b.kin(spark, sf), "entity")
            .join(roster.withColumnRenamed("entity", "entity2"), ["period", "entity2"])
            .filter(F.col("entity") != F.col("entity2")).select("period", "entity", "entity2", "kin"))
