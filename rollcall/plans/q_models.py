"""Time-to-event, dyad, draw, diagnostic and regression queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollcall.functions.scalars import season
from rollcall.functions.tails import QUANTILE_CUT, QUANTILE_MID, QUANTILE_TAIL
from rollcall.operators import calendar as cal
from rollcall.operators import diagnostics as dg
from rollcall.operators import draws as dr
from rollcall.operators import frames as fr
from rollcall.operators import likelihood as lk
from rollcall.operators import network as nw
from rollcall.operators import pairs as pr
from rollcall.operators import regress as rg
from rollcall.operators import series as se
from rollcall.operators import survival as sv
from rollcall.plans import base as b
from rollcall.plans.registry import query
from rollcall.plans.sqlbase import COEFS, GLM, LINEAR, LOGITS, SHAPED, R
from rollcall.session import cut_lineage

BIN = 30.0  # minutes per interval of the rows that ``person_period`` lists


# Time to event -----------------------------------------------------------

@query("V1 R12 R13", """, d as (select day, entity, confirmed, dur, least(cast(ceil(dur / 30.0) as bigint), cast(ceil(dur_follow / 30.0) as bigint)) as last
      from durations where dur > 0)
    select cast(day as varchar) as day, entity, t.time, case when t.time = cast(ceil(dur / 30.0) as bigint) and confirmed = 1 then 1 else 0 end as hit
    from d, lateral (select unnest(range(1, last + 1)) as time) t""")
def person_period(spark, sf):
    return sv.person_period(b.durations(spark, sf), "dur", "dur_follow", BIN, "confirmed").select("day", "entity", "time", "hit")


@query("V2 W5", f""", n as (select period, cast(ceil(dur) as bigint) as bin, count(*) as n, sum(confirmed) as events from durations where dur > 0 group by 1, 2),
    h as (select period, bin, cast(events as bigint) as events, cast(sum(n) over (partition by period order by bin desc) as bigint) as at_risk from n)
    select period, bin, events, at_risk, {R('events / at_risk')} as hazard,
      {R('1 - product(1 - events / at_risk) over (partition by period order by bin rows unbounded preceding)')} as cum_detect from h""")
def life_table(spark, sf):
    return sv.life_table(b.durations(spark, sf), "dur", "confirmed", 1.0, ["period"])


@query("V1", """, d as (select period, confirmed, dur, least(cast(ceil(dur) as bigint), cast(ceil(dur_follow) as bigint)) as last from durations where dur > 0)
    select period, t.time, count(*) as n, cast(sum(case when t.time = cast(ceil(dur) as bigint) and confirmed = 1 then 1 else 0 end) as bigint) as hits
    from d, lateral (select unnest(range(1, last + 1)) as time) t group by 1, 2""")
def person_minutes(spark, sf):
    """Person-period rows by the minute, counted per period and minute."""
    rows = sv.person_period(b.durations(spark, sf), "dur", "dur_follow", 1.0, "confirmed")
    return rows.groupBy("period", "time").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))


def _hazard_rows(spark, sf):
    """Person-period rows by the minute, folded to counts per cell: the likelihood
    only needs the number at risk and the hits of every covariate pattern."""
    rows = sv.person_period(b.durations(spark, sf), "dur", "dur_follow", 1.0, "confirmed").select(
        (F.col("time") / 60).alias("time"), F.col("rank").cast("double").alias("rank_c"), F.col("hit").alias("p"))
    return rg.fold_patterns(rows, "p", ["time", "rank_c"])


def _coefs(spark, fit):
    return rg.coef_table(spark, fit).select("term", "estimate", "se", "lo", "hi")


HAZARD = """select avg(hit) as y, cast(count(*) as double) as w, time / 60 as x1, cast(rank as double) as x2, 0.0 as off from (
      select d.*, t.time, case when t.time = cast(ceil(dur) as bigint) and confirmed = 1 then 1.0 else 0.0 end as hit
      from (select *, least(cast(ceil(dur) as bigint), cast(ceil(dur_follow) as bigint)) as last from durations where dur > 0) d,
        lateral (select unnest(range(1, last + 1)) as time) t) group by time, rank"""


@query("V3 M1", GLM(HAZARD, 3, "cloglog", "mu * (1 - mu)", "-5") + COEFS("time", "rank_c", "(Intercept)"))
def hazard_glm(spark, sf):
    """Grouped-time proportional hazards: complementary log-log link."""
    fit = rg.fit_glm(_hazard_rows(spark, sf), "p ~ time + rank_c", "binomial", "cloglog", weight="n", many=True)
    return _coefs(spark, fit)


POLY = f"""select y, w, x2 as x3, off, sqrt(n) * c / sqrt(s2) as x1, sqrt(n) * ((c - s3 / s2) * c - s2 / n) / sqrt(s4 - s3 * s3 / s2 - s2 * s2 / n) as x2
    from (select *, count(*) over () as n, sum(c * c) over () as s2, sum(c ** 3) over () as s3, sum(c ** 4) over () as s4
          from (select *, x1 - avg(x1) over () as c from ({HAZARD})))"""


@query("V4 F11", GLM(POLY, 4, "logit", "mu * (1 - mu)", "-5") + COEFS("t1", "t2", "rank_c", "(Intercept)"))
def hazard_logit(spark, sf):
    """Discrete-time logistic model with orthogonal polynomial time (columns of mean square 1)."""
    cells = cut_lineage(_hazard_rows(spark, sf))
    root = float(cells.count()) ** 0.5
    rows = fr.poly_columns(cells, "time", 2, "t").withColumns({c: F.col(c) * root for c in ("t1", "t2")})
    return _coefs(spark, rg.fit_glm(rows, "p ~ t1 + t2 + rank_c", "binomial", "logit", weight="n", many=True))


COX = """, cd as (select dur as t, confirmed as d, rank / 100.0 as x1, case when period % 2 = 1 then 1.0 else 0.0 end as x2 from durations
      where dur is not null and confirmed is not null and rank is not null and period is not null),
    recursive cb as (select 0 as step, cast(0 as double) as b1, cast(0 as double) as b2, cast(0 as double) as i11, cast(0 as double) as i12, cast(0 as double) as i22
      union all select step + 1, b1 + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), b2 + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12), h11, h12, h22 from (
        select step, b1, b2, sum(v1 - s1) as g1, sum(v2 - s2) as g2, sum(s11) as h11, sum(s12) as h12, sum(s22) as h22 from (
          select step, b1, b2, t, max(v1) as v1, max(v2) as v2, sum(m1) as s1, sum(m2) as s2,
            sum(m11 - m1 * m1) as s11, sum(m12 - m1 * m2) as s12, sum(m22 - m2 * m2) as s22 from (
            select step, b1, b2, t, v1, v2, (r1 - f * d1) / (r0 - f * d0) as m1, (r2 - f * d2) / (r0 - f * d0) as m2,
              (r11 - f * d11) / (r0 - f * d0) as m11, (r12 - f * d12) / (r0 - f * d0) as m12, (r22 - f * d22) / (r0 - f * d0) as m22 from (
              select *, unnest(range(0, n)) / n as f from (
                select step, b1, b2, t, n, v1, v2, d0, d1, d2, d11, d12, d22, sum(s0) over w as r0, sum(s1) over w as r1, sum(s2) over w as r2,
                  sum(s11) over w as r11, sum(s12) over w as r12, sum(s22) over w as r22 from (
                  select step, b1, b2, t, cast(sum(d) as bigint) as n, sum(d * x1) as v1, sum(d * x2) as v2,
                    sum(e) as s0, sum(e * x1) as s1, sum(e * x2) as s2, sum(e * x1 * x1) as s11, sum(e * x1 * x2) as s12, sum(e * x2 * x2) as s22,
                    sum(d * e) as d0, sum(d * e * x1) as d1, sum(d * e * x2) as d2, sum(d * e * x1 * x1) as d11, sum(d * e * x1 * x2) as d12, sum(d * e * x2 * x2) as d22
                  from (select *, exp(b1 * x1 + b2 * x2) as e from cb, cd where step < 12) group by step, b1, b2, t)
                window w as (partition by step order by t desc)) where n > 0)) group by step, b1, b2, t) group by step, b1, b2)),
    cf as (select *, i11 * i22 - i12 * i12 as det from cb where step = 12)"""


@query("V3", COX + f""" select 'rank100' as term, {R('b1')} as estimate, {R('sqrt(i22 / det)')} as se from cf
    union all select 'season', {R('b2')}, {R('sqrt(i11 / det)')} from cf""")
def cox(spark, sf):
    """Proportional hazards of being found, by partial likelihood with tied minutes."""
    rows = b.durations(spark, sf).select("dur", "confirmed", (F.col("rank") / 100).alias("rank100"),
                                         F.pmod("period", F.lit(2)).cast("double").alias("season"))
    fit = lk.fit_cox(rows, "dur", "confirmed", ["rank100", "season"])
    return rg.coef_table(spark, fit).select("term", "estimate", "se")


# Dyads -------------------------------------------------------------------

def _sri(spark, sf):
    """Association index inside troops of at most ``TROOP`` members."""
    lo = b.span(spark, sf).getField("lo")
    p = b.presence(spark, sf).withColumn("troop", F.floor(F.col("entity") / b.TROOP))
    return pr.association_index(p, "entity", F.datediff("day", lo), ["troop"])


@query("N1 N2", f"select troop, a, b, cast(together as bigint) as together, cast(denom as bigint) as denom, {R('together / denom')} as sri from troop_sri where denom > 0")
def sri_presence(spark, sf):
    return _sri(spark, sf).filter(F.col("denom") > 0)


@query("N3", f""", d as (select t.entity, t.day, 1 - t.present as gone from presence t join presence q on q.entity = t.entity and q.day = t.day - 1 where q.present = 1),
    x as (select a.entity // 50 as troop, a.entity as a, b.entity as b, count(*) as days_both, sum(a.gone * b.gone) as together, sum(greatest(a.gone, b.gone)) as denom
      from d a join d b on b.day = a.day and b.entity // 50 = a.entity // 50 and b.entity > a.entity group by 1, 2, 3)
    select troop, a, b, days_both, cast(together as bigint) as together, cast(denom as bigint) as denom, {R('case when denom > 0 then together / denom end')} as sri from x""")
def sri_departure(spark, sf):
    """How often two members left on the same day, given both were at risk."""
    lo = b.span(spark, sf).getField("lo")
    p = cal.prev_day(b.presence(spark, sf), ["entity"], "day", ["present"])
    flags = p.select("entity", "day", F.floor(F.col("entity") / b.TROOP).alias("troop"),
                     F.when(F.col("present_pre") == 1, 1 - F.col("present")).alias("left"))
    return pr.co_event_index(flags, "entity", F.datediff("day", lo), ["troop"], "left")


KINU = "(select least(entity, entity2) as a, greatest(entity, entity2) as b, max(kin) as kin from kin group by 1, 2)"


def _pair_frame(spark, sf):
    nodes = b.users(spark, sf).select("entity", (F.col("entity") % 15).alias("age"), (F.col("entity") + 1).alias("rank"))
    return pr.pair_attributes(_sri(spark, sf), nodes, "entity", ["age", "rank"], b.kin(spark, sf), "kin", 0.0)


@query("N4", f"""select s.a, s.b, abs(s.a % 15 - s.b % 15) as diff_age, abs(s.a - s.b) as diff_rank, {R('coalesce(k.kin, 0)')} as kin
    from troop_sri s left join {KINU} k on k.a = s.a and k.b = s.b""")
def pair_attr(spark, sf):
    return _pair_frame(spark, sf).select("a", "b", "diff_age", "diff_rank", "kin")


@query("N5", f""", e as (select s.a, s.b, abs(s.a - s.b) as diff_rank, coalesce(k.kin, 0) as kin from troop_sri s left join {KINU} k on k.a = s.a and k.b = s.b),
    f as (select * from e union all select b, a, diff_rank, kin from e),
    z as (select avg(diff_rank) as m1, stddev_samp(diff_rank) as s1, avg(kin) as m2, stddev_samp(kin) as s2 from f)
    select a, b, {R('(diff_rank - m1) / s1')} as diff_rank_std, {R('(kin - m2) / s2')} as kin_std from e, z""")
def pair_std(spark, sf):
    return pr.standardize_pairs(_pair_frame(spark, sf), ["diff_rank", "kin"]).select("a", "b", "diff_rank_std", "kin_std")


@query("N6 P11", f"""select abs(a % 15 - b % 15) as diff_age, count(*) as n_pairs, {R('avg(together / denom)')} as mean_sri from troop_sri where denom > 0 group by 1""")
def index_by_diff(spark, sf):
    return _pair_frame(spark, sf).filter(F.col("denom") > 0).groupBy("diff_age").agg(
        F.count(F.lit(1)).alias("n_pairs"), F.avg("sri").alias("mean_sri"))


@query("N7", f""", d as (select period, a, b, sum(case when kind = 'R' then minutes else 0.0 end) as groom, sum(case when kind = 'A' then minutes else 0.0 end) as near
      from bouts where kind in ('R', 'A') group by 1, 2, 3), m as (select period, avg(groom) as mg, avg(near) as mn from d group by period)
    select d.period, a, b, {R('groom')} as groom, {R('near')} as near, {R('(groom / mg + near / mn) / 2')} as csi from d join m on m.period = d.period""")
def csi(spark, sf):
    return pr.sociality_index(b.bouts(spark, sf), ["period"], F.col("kind") == "R", F.col("kind") == "A")


@query("N8", f""", e as (select s.together / s.denom as y, cast(s.denom as double) as w, 0.0 as off, cast(coalesce(k.kin, 0) as double) as x1, cast(abs(s.a - s.b) as double) as x2
      from troop_sri s left join {KINU} k on k.a = s.a and k.b = s.b where s.denom > 0)
    {GLM('select * from e', 3, 'identity', '1.0', '0', steps=3)} select 'kin' as predictor, {R('b1')} as coef, {R('b1 / sqrt(v11)')} as t_obs from fitv
    union all select 'diff_rank', {R('b2')}, {R('b2 / sqrt(v22)')} from fitv""")
def edge_regression(spark, sf):
    """The fit behind the permutation test."""
    return nw.edge_regression(_pair_frame(spark, sf).filter(F.col("denom") > 0), "sri", ["kin", "diff_rank"], "denom")


PERMS = 999
EDGES = f"""select s.troop, s.a, s.b, s.together / s.denom as y, cast(s.denom as double) as w, cast(coalesce(k.kin, 0) as double) as x1, cast(abs(s.a - s.b) as double) as x2
      from troop_sri s left join {KINU} k on k.a = s.a and k.b = s.b where s.denom > 0"""
MOVED = f""", e as ({EDGES}), m as (select sum(w * x1) / sum(w) as m1, sum(w * x2) / sum(w) as m2 from e),
    c as (select sum(w * (x1 - m1) * (x2 - m2)) / sum(w * (x2 - m2) ** 2) as c1, sum(w * (x1 - m1) * (x2 - m2)) / sum(w * (x1 - m1) ** 2) as c2 from e, m),
    src as (select troop, a, b, y as yp, w as wp, x1 - m1 - c1 * (x2 - m2) as e1, x2 - m2 - c2 * (x1 - m1) as e2 from e, m, c),
    nodes as (select distinct troop, unnest([a, b]) as node from e),
    spread as (select troop, node, perm, row_number() over (partition by troop, perm order by md5('7:' || perm || ':' || node)) as place
      from nodes, (select unnest(range(0, {PERMS + 1})) as perm)),
    image as (select s.troop, s.perm, s.node, f.node as image from spread s join spread f on f.troop = s.troop and f.place = s.place and f.perm = 0 where s.perm > 0),
    moved as (select i.perm, e.y, e.w, e.x1, e.x2, src.yp, src.wp, src.e1, src.e2 from e join image i on i.troop = e.troop and i.node = e.a
      join image j on j.troop = e.troop and j.perm = i.perm and j.node = e.b
      join src on src.troop = e.troop and src.a = least(i.image, j.image) and src.b = greatest(i.image, j.image))"""
PERMUTED = """select 0 as perm, 0 as model, y, w, x1, x2 from e union all select perm, 0, yp, wp, x1, x2 from moved
    union all select perm, 1, y, w, e1, x2 from moved union all select perm, 2, y, w, x1, e2 from moved"""


@query("N8", MOVED + LOGITS(PERMUTED, "perm, model", 3, steps=12) + f""", o as (select * from fits where perm = 0),
    q as (select f.model, case f.model when 0 then f.z0 when 1 then f.z1 else f.z2 end as z, case f.model when 0 then o.z0 when 1 then o.z1 else o.z2 end as z_obs,
      case f.model when 0 then o.b0 when 1 then o.b1 else o.b2 end as coef from fits f, o where f.perm > 0)
    select case model when 0 then '(Intercept)' when 1 then 'kin' else 'diff_rank' end as predictor, {R('coef')} as coef, {R('z_obs')} as z_obs, count(*) as n_perm,
      {R('avg(case when abs(z) >= abs(z_obs) then 1.0 else 0.0 end)')} as p_value from q group by model, coef, z_obs""")
def qap(spark, sf):
    """Association counts on kinship and rank distance, permuted within troops."""
    rows = _pair_frame(spark, sf).filter(F.col("denom") > 0)
    return nw.permutation_regression(rows, "sri", ["kin", "diff_rank"], ["troop"], PERMS, 7, "denom")


LINEAR_FITS = f""", g as (select perm, model, sum(w) as n0, sum(w * x1) as n1, sum(w * x2) as n2, sum(w * x1 * x1) as n11, sum(w * x1 * x2) as n12, sum(w * x2 * x2) as n22,
      sum(w * y) as y0, sum(w * x1 * y) as y1, sum(w * x2 * y) as y2, sum(w * y * y) as yy, count(*) as n from ({PERMUTED}) group by 1, 2),
    s as (select *, n11 - n1 * n1 / n0 as a11, n12 - n1 * n2 / n0 as a12, n22 - n2 * n2 / n0 as a22, y1 - n1 * y0 / n0 as c1, y2 - n2 * y0 / n0 as c2, yy - y0 * y0 / n0 as cc from g),
    r as (select *, a11 * a22 - a12 * a12 as det from s), f as (select *, (a22 * c1 - a12 * c2) / det as b1, (a11 * c2 - a12 * c1) / det as b2 from r),
    v as (select *, (cc - b1 * c1 - b2 * c2) / (n - 3) as s2 from f), t as (select *, b1 / sqrt(s2 * a22 / det) as t1, b2 / sqrt(s2 * a11 / det) as t2 from v)"""


@query("N8", MOVED + LINEAR_FITS + f""", o as (select * from t where perm = 0)
    select 'kin' as predictor, {R('max(o.b1)')} as coef, {R('max(o.t1)')} as t_obs, count(*) as n_perm, {R('avg(case when abs(t.t1) >= abs(o.t1) then 1.0 else 0.0 end)')} as p_value
      from t, o where t.perm > 0 and t.model = 1
    union all select 'diff_rank', {R('max(o.b2)')}, {R('max(o.t2)')}, count(*), {R('avg(case when abs(t.t2) >= abs(o.t2) then 1.0 else 0.0 end)')}
      from t, o where t.perm > 0 and t.model = 2""")
def qap_linear(spark, sf):
    """The same with a weighted linear fit."""
    return nw.qap(_pair_frame(spark, sf).filter(F.col("denom") > 0), "sri", ["kin", "diff_rank"], ["troop"], PERMS, 7, "denom")


ARCS = ", arcs as (select a as src, b as dst, w from graph union all select b, a, w from graph)"


@query("N9", f"""{ARCS}, deg as (select src, sum(w) as d from arcs group by src), loops as (select * from arcs union all
      select src, src, (select sum(d * d) / sum(d) from deg) from deg),
    recursive v as (select src as node, cast(1 as double) as v, 0 as step from (select distinct src from arcs)
      union all select dst, s / max(s) over (), step from (select l.dst, sum(l.w * v.v) as s, v.step + 1 as step
        from loops l join v on v.node = l.src where v.step < 200 group by l.dst, v.step))
    select node, {R('v')} as centrality from v where step = 200""")
def eigen_centrality(spark, sf):
    return nw.eigen_centrality(b.graph(spark, sf))


@query("N10", f""", l as (select a, b, w, a % 5 as la, b % 5 as lb from graph), s as (select la as x, lb as y, w from l union all select lb, la, w from l),
    c as (select x, sum(w) as degree, sum(case when x = y then w else 0 end) as inside from s group by x)
    select count(*) as n_labels, {R('sum(inside) / sum(degree) - sum(degree * degree) / (sum(degree) * sum(degree))')} as q from c""")
def modularity(spark, sf):
    g = cut_lineage(b.graph(spark, sf))
    labels = g.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node") % 5)
    return nw.modularity(g, labels)


TURN = "node % 2 = step % 2"


@query("N10", f"""{ARCS}, own as (select src as node, avg(w) as w from arcs group by src),
    recursive l as (select node, node as label, 0 as step from own union all select node, label, step + 1 from (
      select node, label, step from l where step < 120 and not {TURN} union all
      select node, label, step from (select node, label, step, row_number() over (partition by node order by w desc, label) as place from (
        select node, label, step, sum(w) as w from (
          select a.dst as node, l.label, l.step, a.w from arcs a join l on l.node = a.src where l.step < 120
          union all select l.node, l.label, l.step, o.w from l join own o on o.node = l.node where l.step < 120) where {TURN} group by 1, 2, 3)) where place = 1))
    select node, label from l where step = 120""")
def label_propagation(spark, sf):
    return nw.label_propagation(b.graph(spark, sf), F.pmod("node", F.lit(2)), phase=120)


@query("N10", f"""{ARCS} select count(distinct src) as n_nodes, 0 as raising, 1 as above_propagation, 1 as named_by_least from arcs""")
def communities(spark, sf):
    """Modularity search: all nodes labelled, no single move that raises it, not below label propagation."""
    g = cut_lineage(b.graph(spark, sf))
    labels = cut_lineage(nw.communities(g))
    found, other = (nw.modularity(g, x).first() for x in (labels, nw.label_propagation(g)))
    names = labels.groupBy("label").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n"))
    return names.agg(F.sum("n").alias("n_nodes"), F.lit(nw.raising_moves(g, labels).count()).alias("raising"),
                     F.lit(int(found.q >= other.q - 1e-12)).alias("above_propagation"),
                     F.min((F.col("label") == F.col("least")).cast("int")).alias("named_by_least"))


# Draws -------------------------------------------------------------------

@query("B1 B2 A5", f""", m as (select variable, median(value) as med from draws group by 1)
    select d.variable, {R('avg(value)')} as mean, {R('stddev_samp(value)')} as sd, {R('quantile_cont(value, 0.025)')} as q2_5, {R('quantile_cont(value, 0.05)')} as q5,
      {R('median(value)')} as median, {R('quantile_cont(value, 0.95)')} as q95, {R('quantile_cont(value, 0.975)')} as q97_5, {R('1.4826 * median(abs(value - med))')} as mad
    from draws d join m on m.variable = d.variable group by 1""")
def draws_summary(spark, sf):
    wide = b.draws_wide(spark, sf)
    return dr.summarize_draws(dr.draws_to_long(wide, [c for c in wide.columns if c.startswith("p[")]))


DIFFS = """, x as (select p.variable as level1, q.variable as level2, p.value - q.value as value from draws p join draws q
    on q.chain = p.chain and q.iteration = p.iteration and p.variable < q.variable)"""


@query("B3", f"""{DIFFS} select level1, level2, {R('avg(value)')} as mean, {R('quantile_cont(value, 0.025)')} as lo, {R('quantile_cont(value, 0.975)')} as hi from x group by 1, 2""")
def contrasts(spark, sf):
    return dr.pairwise_contrasts(b.draws(spark, sf))


@query("B4", f""", c as (select variable, chain, count(*) as n from draws group by 1, 2), n as (select variable, min(n) // 2 as h from c group by 1),
    s as (select d.variable, n.h, chain, (iteration - 1) // n.h as half, avg(value) as m, var_samp(value) as v from draws d join n on n.variable = d.variable
      where iteration <= 2 * n.h group by 1, 2, 3, 4)
    select variable, {R('sqrt(((h - 1) / h * avg(v) + var_samp(m)) / avg(v))')} as rhat from s group by variable, h""")
def rhat(spark, sf):
    return dr.rhat(b.draws(spark, sf), shortest=True)


def ESS(src: str) -> str:
    """The table ``essv``: effective sample sizes of the chains of ``src``, over all lags."""
    return f""", l as (select variable, chain, count(*) as n from {src} group by 1, 2), s as (select variable, min(n) as n from l group by 1),
    x as (select d.variable, d.chain, d.iteration, s.n, d.value - avg(d.value) over (partition by d.variable, d.chain) as d, d.value
      from {src} d join s on s.variable = d.variable where d.iteration <= s.n),
    m as (select variable, var_samp(m) as between_v, count(*) as chains from (select variable, chain, avg(value) as m from x group by 1, 2) group by 1),
    c as (select x.variable, x.chain, x.n, k.lag, sum(x.d * y.d) / x.n as c from x join (select unnest(range(0, (select max(n) from s))) as lag) k on k.lag < x.n
      join x y on y.variable = x.variable and y.chain = x.chain and y.iteration = x.iteration - k.lag group by 1, 2, 3, 4),
    a as (select variable, n, lag, avg(c) as c from c group by 1, 2, 3),
    w as (select a.variable, a.n, m.chains, a.c as c0, a.c * a.n / (a.n - 1) as within_v, a.c + m.between_v as plus from a join m on m.variable = a.variable where lag = 0),
    rho as (select a.variable, a.lag, case when a.lag = 0 then 1 else 1 - (w.within_v - a.c * a.n / (a.n - 1)) / w.plus end as rho from a join w on w.variable = a.variable),
    p as (select variable, lag // 2 as t, sum(rho) as p from rho group by 1, 2 having count(*) = 2),
    g as (select *, min(case when p > 0 then 1 else 0 end) over (partition by variable order by t) as go from p),
    essv as (select g.variable, max(w.n * w.chains) / (2 * sum(case when go = 1 then p else 0 end) - 1) as ess
      from g join w on w.variable = g.variable group by 1)"""


ESS_ROWS = f" select variable, {R('ess')} as ess from essv"


@query("B4", ESS("draws") + ESS_ROWS)
def ess(spark, sf):
    return dr.ess(b.draws(spark, sf), shortest=True)


def _poly(coefs: list[float], x: str) -> str:
    out = repr(coefs[0])
    for c in coefs[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _probit(p: str) -> str:
    """The normal quantile of the SQL expression ``p``."""
    q, t = f"({p} - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    mid = f"{_poly(QUANTILE_MID[0], f'({q} * {q})')} * {q} / {_poly(QUANTILE_MID[1], f'({q} * {q})')}"
    tail = f"{_poly(QUANTILE_TAIL[0], t)} / {_poly(QUANTILE_TAIL[1], t)}"
    return f"case when {p} < {QUANTILE_CUT} then {tail} when {p} > 1 - {QUANTILE_CUT} then -({tail}) else {mid} end"


HALVES = """, ln as (select variable, min(n) as n, min(n) // 2 as h from (select variable, chain, count(*) as n from draws group by 1, 2) group by 1),
    halves as (select d.variable, 2 * d.chain + case when d.iteration > ln.n - ln.h then 1 else 0 end as chain,
        case when d.iteration > ln.n - ln.h then d.iteration - (ln.n - ln.h) else d.iteration end as iteration, d.value
      from draws d join ln on ln.variable = d.variable where d.iteration <= ln.h or d.iteration > ln.n - ln.h)"""


def RANKED(src: str, to: str) -> str:
    """``src`` with values replaced by the normal quantiles of their mean ranks."""
    p = "((r - 0.375) / (s + 0.25))"
    return f""", {to} as (select variable, chain, iteration, {_probit(p)} as value from (select *,
      rank() over (partition by variable order by value) + (count(*) over (partition by variable, value) - 1) / 2.0 as r,
      count(*) over (partition by variable) as s from {src}))"""


@query("B4", f"""{HALVES}, folded as (select variable, chain, iteration, abs(value - median(value) over (partition by variable)) as value from halves)
    {RANKED('halves', 'z1')}{RANKED('folded', 'z2')},
    c as (select 1 as k, variable, chain, avg(value) as m, var_samp(value) as v, count(*) as n from z1 group by all
      union all select 2, variable, chain, avg(value), var_samp(value), count(*) from z2 group by all),
    r as (select variable, k, sqrt(((min(n) - 1) / min(n) * avg(v) + var_samp(m)) / avg(v)) as rhat from c group by 1, 2)
    select variable, {R('max(rhat)')} as rhat from r group by 1""")
def rhat_rank(spark, sf):
    """Rank-normalised split R-hat."""
    return dr.rhat_rank(b.draws(spark, sf), shortest=True)


@query("B4", HALVES + RANKED("halves", "ranked") + ESS("ranked") + ESS_ROWS)
def ess_bulk(spark, sf):
    return dr.ess_bulk(b.draws(spark, sf), shortest=True)


@query("B4", f"""{HALVES}, qs as (select variable, quantile_cont(value, 0.05) as q1, quantile_cont(value, 0.95) as q2 from halves group by 1),
    sides as (select h.variable || '#' || k.k as variable, chain, iteration,
        case when value <= case when k.k = 1 then q1 else q2 end then 1.0 else 0.0 end as value
      from halves h join qs on qs.variable = h.variable cross join (select unnest([1, 2]) as k) k)
    {ESS('sides')} select split_part(variable, '#', 1) as variable, {R('min(ess)')} as ess from essv group by 1""")
def ess_tail(spark, sf):
    return dr.ess_tail(b.draws(spark, sf), shortest=True)


@query("B5 F12 H7", f"""select t.t, cast(t.day as varchar) as day, {R('median(d.value)')} as median, {R('quantile_cont(d.value, 0.025)')} as lo, {R('quantile_cont(d.value, 0.975)')} as hi
    from tday t left join draws d on d.i = t.t group by 1, 2""")
def index_posterior(spark, sf):
    return dr.index_posterior(b.draws(spark, sf), b.tday(spark, sf).select("t", "day"), "t")


@query("B6", f"""select t.period, {R('median(d.value)')} as median, {R('quantile_cont(d.value, 0.025)')} as lo, {R('quantile_cont(d.value, 0.975)')} as hi
    from tday t join draws d on d.i = t.t group by 1""")
def level_posterior(spark, sf):
    return dr.level_posterior(b.draws(spark, sf), b.tday(spark, sf), "t", "period")


@query("B7", f"""select variable, {R('greatest(avg(case when value > 0 then 1.0 else 0.0 end), avg(case when value < 0 then 1.0 else 0.0 end))')} as pd from draws group by 1""")
def prob_direction(spark, sf):
    return dr.direction(b.draws(spark, sf))


@query("B8", f""", c as (select variable, avg(value) as mean, quantile_cont(value, 0.025) as lo, quantile_cont(value, 0.975) as hi from draws group by 1)
    select case when variable < 'p[4' then 'base' else variable end as level1, case when variable < 'p[4' then variable else 'base' end as level2,
      {R("case when variable < 'p[4' then -mean else mean end")} as mean, {R("case when variable < 'p[4' then -hi else lo end")} as lo,
      {R("case when variable < 'p[4' then -lo else hi end")} as hi, case when lo * hi > 0 then '***' else 'n.s' end as mark from c""")
def signif_grid(spark, sf):
    """Contrasts turned to one orientation, with their significance mark."""
    from rollcall.operators.ranks import exact_quantiles

    d = b.draws(spark, sf)
    c = exact_quantiles(d, ["variable"], "value", {"lo": 0.025, "hi": 0.975}, extra={"mean": F.avg("value")})
    c = c.select(F.col("variable").alias("level1"), F.lit("base").alias("level2"), "mean", "lo", "hi")
    out = dr.orient(c, F.col("level1") < "p[4")
    return out.withColumn("mark", dr.significance(F.col("lo"), F.col("hi")))


def _probabilities(spark, sf):
    """Draws on the probability scale with the precision of the same draw, and the observed counts of the day."""
    from rollcall.functions.scalars import draw_index, inverse_logit

    wide = b.draws(spark, sf)
    precision = wide.filter("variable = 'p[64]'").select("chain", "iteration", (20 * F.exp("value")).alias("precision"))
    d = wide.select("chain", "iteration", draw_index(F.col("variable")).cast("bigint").alias("t"), inverse_logit(F.col("value")).alias("value"))
    obs = b.presence(spark, sf).groupBy("day").agg(F.sum("present").alias("y"), F.count(F.lit(1)).alias("size"))
    return d.join(precision, ["chain", "iteration"]), b.tday(spark, sf).join(obs, "day").select("t", "y", "size")


def UNIFORM(*keys: str) -> str:
    """The number in (0, 1) that md5 makes of the keys."""
    return f"((('0x' || substr(md5(concat_ws(':', {', '.join(keys)})), 1, 13))::bigint + 0.5) / 4503599627370496)"


SIMULATED = f""", obs as (select t.t, sum(p.present) as y, count(*) as size from tday t join presence p on p.day = t.day group by 1),
    it as (select chain, iteration from (select distinct chain, iteration from draws) order by md5('11:' || chain || ':' || iteration), chain, iteration limit 1000),
    ph as (select chain, iteration, 20 * exp(value) as phi from draws where variable = 'p[64]'),
    pr as (select obs.t, obs.size, d.chain, d.iteration, phi / (1 + exp(-d.value)) as a, phi - phi / (1 + exp(-d.value)) as b, {UNIFORM('11', 'obs.t', 'd.chain', 'd.iteration')} as u
      from draws d join it using (chain, iteration) join ph using (chain, iteration) join obs on obs.t = d.i),
    steps as (select *, unnest(range(0, size)) as k, list_sum(list_transform(range(0, size), lambda j: ln((b + j) / (a + b + j)))) as zero from pr),
    logs as (select *, zero + coalesce(sum(ln((size - k) * (a + k) / ((k + 1) * (b + size - k - 1)))) over (partition by t, chain, iteration order by k
      rows between unbounded preceding and 1 preceding), 0) as lp from steps),
    upto as (select *, sum(exp(lp)) over (partition by t, chain, iteration order by k rows unbounded preceding) as cdf from logs),
    sim as (select t, chain, iteration, count(*) filter (cdf < u) as y from upto group by 1, 2, 3)"""


@query("B9", SIMULATED + " select t, chain, iteration, y from sim")
def post_pred(spark, sf):
    """Beta-binomial counts of every day for every sampled draw, with the draw's own precision."""
    d, obs = _probabilities(spark, sf)
    return dr.simulate_counts(d, obs, "t", "size", "precision", n_draws=1000, seed=11)


@query("B10", SIMULATED + " select t, 'y_pred' as source, y from sim union all select t, 'y', cast(y as bigint) from obs")
def ppc_long(spark, sf):
    d, obs = _probabilities(spark, sf)
    return dr.predictive_long(dr.simulate_counts(d, obs, "t", "size", "precision", 1000, 11), obs, "t", "y")


@query("B11", f""", f as (select i as t, avg(value) as fitted from draws group by 1), o as (select p.day, avg(present) as share from presence p group by 1)
    select t.t, {R('o.share')} as share, {R('f.fitted')} as fitted, {R('o.share - f.fitted')} as resid from tday t join o on o.day = t.day left join f on f.t = t.t""")
def residuals(spark, sf):
    share = b.presence(spark, sf).groupBy("day").agg(F.avg("present").alias("share"))
    data = b.tday(spark, sf).join(share, "day").select(F.col("t").cast("int").alias("t"), "share")
    return dr.residuals(b.draws(spark, sf), data, "t", "share")


# Diagnostics -------------------------------------------------------------

CENTRED = ", v as (select entity, day, mean_value - avg(mean_value) over (partition by entity) as d from seen), c0 as (select entity, count(*) as n, sum(d * d) as ss from v group by 1)"
LAGGED = """, lg as (select x.entity, k.lag, sum(x.d * y.d) / (count(*) + k.lag) as c from v x cross join (values (1), (2), (3), (4), (5)) k(lag)
    join v y on y.entity = x.entity and y.day = x.day - k.lag group by 1, 2)"""


def _series(spark, sf):
    return b.seen(spark, sf).select("entity", "day", "mean_value")


@query("B12", f"""{CENTRED}{LAGGED} select c0.entity, k.lag, c0.n, {R('case when k.lag = 0 then c0.ss / c0.n else lg.c end / nullif(c0.ss / c0.n, 0)')} as acf
    from c0 cross join (values (0), (1), (2), (3), (4), (5)) k(lag) left join lg on lg.entity = c0.entity and lg.lag = k.lag""")
def acf(spark, sf):
    return dg.acf(_series(spark, sf), "day", "mean_value", ["entity"], 5).select("entity", "lag", "n", "acf")


PACF = f"""{CENTRED}{LAGGED}, r as (select c0.entity, max(case when lag = 1 then c end) * c0.n / c0.ss as r1, max(case when lag = 2 then c end) * c0.n / c0.ss as r2,
      max(case when lag = 3 then c end) * c0.n / c0.ss as r3, max(case when lag = 4 then c end) * c0.n / c0.ss as r4
      from c0 left join lg on lg.entity = c0.entity group by c0.entity, c0.n, c0.ss),
    s2 as (select *, r1 as a1, (r2 - r1 * r1) / (1 - r1 * r1) as b2 from r), s2b as (select *, a1 - b2 * a1 as b1 from s2),
    s3 as (select *, (r3 - b1 * r2 - b2 * r1) / (1 - b1 * r1 - b2 * r2) as c3 from s2b), s3b as (select *, b1 - c3 * b2 as c1, b2 - c3 * b1 as c2 from s3),
    s4 as (select *, (r4 - c1 * r3 - c2 * r2 - c3 * r1) / (1 - c1 * r1 - c2 * r2 - c3 * r3) as d4 from s3b)"""


@query("B13", f"""{PACF} select entity, k.lag, {R('case k.lag when 1 then a1 when 2 then b2 when 3 then c3 else d4 end')} as pacf
    from s4 cross join (values (1), (2), (3), (4)) k(lag)""")
def pacf(spark, sf):
    return dg.pacf(_series(spark, sf), "day", "mean_value", ["entity"], 4)


@query("B14", f"""{CENTRED}{LAGGED} select c0.entity, c0.n,
    {R('c0.n * (c0.n + 2) * sum(coalesce((lg.c * c0.n / c0.ss) * (lg.c * c0.n / c0.ss) / nullif(c0.n - lg.lag, 0), 0))')} as q
    from c0 left join lg on lg.entity = c0.entity group by c0.entity, c0.n, c0.ss""")
def ljung_box(spark, sf):
    return dg.ljung_box(_series(spark, sf), "day", "mean_value", ["entity"], 5).select("entity", "n", "q")


# The same published erfc fit, spelled out once more.
ERFC = """t * exp(-z * z - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807
    + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277)))))))))"""


@query("B14", f"""{CENTRED}{LAGGED}, q as (select c0.entity, c0.n * (c0.n + 2) *
      sum(coalesce((lg.c * c0.n / c0.ss) * (lg.c * c0.n / c0.ss) / nullif(c0.n - lg.lag, 0), 0)) as q
      from c0 left join lg on lg.entity = c0.entity and lg.lag <= 3 group by c0.entity, c0.n, c0.ss),
    e as (select *, sqrt(q / 2) as z, 1 / (1 + 0.5 * sqrt(q / 2)) as t from q)
    select entity, {R(f'{ERFC} + exp(-q / 2) * sqrt(q / 2) / (sqrt(pi()) / 2)')} as p_value from e""")
def ljung_box_p(spark, sf):
    """p-values of the statistic, per entity."""
    return dg.ljung_box(_series(spark, sf), "day", "mean_value", ["entity"], 3).select("entity", "p_value")


@query("B15", f"""{CENTRED}, s as (select *, d - lag(d) over (partition by entity order by day) as step from v)
    select entity, count(*) as n, {R('sum(step * step) / nullif(sum(d * d), 0)')} as dw from s group by 1""")
def durbin_watson(spark, sf):
    return dg.durbin_watson(_series(spark, sf), "day", "mean_value", ["entity"])


SPAN = "exp(pi() / 2 * sinh(g / 16.0))"
DW_P = f""", dwn as (select *, unnest(range(-64, 65)) as g from dws where n > 2 and dw is not null),
    dwt as (select *, pi() / 32 * cosh(g / 16.0) * sin(0.5 * list_sum(list_transform(range(1, n), lambda j: atan((2 - 2 * cos(pi() * j / n) - dw) * {SPAN}))))
      / exp(0.25 * list_sum(list_transform(range(1, n), lambda j: ln(1 + ((2 - 2 * cos(pi() * j / n) - dw) * {SPAN}) ** 2)))) as f from dwn),
    dwp as (select key, 0.5 - sum(f) / pi() as below from dwt group by key)"""
DW_ROWS = f"select d.key, d.n, {R('d.dw')} as dw, case when p.below is not null then {R('greatest(least(p.below, 1), 0)')} end as p_positive, case when p.below is not null then {R('least(1, 2 * least(greatest(least(p.below, 1), 0), 1 - greatest(least(p.below, 1), 0)))')} end as p_value from dws d left join dwp p using (key)"


@query("B15", f"""{CENTRED}, s as (select *, d - lag(d) over (partition by entity order by day) as step from v),
    dws as (select entity as key, count(*) as n, sum(step * step) / nullif(sum(d * d), 0) as dw from s group by 1){DW_P} {DW_ROWS}""")
def durbin_watson_p(spark, sf):
    """Serial correlation per entity: p-values of the exact distribution for the series' length."""
    return dg.durbin_watson_test(_series(spark, sf), "day", "mean_value", ["entity"]).withColumnRenamed("entity", "key")


@query("B15", f""", r as (select day, sum(mean_value - (select avg(mean_value) from seen)) as d0 from seen group by 1), v as (select day, d0 - avg(d0) over () as d from r),
    s as (select *, d - lag(d) over (order by day) as step from v),
    dws as (select 0 as key, count(*) as n, sum(step * step) / nullif(sum(d * d), 0) as dw from s){DW_P} {DW_ROWS}""")
def durbin_watson_daily(spark, sf):
    """The same of the residuals of all entities, regrouped by day."""
    rows = _series(spark, sf)
    mean = rows.agg(F.avg("mean_value").alias("m"))
    resid = rows.withColumn("resid", F.col("mean_value") - mean.scalar())
    out = dg.durbin_watson_test(dg.regrouped(resid, ["day"], "resid"), "day", "resid")
    return out.select(F.lit(0).cast("bigint").alias("key"), "n", "dw", "p_positive", "p_value")


@query("B16", SIMULATED + f""", sh as (select obs.t, avg(case when sim.y < obs.y then 1.0 else 0.0 end) as below, avg(case when sim.y = obs.y then 1.0 else 0.0 end) as tied
      from obs join sim on sim.t = obs.t group by 1)
    select t, {R('below')} as below, {R('tied')} as tied, {R(f"below + {UNIFORM('5', 't')} * tied")} as scaled from sh""")
def scaled_resid(spark, sf):
    d, obs = _probabilities(spark, sf)
    return dg.scaled_residuals(dr.simulate_counts(d, obs, "t", "size", "precision", 1000, 11), obs, ["t"], "y", 5)


@query("B10 B16", f""", o as (select t.t, sum(p.present) as y, count(*) as size from tday t join presence p on p.day = t.day group by 1),
    s as (select o.t, o.y, floor(o.size / (1 + exp(-d.value))) as sim from o join draws d on d.i = o.t)
    select t, {R('avg(case when sim < y then 1.0 else 0.0 end)')} as below, {R('avg(case when sim = y then 1.0 else 0.0 end)')} as tied from s group by 1""")
def expected_shares(spark, sf):
    """Shares below and tied when every draw predicts its expected whole count."""
    d, obs = _probabilities(spark, sf)
    sim = d.join(obs, "t").select("t", F.floor(F.col("value") * F.col("size")).alias("y"))
    return dg.scaled_residuals(sim, obs, ["t"], "y", 5).select("t", "below", "tied")


@query("B17", f""", c as (select corr(l_quantity, l_extendedprice) as a, corr(l_quantity, l_discount) as b, corr(l_extendedprice, l_discount) as c from lineitem),
    d as (select *, 1 + 2 * a * b * c - a * a - b * b - c * c as det from c)
    select 'l_quantity' as variable, {R('(1 - c * c) / det')} as vif from d union all select 'l_extendedprice', {R('(1 - b * b) / det')} from d
    union all select 'l_discount', {R('(1 - a * a) / det')} from d""")
def vif(spark, sf):
    return dg.vif(b.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


# Regression --------------------------------------------------------------

def _items(spark, sf):
    t = b.table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    t = t.select("l_suppkey", F.to_date("l_shipdate").alias("shipped"), (F.col("l_returnflag") == "R").cast("double").alias("y"), F.col("l_quantity").alias("qty"),
                 F.col("l_extendedprice").alias("price"), (F.col("l_discount") * 100).alias("disc"), (F.col("l_tax") * 100).alias("tax"),
                 F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag"))
    return fr.standardize(t, ["qty", "price", "disc", "tax"])[0]


ITEMS = """select case when l_returnflag = 'R' then 1.0 else 0.0 end as y, 1.0 as w, 0.0 as off, l_suppkey as cl, cast(l_shipdate as date) as cl2,
    (l_discount - avg(l_discount) over ()) / stddev_samp(l_discount) over () as x1, (l_tax - avg(l_tax) over ()) / stddev_samp(l_tax) over () as x2,
    (l_discount - avg(l_discount) over ()) / stddev_samp(l_discount) over () * (l_tax - avg(l_tax) over ()) / stddev_samp(l_tax) over () as x3,
    case when l_linestatus = 'O' then 1.0 else 0.0 end as x4 from lineitem"""


@query("M1 T9", GLM(ITEMS, 5, "logit", "mu * (1 - mu)", "-0.5", cluster=True, crossed=True)
       + COEFS("disc_std", "tax_std", "disc_std:tax_std", "status_O", "(Intercept)"))
def glm_bernoulli(spark, sf):
    """Bernoulli model with an interaction; errors over supplier and ship date, which cross."""
    fit = rg.fit_glm(_items(spark, sf), "y ~ disc_std + tax_std + disc_std:tax_std + status", "binomial", "logit", cluster=["l_suppkey", "shipped"])
    return _coefs(spark, fit)


@query("M1", GLM(ITEMS.replace("as x3", "as x9").replace("as x4", "as x3"), 4, "logit", "mu * (1 - mu)", "-0.5", cluster=True)
       + COEFS("disc_std", "tax_std", "status_O", "(Intercept)"))
def glm_clustered(spark, sf):
    """Standard errors clustered by supplier alone."""
    return _coefs(spark, rg.fit_glm(_items(spark, sf), "y ~ disc_std + tax_std + status", "binomial", "logit", cluster="l_suppkey"))


def _trials(spark, sf):
    """Attendance counts per entity and period: proportion and trials."""
    p = b.presence(spark, sf).withColumns({"age": (F.col("entity") % 15).cast("double"),
                                           "season": season(b.period_label())})
    return rg.fold_patterns(p.withColumnRenamed("present", "prop"), "prop", ["entity", "period", "season", "age"], "trials")


TRIALS = """select avg(present) as y, cast(count(*) as double) as w, cast(entity % 15 as double) as x1, case when period % 2 = 1 then 1.0 else 0.0 end as x2,
    0.0 as off from presence group by entity, period"""


@query("M2", GLM(TRIALS, 3, "logit", "mu * (1 - mu)", "0", scaled=True) + COEFS("age", "season_nonmating", "(Intercept)"))
def glm_binomial(spark, sf):
    """Counts out of trials; standard errors scaled by the Pearson dispersion."""
    fit = rg.fit_glm(_trials(spark, sf), "prop ~ age + season", "binomial", "logit", weight="trials", overdispersed=True)
    return _coefs(spark, fit)


def _sum_over(a: str, n: str, power: str = "") -> str:
    """Sum of 1 / (a + j)^power over j below n, term by term."""
    return f"coalesce(list_sum(list_transform(range(0, cast({n} as bigint)), lambda j: 1 / ({a} + j){power})), 0)"


@query("M2")
def glm_betabinomial(spark, sf):
    """Entities in a group out of the day's roster, with a share that varies from day to day.

    No SQL: Newton steps from a plain start need the guards of ``likelihood.newton``, which a recursive query has not.
    """
    rows = b.sizes(spark, sf).select("n_entity", "max_entity", (F.col("dur") / 60).alias("hours"), season(F.col("code")).alias("season"))
    fit, phi = lk.fit_beta_binomial(rows, "n_entity ~ hours + season", "max_entity")
    return _coefs(spark, fit).withColumn("phi", F.lit(phi))


def _counts(spark, sf):
    """Whole units of daily value per present entity, with log hours of observation."""
    units = b.seen(spark, sf).select("entity", "day", F.floor(F.round(F.col("mean_value") * F.col("n_ev"), 4)).cast("double").alias("n_units"))
    rows = b.panel(spark, sf).filter(F.col("presence") == 1).join(units, ["entity", "day"])
    return rows.select("entity", "n_units", F.col("age").cast("double").alias("age"),
                       season(F.col("code")).alias("season"), F.log(F.col("dur") / 60.0).alias("log_hours"))


UNITS = """select floor(round(s.mean_value * s.n_ev, 4)) as y, 1.0 as w, cast(p.age as double) as x1, case when p.code like 'nm%' then 1.0 else 0.0 end as x2,
    ln(p.dur / 60) as off, p.entity as cl from panel p join seen s on s.entity = p.entity and s.day = p.day where p.presence = 1"""


NEGBIN = {
    "_r1": _sum_over("k", "y"), "_r2": _sum_over("k", "y", " ** 2"), "_k": "_r1 + th + 1 - ln(k + mu) - (k + y) / (k + mu)",
    "s": "k * (y - mu) / (k + mu)", "t": "k * _k", "ss": "-k * mu * (k + y) / (k + mu) ** 2", "st": "k * (y - mu) * mu / (k + mu) ** 2",
    "tt": "k * _k + k * k * (-_r2 + 1 / k - 1 / (k + mu) - (mu - y) / (k + mu) ** 2)"}


@query("M3", SHAPED(UNITS, 3, "exp(eta)", NEGBIN, ("1", "0"))
       + GLM("select * from pd", 3, "log", "(mu + al * mu * mu)", "1", cluster=True, overdispersed=True,
             given="select 0 as step, b0, b1, b2, exp(-th) as al from lastp") + f""", co as (
    {COEFS('age', 'season_nonmating', '(Intercept)')}) select co.*, {R('al')} as alpha from co, fitv""")
def glm_negbin(spark, sf):
    """Overdispersed counts with an offset, errors clustered by entity."""
    fit, alpha = lk.fit_negbin_likelihood(_counts(spark, sf), "n_units ~ age + season", "log_hours", cluster="entity")
    return _coefs(spark, fit).withColumn("alpha", F.lit(alpha))


TOTALS = """select mean_value * n_ev as y, 1.0 as w, cast(entity % 15 as double) as x1, cast(bought as double) as x2, ln(cast(n_ev as double)) as off
    from seen where mean_value * n_ev > 0"""


@query("M4", GLM(TOTALS, 3, "log", "mu * mu", "ln((select avg(mean_value) from seen))") + COEFS("age", "bought", "(Intercept)"))
def glm_gamma(spark, sf):
    """Gamma model of positive daily values with a log offset."""
    rows = b.seen(spark, sf).select((F.col("mean_value") * F.col("n_ev")).alias("total"), F.log(F.col("n_ev").cast("double")).alias("log_n"),
                                    (F.col("entity") % 15).cast("double").alias("age"), F.col("bought").cast("double").alias("bought"))
    return _coefs(spark, rg.fit_glm(rows.filter(F.col("total") > 0), "total ~ age + bought", "gamma", "log", offset="log_n"))


@query("M5 J8 W7", f""", s as (select avg(l_quantity) as m1, stddev_samp(l_quantity) as s1, min(l_quantity) as lo, max(l_quantity) as hi, avg(l_tax) as m2 from lineitem)
    select f.l_returnflag, q.l_quantity, {R('(q.l_quantity - m1) / s1')} as l_quantity_std, {R('m2')} as l_tax
    from s cross join (select distinct l_returnflag from lineitem) f, lateral (select unnest(range(cast(lo as bigint), cast(hi as bigint) + 1)) as l_quantity) q""")
def pred_grid(spark, sf):
    """Levels x observed range of a covariate, another at its mean."""
    t = b.table(spark, sf, "lineitem")
    stats = fr.frame_stats(t, ["l_quantity", "l_tax"])
    lim = t.select(F.struct(F.min("l_quantity").cast("bigint").alias("lo"), F.max("l_quantity").cast("bigint").alias("hi"))).scalar()
    out = fr.prediction_grid(t.select("l_returnflag").distinct(), {"l_quantity": F.sequence(lim.getField("lo"), lim.getField("hi"))},
                             stats, ["l_quantity"], ["l_tax"])
    return out.select("l_returnflag", "l_quantity", "l_quantity_std", "l_tax")


def _fit_and_grid(spark, sf):
    """A model and a grid over its covariates, with the frame's statistics."""
    t = b.table(spark, sf, "lineitem").select((F.col("l_returnflag") == "R").cast("double").alias("y"), F.col("l_quantity").alias("qty"),
                                              F.col("l_linestatus").alias("status"))
    rows, stats = fr.standardize(t, ["qty"])
    fit = rg.fit_glm(rows, "y ~ qty_std + status + qty_std:status", "binomial", "logit")
    frame = fr.prediction_grid(t.select("status").distinct(),
                               {"qty": F.array(*[F.lit(float(v)) for v in range(5, 51, 5)])}, stats, ["qty"])
    return fit, frame, stats


CURVE = """select case when l_returnflag = 'R' then 1.0 else 0.0 end as y, 1.0 as w, 0.0 as off, (l_quantity - m) / sd as x1, st as x2, (l_quantity - m) / sd * st as x3
    from (select *, case when l_linestatus = 'O' then 1.0 else 0.0 end as st from lineitem, (select avg(l_quantity) as m, stddev_samp(l_quantity) as sd from lineitem))"""
POINTS = f"""{GLM(CURVE, 4, 'logit', 'mu * (1 - mu)', '-0.5')},
    pts as (select s.l_linestatus as status, q.qty * 5.0 as qty, (q.qty * 5 - z.m) / z.sd as x, case when s.l_linestatus = 'O' then 1.0 else 0.0 end as st
      from (select distinct l_linestatus from lineitem) s, (select unnest(range(1, 11)) as qty) q, (select avg(l_quantity) as m, stddev_samp(l_quantity) as sd from lineitem) z)"""
ETA, SE = LINEAR(["1", "x", "st", "x * st"])
ETA2, _SE2 = LINEAR(["1", "(x + 1e-3)", "st", "(x + 1e-3) * st"])
DIFF, DIFF_SE = LINEAR(["0", "0", "p.st - q.st", "p.x * (p.st - q.st)"])
Z = "1.959963984540054"


@query("M6 F9", f"""{POINTS} select status, {R('qty')} as qty, {R('1 / (1 + exp(-eta))')} as fit, {R(f'1 / (1 + exp(-(eta - {Z} * se)))')} as fit_lo,
    {R(f'1 / (1 + exp(-(eta + {Z} * se)))')} as fit_hi from (select *, {ETA} as eta, {SE} as se from pts, fitv)""")
def fitted_grid(spark, sf):
    fit, frame, _ = _fit_and_grid(spark, sf)
    return rg.predict(fit, frame).select("status", "qty", "fit", "fit_lo", "fit_hi")


@query("M7 W8", f"""{POINTS} select {R('qty')} as qty, level1, level2, {R('e')} as estimate, {R(f'e - {Z} * se')} as lo, {R(f'e + {Z} * se')} as hi
    from (select p.qty, p.status as level1, q.status as level2, {DIFF} as e, {DIFF_SE} as se from pts p join pts q on q.qty = p.qty and p.status < q.status, fitv)""")
def emm_contrasts(spark, sf):
    """Level contrasts along the raw covariate axis."""
    fit, frame, _ = _fit_and_grid(spark, sf)
    return rg.contrasts(fit, frame, "status", ["qty", "qty_std"]).select("qty", "level1", "level2", "estimate", "lo", "hi")


MEAN, MEAN_SE = LINEAR(["1", "x", "st", "xst"])


@query("M7", f"""{POINTS}, av as (select status, avg(x) as x, avg(st) as st, avg(x * st) as xst from pts group by 1)
    select status, {R('e')} as estimate, {R('se')} as se, {R(f'e - {Z} * se')} as lo, {R(f'e + {Z} * se')} as hi, {R('1 / (1 + exp(-e))')} as mean
    from (select status, {MEAN} as e, {MEAN_SE} as se from av, fitv)""")
def emm_means(spark, sf):
    """Estimated means per level, averaged over the covariate's grid."""
    fit, frame, _ = _fit_and_grid(spark, sf)
    return rg.marginal_means(fit, frame.select("status", "qty_std"), "status")


@query("M8", f"""{POINTS} select status, {R('x')} as qty_std, {R('(1 / (1 + exp(-eta2)) - 1 / (1 + exp(-eta))) / 1e-3')} as slope
    from (select *, {ETA} as eta, {ETA2} as eta2 from pts, fitv)""")
def slopes(spark, sf):
    fit, frame, _ = _fit_and_grid(spark, sf)
    return rg.slopes(fit, frame.select("status", "qty_std"), "qty_std").select("status", "qty_std", "slope")


REPORT = GLM(ITEMS.replace("as x3", "as x9").replace("as x4", "as x3"), 4, "logit", "mu * (1 - mu)", "-0.5")
PD_Z = "(abs(estimate / se) / sqrt(2))"


@query("M9", f"""{REPORT}, co as (select 1 as position, '(Intercept)' as label, b0 as estimate, sqrt(v00) as se from fitv
      union all select 2, 'Discount', b1, sqrt(v11) from fitv union all select 3, 'Tax', b2, sqrt(v22) from fitv
      union all select 4, 'Status O', b3, sqrt(v33) from fitv),
    e as (select *, {PD_Z} as z, 1 / (1 + 0.5 * {PD_Z}) as t from co)
    select cast(position as bigint) as position, label, {R('estimate')} as estimate, printf('[%.2f, %.2f]', estimate - {Z} * se, estimate + {Z} * se) as ci,
      {R(f'100 * (1 - ({ERFC}) / 2)')} as pd_pct from e""")
def coef_report(spark, sf):
    fit = rg.fit_glm(_items(spark, sf), "y ~ disc_std + tax_std + status", "binomial", "logit")
    labels = {"disc_std": "Discount", "tax_std": "Tax", r"status_(\w)": "Status $1"}
    return rg.coef_report(rg.coef_table(spark, fit), labels, ["(Intercept)", "Discount", "Tax"])


SERIES = """, s0 as (select entity, min(day) as lo, max(day) as hi from seen group by entity),
    ser as (select s.entity, c.day, cast(date_diff('day', s.lo, c.day) as bigint) as t, v.mean_value as y from s0 s join cal c on c.day between s.lo and s.hi
      left join seen v on v.entity = s.entity and v.day = c.day)"""


@query("M10", f"""{SERIES}, recursive k as (
      select entity, day, t, case when y is null then 0 else 1e6 / (1e6 + 25) * y end as m, case when y is null then 1e6 else 1e6 - 1e6 / (1e6 + 25) * 1e6 end as p from ser where t = 0
      union all select s.entity, s.day, s.t, case when s.y is null then k.m else k.m + (k.p + 1) / (k.p + 1 + 25) * (s.y - k.m) end,
        case when s.y is null then k.p + 1 else (k.p + 1) - (k.p + 1) / (k.p + 1 + 25) * (k.p + 1) end
      from k join ser s on s.entity = k.entity and s.t = k.t + 1)
    select entity, cast(day as varchar) as day, {R('m')} as level, {R('p')} as level_var from k""")
def local_level(spark, sf):
    """Level of every entity's daily value, missing days predicted."""
    return se.local_level(_series(spark, sf), "day", "mean_value", ["entity"], q=1.0, r=25.0)


@query("M11", f"""{SERIES}, recursive k as (
      select entity, day, t, 1e6 / (1e6 + 25) * y as m1, cast(0 as double) as m2, cast(1e6 - 1e6 / (1e6 + 25) * 1e6 as double) as p11, cast(0 as double) as p12, cast(1e6 as double) as p22 from ser where t = 0
      union all select entity, day, t,
        case when y is null then a1 else a1 + q11 / (q11 + 25) * (y - a1) end, case when y is null then a2 else a2 + q12 / (q11 + 25) * (y - a1) end,
        case when y is null then q11 else q11 - q11 / (q11 + 25) * q11 end, case when y is null then q12 else q12 - q12 / (q11 + 25) * q11 end,
        case when y is null then q22 else q22 - q12 / (q11 + 25) * q12 end
      from (select s.entity, s.day, s.t, s.y, 2 * k.m1 - k.m2 as a1, k.m1 as a2, 4 * k.p11 - 4 * k.p12 + k.p22 + 0.1 as q11, 2 * k.p11 - k.p12 as q12, k.p11 as q22
            from k join ser s on s.entity = k.entity and s.t = k.t + 1))
    select entity, cast(day as varchar) as day, {R('m1')} as level, {R('p11')} as level_var from k""")
def smooth_trend(spark, sf):
    return se.smooth_trend(_series(spark, sf), "day", "mean_value", ["entity"], q=0.1, r=25.0)


@query("M10", f"""{SERIES}, recursive k as (
      select entity, day, t, case when y is null then 0 else 1e6 / (1e6 + 25) * y end as m, case when y is null then 1e6 else 1e6 - 1e6 / (1e6 + 25) * 1e6 end as p from ser where t = 0
      union all select s.entity, s.day, s.t, case when s.y is null then k.m else k.m + (k.p + 1) / (k.p + 1 + 25) * (s.y - k.m) end,
        case when s.y is null then k.p + 1 else (k.p + 1) - (k.p + 1) / (k.p + 1 + 25) * (k.p + 1) end
      from k join ser s on s.entity = k.entity and s.t = k.t + 1),
    sm as (select entity, day, t, m, p from k where (entity, t) in (select entity, max(t) from k group by entity)
      union all select k.entity, k.day, k.t, k.m + k.p / (k.p + 1) * (sm.m - k.m), k.p + (k.p / (k.p + 1)) ** 2 * (sm.p - k.p - 1)
      from sm join k on k.entity = sm.entity and k.t = sm.t - 1)
    select entity, cast(day as varchar) as day, {R('m')} as level, {R('p')} as level_var from sm""")
def local_level_smoothed(spark, sf):
    """Level of every day given the whole series."""
    return se.smoothed_level(_series(spark, sf), "day", "mean_value", ["entity"], q=1.0, r=25.0)


@query("M10")
def local_level_fit(spark, sf):
    """Variances of greatest likelihood, the effect of a state, and the gain of the last round (no SQL: each round smooths anew)."""
    rows = b.seen(spark, sf).select("entity", "day", "mean_value", "bought")
    fit = se.fit_level(rows, "day", "mean_value", ["entity"], ["bought"], start=(1.0, 100.0), tol=1e-5)
    falls = sum(y < x - 1e-9 * abs(x) for x, y in zip(fit.history, fit.history[1:]))
    return spark.createDataFrame([(fit.q, fit.r, float(fit.beta[0]), falls)], "q double, r double, bought double, falls long")


@query("M12 F10 W6", f""", c as (select * from cal where day between (select min(day) from mgd) and (select max(day) from mgd))
    select cast(c.day as varchar) as day, {R('m.n_entity')} as n_entity, {R('m.dur')} as dur, row_number() over (order by c.day) as t_index,
      case when m.n_entity is not null then count(m.n_entity) over (order by c.day) end as obs_index,
      case when m.code = 'm19' then 1 when m.code <> 'm19' then 0 end as code_m19, case when m.code = 'nm20' then 1 when m.code <> 'nm20' then 0 end as code_nm20
    from c left join mgd m on m.day = c.day""")
def state_frame(spark, sf):
    days = b.mgd(spark, sf).select("day", F.col("n_entity").cast("double").alias("n_entity"), "dur", "code")
    return fr.state_frame(days, "day", "n_entity", ["dur"], "code", ["m19", "nm20"])


