"""Projection, reshape, join, aggregate, window and scalar queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rollcall.functions.nulls import is_in, ratio
from rollcall.functions.scalars import (
    interval_label, level_index, period_code, replace_all, split_right,
)
from rollcall.operators import calendar as cal
from rollcall.operators import frames as fr
from rollcall.operators import reshape as rs
from rollcall.operators.attendance import attach_attributes
from rollcall.operators.ranks import exact_quantiles, scale_by_max
from rollcall.operators.survival import cumulative_detection
from rollcall.plans import base as b
from rollcall.plans.registry import query
from rollcall.plans.sqlbase import R
from rollcall.session import delete_at_end, shared_folder
from rollcall.sources import load_result, read_csv, read_periods, save_result
from rollcall.sources import stack_periods as stack

MONEY = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("S3 O4", """select period, entity, cast(day as varchar) as day, case when event_type = 'error' then value end as v_error,
    case when event_type = 'view' then value end as v_view, case when event_type = 'error' then 'e' else 'v' end as sheet
    from ev where event_type in ('error', 'view')""")
def stack_periods(spark, sf):
    """Sheets of different shape, tagged and stacked by name."""
    e = b.ev(spark, sf).select("period", "entity", "day", "event_type", "value")
    part = lambda kind, name: e.filter(F.col("event_type") == kind).drop("event_type").withColumnRenamed("value", name)
    return stack({"e": part("error", "v_error"), "v": part("view", "v_view")}, "sheet").select(
        "period", "entity", "day", "v_error", "v_view", "sheet")


@query("P1 P2 P3", """select l_orderkey as order_id, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_linestatus from lineitem""")
def project_range(spark, sf):
    t = b.table(spark, sf, "lineitem")
    keep = [*rs.cols_between(t, "l_orderkey", "l_linenumber"), *rs.cols_matching(t, prefix="l_", any_of=["l_returnflag", "l_linestatus", "absent"])]
    return t.select(*keep).withColumnRenamed("l_orderkey", "order_id")


@query("P5 R10", """select l_orderkey, l_linenumber, round_even(l_quantity, 0) as l_quantity, round_even(l_extendedprice, 0) as l_extendedprice,
    round_even(l_discount, 0) + 0.0 as l_discount, round_even(l_tax, 0) + 0.0 as l_tax from lineitem""")
def round_numeric(spark, sf):
    return rs.round_numeric(b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *MONEY))


@query("P8", """select entity, cast(day as varchar) as day, rs from state where rs is not null""")
def drop_na(spark, sf):
    return b.state(spark, sf).dropna(subset=["rs"])


def _roster_wide(spark, sf):
    """Wide roster by event type: one column per type, null when none."""
    return rs.to_wide(b.ev(spark, sf).groupBy("entity", "day", "event_type").agg(F.count(F.lit(1)).alias("n")),
                      ["entity", "day"], "event_type", "n", None, F.max)


@query("H1", """, w as (select distinct entity, day from ev), n as (select entity, day, event_type, count(*) as n from ev group by 1, 2, 3)
    select w.entity, cast(w.day as varchar) as day, t.event_type, n.n from w cross join (values ('click'), ('error'), ('purchase'), ('signup'), ('view')) t(event_type)
    left join n on n.entity = w.entity and n.day = w.day and n.event_type = t.event_type""")
def unpivot_roster(spark, sf):
    wide = _roster_wide(spark, sf)
    return rs.to_long(wide, ["entity", "day"], wide.columns[2:], "event_type", "n")


@query("H2 R16", """select entity, cast(day as varchar) as day, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'error') as error,
    count(*) filter (event_type = 'purchase') as purchase, count(*) filter (event_type = 'signup') as signup, count(*) filter (event_type = 'view') as view from ev group by 1, 2""")
def pivot_presence(spark, sf):
    wide = _roster_wide(spark, sf)
    return wide.fillna(0, subset=wide.columns[2:])


@query("H3", f"""select entity, count(*) filter (period = 0) as n_0, count(*) filter (period = 1) as n_1, count(*) filter (period = 2) as n_2, {R('avg(value) filter (period = 0)')} as mean_0,
    {R('avg(value) filter (period = 1)')} as mean_1, {R('avg(value) filter (period = 2)')} as mean_2, {R('stddev_samp(value) filter (period = 0)')} as sd_0, {R('stddev_samp(value) filter (period = 1)')} as sd_1, {R('stddev_samp(value) filter (period = 2)')} as sd_2
    from ev group by entity""")
def pivot_multi(spark, sf):
    aggs = {"n": F.count("value"), "mean": F.avg("value"), "sd": F.stddev_samp("value")}
    wide = rs.to_wide_many(b.ev(spark, sf), ["entity"], "period", None, aggs)
    return wide.fillna(0, subset=[c for c in wide.columns if c.startswith("n_")])


@query("S1", """select l_orderkey, l_partkey, l_linenumber, l_quantity, l_returnflag, cast(cast(l_shipdate as date) as varchar) as l_shipdate from lineitem""")
def csv_scan(spark, sf):
    """Columns written as CSV and read with their types found in the file."""
    t = b.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", F.to_date("l_shipdate").alias("l_shipdate"))
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    t.write.csv(path, header=True, nullValue="NA")
    delete_at_end(spark, path)
    return read_csv(spark, path)


@query("S4 S5", f"""select period, entity, {R('avg(value)')} as mean, count(*) as n from ev group by 1, 2""")
def saved_result(spark, sf):
    """A result kept in partitions by period, and loaded again."""
    path = f"{shared_folder(spark)}/result-{uuid.uuid4().hex}"
    save_result(b.ev(spark, sf).groupBy("period", "entity").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n")), path, "period")
    delete_at_end(spark, path)
    return load_result(spark, path)


@query("S3", """select period, entity, count(*) as n from ev where period between 1 and 2 group by 1, 2""")
def period_scan(spark, sf):
    """Many periods as one partitioned table, of which only the wanted ones are read."""
    path = f"{shared_folder(spark)}/periods-{uuid.uuid4().hex}"
    save_result(b.ev(spark, sf).select("period", "entity", "event_id"), path, "period")
    delete_at_end(spark, path)
    return read_periods(spark, path, "period", [1, 2]).groupBy("period", "entity").agg(F.count(F.lit(1)).alias("n"))


@query("H4 H5", """select group_id, split_part(group_id, '_', 1) as head, cast(split_part(group_id, '_', 2) as bigint) as no,
    left(code, length(code) - 2) as season_code, right(code, 2) as year_code from group_days""")
def split_key(spark, sf):
    parts = F.split("group_id", "_")
    head, tail = split_right(F.col("code"), 2)
    return b.group_days(spark, sf).select("group_id", parts[0].alias("head"), parts[1].cast("bigint").alias("no"),
                                          head.alias("season_code"), tail.alias("year_code"))


@query("H6", """, g as (select least(a % 4, b % 4) as x, greatest(a % 4, b % 4) as y, sum(w) as w from graph group by 1, 2),
    s as (select x, y, w from g union all select y, x, w from g where x <> y)
    select x as a, max(case when y = 0 then w end) as "0", max(case when y = 1 then w end) as "1", max(case when y = 2 then w end) as "2",
      max(case when y = 3 then w end) as "3" from s group by x""")
def edge_matrix(spark, sf):
    """The graph folded to classes of nodes and shown as a square matrix."""
    x, y = F.col("a") % 4, F.col("b") % 4
    folded = b.graph(spark, sf).groupBy(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).agg(F.sum("w").alias("w"))
    return rs.edges_to_matrix(folded, "a", "b", "w")


@query("H7 W6", f"""select t.t, cast(t.day as varchar) as day, {R('avg(d.value)')} as mean from tday t left join draws d on d.i = t.t group by 1, 2""")
def bind_by_index(spark, sf):
    """Columns bound by an explicit index instead of by position."""
    idx = F.regexp_extract("variable", r"(\d+)", 1).cast("bigint")
    means = b.draws(spark, sf).groupBy(idx.alias("t")).agg(F.avg("value").alias("mean"))
    return b.tday(spark, sf).select("t", "day").join(means, "t", "left")


@query("J1 J2 D2", """select p.entity, cast(p.day as varchar) as day, p.present, a.age, a.rank from presence p left join att a on a.entity = p.entity and a.period = p.period""")
def left_attr(spark, sf):
    return attach_attributes(b.presence(spark, sf), b.att(spark, sf), ["entity", "period"]).select("entity", "day", "present", "age", "rank")


@query("J8", """, l as (select distinct entity % 4 as class from ev), n as (select entity % 4 as class, event_type, day, count(*) as n from ev group by 1, 2, 3)
    select l.class, t.event_type, cast(c.day as varchar) as day, coalesce(n.n, 0) as n from l
    cross join (values ('click'), ('error'), ('purchase'), ('signup'), ('view')) t(event_type) cross join cal c
    left join n on n.class = l.class and n.event_type = t.event_type and n.day = c.day""")
def grid(spark, sf):
    """Levels x types x calendar, with the observed counts."""
    e = b.ev(spark, sf).withColumn("class", F.col("entity") % 4)
    s = b.span(spark, sf)
    frame = cal.grid(e.select("class").distinct(), {
        "event_type": F.array(*[F.lit(t) for t in rs.levels_of(e, "event_type")]), "day": F.sequence(s.getField("lo"), s.getField("hi"))})
    counted = e.groupBy("class", "event_type", "day").agg(F.count(F.lit(1)).alias("n"))
    return frame.join(counted, ["class", "event_type", "day"], "left").fillna({"n": 0})


@query("A1", f"""select period, event_type, count(*) as n, {R('sum(value)')} as total, {R('avg(value)')} as mean, {R('stddev_samp(value)')} as sd, {R('max(value)')} as top
    from ev group by 1, 2""")
def period_summary(spark, sf):
    return b.ev(spark, sf).groupBy("period", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("sd"), F.max("value").alias("top"))


@query("A2 F8", f"""select count(*) as n_days, cast(sum(present) as bigint) as n_present, {R('avg(present)')} as share, {R('ln(sum(present))')} as log_n from presence""")
def overall_share(spark, sf):
    return b.presence(spark, sf).agg(F.count(F.lit(1)).alias("n_days"), F.sum("present").alias("n_present"),
                                     F.avg("present").alias("share"), F.log(F.sum("present").cast("double")).alias("log_n"))


@query("A5 R8", f"""select event_type, {R('quantile_cont(value, 0.025)')} as lo, {R('median(value)')} as median, {R('quantile_cont(value, 0.975)')} as hi from ev group by 1""")
def quantiles(spark, sf):
    return exact_quantiles(b.ev(spark, sf), ["event_type"], "value", {"lo": 0.025, "median": 0.5, "hi": 0.975})


@query("A7 R19", f"""select entity, {R('avg(value)')} as mean, {R('stddev_samp(value) / avg(value)')} as cv from ev group by entity""")
def cv(spark, sf):
    return b.ev(spark, sf).groupBy("entity").agg(
        F.avg("value").alias("mean"), ratio(F.stddev_samp("value"), F.avg("value")).alias("cv"))


@query("A8", """select l_returnflag, count(*) filter (l_linestatus = 'F') as f, count(*) filter (l_linestatus = 'O') as o from lineitem group by 1""")
def contingency(spark, sf):
    t = b.table(spark, sf, "lineitem").select("l_returnflag", F.lower("l_linestatus").alias("status"))
    counts = t.groupBy("l_returnflag", "status").agg(F.count(F.lit(1)).alias("n"))
    return rs.to_wide(counts, ["l_returnflag"], "status", "n", None, F.sum).fillna(0)


@query("A9", f"""select l_suppkey, l_returnflag, count(*) as n, {R('avg(l_quantity)')} as mean from lineitem group by 1, 2 having count(*) >= 200""")
def min_support_means(spark, sf):
    t = b.table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity")
    return t.groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("mean")).filter(F.col("n") >= 200)


@query("W3", f"select period, entity, {R('rank / max(rank) over (partition by period)')} as rank_scaled from att")
def rank_scaled(spark, sf):
    return scale_by_max(b.att(spark, sf), "rank", ["period"], "rank_scaled").select("period", "entity", "rank_scaled")


@query("W5", f""", h as (select period, cast(floor(date_diff('minute', cast(day as timestamp), ts) / 60) as bigint) as hour, avg(case when event_type = 'error' then 1.0 else 0.0 end) as p from ev group by 1, 2)
    select period, hour, {R('p')} as p, {R('1 - product(1 - p) over (partition by period order by hour rows unbounded preceding)')} as cum from h""")
def cum_detect(spark, sf):
    """Cumulative detection from hourly probabilities (24 rows per period)."""
    h = b.ev(spark, sf).groupBy("period", F.hour("ts").alias("hour")).agg(
        F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("p"))
    run = W.partitionBy("period").orderBy("hour").rowsBetween(W.unboundedPreceding, W.currentRow)
    return h.withColumn("cum", cumulative_detection(F.col("p"), run))


@query("W7 R9", f""", s as (select avg(l_quantity) as m1, stddev_samp(l_quantity) as s1, avg(l_extendedprice) as m2, stddev_samp(l_extendedprice) as s2 from lineitem)
    select l_orderkey, l_partkey, {R('(l_quantity - m1) / s1')} as l_quantity_std, {R('(l_extendedprice - m2) / s2')} as l_extendedprice_std from lineitem, s""")
def standardize(spark, sf):
    t = b.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    out, _ = fr.standardize(t, ["l_quantity", "l_extendedprice"])
    return out.select("l_orderkey", "l_partkey", "l_quantity_std", "l_extendedprice_std")


@query("W8", f"""select l_orderkey, l_partkey, {R('l_quantity')} as back, {R('z.s * 2 + z.m')} as at_two_sd from lineitem, (select avg(l_quantity) as m, stddev_samp(l_quantity) as s from lineitem) z""")
def unstandardize(spark, sf):
    t = b.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    out, stats = fr.standardize(t, ["l_quantity"])
    return out.select("l_orderkey", "l_partkey", fr.unstandardize(F.col("l_quantity_std"), stats, "l_quantity").alias("back"),
                      fr.unstandardize(F.lit(2.0), stats, "l_quantity").alias("at_two_sd"))


@query("O1 O2 R5", """select o_orderpriority, cast(case o_orderpriority when '1-URGENT' then 1 when '3-MEDIUM' then 2 when '5-LOW' then 3 else 4 end as bigint) as position, count(*) as n
    from orders group by 1, 2""")
def custom_order(spark, sf):
    t = b.table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    pos = level_index(F.col("o_orderpriority"), ["1-URGENT", "3-MEDIUM", "5-LOW"])
    return t.select("o_orderpriority", pos.alias("position"), "n").orderBy("position", F.col("o_orderpriority").asc_nulls_last())


@query("O3", """select group_id, cast(n_entity as bigint) as n_entity from sizes order by n_entity desc, group_id limit 8""")
def head_rows(spark, sf):
    """The first rows of an ordered table (the display of a table's head)."""
    return b.sizes(spark, sf).select("group_id", "n_entity").orderBy(F.desc("n_entity"), "group_id").limit(8)


@query("F1", """, s as (select entity, day, rs from state) select s.entity, cast(s.day as varchar) as day, cast(s.entity as varchar) || '_' || cast(s.rs as varchar) as key from s""")
def concat_key(spark, sf):
    """Keys that are null when a part is null."""
    return b.state(spark, sf).select("entity", "day", F.concat(F.col("entity").cast("string"), F.lit("_"), F.col("rs").cast("string")).alias("key"))


@query("F2", """select p_partkey, p_name, p_brand from part where regexp_matches(p_brand, '#(1|2[0-4])$') and not regexp_matches(p_name, '^red')""")
def regex_filter(spark, sf):
    t = b.table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return t.filter(F.col("p_brand").rlike("#(1|2[0-4])$") & ~F.col("p_name").rlike("^red"))


@query("F3", """select p_partkey, replace(replace(p_name, 'red', 'blue'), 'blue', 'green') as p_name from part""")
def relabel(spark, sf):
    """Replacements in sequence: red to blue, then every blue to green."""
    t = b.table(spark, sf, "part")
    return t.select("p_partkey", replace_all(F.col("p_name"), {"red": "blue", "blue": "green"}).alias("p_name"))


@query("F4 F6", """select o_orderkey, 'm' || substr(cast(year(o_orderdate) as varchar), 3, 2) as period_code from orders""")
def period_code_(spark, sf):
    return b.table(spark, sf, "orders").select("o_orderkey", period_code(F.col("o_orderdate")).alias("period_code"))


@query("F5", """, q as (select event_type, quantile_cont(value, 0.025) as lo, quantile_cont(value, 0.975) as hi from ev group by 1)
    select event_type, printf('[%.2f, %.2f]', lo, hi) as ci from q""")
def ci_label(spark, sf):
    q = exact_quantiles(b.ev(spark, sf), ["event_type"], "value", {"lo": 0.025, "hi": 0.975})
    return q.select("event_type", interval_label(F.col("lo"), F.col("hi")).alias("ci"))


@query("F10", """select entity, cast(day as varchar) as day, case when rs = 0 then 1 when rs <> 0 then 0 end as rs_0, case when rs = 1 then 1 when rs <> 1 then 0 end as rs_1 from state""")
def dummies(spark, sf):
    s = b.state(spark, sf)
    return s.withColumns(rs.dummies(F.col("rs"), [0, 1], "rs_")).select("entity", "day", "rs_0", "rs_1")


@query("F11", f""", v as (select l_orderkey, l_partkey, l_quantity, l_quantity - avg(l_quantity) over () as c from lineitem),
    m as (select count(*) as n, sum(c * c) as s2, sum(c ** 3) as s3, sum(c ** 4) as s4 from v)
    select l_orderkey, l_partkey, {R('c / sqrt(s2) * 1000')} as t1, {R('((c - s3 / s2) * c - s2 / n) / sqrt(s4 - s3 * s3 / s2 - s2 * s2 / n) * 1000')} as t2 from v, m""")
def poly_time(spark, sf):
    t = b.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    out = fr.poly_columns(t, "l_quantity", 2, "t")
    return out.select("l_orderkey", "l_partkey", (F.col("t1") * 1000).alias("t1"), (F.col("t2") * 1000).alias("t2"))


@query("F12 R4", """select event_id, cast(cast(value as varchar) as double) as value, coalesce(event_type in ('click', 'view'), false) as listed from events""")
def cast_member(spark, sf):
    t = b.table(spark, sf, "events")
    return t.select("event_id", F.col("value").cast("string").cast("double").alias("value"), is_in(F.col("event_type"), ["click", "view"]).alias("listed"))


