"""Rosters, main-group days, arrivals, attendance rates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions.nulls import if_na, is_in, not_in, ratio, total
from rollcall.functions.scalars import minutes_between, share_label
from rollcall.operators.ranks import sorted_row_number
from rollcall.operators.reshape import to_wide

# Codes of the sighting sheet that carry no clock time.
TIME_UNKNOWN, DEAD, TOO_YOUNG = "?", "DD", "NS"


def presence_grid(seen: DataFrame, entity: str, day: str, span: Column) -> DataFrame:
    """0/1 presence of every entity on every day of ``span``.

    ``seen`` holds one row per entity and day of sighting.
    """
    from rollcall.operators.calendar import complete_calendar

    marked = seen.select(entity, day, F.lit(1).alias("present"))
    return complete_calendar(marked, day, [entity], span).fillna({"present": 0})


def decode_sightings(df: DataFrame, code: str = "code", day: str = "day",
                     drop_codes: Sequence[str] = (TIME_UNKNOWN, DEAD, TOO_YOUNG)) -> DataFrame:
    """Clock-time codes to ``found_time`` and ``confirmed``; no code means not seen."""
    kept = df.filter(not_in(F.col(code), drop_codes))
    stamp = F.try_to_timestamp(F.concat(F.col(day).cast("string"), F.lit(" "), F.col(code)), F.lit("yyyy-MM-dd HH:mm"))
    return kept.withColumns({
        "found_time": stamp,
        "confirmed": if_na(F.col(code).isNull(), 0, 1),
        "day_pre": F.date_sub(day, 1),
    })


def attach_attributes(df: DataFrame, att: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on named keys. No broadcast hint: the attribute table grows
    with the entities, so the adaptive planner decides by its real size."""
    return df.join(att, list(keys), "left")


def roster_size(sightings: DataFrame, code: str = "code", day: str = "day",
                drop_codes: Sequence[str] = (DEAD, TOO_YOUNG)) -> DataFrame:
    """Entities that could have been seen, per day."""
    return (sightings.filter(not_in(F.col(code), drop_codes))
            .groupBy(day).agg(F.count(F.lit(1)).alias("max_entity")))


def group_size(members: DataFrame, keys: Sequence[str], exclude: Sequence[str] = (),
               group: str = "group_id", presence: str = "presence") -> DataFrame:
    """Present entities per observed group, without the excluded groups."""
    return (members.filter(not_in(F.col(group), exclude))
            .groupBy(*keys).agg(total(F.col(presence)).cast("bigint").alias("n_entity")))


def main_group_days(sizes: DataFrame, min_share: float = 0.5, min_minutes: float = 240.0,
                    exclude: Sequence[str] = (), group: str = "group_id") -> DataFrame:
    """Groups that held enough of the roster and were followed long enough.

    ``sizes`` needs ``n_entity``, ``max_entity`` and ``dur`` (minutes).
    """
    return (sizes.filter(F.col("dur").isNotNull())
            .withColumn("prop", ratio(F.col("n_entity"), F.col("max_entity")))
            .filter((F.col("prop") >= min_share) & (F.col("dur") >= min_minutes))
            .filter(not_in(F.col(group), exclude)))


def main_group_share(observed: DataFrame, main: DataFrame, by: Sequence[str], day: str = "day") -> DataFrame:
    """Share of the observed days that are main-group days."""
    flags = observed.select(*by, day).distinct().join(
        main.select(day).distinct().withColumn("_main", F.lit(1)), day, "left")
    return flags.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_days"),
        total(F.col("_main")).cast("bigint").alias("n_main"),
        F.avg(F.coalesce("_main", F.lit(0))).alias("share"))


def complete_days(sizes: DataFrame, day: str = "day", by: Sequence[str] = ()) -> DataFrame:
    """Days on which everybody was found today and on the calendar day before.

    ``sizes`` holds one row per (by, day) with ``n_entity`` and ``max_entity``.
    """
    full = sizes.withColumn("inc2", if_na(F.col("max_entity") == F.col("n_entity"), 1, 0))
    pre = full.select(*by, F.date_add(day, 1).alias(day), F.col("inc2").alias("inc"))
    return full.join(pre, [*by, day], "left").filter((F.col("inc") == 1) & (F.col("inc2") == 1)).drop("inc", "inc2")


def pause_ok(found: DataFrame, days: DataFrame, keys: Sequence[str]) -> DataFrame:
    """1 where a pause began before the last arrival, else 0; null if unknown."""
    last = found.groupBy(*keys).agg(F.max("found_time").alias("last_found"))
    flag = if_na(F.col("suspend").isNull(), F.lit(0), if_na(F.col("last_found") < F.col("suspend"), 0, 1))
    return last.join(days, list(keys), "left").withColumn("exclude", flag)


def arrival_rank(df: DataFrame, day: str, dur: str, entity: str, name: str = "arrival") -> DataFrame:
    """Arrival order within the day; never-found entities come last, ties by entity.

    Numbers come from a sort over ranges of (day, time, entity), so neither a
    busy day nor a crowded second, of one time or of many, is one task's work.
    """
    return sorted_row_number(df, [day], [F.col(dur).asc_nulls_last(), F.col(entity)], name)


def arrival_curve(found: DataFrame, day: str = "day", entity: str = "entity") -> DataFrame:
    """Minutes to first sighting, arrival order and cumulative share found.

    ``found`` needs ``start``, ``found_time`` and ``max_entity``.
    """
    timed = found.withColumn("dur", minutes_between(F.col("start"), F.col("found_time")))
    ranked = arrival_rank(timed, day, "dur", entity, "arrival")
    return ranked.withColumn("prop", ratio(F.col("arrival"), F.col("max_entity")))


def censored_durations(df: DataFrame, exclude_groups: Sequence[str] = (), exclude_days: Sequence = ()) -> DataFrame:
    """Time to sighting, right-censored at the end of observation.

    Days with a pause or without observation are dropped. An entity confirmed
    in a smaller group but absent from this one is downgraded to not confirmed.
    """
    kept = (df.filter(not_in(F.col("group_id"), exclude_groups))
            .filter(~is_in(F.col("day"), exclude_days))
            .filter(F.col("suspend").isNull() & F.col("start").isNotNull()))
    follow = minutes_between(F.col("start"), F.col("fin"))
    return kept.withColumns({
        "dur_follow": follow,
        "dur": if_na(F.col("presence") == 1, minutes_between(F.col("start"), F.col("found_time")), follow),
        "confirmed": if_na((F.col("confirmed") == 1) & (F.col("presence") == 0), F.col("presence"), F.col("confirmed")),
    })


def confirmed_durations(df: DataFrame, exclude_groups: Sequence[str] = (), exclude_days: Sequence = ()) -> DataFrame:
    """Durations of confirmed entities only, found before any pause."""
    kept = (df.filter(not_in(F.col("group_id"), exclude_groups))
            .filter(~is_in(F.col("day"), exclude_days))
            .filter(F.col("suspend").isNull() | (F.col("found_time") <= F.col("suspend")))
            .filter(F.col("start").isNotNull()))
    follow = minutes_between(F.col("start"), F.col("fin"))
    return kept.withColumns({
        "dur_follow": follow,
        "dur": if_na(F.col("presence") == 1, minutes_between(F.col("start"), F.col("found_time")), follow),
        "confirmed": if_na((F.col("confirmed") == 1) & (F.col("presence") == 0), F.col("presence"), F.col("confirmed")),
    }).filter(F.col("confirmed") == 1)


def last_arrival(durations: DataFrame, day: str = "day") -> DataFrame:
    return durations.groupBy(day).agg(F.max("dur").alias("last_time"))


def histogram_cdf(df: DataFrame, col: str, width: float, upper: float | None = None) -> DataFrame:
    """Counts in ``(a, a + width]`` bins (the first also takes its left end)
    and the running share. One row per bin, so the running sum is short.

    Bins reach from zero to ``upper``, or as far as the largest value when it
    lies beyond, so that no value is left out. A negative value raises.
    """
    from pyspark.sql.window import Window as W

    place = F.greatest(F.ceil(F.col(col) / width) - 1, F.lit(0)).cast("bigint")
    below = F.raise_error(F.concat(F.lit(f"{col} holds a negative value: "), F.col(col).cast("string"))).cast("bigint")
    counted = (df.filter(F.col(col).isNotNull()).select(F.when(F.col(col) < 0, below).otherwise(place).alias("bin"))
               .groupBy("bin").agg(F.count(F.lit(1)).alias("n")))
    least = int(round((upper or 0) / width)) - 1
    last = counted.agg(F.greatest(F.coalesce(F.max("bin"), F.lit(-1)), F.lit(least)).alias("_last"))
    bins = last.filter("_last >= 0").select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last"))).alias("bin"))
    full = bins.join(counted, "bin", "left").fillna({"n": 0}).withColumn("_one", F.lit(1))
    run = W.partitionBy("_one").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = W.partitionBy("_one")
    return full.select(
        "bin", (F.col("bin") * float(width)).alias("lower"), "n",
        ratio(F.sum("n").over(run), F.sum("n").over(whole)).alias("cdf"))


def attendance_rate(panel: DataFrame, by: Sequence[str], presence: str = "presence",
                    impossible: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Days possible and days present per key, without impossible pairs.

    ``impossible`` maps a key column to values excluded for it; with several
    columns the pair ``a_b`` in column order is compared.
    """
    counts = panel.groupBy(*by).agg(
        F.count(F.lit(1)).alias("possible"), total(F.col(presence)).cast("bigint").alias("n"))
    for name, values in (impossible or {}).items():
        key = F.concat_ws("_", *[F.col(c).cast("string") for c in name.split("+")])
        counts = counts.filter(not_in(key, values))
    return counts.withColumn("prop", ratio(F.col("n"), F.col("possible")))


def attendance_table(rates: DataFrame, row: str, column: str, levels: Sequence[str] | None = None) -> DataFrame:
    """'0.83(10/12)' per row entity and column level, all of them unless listed."""
    labelled = rates.withColumn("label", share_label(F.col("n"), F.col("possible")))
    return to_wide(labelled, [row], column, "label", levels, F.max)


def presence_by_stay(stays: DataFrame, minutes: str, levels: Sequence[tuple[float, int]], name: str) -> DataFrame:
    """Level of a stay by its length: the first ``(at least, level)`` that fits,
    0 for shorter ones, null when the length is unknown."""
    expr = F.lit(0)
    for at_least, level in sorted(levels):
        expr = F.when(F.col(minutes) >= at_least, level).otherwise(expr)
    return stays.withColumn(name, F.when(F.col(minutes).isNotNull(), expr))


def frequency_per(df: DataFrame, by: Sequence[str], flag: str, days: int = 10, name: str = "rate") -> DataFrame:
    """Events per ``days`` observed days."""
    known = df.filter(F.col(flag).isNotNull())
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(flag).cast("bigint").alias("sum_flag"),
        (F.avg(flag) * days).alias(name))


def joint_rate(df: DataFrame, first: str, second: str) -> DataFrame:
    """Of the rows where ``first`` happened: how often did ``second`` too."""
    both = if_na((F.col(first) == 1) & (F.col(second) == 1), 1, 0)
    return (df.dropna(subset=[first, second]).filter(F.col(first) == 1)
            .agg(F.count(F.lit(1)).alias("n"), F.sum(both).cast("bigint").alias("together"), F.avg(both).alias("prop")))


def any_flag(df: DataFrame, by: Sequence[str], flag: str, name: str) -> DataFrame:
    return df.groupBy(*by).agg((total(F.col(flag)) > 0).cast("int").alias(name))


def state_share(df: DataFrame, by: Sequence[str], presence: str, state: str, name: str) -> DataFrame:
    """Share of present days in a state; null states are left out."""
    return (df.filter(F.col(presence) == 1).groupBy(*by)
            .agg(F.avg(state).alias(name), F.count(F.lit(1)).alias("n_present")))
