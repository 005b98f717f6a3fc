"""Who left, who came back, and with whom."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rollcall.functions.nulls import if_na
from rollcall.operators.calendar import prev_day


def transition_flags(pre: Column, now: Column) -> dict[str, Column]:
    """Departure and return flags; null when yesterday was not observed."""
    return {
        "departure": if_na(pre.isNull(), F.lit(None).cast("int"), if_na((pre == 1) & (now == 0), 1, 0)),
        "return": if_na(pre.isNull(), F.lit(None).cast("int"), if_na((pre == 0) & (now == 1), 1, 0)),
    }


def state_labels(pre: Column, now: Column, kind: str) -> Column:
    """Labels of a pair of consecutive days; null when one is unknown.

    ``state4``: stay, out, return, absent. ``state3_out``: stay, out, absent
    (absent yesterday, whatever today). ``state3_in``: present (yesterday,
    whatever today), absent, return.
    """
    if kind == "state4":
        return (F.when((pre == 1) & (now == 1), "stay").when((pre == 1) & (now == 0), "out")
                .when((pre == 0) & (now == 1), "return").when((pre == 0) & (now == 0), "absent"))
    if kind == "state3_out":
        return (F.when((pre == 1) & (now == 1), "stay").when((pre == 1) & (now == 0), "out")
                .when(pre == 0, "absent"))
    if kind == "state3_in":
        return (F.when((pre == 0) & (now == 1), "return").when((pre == 0) & (now == 0), "absent")
                .when(pre == 1, "present"))
    raise ValueError(f"unknown kind {kind!r}")


def transitions(presence: DataFrame, entity: str, day: str, kind: str, presence_col: str = "present",
                keys: Sequence[str] = ()) -> DataFrame:
    """Consecutive-day change per entity. ``kind`` is 'departure', 'return',
    'state3_out', 'state3_in' or 'state4'; the result adds ``present_pre`` and
    a column named after the kind. One row per (keys, entity, day) is needed.
    """
    base = prev_day(presence.withColumn("_p", F.col(presence_col)), [*keys, entity], day, ["_p"])
    pre, now = F.col("_p_pre"), F.col("_p")
    if kind in ("departure", "return"):
        out = base.withColumn(kind, transition_flags(pre, now)[kind])
    else:
        out = base.withColumn(kind, state_labels(pre, now, kind))
    return out.withColumnRenamed("_p_pre", "present_pre").drop("_p")


def joint_state(a: Column, b: Column, name_a: str, name_b: str) -> Column:
    return (F.when((a == 1) & (b == 1), "Both").when((a == 1) & (b == 0), f"{name_a} only")
            .when((a == 0) & (b == 1), f"{name_b} only").when((a == 0) & (b == 0), "None"))


def max_pair_value(events: DataFrame, pairs: DataFrame, entity: str, keys: Sequence[str], flag: str,
                   value: str, strict: bool = True, fill: float | None = None, keep_loose: str | None = None) -> DataFrame:
    """For every row, the largest pair value among *other* entities with the
    flag in the same ``keys`` (one day, one group).

    Every flagged row offers its value to its listed relatives, so the work
    follows the pair table and no two members of a day are paired up otherwise. ``strict``
    gives null as soon as one of the others has no pair row, which is found by
    counting; ``fill`` replaces a null result; ``keep_loose`` also keeps the
    maximum over the listed others under that name. ``pairs`` has ``entity``,
    ``entity2`` and ``value``, one row per ordered pair; a row of an entity with
    itself says nothing about others and is left out.
    """
    keys, pairs = list(keys), pairs.filter(F.col(entity) != F.col(f"{entity}2"))
    flagged = events.filter(F.col(flag) == 1).select(*keys, F.col(entity).alias("_other"))
    sizes = flagged.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_flagged"))
    listed = pairs.select(F.col(entity), F.col(f"{entity}2").alias("_other"), F.col(value).alias("_v"))
    offers = (flagged.join(listed, "_other").groupBy(*keys, entity)
              .agg(F.count(F.lit(1)).alias("_listed"), F.max("_v").alias("_max")))
    out = events.join(offers, [*keys, entity], "left").join(sizes, keys, "left")
    others = F.coalesce("_n_flagged", F.lit(0)) - if_na(F.coalesce(F.col(flag), F.lit(0)) == 1, 1, 0)
    if keep_loose:
        out = out.withColumn(keep_loose, F.col("_max"))
    best = F.col("_max")
    if strict:
        best = F.when(F.coalesce("_listed", F.lit(0)) >= others, best)
    if fill is not None:
        best = F.coalesce(best, F.lit(float(fill)))
    return out.withColumns({"n_others": others.cast("bigint"), f"max_{value}": best}).drop(
        "_n_flagged", "_listed", "_max")


def leave_out_totals(rows: DataFrame, keys: Sequence[str], flag: str, amounts: Mapping[str, Column]) -> DataFrame:
    """Totals of a day, and the same without the rows that had the flag.

    ``amounts`` names what is added up per row; both totals come from one pass.
    """
    flagged = F.col(flag) == 1
    out = rows.groupBy(*keys).agg(*[
        e for name, amount in amounts.items()
        for e in (F.sum(amount).alias(name), F.coalesce(F.sum(F.when(flagged, amount)), F.lit(0)).alias(f"_less_{name}"))])
    return out.withColumns({f"{name}_other": F.col(name) - F.col(f"_less_{name}") for name in amounts}).drop(
        *[f"_less_{name}" for name in amounts])


def departures_of_seen(seen: DataFrame, entity: str, day: str, last: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Departures from sightings alone: one row per day after a sighting.

    ``seen`` has one row per (keys, entity, day) of presence; nobody is looked
    for after ``last``. An entity has left on the day after a sighting unless
    it is seen on that day too, so absent days are never built.
    """
    w = W.partitionBy(*keys, entity).orderBy(day)
    after = F.date_add(F.col(day), 1)
    rows = seen.select(*keys, entity, after.alias(day), F.lead(day).over(w).alias("_next")).filter(F.col(day) <= last)
    left = F.when(F.col("_next") == F.col(day), 0).otherwise(1)
    return rows.withColumn("departure", left).drop("_next")
