"""Incident rates over exposure, zero-filled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.nulls import n_distinct
from rollcall.operators.calendar import grid
from rollcall.operators.reshape import listed


def incident_rate(incidents: DataFrame, exposure: DataFrame, keys: Sequence[str], per_minutes: float = 60.0,
                  distinct_on: str | None = None, dur: str = "dur") -> DataFrame:
    """Incidents per ``per_minutes`` of observation for every exposure row.

    Exposure rows without an incident stay with rate 0; incidents outside the
    exposure are dropped.
    """
    count = n_distinct(F.col(distinct_on)) if distinct_on else F.count(F.lit(1))
    counted = incidents.groupBy(*keys).agg(count.cast("bigint").alias("n_inc"))
    return (counted.join(exposure, list(keys), "right").fillna({"n_inc": 0})
            .withColumn("rate", F.try_divide(F.col("n_inc") * float(per_minutes), F.col(dur))))


def qualifying(incidents: DataFrame, condition: Column) -> DataFrame:
    """Incidents whose target surely qualifies (null conditions are dropped)."""
    return incidents.filter(condition)


def rate_by_actor(incidents: DataFrame, exposure: DataFrame, nesting: Sequence[str], actor: str, state: str,
                  actors: Sequence[str], states: Sequence[int], availability: DataFrame,
                  per_minutes: float = 60.0, dur: str = "dur") -> DataFrame:
    """Rate by actor class ('other' when not listed) and target state.

    Every observed day gets every class and state; rows stay only where the
    actor was available. A state that is neither listed nor null raises.
    ``availability`` has the nesting day, the actor class
    and ``available``; a missing row counts as available.
    """
    classed = incidents.withColumn("actor_class", F.when(F.col(actor).isin(list(actors)), F.col(actor)).otherwise("other"))
    classed = classed.withColumn(state, listed(F.col(state), states, state).cast(classed.schema[state].dataType))
    counted = (classed.filter(F.col(state).isNotNull())
               .groupBy(*nesting, "actor_class", state).agg(F.count(F.lit(1)).alias("n_inc")))
    frame = grid(exposure.select(*nesting, dur), {
        "actor_class": F.array(*[F.lit(a) for a in (*actors, "other")]), state: F.array(*[F.lit(v) for v in states])})
    frame = frame.join(counted, [*nesting, "actor_class", state], "left").fillna({"n_inc": 0})
    on = [c for c in availability.columns if c != "available"]
    return (frame.join(availability, on, "left").filter(F.coalesce("available", F.lit(1)) == 1)
            .withColumn("rate", F.try_divide(F.col("n_inc") * float(per_minutes), F.col(dur)))
            .drop("available"))


def two_level(df: DataFrame, session: Sequence[str], value: str, then: Sequence[str], name: str) -> DataFrame:
    """Maximum per session (its length), then the sum of sessions."""
    return (df.groupBy(*session).agg(F.max(value).alias("_m"))
            .groupBy(*then).agg(F.sum("_m").alias(name)))


def headcounts(df: DataFrame, by: Sequence[str], counts: Mapping[str, Column]) -> DataFrame:
    """Number of rows per key that satisfy each condition."""
    return df.groupBy(*by).agg(*[
        F.sum(F.when(cond, 1).otherwise(0)).cast("bigint").alias(name) for name, cond in counts.items()])
