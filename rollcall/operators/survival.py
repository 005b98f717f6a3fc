"""Time to detection: person-period rows, life tables, hazards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rollcall.functions.nulls import if_na


def person_period(df: DataFrame, dur: str, follow: str, width: float = 1.0, event: str | None = None) -> DataFrame:
    """One row per elapsed interval until detection or end of observation.

    ``time`` runs 1, 2, ... up to ceil(min(dur, follow) / width). ``hit`` is 1
    in the interval in which the entity was found and 0 before it; a censored
    entity (``event`` = 0) never gets 1. Durations of 0 or less give no row.
    """
    last = F.floor(F.least(F.ceil(F.col(dur) / width), F.ceil(F.col(follow) / width)))
    # least() would skip a null, so unknown durations are dropped first
    rows = df.dropna(subset=[dur, follow]).withColumn("_last", last).filter(F.col("_last") >= 1)
    found = F.lit(1) if event is None else F.col(event)
    return (rows.withColumn("time", F.explode(F.sequence(F.lit(1).cast("bigint"), "_last")))
            .withColumn("hit", if_na((F.col("time") == F.ceil(F.col(dur) / width)) & (found == 1), 1, 0))
            .drop("_last"))


def life_table(df: DataFrame, dur: str, event: str, width: float, by: Sequence[str]) -> DataFrame:
    """Discrete hazard and cumulative detection by time bin, without expansion.

    Durations are counted per bin first; the number still at risk is a
    reverse running sum over the bins (one short run per group).
    """
    binned = (df.filter(F.col(dur) > 0)
              .groupBy(*by, F.ceil(F.col(dur) / width).alias("bin"))
              .agg(F.count(F.lit(1)).alias("_n"), F.sum(event).cast("bigint").alias("events")))
    ahead = W.partitionBy(*by).orderBy("bin").rowsBetween(W.currentRow, W.unboundedFollowing)
    run = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    table = binned.withColumn("at_risk", F.sum("_n").over(ahead).cast("bigint"))
    table = table.withColumn("hazard", F.col("events") / F.col("at_risk"))
    return table.withColumn("cum_detect", cumulative_detection(F.col("hazard"), run)).drop("_n")


def cumulative_detection(p: Column, run) -> Column:
    """1 - running product of (1 - p)."""
    return F.lit(1.0) - F.product(F.lit(1.0) - p).over(run)
