"""Dyads: who is seen with whom, within bounded social units."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.functions.nulls import ratio
from rollcall.session import cut_lineage


def pack_days(df: DataFrame, keys: Sequence[str], position: Column, flags: Mapping[str, Column]) -> DataFrame:
    """Fold the days of an entity to bit masks: one row per key and 64-day word."""
    word = F.shiftright(position.cast("bigint"), 6)
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(position, F.lit(64)).cast("int"))
    return df.groupBy(*keys, word.alias("word")).agg(*[
        F.coalesce(F.bit_or(F.when(cond, bit)), F.lit(0).cast("bigint")).alias(name)
        for name, cond in flags.items()])


def pairs_within(rows: DataFrame, unit: Sequence[str], entity: str, cols: Sequence[str],
                 extra: Sequence[str] = (), block: int = 512) -> DataFrame:
    """Unordered pairs ``a < b`` of the members of one unit, each pair once.

    ``rows`` is folded to one row per member (and ``extra`` key) beforehand,
    so the join emits the result itself and no per-day pairs. A unit with more
    than ``block`` members is cut into id blocks and each block pair becomes
    its own join key: no task holds a whole large unit and no pair is lost.
    """
    unit, extra = list(unit), list(extra)
    n_blocks = rows.groupBy(*unit).agg(
        F.ceil(F.count_distinct(F.col(entity)) / block).alias("_blocks"))
    cut = rows.join(n_blocks, unit).withColumn("_b", F.pmod(F.xxhash64(entity), "_blocks").cast("int"))
    top = F.col("_blocks").cast("int") - 1
    left = (cut.withColumn("_bb", F.explode(F.sequence(F.col("_b"), top))).withColumn("_ba", F.col("_b"))
            .select(*unit, *extra, "_ba", "_bb", F.col(entity).alias("x"), *[F.col(c).alias(f"{c}_x") for c in cols]))
    right = (cut.withColumn("_ba", F.explode(F.sequence(F.lit(0), F.col("_b")))).withColumn("_bb", F.col("_b"))
             .select(*unit, *extra, "_ba", "_bb", F.col(entity).alias("y"), *[F.col(c).alias(f"{c}_y") for c in cols]))
    both = left.join(right, [*unit, *extra, "_ba", "_bb"]).filter(
        F.when(F.col("_ba") == F.col("_bb"), F.col("x") < F.col("y")).otherwise(F.col("x") != F.col("y")))
    swap = F.col("x") > F.col("y")
    out = [F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")]
    for c in cols:
        out.append(F.when(swap, F.col(f"{c}_y")).otherwise(F.col(f"{c}_x")).alias(f"{c}_a"))
        out.append(F.when(swap, F.col(f"{c}_x")).otherwise(F.col(f"{c}_y")).alias(f"{c}_b"))
    return both.select(*unit, *extra, *out)


def association_index(present: DataFrame, entity: str, position: Column, unit: Sequence[str],
                      present_col: str = "present") -> DataFrame:
    """Simple ratio index: together / (together + only a + only b).

    ``position`` numbers the observation events (a day number). ``denom`` is
    returned as well; pairs never seen together have index 0. ``present`` holds
    absent days too, one row per entity and event. The packed rows (one per
    entity and 64 days) are written once, as the pair join reads them thrice.
    """
    packed = cut_lineage(pack_days(present, [*unit, entity], position, {"seen": F.col(present_col) == 1}))
    pairs = pairs_within(packed, unit, entity, ["seen"], ["word"])
    together = F.bit_count(F.col("seen_a").bitwiseAND(F.col("seen_b")))
    either = F.bit_count(F.col("seen_a").bitwiseOR(F.col("seen_b")))
    return (pairs.groupBy(*unit, "a", "b")
            .agg(F.sum(together).cast("bigint").alias("together"), F.sum(either).cast("bigint").alias("denom"))
            .withColumn("sri", ratio(F.col("together"), F.col("denom"))))


def co_event_index(flags: DataFrame, entity: str, position: Column, unit: Sequence[str], flag: str) -> DataFrame:
    """Shared events over all events of the pair, on days both were at risk.

    A null ``flag`` means the entity was not at risk that day. The index is
    null when neither had an event.
    """
    at_risk, hit = F.col(flag).isNotNull(), F.col(flag) == 1
    packed = cut_lineage(pack_days(flags, [*unit, entity], position, {"risk": at_risk, "hit": hit}))
    pairs = pairs_within(packed, unit, entity, ["risk", "hit"], ["word"])
    both = F.col("risk_a").bitwiseAND(F.col("risk_b"))
    together = F.bit_count(F.col("hit_a").bitwiseAND(F.col("hit_b")))
    either = F.bit_count(F.col("hit_a").bitwiseOR(F.col("hit_b")).bitwiseAND(both))
    return (pairs.groupBy(*unit, "a", "b")
            .agg(F.sum(F.bit_count(both)).cast("bigint").alias("days_both"),
                 F.sum(together).cast("bigint").alias("together"), F.sum(either).cast("bigint").alias("denom"))
            .filter(F.col("days_both") > 0)
            .withColumn("sri", ratio(F.col("together"), F.col("denom"))))


def pair_attributes(pairs: DataFrame, nodes: DataFrame, entity: str, diffs: Sequence[str],
                    pair_values: DataFrame | None = None, value: str | None = None, fill: float = 0.0) -> DataFrame:
    """Absolute attribute differences per pair, plus a listed pair value with
    ``fill`` for unlisted pairs. ``pairs`` has ``a`` and ``b``."""
    out = pairs
    for side in ("a", "b"):
        renamed = nodes.select(F.col(entity).alias(side), *[F.col(c).alias(f"_{c}_{side}") for c in diffs])
        out = out.join(renamed, side, "left")
    out = out.withColumns({f"diff_{c}": F.abs(F.col(f"_{c}_a") - F.col(f"_{c}_b")) for c in diffs})
    out = out.drop(*[f"_{c}_{s}" for c in diffs for s in ("a", "b")])
    if pair_values is not None:
        listed = pair_values.groupBy(F.least(entity, f"{entity}2").alias("a"),
                                     F.greatest(entity, f"{entity}2").alias("b")).agg(F.max(value).alias(value))
        out = out.join(listed, ["a", "b"], "left").fillna({value: fill})
    return out


def sociality_index(bouts: DataFrame, by: Sequence[str], groom: Column, near: Column, value: str = "minutes") -> DataFrame:
    """Composite index of a dyad: mean of its two rates over the mean rates.

    ``groom`` and ``near`` tell the two kinds of bouts apart. Dyads with one
    kind only count 0 in the other; the means are taken over the dyads of the
    same ``by`` group. Both sums come from one pass over the bouts.
    """
    by = list(by)
    part = lambda kind: F.sum(F.when(kind, F.col(value)).otherwise(0.0))
    dyads = bouts.filter(groom | near).groupBy(*by, "a", "b").agg(part(groom).alias("groom"), part(near).alias("near"))
    means = dyads.groupBy(*by).agg(F.avg("groom").alias("_mg"), F.avg("near").alias("_mn"))
    return (dyads.join(means, by)
            .withColumn("csi", (ratio(F.col("groom"), F.col("_mg")) + ratio(F.col("near"), F.col("_mn"))) / 2.0)
            .drop("_mg", "_mn"))


def standardize_pairs(pairs: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Standardise over all off-diagonal cells of the symmetric matrix.

    Each unordered pair fills two cells, which leaves the mean alone and turns
    the n-1 of the deviation into 2n-1.
    """
    stats = []
    for c in cols:
        n = F.count(c).cast("double")
        stats.append(F.struct(F.avg(c).alias("m"),
                              F.sqrt(F.var_pop(c) * 2.0 * n / (2.0 * n - 1.0)).alias("s")).alias(c))
    one = pairs.select(F.struct(*stats)).scalar()
    return pairs.withColumns({
        f"{c}_std": F.try_divide(F.col(c) - one.getField(c).getField("m"), one.getField(c).getField("s")) for c in cols})
