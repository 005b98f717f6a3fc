"""Order statistics that never sort a whole group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from rollcall.session import cut_lineage


def split_row_number(df: DataFrame, by: Sequence[str], order: Sequence[Column],
                     slices: Mapping[str, Column], name: str) -> DataFrame:
    """``row_number`` over (by, order), computed slice by slice.

    ``slices`` are columns that never decrease along ``order`` and are never
    null (a minute bin, an id range). A row's number is its place inside its
    slice plus the size of the earlier slices; only the short list of slice
    sizes is ordered per group, so a group holding a third of all rows is
    still sorted by many tasks. ``by`` columns must not be null.
    """
    cut = df.withColumns(dict(slices))
    keys = [*by, *slices]
    sizes = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_slice_n"))
    earlier = W.partitionBy(*by).orderBy(*slices).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_slice_n").over(earlier), F.lit(0))).drop("_slice_n")
    placed = cut.withColumn("_within", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return (placed.join(offsets, keys)
            .withColumn(name, (F.col("_within") + F.col("_before")).cast("bigint"))
            .drop("_within", "_before", *slices))


def sorted_row_number(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """``row_number`` over (by, order), by one sort over ranges of both together.

    A range is a partition: a group of any size, with any ties in its first
    columns, is dealt over many. The sorted rows are written once; a row's
    number is its place in its partition and the sizes of the group's parts in
    earlier ones, of which there are no more than groups and partitions.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*[F.col(c) for c in by], *order]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = cut_lineage(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
                        .withColumn("_part", F.spark_partition_id()).withColumn("_at", place))
    sizes = dealt.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*by, "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_before"))
    return (dealt.join(sizes, [*by, "_part"]).withColumn(name, (F.col("_at") + F.col("_before")).cast("bigint"))
            .drop("_part", "_at", "_before"))


def exact_quantiles(df: DataFrame, by: Sequence[str], col: str, probs: Mapping[str, float],
                    accuracy: int = 10_000, extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Linear-interpolation quantiles, exact, without buffering a group.

    Pass 1 keeps a bounded sketch per group and brackets every wanted rank.
    Pass 2 collapses the rows outside the brackets to two counters per quantile
    (map-side), and orders only the distinct values inside them, about
    ``20 / accuracy`` of the rows. A bracket that missed its rank fails the job
    rather than giving a near value. ``extra`` aggregates (a mean, a count)
    ride along in pass 1.
    """
    extra = dict(extra or {})
    by = list(by)
    margin = 10.0 / accuracy
    cuts = [c for p in probs.values() for c in (max(0.0, p - margin), min(1.0, p + margin))]
    clean = df.select(*by, F.col(col).cast("double").alias(col)).filter(F.col(col).isNotNull())
    sketch = [*[agg.alias(name) for name, agg in extra.items()], F.count(col).alias("_n"),
              F.percentile_approx(col, F.array(*[F.lit(c) for c in cuts]), F.lit(accuracy)).alias("_cuts")]
    if by:
        rows = clean.join(clean.groupBy(*by).agg(*sketch), by)
    else:
        rows = clean.withColumn("_s", clean.select(F.struct(*sketch)).scalar()).select(col, "_s.*")
    probe = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p"),
                 F.col("_cuts")[2 * i].alias("lo"), F.col("_cuts")[2 * i + 1].alias("hi"))
        for i, p in enumerate(probs.values())
    ])
    side = F.when(F.col("_v") < F.col("q.lo"), -1).when(F.col("_v") > F.col("q.hi"), 1).otherwise(0)
    carried = [F.first(name).alias(name) for name in extra]
    tallied = (
        rows.select(*by, *extra, F.col("_n").alias("n"), F.col(col).alias("_v"), F.explode(probe).alias("q"))
        .select(*by, *extra, "n", "_v", F.col("q.i").alias("i"), F.col("q.p").alias("p"), side.alias("side"))
        .groupBy(*by, "n", "i", "p", "side", F.when(F.col("side") == 0, F.col("_v")).alias("at"))
        .agg(F.count(F.lit(1)).alias("c"), F.min("_v").alias("low"), F.max("_v").alias("high"), *carried)
    )
    run = W.partitionBy(*by, "i").orderBy("side", "at").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = tallied.withColumn("upto", F.sum("c").over(run)).withColumn("h", (F.col("n") - 1) * F.col("p"))

    def statistic(rank: Column) -> Column:
        """Value at a 1-based rank; only the row whose run covers it answers."""
        covers = (F.col("upto") >= rank) & (F.col("upto") - F.col("c") < rank)
        known = (F.when(F.col("side") == 0, F.col("at"))
                 .when((F.col("side") == -1) & (F.col("upto") == rank), F.col("high"))
                 .when((F.col("side") == 1) & (F.col("upto") - F.col("c") + 1 == rank), F.col("low"))
                 .otherwise(F.raise_error(F.lit("quantile bracket missed its rank")).cast("double")))
        return F.max(F.when(covers, known))

    k = F.floor("h") + 1
    picked = placed.groupBy(*by, "i").agg(
        statistic(k).alias("x0"), statistic(F.least(k + 1, F.col("n"))).alias("x1"), F.max("h").alias("h"), *carried)
    value = F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("h") - F.floor("h"))
    return picked.groupBy(*by).agg(*[
        F.max(F.when(F.col("i") == i, value)).alias(name) for i, name in enumerate(probs)
    ], *carried)


def scale_by_max(df: DataFrame, col: str, by: Sequence[str], name: str, reference: DataFrame | None = None) -> DataFrame:
    """``col`` over its maximum in the group, by an aggregate joined back
    (the maximum is combined map-side, so a hot group is not gathered).
    ``reference`` may name a cheaper table with the same maxima."""
    top = (df if reference is None else reference).groupBy(*by).agg(F.max(col).alias("_top"))
    return df.join(top, list(by)).withColumn(name, F.try_divide(F.col(col).cast("double"), F.col("_top"))).drop("_top")
