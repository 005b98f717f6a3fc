"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.session import release, shared_table


def _large(links: DataFrame) -> DataFrame:
    """Larger neighbours of a node point to the smallest of its neighbourhood."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of these."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return (links.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))))


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each linked node reaches.

    ``links`` has long columns u and v; direction and repetition don't matter.
    Every round is a table in the shared folder, removed once the next one is
    written, and rounds go on until the links no longer change, when each points
    to its label. Minima are combined
    before the shuffle, so a hub costs no task more than its rows. Nodes
    without a link to another node are not in the result.
    """
    down = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    down, seen = shared_table(down), None
    while True:
        now = down.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen or not now[0]:
            return down.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
                down.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
        seen = now
        done, down = down, shared_table(_small(_large(down).distinct()).distinct())
        release(done)
