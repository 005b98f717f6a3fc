"""Query registry: a Spark plan and, where SQL can say it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.plans.sqlbase import with_bases
from rollcall.session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ROWS: dict[str, str] = {}
#: Called before each query is planned.
ON_START: list[Callable[[], None]] = []


def comparable(df: DataFrame) -> DataFrame:
    """Types that compare across engines: six decimals, bigint, day as text."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(rows: str, sql: str | None = None):
    """Register a plan under its function name. ``rows`` names the survey rows
    it covers; ``sql`` is the oracle body over the base tables."""

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        name = fn.__name__.rstrip("_")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            ship(spark)
            for start in ON_START:
                start()
            return comparable(fn(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        ROWS[name] = rows
        if sql is not None:
            ORACLES[name] = with_bases(sql)
        return fn

    return wrap
