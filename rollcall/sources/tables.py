"""Reading and writing tables. Sheets of a workbook are tables of their own here."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Explicit schemas of the long input tables.
PERIOD_SCHEMAS: dict[str, str] = {
    "att": "study_period string, entity string, age int, rank int",
    "rank": "entity string, age int, rank int",
    "kin": "entity string, entity2 string, kin double",
    "female_all": "date date, entity string, rs2 int",
    "male_all": "date date, entity string, presence int",
    "aggression_all": "no int, date date, study_period string, aggressor string, entity string",
    "focal_combined": "no_focal string, date date, subject string, time double",
    "draws": "chain int, iteration int, variable string, value double",
}


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """CSV with a header; 'NA' is null. Without a stated schema one pass over all rows finds the types."""
    return spark.read.csv(path, header=True, schema=schema, inferSchema=schema is None, nullValue="NA")


def read_sheets(spark: SparkSession, paths: Mapping[str, str], schema: str | T.StructType | None = None,
                fmt: str = "csv") -> dict[str, DataFrame]:
    """One table per sheet name, from CSV or Parquet folders."""
    if fmt == "parquet":
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return {name: reader.parquet(path) for name, path in paths.items()}
    return {name: read_csv(spark, path, schema) for name, path in paths.items()}


def stack_periods(tables: Mapping[str, DataFrame], column: str = "period") -> DataFrame:
    """Same-shaped tables stacked by name, each tagged; absent columns are null."""
    out = None
    for tag, df in tables.items():
        tagged = df.withColumn(column, F.lit(tag))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    if out is None:
        raise ValueError("no tables to stack")
    return out


def read_periods(spark: SparkSession, path: str, column: str = "period", wanted=None, schema: str | T.StructType | None = None) -> DataFrame:
    """One read of a folder with a partition per period, tagged by ``column``; of the wanted periods alone, if given."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df if wanted is None else df.filter(F.col(column).isin(list(wanted)))


def save_result(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Keep a result for later runs."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def load_result(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
