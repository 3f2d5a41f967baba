"""Reading and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.operators.buckets import join_same
from tidemill.session import scratch_path


def scan_csv(spark: SparkSession, path, schema: str, header: bool = True) -> DataFrame:
    """CSV with a declared schema: no pass over the data to guess types."""
    reader = spark.read.schema(schema).option("header", header)
    return reader.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(path)


def scan_csv_by_name(
    spark: SparkSession, path, schema: str, name_pattern: str, key: str, header: bool = True
) -> DataFrame:
    """Many files at once, with the series key cut out of each file's path by `name_pattern`."""
    label = F.regexp_extract(F.col("_metadata.file_path"), name_pattern, 1)
    return scan_csv(spark, path, schema, header).withColumn(key, label)


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("overwrite").option("header", True)
    writer = writer.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def usable_sources(frames: dict[str, DataFrame], required: Sequence[str]) -> dict[str, DataFrame]:
    """The sources that have every required column; decided from schemas, no data is read."""
    return {name: df for name, df in frames.items() if not missing_columns(df, required)}


def missing_parts(df: DataFrame, key: str, part: str, expected: Sequence) -> DataFrame:
    """(key, part) pairs that are expected but hold no rows."""
    present = df.select(key, part).distinct()
    wanted = present.select(key).distinct().select(
        key, F.explode(F.array(*[F.lit(p) for p in expected])).alias(part)
    )
    return join_same(wanted, present, [key, part], "left_anti")


def write_json(df: DataFrame, path: str) -> None:
    """Metrics or parameter rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def materialise(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a stage as Parquet and read it back: cuts lineage and feeds pruned scans."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    reader = df.sparkSession.read
    return (reader if partition_by else reader.schema(df.schema)).parquet(path)


def kept(df: DataFrame, label: str) -> DataFrame:
    """A stage that several later steps read, stored once in the shared scratch folder."""
    return materialise(df, scratch_path(df.sparkSession, label))
