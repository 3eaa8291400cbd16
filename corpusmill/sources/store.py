"""JSON files of documents: tolerant reading, and a sink that replaces what it has under an id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Documents of a folder; files that aren't JSON are skipped."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    full = T.StructType([*wanted.fields, T.StructField("_corrupt_record", T.StringType())])
    read = spark.read.schema(full).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).json(path)
    return read.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def write_json(docs: DataFrame, path: str, partition: str | None = None) -> None:
    """Writes JSON lines. With `partition`, only the partitions that occur in `docs` are replaced."""
    writer = docs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(partition) if partition else writer).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("sep", ";").option("header", True).csv(path)
