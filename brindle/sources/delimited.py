"""Delimited files: fields parted by |, no header; a field after the last column is ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.sources.catalog import TableMeta


def read(spark: SparkSession, path: str, table: TableMeta) -> DataFrame:
    """The file's fields as the table's columns; a field that is not of its column's type is an error when rows are read."""
    schema = T.StructType([T.StructField(c.name, T.StringType()) for c in table.columns] + [T.StructField("_trail", T.StringType())])
    found = spark.read.csv(path, sep="|", schema=schema, mode="PERMISSIVE", enforceSchema=True, quote="\0", nullValue="\0")
    return found.select([F.col(f"`{c.name}`").cast(c.type).alias(c.name) for c in table.columns])
