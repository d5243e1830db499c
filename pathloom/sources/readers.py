"""Documents from files and streams, and results to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_json_texts(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """One document per line, as JSON text in column resource."""
    reader = spark.readStream if stream else spark.read
    return reader.format("text").load(path).withColumnRenamed("value", "resource")


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str | None = None, stream: bool = False) -> DataFrame:
    """One JSON document per line, typed by schema (without one, batch reads infer it)."""
    reader = spark.readStream if stream else spark.read
    return (reader.schema(schema) if schema is not None else reader).json(path)


def read_parquet(spark: SparkSession, path: str, stream: bool = False, schema: T.StructType | None = None) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path) if stream else spark.read.parquet(path)


def parse(df: DataFrame, schema: T.StructType | str, col: str = "resource", to: str = "document") -> DataFrame:
    """df with its JSON text parsed once into a struct; malformed text gives null."""
    return df.withColumn(to, F.from_json(col, schema))


def explode_array_roots(df: DataFrame, col: str = "resource") -> DataFrame:
    """JSON arrays at the root become one row per element; other roots stay."""
    elements = F.from_json(F.col(col), "array<variant>")
    is_array = F.ltrim(F.col(col)).startswith("[")
    return df.withColumn(col, F.explode(F.when(is_array, F.transform(elements, lambda v: F.to_json(v))).otherwise(F.array(col))))


def bundle_entries(df: DataFrame, col: str = "entry") -> DataFrame:
    """One row per entry of a bundle's entry array, with the columns of its resource."""
    return df.select(F.explode(col).alias("_entry")).select("_entry.resource.*")


def write(df: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    df.write.format(form).mode(mode).save(path)
