"""Manifest sources and sinks: JSON lines, tables by split, dotted columns and the incremental score cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veraframe.operators.manifests import SAMPLE_SCHEMA


def write_manifest(samples: DataFrame, path: str) -> None:
    """One JSON object a line, keys in alphabetical order."""
    samples.select(*sorted(samples.columns)).write.json(path)


def read_manifest_files(spark: SparkSession, path: str) -> DataFrame:
    """Samples with the fixed schema; unknown keys are dropped."""
    return spark.read.schema(SAMPLE_SCHEMA).json(path)


def write_by_split(rows: DataFrame, path: str, split: str, order: list[str], columns: list[str]) -> None:
    """Tables partitioned by split, with whitelisted columns, sorted within files."""
    rows.select(split, *columns).repartition(split, *order[:1]).sortWithinPartitions(split, *order).write.partitionBy(split).parquet(path)


def forbidden_columns(schema: T.StructType, allowed: set[str], prefix: str = "") -> list[str]:
    """Dotted names of a schema that are not allowed; no data is read."""
    out = []
    for f in schema.fields:
        name = prefix + f.name
        if isinstance(f.dataType, T.StructType):
            out += forbidden_columns(f.dataType, allowed, name + ".")
        elif name not in allowed:
            out.append(name)
    return out


def whitelisted(df: DataFrame, allowed: set[str]) -> DataFrame:
    """``df``, if its columns, nested ones by their dotted names, are all allowed; else the call fails without reading data."""
    bad = forbidden_columns(df.schema, allowed)
    if bad:
        raise ValueError(f"columns that are not allowed: {', '.join(bad)}")
    return df


def dotted(df: DataFrame) -> DataFrame:
    """Nested structs as flat columns with dotted names."""

    def walk(schema: T.StructType, at: str, name: str) -> list[Column]:
        out = []
        for f in schema.fields:
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, f"{at}`{f.name}`.", f"{name}{f.name}.")
            else:
                out.append(F.col(f"{at}`{f.name}`").alias(f"{name}{f.name}"))
        return out

    return df.select(*walk(df.schema, "", ""))


def cached_scores(frames: DataFrame, keys: list[str], path: str, tag: str, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Scores of all frames: those in the cache under ``tag``, and new ones for the rest, which are appended."""
    spark = frames.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    todo = frames
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        todo = frames.join(spark.read.parquet(path).filter(F.col("tag") == tag).select(*keys), keys, "left_anti")
    score(todo).withColumn("tag", F.lit(tag)).write.mode("append").partitionBy("tag").parquet(path)
    return spark.read.parquet(path).filter(F.col("tag") == tag).drop("tag").join(frames.select(*keys), keys, "left_semi")
