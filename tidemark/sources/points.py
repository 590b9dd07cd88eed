"""Telemetry scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schema import FEATURE_TABLE, FRAME, POINTS, require_columns

BOM = "﻿"


def read_points(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Point table with the fixed schema; filters and columns reach a Parquet scan."""
    if fmt == "csv":
        return read_csv_by_name(spark, path, POINTS)
    return spark.read.schema(POINTS).format(fmt).load(path)


def read_features(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    if fmt == "csv":
        return read_csv_by_name(spark, path, FEATURE_TABLE)
    return require_columns(spark.read.schema(FEATURE_TABLE).format(fmt).load(path), FEATURE_TABLE.names)


def read_csv_by_name(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header; columns are found by name, a byte order mark before the first name is dropped."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    names = {c.lstrip(BOM).strip(): c for c in raw.columns}
    missing = [f.name for f in schema if f.name not in names]
    if missing:
        raise ValueError(f"missing columns: {missing}")

    def typed(f: T.StructField) -> Column:
        text = F.trim(F.col(f"`{names[f.name]}`"))
        if isinstance(f.dataType, T.TimestampType):
            return F.try_to_timestamp(text).alias(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.LongType)):
            flag = F.when(F.lower(text) == "true", 1).when(F.lower(text) == "false", 0)
            return F.coalesce(flag, text.try_cast("double")).cast(f.dataType).alias(f.name)
        return text.try_cast(f.dataType).alias(f.name)

    return raw.select(*[typed(f) for f in schema])


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def from_epoch(seconds: Column) -> Column:
    return F.timestamp_micros((seconds * F.lit(1e6)).cast("long"))


def frames_to_points(frames: DataFrame) -> DataFrame:
    """Live frames to the point layout."""
    return frames.select(
        "channel", from_epoch(F.col("ts")).alias("timestamp"), "value",
        F.col("segment_id").alias("segment"), F.coalesce("sampling", F.lit(1)).alias("sampling"))


def stream_frames(spark: SparkSession, path: str, fmt: str = "json", **options: str) -> DataFrame:
    """Live frames from files that arrive in a folder; other stream formats by name and options."""
    reader = spark.readStream.format(fmt).options(**options)
    return reader.schema(FRAME).load(path)
