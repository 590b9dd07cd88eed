"""Stored result documents and record logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def result_documents(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Documents called ``name`` in the folder or one level below; the direct one comes first."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(folder, wholetext=True).select(
        F.input_file_name().alias("path"), F.col("value").alias("document"))
    base = F.lit(folder.rstrip("/").rsplit("/", 1)[-1])
    parent = F.element_at(F.split("path", "/"), -2)
    depth = F.when(parent == base, 0).when(F.element_at(F.split("path", "/"), -3) == base, 1)
    return found.withColumn("depth", depth).filter(F.col("depth").isNotNull()).orderBy("depth", "path")


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON record per line; malformed lines become NULL rows."""
    return spark.read.schema(schema).json(path)


def result_runs(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Provenance of a result's runs: name, run, meta, saved_at."""
    return spark.read.schema("name string, run string, meta string, saved_at string").json(f"{folder}/runs").filter(F.col("name") == name)


def latest_result(spark: SparkSession, folder: str, name: str) -> tuple[DataFrame, DataFrame] | None:
    """Provenance row and rows of the newest run of a result; None where there is none."""
    runs = result_runs(spark, folder, name)
    newest = runs.agg(F.max("run")).first()[0]
    return (runs.filter(F.col("run") == newest), spark.read.parquet(f"{folder}/rows/{name}/{newest}")) if newest else None
