"""Document scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def markdown_files(spark: SparkSession, folder: str, metadata: DataFrame) -> DataFrame:
    """Whole Markdown files with source name, priority and language by file name."""
    files = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).text(folder, wholetext=True).select(
        F.element_at(F.split(F.input_file_name(), "/"), -1).alias("filename"), F.col("value").alias("text"))
    return files.join(metadata, "filename").withColumn("page", F.lit(0))


def paged_documents(pages: DataFrame, metadata: DataFrame, key: str = "filename") -> DataFrame:
    """Page texts with the metadata of their document."""
    return pages.join(metadata, key)


def count_by_extension(spark: SparkSession, folder: str, known: tuple[str, ...] = ("pdf", "md", "html")) -> DataFrame:
    """Files per known extension, zeros included; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    counted = files.groupBy(ext.alias("ext")).agg(F.count(F.lit(1)).alias("n"))
    listed = spark.createDataFrame([(k,) for k in known], "ext string")
    return listed.join(counted, "ext", "left").select("ext", F.coalesce("n", F.lit(0)).alias("n"))
