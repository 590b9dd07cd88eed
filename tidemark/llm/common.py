"""What the corpus operators share: word rule, stored intermediate tables, running totals over hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only a local session without that setting gets one of its own."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    set_by_hand = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_by_hand.isDefined():
        return set_by_hand.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    spark.sparkContext.setCheckpointDir(own)
    return own


class Shelf:
    """Parquet tables of one run of an operator in the shared folder; they go when the application ends.

    A stored table cuts the lineage: a lost executor costs a reread of a file, and what is read several times is
    computed once.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = f"{shared_folder(spark).rstrip('/')}/tidemark-{name}-{uuid.uuid4().hex}"
        self._files(self.folder).mkdirs(self._path(self.folder))  # only what exists can be marked
        self._files(self.folder).deleteOnExit(self._path(self.folder))

    def _path(self, folder: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(folder)

    def _files(self, folder: str):
        return self._path(folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
        df.write.mode("overwrite").option("compression", codec).parquet(f"{self.folder}/{label}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{label}")

    def drop(self, label: str) -> None:
        self._files(self.folder).delete(self._path(f"{self.folder}/{label}"), True)


def small(df: DataFrame, most: int = 1 << 25) -> DataFrame:
    """Broadcast where the rows' counted size permits it, else left to a shuffle join. df: stored."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if kind == "string" else F.lit(8) for c, kind in df.dtypes), F.lit(32))
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= most else df


def slices_for(df: DataFrame, rows: int, per_slice: int = 200_000) -> int:
    """Into how many slices a key may have to be cut: by rows, and no fewer than a shuffle has partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_slice))


def running_total(df: DataFrame, keys: list[str], slice_: Column, order: list[Column], value: Column, out: str) -> DataFrame:
    """The sum of ``value`` over the rows of the same keys that come before, in the order (slice, order).

    No key meets in one task: every slice of a key is summed first, the sums of a key's slices are added up, and the
    rows of one slice are ordered by themselves.
    """
    cut = df.withColumns({"_slice": slice_, "_value": value})
    sums = cut.groupBy(*keys, "_slice").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s"),
                       F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_slice") == F.col("_s")]
    return placed.join(base, on).withColumn(out, F.col("_base") + F.col("_inside")).select(*df.columns, out)
