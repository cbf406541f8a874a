"""Sinks that a repeated run leaves as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from korpuskel.operators.registry import new_rows


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path of any file system that the session knows."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def append_new(rows: DataFrame, path: str, key: list[str], order: list[str]) -> None:
    """Appends to the Parquet table at ``path`` the first row of each key that it doesn't hold yet."""
    spark = rows.sparkSession
    stored = spark.read.parquet(path) if exists(spark, path) else rows.limit(0)
    new_rows(rows, stored, key, order).write.mode("append").parquet(path)


def write_by_digest(rows: DataFrame, content: Column, path: str) -> DataFrame:
    """Writes each distinct content under its SHA-256, in folders by its first two digits; returns ``rows`` with the digest.

    Contents already there are left alone, so the store only grows.
    """
    digest = F.sha2(content, 256)
    blobs = rows.where(content.isNotNull()).select(digest.alias("sha256"), content.alias("content"), F.substring(digest, 1, 2).alias("shard")).dropDuplicates(["sha256"])
    if exists(rows.sparkSession, path):
        blobs = blobs.join(rows.sparkSession.read.parquet(path).select("sha256"), "sha256", "left_anti")
    blobs.write.mode("append").partitionBy("shard").parquet(path)
    return rows.withColumn("sha256", digest)


def damaged_blobs(spark: SparkSession, path: str) -> DataFrame:
    """Contents of a store by digest that no longer have their digest."""
    return spark.read.parquet(path).where(F.sha2("content", 256) != F.col("sha256")).select("sha256")


def write_report(report: DataFrame, path: str) -> None:
    """A small report as JSON lines: written beside its place, then renamed into it, so a reader never sees half of it."""
    spark = report.sparkSession
    beside = f"{path}.new"
    report.coalesce(1).write.mode("overwrite").json(beside)
    place, fresh = spark._jvm.org.apache.hadoop.fs.Path(path), spark._jvm.org.apache.hadoop.fs.Path(beside)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    system.delete(place, True)
    if not system.rename(fresh, place):
        raise OSError(f"could not rename {beside}")


def produce(rows: DataFrame, path: str, key: list[str], make, per_run: int | None = None) -> DataFrame:
    """Makes and appends what the table at ``path`` lacks, and returns it: a run that was cut off goes on where it was.

    ``make`` turns rows into results with the same keys. ``per_run`` bounds the
    rows of one run by their key's order; null keys are left out.
    """
    spark = rows.sparkSession
    waiting = rows.dropna(subset=key).dropDuplicates(key)
    if exists(spark, path):
        waiting = waiting.join(spark.read.parquet(path).select(*key), key, "left_anti")
    make(waiting.orderBy(*key).limit(per_run) if per_run else waiting).write.mode("append").parquet(path)
    return spark.read.parquet(path)
