"""Incremental processing: changed files by content hash, batch by batch, resumable.

The registry of what was processed is a table of (path, hash). A file whose content changed counts
as new, which a file stream alone, remembering paths, would not see.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators.tables import pending_rows


def fingerprints(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """``path, hash`` of the files below a folder; contents are hashed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return files.select("path", F.md5("content").alias("hash"))


def registry(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema("path string, hash string").parquet(path)
    except Exception:  # noqa: BLE001 - no registry yet
        return spark.createDataFrame([], "path string, hash string")


def run_new_files(spark: SparkSession, folder: str, registry_path: str, handle: Callable[[DataFrame, Sequence[str]], None], pattern: str = "*.csv") -> int:
    """Hands the new and changed files to ``handle`` and registers them only after it returned. Returns how many."""
    fresh = pending_rows(fingerprints(spark, folder, pattern), registry(spark, registry_path), ["path", "hash"])
    found = [(r["path"], r["hash"]) for r in fresh.orderBy("path").collect()]
    if found:
        done = spark.createDataFrame(found, "path string, hash string")
        handle(done, [p for p, _ in found])
        done.write.mode("append").parquet(registry_path)
    return len(found)


def stream_table(
    spark: SparkSession, folder: str, schema: str, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, file_format: str = "parquet"
) -> int:
    """Processes the files that arrived since the last call and appends the result; returns the rows written.

    The checkpoint makes each file count once, also after a failure between the write and its commit:
    a batch is written under its own number and overwritten when it is repeated.
    """
    written = [0]

    def write(batch: DataFrame, number: int) -> None:
        result = transform(batch)
        target = f"{out}/batch={number}"
        result.write.mode("overwrite").parquet(target)
        written[0] += spark.read.parquet(target).count() if result.columns else 0

    query = (
        spark.readStream.format(file_format)
        .schema(schema)
        .load(folder)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return written[0]


def windowed_counts(events: DataFrame, stamp: str, kind: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums per time window and kind; rows later than ``late`` are left out of closed windows in a stream."""
    return events.withWatermark(stamp, late).groupBy(F.window(stamp, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
