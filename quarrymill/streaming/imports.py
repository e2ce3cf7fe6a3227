"""Import of files one by one: read by format, harmonise, validate, save, and a log of what became of each."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators.validate import schema_problems
from quarrymill.session import write_text
from quarrymill.sources.columns import STANDARD, drop_unnamed, standardise
from quarrymill.sources.readers import load, too_long_rows
from quarrymill.sources.sinks import write_batches

LOG_ENTRIES = 1000
LOG_SCHEMA = "at timestamp, original string, output string, format string, records long, dropped long, success boolean, error string"


def stamped(path: str, kind: str, at: datetime) -> str:
    """The name under which a file's records are saved."""
    stem = os.path.splitext(os.path.basename(path))[0]
    return f"{stem}_{kind}_processed_{at:%Y%m%d_%H%M%S}"


def import_file(
    spark: SparkSession, path: str, folder: str, required: Sequence[str] = ("中文名称",), standard: Mapping[str, Sequence[str]] = STANDARD, at: datetime | None = None
) -> DataFrame | None:
    """The records of a file under standard names, also saved below ``folder``; None if it can't be imported.

    Rows without a value in a required column and rows with too many fields are dropped and counted. Failures leave a note, and every file a log entry.
    """
    at = at or datetime.now(timezone.utc)
    kind = os.path.splitext(path)[1].lstrip(".").lower()
    try:
        df = standardise(drop_unnamed(load(spark, path)), standard)
        missing = schema_problems(df, required).get("missing", [])
        if missing:
            raise ValueError(f"missing columns: {', '.join(missing)}")
        bare = [F.coalesce(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in required]
        kept = df
        for value in bare:
            kept = kept.where((value != "") & (F.lower(value) != "nan"))
        output = f"{folder}/processed/{stamped(path, kind, at)}"
        write_batches(kept, output, mark=True)
        records, every = kept.count(), df.count() + (too_long_rows(spark, path).count() if kind in ("csv", "tsv") else 0)
        _log(spark, folder, (at, path, output, kind, records, every - records, True, None))
        return kept
    except Exception as error:  # noqa: BLE001 - a bad file must not stop the others
        reason = str(error)[:500]
        write_text(spark, f"{folder}/failed/failed_{stamped(path, kind, at)}.txt", f"{path}\n{at.isoformat()}\n{reason}\n")
        _log(spark, folder, (at, path, None, kind, 0, 0, False, reason))
        return None


def _log(spark: SparkSession, folder: str, entry: tuple) -> None:
    spark.createDataFrame([entry], LOG_SCHEMA).write.mode("append").parquet(f"{folder}/import_log")


def import_log(spark: SparkSession, folder: str, limit: int = LOG_ENTRIES) -> DataFrame:
    """The most recent entries."""
    return spark.read.schema(LOG_SCHEMA).parquet(f"{folder}/import_log").orderBy(F.desc("at"), "original").limit(limit)


def import_statistics(log: DataFrame) -> DataFrame:
    """``format, files, succeeded, records, dropped`` by format."""
    return log.groupBy("format").agg(
        F.count("*").alias("files"), F.count_if("success").alias("succeeded"), F.sum("records").alias("records"), F.sum("dropped").alias("dropped")
    )
