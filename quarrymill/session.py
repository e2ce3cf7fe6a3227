"""Session, table and checkpoint helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks. On a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quarrymill")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the session's ``spark.checkpoint.dir``, else one of our own.

    A private temporary folder is made only where the setting is absent and all runs on one machine, as in local
    tests; a cluster has to name a folder that all of its executors share.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarrymill-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def tokenizer_folder() -> str:
    return os.environ.get("QUARRYMILL_TOKENIZERS", "/opt/tokenizers")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of any file system that the session reaches, None if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file beside its place and moves it there, so that a reader never sees a part of it."""
    jvm = spark._jvm.org.apache.hadoop.fs
    new, final = jvm.Path(path + ".new"), jvm.Path(path)
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(new, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(final, False)
    fs.rename(new, final)
