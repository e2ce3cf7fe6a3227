"""Whole-table operators: unions, differences, incremental sets, batches, skeletons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators.catalogue import keep_first
from quarrymill.vocab import PLACEHOLDER


def union_all(frames: Sequence[DataFrame], source: str = "source_no") -> DataFrame:
    """Union by name with missing columns null and the ordinal of the frame."""
    tagged = [f.withColumn(source, F.lit(i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for f in tagged[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_distinct(frames: Sequence[DataFrame], key: str, order: str, last: bool = False) -> DataFrame:
    """Union with one row per key: of the first frame that has it, or of the last; blank keys are skipped."""
    both = union_all(frames).where((F.trim(F.col(key)) != "") & (F.col(key) != "nan"))
    ranked = both.withColumn("__ord", F.struct("source_no", order))
    return keep_first(ranked, [key], "__ord", last=last).drop("__ord")


def pending_rows(df: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not among those done: resume after a stop."""
    return df.join(done.select(*keys).distinct(), list(keys), "left_anti")


def changed_rows(df: DataFrame, registry: DataFrame, key: str, fingerprint: Column) -> DataFrame:
    """Rows that are new or whose content differs from what the registry (``key, hash``) remembers."""
    return df.withColumn("hash", fingerprint).join(registry.select(key, "hash").distinct(), [key, "hash"], "left_anti")


def unexpired(df: DataFrame, stamp: str, seconds: int, now: Column) -> DataFrame:
    return df.where(F.col(stamp) + F.make_interval(secs=F.lit(seconds)) >= now)


def missing_numbers(df: DataFrame, number: str, bits: int = 13, blocks: int = 1024) -> DataFrame:
    """Integers between the least and the greatest that do not occur; those two are found at once, by a job of its own.

    The range is cut into blocks of 2 ** ``bits`` numbers. A block is a row until the end, dealt to tasks of about
    ``blocks`` blocks and joined with the numbers that occur in it. Spark gathers all that a row is exploded to, by all
    generators of a stage, before it passes any of it on: so there is one generator, behind the exchange, and a task
    holds the numbers of one block at a time, however wide a gap is.
    """
    n = F.col(number).cast("long")
    least, greatest = df.agg(F.min(n), F.max(n)).first()
    if least is None:
        return df.select(number).limit(0)
    first, last = least >> bits, greatest >> bits
    parts = min((last - first) // blocks + 1, 10_000)
    known = df.where(F.col(number).isNotNull()).groupBy(F.shiftright(n, bits).alias("b")).agg(F.collect_set(n).alias("known"))
    cut = df.sparkSession.range(first, last + 1).select(F.col("id").alias("b")).repartition(parts, "b")
    begin = F.shiftleft("b", bits)
    whole = F.sequence(F.greatest(begin, F.lit(least).cast("long")), F.least(begin + ((1 << bits) - 1), F.lit(greatest).cast("long")))
    free = F.when(F.col("known").isNull(), whole).otherwise(F.array_except(whole, "known"))
    every = cut.join(known, "b", "left").select(F.explode(free).alias(number))
    return every.select(F.col(number).cast(df.schema[number].dataType).alias(number))


def number_batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """``batch`` of consecutive rows by a dense 1-based ``order``."""
    return df.withColumn("batch", F.floor((F.col(order) - 1) / size).cast("int"))


def batch_number(path: Column) -> Column:
    """The number in a file name: ``final_processed…part_N``, else ``batch_N``, else ``part_N``, else 0."""
    found = [F.regexp_extract(path, p, 1) for p in (r"final_processed.*part_([0-9]+)", r"batch_([0-9]+)", r"part_([0-9]+)", r"_([0-9]+)\.csv$")]
    return F.coalesce(*[F.nullif(f, F.lit("")).cast("int") for f in found], F.lit(0))


def skeleton(spark: SparkSession, names: DataFrame, name: str, attributes: Sequence[str]) -> DataFrame:
    """Distinct names with a placeholder in every attribute."""
    return names.select(name).where(F.trim(name) != "").distinct().select(name, *[F.lit(PLACEHOLDER).alias(a) for a in attributes])


def merge_alias(df: DataFrame, alias: str, into: str, joiner: str = "；") -> DataFrame:
    """Appends one column to another unless it is already a member of it."""
    a, b = F.trim(F.col(alias)), F.trim(F.col(into))
    member = F.array_contains(F.split(b, "；"), a) | F.array_contains(F.split(b, ";"), a)
    merged = F.when(F.coalesce(a, F.lit("")) == "", b).when(F.coalesce(b, F.lit("")) == "", a).when(member, b).otherwise(F.concat(b, F.lit(joiner), a))
    return df.withColumn(into, merged)
