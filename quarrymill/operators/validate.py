"""Validation, quality scores and run statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.operators.merge import usable

BOOLEANS = ["true", "false", "yes", "no", "1", "0", "是", "否"]


def flag_rules(df: DataFrame, rules: Mapping[str, Column], unique: Sequence[str], order: str) -> DataFrame:
    """Adds ``reasons``: the names of the rules a row breaks, ``duplicate`` for all but the first row of a key.

    The first row of each key comes from an aggregation and a join, so that a key with very many
    rows is no single window.
    """
    keys = [F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(f"__k{i}") for i, c in enumerate(unique)]
    keyed = df.select("*", *keys)
    names = [f"__k{i}" for i in range(len(unique))]
    firsts = keyed.groupBy(*names).agg(F.min(order).alias("__first"))
    joined = keyed.join(firsts, names)
    broken = [F.when(bad, F.lit(rule)) for rule, bad in rules.items()] + [F.when(F.col(order) > F.col("__first"), F.lit("duplicate"))]
    return joined.withColumn("reasons", F.array_compact(F.array(*broken))).drop("__first", *names)


def split_valid(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason; and one row per reason of the others."""
    return flagged.where(F.size("reasons") == 0).drop("reasons"), flagged.where(F.size("reasons") > 0).withColumn("reason", F.explode("reasons")).drop("reasons")


def type_violations(df: DataFrame, numeric: Sequence[str], boolean: Sequence[str] = ()) -> DataFrame:
    """``column, violations`` in one pass."""
    bad = {c: F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").cast("string").try_cast("double").isNull() for c in numeric}
    bad |= {c: F.col(f"`{c}`").isNotNull() & ~F.lower(F.col(f"`{c}`").cast("string")).isin(BOOLEANS) for c in boolean}
    return long_form(df.agg(*[F.count_if(b).alias(c) for c, b in bad.items()]), list(bad), "column", "violations")


def range_violations(df: DataFrame, limits: Mapping[str, tuple[float | None, float | None]]) -> DataFrame:
    """``column, below, above``."""
    pairs = []
    for c, (low, high) in limits.items():
        v = F.col(f"`{c}`").cast("double")
        pairs.append(F.count_if(v < low) if low is not None else F.lit(0).cast("long"))
        pairs.append(F.count_if(v > high) if high is not None else F.lit(0).cast("long"))
    row = df.agg(*[p.alias(f"p{i}") for i, p in enumerate(pairs)])
    found = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"p{2 * i}").alias("below"), F.col(f"p{2 * i + 1}").alias("above")) for i, c in enumerate(limits)])
    return row.select(F.inline(found))


def duplicate_values(df: DataFrame, column: str, samples: int = 10) -> DataFrame:
    """``duplicates`` beyond the first of each value, and the least values that repeat, at most ``samples``."""
    repeated = df.where(F.col(column).isNotNull()).groupBy(column).count().where("count > 1")
    total = repeated.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicates"))
    shown = ",".join(str(r[0]) for r in sorted((str(r[column]),) for r in repeated.orderBy(column).limit(samples).collect()))
    return total.withColumn("samples", F.lit(shown))


def long_form(row: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    """One row of counts as rows of name and value."""
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").alias(value)) for c in columns])))


def validation_score(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Share of the checks, over the whole table, that no row breaks, times 100."""
    row = df.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(c) for c, ok in checks.items()])
    passed = sum(((F.col(c) == 0).cast("int") for c in checks), F.lit(0))
    return row.select(*checks, F.round(passed * 100.0 / len(checks), 2).alias("score"))


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, filled``: rows with a usable value."""
    return long_form(df.agg(*[F.count(usable(F.col(f"`{c}`").cast("string"))).alias(c) for c in columns]), columns, "column", "filled")


def table_quality(df: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    """Weighted share of usable values; weights are scaled to the columns the table has."""
    present = {c: w for c, w in weights.items() if c in df.columns}
    total = sum(present.values()) or 1.0
    parts = [F.avg(usable(F.col(f"`{c}`").cast("string")).isNotNull().cast("double")) * (w / total) for c, w in present.items()]
    return df.agg(F.round(F.coalesce(sum(parts, F.lit(0.0)), F.lit(0.0)), 4).alias("quality"))


def record_quality(weights: Mapping[str, float], full_length: int = 50) -> Column:
    """Weights times a length factor, and a bonus of up to 0.2 for completeness."""
    score, filled = F.lit(0.0), F.lit(0)
    for c, w in weights.items():
        v = usable(F.col(f"`{c}`").cast("string"))
        score = score + F.when(v.isNotNull(), F.least(F.lit(1.0), F.length(v) / full_length) * w).otherwise(0.0)
        filled = filled + v.isNotNull().cast("int")
    return F.round(score + 0.2 * filled / len(weights), 4)


def moving_mean(df: DataFrame, group: str, order: str, value: str, width: int = 100) -> DataFrame:
    """Mean over the last ``width`` rows of each group, this one included."""
    from pyspark.sql import Window as W

    frame = W.partitionBy(group).orderBy(order).rowsBetween(-(width - 1), 0)
    return df.withColumn("moving_mean", F.avg(value).over(frame))


def schema_problems(df: DataFrame, required: Sequence[str], allowed: Sequence[str] | None = None) -> dict[str, list[str]]:
    """Missing required and, if ``allowed`` is given, unexpected columns."""
    return {
        "missing": [c for c in required if c not in df.columns],
        "unexpected": [c for c in df.columns if allowed is not None and c not in allowed and c not in required],
    }


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
