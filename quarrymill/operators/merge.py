"""Group merge with a policy per field, conflict resolution and continuation rows.

All policies are aggregations with partial results on the map side: a name that holds a large part
of all rows costs its partial aggregates, never a list of its rows in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.vocab import NO_VALUE


def usable(value: Column, no_value: Sequence[str] = tuple(NO_VALUE)) -> Column:
    """The trimmed value, null if it stands for none."""
    bare = F.trim(value)
    return F.when(~bare.isin(list(no_value)), bare)


def first_value(value: Column, order: Column) -> Column:
    v = usable(value)
    return F.min_by(v, F.when(v.isNotNull(), order))


def longest_value(value: Column, order: Column) -> Column:
    """The longest; of equally long ones the earliest."""
    v = usable(value)
    return F.max_by(v, F.when(v.isNotNull(), F.struct(F.length(v), -order)))


def severest_value(value: Column, order: Column, ranks: Mapping[str, int]) -> Column:
    """The value of the highest rank that it mentions; the earliest of equal ones; unranked values count least."""
    v = usable(value)
    rank = F.lit(0)
    for word, level in sorted(ranks.items(), key=lambda x: x[1]):
        rank = F.when(v.contains(word), level).otherwise(rank)
    return F.max_by(v, F.when(v.isNotNull(), F.struct(rank, -order)))


def set_join(df: DataFrame, keys: Sequence[str], value: str, separator: str = "; ") -> DataFrame:
    """Distinct trimmed values per key, sorted and joined. Values are made distinct before they are gathered."""
    pairs = df.select(*keys, usable(F.col(f"`{value}`")).alias("v")).where("v is not null").distinct()
    return pairs.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("v")), separator).alias(value))


def alias_union(df: DataFrame, keys: Sequence[str], value: str, order: str, separators: str = "[,;，；、]", joiner: str = ";") -> DataFrame:
    """Distinct parts of a packed field per key, in order of first appearance."""
    parts = df.select(*keys, F.col(order).alias("o"), F.posexplode(F.split(usable(F.col(f"`{value}`")), separators)).alias("i", "p"))
    firsts = parts.select(*keys, F.trim("p").alias("p"), F.struct("o", "i").alias("at")).where("p <> ''").groupBy(*keys, "p").agg(F.min("at").alias("at"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "p")))
    return firsts.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["p"]), joiner).alias(value))


def merge_records(df: DataFrame, keys: Sequence[str], order: str, policies: Mapping[str, str], ranks: Mapping[str, int] | None = None) -> DataFrame:
    """One record per key. Policies by column: ``first, longest, severity, set, alias``; ``n_rows`` counts the rows."""
    o = F.col(order)
    plain = {"first": lambda c: first_value(c, o), "longest": lambda c: longest_value(c, o), "severity": lambda c: severest_value(c, o, ranks or {})}
    aggregates = [plain[p](F.col(f"`{c}`")).alias(c) for c, p in policies.items() if p in plain]
    out = df.groupBy(*keys).agg(F.count("*").alias("n_rows"), *aggregates)
    for column, policy in policies.items():
        if policy == "set":
            out = out.join(set_join(df, keys, column), list(keys), "left")
        elif policy == "alias":
            out = out.join(alias_union(df, keys, column, order), list(keys), "left")
    return out


def identifier_score(ident: Column, bonuses: Sequence[tuple[Column, float]] = ()) -> Column:
    """The score of one record for its id: 10 for a well-formed id, 2 for a serial of three digits or more, half a point
    for the record itself, and the weight of every bonus (condition, weight) that holds."""
    form = F.when(ident.rlike("^[0-9]{2,7}-[0-9]{2}-[0-9]$"), 10.0).when(ident.rlike("^[0-9]{3,}$"), 2.0).otherwise(0.0)
    return sum((F.when(condition, weight).otherwise(0.0) for condition, weight in bonuses), form + F.lit(0.5))


def record_bonuses(formula: Column, weight: Column, english: Column, use: Column, source: Column) -> list[tuple[Column, float]]:
    """What a full record adds to the score of its id."""
    some = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return [(some(formula), 1.0), (some(weight), 0.5), (some(english), 1.0), (F.coalesce(F.length(F.trim(use)) > 5, F.lit(False)), 0.5), (some(source), 0.5)]


def resolve_conflicts(df: DataFrame, name: str, ident: str, order: str, score: Column) -> DataFrame:
    """Per name the id with the highest sum of scores; of equal ones the one met first."""
    sums = df.groupBy(name, ident).agg(F.sum(score).alias("score"), F.min(order).alias("first_seen"), F.count("*").alias("n"))
    best = F.max_by(F.struct(F.col(ident), F.col("score")), F.struct(F.col("score"), -F.col("first_seen")))
    return sums.groupBy(name).agg(F.count("*").alias("candidates"), best.alias("b")).select(name, "candidates", F.col(f"b.{ident}").alias(ident), F.col("b.score").alias("score"))


def continue_rows(df: DataFrame, group: str, pos: str, text: str, blank: Column, chunk: int = 4096, every: bool = False) -> DataFrame:
    """Rows that continue the one before them are merged into it.

    ``blank`` marks a continuation row. By default the text of a single following blank row is taken
    over and further ones are dropped; with ``every`` all of a run are. ``pos`` is dense within a
    group. Rows are looked up by (group, place), so a large group is spread over tasks; for runs,
    only one summary per ``chunk`` rows is ordered within its group.
    """
    from pyspark.sql import Window as W

    base = df.withColumn("__blank", F.coalesce(blank, F.lit(True)))
    if not every:
        following = base.where("__blank").select(F.col(group), (F.col(pos) - 1).alias(pos), F.col(text).alias("__next"))
        kept = base.where(~F.col("__blank")).join(following, [group, pos], "left")
    else:
        part = F.floor(F.col(pos) / chunk).alias("__chunk")
        with_chunk = base.withColumn("__chunk", part)
        inside = W.partitionBy(group, "__chunk").orderBy(pos)
        local = with_chunk.withColumn("__head", F.last(F.when(~F.col("__blank"), F.col(pos)), ignorenulls=True).over(inside))
        summary = with_chunk.groupBy(group, "__chunk").agg(F.max(F.when(~F.col("__blank"), F.col(pos))).alias("__top"))
        before = W.partitionBy(group).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
        carried = summary.withColumn("__carry", F.last("__top", ignorenulls=True).over(before)).drop("__top")
        headed = local.join(carried, [group, "__chunk"]).withColumn("__head", F.coalesce("__head", "__carry"))
        runs = headed.where("__blank and __head is not null").groupBy(F.col(group), F.col("__head").alias(pos))
        gathered = runs.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda x: x[text]), "").alias("__next"))
        kept = base.where(~F.col("__blank")).join(gathered, [group, pos], "left")
    return kept.withColumn(text, F.concat(F.coalesce(F.col(text), F.lit("")), F.coalesce("__next", F.lit("")))).drop("__blank", "__next")
