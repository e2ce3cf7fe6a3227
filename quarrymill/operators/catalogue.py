"""Matching an entity list against a reference catalogue, and lookups of names within names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import collapse_blanks

BRACKET = r"\[([^\]]*)\]"


def keep_first(df: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """One row per key: the first (or last) by ``order``. An aggregation with map-side combine, so a hot key is no hot task.

    Null keys are equal to each other; ties of ``order`` are broken by nothing, so it has to be unique.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    pick = F.max_by if last else F.min_by
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(pick(whole, F.col(f"`{order}`")).alias("__row")).select("__row.*")


def prepare_catalogue(df: DataFrame, name: str, alias: str, ident: str, order: str) -> DataFrame:
    """``ref_name, ref_alias, threshold, ref_id, ref_order``: blanks collapsed, threshold split from the name, first of each name."""
    flat = collapse_blanks(F.col(f"`{name}`"))
    clean = df.select(
        F.trim(F.regexp_replace(flat, BRACKET, "")).alias("ref_name"),
        F.col(f"`{alias}`").alias("ref_alias"),
        F.regexp_extract(flat, BRACKET, 1).alias("threshold"),
        F.nullif(F.regexp_replace(F.col(f"`{ident}`"), r"[ \t\n\r\f]", ""), F.lit("")).alias("ref_id"),
        F.col(f"`{order}`").alias("ref_order"),
    ).where("ref_name <> ''")
    return keep_first(clean, ["ref_name"], "ref_order")


def match_reference(data: DataFrame, catalogue: DataFrame, key: str, name: str, ident: str, keep_alias: str | None = None) -> DataFrame:
    """``key, is_hazard, alias, threshold, corrected_name`` of every row: matched by id first, else by name.

    Several catalogue rows of an id: the last counts; of a name: the first. An id match corrects the
    name. Without a match the alias falls back to the row's own ``keep_alias``. Sides are left to the
    optimizer, which broadcasts the catalogue if it is small.
    """
    by_id = keep_first(catalogue.where("ref_id is not null"), ["ref_id"], "ref_order", last=True)
    i = by_id.select(F.col("ref_id").alias("i_id"), F.struct("ref_name", "ref_alias", "threshold").alias("i"))
    n = catalogue.select(F.col("ref_name").alias("n_name"), F.struct("ref_name", "ref_alias", "threshold").alias("n"))
    own_alias = F.col(f"`{keep_alias}`") if keep_alias else F.lit(None).cast("string")
    slim = data.select(
        F.col(f"`{key}`").alias("key"), F.trim(F.col(f"`{name}`")).alias("name"), F.trim(F.col(f"`{ident}`")).alias("ident"), own_alias.alias("own_alias")
    )
    # Rows without an id, which may be many, are kept out of the join by it.
    with_id = slim.where(F.col("ident") != "").join(i, F.col("ident") == F.col("i_id"), "left")
    without = slim.where(~F.coalesce(F.col("ident") != "", F.lit(False)))
    joined = with_id.unionByName(without, allowMissingColumns=True).join(n, F.col("name") == n["n_name"], "left")
    hit = F.coalesce("i", "n")
    return joined.select(
        F.col("key").alias(key),
        F.when(hit.isNotNull(), "是").otherwise("否").alias("is_hazard"),
        F.coalesce(hit["ref_alias"], F.col("own_alias"), F.lit("")).alias("alias"),
        F.coalesce(hit["threshold"], F.lit("")).alias("threshold"),
        F.coalesce(F.col("i.ref_name"), F.col("name")).alias("corrected_name"),
    )


def missing_from(catalogue: DataFrame, data: DataFrame, name: str, ident: str) -> DataFrame:
    """Catalogue rows of which neither id nor name occurs in the data: two anti joins, never an OR."""
    ids = data.select(F.trim(F.col(f"`{ident}`")).alias("ref_id")).where("ref_id <> ''").distinct()
    names = data.select(F.trim(F.col(f"`{name}`")).alias("ref_name")).where("ref_name <> ''").distinct()
    return catalogue.join(ids, "ref_id", "left_anti").join(names, "ref_name", "left_anti")


def substrings(text: Column, least: int, most: int) -> Column:
    """All distinct substrings of ``least`` to ``most`` characters: linear in the length of the text for bounded ``most``."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - least + 1, F.lit(1)))
    lengths = F.sequence(F.lit(least), F.lit(most))
    every = F.flatten(F.transform(starts, lambda s: F.transform(lengths, lambda n: F.substring(text, s, n))))
    return F.array_distinct(F.filter(every, lambda x: F.length(x) >= least))


def containing_pairs(left: DataFrame, right: DataFrame, least: int = 2, most: int = 40) -> DataFrame:
    """Pairs ``left_name, right_name`` of which one contains the other, by equi-joins on substrings.

    ``left`` and ``right`` have a column ``name`` of distinct names. A name of more than ``most`` characters is found
    by its first ``most``, then compared as a whole, so names of any length lose no pair.
    """
    a = left.select(F.col("name").alias("left_name")).where(F.length("name") >= least)
    b = right.select(F.col("name").alias("right_name")).where(F.length("name") >= least)

    def inside(long: DataFrame, short: DataFrame) -> DataFrame:
        outer, inner = long.columns[0], short.columns[0]
        spread = long.select(outer, F.explode(substrings(F.col(outer), least, most)).alias("piece"))
        begun = short.select(inner, F.substring(inner, 1, most).alias("piece"))
        return spread.join(begun, "piece").where((F.length(inner) <= most) | F.col(outer).contains(F.col(inner))).select("left_name", "right_name")

    return inside(a, b).union(inside(b, a)).distinct()


def lookup_ids(names: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``name, found_id``: the id of the equal name, else of the first dictionary entry (by ``ord``) that contains it or is contained.

    ``names``: distinct ``name``; ``dictionary``: ``name, id, ord`` with distinct names.
    """
    exact = names.join(dictionary.select("name", F.col("id").alias("exact_id")), "name", "left")
    entries = dictionary.select(F.col("name").alias("right_name"), "id", "ord")
    near = containing_pairs(names, dictionary).join(entries, "right_name").groupBy(F.col("left_name").alias("name")).agg(F.min_by("id", "ord").alias("near_id"))
    return exact.join(near, "name", "left").select("name", F.coalesce("exact_id", "near_id").alias("found_id"))
