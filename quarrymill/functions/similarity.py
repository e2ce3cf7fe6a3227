"""Similarity of names. Native expressions, and Arrow functions for what Spark lacks."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def characters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def jaccard(a: Column, b: Column, bonus: float = 0.3) -> Column:
    """Jaccard of the character sets, plus a bonus if one contains the other, at most 1."""
    x, y = characters(a), characters(b)
    base = F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))
    return F.least(F.lit(1.0), base + F.when(a.contains(b) | b.contains(a), bonus).otherwise(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Characters in common, counted with repeats, over the longer length."""
    kinds = F.array_intersect(characters(a), characters(b))

    def times(text: Column, c: Column) -> Column:
        return F.length(text) - F.length(F.replace(text, c, F.lit("")))

    shared = F.aggregate(kinds, F.lit(0), lambda n, c: n + F.least(times(a, c), times(b, c)))
    return shared / F.greatest(F.length(a), F.length(b), F.lit(1))


def edit_ratio(a: Column, b: Column) -> Column:
    """One less the edit distance over the longer length."""
    return 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def tiered(query: Column, text: Column) -> Column:
    """1.0 equal, 0.8 contained in the text, 0.7 contains it, else the Jaccard of characters."""
    return F.when(query == text, 1.0).when(text.contains(query), 0.8).when(query.contains(text), 0.7).otherwise(jaccard(query, text, 0.0))


def matching_blocks_ratio(a: Column, b: Column) -> Column:
    """Twice the characters in matching blocks over both lengths, lower case; by Arrow batches."""

    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, (p or "").lower(), (q or "").lower()).ratio() for p, q in zip(x, y, strict=True)])

    return F.pandas_udf(ratio, "double", F.PandasUDFType.SCALAR)(a, b)


def grams(text: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Character n-grams with repeats."""
    low = F.lower(text)

    def of(n: int) -> Column:
        starts = F.when(F.length(low) >= n, F.sequence(F.lit(1), F.length(low) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: F.substring(low, s, F.lit(n)))

    return F.flatten(F.array(*[of(n) for n in sizes]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
