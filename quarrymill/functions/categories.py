"""Ordered keyword rules: the first class with a keyword in the text wins."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.vocab import SOLUBILITY_GRADES, SOLVENTS

Rules = Sequence[tuple[str, Sequence[str]]]


def first_class(text: Column, rules: Rules, default: str | None) -> Column:
    out = None
    for name, words in rules:
        hit = text.rlike("|".join(re.escape(w) for w in words))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def categorize(text: Column, rules: Rules, default: str, separators: str) -> Column:
    """Array of ``class, part`` for every part that is not blank."""
    parts = F.filter(F.transform(F.split(text, separators), lambda p: F.trim(p)), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(first_class(p, rules, default).alias("class"), p.alias("part")))


def solubility_grades(text: Column) -> Column:
    """Array of ``solvent, grade`` by sentence, of each the first of its list that occurs; sentences that state amounts are left out."""
    parts = F.filter(F.transform(F.split(text, "[,，;；。]"), lambda p: F.trim(p)), lambda p: p != "")
    words = F.filter(parts, lambda p: ~(p.rlike("[0-9]") & p.rlike("g/mL|g/L")))
    solvents, grades = ([(w, [w]) for w in group] for group in (SOLVENTS, SOLUBILITY_GRADES))
    found = F.transform(words, lambda p: F.struct(first_class(p, solvents, None).alias("solvent"), first_class(p, grades, "未知").alias("grade")))
    return F.filter(found, lambda x: x["solvent"].isNotNull())


def retry_delay(error: Column, attempt: Column) -> Column:
    """Seconds to wait before the next attempt, -1 to give up."""
    text = F.lower(error)
    return (
        F.when(text.contains("timeout"), F.least(F.lit(10), 2 + attempt * 2))
        .when(text.contains("lock"), F.least(F.lit(8), 1 + attempt))
        .when(text.contains("connection"), F.least(F.lit(15), 3 + attempt * 3))
        .when(attempt > 7, F.lit(-1))
        .otherwise(F.least(F.lit(5), 1 + attempt))
    )
