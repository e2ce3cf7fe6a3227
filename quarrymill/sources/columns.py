"""Harmonising columns by name. Works on names only, so it costs nothing whatever the data."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

# Standard columns and the names they go by, in order of priority.
STANDARD = {
    "中文名称": ["中文名称", "中文名", "品名", "名称", "化学品名称", "chemical_name", "name"],
    "英文名称": ["英文名称", "英文名", "english_name"],
    "CAS号": ["CAS号", "CAS号或流水号", "cas", "cas_number", "cas number"],
    "别名": ["别名", "中文别名", "英文别名", "alias", "aliases", "synonyms"],
    "分子式": ["分子式", "formula", "molecular_formula"],
    "分子量": ["分子量", "molecular_weight"],
}


def drop_unnamed(df: DataFrame) -> DataFrame:
    """Without columns whose name is blank, ``nan``, ``unnamed…`` or made up by the reader."""
    return df.select(*[f"`{c}`" for c in df.columns if not re.fullmatch(r"\s*|nan|unnamed.*|_c\d+", c.strip().lower())])


def detect_column(columns: Sequence[str], patterns: Sequence[str]) -> str | None:
    """By pattern in order: equal in lower case, else the first that contains it or is contained in it."""
    low = {c: c.strip().lower() for c in columns}
    for p in (p.lower() for p in patterns):
        for c, name in low.items():
            if name == p:
                return c
        for c, name in low.items():
            if name and (p in name or name in p):
                return c
    return None


def standard_mapping(columns: Sequence[str], standard: Mapping[str, Sequence[str]] = STANDARD) -> dict[str, str]:
    """Column to standard name, one to one: equal names first, containment for what is left."""
    taken: dict[str, str] = {}
    for target, names in standard.items():
        hit = next((c for n in names for c in columns if c not in taken and c.strip().lower() == n.lower()), None)
        if hit:
            taken[hit] = target
    for target, names in standard.items():
        if target in taken.values():
            continue
        hit = next((c for n in names for c in columns if c not in taken and len(n) > 2 and n.lower() in c.strip().lower()), None)
        if hit:
            taken[hit] = target
    return taken


def standardise(df: DataFrame, standard: Mapping[str, Sequence[str]] = STANDARD) -> DataFrame:
    mapping = standard_mapping(df.columns, standard)
    clash = {t for t in mapping.values() if t in df.columns and mapping.get(t) != t}
    return df.drop(*clash).withColumnsRenamed({c: t for c, t in mapping.items() if c not in clash})


def suggest(columns: Sequence[str], standard: Mapping[str, Sequence[str]] = STANDARD) -> dict[str, list[str]]:
    """Standard names that a column might stand for."""
    return {c: [t for t, names in standard.items() if any(n.lower() in c.lower() or c.lower() in n.lower() for n in names)] for c in columns}


def reorder(df: DataFrame, column: str, after: str) -> DataFrame:
    """Moves a column behind another one, if both exist."""
    if column not in df.columns or after not in df.columns or column == after:
        return df
    rest = [c for c in df.columns if c != column]
    at = rest.index(after) + 1
    return df.select(*[f"`{c}`" for c in [*rest[:at], column, *rest[at:]]])
