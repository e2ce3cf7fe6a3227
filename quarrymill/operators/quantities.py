"""Quantities recorded in different units: every stated quantity in one unit per kind.

Method: regular expressions find groups of numbers that share a unit, stated after or before
them; number and unit are extracted; the unit's alias is normalised by a join with the alias
table; a unit missing at the number comes from a unit field or a default of the source; factor
and offset give the amount. One narrow pass: the alias table is a fixed list of under 200 rows,
so its broadcast cannot grow with the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.vocab import UNIT_ALIASES

Aliases = Mapping[tuple[str, str], Sequence[str]]

_FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000\u00a0\u2009\u202f"
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "    "
_SQUARED = {"\u339c": "mm", "\u339d": "cm", "\u338f": "kg", "\u338e": "mg", "\u3394": "GHz", "\u3392": "MHz", "\u33be": "kW"}

# The one symbol of which the case of the first letter tells the prefix: mega, not milli.
MEGA = "MW"

# A mixed or plain fraction, or a number: a comma before exactly three digits groups thousands.
NUMBER = r"\d+\s\d+/\d+(?!\d)|\d+/\d+(?![\d/])|\d+(?:,\d{3}(?!\d))*(?:[.,]\d+)?"


def alias_table(spark: SparkSession, aliases: Aliases = UNIT_ALIASES) -> DataFrame:
    """``unit_key, base_unit, factor, shift``: a fixed table of a few hundred bytes."""
    from decimal import Decimal

    rows = [(a.lower(), base, Decimal(factor), Decimal(0)) for (base, factor), names in aliases.items() for a in names]
    schema = "unit_key string, base_unit string, factor decimal(20,6), shift decimal(20,6)"
    return spark.createDataFrame(rows, schema)


def _unit_pattern(aliases: Aliases) -> str:
    """All aliases, the longest first; a Latin one must not run on into a word."""
    names = sorted({a for group in aliases.values() for a in group}, key=lambda a: (-len(a), a))
    latin = [a.replace(".", r"\.") for a in names if a.isascii()]
    other = [a for a in names if not a.isascii()]
    # A capital N before the m is newton, not nano.
    return rf"(?:(?:(?!N[mM])(?i:{'|'.join(latin)}))(?!(?![xX]\s*\d)[A-Za-z]|²|\^)|(?:{'|'.join(other)})(?![时秒]))"


def patterns(aliases: Aliases = UNIT_ALIASES) -> tuple[str, str]:
    """The pattern of a group of numbers with their unit, and that of the unit alone.

    Series are possessive, since a shorter one is never followed by a unit. A series without a unit is
    a match of its own, to be left out, so that it is read once and not from each of its numbers.
    """
    unit = _unit_pattern(aliases)
    number = rf"(?<![\d.,A-Za-z])(?>{NUMBER})"
    inner = rf"(?>{NUMBER})"
    series = r"\s*(?:[xX×*~～–—\-−/]|to\b|至|到|or\b|和|或)\s*"
    after = rf"(?:{number}(?:{series}{inner})*+|(?<=[A-Za-z_])(?:{NUMBER})(?=\s*{unit}))\s*[(\[（【]?\s*{unit}"
    alone = rf"{inner}(?!\s*[(\[]?\s*{unit})"
    label = r"(?:[A-Za-z一-鿿_@-]+\s*[:=@]?\s*)?"
    before = (
        rf"(?<![A-Za-z\d.]){unit}\s*(?:[)\]】]\s*[:,]?|[:,]|计|为单位)\s*{label}{alone}"
        rf"(?:(?:{series}|\s*[,;、，；|]\s*|\s+){label}{alone})*+"
    )
    return rf"{after}|{before}|{number}(?:{series}{inner})++", unit


def _plain(cell: Column) -> Column:
    """Half-width characters; blanks that were written as escapes become blanks."""
    text = F.regexp_replace(cell, r"\\x[aA]0|\\u00[aA]0|\\u3000|\\t", " ")
    text = F.translate(text, _FULL, _HALF)
    for sign, unit in _SQUARED.items():
        text = F.replace(text, F.lit(sign), F.lit(unit))
    return text


def _amount(number: Column) -> Column:
    """The number as a decimal; mixed fractions are one number."""
    plain = F.regexp_replace(F.regexp_replace(number, r",(?=\d{3}(?!\d))", ""), ",", ".").try_cast(T.DecimalType(20, 6))
    whole = F.regexp_extract(number, r"^(\d+)\s\d+/", 1).try_cast(T.DecimalType(20, 6))
    over = F.regexp_extract(number, r"(\d+)/\d+$", 1).try_cast(T.DecimalType(20, 6))
    under = F.regexp_extract(number, r"/(\d+)$", 1).try_cast(T.DecimalType(20, 6))
    fraction = F.coalesce(whole, F.lit(0).cast(T.DecimalType(20, 6))) + F.try_divide(over, under).try_cast(T.DecimalType(20, 6))
    return F.when(number.contains("/"), fraction).otherwise(plain)


def explode_quantities(
    df: DataFrame,
    table_name: str,
    fields: Sequence[str],
    key: str = "row_id",
    aliases: Aliases = UNIT_ALIASES,
    unit_fields: Mapping[str, str] | None = None,
    default_units: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per stated quantity: ``table_name, row_id, field_name, pos, base_unit, amount``.

    Both ends of a range count, and so do statements in two units. A unit given once for several
    numbers holds for all of them. Numbers without a unit give no row, unless the cell is a lone
    number and ``unit_fields`` (field -> column that holds its unit) or ``default_units``
    (field -> unit of the source) provides one. Null and empty cells give no row. A fraction over zero
    and an amount beyond 64 bits are null.
    """
    group, unit = patterns(aliases)
    unit_fields, default_units = unit_fields or {}, default_units or {}

    def spare(field: str) -> Column:
        named = F.col(f"`{unit_fields[field]}`").cast("string") if field in unit_fields else F.lit(None).cast("string")
        return F.coalesce(F.nullif(F.trim(named), F.lit("")), F.lit(default_units.get(field)).cast("string"))

    cells = F.array(
        *[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("cell"), spare(f).alias("spare")) for f in fields]
    )
    found = (
        df.select(F.col(key).cast("long").alias("row_id"), F.explode(cells).alias("c"))
        .where(F.col("c.cell").rlike(r"[0-9０-９]"))
        .select("row_id", "c.field_name", "c.spare", _plain(F.col("c.cell")).alias("text"))
        .withColumn("groups", F.regexp_extract_all("text", F.lit(group), F.lit(0)))
    )
    lone = rf"^\s*({NUMBER})\s*$"
    groups = F.when(
        (F.size("groups") == 0) & F.col("spare").isNotNull() & F.col("text").rlike(lone),
        F.array(F.concat(F.col("text"), F.lit(" "), F.col("spare"))),
    ).otherwise(F.col("groups"))
    stated = F.transform(
        groups,
        lambda g: F.struct(
            F.regexp_extract(g, rf"(?<![A-Za-z]){unit}", 0).alias("unit"), F.regexp_extract_all(g, F.lit(f"(?:{NUMBER})"), F.lit(0)).alias("numbers")
        ),
    )
    # Every unit that the pattern finds has an alias, so the join below drops no row and leaves no gap in the positions.
    known = F.filter(stated, lambda s: s["unit"] != "")
    pairs = F.flatten(F.transform(known, lambda s: F.transform(s["numbers"], lambda n: F.struct(n.alias("number"), s["unit"].alias("unit")))))
    rows = found.select("row_id", "field_name", F.posexplode(pairs).alias("i", "q")).select(
        "row_id",
        "field_name",
        (F.col("i") + 1).cast("int").alias("pos"),
        _amount(F.col("q.number")).alias("number"),
        F.when(F.col("q.unit") == MEGA, "megawatt").otherwise(F.lower(F.col("q.unit"))).alias("unit_key"),
    )
    named = rows.join(F.broadcast(alias_table(df.sparkSession, aliases)), "unit_key")
    return named.select(
        F.lit(table_name).alias("table_name"),
        "row_id",
        "field_name",
        "pos",
        "base_unit",
        F.round(F.col("number") * F.col("factor") + F.col("shift"), 0).try_cast("long").alias("amount"),
    )
