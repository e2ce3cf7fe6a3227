"""Measures in free text: numbers, units, temperatures, pressures, densities, solubilities, limits.

A measure is a number followed by one of a list of units, both from ``vocab``; the patterns are put together here. What is
found keeps the words it was found in as ``original``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.vocab import CONDITION_WORDS, DEGREES, DENSITY_UNITS, PRESSURE_UNITS, RANGE_WORDS, SOLUTE_UNITS, SOLVENT_UNITS, TEXT_UNITS

PLAIN = r"[0-9]+(?:\.[0-9]+)?"
NUMBER = f"-?{PLAIN}"


def _one_of(words: Iterable[str]) -> str:
    return "|".join(words)


def measured(units: Iterable[str], number: str = PLAIN) -> str:
    """A number and its unit, a group each."""
    return rf"({number})\s*({_one_of(units)})"


TEMPERATURE_POINT = "(?i)" + measured(DEGREES, NUMBER)
TEMPERATURE_RANGE = rf"(?i)({NUMBER})\s*(?:{_one_of(RANGE_WORDS)})\s*" + measured(DEGREES, NUMBER)
_CONDITION = rf"(?:\s*(?:{_one_of(CONDITION_WORDS)})\s*({NUMBER}\s*(?:{_one_of(DEGREES)})))?"
PRESSURE = "(?i)" + measured(PRESSURE_UNITS) + _CONDITION
DENSITY = "(?i)" + measured(DENSITY_UNITS) + _CONDITION
SOLUBILITY = "(?i)" + measured(SOLUTE_UNITS) + r"\s*/\s*" + measured(SOLVENT_UNITS) + r"\s*(?:\(([^()]+)\))?"


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _matches(text: Column, pattern: str, *groups: str) -> Column:
    """All matches as an array of structs: the whole as ``original`` and the groups by name."""
    return F.arrays_zip(*[_all(text, pattern, i).alias(name) for i, name in enumerate(("original", *groups))])


def to_celsius(value: Column, unit: Column) -> Column:
    letter = F.upper(F.regexp_replace(unit, "[°℃]", ""))
    return F.when(letter == "F", (value - 32) * 5 / 9).when(letter == "K", value - 273.15).otherwise(value)


def extract_temperatures(text: Column) -> Column:
    """Array of ``kind, low, high, original`` in degrees Celsius; single values only where there is no range."""

    def celsius(kind: str, low: str, high: str):
        at = lambda x, name: F.round(to_celsius(x[name].cast("double"), x["unit"]), 2)
        return lambda x: F.struct(F.lit(kind).alias("kind"), at(x, low).alias("low"), at(x, high).alias("high"), F.trim(x["original"]).alias("original"))

    ranges = F.transform(_matches(text, TEMPERATURE_RANGE, "a", "b", "unit"), celsius("range", "a", "b"))
    points = F.transform(_matches(text, TEMPERATURE_POINT, "a", "unit"), celsius("point", "a", "a"))
    return F.when(F.size(ranges) > 0, ranges).otherwise(points)


def _converted(text: Column, pattern: str, factors: Mapping[str, float], name: str) -> Column:
    """Array of the amount in the common unit, to four digits, ``condition`` and ``original``."""
    known = F.create_map(*[F.lit(x) for unit, factor in factors.items() for x in (unit.lower(), factor)])
    amount = lambda x: F.round(x["number"].cast("double") * F.element_at(known, F.lower(x["unit"])), 4)
    return F.transform(
        _matches(text, pattern, "number", "unit", "condition"),
        lambda x: F.struct(amount(x).alias(name), F.trim(x["condition"]).alias("condition"), F.trim(x["original"]).alias("original")),
    )


def extract_pressures(text: Column) -> Column:
    """Array of ``kpa, condition, original``."""
    return _converted(text, PRESSURE, PRESSURE_UNITS, "kpa")


def extract_densities(text: Column) -> Column:
    """Array of ``density`` in g/cm³, ``condition`` and ``original``."""
    return _converted(text, DENSITY, DENSITY_UNITS, "density")


def extract_solubilities(text: Column) -> Column:
    """Array of ``mass, mass_unit, volume, volume_unit, condition``."""
    return F.transform(
        _matches(text, SOLUBILITY, "mass", "mass_unit", "volume", "volume_unit", "condition"),
        lambda x: F.struct(
            x["mass"].cast("double").alias("mass"), x["mass_unit"].alias("mass_unit"), x["volume"].cast("double").alias("volume"),
            x["volume_unit"].alias("volume_unit"), F.trim(x["condition"]).alias("condition"),
        ),
    )


def explosion_limits(text: Column) -> tuple[Column, Column]:
    """Lower and upper limit, null where not stated."""
    return tuple(F.regexp_extract(text, rf"(?i){name}[: ]*([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double") for name in ("LEL", "UEL"))


def extract_numbers(text: Column) -> Column:
    return F.transform(_all(text, r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?", 0), lambda n: n.cast("double"))


def extract_units(text: Column) -> Column:
    """Distinct units of all kinds that stand anywhere in the text, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.array(*[_all(text, p, 0) for p in TEXT_UNITS]))))
