"""Registry numbers, serials, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_id(text: Column) -> Column:
    """Digits and hyphens only."""
    return F.regexp_replace(text, "[^0-9-]", "")


def checksum_ok(number: Column) -> Column:
    """The last digit equals the sum of the others times their place from the right, modulo ten."""
    digits = F.reverse(F.regexp_replace(number, "-", ""))
    places = F.filter(F.split(digits, ""), lambda d: d != "")
    sum_ = F.aggregate(
        F.transform(F.slice(places, 2, 100), lambda d, i: d.cast("int") * (i + 1)), F.lit(0), lambda a, x: a + x
    )
    formed = number.rlike("^[0-9]{2,7}-[0-9]{2}-[0-9]$")
    return F.coalesce(formed & (sum_ % 10 == F.get(places, F.lit(0)).cast("int")), F.lit(False))


def fix_id(text: Column) -> Column:
    """Struct ``ok, fixed``: prefixes removed, runs of five digits and more hyphenated; only what needed no repair is checked for its check digit."""
    bare = F.trim(F.regexp_replace(F.trim(text), "CAS:|CAS |cas:|cas ", ""))
    formed = bare.rlike("^[0-9]{2,7}-[0-9]{2}-[0-9]$")
    digits = normalize_id(bare)
    hyphened = F.when(digits.rlike("^[0-9]{5,}$"), F.regexp_replace(digits, "^([0-9]+)([0-9]{2})([0-9])$", "$1-$2-$3")).otherwise(digits)
    repaired = hyphened.rlike("^[0-9]{2,7}-[0-9]{2}-[0-9]$")
    ok = F.when(bare.isNull() | (bare == ""), F.lit(False)).when(formed, checksum_ok(bare)).otherwise(repaired)
    fixed = F.when(bare.isNull(), "").when(formed | ~repaired, bare).otherwise(hyphened)
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), fixed.alias("fixed"))


def extract_ids(text: Column) -> Column:
    """Registry numbers in a text whose check digit is right."""
    found = F.regexp_extract_all(text, F.lit("(?:^|[^0-9-])([0-9]{2,7}-[0-9]{2}-[0-9])(?:$|[^0-9-])"), F.lit(1))
    return F.filter(found, checksum_ok)


def classify_id(text: Column) -> Column:
    bare = F.trim(text)
    return (
        F.when(bare.isNull() | (bare == ""), "empty")
        .when(bare.rlike("^[0-9]{2,7}-[0-9]{2}-[0-9]$"), "standard")
        .when(bare.rlike("^[0-9]{6,}$"), "serial")
        .otherwise("malformed")
    )


def content_id(*parts: Column) -> Column:
    """An id made from content: the same after a restart and on any partitioning."""
    return F.md5(F.concat_ws("|", *parts))
