"""JSON in the text of a model's answer: found, repaired and read, natively first.

``parse_answers`` tries what the JVM can do on every row and sends only the rows that fail to Python.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.identifiers import extract_ids

STRING_MAP = "map<string,string>"


def fenced_block(text: Column) -> Column:
    """What stands in the first code fence, without its language mark."""
    return F.trim(F.regexp_extract(text, r"(?is)```(?:json)?[ \t\r\n]*(.*?)[ \t\r\n]*```", 1))


def outer_object(text: Column) -> Column:
    """From the first opening to the last closing brace."""
    return F.regexp_extract(text, r"(?s)\{.*\}", 0)


def longest_object(text: Column) -> Column:
    """The longest flat object in braces."""
    found = F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}"), F.lit(0))
    return F.get(F.array_sort(found, lambda a, b: F.length(b) - F.length(a)), F.lit(0))


def key_values(text: Column) -> Column:
    """Map of ``key: value`` pairs by line or comma; the last value of a key counts."""
    pattern = r"([A-Za-z_一-鿿][\w一-鿿]*) *[:：] *([^,\n]+)"
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("k"), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda p: F.trim(p)).alias("v"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, 10_000), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def repair(text: Column) -> Column:
    """The outer object with straight quotes, without comments and trailing commas, bare keys quoted."""
    out = F.translate(text, "“”‘’", "\"\"''")
    out = F.regexp_replace(out, r"```(?:json)?", "")
    out = outer_object(F.regexp_replace(out, r"(?m)(^|\s)//[^\n]*$", "$1"))
    out = F.regexp_replace(out, r",\s*([}\]])", "$1")
    return F.regexp_replace(out, r"([{,]\s*)([A-Za-z_一-鿿][\w一-鿿]*)\s*:", '$1"$2":')


def value_of_key(text: Column, key: str) -> Column:
    """The value of one key: quoted, number or up to the next comma."""
    tries = [rf'"{key}"\s*[:：]\s*"([^"]*)"', rf"'{key}'\s*[:：]\s*'([^']*)'", rf'(?<![\w"]){key}"?\s*[:：]\s*([-+0-9.]+)', rf"(?<!\w){key}\s*[:：]\s*([^,，}}\n]+)"]
    found = [F.nullif(F.trim(F.regexp_extract(text, t, 1)), F.lit("")) for t in tries]
    return F.coalesce(*found)


def prose_value(text: Column, attribute: str) -> Column:
    """The value that a sentence gives to an attribute."""
    return F.nullif(F.trim(F.regexp_extract(text, rf"{attribute}\s*(?:[:：]|为|是)\s*([^,，。；;\n]+)", 1)), F.lit(""))


def id_of_answer(text: Column) -> Column:
    """The registry number in a JSON field of the answer, else the first right one in its text."""
    field = F.nullif(F.get_json_object(outer_object(text), "$.cas"), F.lit(""))
    return F.coalesce(field, F.get(extract_ids(text), F.lit(0)))


def flatten_attributes(text: Column, invalid: Iterable[str]) -> Column:
    """Map of a list of ``{name, value}`` under ``attributes``, without invalid values."""
    parsed = F.from_json(text, "attributes array<struct<name:string,value:string>>")["attributes"]
    good = F.filter(parsed, lambda a: a["name"].isNotNull() & a["value"].isNotNull() & ~F.lower(F.trim(a["value"])).isin(list(invalid)))
    return F.map_from_entries(good)


def records_of(text: Column, schema: str) -> Column:
    """The records of a wrapped document: the first list under data, records, items, chemicals or results."""
    element = f"array<struct<{', '.join(schema.replace(' ', ':', 1).split(', '))}>>"
    wrapped = F.from_json(text, ", ".join(f"{k} {element}" for k in ("data", "records", "items", "chemicals", "results")))
    return F.coalesce(*[wrapped[k] for k in ("data", "records", "items", "chemicals", "results")])


def _balanced(text: str) -> Iterable[str]:
    """Objects by brace depth, in order."""
    depth, start = 0, -1
    for i, c in enumerate(text):
        if c == "{":
            if depth == 0:
                start = i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                yield text[start : i + 1]


def _as_map(value: object) -> dict[str, str] | None:
    if isinstance(value, list) and value and isinstance(value[0], dict):
        value = value[0]
    if not isinstance(value, dict):
        return None
    if isinstance(value.get("attributes"), list):
        value = {a["name"]: a.get("value") for a in value["attributes"] if isinstance(a, dict) and "name" in a}
    return {str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in value.items() if v is not None}


def parse_answer(text: str | None, attributes: Iterable[str] = (), loose_first: bool = True) -> dict[str, str] | None:
    """Strategies in order: whole text, fence, brace depth, flat objects, key and value lines, repair, prose."""
    if not text or not text.strip():
        return None

    def direct(candidate: str) -> dict[str, str] | None:
        try:
            return _as_map(json.loads(candidate))
        except ValueError:
            return None

    def fence() -> dict[str, str] | None:
        found = re.findall(r"(?is)```(?:json)?\s*(.*?)\s*```|`([^`]+)`", text)
        return next((m for a, b in found if (m := direct(a or b))), None)

    def loose() -> dict[str, str] | None:
        pairs = re.findall(r"[\"']?([A-Za-z_一-鿿][\w一-鿿]*)[\"']?\s*[:：]\s*[\"']?([^,\"'\n{}]+)", text)
        return {k: v.strip() for k, v in pairs if v.strip()} or None

    def repaired() -> dict[str, str] | None:
        out = text.translate(str.maketrans("“”‘’", "\"\"''"))
        out = re.sub(r"```(?:json)?", "", out)
        start, end = out.find("{"), out.rfind("}")
        if start < 0 or end < start:
            return None
        out = re.sub(r"(^|\s)//[^\n]*", r"\1", out[start : end + 1])
        out = re.sub(r",\s*([}\]])", r"\1", out)
        return direct(re.sub(r"([{,]\s*)([A-Za-z_一-鿿][\w一-鿿]*)\s*:", r'\1"\2":', out))

    def prose() -> dict[str, str] | None:
        found = {a: m.group(1).strip() for a in attributes if (m := re.search(rf"{re.escape(a)}\s*(?:[:：]|为|是)\s*([^,，。；;\n]+)", text))}
        return found or None

    steps = [lambda: direct(text.strip()), fence, lambda: next((m for o in _balanced(text) if (m := direct(o))), None)]
    steps.append(lambda: next((m for o in sorted(re.findall(r"\{[^{}]*\}", text), key=len, reverse=True) if (m := direct(o))), None))
    steps += [loose, repaired] if loose_first else [repaired, loose]
    return next((found for step in [*steps, prose] if (found := step())), None)


def parse_answers(df: DataFrame, text: str, out: str = "parsed", loose_first: bool = False) -> DataFrame:
    """Adds a map of strings. Rows that the JVM reads, plainly or after repair, never leave it."""
    native = F.coalesce(F.from_json(F.col(text), STRING_MAP), F.from_json(fenced_block(F.col(text)), STRING_MAP))
    fixed = F.from_json(repair(F.col(text)), STRING_MAP)

    @F.pandas_udf("string")
    def slow(values: pd.Series) -> pd.Series:
        def one(v: str | None) -> str | None:
            found = parse_answer(v, loose_first=loose_first)
            return json.dumps(found, ensure_ascii=False) if found else None

        return values.map(one)

    # A list of attributes has to be made flat first.
    tried = df.withColumn("__native", F.when(~F.contains(F.col(text), F.lit('"attributes"')), F.coalesce(native, fixed)))
    done = tried.where(F.col("__native").isNotNull()).withColumn(out, F.col("__native"))
    rest = tried.where(F.col("__native").isNull()).withColumn(out, F.from_json(slow(F.col(text)), STRING_MAP))
    return done.unionByName(rest).drop("__native")
