"""Queries p1, p2 and p6: packed values, rows that fail to parse, quantities in different units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators.packed import explode_packed
from quarrymill.operators.quantities import explode_quantities
from quarrymill.operators.records import parse_records
from quarrymill.session import table

PC = "enriched_pc_hardware_database"
HARDWARE = "enriched_computer_hardware_knowledge"
HERBS = "traditional_chinese_medicine_material_enriched"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    systems = explode_packed(table(spark, sf_dir, PC), PC, ["supported_operating_systems", "compatible_systems"])
    ports = explode_packed(table(spark, sf_dir, HARDWARE), HARDWARE, ["connectivity"])
    # Names of substances may be lower-case words: a comma before one is a delimiter.
    substances = explode_packed(table(spark, sf_dir, HERBS), HERBS, ["chemical_constituents"], qualifiers=False)
    return systems.unionByName(ports).unionByName(substances)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_records(table(spark, sf_dir, "sample_chemicals_raw"))
    return parsed.where(F.col("reason").isNotNull()).select("raw_id", "reason")


def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parse_records(table(spark, sf_dir, "sample_chemicals_raw"))
    return parsed.where(F.col("reason").isNull()).drop("reason")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = explode_quantities(table(spark, sf_dir, HARDWARE), HARDWARE, ["power_consumption", "dimensions", "weight"])
    clocks = explode_quantities(table(spark, sf_dir, PC), PC, ["clock_speeds"])
    return sizes.unionByName(clocks)


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_loaded": p2_loaded, "p6_found": p6_found}

_FIELD = r'(?:[^",]*|"(?:[^"]|"")*")'
_BLANKS = r"[\s\x{00a0}\x{3000}]"
_SPLIT = rf"""
r AS (SELECT raw_id, coalesce(raw_text, '') AS t FROM sample_chemicals_raw),
s AS (
  SELECT raw_id, t,
    regexp_full_match(t, '(?s){_FIELD}(?:,{_FIELD})*') AS quoted_ok,
    regexp_full_match(t, '(?s){_FIELD},{_FIELD},{_FIELD}') AS three,
    [regexp_extract(t, '(?s)^({_FIELD}),({_FIELD}),({_FIELD})$', 1),
     regexp_extract(t, '(?s)^({_FIELD}),({_FIELD}),({_FIELD})$', 2),
     regexp_extract(t, '(?s)^({_FIELD}),({_FIELD}),({_FIELD})$', 3)] AS raw
  FROM r),
u AS (
  SELECT raw_id, quoted_ok, three,
    [CASE WHEN x[1:1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END FOR x IN raw] AS f
  FROM s),
v AS (
  SELECT raw_id, quoted_ok, three, f,
    regexp_replace(f[1], '^{_BLANKS}+|{_BLANKS}+$', '', 'g') AS name,
    regexp_replace(f[2], '^{_BLANKS}+|{_BLANKS}+$', '', 'g') AS cas
  FROM u),
w AS (
  SELECT *, CASE WHEN regexp_full_match(cas, '[0-9]{{2,7}}-[0-9]{{2}}-[0-9]') THEN
      list_sum([CAST(d AS INTEGER) * k FOR d, k IN string_split(reverse(replace(cas, '-', '')[1:-2]), '')]) % 10
        = CAST(cas[-1:] AS INTEGER)
    ELSE false END AS cas_ok
  FROM v),
z AS (
  SELECT *, CASE
      WHEN NOT quoted_ok THEN 'quoting'
      WHEN NOT three THEN 'column_count'
      WHEN name IN ('', 'N/A', 'null', 'nan', '未知', '无', '处理异常', '[待补全]') THEN 'invalid_value'
      WHEN NOT (cas = '' OR cas_ok OR regexp_full_match(cas, '20[0-9]{{7}}')) THEN 'invalid_value'
    END AS reason
  FROM w)
"""

ORACLE = {
    "p2_found": f"WITH {_SPLIT} SELECT raw_id, reason FROM z WHERE reason IS NOT NULL",
    "p2_loaded": f"""WITH {_SPLIT} SELECT raw_id, f[1] AS "品名", f[2] AS "CAS号", f[3] AS "备注" FROM z WHERE reason IS NULL""",
}
