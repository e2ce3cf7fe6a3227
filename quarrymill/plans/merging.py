"""Queries of group merge, conflict resolution and partition merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import merge as G
from quarrymill.session import table

HERBS = "traditional_chinese_medicine_material_enriched"
_BAD = "('', 'N/A', 'null', 'nan', '未知', '无', '处理异常', '[待补全]')"


def _herbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, HERBS).where(F.trim("名称") != "").withColumn("name", F.trim("名称"))


def merge_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    policies = {"botanical_name": "first", "function_effects": "longest", "meridian_tropism": "set", "common_combinations": "alias"}
    return G.merge_records(_herbs(spark, sf_dir), ["name"], "row_id", policies)


def agg_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _herbs(spark, sf_dir).groupBy("name").agg(G.longest_value(F.col("processing_method"), F.col("row_id")).alias("processing_method"))


def agg_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.set_join(_herbs(spark, sf_dir), ["name"], "taste")


def agg_alias_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.alias_union(_herbs(spark, sf_dir), ["name"], "common_name", "row_id")


_RANKS = {"5-LOW": 1, "4-NOT SPECIFIED": 2, "3-MEDIUM": 3, "2-HIGH": 4, "1-URGENT": 5}


def agg_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_custkey").agg(G.severest_value(F.col("o_orderpriority"), F.col("o_orderkey"), _RANKS).alias("worst"))


def id_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with several ids: the best formed, most frequent and best described id wins."""
    rows = table(spark, sf_dir, "sample_chemicals").select(F.trim("品名").alias("name"), F.trim("CAS号").alias("id"), "备注", "source_file", "row_id").where("name <> '' and id <> ''")
    none = F.lit(None).cast("string")
    bonuses = G.record_bonuses(none, none, none, F.col("备注"), F.col("source_file"))
    return G.resolve_conflicts(rows, "name", "id", "row_id", G.identifier_score(F.col("id"), bonuses))


def partition_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hazardous substances keep all of their rows, the others are merged by name."""
    rows = table(spark, sf_dir, "sample_chemicals").select("row_id", F.trim("品名").alias("name"), "CAS号").where("name <> ''")
    listed = table(spark, sf_dir, "hazard_catalog").select(F.trim(F.regexp_replace("品名", r"\[[^\]]*\]", "")).alias("name")).distinct()
    hazardous = rows.join(listed, "name", "left_semi").select("name", F.col("CAS号").alias("id"), F.lit(1).cast("long").alias("n_rows"))
    normal = rows.join(listed, "name", "left_anti").groupBy("name").agg(G.first_value(F.col("CAS号"), F.col("row_id")).alias("id"), F.count("*").alias("n_rows"))
    return hazardous.unionByName(normal)


def distinct_combo(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "hazard_catalog")
    name, threshold = F.trim(F.regexp_replace("品名", r"\[[^\]]*\]", "")), F.regexp_extract("品名", r"\[([^\]]*)\]", 1)
    return rows.agg(F.count_distinct(F.regexp_replace(F.concat_ws("_", name, threshold), "_+$", "")).alias("combinations"))


_KEYS = ["merge_records", "agg_longest", "agg_set_join", "agg_alias_union", "agg_severity", "id_conflict", "partition_merge", "distinct_combo"]
QUERIES = {name: globals()[name] for name in _KEYS}


def _u(column: str) -> str:
    return f"CASE WHEN trim({column}, ' ') NOT IN {_BAD} THEN trim({column}, ' ') END"


_BASE = f"h AS (SELECT *, trim(\"名称\", ' ') AS name FROM {HERBS} WHERE trim(\"名称\", ' ') <> '')"


def _alias(column: str) -> str:
    return f"""(SELECT name, string_agg(p, ';' ORDER BY o, i) AS {column} FROM (
      SELECT name, p, min(row_id) AS o, arg_min(i, row_id * 1000 + i) AS i FROM (
        SELECT name, row_id, i, trim(string_split_regex({_u(column)}, '[,;，；、]')[i], ' ') AS p
        FROM (SELECT *, unnest(range(1, 1 + len(string_split_regex({_u(column)}, '[,;，；、]')))) AS i FROM h)) WHERE p <> '' GROUP BY name, p) GROUP BY name)"""


def _set(column: str, joiner: str = "; ") -> str:
    return f"(SELECT name, string_agg(v, '{joiner}' ORDER BY v) AS {column} FROM (SELECT DISTINCT name, {_u(column)} AS v FROM h) WHERE v IS NOT NULL GROUP BY name)"


def _longest(column: str) -> str:
    return f"(SELECT name, v AS {column} FROM (SELECT name, row_id, {_u(column)} AS v FROM h) WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY length(v) DESC, row_id) = 1)"


ORACLE = {
    "merge_records": f"""WITH {_BASE}, n AS (SELECT name, count(*) AS n_rows, arg_min({_u("botanical_name")}, row_id) FILTER (WHERE {_u("botanical_name")} IS NOT NULL) AS botanical_name FROM h GROUP BY name)
      SELECT n.*, l.function_effects, s.meridian_tropism, a.common_combinations FROM n LEFT JOIN {_longest("function_effects")} l USING (name)
      LEFT JOIN {_set("meridian_tropism")} s USING (name) LEFT JOIN {_alias("common_combinations")} a USING (name)""",
    "agg_longest": f"WITH {_BASE} SELECT n.name, l.processing_method FROM (SELECT DISTINCT name FROM h) n LEFT JOIN {_longest('processing_method')} l USING (name)",
    "agg_set_join": f"WITH {_BASE} SELECT * FROM {_set('taste')}",
    "agg_alias_union": f"WITH {_BASE} SELECT * FROM {_alias('common_name')}",
    "agg_severity": "SELECT o_custkey, o_orderpriority AS worst FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _RANKS.items())
    + " ELSE 0 END DESC, o_orderkey) = 1",
    "id_conflict": r"""WITH r AS (SELECT trim("品名", ' ') AS name, trim("CAS号", ' ') AS id, "备注", source_file, row_id FROM sample_chemicals WHERE trim("品名", ' ') <> '' AND trim("CAS号", ' ') <> ''),
      s AS (SELECT name, id, sum(CASE WHEN regexp_full_match(id, '[0-9]{2,7}-[0-9]{2}-[0-9]') THEN 10.0 WHEN regexp_full_match(id, '[0-9]{3,}') THEN 2.0 ELSE 0.0 END + CASE WHEN length(trim("备注", ' ')) > 5 THEN 0.5 ELSE 0.0 END + CASE WHEN trim(source_file, ' ') <> '' THEN 0.5 ELSE 0.0 END + 0.5) AS score, min(row_id) AS f FROM r GROUP BY name, id)
      SELECT name, count(*) OVER (PARTITION BY name) AS candidates, id, CAST(score AS DOUBLE) AS score FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, f) = 1""",
    "partition_merge": rf"""WITH r AS (SELECT row_id, trim("品名", ' ') AS name, "CAS号" FROM sample_chemicals WHERE trim("品名", ' ') <> ''),
      l AS (SELECT DISTINCT trim(regexp_replace("品名", '\[[^\]]*\]', '', 'g'), ' ') AS name FROM hazard_catalog)
      SELECT name, "CAS号" AS id, CAST(1 AS BIGINT) AS n_rows FROM r WHERE name IN (SELECT name FROM l) UNION ALL
      SELECT name, arg_min({_u('"CAS号"')}, row_id) FILTER (WHERE {_u('"CAS号"')} IS NOT NULL), count(*) FROM r WHERE name NOT IN (SELECT name FROM l) GROUP BY name""",
    "distinct_combo": r"""SELECT count(DISTINCT regexp_replace(concat_ws('_', trim(regexp_replace("品名", '\[[^\]]*\]', '', 'g'), ' '), regexp_extract("品名", '\[([^\]]*)\]', 1)), '_+$', '')) AS combinations FROM hazard_catalog""",
}
