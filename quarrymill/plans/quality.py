"""Queries of validation, quality and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.operators import validate as V
from quarrymill.session import table

HARDWARE = "enriched_computer_hardware_knowledge"
_BAD = "('', 'N/A', 'null', 'nan', '未知', '无', '处理异常', '[待补全]')"


def _u(column: str) -> str:
    return f"CASE WHEN trim({column}, ' ') NOT IN {_BAD} THEN trim({column}, ' ') END"


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sample_chemicals")
    rules = {"name missing": F.coalesce(F.trim("品名"), F.lit("")) == "", "note missing": F.coalesce(F.trim("备注"), F.lit("")) == ""}
    return V.flag_rules(rows, rules, ["品名", "CAS号"], "row_id")


def validate_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.split_valid(_flagged(spark, sf_dir))[0].select("row_id")


def validate_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.split_valid(_flagged(spark, sf_dir))[1].select("row_id", "reason")


def validate_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.type_violations(table(spark, sf_dir, HARDWARE), ["price", "release_year", "wattage"], ["rgb_lighting"])


def validate_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.range_violations(table(spark, sf_dir, "lineitem"), {"l_quantity": (2, 49), "l_discount": (0.01, None), "l_tax": (None, 0.07)})


def validate_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.duplicate_values(table(spark, sf_dir, "doc_labels"), "doc_id")


def validation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.validation_score(table(spark, sf_dir, "lineitem"), {"quantity": F.col("l_quantity") > 0, "discount": F.col("l_discount") < 0.05, "tax": F.col("l_tax") >= 0})


def status_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.coalesce(F.col("备注").contains("破损"), F.lit(False))
    return table(spark, sf_dir, "sample_chemicals").groupBy(failed.alias("failed")).agg(F.count("*").alias("n"))


_FIELDS = ["manufacturer", "category", "power_consumption", "dimensions", "weight", "warranty_period"]
_WEIGHTS = {"manufacturer": 0.3, "category": 0.2, "power_consumption": 0.2, "weight": 0.1, "absent": 0.2}


def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.completeness(table(spark, sf_dir, HARDWARE), _FIELDS)


def quality_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table_quality(table(spark, sf_dir, HARDWARE), _WEIGHTS)


def quality_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, HARDWARE).select("row_id", V.record_quality({c: w for c, w in _WEIGHTS.items() if c != "absent"}).alias("quality"))


def record_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = {"power": "power_consumption", "size": "dimensions", "ports": "connectivity"}
    rows = table(spark, sf_dir, HARDWARE)
    return rows.agg(F.count("*").alias("records"), *[F.count(V.usable(F.col(c))).alias(n) for n, c in sections.items()])


def prop_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, HARDWARE)
    props = F.map_filter(F.create_map(*[x for c in _FIELDS for x in (F.lit(c), V.usable(F.col(c)))]), lambda k, v: v.isNotNull())
    return rows.select(F.explode(F.map_keys(props)).alias("property")).groupBy("property").agg(F.count("*").alias("n"))


def run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(
        F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.avg("value"), 4).alias("mean_value")
    )


def moving_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return V.moving_mean(events, "user_id", "event_id", "value", 100).select("event_id", F.floor(F.col("moving_mean") * 10 + 1e-6).alias("moving_tenths"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg((F.col("event_type") == "error").cast("double")).alias("rate"))
    return rates.select("user_id", F.when(F.col("rate") > 0.25, "high").when(F.col("rate") > 0.2, "raised").otherwise("normal").alias("level"))


def recent_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(10).select("event_id", "event_type")


_KEYS = [
    "validate_split", "validate_failed", "validate_types", "validate_range", "validate_unique", "validation_score", "status_split", "completeness",
    "quality_table", "quality_record", "record_stats", "prop_hist", "run_stats", "moving_stats", "alerts", "recent_n",
]
QUERIES = {name: globals()[name] for name in _KEYS}
_FLAGS = """f AS (SELECT row_id, coalesce(trim("品名", ' '), '') = '' AS a, coalesce(trim("备注", ' '), '') = '' AS b,
  row_number() OVER (PARTITION BY coalesce(trim("品名", ' '), ''), coalesce(trim("CAS号", ' '), '') ORDER BY row_id) > 1 AS c FROM sample_chemicals)"""
_W = {c: w for c, w in _WEIGHTS.items() if c != "absent"}
ORACLE = {
    "validate_split": f"WITH {_FLAGS} SELECT row_id FROM f WHERE NOT (a OR b OR c)",
    "validate_failed": f"WITH {_FLAGS} SELECT row_id, 'name missing' AS reason FROM f WHERE a UNION ALL SELECT row_id, 'note missing' FROM f WHERE b UNION ALL SELECT row_id, 'duplicate' FROM f WHERE c",
    "validate_types": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NOT NULL AND try_cast({c} AS DOUBLE) IS NULL) AS violations FROM {HARDWARE}" for c in ("price", "release_year", "wattage"))
    + f" UNION ALL SELECT 'rgb_lighting', count(*) FILTER (WHERE rgb_lighting IS NOT NULL AND lower(rgb_lighting) NOT IN ('true', 'false', 'yes', 'no', '1', '0', '是', '否')) FROM {HARDWARE}",
    "validate_range": "SELECT 'l_quantity' AS \"column\", count(*) FILTER (WHERE l_quantity < 2) AS below, count(*) FILTER (WHERE l_quantity > 49) AS above FROM lineitem UNION ALL SELECT 'l_discount', count(*) FILTER (WHERE l_discount < 0.01), 0 FROM lineitem UNION ALL SELECT 'l_tax', 0, count(*) FILTER (WHERE l_tax > 0.07) FROM lineitem",
    "validate_unique": "WITH r AS (SELECT doc_id, count(*) AS n FROM doc_labels GROUP BY doc_id HAVING count(*) > 1) SELECT CAST(coalesce((SELECT sum(n - 1) FROM r), 0) AS BIGINT) AS duplicates, (SELECT coalesce(string_agg(d, ',' ORDER BY d), '') FROM (SELECT CAST(doc_id AS VARCHAR) AS d FROM r ORDER BY doc_id LIMIT 10)) AS samples",
    "validation_score": "WITH c AS (SELECT count(*) FILTER (WHERE NOT l_quantity > 0) AS quantity, count(*) FILTER (WHERE NOT l_discount < 0.05) AS discount, count(*) FILTER (WHERE NOT l_tax >= 0) AS tax FROM lineitem) SELECT *, round((CAST(quantity = 0 AS INTEGER) + CAST(discount = 0 AS INTEGER) + CAST(tax = 0 AS INTEGER)) * 100.0 / 3, 2) AS score FROM c",
    "status_split": "SELECT coalesce(contains(\"备注\", '破损'), false) AS failed, count(*) AS n FROM sample_chemicals GROUP BY 1",
    "completeness": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({_u(c)}) AS filled FROM {HARDWARE}" for c in _FIELDS),
    "quality_table": "SELECT round(" + " + ".join(f"avg(CAST({_u(c)} IS NOT NULL AS DOUBLE)) * {w / sum(_W.values())!r}" for c, w in _W.items()) + f", 4) AS quality FROM {HARDWARE}",
    "quality_record": "SELECT row_id, round(" + " + ".join(f"CASE WHEN {_u(c)} IS NOT NULL THEN least(1.0, length({_u(c)})::DOUBLE / 50) * {w}::DOUBLE ELSE 0.0 END" for c, w in _W.items()) + " + 0.2::DOUBLE * (" + " + ".join(f"CAST({_u(c)} IS NOT NULL AS INTEGER)" for c in _W) + f") / {len(_W)}, 4) AS quality FROM {HARDWARE}",
    "record_stats": f"SELECT count(*) AS records, count({_u('power_consumption')}) AS power, count({_u('dimensions')}) AS size, count({_u('connectivity')}) AS ports FROM {HARDWARE}",
    "prop_hist": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS property, count({_u(c)}) AS n FROM {HARDWARE}" for c in _FIELDS) + ") WHERE n > 0",
    "run_stats": "SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS errors, round(avg(value), 4) AS mean_value FROM events GROUP BY user_id",
    "moving_stats": "SELECT event_id, CAST(floor(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) * 10 + 1e-6) AS BIGINT) AS moving_tenths FROM events",
    "alerts": "WITH r AS (SELECT user_id, avg(CAST(event_type = 'error' AS DOUBLE)) AS rate FROM events GROUP BY user_id) SELECT user_id, CASE WHEN rate > 0.25 THEN 'high' WHEN rate > 0.2 THEN 'raised' ELSE 'normal' END AS level FROM r",
    "recent_n": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10",
}
