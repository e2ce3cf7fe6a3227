"""Queries of catalogue matching, joins, set operations, increments and enrichment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions.text import collapse_blanks
from quarrymill.operators import catalogue as K
from quarrymill.operators import enrich as E
from quarrymill.operators import tables as T
from quarrymill.operators.merge import continue_rows
from quarrymill.session import table

_PREPARED = r"""
flat AS (SELECT "序号", trim(regexp_replace("品名", '[ \t\n\r\f]+', ' ', 'g'), ' ') AS f, "别名" AS ref_alias, nullif(regexp_replace("CAS号", '[ \t\n\r\f]', '', 'g'), '') AS ref_id FROM hazard_catalog),
split AS (SELECT trim(regexp_replace(f, '\[[^\]]*\]', '', 'g'), ' ') AS ref_name, ref_alias, regexp_extract(f, '\[([^\]]*)\]', 1) AS threshold, ref_id, "序号" AS ref_order FROM flat),
ref AS (SELECT * FROM split WHERE ref_name <> '' QUALIFY row_number() OVER (PARTITION BY ref_name ORDER BY ref_order) = 1)"""


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.prepare_catalogue(table(spark, sf_dir, "hazard_catalog"), "品名", "别名", "CAS号", "序号")


def ref_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: every row of the substances against the catalogue, by id first, else by name."""
    return K.match_reference(table(spark, sf_dir, "sample_chemicals"), _catalogue(spark, sf_dir), "row_id", "品名", "CAS号")


def anti_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = K.missing_from(_catalogue(spark, sf_dir), table(spark, sf_dir, "sample_chemicals"), "品名", "CAS号")
    return found.select("ref_order", "ref_name", "ref_id")


def distinct_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sample_chemicals").select("row_id", "品名", "CAS号")
    return K.keep_first(rows, ["品名"], "row_id")


def dup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sample_chemicals").select("品名", "CAS号", "备注", "source_file")
    kinds = {"row": rows.columns, "name": ["品名"], "id": ["CAS号"]}
    parts = [rows.groupBy(*keys).count().agg(F.sum(F.col("count") - 1).alias("duplicates")).select(F.lit(kind).alias("kind"), "duplicates") for kind, keys in kinds.items()]
    return parts[0].union(parts[1]).union(parts[2])


def continuation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sample_chemicals_raw").select("raw_id", "source_file", "line_no", "raw_text")
    kept = continue_rows(K.keep_first(rows, ["source_file", "line_no"], "raw_id"), "source_file", "line_no", "raw_text", ~F.col("raw_text").contains(","))
    return kept.select("source_file", "line_no", F.md5("raw_text").alias("hash"))


def continuation_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sample_chemicals_raw").select("raw_id", "source_file", "line_no", "raw_text")
    kept = continue_rows(K.keep_first(rows, ["source_file", "line_no"], "raw_id"), "source_file", "line_no", "raw_text", ~F.col("raw_text").contains(","), chunk=64, every=True)
    return kept.select("source_file", "line_no", F.md5("raw_text").alias("hash"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sample_chemicals")
    missing = rows.where((F.coalesce(F.trim("CAS号"), F.lit("")) == "") & (F.trim("品名") != ""))
    return missing.select(F.trim("品名").alias("name")).distinct()


def id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _catalogue(spark, sf_dir).select(F.col("ref_name").alias("name"), F.col("ref_id").alias("id"), F.col("ref_order").alias("ord"))
    return K.lookup_ids(_names(spark, sf_dir), entries)


def fill_missing_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sample_chemicals").select("row_id", F.trim("品名").alias("name"), F.nullif(F.trim("CAS号"), F.lit("")).alias("id"))
    found = id_lookup(spark, sf_dir)
    return rows.join(found, "name", "left").select("row_id", F.coalesce("id", "found_id").alias("id"))


def _people(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    customers = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"))
    return [customers, suppliers]


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.union_all(_people(spark, sf_dir))


def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey").exceptAll(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey")).distinct())


def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "hazard_catalog").select(F.trim("品名").alias("name")).union(table(spark, sf_dir, "sample_chemicals").select(F.trim("品名")))
    organisation = "公司|企业|集团|厂"
    return names.where(F.length("name").between(2, 20) & ~F.col("name").rlike(organisation)).distinct()


def _sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [
        table(spark, sf_dir, "hazard_catalog").select(F.trim("品名").alias("name"), F.col("CAS号").alias("id"), F.col("序号").cast("long").alias("pos")),
        table(spark, sf_dir, "sample_chemicals").select(F.trim("品名").alias("name"), F.col("CAS号").alias("id"), F.col("row_id").alias("pos")),
    ]


def union_dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.union_distinct(_sources(spark, sf_dir), "name", "pos")


def union_dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.union_distinct(_sources(spark, sf_dir), "name", "pos", last=True)


def failed_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "sample_chemicals").where(F.coalesce(F.trim("品名"), F.lit("")) == "").select("row_id", F.col("CAS号").alias("id"), F.lit("name missing").alias("reason"))
    lost = anti_two_keys(spark, sf_dir).select(F.col("ref_name").alias("name"), F.col("ref_id").alias("id"), F.lit("not in data").alias("reason"))
    return bad.unionByName(lost, allowMissingColumns=True)


def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return T.pending_rows(documents.select("doc_id"), table(spark, sf_dir, "doc_labels").select("doc_id"), ["doc_id"])


def changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed since a registry that knows the documents published before the median date, some with stale counts."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    registry = documents.select("doc_id", F.md5(F.concat_ws("|", F.col("text"), F.length("text").cast("string"))).alias("hash"))
    return T.changed_rows(documents, registry, "doc_id", F.md5(F.concat_ws("|", F.col("text"), F.col("n_chars").cast("string")))).select("doc_id", "hash")


def discovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = table(spark, sf_dir, "hazard_catalog").select(F.explode(F.split("别名", "[;；]")).alias("name")).select(F.trim("name").alias("name")).where("name <> ''").distinct()
    return aliases.join(_catalogue(spark, sf_dir).select(F.col("ref_name").alias("name")), "name", "left_anti")


def ttl_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.unexpired(table(spark, sf_dir, "events"), "ts", 86400 * 7, F.to_timestamp(F.lit("2024-01-20 00:00:00"))).select("event_id")


def alias_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "hazard_catalog").withColumn("extra", F.element_at(F.split("别名", "[;；]"), -1))
    return T.merge_alias(rows, "品名", "别名").select("序号", "别名")


def alias_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main name of every alias: of several, that of the last entry; names without one stand for themselves."""
    entries = table(spark, sf_dir, "hazard_catalog").select(F.trim("品名").alias("main"), "序号", F.explode(F.split("别名", "[;；]")).alias("a"))
    mapping = entries.select(F.trim("a").alias("name"), "main", "序号").where("name <> ''").groupBy("name").agg(F.max_by("main", "序号").alias("main"))
    rows = table(spark, sf_dir, "sample_chemicals").select("row_id", F.trim("品名").alias("name"))
    return rows.join(mapping, "name", "left").select("row_id", F.coalesce("main", "name").alias("name"))


def batch_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sample_chemicals_raw").groupBy(T.batch_number(F.col("source_file")).alias("batch")).agg(F.count("*").alias("n"))


def batch_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.number_batches(table(spark, sf_dir, "sample_chemicals"), "row_id", 200).groupBy("batch").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


def missing_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.missing_numbers(table(spark, sf_dir, "doc_labels").select("doc_id"), "doc_id")


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return lines.where(collapse_blanks(F.col("line")) != "").groupBy("doc_id").agg(F.count("*").alias("lines"))


def skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.skeleton(spark, table(spark, sf_dir, "traditional_chinese_medicine_material_enriched"), "名称", ["nature", "taste"])


def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sample_chemicals")
    return rows.select("row_id", E.build_prompt(F.col("品名"), ["分子式", "用途"], F.col("CAS号")).alias("prompt"))


def enrich_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = E.Limits(10**9, 10**12, 10**12, 100)
    return E.enrich(table(spark, sf_dir, "hazard_catalog"), "品名", ["分子式", "用途"], E.stub_client, big)


def apply_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short codes and names of makers mapped to the full name."""
    items = table(spark, sf_dir, "reference_items").where("list_name = 'manufacturer'")
    mapping = items.select(F.col("name_zh").alias("value"), "canonical_name").union(items.select("short_code", "canonical_name")).where("value is not null").groupBy("value").agg(F.min("canonical_name").alias("canonical"))
    rows = table(spark, sf_dir, "enriched_pc_hardware_database").select("row_id", F.trim("manufacturer").alias("value"))
    return rows.join(mapping, "value", "left").select("row_id", F.coalesce("canonical", "value").alias("maker"))


_KEYS = [
    "ref_match", "anti_two_keys", "distinct_first", "dup_counts", "continuation_merge", "continuation_runs", "id_lookup", "fill_missing_id", "union_by_name",
    "set_difference", "set_union", "union_dedup_first", "union_dedup_last", "failed_union", "resume_anti", "changed_rows", "discovered", "ttl_expire",
    "alias_merge", "alias_resolve", "batch_number", "batch_split", "missing_in_range", "text_lines", "skeleton", "prompt_build", "enrich_stub", "apply_map",
]
QUERIES = {name: globals()[name] for name in _KEYS}
QUERIES["ref_prepare"] = _catalogue

_ANTI = """missing AS (SELECT ref_order, ref_name, ref_id FROM ref WHERE NOT EXISTS (SELECT 1 FROM sample_chemicals WHERE trim("CAS号", ' ') = ref_id)
  AND NOT EXISTS (SELECT 1 FROM sample_chemicals WHERE trim("品名", ' ') = ref_name))"""
_SOURCES = """u AS (SELECT trim("品名", ' ') AS name, "CAS号" AS id, CAST("序号" AS BIGINT) AS pos, 0 AS source_no FROM hazard_catalog
  UNION ALL SELECT trim("品名", ' '), "CAS号", row_id, 1 FROM sample_chemicals), good AS (SELECT * FROM u WHERE trim(name, ' ') <> '' AND name <> 'nan')"""
_MISSING = """names AS (SELECT DISTINCT trim("品名", ' ') AS name FROM sample_chemicals WHERE coalesce(trim("CAS号", ' '), '') = '' AND length(trim("品名", ' ')) BETWEEN 2 AND 40),
near AS (SELECT name, arg_min(ref_id, ref_order) AS near_id FROM names JOIN ref ON (contains(name, ref_name) OR contains(ref_name, name)) AND length(ref_name) BETWEEN 2 AND 40 GROUP BY name),
found AS (SELECT n.name, coalesce(r.ref_id, near_id) AS found_id FROM names n LEFT JOIN ref r ON r.ref_name = n.name LEFT JOIN near ON near.name = n.name)"""
_LINES = """r AS (SELECT source_file, line_no, arg_min(raw_text, raw_id) AS t FROM sample_chemicals_raw GROUP BY ALL)"""
ORACLE = {
    "ref_prepare": f"WITH {_PREPARED} SELECT ref_name, ref_alias, threshold, ref_id, ref_order FROM ref",
    "ref_match": f"""WITH {_PREPARED},
      by_id AS (SELECT * FROM ref WHERE ref_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY ref_order DESC) = 1)
      SELECT row_id, CASE WHEN i.ref_name IS NOT NULL OR n.ref_name IS NOT NULL THEN '是' ELSE '否' END AS is_hazard,
        coalesce(CASE WHEN i.ref_name IS NOT NULL THEN i.ref_alias ELSE n.ref_alias END, '') AS alias,
        coalesce(CASE WHEN i.ref_name IS NOT NULL THEN i.threshold ELSE n.threshold END, '') AS threshold,
        coalesce(i.ref_name, trim(c."品名", ' ')) AS corrected_name
      FROM sample_chemicals c LEFT JOIN by_id i ON trim(c."CAS号", ' ') = i.ref_id LEFT JOIN ref n ON trim(c."品名", ' ') = n.ref_name""",
    "anti_two_keys": f"WITH {_PREPARED}, {_ANTI} SELECT * FROM missing",
    "distinct_first": """SELECT row_id, "品名", "CAS号" FROM sample_chemicals QUALIFY row_number() OVER (PARTITION BY "品名" ORDER BY row_id) = 1""",
    "dup_counts": """SELECT 'row' AS kind, (SELECT count(*) FROM sample_chemicals) - count(*) AS duplicates FROM (SELECT DISTINCT "品名", "CAS号", "备注", source_file FROM sample_chemicals)
      UNION ALL SELECT 'name', (SELECT count(*) FROM sample_chemicals) - count(*) FROM (SELECT DISTINCT "品名" FROM sample_chemicals)
      UNION ALL SELECT 'id', (SELECT count(*) FROM sample_chemicals) - count(*) FROM (SELECT DISTINCT "CAS号" FROM sample_chemicals)""",
    "continuation_merge": f"""WITH {_LINES}, n AS (SELECT a.*, b.t AS following FROM r a LEFT JOIN r b ON b.source_file = a.source_file AND b.line_no = a.line_no + 1)
      SELECT source_file, line_no, md5(t || CASE WHEN NOT contains(following, ',') THEN following ELSE '' END) AS hash FROM n WHERE contains(t, ',')""".replace("CASE WHEN NOT", "CASE WHEN following IS NOT NULL AND NOT"),
    "continuation_runs": f"""WITH {_LINES}, h AS (SELECT *, max(CASE WHEN contains(t, ',') THEN line_no END) OVER (PARTITION BY source_file ORDER BY line_no) AS head FROM r)
      SELECT source_file, head AS line_no, md5(string_agg(t, '' ORDER BY line_no)) AS hash FROM h WHERE head IS NOT NULL GROUP BY source_file, head""",
    "id_lookup": f"WITH {_PREPARED}, {_MISSING} SELECT name, found_id FROM found",
    "fill_missing_id": f"""WITH {_PREPARED}, {_MISSING} SELECT row_id, coalesce(nullif(trim("CAS号", ' '), ''), found_id) AS id FROM sample_chemicals LEFT JOIN found ON name = trim("品名", ' ')""",
    "union_by_name": "SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, c_custkey AS id, 0 AS source_no FROM customer UNION ALL SELECT s_name, s_nationkey, NULL, s_suppkey, 1 FROM supplier",
    "set_difference": "SELECT n_nationkey FROM nation EXCEPT ALL SELECT DISTINCT s_nationkey FROM supplier",
    "set_union": """SELECT DISTINCT name FROM (SELECT trim("品名", ' ') AS name FROM hazard_catalog UNION ALL SELECT trim("品名", ' ') FROM sample_chemicals) WHERE length(name) BETWEEN 2 AND 20 AND NOT regexp_matches(name, '公司|企业|集团|厂')""",
    "union_dedup_first": f"WITH {_SOURCES} SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY name ORDER BY source_no, pos) = 1",
    "union_dedup_last": f"WITH {_SOURCES} SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY name ORDER BY source_no DESC, pos DESC) = 1",
    "failed_union": f"""WITH {_PREPARED}, {_ANTI} SELECT row_id, "CAS号" AS id, 'name missing' AS reason, NULL AS name FROM sample_chemicals WHERE coalesce(trim("品名", ' '), '') = '' UNION ALL SELECT NULL, ref_id, 'not in data', ref_name FROM missing""",
    "resume_anti": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM doc_labels)",
    "changed_rows": "SELECT doc_id, md5(concat_ws('|', text, CAST(n_chars AS VARCHAR))) AS hash FROM documents WHERE md5(concat_ws('|', text, CAST(n_chars AS VARCHAR))) <> md5(concat_ws('|', text, CAST(length(text) AS VARCHAR)))",
    "discovered": f"""WITH {_PREPARED}, a AS (SELECT DISTINCT trim(unnest(string_split_regex("别名", '[;；]')), ' ') AS name FROM hazard_catalog) SELECT name FROM a WHERE name <> '' AND name NOT IN (SELECT ref_name FROM ref)""",
    "ttl_expire": "SELECT event_id FROM events WHERE ts + INTERVAL 7 DAY >= TIMESTAMP '2024-01-20 00:00:00'",
    "alias_merge": """SELECT "序号", CASE WHEN coalesce(trim("品名", ' '), '') = '' THEN trim("别名", ' ') WHEN coalesce(trim("别名", ' '), '') = '' THEN trim("品名", ' ')
      WHEN list_contains(string_split(trim("别名", ' '), '；'), trim("品名", ' ')) OR list_contains(string_split(trim("别名", ' '), ';'), trim("品名", ' ')) THEN trim("别名", ' ')
      ELSE trim("别名", ' ') || '；' || trim("品名", ' ') END AS "别名" FROM hazard_catalog""",
    "alias_resolve": """WITH e AS (SELECT trim("品名", ' ') AS main, "序号" AS o, trim(unnest(string_split_regex("别名", '[;；]')), ' ') AS name FROM hazard_catalog),
      m AS (SELECT name, arg_max(main, o) AS main FROM e WHERE name <> '' GROUP BY name)
      SELECT row_id, coalesce(main, trim("品名", ' ')) AS name FROM sample_chemicals LEFT JOIN m ON m.name = trim("品名", ' ')""",
    "batch_number": r"SELECT coalesce(CAST(nullif(regexp_extract(source_file, '_([0-9]+)\.csv$', 1), '') AS INTEGER), 0) AS batch, count(*) AS n FROM sample_chemicals_raw GROUP BY 1",
    "batch_split": "SELECT CAST(floor((row_id - 1) / 200) AS INTEGER) AS batch, count(*) AS n, min(row_id) AS first_row FROM sample_chemicals GROUP BY 1",
    "missing_in_range": "SELECT doc_id FROM (SELECT unnest(range((SELECT min(doc_id) FROM doc_labels), (SELECT max(doc_id) + 1 FROM doc_labels))) AS doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM doc_labels)",
    "text_lines": r"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS lines FROM l WHERE trim(regexp_replace(line, '[ \t\n\r\f]+', ' ', 'g'), ' ') <> '' GROUP BY doc_id",
    "skeleton": """SELECT DISTINCT "名称", '[待补全]' AS nature, '[待补全]' AS taste FROM traditional_chinese_medicine_material_enriched WHERE trim("名称", ' ') <> ''""",
    "prompt_build": """SELECT row_id, '请以JSON给出“' || "品名" || '”' || CASE WHEN coalesce("CAS号", '') <> '' THEN '（编号 ' || "CAS号" || '）' ELSE '' END || '的以下属性：分子式、用途' AS prompt FROM sample_chemicals""",
    "enrich_stub": """SELECT DISTINCT "品名", '分子式 of ' || "品名" AS "分子式", '用途 of ' || "品名" AS "用途", '成功' AS status FROM hazard_catalog WHERE trim("品名", ' ') <> ''""",
    "apply_map": """WITH i AS (SELECT name_zh AS value, canonical_name AS c FROM reference_items WHERE list_name = 'manufacturer' UNION ALL SELECT short_code, canonical_name FROM reference_items WHERE list_name = 'manufacturer'),
      m AS (SELECT value, min(c) AS c FROM i WHERE value IS NOT NULL GROUP BY value) SELECT row_id, coalesce(c, trim(manufacturer, ' ')) AS maker FROM enriched_pc_hardware_database LEFT JOIN m ON m.value = trim(manufacturer, ' ')""",
}
