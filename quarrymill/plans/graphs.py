"""Queries of relation extraction and the property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill import vocab as V
from quarrymill.functions.categories import categorize, solubility_grades
from quarrymill.functions.text import clean_node_name, split_list
from quarrymill.operators import graph as G
from quarrymill.operators.catalogue import keep_first
from quarrymill.operators.merge import usable
from quarrymill.plans.scalars import ORACLE_TEXT
from quarrymill.session import table

HARDWARE = "enriched_computer_hardware_knowledge"
PATTERNS = ["用于([^，,；;。]+?)对照", "以([^，,；;。为]+)为原料", "由([^，,；;。制]+)制得"]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sample_chemicals").select("row_id", F.trim("品名").alias("name"), F.col("备注").alias("note"), "CAS号").where("name <> ''")


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "hazard_catalog").select("序号", F.trim(F.regexp_replace("品名", r"\[[^\]]*\]", "")).alias("name"), "别名")


def dict_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaced = _rows(spark, sf_dir).withColumn("text", F.regexp_replace("note", "用于|对照", " "))
    return G.scan_names(spaced, "row_id", "text", _catalogue(spark, sf_dir).select("name").distinct())


def upstream_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _catalogue(spark, sf_dir).select("name").distinct()
    return G.upstream_materials(table(spark, sf_dir, "documents"), "doc_id", "text", "entity_name", known)


def edge_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges without those of which a like one with contained ends exists."""
    return G.drop_longer_edges(graph_edges(spark, sf_dir))


def graph_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every substance as a node with the columns that the tables have: hazards and thresholds of listed ones only."""
    listed = keep_first(_rows_of_catalogue(spark, sf_dir), ["name"], "o")
    rows = _rows(spark, sf_dir).join(listed, "name", "left")
    record = rows.select(
        F.col("name").alias("中文名称"), F.col("CAS号").alias("CAS号或流水号"), F.col("alias").alias("中文别名"), F.col("note").alias("危害"), F.col("threshold").alias("浓度阈值"),
        F.col("note").alias("data_source"), F.when(F.col("o").isNotNull(), "是").otherwise("否").alias("是否为危化品"),
    )
    return G.project_nodes(record, V.NODE_COLUMNS, "是否为危化品", V.HAZARD_COLUMNS)


def _rows_of_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.trim(F.regexp_replace("品名", r"\[[^\]]*\]", ""))
    return table(spark, sf_dir, "hazard_catalog").select(F.col("序号").alias("o"), name.alias("name"), F.col("别名").alias("alias"), F.regexp_extract("品名", r"\[([^\]]*)\]", 1).alias("threshold"))


def storage_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.class_edges(_rows(spark, sf_dir), "name", categorize(F.col("note"), V.STORAGE_CLASSES, "其他要求", "[,，;；]"), "REQUIRES_STORAGE")


def hazard_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.class_edges(_rows(spark, sf_dir), "name", categorize(F.col("note"), V.HAZARD_CLASSES, "其他", "[;；。]"), "HAS_HAZARD")


def solubility_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of the documents and what their texts say of their solubility."""
    documents = table(spark, sf_dir, "documents").select(F.trim("entity_name").alias("name"), "text")
    grades = F.transform(solubility_grades(F.col("text")), lambda x: F.struct(x["solvent"].alias("class"), x["grade"].alias("part")))
    return G.class_edges(documents, "name", grades, "HAS_SOLUBILITY")


def pattern_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.extract_by_patterns(F.col("note"), PATTERNS)
    return _rows(spark, sf_dir).select("row_id", F.posexplode(found).alias("i", "material")).select("row_id", "material")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _rows(spark, sf_dir).select("name", F.explode(G.extract_by_patterns(F.col("note"), PATTERNS)).alias("material"))
    clean = found.select(clean_node_name(F.col("name"), V.CONNECTIVES).alias("product"), clean_node_name(F.col("material"), V.CONNECTIVES).alias("material"))
    return clean.where("product <> material and product <> '' and material <> ''").distinct()


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.relation_edges(_pairs(spark, sf_dir))


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last row per name; hazardous names carry their own label."""
    rows = _rows(spark, sf_dir)
    latest = keep_first(rows, ["name"], "row_id", last=True)
    listed = _catalogue(spark, sf_dir).select("name").distinct().withColumn("listed", F.lit(True))
    joined = latest.join(listed, "name", "left")
    return joined.select("name", F.coalesce("CAS号", F.lit("")).alias("cas"), F.when(F.col("listed"), "DangerousChemical").otherwise("Chemical").alias("label"))


def process_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.process_nodes(graph_edges(spark, sf_dir))


def process_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.neighbours(graph_edges(spark, sf_dir), [V.TAKES_PART, V.COMES_FROM])
    return found.select("dst", F.col(V.TAKES_PART).alias("materials"), F.col(V.COMES_FROM).alias("products"))


def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("dst"),
        F.col("l_returnflag").alias("type"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )
    return G.dedup_edges(lines, "pos")


def edge_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = graph_nodes(spark, sf_dir).select("name").union(process_nodes(spark, sf_dir).select("name"))
    return G.resolve_edges(graph_edges(spark, sf_dir), nodes)


def edge_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_edges(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))


def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_nodes(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))


def alias_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.alias_edges(_catalogue(spark, sf_dir), "name", "别名")


_PROPS = ["power_consumption", "dimensions", "weight", "warranty_period"]


def prop_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.property_edges(table(spark, sf_dir, HARDWARE), "row_id", {c: usable(F.col(c)) for c in _PROPS})


def node_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, HARDWARE).select("名称", "row_id", F.struct("updated_at", "row_id").alias("version"), usable(F.col("manufacturer")).alias("maker"))
    return keep_first(rows.where(F.trim("名称") != ""), ["名称"], "version", last=True).select("名称", "row_id", "maker")


def record_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested records; shown here by scalars of their parts."""
    rows = table(spark, sf_dir, "sample_chemicals")
    record = F.struct(
        F.struct(F.trim("品名").alias("name"), F.trim("CAS号").alias("cas")).alias("basic_info"),
        split_list(F.col("备注")).alias("notes"),
        categorize(F.col("备注"), V.STORAGE_CLASSES, "其他要求", "[,，;；]").alias("storage"),
    )
    nested = rows.select("row_id", record.alias("r"))
    return nested.select("row_id", F.col("r.basic_info.name").alias("name"), F.size("r.notes").alias("notes"), F.get(F.col("r.storage"), F.lit(0))["class"].alias("first_class"))


def flatten_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user, a column for every kind of event that there is."""
    events = table(spark, sf_dir, "events")
    kinds = [r[0] for r in events.where("event_type is not null").select("event_type").distinct().orderBy("event_type").collect()]
    return events.groupBy("user_id").pivot("event_type", kinds).agg(F.count(F.lit(1))).na.fill(0)


_KEYS = [
    "dict_scan", "upstream_materials", "edge_containment", "graph_projection", "storage_edges", "hazard_edges", "solubility_edges", "pattern_extract", "graph_edges", "graph_nodes", "process_nodes", "process_neighbours", "edge_dedup", "edge_resolve", "edge_type_counts",
    "label_counts", "alias_edges", "prop_edges", "node_upsert", "record_struct", "flatten_pivot",
]
QUERIES = {name: globals()[name] for name in _KEYS}

_BAD = "('', 'N/A', 'null', 'nan', '未知', '无', '处理异常', '[待补全]')"
_ENDS = "|".join(sorted(V.CONNECTIVES, key=len, reverse=True))


def _clean(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '[^\x{{4e00}}-\x{{9fa5}}a-zA-Z0-9,，-]', '', 'g'), '(?:{_ENDS})$', '')"


_FOUND = " || ".join(f"regexp_extract_all(note, '{p}', 1)" for p in PATTERNS)
_BASE = rf"""rows AS (SELECT row_id, trim("品名", ' ') AS name, "备注" AS note, "CAS号" FROM sample_chemicals WHERE trim("品名", ' ') <> ''),
cat AS (SELECT "序号" AS o, trim(regexp_replace("品名", '\[[^\]]*\]', '', 'g'), ' ') AS name, "别名" AS alias FROM hazard_catalog),
found AS (SELECT row_id, name, trim(unnest(list_distinct({_FOUND})), ' ') AS material FROM rows),
good AS (SELECT DISTINCT row_id, name, material FROM found WHERE length(material) >= 2),
pairs AS (SELECT DISTINCT product, material FROM (SELECT {_clean("name")} AS product, {_clean("material")} AS material FROM good) WHERE product <> material AND product <> '' AND material <> ''),
edges AS (SELECT DISTINCT product || '_生产工艺' AS src, product AS dst, '产生' AS type FROM pairs UNION ALL SELECT DISTINCT product, product || '_生产工艺', '来源' FROM pairs
  UNION ALL SELECT material, product || '_生产工艺', '参与' FROM pairs UNION ALL SELECT product || '_生产工艺', material, '原料' FROM pairs),
ends AS (SELECT DISTINCT n AS name FROM (SELECT src AS n FROM edges UNION ALL SELECT dst FROM edges) WHERE contains(n, '工艺')),
nodes AS (SELECT name, coalesce("CAS号", '') AS cas, CASE WHEN name IN (SELECT name FROM cat) THEN 'DangerousChemical' ELSE 'Chemical' END AS label FROM rows QUALIFY row_number() OVER (PARTITION BY name ORDER BY row_id DESC) = 1)"""
_STORE = "CASE " + " ".join(f"WHEN regexp_matches(p, '{'|'.join(w)}') THEN '{c}'" for c, w in V.STORAGE_CLASSES) + " ELSE '其他要求' END"
_HAZARD = "CASE WHEN regexp_matches(p, '中毒|有毒|致命|急性') THEN '急性毒性' WHEN regexp_matches(p, '皮肤|灼伤|刺激') THEN '皮肤刺激' WHEN regexp_matches(p, '眼|眼睛|眼部') THEN '眼部刺激' WHEN regexp_matches(p, '呼吸|吸入') THEN '呼吸道刺激' WHEN regexp_matches(p, '致癌|癌') THEN '致癌性' WHEN regexp_matches(p, '致突变|突变') THEN '致突变性' WHEN regexp_matches(p, '生殖|胎儿') THEN '生殖毒性' ELSE '其他' END"
_SOLVENT = "CASE " + " ".join(f"WHEN contains(p, '{w}') THEN '{w}'" for w in ("水", "乙醇", "乙醚", "苯", "氯仿", "丙酮", "酸", "碱")) + " END"
_GRADE = "CASE " + " ".join(f"WHEN contains(p, '{w}') THEN '{w}'" for w in ("溶于", "不溶于", "微溶于", "易溶于", "难溶于", "混溶", "任意比例混溶")) + " ELSE '未知' END"
_LISTS = [
    "上游原料[：:]?\\s*包括\\s*([^。；;]+)", "原料(?:包括)?[：:]\\s*([^。；;]+)", "以\\s*([^为]+?)\\s*为原料", "由\\s*([^制]+?)\\s*(?:制得|制成|制备)",
    "从\\s*([^中]+?)\\s*中(?:提取|分离|得到)", "([^。；;，,]+?)\\s*(?:裂解|氧化|分解)(?:得到|制得|产生)", "原料.*?包括\\s*([^。；;]+)", "主要原料[：:]?\\s*([^。；;]+)",
    "所需原料[：:]?\\s*([^。；;]+)", "以\\s*([^。；;，,]*(?:、[^。；;，,]*)*)\\s*(?:等\\s*)?(?:化学品|原料|物质)",
    "使用\\s*([^。；;，,]*(?:、[^。；;，,]*)*)\\s*(?:等\\s*)?(?:作为|为)\\s*原料", "从\\s*([^。；;，,]*(?:、[^。；;，,]*)*)\\s*(?:等\\s*)?中",
]
_UPSTREAM = rf"""cat AS (SELECT DISTINCT trim(regexp_replace("品名", '\[[^\]]*\]', '', 'g'), ' ') AS name FROM hazard_catalog),
d AS (SELECT doc_id, trim(entity_name, ' ') AS product, {ORACLE_TEXT["remove_producers"]} AS t FROM documents),
l AS (SELECT doc_id, product, unnest({" || ".join(f"regexp_extract_all(t, '{p}', 1)" for p in _LISTS)}) AS x FROM d),
s AS (SELECT doc_id, product, unnest({ORACLE_TEXT["smart_split"]}) AS n FROM l),
m AS (SELECT doc_id, product, {_clean("trim(regexp_replace(regexp_replace(trim(n, ' '), '^(?:通过|经过|利用|使用|主要|从|由)[ \t\n\r\f]*', ''), '(?s)[ \t\n\r\f]*(?:等|类|反应|制得|制备|制成|裂解|氧化|分解|化学品|原料|物质).*$', ''), ' ')")} AS material FROM s),
ph AS (SELECT DISTINCT doc_id, material FROM m WHERE length(material) >= 2 AND material IS DISTINCT FROM product AND NOT regexp_matches(material, '[制得备成反应裂解氧化分]') AND (material IN (SELECT name FROM cat) OR {ORACLE_TEXT["name_plausible"].format("material")})),
h AS (SELECT DISTINCT doc_id, {_clean("c.name")} AS material FROM d JOIN cat c ON contains(t, c.name) AND c.name IS DISTINCT FROM product AND length(c.name) >= 2
  AND regexp_matches(' ' || t || ' ', '[^a-zA-Z\x{{4e00}}-\x{{9fa5}}]' || regexp_escape(c.name) || '[^a-zA-Z\x{{4e00}}-\x{{9fa5}}]')),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(material) DESC, material) AS r FROM h ANTI JOIN ph USING (doc_id, material) WHERE material <> '')"""
_BRACED = r"array_to_string(list_distinct(list_filter(list_transform(flatten(list_transform(regexp_extract_all(note, '\{([^}]+)\}', 1), lambda g: string_split_regex(g, '[;；、,，]'))), lambda x: trim(x, ' ')), lambda x: length(x) > 1)), '; ')"
ORACLE = {
    "graph_projection": rf"""WITH {_BASE}, c1 AS (SELECT o, name, alias, threshold FROM (SELECT "序号" AS o, trim(regexp_replace("品名", '\[[^\]]*\]', '', 'g'), ' ') AS name, "别名" AS alias, regexp_extract("品名", '\[([^\]]*)\]', 1) AS threshold FROM hazard_catalog) QUALIFY row_number() OVER (PARTITION BY name ORDER BY o) = 1)
      SELECT {_clean("r.name")} AS "name:ID", coalesce(CASE WHEN NOT regexp_matches("CAS号", '[\x{{4e00}}-\x{{9fa5}}]') THEN "CAS号" END, '') AS "cas:string",
      coalesce(array_to_string(list_filter(list_transform(string_split_regex(alias, '[;；|]'), lambda x: {_clean("trim(x, ' ')")}), lambda x: x <> ''), ';'), '') AS "aliases:string[]",
      CASE WHEN o IS NOT NULL THEN coalesce(note, '') ELSE '' END AS "hazard:string", coalesce(nullif({_BRACED}, ''), '根据通义大模型蒸馏而来') AS "source:string",
      CASE WHEN o IS NOT NULL THEN coalesce(threshold, '') ELSE '' END AS "concentration_threshold:string", CASE WHEN o IS NOT NULL THEN 'DangerousChemical;Chemical' ELSE 'Chemical' END AS ":LABEL"
      FROM rows r LEFT JOIN c1 ON c1.name = r.name WHERE {_clean("r.name")} <> ''""",
    "upstream_materials": f"WITH {_UPSTREAM} SELECT doc_id, material FROM ph UNION ALL SELECT o.doc_id, o.material FROM o LEFT JOIN (SELECT doc_id, count(*) AS n FROM ph GROUP BY doc_id) k USING (doc_id) WHERE r <= greatest(1, 5 - coalesce(n, 0))",
    "edge_containment": f"WITH {_BASE} SELECT src, dst, type FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges f WHERE f.type = e.type AND (f.src <> e.src OR f.dst <> e.dst) AND contains(e.src, f.src) AND contains(e.dst, f.dst))",
    "storage_edges": f"WITH {_BASE}, q AS (SELECT DISTINCT name, trim(unnest(string_split_regex(note, '[,，;；]')), ' ') AS p FROM rows) SELECT DISTINCT name AS src, 'REQUIRES_STORAGE' AS relation, {_STORE} AS class, p AS value FROM q WHERE p <> ''",
    "hazard_edges": f"WITH {_BASE}, q AS (SELECT DISTINCT name, trim(unnest(string_split_regex(note, '[;；。]')), ' ') AS p FROM rows) SELECT DISTINCT name AS src, 'HAS_HAZARD' AS relation, {_HAZARD} AS class, p AS value FROM q WHERE p <> ''",
    "solubility_edges": f"WITH q AS (SELECT DISTINCT trim(entity_name, ' ') AS src, trim(unnest(string_split_regex(text, '[,，;；。]')), ' ') AS p FROM documents) SELECT DISTINCT src, 'HAS_SOLUBILITY' AS relation, {_SOLVENT} AS class, {_GRADE} AS value FROM q WHERE src <> '' AND p <> '' AND {_SOLVENT} IS NOT NULL AND NOT (regexp_matches(p, '[0-9]') AND regexp_matches(p, 'g/mL|g/L'))",
    "dict_scan": rf"""WITH {_BASE}, t AS (SELECT row_id, regexp_replace(note, '用于|对照', ' ', 'g') AS text FROM rows WHERE note IS NOT NULL),
      h AS (SELECT DISTINCT row_id, c.name FROM t JOIN cat c ON contains(text, c.name) AND regexp_matches(' ' || text || ' ', '[^a-zA-Z\x{{4e00}}-\x{{9fa5}}]' || regexp_escape(c.name) || '[^a-zA-Z\x{{4e00}}-\x{{9fa5}}]') WHERE length(c.name) >= 2)
      SELECT * FROM (SELECT row_id, name, CAST(row_number() OVER (PARTITION BY row_id ORDER BY length(name) DESC, name) AS INTEGER) AS rank FROM h) WHERE rank <= 5""",
    "pattern_extract": f"WITH {_BASE} SELECT row_id, material FROM good",
    "graph_edges": f"WITH {_BASE} SELECT * FROM edges",
    "graph_nodes": f"WITH {_BASE} SELECT * FROM nodes",
    "process_nodes": f"WITH {_BASE} SELECT name, '化学生产工艺' AS process_type, regexp_replace(name, '_生产工艺$', '') AS product FROM ends",
    "process_neighbours": f"WITH {_BASE} SELECT dst, coalesce(string_agg(DISTINCT src, ';' ORDER BY src) FILTER (WHERE type = '参与'), '') AS materials, coalesce(string_agg(DISTINCT src, ';' ORDER BY src) FILTER (WHERE type = '来源'), '') AS products FROM edges WHERE type IN ('参与', '来源') GROUP BY dst",
    "edge_dedup": "SELECT 'S' || l_suppkey AS src, 'P' || l_partkey AS dst, l_returnflag AS type, min(l_orderkey * 10 + l_linenumber) AS pos FROM lineitem GROUP BY 1, 2, 3",
    "edge_resolve": f"WITH {_BASE}, k AS (SELECT name FROM nodes UNION SELECT name FROM ends) SELECT DISTINCT src, dst, type FROM edges WHERE src IN (SELECT name FROM k) AND dst IN (SELECT name FROM k)",
    "edge_type_counts": f"WITH {_BASE} SELECT type, count(*) AS n FROM edges GROUP BY type",
    "label_counts": f"WITH {_BASE} SELECT label, count(*) AS n FROM nodes GROUP BY label",
    "alias_edges": f"WITH {_BASE}, a AS (SELECT DISTINCT name AS src, trim(unnest(string_split_regex(alias, '[;；]')), ' ') AS dst FROM cat) SELECT src, dst, dst IN (SELECT name FROM cat) AS is_known FROM a WHERE src <> '' AND dst <> '' AND src <> dst",
    "prop_edges": " UNION ALL ".join(f"SELECT row_id, 'HAS_PROPERTY' AS relation, '{c}' AS kind, trim({c}, ' ') AS value FROM {HARDWARE} WHERE trim({c}, ' ') NOT IN {_BAD}" for c in _PROPS),
    "node_upsert": f"""SELECT "名称", row_id, CASE WHEN trim(manufacturer, ' ') NOT IN {_BAD} THEN trim(manufacturer, ' ') END AS maker FROM {HARDWARE} WHERE trim("名称", ' ') <> '' QUALIFY row_number() OVER (PARTITION BY "名称" ORDER BY updated_at DESC, row_id DESC) = 1""",
    "record_struct": f"""WITH r AS (SELECT row_id, trim("品名", ' ') AS name, "备注", list_filter(list_transform(string_split_regex("备注", '[;；,，、]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS n, list_filter(list_transform(string_split_regex("备注", '[,，;；]'), lambda x: trim(x, ' ')), lambda x: x <> '')[1] AS p FROM sample_chemicals)
      SELECT row_id, name, CAST(len(n) AS INTEGER) AS notes, CASE WHEN p IS NOT NULL THEN {_STORE} END AS first_class FROM r""",
    "flatten_pivot": "SELECT * FROM (PIVOT (SELECT user_id, event_type FROM events) ON event_type USING count(*) GROUP BY user_id)",
}
