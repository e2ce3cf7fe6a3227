"""Queries of the scalar functions: text, measures, identifiers, categories, JSON text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import categories as C
from quarrymill.functions import identifiers as I
from quarrymill.functions import json_text as J
from quarrymill.functions import measures as M
from quarrymill.functions import text as X
from quarrymill import vocab as V
from quarrymill.session import table

# SQL of single expressions that other modules' queries need too.
ORACLE_TEXT: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Every document and every remark, as they stand.
_TEXTS = "(SELECT 'documents' AS origin, doc_id AS id, text FROM documents UNION ALL SELECT 'sample_chemicals', row_id, 备注 FROM sample_chemicals) AS v"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text")
    return documents.union(table(spark, sf_dir, "sample_chemicals").select(F.lit("sample_chemicals"), "row_id", "备注"))


def _over_texts(name: str, run: Callable[[DataFrame, list[str]], DataFrame], sql: Callable[[str, str], str]) -> None:
    """A query over every text of the tables, which are known by their origin and id."""
    QUERIES[name] = lambda spark, sf_dir: run(_texts(spark, sf_dir), ["origin", "id"])
    ORACLE[name] = sql("origin, id", _TEXTS)


def _scalar(name: str, source: str, key: str, columns: dict[str, tuple[Callable[[], Column], str]]) -> None:
    """A query that shows expressions of every row of a table beside its key."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, source).select(key, *[make().alias(c) for c, (make, _) in columns.items()])

    QUERIES[name] = run
    ORACLE[name] = f"SELECT {key}, " + ", ".join(f"{sql} AS {c}" for c, (_, sql) in columns.items()) + f" FROM {source}"


def _shown(name: str, columns: dict[str, tuple[Callable[[], Column], str]]) -> None:
    shown = ", ".join(f"{sql} AS {c}" for c, (_, sql) in columns.items())
    run = lambda df, keys: df.select(*keys, *[make().alias(c) for c, (make, _) in columns.items()])
    _over_texts(name, run, lambda keys, source: f"SELECT {keys}, {shown} FROM {source}")


def _in(words: list[str]) -> str:
    return ", ".join("'" + w + "'" for w in words)


_CLEAN = r"trim(regexp_replace(regexp_replace({0}, '[ \t\n\r\f\x0B]+', ' ', 'g'), '[\x00-\x1f\x7f]', '', 'g'))"
_scalar("clean_text", "documents", "doc_id", {"clean": (lambda: X.clean_text(F.col("text")), _CLEAN.format("text"))})
_scalar("ws_collapse", "documents", "doc_id", {"flat": (lambda: X.collapse_blanks(F.col("text")), r"trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'))")})
_scalar("truncate", "documents", "doc_id", {"short": (lambda: X.truncate(F.col("text"), 100), "CASE WHEN length(text) > 100 THEN text[1:97] || '...' ELSE text END")})
_scalar(
    "lang_class",
    "documents",
    "doc_id",
    {"class": (lambda: X.language_class(F.col("text")), r"CASE WHEN regexp_matches(text, '[\x{4e00}-\x{9fff}]') THEN 'zh' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'other' END")},
)
_scalar(
    "mask_tokens",
    "documents",
    "doc_id",
    {"masked": (lambda: X.mask_tokens(F.col("text")), r"regexp_replace(text, '([A-Za-z0-9]{4})[A-Za-z0-9]{12,}([A-Za-z0-9]{4})', '\1****\2', 'g')")},
)


def _prefixes() -> str:
    out = _CLEAN.format('"品名"')
    for p in V.GRADE_PREFIXES:
        out = f"regexp_replace({out}, '^{p} *', '')"
    return rf"regexp_replace({out}, '[（(]([^）)]*)[）)]', '(\1)', 'g')"


_scalar("normalize_name", "sample_chemicals", "row_id", {"name": (lambda: X.normalize_name(F.col("品名"), V.GRADE_PREFIXES), _prefixes())})


def _synonyms(column: str) -> str:
    for first, *others in V.SYNONYMS:
        for other in others:
            column = f"replace({column}, '{other}', '{first}')"
    return column


_shown("synonym_fold", {"folded": (lambda: X.fold_synonyms(F.col("text"), V.SYNONYMS), _synonyms("text"))})
_ENDS = "|".join(sorted(V.CONNECTIVES, key=len, reverse=True))
_scalar(
    "clean_node_name",
    "hazard_catalog",
    '序号',
    {"name": (lambda: X.clean_node_name(F.col("品名"), V.CONNECTIVES), rf"regexp_replace(regexp_replace(品名, '[^\x{{4e00}}-\x{{9fa5}}a-zA-Z0-9,，-]', '', 'g'), '(?:{_ENDS})$', '')")},
)
_FILL = "|".join(sorted(V.NAME_FILLERS, key=lambda w: (-len(w), w)))
_ADV = "trim({0})"
for _p in (r"[（(][^）)]*[）)]", r"[【\[][^】\]]*[】\]]", _FILL, r"[（()）\[\]【】]"):
    _ADV = f"regexp_replace({_ADV}, '{_p}', '', 'g')"
_ADV = rf"regexp_replace({_ADV}, '^[0-9]+[.、][ \t]*', '')"
_ADV = rf"regexp_replace({_ADV}, '[，,；;：:。. \t\n\r\f]+', '', 'g')".replace("{0}", "品名")
_scalar(
    "clean_name_adv",
    "sample_chemicals",
    "row_id",
    {"name": (lambda: X.clean_name(F.col("品名"), V.NAME_FILLERS), f"CASE WHEN length({_ADV}) BETWEEN 2 AND 50 AND NOT regexp_full_match({_ADV}, '[0-9]+') AND NOT regexp_matches({_ADV}, '^[用于作为通过经过]') THEN {_ADV} ELSE '' END")},
)
_CJK = r"regexp_replace(regexp_replace(品名, '[()（）【】\[\]<>《》].*?[()（）【】\[\]<>《》]', '', 'g'), '[^\x{4e00}-\x{9fa5}·]', '', 'g')"
_scalar(
    "clean_name_cjk",
    "sample_chemicals",
    "row_id",
    {"name": (lambda: X.clean_name_chinese(F.col("品名"), V.NAME_STOP_WORDS), f"CASE WHEN length({_CJK}) BETWEEN 2 AND 20 AND {_CJK} NOT IN ({_in(V.NAME_STOP_WORDS)}) THEN {_CJK} ELSE '' END")},
)
_scalar(
    "split_list",
    "hazard_catalog",
    "序号",
    {"parts": (lambda: F.array_join(X.split_list(F.col("别名")), "|"), "array_to_string(list_filter(list_transform(string_split_regex(别名, '[;；,，、]'), lambda x: trim(x)), lambda x: x <> ''), '|')")},
)
_scalar(
    "split_first_sep",
    "hazard_catalog",
    "序号",
    {
        "parts": (
            lambda: F.array_join(X.split_first_separator(F.col("别名"), [";", "；", ",", "，"]), "|"),
            "array_to_string(CASE WHEN 别名 IS NULL THEN NULL "
            + " ".join(f"WHEN contains(别名, '{s}') THEN list_filter(list_transform(string_split(别名, '{s}'), lambda x: trim(x)), lambda x: x <> '')" for s in (";", "；", ",", "，"))
            + " WHEN trim(别名) <> '' THEN [trim(别名)] ELSE [] END, '|')",
        )
    },
)
QUERIES["split_first_sep"] = lambda spark, sf_dir: table(spark, sf_dir, "hazard_catalog").select(
    "序号", F.when(F.col("别名").isNotNull(), F.array_join(X.split_first_separator(F.col("别名"), [";", "；", ",", "，"]), "|")).alias("parts")
)
_scalar(
    "bracket_split",
    "hazard_catalog",
    "序号",
    {
        "name": (lambda: F.trim(F.regexp_replace("品名", r"\[[^\]]*\]", "")), r"trim(regexp_replace(品名, '\[[^\]]*\]', '', 'g'))"),
        "threshold": (lambda: F.regexp_extract("品名", r"\[([^\]]*)\]", 1), r"regexp_extract(品名, '\[([^\]]*)\]', 1)"),
    },
)
_scalar("safe_name", "enriched_pc_hardware_database", "row_id", {"file": (lambda: X.safe_name(F.col("product_name")), r"left(regexp_replace(product_name, '[<>:""/\\|?*\x00-\x1f ]', '_', 'g'), 80)".replace('""', '"'))})
_scalar("clean_nulls", "enriched_pc_hardware_database", "row_id", {c: (lambda c=c: X.null_tokens(F.col(c), V.NO_VALUE), f"CASE WHEN trim({c}) NOT IN ({_in(V.NO_VALUE)}) THEN {c} END") for c in ("component_type", "manufacturer", "form_factor")})
_BARE = "regexp_replace(trim({0}), '^[\"'']+|[\"'']+$', '', 'g')"
_scalar(
    "clean_value",
    "enriched_computer_hardware_knowledge",
    "row_id",
    {c: (lambda c=c: X.clean_answer(F.col(c), V.INVALID_ANSWERS), f"CASE WHEN lower({_BARE.format(c)}) NOT IN ({_in(V.INVALID_ANSWERS)}) AND NOT regexp_full_match({_BARE.format(c)}, '<.*>') AND NOT regexp_full_match({_BARE.format(c)}, '\\[.*\\]') THEN {_BARE.format(c)} END") for c in ("manufacturer", "warranty_period")},
)
_FIELDS = ["name", "manufacturer", "category", "power_consumption", "weight", "connectivity"]
_scalar(
    "valid_field_count",
    "enriched_computer_hardware_knowledge",
    "row_id",
    {"n": (lambda: sum((X.is_valid_field(F.col(c), V.INVALID_FIELDS).cast("int") for c in _FIELDS), F.lit(0)), " + ".join(f"CAST(coalesce(upper(trim({c})) NOT IN ({_in(V.INVALID_FIELDS)}) AND NOT regexp_full_match(trim({c}), '[0-9]'), false) AS INTEGER)" for c in _FIELDS))},
)
_PLAUSIBLE = (
    "coalesce(length({0}) BETWEEN 1 AND 20 AND {0} NOT IN ('等', '类', '中', '上', '下', '前', '后', '左', '右', '内', '外', '高', '低', '大', '小', '多', '少', '好', '坏', "
    "'新', '旧', '快', '慢', '热', '冷', '工业', '农业', '医药', '食品', '化工', '生产', '制造', '加工', '处理', '使用', '应用', '方法', '技术', '工艺', '公司', '企业', '有限', "
    "'股份', '集团', '反应', '制备', '合成', '包括', '通过石油', '经过石油', '利用石油', '使用石油', '乙烯氢气', '通过') AND NOT regexp_matches({0}, '[-0-9%％+=*#@$&^~`|\\\\\"''\\[\\]<>《》]') "
    "AND ({0} IN ('苯', '甲苯', '二甲苯', '石油', '煤', '天然气', '水', '氨', '氢气', '氧气', '氮气') OR regexp_matches({0}, '[酸碱盐醇醛酮酯醚烷烯炔苯酚腈甲乙丙丁戊己庚辛壬癸正异叔仲邻间对顺反"
    "氢氧氮氯硫钠钾钙镁铁铜锌铅汞银聚环二三四五六七八九十气油脂胶]')), false)"
)
_scalar("name_plausible", "sample_chemicals", "row_id", {"ok": (lambda: X.name_plausible(F.col("品名"), V.NAME_INVALID_WORDS, V.NAME_ALWAYS_VALID, V.NAME_MARKS), _PLAUSIBLE.format("品名"))})
_SPLIT_HELD = "regexp_replace(regexp_replace({0}, '([0-9]),([0-9])', '\\1~~\\2', 'g'), '([0-9]),([0-9])', '\\1~~\\2', 'g')"
_CUT = "trim(regexp_replace(regexp_replace(trim(replace({0}, '~~', ',')), '^(?:由|从|以|通过|经过|利用|使用|主要|含有|含)[ \\t\\n\\r\\f]*', ''), '(?s)[ \\t\\n\\r\\f]*(?:等|类|制得|制备|制成|生产|合成|反应|裂解|氧化|分解|化学品|原料|物质|材料|中提取|为原料|作为溶剂).*$', ''))"
_NAMES = "list_filter(list_transform(string_split_regex({1}, '[、;；,和与及或等]+'), lambda y: " + _CUT.format("y") + "), lambda y: length(y) >= 2)"
_REST = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?:主要)?(?:生产商|生厂商|制造商|生产企业|制造企业)[^。；;，,]*', '', 'g'), "
    "'[^。；;，,]*(?:公司|企业|厂|集团)[^。；;，,]*(?:[。；;，,]|$)', '', 'g'), '[；;]+', '', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"
)
_scalar(
    "smart_split",
    "traditional_chinese_medicine_material_enriched",
    "row_id",
    {
        "names": (
            lambda: F.array_join(X.smart_split(F.col("chemical_constituents")), "|"),
            f"array_to_string({_NAMES.format('chemical_constituents', _SPLIT_HELD.format('chemical_constituents'))}, '|')",
        )
    },
)
_scalar(
    "remove_producers",
    "documents",
    "doc_id",
    {"rest": (lambda: X.remove_producers(F.col("text")), _REST)},
)
_scalar("braced_list", "documents", "doc_id", {"items": (lambda: F.array_join(X.braced_items(F.col("text")), "; "), r"array_to_string(list_filter(list_transform(flatten(list_transform(regexp_extract_all(text, '\{([^}]+)\}', 1), lambda g: string_split_regex(g, '[;；、,，]'))), lambda x: trim(x)), lambda x: length(x) > 1), '; ')")})
_scalar("source_default", "enriched_pc_hardware_database", "row_id", {"origin": (lambda: F.coalesce(F.nullif(F.array_join(X.braced_items(F.col("data_source")), "; "), F.lit("")), F.lit(V.SOURCE_DEFAULT)), rf"coalesce(nullif(array_to_string(list_filter(list_transform(flatten(list_transform(regexp_extract_all(data_source, '\{{([^}}]+)\}}', 1), lambda g: string_split_regex(g, '[;；、,，]'))), lambda x: trim(x)), lambda x: length(x) > 1), '; '), ''), '{V.SOURCE_DEFAULT}')")})
_scalar(
    "coalesce_columns",
    "enriched_computer_hardware_knowledge",
    "row_id",
    {"resolved": (lambda: F.coalesce(*[F.when(~F.trim(c).isin(V.NO_VALUE), F.trim(c)) for c in ("product_name", "name", "名称")], F.lit("")), "coalesce(" + ", ".join(f"CASE WHEN trim({c}) NOT IN ({_in(V.NO_VALUE)}) THEN trim({c}) END" for c in ("product_name", "name", "名称")) + ", '')")},
)
_scalar(
    "validators",
    "sample_chemicals",
    "row_id",
    {
        "id_ok": (lambda: F.coalesce(F.col("CAS号").rlike("^[0-9]{2,7}-[0-9]{2}-[0-9]$"), F.lit(False)), "coalesce(regexp_full_match(CAS号, '[0-9]{2,7}-[0-9]{2}-[0-9]'), false)"),
        "formula_ok": (lambda: F.coalesce(F.col("备注").rlike("^(?:[A-Z][a-z]?[0-9]*)+$"), F.lit(False)), "coalesce(regexp_full_match(备注, '(?:[A-Z][a-z]?[0-9]*)+'), false)"),
        "name_ok": (lambda: F.coalesce(F.length("品名").between(2, 100) & ~F.col("品名").rlike("^[0-9]+$"), F.lit(False)), "coalesce(length(品名) BETWEEN 2 AND 100 AND NOT regexp_full_match(品名, '[0-9]+'), false)"),
        "number_ok": (lambda: F.coalesce(F.col("CAS号").try_cast("double").between(0, 1e9), F.lit(False)), "coalesce(try_cast(CAS号 AS DOUBLE) BETWEEN 0 AND 1e9, false)"),
        "email_ok": (lambda: F.coalesce(F.col("备注").rlike(r"^[\w.+-]+@[\w-]+\.[\w.]+$"), F.lit(False)), r"coalesce(regexp_full_match(备注, '[\w.+-]+@[\w-]+\.[\w.]+'), false)"),
        "url_ok": (lambda: F.coalesce(F.col("备注").rlike(r"^https?://[^ ]+$"), F.lit(False)), "coalesce(regexp_full_match(备注, 'https?://[^ ]+'), false)"),
    },
)

# Identifiers
_FORM = "[0-9]{2,7}-[0-9]{2}-[0-9]"
_SUM = "list_sum([CAST(d AS INTEGER) * k FOR d, k IN string_split(reverse((replace({0}, '-', ''))[1:-2]), '')])"


def _check(x: str) -> str:
    """SQL of the check digit."""
    formed = f"regexp_full_match({x}, '{_FORM}')"
    return f"coalesce(CASE WHEN {formed} THEN {_SUM.format(x)} % 10 = CAST(({x})[-1:] AS INTEGER) ELSE false END, false)"


_scalar("id_normalize", "sample_chemicals", "row_id", {"id": (lambda: I.normalize_id(F.col("CAS号")), "regexp_replace(CAS号, '[^0-9-]', '', 'g')")})
_scalar("id_checksum", "sample_chemicals", "row_id", {"ok": (lambda: I.checksum_ok(F.trim("CAS号")), _check("trim(CAS号)"))})
_scalar(
    "id_classify",
    "sample_chemicals",
    "row_id",
    {"class": (lambda: I.classify_id(F.col("CAS号")), f"CASE WHEN CAS号 IS NULL OR trim(CAS号) = '' THEN 'empty' WHEN regexp_full_match(trim(CAS号), '{_FORM}') THEN 'standard' WHEN regexp_full_match(trim(CAS号), '[0-9]{{6,}}') THEN 'serial' ELSE 'malformed' END")},
)
_B = "trim(regexp_replace(trim(CAS号), 'CAS:|CAS |cas:|cas ', '', 'g'))"
_H = rf"CASE WHEN regexp_full_match(regexp_replace({_B}, '[^0-9-]', '', 'g'), '[0-9]{{5,}}') THEN regexp_replace(regexp_replace({_B}, '[^0-9-]', '', 'g'), '^([0-9]+)([0-9]{{2}})([0-9])$', '\1-\2-\3') ELSE regexp_replace({_B}, '[^0-9-]', '', 'g') END"
_scalar(
    "id_fix",
    "sample_chemicals",
    "row_id",
    {
        "ok": (lambda: I.fix_id(F.col("CAS号"))["ok"], f"coalesce(CASE WHEN CAS号 IS NULL OR {_B} = '' THEN false WHEN regexp_full_match({_B}, '{_FORM}') THEN {_check(_B)} ELSE regexp_full_match({_H}, '{_FORM}') END, false)"),
        "fixed": (lambda: I.fix_id(F.col("CAS号"))["fixed"], f"CASE WHEN CAS号 IS NULL THEN '' WHEN regexp_full_match({_B}, '{_FORM}') OR NOT regexp_full_match({_H}, '{_FORM}') THEN {_B} ELSE {_H} END"),
    },
)
_scalar(
    "id_extract",
    "sample_chemicals_raw",
    "raw_id",
    {"ids": (lambda: F.array_join(I.extract_ids(F.col("raw_text")), ","), f"array_to_string(list_filter(regexp_extract_all(raw_text, '(?:^|[^0-9-])({_FORM})(?:$|[^0-9-])', 1), lambda x: {_check('x')}), ',')")},
)
QUERIES["invalid_id_count"] = lambda spark, sf_dir: table(spark, sf_dir, "sample_chemicals").agg(
    F.count_if(~F.coalesce(F.col("CAS号").rlike(r"^[0-9]+-[0-9]+-[0-9]+$"), F.lit(False))).alias("invalid"), F.count("*").alias("rows")
)
ORACLE["invalid_id_count"] = "SELECT count(*) FILTER (WHERE NOT coalesce(regexp_full_match(CAS号, '[0-9]+-[0-9]+-[0-9]+'), false)) AS invalid, count(*) AS rows FROM sample_chemicals"
_scalar("fingerprint", "documents", "doc_id", {"hash": (lambda: F.md5("text"), "md5(text)")})
_scalar("node_ids", "hazard_catalog", "序号", {"node": (lambda: I.content_id(F.col("品名"), F.col("CAS号")), "md5(concat_ws('|', 品名, CAS号))")})

# Measures
_N = r"-?[0-9]+(?:\.[0-9]+)?"
_D = "℃|°?[CKF]"
_POINT = rf"(?i)({_N})\s*({_D})"
_RANGE = rf"(?i)({_N})\s*(?:-|~|to|至)\s*({_N})\s*({_D})"
_CELSIUS = "round(CASE upper(regexp_replace({u}, '[°℃]', '', 'g')) WHEN 'F' THEN (CAST({v} AS DOUBLE) - 32) * 5 / 9 WHEN 'K' THEN CAST({v} AS DOUBLE) - 273.15 ELSE CAST({v} AS DOUBLE) END, 2)"


def _spans(keys: str, source: str) -> str:
    return f"""
WITH m AS (SELECT {keys}, text, unnest(range(1, 1 + greatest(1, len(regexp_extract_all(text, '{_RANGE}')), len(regexp_extract_all(text, '{_POINT}'))))) AS i FROM {source}),
s AS (SELECT {keys}, i, len(regexp_extract_all(text, '{_RANGE}')) AS n,
  regexp_extract_all(text, '{_RANGE}', 1)[i] AS a, regexp_extract_all(text, '{_RANGE}', 2)[i] AS b, regexp_extract_all(text, '{_RANGE}', 3)[i] AS u,
  regexp_extract_all(text, '{_POINT}', 1)[i] AS p, regexp_extract_all(text, '{_POINT}', 2)[i] AS q FROM m)"""


def _temperatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _texts(spark, sf_dir).select("origin", "id", F.posexplode(M.extract_temperatures(F.col("text"))).alias("i", "m"))
    return found.select("origin", "id", (F.col("i") + 1).alias("pos"), "m.kind", "m.low", "m.high")


QUERIES["extract_temp"] = _temperatures
ORACLE["extract_temp"] = f"""{_spans("origin, id", _TEXTS)}
SELECT origin, id, CAST(i AS INTEGER) AS pos, CASE WHEN n > 0 THEN 'range' ELSE 'point' END AS kind, CASE WHEN n > 0 THEN {_CELSIUS.format(v='a', u='u')} ELSE {_CELSIUS.format(v='p', u='q')} END AS low,
  CASE WHEN n > 0 THEN {_CELSIUS.format(v='b', u='u')} ELSE {_CELSIUS.format(v='p', u='q')} END AS high FROM s WHERE CASE WHEN n > 0 THEN a ELSE p END IS NOT NULL"""

def _converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of the tables states any number of temperatures: one row for each."""
    parts = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(_POINT), F.lit(g)).alias(n) for g, n in ((1, "v"), (2, "u"))])
    found = _texts(spark, sf_dir).select("origin", "id", F.posexplode(parts).alias("i", "m"))
    return found.select("origin", "id", (F.col("i") + 1).alias("pos"), F.round(M.to_celsius(F.col("m.v").cast("double"), F.col("m.u")), 2).alias("celsius"))


QUERIES["temp_convert"] = _converted
ORACLE["temp_convert"] = f"""WITH m AS (SELECT origin, id, text, unnest(range(1, 1 + len(regexp_extract_all(text, '{_POINT}')))) AS pos FROM {_TEXTS}),
  g AS (SELECT origin, id, CAST(pos AS INTEGER) AS pos, regexp_extract_all(text, '{_POINT}', 1)[pos] AS v, regexp_extract_all(text, '{_POINT}', 2)[pos] AS u FROM m) SELECT origin, id, pos, {_CELSIUS.format(v="v", u="u")} AS celsius FROM g"""


def _rows(name: str, pattern: str, spark_col: Callable[[], Column], fields: list[tuple[str, str]]) -> None:
    """A query with one row per match of a measure."""

    def run(df: DataFrame, keys: list[str]) -> DataFrame:
        found = df.select(*keys, F.posexplode(spark_col()).alias("i", "m"))
        return found.select(*keys, (F.col("i") + 1).alias("pos"), *[F.col(f"m.{f}").alias(f) for f, _ in fields])

    groups = ", ".join(f"regexp_extract_all(text, '{pattern}', {g})[pos] AS g{g}" for g in range(0, 6 if name == "extract_solub" else 4))

    def matches(keys: str, source: str) -> str:
        return f"""WITH m AS (SELECT {keys}, text, unnest(range(1, 1 + len(regexp_extract_all(text, '{pattern}')))) AS pos FROM {source}),
      g AS (SELECT {keys}, CAST(pos AS INTEGER) AS pos, {groups} FROM m) SELECT {keys}, pos, {", ".join(f"{sql} AS {f}" for f, sql in fields)} FROM g"""

    _over_texts(name, run, matches)


# The patterns and factors of the SQL are written out, independent of those of the operators.
_AT = r"(?:\s*(?:at|@|在)\s*(-?[0-9]+(?:\.[0-9]+)?\s*(?:℃|°?[CKF])))?"
_KPA = "round(CAST(g1 AS DOUBLE) * CASE lower(g2) WHEN 'kpa' THEN 1.0::DOUBLE WHEN 'pa' THEN 0.001::DOUBLE WHEN 'hpa' THEN 0.1::DOUBLE WHEN 'mpa' THEN 1000.0::DOUBLE WHEN 'bar' THEN 100.0::DOUBLE WHEN 'atm' THEN 101.325::DOUBLE WHEN 'mmhg' THEN 0.133322::DOUBLE END, 4)"
_DENSITY = "round(CAST(g1 AS DOUBLE) * CASE lower(g2) WHEN 'kg/m³' THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END, 4)"
_NUM = r"([0-9]+(?:\.[0-9]+)?)"
_rows("extract_pressure", rf"(?i){_NUM}\s*(kPa|Pa|hPa|MPa|bar|atm|mmHg){_AT}", lambda: M.extract_pressures(F.col("text")), [("kpa", _KPA), ("condition", "coalesce(trim(g3), '')"), ("original", "trim(g0)")])
_rows("extract_density", rf"(?i){_NUM}\s*(g/cm³|g/ml|kg/m³){_AT}", lambda: M.extract_densities(F.col("text")), [("density", _DENSITY), ("condition", "coalesce(trim(g3), '')"), ("original", "trim(g0)")])
_rows("extract_solub", rf"(?i){_NUM}\s*(g|mg)\s*/\s*{_NUM}\s*(mL|L|g|mg)\s*(?:\(([^()]+)\))?", lambda: M.extract_solubilities(F.col("text")), [("mass", "CAST(g1 AS DOUBLE)"), ("mass_unit", "g2"), ("volume", "CAST(g3 AS DOUBLE)"), ("volume_unit", "g4"), ("condition", "coalesce(trim(g5), '')")])
_shown("extract_limits", {n.lower(): (lambda n=n: M.explosion_limits(F.col("text"))[n == "UEL"], rf"try_cast(regexp_extract(text, '(?i){n}[: ]*([0-9]+(?:\.[0-9]+)?)', 1) AS DOUBLE)") for n in ("LEL", "UEL")})
_scalar("extract_numbers", "enriched_computer_hardware_knowledge", "row_id", {"total": (lambda: F.round(F.aggregate(M.extract_numbers(F.col("dimensions")), F.lit(0.0), lambda a, x: a + x), 4), r"round(coalesce(list_sum(list_transform(regexp_extract_all(dimensions, '[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?'), lambda x: CAST(x AS DOUBLE))), CASE WHEN dimensions IS NOT NULL THEN 0.0 END), 4)")})
_UNITS_SQL = " || ".join(f"regexp_extract_all(text, '{p}')" for p in ("°C|℃|K|°F", "Pa|kPa|MPa|bar|atm|mmHg", "g/mol|Da|u", "g/cm³|kg/m³|g/mL", "mol/L|M|ppm|ppb|%"))
_shown("extract_units", {"units": (lambda: F.array_join(M.extract_units(F.col("text")), ","), f"array_to_string(list_sort(list_distinct({_UNITS_SQL})), ',')")})

# Categories


def _case(rules: list, default: str, column: str) -> str:
    from re import escape

    whens = " ".join(f"WHEN regexp_matches({column}, '{'|'.join(escape(w) for w in words)}') THEN '{name}'" for name, words in rules)
    return f"CASE {whens} ELSE {default} END"


def _parts_query(name: str, rules: list, default: str, separators: str) -> None:
    def run(df: DataFrame, keys: list[str]) -> DataFrame:
        found = df.select(*keys, F.posexplode(C.categorize(F.col("text"), rules, default, separators)).alias("i", "p"))
        return found.select(*keys, F.col("p.class").alias("class"), F.col("p.part").alias("part"))

    def parts(keys: str, source: str) -> str:
        return f"WITH p AS (SELECT {keys}, trim(unnest(string_split_regex(text, '{separators}'))) AS part FROM {source}) SELECT {keys}, {_case(rules, chr(39) + default + chr(39), 'part')} AS class, part FROM p WHERE part <> ''"

    _over_texts(name, run, parts)


_parts_query("keyword_categorize", V.HAZARD_CLASSES, "其他", "[;；。]")
_parts_query("storage_classes", V.STORAGE_CLASSES, "其他要求", "[,，;；]")
_shown("relation_type", {"type": (lambda: C.first_class(F.lower("text"), V.RELATION_TYPES, "工艺"), _case(V.RELATION_TYPES, "'工艺'", "lower(text)"))})
_shown("error_class", {"class": (lambda: C.first_class(F.lower("text"), V.ERROR_CLASSES, "unknown"), _case(V.ERROR_CLASSES, "'unknown'", "lower(text)"))})
# The tables number no attempts: the key counts them, from 0 to 9 and again.
QUERIES["retry_delay"] = lambda spark, sf_dir: _texts(spark, sf_dir).select("origin", "id", C.retry_delay(F.col("text"), F.pmod("id", F.lit(10))).alias("seconds"))
ORACLE["retry_delay"] = "SELECT origin, id, CASE WHEN contains(lower(text), 'timeout') THEN least(10, 2 + id % 10 * 2) WHEN contains(lower(text), 'lock') THEN least(8, 1 + id % 10) WHEN contains(lower(text), 'connection') THEN least(15, 3 + id % 10 * 3) WHEN id % 10 > 7 THEN -1 ELSE least(5, 1 + id % 10) END AS seconds FROM " + _TEXTS


def _solubility(df: DataFrame, keys: list[str]) -> DataFrame:
    found = df.select(*keys, F.posexplode(C.solubility_grades(F.col("text"))).alias("i", "s"))
    return found.groupBy(*keys, F.col("s.solvent").alias("solvent")).agg(F.min_by("s.grade", "i").alias("grade"))


_GRADES = [(g, [g]) for g in ("溶于", "不溶于", "微溶于", "易溶于", "难溶于", "混溶", "任意比例混溶")]


def _grades(keys: str, source: str) -> str:
    return f"""
WITH p AS (SELECT {keys}, unnest(range(1, 1 + len(string_split_regex(text, '[,，;；。]')))) AS i, text FROM {source}),
s AS (SELECT {keys}, i, trim(string_split_regex(text, '[,，;；。]')[i]) AS part FROM p),
g AS (SELECT {keys}, i, {_case([(s, [s]) for s in V.SOLVENTS], "NULL", "part")} AS solvent, {_case(_GRADES, "'未知'", "part")} AS grade FROM s WHERE part <> '' AND NOT (regexp_matches(part, '[0-9]') AND regexp_matches(part, 'g/mL|g/L')))
SELECT {keys}, solvent, arg_min(grade, i) AS grade FROM g WHERE solvent IS NOT NULL GROUP BY {keys}, solvent"""


_over_texts("solubility_map", _solubility, _grades)

# JSON text of a model's answer, made from the events: fenced, prefixed, with trailing commas and bare keys.
def _fenced() -> Column:
    return F.concat(F.lit("Answer:\n```json\n"), F.col("props"), F.lit("\n```\nDone."))


def _sloppy() -> Column:
    return F.concat(F.lit("Result: "), F.regexp_replace("props", r'"(k)"', "$1"), F.lit(" // note"))


_FENCED_SQL = "'Answer:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' || chr(10) || 'Done.'"
_SLOPPY_SQL = """'Result: ' || regexp_replace(props, '"(k)"', '\\1', 'g') || ' // note'"""
_scalar("json_direct", "events", "event_id", {"k": (lambda: F.get_json_object("props", "$.k").cast("int"), "CAST(json_extract_string(props, '$.k') AS INTEGER)")})
_scalar("json_fence", "events", "event_id", {"body": (lambda: J.fenced_block(_fenced()), rf"trim(regexp_extract({_FENCED_SQL}, '(?is)```(?:json)?[ \t\r\n]*(.*?)[ \t\r\n]*```', 1))")})
_scalar("json_outer", "events", "event_id", {"body": (lambda: J.outer_object(_sloppy()), rf"regexp_extract({_SLOPPY_SQL}, '(?s)\{{.*\}}')")})
_scalar("json_regex", "events", "event_id", {"longest": (lambda: J.longest_object(_fenced()), rf"list_sort([[length(x), x] FOR x IN regexp_extract_all({_FENCED_SQL}, '\{{[^{{}}]*\}}')], 'DESC')[1][2]")})
ORACLE["json_regex"] = rf"SELECT event_id, regexp_extract({_FENCED_SQL}, '\{{[^{{}}]*\}}') AS longest FROM events"
_scalar("json_kv", "events", "event_id", {"k": (lambda: J.key_values(F.regexp_replace("props", '[{}"]', ""))["k"], "trim(regexp_extract(regexp_replace(props, '[{}\"]', '', 'g'), 'k[ ]*[:：][ ]*([^,\n]+)', 1))")})
_scalar("json_fix", "events", "event_id", {"k": (lambda: F.get_json_object(J.repair(_sloppy()), "$.k"), "json_extract_string(props, '$.k')")})
_scalar("json_key_extract", "events", "event_id", {"k": (lambda: J.value_of_key(_sloppy(), "k"), rf"coalesce(nullif(regexp_extract({_SLOPPY_SQL}, '\bk\b[ ]*[:：][ ]*([0-9.+-]+)', 1), ''))")})
_scalar("json_prose", "events", "event_id", {"value": (lambda: J.prose_value(F.concat(F.lit("事件类型为"), "event_type", F.lit("，其余略。")), "事件类型"), "event_type")})


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in five forms, by the number of the event: plain, fenced, with bare keys, as lines, as a list of attributes."""
    listed = F.concat(F.lit('{"attributes":[{"name":"k","value":"'), F.get_json_object("props", "$.k"), F.lit('"}]}'))
    lines = F.concat(F.lit("k: "), F.get_json_object("props", "$.k"), F.lit("\nnote: none"))
    forms = F.array(F.col("props"), _fenced(), _sloppy(), lines, listed)
    answers = table(spark, sf_dir, "events").select("event_id", F.get(forms, F.pmod("event_id", F.lit(5)).cast("int")).alias("answer"))
    return J.parse_answers(answers, "answer").select("event_id", F.col("parsed")["k"].alias("k"))


QUERIES["json_parse"] = _parsed
ORACLE["json_parse"] = "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"
_scalar("json_id", "sample_chemicals", "row_id", {"id": (lambda: J.id_of_answer(F.concat(F.lit("CAS号是 "), F.coalesce("CAS号", F.lit("")), F.lit(" 。"))), f"list_filter(regexp_extract_all('CAS号是 ' || coalesce(CAS号, '') || ' 。', '(?:^|[^0-9-])({_FORM})(?:$|[^0-9-])', 1), lambda x: {_check('x')})[1]")})


def _flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"attributes":[{"name":"type","value":"'), "event_type", F.lit('"},{"name":"note","value":"无"}]}'))
    flat = J.flatten_attributes(text, V.INVALID_ANSWERS)
    return table(spark, sf_dir, "events").select("event_id", F.explode(flat).alias("name", "value"))


QUERIES["json_attr_flatten"] = _flatten
ORACLE["json_attr_flatten"] = "SELECT event_id, 'type' AS name, event_type AS value FROM events"


def _wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrapped = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"data":['), "props", F.lit(',{"k":-1}]}')).alias("doc"))
    return wrapped.select("event_id", F.explode(J.records_of(F.col("doc"), "k int")).alias("r")).select("event_id", F.col("r.k").alias("k"))


QUERIES["json_wrapper_explode"] = _wrapper
ORACLE["json_wrapper_explode"] = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events UNION ALL SELECT event_id, -1 AS k FROM events"
_fields8 = ["名称", "name", "manufacturer", "category", "power_consumption", "dimensions", "weight", "connectivity", "warranty_period", "cooling_solution"]
_scalar(
    "quality_gate",
    "enriched_computer_hardware_knowledge",
    "row_id",
    {"status": (lambda: F.when(sum((X.is_valid_field(F.col(c), V.INVALID_FIELDS).cast("int") for c in _fields8), F.lit(0)) >= 8, "成功").otherwise("失败: 有效字段不足"), "CASE WHEN " + " + ".join(f"CAST(coalesce(upper(trim({c})) NOT IN ({_in(V.INVALID_FIELDS)}) AND NOT regexp_full_match(trim({c}), '[0-9]'), false) AS INTEGER)" for c in _fields8) + " >= 8 THEN '成功' ELSE '失败: 有效字段不足' END")},
)


def _spaces_only(sql: str) -> str:
    """DuckDB trims blanks of all scripts by default; the expressions here trim spaces."""
    out, i = [], 0
    while (at := sql.find("trim(", i)) >= 0:
        depth, end = 1, at + 5
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0) if sql[end] != "'" else 0
            if sql[end] == "'":
                end = sql.index("'", end + 1)
            end += 1
        out.append(sql[i:at] + "trim(" + _spaces_only(sql[at + 5 : end - 1]) + ", ' ')")
        i = end
    return "".join(out) + sql[i:]


ORACLE.update({name: _spaces_only(sql) for name, sql in ORACLE.items()})
ORACLE_TEXT.update(
    {
        "remove_producers": _spaces_only(_REST),
        "smart_split": _spaces_only(_NAMES.format("x", _SPLIT_HELD.format("x"))),
        "name_plausible": _PLAUSIBLE,
    }
)
