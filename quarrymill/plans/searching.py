"""Queries of similarity and search. Queries are the rows whose id is divisible by 50, against all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill.functions import similarity as S
from quarrymill.operators import search as R
from quarrymill.operators.catalogue import containing_pairs, keep_first
from quarrymill.operators.graph import greedy_groups
from quarrymill.session import table


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "hazard_catalog").select("序号", F.trim(F.regexp_replace("品名", r"\[[^\]]*\]", "")).alias("品名"), "别名", "CAS号")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _catalogue(spark, sf_dir).select(F.col("品名").alias("name")).where("name <> ''").distinct()


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sample_chemicals").where(F.col("row_id") % 50 == 0)
    return rows.select(F.trim("品名").alias("query")).where("query <> ''").distinct()


def _sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that share a character, as every pair with a score above 0 does: nothing is lost."""
    one = lambda df, c: df.select(c, F.explode(S.characters(F.col(c))).alias("g"))
    return one(_queries(spark, sf_dir), "query").join(one(_names(spark, sf_dir), "name"), "g").select("query", "name").distinct()


def jaccard_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sharing(spark, sf_dir).select("query", "name", F.round(S.jaccard(F.col("query"), F.col("name")), 4).alias("score"))


def char_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sharing(spark, sf_dir).select("query", "name", F.round(S.overlap(F.col("query"), F.col("name")), 4).alias("score"))


def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = char_overlap(spark, sf_dir).where("score >= 0.6")
    return scored.groupBy("query").agg(F.max_by("name", F.struct(F.col("score"), F.length("name"), "name")).alias("name"), F.max("score").alias("score"))


def tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _sharing(spark, sf_dir).withColumn("score", F.round(S.tiered(F.col("query"), F.col("name")), 4)).where("score > 0.3")
    return R.top_k(scored, 3).select("query", "name", "score", "rank")


def variant_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.variant_index(_catalogue(spark, sf_dir), "品名", "别名", "CAS号", "序号")


def search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sample_chemicals")
    ids = rows.where(F.col("row_id") % 50 == 0).select(F.trim("CAS号").alias("query")).where("query <> ''").distinct()
    return R.search_exact(_queries(spark, sf_dir).union(ids), variant_index(spark, sf_dir))


def fuzzy_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = jaccard_chars(spark, sf_dir).where("score >= 0.6")
    return R.top_k(scored, 5).select("query", "name", "score", "rank")


def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best score per name over all ways of search, the best five per query."""
    fuzzy = fuzzy_search(spark, sf_dir).select("query", "name", (F.col("score") * 0.8).alias("score"))
    every = R.search_exact(_queries(spark, sf_dir), variant_index(spark, sf_dir)).union(fuzzy)
    best = every.groupBy("query", "name").agg(F.round(F.max("score"), 4).alias("score"))
    return R.top_k(best, 5).select("query", "name", "score", "rank")


def _every_maker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct freely typed makers."""
    rows = table(spark, sf_dir, "enriched_pc_hardware_database").select(F.lower(F.trim("manufacturer")).alias("name"))
    return rows.where("name <> ''").distinct()


def _near(names: DataFrame) -> DataFrame:
    return R.near_pairs_both(names, 0.75).select("a", "b", F.round("score", 4).alias("score"))


def _shortest(names: DataFrame) -> DataFrame:
    """For each name the shortest of its near names, itself included."""
    pairs = _near(names)
    both = pairs.select(F.col("a").alias("name"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    every = both.union(names.select("name", F.col("name")))
    return every.groupBy("name").agg(F.min_by("other", F.struct(F.length("other"), "other")).alias("canonical"))


def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near pairs of all makers. No SQL, since DuckDB has no edit distance of characters."""
    return _near(_every_maker(spark, sf_dir))


def canonical_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shortest(_every_maker(spark, sf_dir))


def name_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Makers in groups of near names, founded in their order; each group has its shortest name as canonical."""
    names = _every_maker(spark, sf_dir).select("name", F.col("name").alias("ord"))
    groups = greedy_groups(names, R.near_pairs_both(names.select("name"), 0.85))
    shortest = groups.groupBy("leader").agg(F.min_by("name", F.struct(F.length("name"), "name")).alias("canonical"))
    return groups.join(shortest, "leader").select("name", "leader", "canonical")


def fuzzy_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that are a known name, or contain or are contained in one of nearly their length."""
    queries, names = _queries(spark, sf_dir).select(F.col("query").alias("name")), _names(spark, sf_dir)
    near = containing_pairs(queries, names).where(F.abs(F.length("left_name") - F.length("right_name")) <= 2)
    return near.select(F.col("left_name").alias("name")).union(queries.join(names, "name", "left_semi")).distinct()


def tfidf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.tfidf_search(_queries(spark, sf_dir), _names(spark, sf_dir)).select("query", "name", "score", "rank")


def tfidf_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    postings, idf = R.gram_weights(_names(spark, sf_dir))
    return postings.agg(F.count_distinct("gram").alias("features"), F.count_distinct("name").alias("names"), F.count("*").alias("entries"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    found = R.vector_top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors, "vec_id", "embedding", 5)
    return found.select("query", "vec_id", F.round("score", 4).alias("score"))


def first_of_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep_first(_catalogue(spark, sf_dir).select("序号", "品名"), ["品名"], "序号")


_KEYS = [
    "jaccard_chars", "char_overlap", "best_match", "tiered_search", "variant_index", "search_exact", "fuzzy_search", "search_topk", "fuzzy_pairs",
    "canonical_shortest", "name_groups", "fuzzy_semi", "tfidf_search", "tfidf_stats", "vector_topk",
]
QUERIES = {name: globals()[name] for name in _KEYS}

_BASE = r"""cat AS (SELECT "序号" AS o, trim(regexp_replace("品名", '\[[^\]]*\]', '', 'g'), ' ') AS name, "别名" AS alias, "CAS号" AS cas FROM hazard_catalog),
names AS (SELECT DISTINCT name FROM cat WHERE name <> ''),
q AS (SELECT DISTINCT trim("品名", ' ') AS query FROM sample_chemicals WHERE row_id % 50 = 0 AND trim("品名", ' ') <> ''),
pairs AS (SELECT query, name FROM q, names),
chars AS (SELECT query, name, list_distinct(string_split(query, '')) AS x, list_distinct(string_split(name, '')) AS y FROM pairs),
base AS (SELECT query, name, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE AS j, contains(query, name) OR contains(name, query) AS c FROM chars),
jac AS (SELECT query, name, round(least(1.0::DOUBLE, j + CASE WHEN c THEN 0.3::DOUBLE ELSE 0::DOUBLE END), 4) AS score FROM base),
ovl AS (SELECT query, name, round(list_sum([least(length(query) - length(replace(query, ch, '')), length(name) - length(replace(name, ch, ''))) FOR ch IN list_intersect(x, y)])::DOUBLE / greatest(length(query), length(name)), 4) AS score FROM chars),
tier AS (SELECT query, name, round(CASE WHEN query = name THEN 1.0::DOUBLE WHEN contains(name, query) THEN 0.8::DOUBLE WHEN contains(query, name) THEN 0.7::DOUBLE ELSE j END, 4) AS score FROM base),
va AS (SELECT lower(name) AS variant, name, 'exact' AS kind, o FROM cat UNION ALL SELECT lower(trim(unnest(string_split_regex(alias, '[;；]')), ' ')), name, 'variant', o FROM cat UNION ALL SELECT lower(trim(cas, ' ')), name, 'id', o FROM cat),
vi AS (SELECT variant, kind, arg_max(name, o) AS name FROM va WHERE variant IS NOT NULL AND variant <> '' GROUP BY variant, kind),
fz AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, name) AS rank FROM jac WHERE score >= 0.6) WHERE rank <= 5)"""
_EXACT = "SELECT query, vi.name, max(CASE kind WHEN 'exact' THEN 1.0 WHEN 'variant' THEN 0.95 ELSE 0.9 END)::DOUBLE AS score FROM {q} JOIN vi ON variant = lower(trim(query, ' ')) GROUP BY query, vi.name"
_TF = r"""ngrams AS (SELECT name, lower(name)[i:i+n-1] AS g FROM (SELECT name, n, unnest(range(1, length(name) - n + 2)) AS i FROM names, (VALUES (1), (2), (3)) t(n))),
ntf AS (SELECT name, g, count(*) AS tf FROM ngrams GROUP BY name, g), idf AS (SELECT g, ln((1 + (SELECT count(*) FROM names)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM ntf GROUP BY g),
nw AS (SELECT name, g, tf * idf AS w FROM ntf JOIN idf USING (g)), nn AS (SELECT name, sqrt(sum(w * w)) AS n FROM nw GROUP BY name),
qgrams AS (SELECT query, lower(query)[i:i+n-1] AS g FROM (SELECT query, n, unnest(range(1, length(query) - n + 2)) AS i FROM q, (VALUES (1), (2), (3)) t(n))),
qw AS (SELECT query, g, count(*) * any_value(idf) AS w FROM qgrams JOIN idf USING (g) GROUP BY query, g), qn AS (SELECT query, sqrt(sum(w * w)) AS n FROM qw GROUP BY query)"""
ORACLE = {
    "jaccard_chars": f"WITH {_BASE} SELECT * FROM jac WHERE score > 0",
    "char_overlap": f"WITH {_BASE} SELECT * FROM ovl WHERE score > 0",
    "best_match": f"WITH {_BASE} SELECT query, name, score FROM ovl WHERE score >= 0.6 QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, length(name) DESC, name DESC) = 1",
    "tiered_search": f"WITH {_BASE} SELECT * FROM (SELECT query, name, score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, name) AS INTEGER) AS rank FROM tier WHERE score > 0.3) WHERE rank <= 3",
    "variant_index": f"WITH {_BASE} SELECT * FROM vi",
    "search_exact": f"WITH {_BASE}, qq AS (SELECT query FROM q UNION ALL SELECT DISTINCT trim(\"CAS号\", ' ') FROM sample_chemicals WHERE row_id % 50 = 0 AND trim(\"CAS号\", ' ') <> '') {_EXACT.format(q='qq')}",
    "fuzzy_search": f"WITH {_BASE} SELECT query, name, score, CAST(rank AS INTEGER) AS rank FROM fz",
    "search_topk": f"WITH {_BASE}, e AS ({_EXACT.format(q='q')} UNION ALL SELECT query, name, score * 0.8::DOUBLE FROM fz), b AS (SELECT query, name, round(max(score), 4) AS score FROM e GROUP BY query, name) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, name) AS INTEGER) AS rank FROM b) WHERE rank <= 5",
    "fuzzy_semi": f"WITH {_BASE} SELECT DISTINCT query AS name FROM q JOIN names ON (contains(query, name) OR contains(name, query)) AND abs(length(query) - length(name)) <= 2 AND length(name) >= 2 WHERE length(query) >= 2 UNION SELECT query FROM q SEMI JOIN names ON query = name",
    "tfidf_search": f"WITH {_BASE}, {_TF}, s AS (SELECT qw.query, nw.name, round(sum(qw.w * nw.w / nn.n) / any_value(qn.n), 6) AS score FROM qw JOIN nw USING (g) JOIN nn ON nn.name = nw.name JOIN qn ON qn.query = qw.query GROUP BY qw.query, nw.name) SELECT query, name, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, name) AS rank FROM s WHERE score >= 0.1) WHERE rank <= 5",
    "tfidf_stats": f"WITH {_BASE}, {_TF} SELECT count(DISTINCT g) AS features, count(DISTINCT name) AS names, count(*) AS entries FROM ntf",
    "vector_topk": "SELECT query, vec_id, round(s, 4) AS score FROM (SELECT a.vec_id AS query, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, vec_id) <= 5",
}
