"""Search by equality, variants, n-grams and vectors.

Queries are a table of their own; candidates come from equi-joins on index terms, never from all
pairs. Common grams are what makes such joins grow, so partial sums are combined per pair before
anything is ranked, and ranking keeps k rows per query on the map side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.similarity import edit_ratio, grams


def variant_index(entries: DataFrame, name: str, alias: str, ident: str, order: str) -> DataFrame:
    """``variant, name, kind``: the name, its aliases and its id in lower case; the last entry of a variant counts."""
    o = F.col(order).alias("ord")
    own = entries.select(F.lower(F.trim(name)).alias("variant"), F.trim(name).alias("name"), F.lit("exact").alias("kind"), o)
    packed = entries.select(F.explode(F.split(alias, "[;；]")).alias("a"), F.trim(name).alias("name"), o)
    other = packed.select(F.lower(F.trim("a")).alias("variant"), "name", F.lit("variant").alias("kind"), "ord")
    ids = entries.select(F.lower(F.trim(ident)).alias("variant"), F.trim(name).alias("name"), F.lit("id").alias("kind"), o)
    every = own.union(other).union(ids).where("variant is not null and variant <> ''")
    return every.groupBy("variant", "kind").agg(F.max_by("name", "ord").alias("name"))


def search_exact(queries: DataFrame, index: DataFrame) -> DataFrame:
    """``query, name, score``: 1.0 for the name, 0.95 for an alias, 0.9 for the id; the best per name."""
    score = F.when(F.col("kind") == "exact", 1.0).when(F.col("kind") == "variant", 0.95).otherwise(0.9)
    hits = queries.withColumn("variant", F.lower(F.trim("query"))).join(index, "variant")
    return hits.groupBy("query", "name").agg(F.max(score).alias("score"))


def top_k(scored: DataFrame, k: int, query: str = "query", name: str = "name", score: str = "score") -> DataFrame:
    """The k best per query, ties by name. Partial tops are kept per partition of pairs."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy(query).orderBy(F.desc(score), name))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def gram_weights(names: DataFrame, name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Postings ``gram, name, w`` with smoothed TF-IDF of unit length, and the ``gram, idf`` table."""
    counted = names.withColumnRenamed(name, "name").select("name", F.explode(grams(F.col("name"))).alias("gram")).groupBy("name", "gram").agg(F.count("*").alias("tf"))
    n = names.count()
    idf = counted.groupBy("gram").agg(F.count("*").alias("df")).select("gram", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = counted.join(idf, "gram").select("name", "gram", (F.col("tf") * F.col("idf")).alias("w"))
    norm = raw.groupBy("name").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "name").select("gram", "name", (F.col("w") / F.col("norm")).alias("w")), idf


def tfidf_search(queries: DataFrame, names: DataFrame, least: float = 0.1, k: int = 5) -> DataFrame:
    """``query, name, score, rank``: cosine of character 1 to 3-grams, to six digits, so that ties don't hang on the order of sums."""
    postings, idf = gram_weights(names)
    own = queries.select("query", F.explode(grams(F.col("query"))).alias("gram")).groupBy("query", "gram").agg(F.count("*").alias("tf"))
    weighted = own.join(idf, "gram").select("query", "gram", (F.col("tf") * F.col("idf")).alias("q"))
    norm = weighted.groupBy("query").agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
    pairs = weighted.join(postings, "gram").groupBy("query", "name").agg(F.sum(F.col("q") * F.col("w")).alias("dot"))
    scored = pairs.join(norm, "query").select("query", "name", F.round(F.col("dot") / F.col("qn"), 6).alias("score")).where(F.col("score") >= least)
    return top_k(scored, k)


def near_pairs(left: DataFrame, right: DataFrame, least: float = 0.75, score: Column | None = None) -> DataFrame:
    """Pairs ``left_name, right_name, score`` with an edit ratio of at least ``least``.

    Blocking loses no pair: for a shorter name of length n and at most d edits, one of d + 1 pieces of it stays
    whole, at a place shifted by at most d, in a name of at most n + d characters. So candidates share a piece, its
    place and the length of the longer name, and short pieces don't bring together all names that hold them.
    ``least`` has to be above 0.5, else a name may have more edits than characters.
    """
    if least <= 0.5:
        raise ValueError("near pairs are found from a ratio above 0.5")
    a = left.select(F.col("name").alias("left_name")).where(F.length("name") >= 1)
    b = right.select(F.col("name").alias("right_name")).where(F.length("name") >= 1)
    # With ratio t, d <= (1 - t) * longer and longer <= shorter / t, so d + 1 pieces of the shorter suffice.
    n = F.length("left_name")
    most = F.floor(n * (1 - least) / least + 1e-9).cast("int")
    count = most + 1
    size = F.greatest(F.floor(n / count), F.lit(1)).cast("int")
    starts = F.filter(F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * size + 1), lambda at: at <= n)
    last = F.element_at(starts, -1)
    pieces = F.transform(starts, lambda at: F.struct(at.alias("at"), F.substring(F.col("left_name"), at, F.when(at == last, n).otherwise(size)).alias("piece")))
    cut = a.select("left_name", most.alias("most"), F.explode(pieces).alias("p")).select("left_name", "most", "p.at", "p.piece")
    # At most as many sizes as a name has characters.
    sizes = sorted(r["size"] for r in cut.select(F.length("piece").alias("size")).distinct().collect())
    placed = cut.select("left_name", "most", "piece", F.explode(F.sequence(F.greatest(F.lit(1), F.col("at") - F.col("most")), F.col("at") + F.col("most"))).alias("at"))
    wanted = placed.select("left_name", "piece", "at", F.explode(F.sequence(F.length("left_name"), F.length("left_name") + F.col("most"))).alias("length"))

    def cuts(size: int) -> Column:
        every = F.when(F.length("right_name") >= size, F.sequence(F.lit(1), F.length("right_name") - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(every, lambda at: F.struct(at.alias("at"), F.substring(F.col("right_name"), at, F.lit(size)).alias("piece")))

    held = F.flatten(F.array(*[cuts(s) for s in sizes])) if sizes else F.array().cast("array<struct<at:int,piece:string>>")
    spread = b.select("right_name", F.length("right_name").alias("length"), F.explode(held).alias("p")).select("right_name", "length", "p.at", "p.piece")
    found = wanted.join(spread, ["piece", "at", "length"]).select("left_name", "right_name").distinct()
    value = score if score is not None else edit_ratio(F.col("left_name"), F.col("right_name"))
    return found.withColumn("score", value).where(F.col("score") >= least)


def near_pairs_both(names: DataFrame, least: float) -> DataFrame:
    """Each unordered pair of unlike names once."""
    found = near_pairs(names, names, least).where("left_name <> right_name")
    a, b = F.least("left_name", "right_name"), F.greatest("left_name", "right_name")
    return found.select(a.alias("a"), b.alias("b"), "score").distinct()


# Queries of so many numbers are sent to all tasks (64 MB as doubles).
MAX_BROADCAST_NUMBERS = 8_000_000


def _best_of(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and cosines of the k best vectors per query, ties by id; without a score: minus infinity."""
    with np.errstate(divide="ignore", invalid="ignore"):
        s = (queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).T
    s = np.where(np.isfinite(s), s, -np.inf)
    top = np.stack([np.lexsort((ids, -line))[:k] for line in s])
    return top, np.take_along_axis(s, top, axis=1)


def _against_all(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    got = queries.toPandas()
    shared = rows.sparkSession.sparkContext.broadcast((got.id.to_numpy(np.int64), [np.asarray(v, np.float64) for v in got.v]))

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, vectors = shared.value
        a = np.stack(vectors) if len(vectors) else None
        for batch in batches:
            if a is None or not len(batch):
                continue
            ids = batch["id"].to_numpy(np.int64)
            top, score = _best_of(a, np.stack([np.asarray(v, np.float64) for v in batch.v]), ids, k)
            out = pd.DataFrame({"query": np.repeat(own, top.shape[1]), key: ids[top].ravel(), "score": score.ravel()})
            yield out[np.isfinite(out.score)]

    slim = rows.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    return slim.mapInPandas(multiply, f"query long, `{key}` long, score double")


def vector_top_k(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 5, block: int = 1024) -> DataFrame:
    """``query, key, score, rank``: exact cosine of every query against all rows.

    Queries of at most ``MAX_BROADCAST_NUMBERS`` numbers, which is counted, go to the rows: every batch of rows is
    multiplied with them where it stands, and k rows per query and batch are shuffled. Beyond it both sides are packed
    into blocks by a hash of the key, and a task multiplies one block of rows with one of queries, so nothing larger
    than a block is in memory. Vectors without length have no score.
    """
    slim_queries = queries.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    numbers = slim_queries.agg(F.coalesce(F.sum(F.size("v")), F.lit(0))).first()[0]
    if numbers <= MAX_BROADCAST_NUMBERS:
        return top_k(_against_all(slim_queries, rows, key, vector, k), k, "query", key, "score")

    def packed(df: DataFrame, side: str) -> tuple[DataFrame, int]:
        slim = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
        n = max(1, -(-slim.count() // block))
        placed = slim.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)))
        return placed.groupBy("block").agg(F.collect_list("id").alias(f"{side}_ids"), F.collect_list("v").alias(f"{side}_vs")).withColumnRenamed("block", f"{side}_block"), n

    q, q_count = packed(queries, "q")
    r, _ = packed(rows, "r")
    spread = r.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_count - 1).cast("long"))))

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids = np.asarray(row.r_ids)
                a, b = (np.stack([np.asarray(v, np.float64) for v in vs]) for vs in (row.q_vs, row.r_vs))
                top, score = _best_of(a, b, ids, k)
                query = np.repeat(np.asarray(row.q_ids), top.shape[1])
                out = pd.DataFrame({"query": query, key: ids[top].ravel(), "score": score.ravel()})
                yield out[np.isfinite(out.score)]

    pairs = spread.join(q, "q_block").select("q_ids", "q_vs", "r_ids", "r_vs").mapInPandas(multiply, f"query long, `{key}` long, score double")
    return top_k(pairs, k, "query", key, "score")
