"""Relations from text and the property graph: node and edge tables, never a driver-side structure."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import braced_items, clean_node_name, cut_affixes, name_plausible, remove_producers, smart_split
from quarrymill.operators.catalogue import containing_pairs, keep_first
from quarrymill.session import cut_lineage
from quarrymill import vocab as V
from quarrymill.vocab import COMES_FROM, PRODUCES, RAW_MATERIAL, TAKES_PART

PROCESS_SUFFIX = "_生产工艺"
# A dictionary is sent to the executors as automata of so many characters each (some 100 MB at most).
MAX_BROADCAST_CHARACTERS = 2_000_000


def scan_names(texts: DataFrame, key: str, text: str, names: DataFrame, least: int = 2, limit: int | None = 5) -> DataFrame:
    """``key, name, rank``: known names in a text, not within longer words, the longest ``limit`` of them (all with None).

    ``names``: distinct ``name`` of any length. Texts are read by an automaton in a narrow pass; a dictionary of more
    than ``MAX_BROADCAST_CHARACTERS`` is cut by hash into parts of that size, with a pass over the texts for each.
    """
    known = names.where(F.length("name") >= least).select("name").distinct()
    slim = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("text is not null")
    kind = dict(slim.dtypes)["key"]
    size = known.agg(F.coalesce(F.sum(F.length("name") + 8), F.lit(0))).first()[0]
    parts = max(1, -(-size // MAX_BROADCAST_CHARACTERS))
    hits = None
    for part in range(parts):
        own = known if parts == 1 else known.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part)
        words = texts.sparkSession.sparkContext.broadcast([r["name"] for r in own.collect()])
        found = slim.mapInPandas(_finder(words), f"key {kind}, name string")
        hits = found if hits is None else hits.union(found)
    from pyspark.sql import Window as W

    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc(F.length("name")), "name")))
    return (ranked if limit is None else ranked.where(F.col("rank") <= limit)).withColumnRenamed("key", key)


def _finder(words: Broadcast) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Names of one part of a dictionary in the texts of a batch."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for w in words.value:
            automaton.add_word(w, w)
        if words.value:
            automaton.make_automaton()
        for batch in batches:
            rows = []
            for k, t in zip(batch.key, batch.text, strict=True):
                found = {w for end, w in automaton.iter(t) if _bounded(t, end - len(w) + 1, end + 1)} if words.value else set()
                rows += [(k, w) for w in found]
            yield pd.DataFrame(rows, columns=["key", "name"])

    return find


def _bounded(text: str, start: int, end: int) -> bool:
    def letter(i: int) -> bool:
        return 0 <= i < len(text) and (text[i].isascii() and text[i].isalpha() or "一" <= text[i] <= "龥")

    return not letter(start - 1) and not letter(end)


def extract_by_patterns(text: Column, patterns: Sequence[str]) -> Column:
    """Distinct first groups of all matches of all patterns, in order."""
    found = F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns]))
    return F.array_distinct(F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.length(x) >= 2))


def upstream_materials(texts: DataFrame, key: str, text: str, product: str, known: DataFrame, limit: int = 5) -> DataFrame:
    """``key, material``: what the product of each text is made from.

    Clauses about producers are left out. Phrases that state materials give lists, lists give names; a name counts if it
    is known (``name``) or may be one of a substance, and if it holds no character of an action. Known names that stand
    anywhere else in the text follow, the longest first: as many as make up ``limit`` names in all, at least one.
    Every name is one that a node may have; the product itself is none.
    """
    slim = texts.select(F.col(key).alias("key"), F.trim(F.col(product)).alias("product"), remove_producers(F.col(text).cast("string")).alias("text"))
    none = F.array().cast("array<string>")
    lists = [F.when(F.col("text").rlike(cue), F.regexp_extract_all("text", F.lit(p), F.lit(1))).otherwise(none) for p, cue in V.MATERIAL_PATTERNS]
    stated = F.flatten(F.array(*lists))
    named = slim.select("key", "product", F.explode(stated).alias("list")).select("key", "product", F.explode(smart_split(F.col("list"))).alias("name"))
    bare = cut_affixes(F.trim("name"), V.MATERIAL_PREFIXES, V.MATERIAL_SUFFIXES)
    clean = named.select("key", "product", clean_node_name(bare, V.CONNECTIVES).alias("material"))
    fit = (F.length("material") >= 2) & ~F.col("material").eqNullSafe(F.col("product")) & ~F.col("material").rlike(f"[{V.ACTION_CHARACTERS}]")
    names = known.select(F.col("name").alias("material")).distinct().withColumn("is_known", F.lit(True))
    tested = clean.where(fit).select("key", "material").distinct().join(names, "material", "left")
    plausible = name_plausible(F.col("material"), V.NAME_INVALID_WORDS, V.NAME_ALWAYS_VALID, V.NAME_MARKS)
    by_phrase = tested.where(F.col("is_known") | plausible).select("key", "material")

    scanned = scan_names(slim, "key", "text", known, limit=None).join(slim.select("key", "product"), "key")
    others = scanned.where(~F.col("name").eqNullSafe(F.col("product"))).select("key", clean_node_name(F.col("name"), V.CONNECTIVES).alias("material"))
    new = others.where("material <> ''").distinct().join(by_phrase, ["key", "material"], "left_anti")
    counts = by_phrase.groupBy("key").agg(F.count("*").alias("n"))
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy("key").orderBy(F.desc(F.length("material")), "material"))
    room = F.greatest(F.lit(1), F.lit(limit) - F.coalesce("n", F.lit(0)))
    kept = new.withColumn("rank", rank).join(counts, "key", "left").where(F.col("rank") <= room)
    return by_phrase.unionByName(kept.select("key", "material")).withColumnRenamed("key", key)


def class_edges(df: DataFrame, name: str, parts: Column, relation: str) -> DataFrame:
    """Distinct ``src, relation, class, value``: an entity and each classified part of one of its texts."""
    found = df.select(F.col(name).alias("src"), F.explode(parts).alias("p")).where("src <> ''")
    return found.select("src", F.lit(relation).alias("relation"), F.col("p.class").alias("class"), F.col("p.part").alias("value")).distinct()


def greedy_groups(names: DataFrame, pairs: DataFrame) -> DataFrame:
    """``name, leader``: names in order of ``ord``; one that is in no group yet founds one of all alike that are in none.

    ``names``: distinct ``name, ord``; ``pairs``: ``a, b`` alike. Rounds decide all names at once whose alike of lower
    order are decided: such a name leads, and what is like it does not. The rest is written between rounds, so lineage
    doesn't grow. Each other name goes to its leader of the lowest order.
    """
    both = pairs.select("a", "b").union(pairs.select("b", "a")).where("a <> b").distinct()
    order = names.select("name", "ord")
    alike = cut_lineage(both.join(order.toDF("a", "oa"), "a").join(order.toDF("b", "ob"), "b"))
    rest, members = alike, None
    while not rest.isEmpty():
        leaders = rest.groupBy("a").agg(F.first("oa").alias("oa"), F.min("ob").alias("lowest")).where("oa < lowest").select(F.col("a").alias("b"))
        joined = cut_lineage(rest.join(leaders, "b", "left_semi").select(F.col("a").alias("name")).distinct())
        members = joined if members is None else members.unionByName(joined)
        gone = joined.unionByName(leaders.toDF("name"))
        rest = cut_lineage(rest.join(gone.toDF("a"), "a", "left_anti").join(gone.toDF("b"), "b", "left_anti"))
    if members is None:
        return names.select("name", F.col("name").alias("leader"))
    # Of all leaders a member is like, the first in order has taken it.
    taken = alike.join(members.toDF("a"), "a", "left_semi").join(members.toDF("b"), "b", "left_anti").groupBy("a").agg(F.min_by("b", "ob").alias("leader"))
    return names.select("name").join(taken.withColumnRenamed("a", "name"), "name", "left").select("name", F.coalesce("leader", "name").alias("leader"))


def relation_edges(pairs: DataFrame) -> DataFrame:
    """``src, dst, type`` from distinct ``product, material``: two edges per process and two per material."""
    process = F.concat("product", F.lit(PROCESS_SUFFIX))
    products = pairs.select("product").distinct().select(
        F.explode(
            F.array(
                F.struct(process.alias("src"), F.col("product").alias("dst"), F.lit(PRODUCES).alias("type")),
                F.struct(F.col("product").alias("src"), process.alias("dst"), F.lit(COMES_FROM).alias("type")),
            )
        ).alias("e")
    )
    materials = pairs.select("product", "material").distinct().select(
        F.explode(
            F.array(
                F.struct(F.col("material").alias("src"), process.alias("dst"), F.lit(TAKES_PART).alias("type")),
                F.struct(process.alias("src"), F.col("material").alias("dst"), F.lit(RAW_MATERIAL).alias("type")),
            )
        ).alias("e")
    )
    return products.select("e.*").union(materials.select("e.*"))


def process_nodes(edges: DataFrame) -> DataFrame:
    """``name, process_type, product`` of every end of an edge that names a process."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("name")).where(F.col("name").contains("工艺")).distinct()
    made = F.col("name").endswith(PROCESS_SUFFIX)
    old = F.col("name").rlike("^.+_制备_.+_工艺$")
    kind = F.when(made, "化学生产工艺").when(old, "化学制备工艺").otherwise("化学工艺")
    product = F.when(made, F.regexp_replace("name", f"{PROCESS_SUFFIX}$", "")).when(old, F.regexp_extract("name", "_制备_(.+)_工艺$", 1))
    return ends.select("name", kind.alias("process_type"), product.alias("product"))


def dedup_edges(edges: DataFrame, order: str) -> DataFrame:
    """The first of each (src, dst, type)."""
    return keep_first(edges, ["src", "dst", "type"], order)


def drop_longer_edges(edges: DataFrame) -> DataFrame:
    """Without edges of which a like one of the same type exists with both ends shorter or equal and contained.

    The shortest wins whatever the order of the rows, and pairs come from equi-joins on substrings.
    """
    names = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    near = containing_pairs(names, names, least=1).where(F.length("left_name") > F.length("right_name"))
    shorter = near.select(F.col("left_name").alias("long"), F.col("right_name").alias("short")).union(names.select("name", F.col("name")))
    s = shorter.select(F.col("long").alias("src"), F.col("short").alias("src2"))
    d = shorter.select(F.col("long").alias("dst"), F.col("short").alias("dst2"))
    reach = edges.join(s, "src").join(d, "dst").where("src <> src2 or dst <> dst2")
    have = edges.select(F.col("src").alias("src2"), F.col("dst").alias("dst2"), "type").distinct()
    beaten = reach.join(have, ["src2", "dst2", "type"], "left_semi").select("src", "dst", "type").distinct()
    return edges.join(beaten, ["src", "dst", "type"], "left_anti")


def resolve_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges both of whose ends are nodes (``name``)."""
    known = nodes.select("name").distinct()
    both = edges.join(known.withColumnRenamed("name", "src"), "src", "left_semi").join(known.withColumnRenamed("name", "dst"), "dst", "left_semi")
    return both.select("src", "dst", "type").distinct()


def alias_edges(entries: DataFrame, name: str, alias: str, separators: str = "[;；]") -> DataFrame:
    """``src, dst, is_known``: entity to alias, no edge to itself; known if the alias is an entity of its own."""
    pairs = entries.select(F.trim(name).alias("src"), F.explode(F.split(alias, separators)).alias("a")).select("src", F.trim("a").alias("dst"))
    good = pairs.where("src <> '' and dst <> '' and src <> dst").distinct()
    known = entries.select(F.trim(name).alias("dst")).distinct().withColumn("is_known", F.lit(True))
    return good.join(known, "dst", "left").select("src", "dst", F.coalesce("is_known", F.lit(False)).alias("is_known"))


def property_edges(df: DataFrame, key: str, kinds: Mapping[str, Column], relation: str = "HAS_PROPERTY") -> DataFrame:
    """``key, relation, kind, value`` for every property with a value."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])
    return df.select(key, F.lit(relation).alias("relation"), F.inline(pairs)).where("value is not null")


def neighbours(edges: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """Per destination the distinct sources by edge type, sorted and joined; only where there are any."""
    distinct = edges.where(F.col("type").isin(list(kinds))).select("dst", "type", "src").distinct()
    gathered = [F.array_join(F.array_sort(F.collect_list(F.when(F.col("type") == k, F.col("src")))), ";").alias(k) for k in kinds]
    return distinct.groupBy("dst").agg(*gathered)


def project_nodes(
    df: DataFrame, columns: Mapping[str, str], hazard: str | None = None, hazard_columns: Sequence[str] = (), labels: Sequence[str] = ("DangerousChemical;Chemical", "Chemical")
) -> DataFrame:
    """Rows as nodes of a graph import: the columns that exist under their new names, and ``:LABEL``.

    The part of a new name after the colon tells what is done: ``ID`` and ``name`` are cleaned names, and rows whose
    name has nothing left are dropped; ``id`` is blank where it holds Chinese; ``string[]`` is a list of cleaned names;
    ``source`` is what stands in braces, else the default; ``producers`` is text without clauses about producers. Of rows
    whose ``hazard`` isn't 是, ``hazard_columns`` are blank; without that column they are all. Nulls become blank.
    """
    dangerous = F.coalesce(F.trim(F.col(f"`{hazard}`")) == "是", F.lit(False)) if hazard in df.columns else F.lit(False)
    clean = lambda c: clean_node_name(c, V.CONNECTIVES)

    def made(column: str, kind: str) -> Column:
        c = F.col(f"`{column}`").cast("string")
        if kind in ("ID", "name"):
            c = clean(c)
        elif kind == "id":
            c = F.when(~c.rlike("[一-龥]"), c)
        elif kind == "string[]":
            c = F.array_join(F.filter(F.transform(F.split(c, "[;；|]"), lambda x: clean(F.trim(x))), lambda x: x != ""), ";")
        elif kind == "source":
            c = F.coalesce(F.nullif(F.array_join(braced_items(c), "; "), F.lit("")), F.lit(V.SOURCE_DEFAULT))
        elif kind == "producers":
            c = remove_producers(c)
        return F.coalesce(F.when(dangerous, c) if column in hazard_columns else c, F.lit(""))

    kept = {old: new for old, new in columns.items() if old in df.columns}
    out = [made(old, new.split(":")[1]).alias(_header(new)) for old, new in kept.items()]
    nodes = df.select(*out, F.when(dangerous, labels[0]).otherwise(labels[1]).alias(":LABEL"))
    named = [_header(new) for new in kept.values() if new.endswith(":ID")]
    return nodes.where(F.col(f"`{named[0]}`") != "") if named else nodes


def _header(name: str) -> str:
    """The header of an import file: kinds that are made differently are strings all the same."""
    base, kind = name.split(":")
    return name if kind in ("ID", "string[]") else f"{base}:string"


def import_tables(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables with the headers that a graph database imports."""
    n = nodes.select(*[F.col(c).alias({"name": "name:ID", "label": ":LABEL"}.get(c, f"{c}:string")) for c in nodes.columns])
    e = edges.select(F.col("src").alias(":START_ID"), F.col("dst").alias(":END_ID"), F.col("type").alias(":TYPE"))
    return n, e
