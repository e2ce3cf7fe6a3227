"""The stages of a whole run: cleaned records, matched with a catalogue, merged by name, and the edges of the graph."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrymill import vocab as V
from quarrymill.functions.text import clean_text, null_tokens
from quarrymill.operators.catalogue import match_reference, prepare_catalogue
from quarrymill.operators.graph import relation_edges, upstream_materials
from quarrymill.operators.merge import merge_records


def clean(df: DataFrame | None, config: Mapping[str, Any], spark: SparkSession) -> DataFrame:
    """Rows of ``config["input"]`` with a name; texts cleaned, tokens of no value null, an order of their own."""
    source = spark.read.parquet(config["input"])
    columns = {config["name"]: "name", config["ident"]: "ident", config["text"]: "text"}
    slim = source.select(F.col(config["key"]).cast("long").alias("key"), *[null_tokens(clean_text(F.col(f"`{c}`").cast("string")), V.NO_VALUE).alias(n) for c, n in columns.items()])
    return slim.where("name is not null")


def match(df: DataFrame, config: Mapping[str, Any], spark: SparkSession) -> DataFrame:
    """Beside every row whether the catalogue lists it, and what it knows of it."""
    catalogue = prepare_catalogue(spark.read.parquet(config["catalogue"]), *config["catalogue_columns"])
    return df.join(match_reference(df, catalogue, "key", "name", "ident"), "key")


def merge(df: DataFrame, config: Mapping[str, Any], spark: SparkSession) -> DataFrame:
    """One record per corrected name: the first id, the longest text, all aliases."""
    policies = {"ident": "first", "text": "longest", "is_hazard": "longest", "threshold": "longest", "alias": "alias"}
    return merge_records(df.drop("name").withColumnRenamed("corrected_name", "name"), ["name"], "key", policies)


def edges(df: DataFrame, config: Mapping[str, Any], spark: SparkSession) -> DataFrame:
    """Relations from what the texts say of materials."""
    pairs = upstream_materials(df.withColumn("product", F.col("name")), "name", "text", "product", df.select("name"))
    return relation_edges(pairs.select(F.col("name").alias("product"), "material"))


DEFAULT_STAGES = [("clean", clean), ("match", match), ("merge", merge), ("edges", edges)]
