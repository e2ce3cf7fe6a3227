"""Sinks: batched CSV, graph import files, nested JSON, a load script."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.operators.graph import import_tables


def write_batches(df: DataFrame, path: str, rows: int = 3000, mode: str = "overwrite", mark: bool = False) -> None:
    """CSV files of at most so many rows each; nulls become blanks. ``mark``: each file starts with a byte order mark."""
    out = df.na.fill("")
    if mark:
        out = out.toDF("\ufeff" + out.columns[0], *out.columns[1:])
    out.write.mode(mode).option("header", True).option("maxRecordsPerFile", rows).option("escape", '"').csv(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, rows: int = 3000, mode: str = "overwrite") -> None:
    n, e = import_tables(nodes, edges)
    write_batches(n, f"{path}/nodes", rows, mode)
    write_batches(e, f"{path}/edges", rows, mode)


def write_nested(df: DataFrame, path: str) -> None:
    """The nested records as JSON, and flat: lists joined, structs as ``outer_inner`` columns."""
    df.write.mode("overwrite").json(f"{path}/nested")
    write_batches(flatten(df), f"{path}/flat")


def flatten(df: DataFrame) -> DataFrame:
    """Structs become columns; lists of texts are joined; other lists and maps become JSON."""
    out = []

    def walk(column, kind: T.DataType, name: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(column[f.name], f.dataType, f"{name}_{f.name}" if name else f.name)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            out.append(F.array_join(column, "; ").alias(name))
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            out.append(F.to_json(column).alias(name))
        else:
            out.append(column.cast("string").alias(name))

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.dataType, f.name)
    return df.select(*out)


def load_script(label: str = "Chemical", node_file: str = "nodes.csv", edge_file: str = "edges.csv", batch: int = 1000) -> str:
    """A script for a graph database: constraint, nodes, edges, index."""
    return "\n".join(
        [
            f"CREATE CONSTRAINT {label.lower()}_name IF NOT EXISTS FOR (n:{label}) REQUIRE n.name IS UNIQUE;",
            f"LOAD CSV WITH HEADERS FROM 'file:///{node_file}' AS row CALL {{ WITH row MERGE (n:{label} {{name: row['name:ID']}}) SET n += row }} IN TRANSACTIONS OF {batch} ROWS;",
            f"LOAD CSV WITH HEADERS FROM 'file:///{edge_file}' AS row CALL {{ WITH row MATCH (a {{name: row[':START_ID']}}), (b {{name: row[':END_ID']}}) MERGE (a)-[:RELATION {{type: row[':TYPE']}}]->(b) }} IN TRANSACTIONS OF {batch} ROWS;",
            f"CREATE INDEX {label.lower()}_cas IF NOT EXISTS FOR (n:{label}) ON (n.cas);",
        ]
    )


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``part, kind, n``: counts by label and by type."""
    a = nodes.groupBy(F.lit("node").alias("part"), F.col("label").alias("kind")).count()
    b = edges.groupBy(F.lit("edge").alias("part"), F.col("type").alias("kind")).count()
    return a.union(b).withColumnRenamed("count", "n")
