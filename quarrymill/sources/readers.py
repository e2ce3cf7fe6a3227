"""Sources: files of several formats and encodings as frames of strings.

Only names, a few kilobytes of the head of a file and XML tags are looked at on the driver; data is
read by Spark. Files of one format and encoding are read together in one scan.
"""

from __future__ import annotations

import glob
import os
from collections import Counter, defaultdict
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.functions.json_text import records_of

SNIFF_BYTES = 100_000
SEPARATORS = [",", ";", "\t", "|"]
FORMATS = {
    ".csv": "csv", ".tsv": "tsv", ".txt": "text", ".json": "json", ".jsonl": "jsonl", ".parquet": "parquet", ".xml": "xml", ".xlsx": "excel", ".xls": "excel",
    ".h5": "hdf5", ".hdf5": "hdf5",
}
WRAPPERS = ["data", "records", "items", "chemicals", "results"]


class SourceError(ValueError):
    """A source that cannot be read."""


def detect_encoding(head: bytes) -> str:
    """By byte order mark, then strict UTF-8, GB18030, Big5, else Latin-1. A cut character at the end does no harm."""
    for mark, name in ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
        if head.startswith(mark):
            return name
    for name, spark_name in (("utf-8", "UTF-8"), ("gb18030", "GB18030"), ("big5", "Big5")):
        for cut in range(4):
            try:
                head[: len(head) - cut].decode(name)
                return spark_name
            except UnicodeDecodeError:
                continue
    return "ISO-8859-1"


def file_encoding(path: str) -> str:
    with open(path, "rb") as f:
        return detect_encoding(f.read(SNIFF_BYTES))


def probe_separator(line: str) -> str:
    """The candidate that splits the line most, a comma if none does."""
    best = max(SEPARATORS, key=lambda s: (line.count(s), -SEPARATORS.index(s)))
    return best if best in line else ","


def _head_line(path: str, encoding: str) -> str:
    with open(path, encoding={"UTF-8": "utf-8-sig"}.get(encoding, encoding), errors="replace") as f:
        return f.readline().rstrip("\r\n")


def unique_names(names: Sequence[str]) -> list[str]:
    """Names that Spark can tell apart, whatever their case."""
    seen: Counter[str] = Counter()
    out = []
    for n in (n.strip() for n in names):
        seen[n.lower()] += 1
        out.append(n if seen[n.lower()] == 1 else f"{n}_{seen[n.lower()]}")
    return out


def _with_spare(spark: SparkSession, path: str, encoding: str | None, separator: str | None, breaks: bool) -> DataFrame:
    """All rows of a delimited file; what goes beyond the header's columns begins in ``__spare``."""
    encoding = encoding or file_encoding(path)
    head = _head_line(path, encoding)
    separator = separator or probe_separator(head)
    names = unique_names([n.strip('"') or f"_c{i}" for i, n in enumerate(head.split(separator))])
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "__spare"]])
    if encoding not in ("UTF-8", "ISO-8859-1", "UTF-16LE", "UTF-16BE"):
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    read = spark.read.schema(schema).options(
        header=True, multiLine=breaks, encoding=encoding, sep=separator, ignoreLeadingWhiteSpace=True, mode="PERMISSIVE", escape='"', enforceSchema=True
    )
    return read.csv(path)


def read_delimited(spark: SparkSession, path: str, encoding: str | None = None, separator: str | None = None, breaks: bool = True) -> DataFrame:
    """A delimited file with header as strings: blanks stay blank, short rows are filled up, rows that are too long are left out
    (``too_long_rows`` has them).

    ``breaks``: quoted fields may hold line breaks; a file is then read by one task. Without them large files are split.
    """
    return _with_spare(spark, path, encoding, separator, breaks).where(F.col("__spare").isNull()).drop("__spare").na.fill("")


def too_long_rows(spark: SparkSession, path: str, encoding: str | None = None, separator: str | None = None, breaks: bool = True) -> DataFrame:
    """``fields, reason`` of the rows with more fields than the header: those of the header and the first beyond them."""
    rows = _with_spare(spark, path, encoding, separator, breaks).where(F.col("__spare").isNotNull())
    return rows.select(F.array(*[F.col(f"`{c}`") for c in rows.columns]).alias("fields"), F.lit("too many fields").alias("reason"))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A list of records, a document that wraps one, or a single record."""
    df = spark.read.option("multiLine", True).json(path)
    for key in WRAPPERS:
        if key in df.columns and isinstance(df.schema[key].dataType, T.ArrayType) and isinstance(df.schema[key].dataType.elementType, T.StructType):
            return df.select(F.inline(F.col(key)))
    return df


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Tab or comma separated if the first line says so, else one ``content`` column; blank lines are left out."""
    head = _head_line(path, file_encoding(path))
    if "\t" in head:
        return read_delimited(spark, path, separator="\t")
    if "," in head:
        return read_delimited(spark, path, separator=",")
    return spark.read.text(path).select(F.col("value").alias("content")).where(F.trim("content") != "")


def read_xml(spark: SparkSession, path: str) -> DataFrame:
    """The most frequent tag below the root becomes the row."""
    from xml.etree import ElementTree

    tags: Counter[str] = Counter()
    depth = 0
    for event, element in ElementTree.iterparse(path, events=("start", "end")):
        depth += 1 if event == "start" else -1
        if event == "start" and depth == 2:
            tags[element.tag] += 1
        if event == "end" and depth <= 1:
            element.clear()
    if not tags:
        raise SourceError(f"no rows in {path}")
    return spark.read.format("xml").option("rowTag", tags.most_common(1)[0][0]).load(path)


def choose_sheet(names: Sequence[str], keywords: Sequence[str] = ("数据", "data", "化学品", "chemical", "main", "主表")) -> str:
    """The first sheet with a keyword, in order of the keywords, else the first."""
    return next((n for k in keywords for n in names if k in n.lower()), names[0])


def read_excel(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A sheet as strings. Needs a reader library for pandas, which is not part of this package."""
    import pandas as pd

    try:
        book = pd.ExcelFile(path)
    except ImportError as missing:
        raise SourceError(f"no library to read {path}: {missing}") from missing
    frame = book.parse(sheet or choose_sheet(book.sheet_names), dtype=str, keep_default_na=False)
    frame.columns = unique_names([str(c) for c in frame.columns])
    return spark.createDataFrame(frame.astype(str))


def read_hdf5(spark: SparkSession, path: str) -> DataFrame:
    import pandas as pd

    try:
        with pd.HDFStore(path, "r") as store:
            keys = [k.strip("/") for k in store.keys()]
            key = next((k for k in ("data", "df") if k in keys), keys[0] if keys else None)
            if key is None:
                raise SourceError(f"no tables in {path}")
            frame = store[key]
    except ImportError as missing:
        raise SourceError(f"no library to read {path}: {missing}") from missing
    return spark.createDataFrame(frame)


READERS = {
    "csv": read_delimited, "tsv": lambda s, p: read_delimited(s, p, separator="\t"), "text": read_text, "json": read_json, "jsonl": lambda s, p: s.read.json(p),
    "parquet": lambda s, p: s.read.parquet(p), "xml": read_xml, "excel": read_excel, "hdf5": read_hdf5,
}


def load(spark: SparkSession, path: str) -> DataFrame:
    """Reads a file by the suffix of its name."""
    kind = FORMATS.get(os.path.splitext(path)[1].lower())
    if kind is None:
        raise SourceError(f"unknown format: {path}")
    return READERS[kind](spark, path)


def find_files(folders: Sequence[str]) -> dict[str, list[str]]:
    """Files by format below the folders, sorted, each once."""
    found: dict[str, set[str]] = defaultdict(set)
    for folder in folders:
        for path in glob.glob(os.path.join(folder, "**", "*"), recursive=True):
            kind = FORMATS.get(os.path.splitext(path)[1].lower())
            if kind and os.path.isfile(path):
                found[kind].add(os.path.realpath(path))
    return {k: sorted(v) for k, v in sorted(found.items())}


def load_all(spark: SparkSession, folders: Sequence[str]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """The union of all readable files as strings with ``source_path``, and what failed with the reason."""
    frames, failed = [], []
    for paths in find_files(folders).values():
        for path in paths:
            try:
                df = load(spark, path)
            except Exception as error:  # noqa: BLE001 - a bad file must not stop the others
                failed.append((path, str(error)[:300]))
                continue
            frames.append(df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns]).withColumn("source_path", F.lit(path)))
    if not frames:
        return None, failed
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out, failed


def unwrap(df: DataFrame, column: str, schema: str) -> DataFrame:
    """Records of wrapped JSON documents in a column."""
    return df.select(F.inline(records_of(F.col(column), schema)))
