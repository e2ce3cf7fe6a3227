"""Several values packed in one field: one row per value, with its position.

Method: every span whose characters belong together (quoted text, parentheses, locants of a
substance name, names such as ``I/O``) is replaced by an indexed placeholder; what remains is
split at the delimiters; the spans come back by array lookup; ``posexplode`` gives the rows.
Everything is a Spark expression: one narrow pass, no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import is_no_value, trim_blanks

OPEN, CLOSE = "\ue000", "\ue001"

# What may stand before and after a quoted span or an abbreviation with a slash. Patterns test their
# first character before they look behind, so that most places in a cell cost one comparison. Loops over
# alternatives are possessive: the matcher would need a stack as deep as the cell is long to go back into them.
_EDGE = r"\[\]{}(),;:|/+•·*\n\t，；、：①-⑳"
_AFTER = rf"(?=\s*(?:$|[{_EDGE}]))"


def _opening(mark: str) -> str:
    """A quotation mark at the start of a value."""
    return rf"{mark}(?<=(?:^|[-.{_EDGE}])\s{{0,4}}{mark})"


_QUOTED = [
    _opening('"') + r'(?:[^"\\]++|\\.|"")*+"' + _AFTER,
    _opening('"') + r'(?:[^"\\]++|\\.)*+"' + _AFTER,
    _opening("'") + r"(?:[^'\\]++|\\.)*+'" + _AFTER,
    _opening("“") + r"[^”]*+”" + _AFTER,
    _opening("「") + r"[^」]*+」" + _AFTER,
]
_PARENTHESES = [r"\((?:[^()]++|\([^()]*+\))*+\)", r"（[^（）]*+）"]
# A number that goes on from the number before it starts no list of locants: the earlier start has been tried.
_LOCANTS = [r"(?:\d(?<!\d\d)(?<!\d['′’]?,\d)\d*+['′’]*|[NOSPα-ω](?<![A-Za-z].)),(?:\d++['′’]*|[NOSP])(?:,(?:\d++['′’]*|[NOSP]))*+(?=['′’]*-)"]
# An abbreviation with a slash starts a value; a bullet or a number with a dot may stand before it.
_START = rf"(?:(?:^|[{_EDGE}])\s{{0,4}}|[-.]\s{{1,4}})"
_SLASHED = [
    rf"[A-Z][A-Z]?/[A-Z0-9]++(?![a-z-])(?<={_START}[A-Z]{{1,2}}/[A-Z0-9]{{1,12}})",
    rf"[A-Z]{{2,8}}/[A-Z](?![A-Za-z0-9-])(?<={_START}[A-Z]{{2,8}}/[A-Z])",
]
# A comma before a lower-case qualifier, as in "DVI-D, dual link" or "8.1, 64-bit".
_QUALIFIER = [rf",\s(?:[a-z]{{2,}}(?:[^\S\n\t][a-z]++)*+|\d+-[a-z]+)(?=\s*(?:$|[{_EDGE}]|\s\d{{1,2}}\.\s))"]
# A cell without any of these has no span.
_MAY_SPAN = f"[\"'“「(（/{OPEN}{CLOSE}]|,"

# Delimiters between values, once the spans above are out of the way.
DELIMITERS = r"[,;|/•·\n\r\t，；、｜①-⑳]|(?<=\s|^)\+"


def _span_pattern(qualifiers: bool) -> str:
    parts = [*_QUOTED, *_PARENTHESES, *_LOCANTS, *_SLASHED, *(_QUALIFIER if qualifiers else []), f"[{OPEN}{CLOSE}]"]
    return "(?s)" + "|".join(parts)


def _restored(piece: Column, spans: Column) -> Column:
    """Puts the spans back: odd parts of the piece are indexes into them."""
    parts = F.split(piece, f"[{OPEN}{CLOSE}]", -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.get(spans, p.cast("int"))).otherwise(p)), "")


def _unquoted(value: Column) -> Column:
    """Without enclosing quotes and escapes; the value is one quoted span."""
    body = F.substring(value, 2, 2_000_000_000)
    body = F.regexp_replace(body, r"(?s).$", "")
    double = F.regexp_replace(body, r'""|\\"', '"')
    # Characters written as escapes are read as JSON has them.
    read = F.get(F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>"), F.lit(0))
    double = F.when(F.contains(value, F.lit("\\u")), F.coalesce(read, double)).otherwise(double)
    single = F.regexp_replace(body, r"\\'", "'")
    plain = F.when(value.startswith('"'), double).when(value.startswith("'"), single).otherwise(body)
    return F.regexp_replace(plain, r"\\\\", r"\\")


def explode_packed(
    df: DataFrame,
    table_name: str,
    fields: Sequence[str],
    key: str = "row_id",
    qualifiers: bool = True,
) -> DataFrame:
    """One row per value packed in ``fields``: ``table_name, row_id, field_name, pos, item``.

    Null, blank and no-value cells give no row; empty pieces are no values and take no position;
    repeated values count each; a cell of one value gives one row. Extra columns are ignored.
    ``qualifiers``: a comma before a lower-case qualifier belongs to the value; off for columns
    in which lower-case words are values of their own.
    """
    pattern = _span_pattern(qualifiers)
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("cell")) for f in fields])
    cells = (
        df.select(F.col(key).cast("long").alias("row_id"), F.explode(pairs).alias("p"))
        .select("row_id", "p.field_name", trim_blanks(F.col("p.cell")).alias("cell"))
        .where(~is_no_value(F.col("cell")))
    )
    may = F.col("cell").rlike(_MAY_SPAN)
    spans = F.when(may, F.regexp_extract_all(F.col("cell"), F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    held = cells.withColumn("spans", spans)
    marked = F.transform(
        F.split("cell", pattern, -1), lambda p, i: F.when(i < F.size("spans"), F.concat(p, F.lit(OPEN), i.cast("string"), F.lit(CLOSE))).otherwise(p)
    )
    held = held.withColumn("masked", F.when(F.size("spans") > 0, F.array_join(marked, "")).otherwise(F.col("cell")))
    inner = trim_blanks(F.substring(F.col("masked"), F.lit(2), F.length("masked") - 2))
    bracketed = F.left("masked", F.lit(1)).isin("[", "{", "【") & F.right("masked", F.lit(1)).isin("]", "}", "】")
    held = held.withColumn("bare", F.when(bracketed, inner).otherwise(F.col("masked")))
    is_numbered = F.left("bare", F.lit(1)).isin("1", "１") & F.col("bare").rlike(r"^[1１]\s?[.)．]\s")
    numbered = F.when(is_numbered, F.regexp_replace("bare", r"(?:^|\s)\d{1,3}\s?[.)．]\s+", "\n")).otherwise(F.col("bare"))
    held = held.select("row_id", "field_name", "spans", F.split(numbered, DELIMITERS, -1).alias("pieces"))

    key_of = rf"^{OPEN}\d+{CLOSE}\s*[:：]\s*"
    marker = r"^(?:[-*]\s+|[-*](?=[^\x00-\x7f]))"

    # Each step binds its values to a variable of its own, so nothing is computed twice.
    def bare_piece(piece: Column) -> Column:
        keyed = F.when(piece.startswith(OPEN), trim_blanks(F.regexp_replace(piece, key_of, ""))).otherwise(piece)
        return F.when(F.left(keyed, F.lit(1)).isin("-", "*"), F.regexp_replace(keyed, marker, "")).otherwise(keyed)

    def with_text(piece: Column) -> Column:
        lone = piece.startswith(OPEN) & (F.instr(piece, CLOSE) == F.length(piece))
        text = F.when(F.contains(piece, F.lit(OPEN)), _restored(piece, F.col("spans"))).otherwise(piece)
        return F.struct(lone.alias("lone"), text.alias("text"))

    def value(x: Column) -> Column:
        text = x["text"]
        first = F.left(text, F.lit(1))
        return (
            F.when(x["lone"] & first.isin('"', "'", "“", "「"), trim_blanks(_unquoted(text)))
            .when(first.isin("(", "（"), trim_blanks(F.regexp_replace(text, r"^(?:\(\d{1,3}\)|（\d{1,3}）)\s*", "")))
            .otherwise(trim_blanks(text))
        )

    steps = F.filter(F.transform("pieces", lambda p: trim_blanks(p)), lambda p: p != "")
    steps = F.transform(F.transform(steps, lambda p: bare_piece(p)), lambda p: with_text(p))
    items = F.filter(F.transform(steps, lambda x: value(x)), lambda v: v != "")
    return held.select(F.lit(table_name).alias("table_name"), "row_id", "field_name", F.posexplode(items).alias("i", "item")).select(
        "table_name", "row_id", "field_name", (F.col("i") + 1).cast("int").alias("pos"), "item"
    )
