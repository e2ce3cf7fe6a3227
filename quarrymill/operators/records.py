"""Rows that fail to parse: valid records as columns, the others with the reason.

Method: records are parsed in blocks by a columnar CSV reader. A block counts as parsed when all of
its records have the strict form and the reader gives exactly one row of the right width for each.
A block that fails is cut in two: by the strict form where some records lack it, so that one part
is all that has it and the other all that has not, else in the middle; parts are cut on until they
parse or are single bad records, which a strict state machine diagnoses. Blocks never cross a
partition, so the operator needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pcsv
from pyspark.sql import DataFrame

from quarrymill.vocab import NO_VALUE

BLOCK_RECORDS = 2048

# Strict form of one field by RFC 4180, for the columnar check of a block.
_FIELD = r'(?:[^",]*|"(?:[^"]|"")*")'


@dataclass(frozen=True)
class CsvRules:
    """What a record must hold. ``required``: column that must have a value; ``identifier``: registry number or serial."""

    columns: tuple[str, ...] = ("品名", "CAS号", "备注")
    required: str | None = "品名"
    identifier: str | None = "CAS号"
    no_value: tuple[str, ...] = tuple(NO_VALUE)


def split_strict(record: str) -> list[str] | None:
    """Fields of one record by RFC 4180 (comma, double quote, doubled for escape), None if the quoting is broken."""
    fields, i, n = [], 0, len(record)
    while True:
        if i < n and record[i] == '"':
            i, parts = i + 1, []
            while True:
                end = record.find('"', i)
                if end < 0:
                    return None
                parts.append(record[i:end])
                if end + 1 < n and record[end + 1] == '"':
                    parts.append('"')
                    i = end + 2
                    continue
                i = end + 1
                break
            if i < n and record[i] != ",":
                return None
            fields.append("".join(parts))
        else:
            end = record.find(",", i)
            end = n if end < 0 else end
            if '"' in record[i:end]:
                return None
            fields.append(record[i:end])
            i = end
        if i >= n:
            return fields
        i += 1


def registry_number_ok(text: str) -> bool:
    """ASCII ``digits-dd-d`` with two to seven digits and a right check digit."""
    a, _, rest = text.partition("-")
    b, _, c = rest.partition("-")
    if not (2 <= len(a) <= 7 and len(b) == 2 and len(c) == 1 and (a + b + c).isascii() and (a + b + c).isdigit()):
        return False
    return sum(int(d) * k for k, d in enumerate(reversed(a + b), 1)) % 10 == int(c)


def identifier_ok(text: str) -> bool:
    text = text.strip()
    return not text or registry_number_ok(text) or (len(text) == 9 and text.isascii() and text.isdigit() and text[:2] == "20")


def diagnose(record: str, rules: CsvRules) -> tuple[list[str] | None, str | None]:
    """The fields of a loadable record, or the first reason that applies: quoting, column_count, invalid_value."""
    fields = split_strict(record)
    if fields is None:
        return None, "quoting"
    if len(fields) != len(rules.columns):
        return None, "column_count"
    row = dict(zip(rules.columns, fields, strict=True))
    if rules.required and row[rules.required].strip() in rules.no_value:
        return fields, "invalid_value"
    if rules.identifier and not identifier_ok(row[rules.identifier]):
        return fields, "invalid_value"
    return fields, None


def _strict(records: pa.Array, rules: CsvRules) -> pa.Array:
    """Per record: strict RFC 4180 with the right number of fields, tested by columns."""
    return pc.match_substring_regex(records, "(?s)^" + ",".join([_FIELD] * len(rules.columns)) + "$")


def _columnar(records: pa.Array, strict: pa.Array, rules: CsvRules) -> list[pa.Array] | None:
    """The columns of a block that parses as a whole, else None."""
    if not pc.all(strict, min_count=0).as_py():
        return None
    data = "\n".join(records.to_pylist()).encode() + b"\n"
    try:
        got = pcsv.read_csv(
            pa.BufferReader(data),
            read_options=pcsv.ReadOptions(column_names=list(rules.columns), block_size=len(data) + 1, use_threads=False),
            parse_options=pcsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False),
            convert_options=pcsv.ConvertOptions(column_types={c: pa.string() for c in rules.columns}, strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    if got.num_rows != len(records):
        return None
    return [got.column(c).combine_chunks() for c in rules.columns]


def _invalid(columns: list[pa.Array], rules: CsvRules) -> list[bool]:
    """Per row of a parsed block: a value is not valid. Distinct identifiers are checked once."""
    by = dict(zip(rules.columns, columns, strict=True))
    bad = [False] * len(columns[0])
    if rules.required:
        bad = pc.is_in(pc.utf8_trim_whitespace(by[rules.required]), value_set=pa.array(rules.no_value, pa.string())).to_pylist()
    if rules.identifier:
        known: dict[str, bool] = {}
        for i, text in enumerate(by[rules.identifier].to_pylist()):
            ok = known.get(text)
            if ok is None:
                ok = known[text] = identifier_ok(text)
            bad[i] = bad[i] or not ok
    return bad


Part = tuple[np.ndarray, list[pa.Array], list[str | None]]


def parse_block(records: pa.Array, strict: pa.Array, rules: CsvRules, at: np.ndarray) -> Iterator[Part]:
    """Places, columns (null where not loadable) and reasons of the records; cuts what fails as a whole.

    ``at``: the places of the records, in which the results may come out of order.
    """
    if not len(records):
        return
    columns = _columnar(records, strict, rules)
    if columns is not None:
        bad = _invalid(columns, rules)
        mask = pa.array(bad, pa.bool_())
        yield at, [pc.if_else(mask, pa.scalar(None, pa.string()), c) for c in columns], ["invalid_value" if b else None for b in bad]
        return
    good = np.flatnonzero(strict.to_numpy(zero_copy_only=False))
    if not len(good):
        # None has the strict form, so no part of these can parse.
        found = [diagnose(r, rules) for r in records.to_pylist()]
        rows = [[None] * len(rules.columns) if reason else fields for fields, reason in found]
        yield at, [pa.array(c, pa.string()) for c in zip(*rows, strict=True)], [reason for _, reason in found]
        return
    if len(records) == 1:
        fields, reason = diagnose(records[0].as_py(), rules)
        row = [None] * len(rules.columns) if reason else fields
        yield at, [pa.array([v], pa.string()) for v in row], [reason]
        return
    middle = np.arange(len(records)) < len(records) // 2
    first = strict.to_numpy(zero_copy_only=False).astype(bool) if len(good) < len(records) else middle
    for part in (np.flatnonzero(first), np.flatnonzero(~first)):
        take = pa.array(part)
        yield from parse_block(records.take(take), strict.take(take), rules, at[part])


def parse_records(
    df: DataFrame, key: str = "raw_id", text: str = "raw_text", rules: CsvRules = CsvRules(), block: int = BLOCK_RECORDS
) -> DataFrame:
    """One row per record: the key, the columns of ``rules`` (null unless loadable) and ``reason`` (null if loadable).

    A null record counts as a blank one: one field, ``column_count``. Extra columns are ignored.
    """
    schema = f"`{key}` long, {', '.join(f'`{c}` string' for c in rules.columns)}, reason string"
    width = len(rules.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            records = pc.fill_null(batch.column(1).cast(pa.string()), "")
            strict = _strict(records, rules)
            parts: list[Part] = []
            for start in range(0, len(records), block):
                own = records.slice(start, block)
                parts += parse_block(own, strict.slice(start, block), rules, np.arange(start, start + len(own)))
            if parts:
                order = pa.array(np.concatenate([p[0] for p in parts]))
                columns = [pa.concat_arrays([p[1][k] for p in parts]) for k in range(width)]
                reasons = pa.array([r for p in parts for r in p[2]], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(order), *columns, reasons], [key, *rules.columns, "reason"])

    return df.selectExpr(f"cast(`{key}` as long) `{key}`", f"cast(`{text}` as string) `{text}`").mapInArrow(run, schema)

