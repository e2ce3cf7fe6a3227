import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quarrymill.operators.records import CsvRules, diagnose, parse_records, split_strict

SCHEMA = "raw_id long, raw_text string, reason string, `品名` string"
CASES = [
    ("甲,64-17-5,x", None), ('"a,b",64-17-5,"x ""y"" z"', None), ('a,64-17-5,"two\nlines"', None), ("a,,", None), ("a,201994420,", None), ("a, 64-17-5 ,", None),
    ('"a,64-17-5,x', "quoting"), ('"a"x,64-17-5,x', "quoting"), ('a,64-17-5,x "y" z', "quoting"), (' "a",64-17-5,x', "quoting"),
    ("", "column_count"), ("  ", "column_count"), ("a,b", "column_count"), ("a,64-17-5,x,", "column_count"), ("a\tb\tc", "column_count"),
    ("　,64-17-5,x", "invalid_value"), ("未知,64-17-5,x", "invalid_value"), ("a,64-17-6,x", "invalid_value"), ("a,６４－１７－５,x", "invalid_value"),
    ("a,N/A,x", "invalid_value"), ("a,20199442,x", "invalid_value"), ("a,12345678-17-5,", "invalid_value"), ("品名,CAS号,备注", "invalid_value"),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, t, "r", "n") for i, (t, _) in enumerate(CASES)], SCHEMA)
    got = {r.raw_id: r.reason for r in parse_records(df).collect()}
    assert [(t, got[i]) for i, (t, _) in enumerate(CASES)] == CASES


def test_blocks_agree_with_single_records(spark):
    r = random.Random(5)
    texts = [r.choice(CASES)[0] for _ in range(3000)] + ["b,64-17-5,ok"] * 3000
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], SCHEMA)
    for row in parse_records(df, block=256).collect():
        fields, reason = diagnose(texts[row.raw_id], CsvRules())
        assert row.reason == reason
        assert [row[c] for c in CsvRules().columns] == ([None] * 3 if reason else fields)


def test_null_empty_and_long(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "a,64-17-5," + "x" * 1_000_000, None, None)], SCHEMA)
    got = {r.raw_id: (r.reason, len(r["备注"] or "")) for r in parse_records(df).collect()}
    assert got == {1: ("column_count", 0), 2: (None, 1_000_000)}
    assert parse_records(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab",\n 中', max_size=6), min_size=1, max_size=4))
def test_split_reads_what_was_written(fields):
    record = ",".join('"' + f.replace('"', '""') + '"' for f in fields)
    assert split_strict(record) == fields
