import pytest

from quarrymill.llm.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    if name.endswith("_found"):
        assert rows and len(set(map(tuple, rows))) == len(rows)
    if name in ORACLE:
        assert sorted(map(tuple, rows)) == sorted(duck.execute(ORACLE[name]).fetchall())
