from pyspark.sql import functions as F

from quarrymill.functions import json_text as J
from quarrymill.functions import similarity as S
from quarrymill.functions import text as X
from quarrymill.operators import catalogue as K
from quarrymill.operators import enrich as E
from quarrymill.operators import graph as G
from quarrymill.operators import merge as M
from quarrymill.operators import search as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_continuations(spark):
    rows = [("f", 1, ""), ("f", 2, "a,"), ("f", 3, "b"), ("f", 4, "c"), ("f", 5, "d,"), ("g", 1, "e,")]
    df = spark.createDataFrame(rows, "file string, n int, t string")
    blank = ~F.col("t").contains(",")
    assert sorted(r.t for r in M.continue_rows(df, "file", "n", "t", blank).collect()) == ["a,b", "d,", "e,"]
    for chunk in (1, 2, 100):
        assert sorted(r.t for r in M.continue_rows(df, "file", "n", "t", blank, chunk=chunk, every=True).collect()) == ["a,bc", "d,", "e,"]


def test_lookup_is_exact(spark):
    names = spark.createDataFrame([("甲苯",), ("二甲苯胺",), ("水银",)], "name string")
    entries = spark.createDataFrame([("苯胺", "1", 2), ("甲苯", "2", 1), ("二甲苯", "3", 0)], "name string, id string, ord int")
    assert {r.name: r.found_id for r in K.lookup_ids(names, entries).collect()} == {"甲苯": "2", "二甲苯胺": "3", "水银": None}


def test_near_pairs_lose_none(spark):
    import random

    r = random.Random(1)
    words = list({"".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(150)})
    names = spark.createDataFrame([(w,) for w in words], "name string")
    got = {(x.a, x.b) for x in R.near_pairs_both(names, 0.7).collect()}
    brute = spark.createDataFrame([(a, b) for a in words for b in words if a < b], "a string, b string").where(S.edit_ratio(F.col("a"), F.col("b")) >= 0.7)
    assert got == {(x.a, x.b) for x in brute.collect()}


def test_scan_paths_agree(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "含 甲苯、乙醇 的"), (2, "二甲苯溶液"), (3, None), (4, "")], "id long, t string")
    names = spark.createDataFrame([("甲苯",), ("乙醇",), ("二甲苯",)], "name string")
    fast = {(r.id, r.name) for r in G.scan_names(texts, "id", "t", names).collect()}
    monkeypatch.setattr(G, "MAX_BROADCAST_CHARACTERS", 10)
    assert fast == {(1, "甲苯"), (1, "乙醇")} == {(r.id, r.name) for r in G.scan_names(texts, "id", "t", names).collect()}


def test_longer_edges_go(spark):
    rows = [("甲苯", "x工艺", "参与"), ("二甲苯", "x工艺", "参与"), ("水", "y工艺", "参与"), ("甲苯", "x工艺", "原料")]
    df = spark.createDataFrame(rows, "src string, dst string, type string")
    assert sorted(tuple(r) for r in G.drop_longer_edges(df).select("src", "dst", "type").collect()) == sorted([rows[0], rows[2], rows[3]])


def test_answers(spark):
    texts = ['{"a": "1"}', 'x ```json\n{"a": "1"}\n```', 'r {a: "1",} // c', "a: 1\nb: 2", '{"attributes": [{"name": "a", "value": "1"}]}', "", None, "no answer"]
    assert [J.parse_answer(t) for t in texts][:5] == [{"a": "1"}, {"a": "1"}, {"a": "1"}, {"a": "1", "b": "2"}, {"a": "1"}]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.parsed for r in J.parse_answers(df, "t").collect()}
    assert got[1] == {"a": "1"} and got[3] == {"a": "1", "b": "2"} and got[5] is None and got[6] is None and got[7] is None


def test_text(spark):
    assert one(spark, X.smart_split(F.lit("由2,4-二硝基苯、甲苯和水制得"))) == ["2,4-二硝基苯", "甲苯"]
    assert one(spark, X.remove_producers(F.lit("以乙烯为原料。主要生产商：某某公司；可得"))).startswith("以乙烯为原料")
    assert one(spark, X.trim_blanks(F.lit("　\xa0a b\t"))) == "a b"
    assert abs(one(spark, S.matching_blocks_ratio(F.lit("abcd"), F.lit("bcde"))) - 0.75) < 1e-9


def test_limiter_and_enrichment(spark):
    now = [0.0]
    waited = []

    def sleep(s):
        waited.append(s)
        now[0] += s

    limiter = E.RateLimiter(E.Limits(2, 10_000, 5_000, 2_000), lambda: now[0], sleep)
    limiter.wait(2000)
    limiter.wait(2000)
    assert not waited
    try:
        limiter.wait(2000)
        raise AssertionError
    except E.DailyBudgetSpent:
        pass
    df = spark.createDataFrame([("a",), ("a",), (" ",), (None,)], "name string")
    rows = E.enrich(df, "name", ["p"], E.stub_client, E.Limits(1000, 10**9, 10**9, 1), partitions=1).collect()
    assert [tuple(r) for r in rows] == [("a", "p of a", "成功")]


def test_hot_vector_blocks(spark, monkeypatch):
    import random

    r = random.Random(0)
    rows = [(i, [r.random() for _ in range(4)]) for i in range(60)] + [(99, [0.0] * 4), (100, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    sent = R.vector_top_k(df.where("id < 5"), df, "id", "v", 3).collect()
    monkeypatch.setattr(R, "MAX_BROADCAST_NUMBERS", 0)
    small = R.vector_top_k(df.where("id < 5"), df, "id", "v", 3, block=7).collect()
    assert sorted((x.query, x.id, x["rank"]) for x in sent) == sorted((x.query, x.id, x["rank"]) for x in small)
    large = R.vector_top_k(df.where("id < 5"), df, "id", "v", 3, block=1000).collect()
    assert sorted((x.query, x.id, x["rank"]) for x in small) == sorted((x.query, x.id, x["rank"]) for x in large) and len(small) == 15
