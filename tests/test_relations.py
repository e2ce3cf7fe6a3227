"""Materials, containment, groups, key assignment, restarts and limits, on small fixtures."""

import os
import random
import subprocess
import sys

import quarrymill.operators.graph as G
from quarrymill.functions.assign import assign_keys, assign_loosely, key_score
from quarrymill.operators.enrich import DailyBudgetSpent, Limits, RateLimiter, enrich, stub_client
from quarrymill.operators.graph import drop_longer_edges, greedy_groups, scan_names, upstream_materials
from quarrymill.operators.tables import missing_numbers
from quarrymill.plans.pipeline import Pipeline

TEXTS = [
    (1, "上游原料包括：乙烯、苯和氯气。", "氯苯", {"乙烯", "苯"} - {"苯"} | {"氯气"}),
    (2, "以甲苯为原料", "苯甲酸", {"甲苯"}),
    (3, "由2,4-二硝基苯酚制得", "某物", {"2,4-二硝基苯酚"}),
    (4, "主要生产商：某某公司，以甲苯为原料", "x", {"甲苯"}),
    (5, "原料：甲醇", "甲醇", set()),
    (6, "含 乙酸 , 与 硫酸 混合", "x", {"乙酸", "硫酸"}),
    (7, "", "x", set()), (8, None, None, set()),
]


def test_upstream_materials(spark):
    texts = spark.createDataFrame([(k, t, p, "m") for k, t, p, _ in TEXTS], "id long, text string, p string, material string")
    known = spark.createDataFrame([("乙烯",), ("乙酸",), ("硫酸",), ("甲醇",), ("2,4-二硝基苯酚",), ("氯气",)], "name string")
    got: dict = {}
    for r in upstream_materials(texts, "id", "text", "p", known).collect():
        assert r.material not in got.setdefault(r.id, set())
        got[r.id].add(r.material)
    assert got == {k: v for k, _, _, v in TEXTS if v}
    assert upstream_materials(texts.limit(0), "id", "text", "p", known).count() == 0
    assert upstream_materials(texts, "id", "text", "p", known.limit(0)).where("id = 6").count() == 0


def test_scan_in_parts_and_of_long_names(spark, monkeypatch):
    long = "甲基" * 30
    names = [f"n{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)] + [long]
    texts = spark.createDataFrame([(1, "naa nbb xnaa " + long + " ncc"), (2, None), (3, "")], "id long, t string")
    known = spark.createDataFrame([(n,) for n in names], "name string")
    want = [(1, long, 1), (1, "naa", 2), (1, "nbb", 3), (1, "ncc", 4)]
    assert sorted(map(tuple, scan_names(texts, "id", "t", known).collect()), key=lambda r: r[2]) == want
    monkeypatch.setattr(G, "MAX_BROADCAST_CHARACTERS", 1000)
    assert sorted(map(tuple, scan_names(texts, "id", "t", known).collect()), key=lambda r: r[2]) == want


def test_containment_against_brute_force(spark):
    r = random.Random(4)
    edges = {("".join(r.choice("ab") for _ in range(r.randint(1, 4))), "".join(r.choice("ab") for _ in range(r.randint(1, 3))), r.choice("xy")) for _ in range(60)}
    kept = {e for e in edges if not any(f != e and f[2] == e[2] and f[0] in e[0] and f[1] in e[1] for f in edges)}
    got = drop_longer_edges(spark.createDataFrame(sorted(edges), "src string, dst string, type string"))
    assert set(map(tuple, got.collect())) == kept


def test_groups_against_one_by_one(spark):
    r = random.Random(6)
    names = [f"n{i:03d}" for i in range(80)]
    pairs = {tuple(sorted(r.sample(names, 2))) for _ in range(90)} | {(names[i], names[i + 1]) for i in range(20)}
    leader: dict = {}
    for n in names:
        if n not in leader:
            leader[n] = n
            for other in names:
                if other not in leader and tuple(sorted((n, other))) in pairs:
                    leader[other] = n
    frame = spark.createDataFrame([(n, n) for n in names], "name string, ord string")
    got = greedy_groups(frame, spark.createDataFrame(sorted(pairs), "a string, b string"))
    assert {x.name: x.leader for x in got.collect()} == leader
    none = greedy_groups(frame, spark.createDataFrame([], "a string, b string"))
    assert all(x.name == x.leader for x in none.collect()) and none.count() == len(names)


def test_keys_are_assigned_to_the_likest():
    assert assign_keys({"tdp": 1, "clock speed": 2, "odd": 3}, ["clock_speed", "tdp", "weight"]) == {"clock_speed": 2, "tdp": 1, "odd": 3}
    assert assign_keys({"分子量值": 1, "分子式": 2}, ["分子式", "分子量"]) == {"分子式": 2, "分子量": 1}
    assert assign_keys({}, ["a"]) == {} and 0.9 < key_score("memory size", "size memory") + 0.4 and key_score("a", "a") == 1.0
    assert assign_loosely({"CAS": " 64-17-5 ", "分子式为": "C2H6O", "空": " "}, ["CAS号", "分子式", "空"]) == {"CAS号": "64-17-5", "分子式": "C2H6O"}
    assert assign_loosely({"a": None}, ["a"]) == {}


def test_missing_numbers_of_a_wide_range(spark):
    ids = spark.createDataFrame([(1,), (3,), (3,), (7,), (None,), (2_500_000,)], "n long")
    assert missing_numbers(ids.where("n < 10"), "n").orderBy("n").collect() == [(2,), (4,), (5,), (6,)]
    assert missing_numbers(ids, "n").count() == 2_500_000 - 4
    assert missing_numbers(spark.createDataFrame([(1,), (3_000_000_000,)], "n long"), "n").limit(3).count() == 3
    assert missing_numbers(ids.limit(0), "n").count() == 0


def test_missing_numbers_against_brute_force(spark):
    far, edge = random.Random(3), 2**63 - 1
    for kind, known in (("long", far.sample(range(-9000, 9000), 6000)), ("int", [-(2**31), 9 - 2**31]), ("long", [edge, edge - 9000, None]), ("long", [-edge - 1, 9000 - edge])):
        ids = [n for n in known if n is not None]
        found = missing_numbers(spark.createDataFrame([(n,) for n in known], f"n {kind}"), "n")
        assert found.dtypes == [("n", {"long": "bigint"}.get(kind, kind))]
        assert sorted(n for (n,) in found.collect()) == sorted(set(range(min(ids), max(ids) + 1)) - set(ids))


def test_a_wide_gap_needs_little_memory(spark):
    """Rows that leave a stage one by one, as in a write, in a session of its own: none piles up the numbers of a gap."""
    code = """
from quarrymill.operators.tables import missing_numbers
from quarrymill.session import local_session
spark = local_session(cores=2, memory="600m")
found = missing_numbers(spark.createDataFrame([(1,), (12_000_000,)], "n long"), "n")
found.write.format("noop").mode("overwrite").save()
assert found.rdd.getNumPartitions() > 1
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=600)


def test_restart_takes_later_stages_along(spark, tmp_path):
    size = {"n": 1}
    stages = [("one", lambda df, c, s: s.range(size["n"])), ("two", lambda df, c, s: df)]
    run = lambda **k: Pipeline(spark, "p", str(tmp_path), stages).run(**k)
    assert [s.rows for s in run().stages] == [1, 1]
    size["n"] = 5
    assert [s.rows for s in run().stages] == [1, 1]
    assert [s.rows for s in run(start="one").stages] == [5, 5]


def test_limits_hold(spark, tmp_path):
    now = [0.0]
    limiter = RateLimiter(Limits(10, 100, 200, 100), clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    limiter.wait(100)
    limiter.wait(100)
    assert now[0] >= 60
    try:
        limiter.wait(100)
        raise AssertionError
    except DailyBudgetSpent:
        now[0] += 86_400
    limiter.wait(100)
    shares = [Limits(3, 9_000, 20_000, 2_000).most_partitions(n) for n in (1, 3, 50)]
    assert shares == [1, 3, 3] and 3 * Limits(3, 9_000, 20_000, 2_000).share(3).requests_per_minute <= 3
    names = spark.createDataFrame([("a",), ("b",), ("a",), ("",), (None,)], "n string")
    calls = str(tmp_path / "calls")

    def counted():
        client = stub_client()

        def call(prompt):
            with open(calls, "a") as f:
                f.write("x")
            return client(prompt)

        return call

    for _ in range(2):
        got = {r.n: r["用途"] for r in enrich(names, "n", ["用途"], counted, store=str(tmp_path / "s")).collect()}
        assert got == {"a": "用途 of a", "b": "用途 of b"}
    assert len(open(calls).read()) == 2


def test_whole_run(spark, tmp_path, small):
    from quarrymill.plans.stages import DEFAULT_STAGES

    rows = [(1, "甲苯", "108-88-3", "以石油为原料"), (2, "甲苯", None, "短"), (3, "氯苯", "无", "由苯制得"), (4, None, "x", "y"), (5, "nan", "x", "y")]
    spark.createDataFrame(rows, "row_id long, n string, c string, t string").write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(1, "氯苯[98%]", "一氯代苯", None)], "o int, n string, a string, c string").write.parquet(str(tmp_path / "cat"))
    config = {"input": str(tmp_path / "in"), "key": "row_id", "name": "n", "ident": "c", "text": "t", "catalogue": str(tmp_path / "cat"), "catalogue_columns": ["n", "a", "c", "o"]}
    state = Pipeline(spark, "run", str(tmp_path / "out"), DEFAULT_STAGES, config).run()
    assert [s.rows for s in state.stages] == [3, 3, 2, 4]
    merged = {r.name: (r.ident, r.is_hazard, r.threshold, r.n_rows) for r in spark.read.parquet(state.stages[2].output).collect()}
    assert merged == {"甲苯": ("108-88-3", "否", None, 2), "氯苯": (None, "是", "98%", 1)}
    assert ("石油", "甲苯_生产工艺", "参与") in {tuple(r) for r in spark.read.parquet(state.stages[3].output).collect()}


def test_imports_are_logged(spark, tmp_path):
    from quarrymill.sources.readers import too_long_rows
    from quarrymill.streaming.imports import import_file, import_log, import_statistics

    good, bad = tmp_path / "a.csv", tmp_path / "b.csv"
    good.write_text("品名,CAS号\n甲苯,108-88-3\n,1\nx,y,z\n", encoding="utf-8")
    bad.write_text("x,y\n1,2\n", encoding="utf-8")
    folder = str(tmp_path / "out")
    assert [r["中文名称"] for r in import_file(spark, str(good), folder).collect()] == ["甲苯"]
    assert import_file(spark, str(bad), folder) is None and import_file(spark, str(tmp_path / "none.csv"), folder) is None
    stats = import_statistics(import_log(spark, folder)).collect()
    assert [tuple(r) for r in stats] == [("csv", 3, 1, 1, 2)]
    assert [r.fields for r in too_long_rows(spark, str(good)).collect()] == [["x", "y", "z"]]
    written = next((tmp_path / "out" / "processed").glob("*/part-*.csv")).read_bytes()
    assert written.startswith(b"\xef\xbb\xbf") and len(list((tmp_path / "out" / "failed").glob("*.txt"))) == 2
