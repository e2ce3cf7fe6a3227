import json

import pytest

from quarrymill.operators.tables import pending_rows
from quarrymill.plans.pipeline import COMPLETED, FAILED, Pipeline, domain_attributes, list_pipelines, resolve_domain
from quarrymill.sources import columns as C
from quarrymill.sources import readers as R
from quarrymill.sources import sinks as K
from quarrymill.streaming import incremental as S


@pytest.mark.parametrize("encoding,found", [("utf-8-sig", "UTF-8"), ("utf-8", "UTF-8"), ("gb18030", "GB18030")])
def test_delimited(spark, tmp_path, encoding, found):
    path = tmp_path / "a.csv"
    path.write_bytes('品名;CAS号;备注\n甲;1;"x\ny"\n乙;;\n丙;1;2;3\n丁\n'.encode(encoding))
    assert R.file_encoding(str(path)) == found
    rows = R.read_delimited(spark, str(path)).orderBy("品名").collect()
    assert sorted(tuple(r) for r in rows) == sorted([("甲", "1", "x\ny"), ("乙", "", ""), ("丁", "", "")])


def test_formats(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"records": [{"a": 1}, {"a": 2}]}))
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "t.txt").write_text("one\n\n two\n")
    (tmp_path / "x.xml").write_text("<r><meta/><row><a>1</a></row><row><a>2</a></row></r>")
    (tmp_path / "s.tsv").write_text("a\tb\n1\t2\n")
    for name, n in (("w.json", 2), ("l.jsonl", 2), ("t.txt", 2), ("x.xml", 2), ("s.tsv", 1)):
        assert R.load(spark, str(tmp_path / name)).count() == n
    (tmp_path / "bad.xlsx").write_text("no book")
    df, failed = R.load_all(spark, [str(tmp_path)])
    assert df.count() == 9 and [p.endswith("bad.xlsx") for p, _ in failed] == [True]
    with pytest.raises(R.SourceError):
        R.load(spark, "a.unknown")


def test_columns(spark):
    df = spark.createDataFrame([("a", "b", "c", "d")], ["品名", "英文名称", "CAS", "Unnamed: 3"])
    assert C.drop_unnamed(df).columns == ["品名", "英文名称", "CAS"]
    assert C.standardise(C.drop_unnamed(df)).columns == ["中文名称", "英文名称", "CAS号"]
    assert C.detect_column(df.columns, ["cas"]) == "CAS"
    assert C.reorder(df, "CAS", "品名").columns == ["品名", "CAS", "英文名称", "Unnamed: 3"]


def test_sinks(spark, tmp_path):
    nodes = spark.createDataFrame([("a", "Chemical")], "name string, label string")
    edges = spark.createDataFrame([("a", "a", "参与")], "src string, dst string, type string")
    K.write_graph(nodes, edges, str(tmp_path / "g"), rows=10)
    assert spark.read.option("header", True).csv(str(tmp_path / "g/nodes")).columns == ["name:ID", ":LABEL"]
    nested = spark.sql("select 1 id, named_struct('x', 'y', 'l', array('p', 'q')) s")
    assert K.flatten(nested).first().asDict() == {"id": "1", "s_x": "y", "s_l": "p; q"}
    assert "MERGE" in K.load_script() and K.graph_summary(nodes, edges).count() == 2


def test_incremental(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    (folder / "a.csv").write_text("x\n1\n")
    run = lambda: S.run_new_files(spark, str(folder), str(tmp_path / "registry"), lambda df, paths: seen.append(len(paths)))
    assert (run(), run()) == (1, 0)
    (folder / "a.csv").write_text("x\n2\n")
    (folder / "b.csv").write_text("x\n3\n")
    assert run() == 2 and seen == [1, 2]


def test_stream(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    args = (spark, str(tmp_path / "in"), "id long", lambda df: df.where("id > 1"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert S.stream_table(*args) == 3
    spark.range(5, 7).write.mode("append").parquet(str(tmp_path / "in"))
    assert S.stream_table(*args) == 2
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_pipeline_resumes(spark, tmp_path):
    calls = []

    def first(df, config, session):
        calls.append("first")
        return session.range(3)

    def second(df, config, session):
        calls.append("second")
        if len(calls) < 3:
            raise RuntimeError("stopped")
        return pending_rows(df, df.where("id = 1"), ["id"])

    def make():
        return Pipeline(spark, "p", str(tmp_path), [("one", first), ("two", second)])

    with pytest.raises(RuntimeError):
        make().run()
    assert make().state.status == FAILED
    state = make().run()
    assert state.status == COMPLETED and state.stages[1].rows == 2 and calls == ["first", "second", "second"]
    assert list_pipelines(spark, str(tmp_path))[0]["name"] == "p"
    nested = {"domains": {"chemical": {"schema": {"attributes": [{"name": "a"}]}}}}
    assert domain_attributes(resolve_domain(nested, "chemical")) == ["a"]
