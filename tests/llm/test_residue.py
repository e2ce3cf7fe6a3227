import numpy as np

from quarrymill.llm.residue import COUNT_SLOTS, EXEMPLARS, Index, find_residue

SCHEMA = "row_id long, v string, cell string, kind string, p string"
RESIDUE = {
    "placeholder": ["适用于{{ name }}的型号", "rated at ${tdp}.", "see [INSERT HERB]", "<%= x %>", "%(trial_n)s", "[[a]]", "__功效__", "$value$", "<!-- tdp -->", "<tdp>", "【请填写功效】", "[tdp待补充]",
                    "[待补全]", "[ 待补全 ]", "Good text here. {参数}", "适用于{名称}读取", "{'名称': '{value}'}", "3.0{field_3}", "see __model__The end", "{'max': '[INSERT value]', '材质': '铝'}"],
    "filler": ["Lorem ipsum dolor sit amet.", "labore aliqua elit tempor magna dolore", "xxxxxxxx", "。。。", "- - -", "TBD", "测试测试测试", "asdf asdf ", "文案占位文案占位", "☆☆☆", "foo bar baz", "内容待更新"],
    "error": ["404 Not Found", "HTTP Error 503 - Service Unavailable", "抱歉，网关超时（错误代码 504）", "{'error': '禁止访问', 'retry_after': 30}", '{"error": {"code": 500, "message": "Internal Server Error", "request_id": "q1"}}', "禁止访问，请26秒后重试", "Oops! Bad Gateway. Go back to the start page.",
              "<html><head><title>403 Forbidden</title></head><body><h1>Forbidden</h1></body></html>", "java.lang.NullPointerException at line 5"],
    "script": ["Please enable JavaScript to view this page.", "您的浏览器不支持脚本或脚本已被禁用", "<noscript>You need to allow scripts to run this app.</noscript>"],
}
CONTENT = ["server: no; fans: 4", "[1] 见手册", "x_{max} and [abc]", "<b>bold</b>", "HBr $5 and $6", 'The firmware prompt shows "Access denied" until an owner key is set. Cache size is 9 MB.', "{'error_rate': '1 in 10^15', 'server': 'no', 'test': 'passed', '注': '[1] 见手册'}",
           "管理页面无需启用脚本即可浏览。", "The standard error was 2.36; the page limit kept details out of the report.", "Supports 5 displays; the third is a placeholder port covered by a cap.",
           "文献404篇经筛选后仅6篇符合标准。", "Request for follow-up data was declined by 8 centres.", "Ships with 4 brackets and a printed template for drilling.", "误差线表示标准误，模板法计数重复9次。"]


def kinds(spark, cells):
    df = spark.createDataFrame([(i, c, "a", "b", "c") for i, c in enumerate(cells)], SCHEMA)
    got = {r.row_id: r.kind for r in find_residue(df, "t", ["v"]).collect()}
    return [got.get(i) for i in range(len(cells))]


def test_kinds(spark):
    flat = [(k, c) for k, cells in RESIDUE.items() for c in cells]
    got = kinds(spark, CONTENT * 20 + [c for _, c in flat])
    assert got[: len(CONTENT) * 20] == [None] * (len(CONTENT) * 20)
    assert list(zip(got[len(CONTENT) * 20 :], [c for _, c in flat], strict=True)) == flat


def test_edges(spark):
    assert kinds(spark, [None, "", " ", "N/A", "nan", "无", "处理异常", "未知"]) == [None] * 8
    assert find_residue(spark.createDataFrame([], SCHEMA), "t", ["v"]).count() == 0
    assert kinds(spark, CONTENT + ["Real words of a long text about boards. " * 20_000 + "${x}"])[-1] == "placeholder"


def test_repeated_windows_count_each_time():
    """Repeated residue is most of a cell, however few of its distinct features it has."""
    index = Index(np.zeros(COUNT_SLOTS, np.int64))
    other = " ".join(f"granite{a}{b}" for a in "abcdefgh" for b in "klmno") + "."
    assert index.classify("加载失败，请刷新重试。" * 20 + other) == "error"
    assert index.classify("加载失败，请刷新重试。" * 2 + other) is None


def test_every_case_is_contained_in_an_exemplar():
    """Without the exemplars of a kind nothing of that kind is found: no other way leads to a case."""
    for kind, cells in RESIDUE.items():
        index = Index(np.zeros(COUNT_SLOTS, np.int64), {k: v for k, v in EXEMPLARS.items() if k != kind})
        assert kind not in {index.classify(c) for c in cells}


def test_long_cells():
    """Cells of open brackets are read in one go; those without letters are filler."""
    index = Index(np.zeros(COUNT_SLOTS, np.int64))
    n = 200_000
    got = [index.classify(c) for c in ("[" * n, "{" * n, "_" * n, "【" * n, "<zinc " * n, "$zinc" * n, "{zinc " * n, "__zinc" * (n // 100))]
    assert got == ["filler"] * 4 + [None, "placeholder", None, "placeholder"]
