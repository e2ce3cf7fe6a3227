"""Queries over whole tables: nothing of a table is left out."""

import __spark_entry__ as entry

QUERIES = entry.queries()
FIXED = ["synonym_fold", "extract_temp", "temp_convert", "extract_pressure", "extract_density", "extract_solub", "extract_limits", "solubility_map", "keyword_categorize",
         "storage_classes", "relation_type", "error_class", "retry_delay"]


def test_queries_of_texts_read_whole_tables(spark, tmp_path):
    texts = ["吸入可致中毒；低温保存", "mp 10-15℃, bp 77F", "1 atm, 1.2 g/mL, 10g/100mL, LEL: 3.3%", "不溶于水", "Timeout while reading", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "row_id long, `备注` string").write.parquet(f"{tmp_path}/sample_chemicals.parquet")
    for name in FIXED:
        found = QUERIES[name](spark, str(tmp_path))
        per = {r.origin: r["count"] for r in found.groupBy("origin").count().collect()}
        assert set(per) == {"documents", "sample_chemicals"} and len(set(per.values())) == 1, name
        if name in ("synonym_fold", "extract_limits", "relation_type", "error_class", "retry_delay"):
            assert per["documents"] == len(texts)


def search_tables(spark, folder, queries, names):
    rows = [(50 * i, q, None) for i, q in enumerate(queries)]
    spark.createDataFrame(rows, "row_id long, `品名` string, `CAS号` string").write.parquet(f"{folder}/sample_chemicals.parquet")
    spark.createDataFrame([(i, n, None, None) for i, n in enumerate(names)], "`序号` int, `品名` string, `别名` string, `CAS号` string").write.parquet(f"{folder}/hazard_catalog.parquet")


def test_scores_need_one_common_character(spark, tmp_path):
    """Names of one character and reordered names share no pair of characters."""
    queries, names = ["苯甲", "氯", "全氟肟", "Na", "水"], ["甲苯", "氯气", "三氟羧基肟", "钠 N", "氯", "乙醇"]
    search_tables(spark, tmp_path, queries, names)
    got = {(r.query, r.name): r.score for r in QUERIES["jaccard_chars"](spark, str(tmp_path)).collect()}
    want = {}
    for q in queries:
        for n in names:
            score = min(1.0, len(set(q) & set(n)) / len(set(q) | set(n)) + (0.3 if q in n or n in q else 0.0))
            if score:
                want[q, n] = round(score, 4)
    assert got == want
    assert set(want) == {(r.query, r.name) for r in QUERIES["char_overlap"](spark, str(tmp_path)).collect()}
    for name in ("best_match", "fuzzy_search", "search_topk", "tiered_search"):
        assert ("苯甲", "甲苯") in {(r.query, r.name) for r in QUERIES[name](spark, str(tmp_path)).collect()}, name
    assert ("全氟肟", "三氟羧基肟") in {(r.query, r.name) for r in QUERIES["tiered_search"](spark, str(tmp_path)).collect()}


def test_makers_of_every_script(spark, tmp_path):
    makers = ["诺维萨科技", "诺维萨科枝", "Nórvexa", "norvexa", "norvexa™", "Ｎｏｒｖｅｘａ", "科凡", "科凡达", "corvane", "Corvanne", "", " ", None, "é", "e"]
    spark.createDataFrame([(i, m) for i, m in enumerate(makers)], "row_id long, manufacturer string").write.parquet(f"{tmp_path}/enriched_pc_hardware_database.parquet")
    names = sorted({m.strip(" ").lower() for m in makers if m and m.strip(" ")})

    def edits(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, line = line, [i]
            for j, y in enumerate(b, 1):
                line.append(min(last[j] + 1, line[-1] + 1, last[j - 1] + (x != y)))
        return line[-1]

    near = {(a, b): 1 - edits(a, b) / max(len(a), len(b)) for a in names for b in names if a < b}
    near = {pair: round(s, 4) for pair, s in near.items() if s >= 0.75}
    assert any(a > "⿿" for a, _ in near)
    assert {(r.a, r.b): r.score for r in QUERIES["fuzzy_pairs"](spark, str(tmp_path)).collect()} == near
    other = {n: min([n, *[b if n == a else a for a, b in near if n in (a, b)]], key=lambda x: (len(x), x)) for n in names}
    assert {r.name: r.canonical for r in QUERIES["canonical_shortest"](spark, str(tmp_path)).collect()} == other


def test_names_of_any_length_are_looked_up(spark, tmp_path):
    long = "甲基" * 25
    rows = [(0, long, None), (50, "氯", ""), (100, "含" + long + "盐", None), (150, long[:45], None), (200, "", None), (250, None, None)]
    spark.createDataFrame(rows, "row_id long, `品名` string, `CAS号` string").write.parquet(f"{tmp_path}/sample_chemicals.parquet")
    names = [(1, long, None, "1-1-1"), (2, "氯", None, "2-2-2")]
    spark.createDataFrame(names, "`序号` int, `品名` string, `别名` string, `CAS号` string").write.parquet(f"{tmp_path}/hazard_catalog.parquet")
    assert {r.row_id: r.id for r in QUERIES["fill_missing_id"](spark, str(tmp_path)).collect()} == {0: "1-1-1", 50: "2-2-2", 100: "1-1-1", 150: "1-1-1", 200: None, 250: None}
    assert {r.name: r.found_id for r in QUERIES["id_lookup"](spark, str(tmp_path)).collect()} == {long: "1-1-1", "氯": "2-2-2", "含" + long + "盐": "1-1-1", long[:45]: "1-1-1"}
    assert {r.name for r in QUERIES["fuzzy_semi"](spark, str(tmp_path)).collect()} == {long, "氯", "含" + long + "盐"}


def test_longer_edges_of_any_length_are_dropped(spark):
    from quarrymill.operators.graph import drop_longer_edges

    long = "甲基" * 25
    edges = spark.createDataFrame([(long, "水", "r"), ("含" + long, "水", "r")], "src string, dst string, type string")
    assert [r.src for r in drop_longer_edges(edges).collect()] == [long]
