import json
import random

import pytest

from quarrymill.operators.packed import explode_packed

SCHEMA = "row_id long, v string, field_name string, item string, pos int, cell string"


def items(spark, cells, **options):
    df = spark.createDataFrame([(i, c, "x", "y", 1, "z") for i, c in enumerate(cells)], SCHEMA)
    out = {}
    for r in sorted(explode_packed(df, "t", ["v"], **options).collect(), key=lambda r: (r.row_id, r.pos)):
        assert r.pos == len(out.setdefault(r.row_id, [])) + 1
        out[r.row_id].append(r.item)
    return [out.get(i, []) for i in range(len(cells))]


CASES = [
    ('["A", "B \\"x\\" C", "D, E"]', ["A", 'B "x" C', "D, E"]),
    ("['DOS/V 7', 'B', 'B']", ["DOS/V 7", "B", "B"]),
    ('"A";"B ""x"" C"', ["A", 'B "x" C']),
    ('{"usb": "PS/2", "video_2": "I/O shield"}', ["PS/2", "I/O shield"]),
    ("{'a': 'X', 'b': 'Y'}", ["X", "Y"]),
    ("A, B (1, 2), C", ["A", "B (1, 2)", "C"]),
    ("微量元素（Zn, Se）、多糖", ["微量元素（Zn, Se）", "多糖"]),
    ("1,8-桉叶素,5,7,4'-三羟基黄酮,芦丁", ["1,8-桉叶素", "5,7,4'-三羟基黄酮", "芦丁"]),
    ("N,N-二乙基胺; (+)-儿茶素", ["N,N-二乙基胺", "(+)-儿茶素"]),
    ("NAS/ATX/PC/104/S/PDIF", ["NAS", "ATX", "PC/104", "S/PDIF"]),
    ("- PC/104\n* S/PDIF\n- M.2 Key-E", ["PC/104", "S/PDIF", "M.2 Key-E"]),
    ("1. 2 x HDMI 2.0 2. I/O shield 3. PS/2 4. DOS/V 7", ["2 x HDMI 2.0", "I/O shield", "PS/2", "DOS/V 7"]),
    ("M.2 Key-E/USB-C/2 x A", ["M.2 Key-E", "USB-C", "2 x A"]),
    ("A + +DOS/V 7 +", ["A", "DOS/V 7"]),
    ("1. A 8.1\n2. B 3. C", ["A 8.1", "B", "C"]),
    ("①A②B③C", ["A", "B", "C"]),
    ("(1)A；(2)B", ["A", "B"]),
    ("- A\n* B\n• C", ["A", "B", "C"]),
    ("A;; ;B;", ["A", "B"]),
    ("{A + B}", ["A", "B"]),
    ("DVI-D, dual link; OS 8.1, 64-bit", ["DVI-D, dual link", "OS 8.1, 64-bit"]),
    ("DVI-D, dual link\neSATA\nlan", ["DVI-D, dual link", "eSATA", "lan"]),
    ('"DVI-D, dual link"', ["DVI-D, dual link"]),
    ("　A、B ", ["A", "B"]),
    ("A0;B", ["A0", "B"]),
    (None, []), ("", []), (" ", []), ("N/A", []), ("[待补全]", []), ("[]", []),
]


def test_cells(spark):
    got = items(spark, [c for c, _ in CASES])
    assert [(c, g) for (c, _), g in zip(CASES, got, strict=True)] == CASES


def test_lower_case_values(spark):
    assert items(spark, ["芦丁, borvelic acid"], qualifiers=False) == [["芦丁", "borvelic acid"]]


def test_empty_table_and_long_cell(spark):
    assert explode_packed(spark.createDataFrame([], SCHEMA), "t", ["v"]).count() == 0
    long = ";".join(f"value {i}" for i in range(20000))
    assert len(items(spark, [long])[0]) == 20000


@pytest.mark.parametrize("seed", range(3))
def test_round_trip(spark, seed):
    """Lists written in several notations come back whole."""
    r = random.Random(seed)
    words = ["Alpha OS", "I/O header", "Mini \"cube\" PC", "Rack (1U, 2U)", "DVI-D, dual link", "工控机", "x86, 64-bit", "Q 13+", "a;b|c", "it's"]
    cells, wanted = [], []
    for _ in range(60):
        values = [r.choice(words) for _ in range(r.randint(1, 6))]
        style = r.choice(["json", "csv"])
        joiner = r.choice([";", "; ", "|", ","])
        cells.append(json.dumps(values) if style == "json" else joiner.join('"' + v.replace('"', '""') + '"' for v in values))
        wanted.append(values)
    assert items(spark, cells) == wanted


def test_cells_of_a_megabyte(spark):
    """No cell is so long, so deep or so broken that it ends the JVM."""
    n = 300_000
    cells = [
        "A (" + "b, " * n + "c)", "(" * n, "(a" * n, "A (" + "(b), " * n + ")", '"' + "a, " * n + '"', '"' + "a, " * n, '["' + 'a\\", ' * n + '"]',
        "'" + "a, " * n + "'", "（" + "b，" * n + "）", "1," * n + "2-x", "1," * n, "A, bb" + " c" * n, "A/" * n, "“" + "a, " * n + "”",
    ]
    got = items(spark, cells)
    assert [len(g) for g in got[:5]] == [1, 1, 1, 1, 1]
    assert [len(g) for g in got[7:10]] == [1, 1, 1] and got[9] == [cells[9]]
    assert len(got[10]) == n and got[11] == [cells[11]] and len(got[12]) == n // 2 and len(got[13]) == 1
