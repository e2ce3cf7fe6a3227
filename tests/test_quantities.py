from quarrymill.operators.quantities import explode_quantities

SCHEMA = "row_id long, v string, unit string, number string, pos int, factor double"
CASES = [
    ("12.5 W", [("mW", 12500)]),
    ("Standby 248650 mW; active 767\xa0瓦", [("mW", 248650), ("mW", 767000)]),
    ("43.7-95.3W", [("mW", 43700), ("mW", 95300)]),
    ("97至446.4 瓦", [("mW", 97000), ("mW", 446400)]),
    ("{'sleep': '1,881 mW', 'peak': '8.1\\xa0w'}", [("mW", 1881), ("mW", 8100)]),
    ("24小时连续运行功耗 416,3 w", [("mW", 416300)]),
    ("8.5 W at 230 V", [("mW", 8500)]),
    ("17.4W±5%", [("mW", 17400)]),
    ("Power [W]: 34", [("mW", 34000)]),
    ("单位：w，数值 266.6", [("mW", 266600)]),
    ("12V DC, 35A", []),
    ("6.51 X 1.71 X 0.45 in (16.5 X 4.3 X 1.1 cm)", [("um", x) for x in (165354, 43434, 11430, 165000, 43000, 11000)]),
    ("143.3 mmx37.6 mmx12.6 millimetres", [("um", 143300), ("um", 37600), ("um", 12600)]),
    ("26 1/8 in", [("um", 663575)]),
    ("1/2 inch", [("um", 12700)]),
    ("31 X 8 X 3.5（cm）", [("um", 310000), ("um", 80000), ("um", 35000)]),
    ("(W×D×H, inches) 9.78 X 1.59 X 0,39", [("um", 248412), ("um", 40386), ("um", 9906)]),
    ("Dimensions in mm: 56.7x41.1x24.6", [("um", 56700), ("um", 41100), ("um", 24600)]),
    ("W 679,3 mm, D 22.02\xa0英寸", [("um", 679300), ("um", 559308)]),
    ("632 x 315 x 169", []),
    ('{"boxed": "2 cm", "gross": "10,162 grams"}', [("um", 20000), ("mg", 10162000)]),
    ("0.3 斤; 2 lb; 8 oz", [("mg", 150000), ("mg", 907185), ("mg", 226796)]),
    ("以KG计 0,15", [("mg", 150000)]),
    ("５４２４ｇｒ", [("mg", 5424000)]),
    ("in MHz: base 3,200, boost 3700", [("kHz", 3200000), ("kHz", 3700000)]),
    ("频率(GHz)：4.1 / 5.9", [("kHz", 4100000), ("kHz", 5900000)]),
    ("3,800,000 kHz", [("kHz", 3800000)]),
    ("8 cores @ 2.3GHz", [("kHz", 2300000)]),
    ("5 MW, 3 W", [("mW", 5_000_000_000), ("mW", 3000)]),
    ("5 mW; 0.002 THz", [("mW", 5), ("kHz", 2_000_000)]),
    ("700 nm, 2 yd, 1 km, 9 μg", [("um", 1), ("um", 1828800), ("um", 1_000_000_000), ("mg", 0)]),
    ("torque 5 Nm", []),
    ("1/0 W", [("mW", None)]), ("99999999999999999999 kW", [("mW", None)]),
    ("1 x 2 x 3, 4 W", [("mW", 4000)]),
    ("32 cores / 16 threads", []), (None, []), ("", []), ("N/A", []),
]


def found(spark, cells, **options):
    df = spark.createDataFrame([(i, c, "W", "7", 9, 1.0) for i, c in enumerate(cells)], SCHEMA)
    out = {}
    for r in sorted(explode_quantities(df, "t", ["v"], **options).collect(), key=lambda r: (r.row_id, r.pos)):
        assert r.pos == len(out.setdefault(r.row_id, [])) + 1
        out[r.row_id].append((r.base_unit, r.amount))
    return [out.get(i, []) for i in range(len(cells))]


def test_cells(spark):
    got = found(spark, [c for c, _ in CASES])
    assert [(c, g) for (c, _), g in zip(CASES, got, strict=True)] == CASES


def test_unit_from_field_and_source(spark):
    assert found(spark, ["34", "3 kW", "a 5"], unit_fields={"v": "unit"}) == [[("mW", 34000)], [("mW", 3000000)], []]
    assert found(spark, ["34"], default_units={"v": "kg"}) == [[("mg", 34000000)]]


def test_empty_and_long(spark):
    assert explode_quantities(spark.createDataFrame([], SCHEMA), "t", ["v"]).count() == 0
    assert len(found(spark, ["; ".join(f"{i} W" for i in range(1, 5001))])[0]) == 5000


def test_every_unit_found_has_an_alias(spark):
    """The join with the aliases drops nothing, so positions have no gaps."""
    from quarrymill.vocab import UNIT_ALIASES

    names = [(base, a) for (base, _), group in UNIT_ALIASES.items() for a in group]
    got = found(spark, [f"1 {a}, 7 W" for _, a in names])
    assert [[b for b, _ in g] for g in got] == [[base, "mW"] for base, _ in names]


def test_cells_of_a_megabyte(spark):
    """A series as long as the cell neither ends the JVM nor is read again from each of its numbers."""
    n = 200_000
    assert [len(x) for x in found(spark, ["1 x " * n + "2 mm", "1 x " * n, "in mm: " + "3, " * n, "1/2 " * n, "W" * 5 * n, "(" * 5 * n + "1 W"])] == [n + 1, 0, n, 0, 0, 1]
