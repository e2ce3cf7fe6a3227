import random

from quarrymill.llm.canonical import MOST_EDITS, THRESHOLD, Entry, Reference, edit_distance, map_to_reference, words_fit
from quarrymill.llm.glossary import glossary_of

REF = [(1, "manufacturer", "Norvexa", "诺维萨", "NVX"), (2, "manufacturer", "Corvane", "科凡", "CRVN"), (3, "manufacturer", "Corvanta", "科凡达", "CRVT"),
       (10, "component_type", "Processor", "处理器", None), (11, "component_type", "Keyboard", "键盘", None), (12, "component_type", "Power Supply", "电源", None),
       (13, "component_type", "Mouse", "鼠标", None)]
SCHEMA = "row_id long, manufacturer string, component_type string, value string, field_name string, ref_id string"


def mapped(spark, field, values):
    ref = spark.createDataFrame(REF, "ref_id int, list_name string, canonical_name string, name_zh string, short_code string")
    rows = [(i, v if field == "manufacturer" else None, v if field != "manufacturer" else None, "a", "b", "c") for i, v in enumerate(values)]
    out = map_to_reference([(spark.createDataFrame(rows, SCHEMA), "t", ["manufacturer", "component_type"])], ref, glossary=glossary_of(ref))
    got = {r.row_id: r.ref_id for r in out.collect()}
    return [got.get(i) for i in range(len(values))]


def test_makers(spark):
    values = ["norvexa Inc.", "NVX", "[nvx]", "诺维萨科技股份有限公司", "诺维萨（Norvexa）", "N O R V E X A", "Nor.vexa", "Ｎｏｒｖｅｘａ", "Nórvéxa", "Norvxa", "品牌 NORVEXA", "Corvane™", "科凡达 - corvanta", "Corvantaa", "Corvant",
              "Zubrowin Ltd", "OEM", "", "N/A", None, "Norvexa"]
    assert mapped(spark, "manufacturer", values) == [1] * 11 + [2, 3, 3, -1, -1, -1, None, None, None, None]


def test_components(spark):
    values = ["CPU", "desktop CPU (new)", "desktopCPU", "Computer Hardware > 处理器", "机械键盘", "机械键盘类", "Pocessor", "power supply unit", "Pet Supplies", "鼠年纪念币", "misc", "游戏鼠标", "kbd（键盘）"]
    assert mapped(spark, "component_type", values) == [10, 10, 10, 10, 11, 11, 10, 12, -1, -1, -1, 13, 11]


def test_learned_names(spark):
    """A name outside the glossary is learned from values that state it beside an entry's name."""
    assert mapped(spark, "component_type", ["thinker (处理器)", "thinker / Processor", "thinker"]) == [10, 10, 10]


def test_large_mappings_are_joined(spark, monkeypatch):
    import quarrymill.llm.canonical as C

    values = ["norvexa Inc.", "NVX", "NVX", "Zubrowin"]
    want = mapped(spark, "manufacturer", values)
    monkeypatch.setattr(C, "MAX_BROADCAST_CHARACTERS", 0)
    assert mapped(spark, "manufacturer", values) == want == [1, 1, 1, -1]


def test_edges(spark):
    assert mapped(spark, "manufacturer", []) == []
    assert mapped(spark, "manufacturer", ["x" * 100_000, "norvexa", "norvexa"]) == [-1, 1, 1]
    assert edit_distance("abcd", "abdc", 2) == 1 and edit_distance("a", "abcdef", 2) == 3
    assert words_fit("Powr Suply", "Power Supply") and not words_fit("Pet Supplies", "Power Supply")


def test_learned_spellings_crowd_nothing_out():
    """Names with better cosines, but too many edits away, don't hide the entry that is one edit away."""
    learned = {f"nrvexa{i}nrvexa": 2 for i in range(10)}
    reference = Reference([Entry(1, ["norvexa"], "Norvexa"), Entry(2, ["corvane"], "Corvane")], learned)
    assert reference.match("nrvexa") == 1


def test_two_entries_are_none(spark):
    assert mapped(spark, "manufacturer", ["Norvexa / Corvane", "Norvexa (诺维萨)", "Corvan"]) == [-1, 1, 2]


def test_nothing_is_accepted_below_the_threshold():
    """The cosine alone accepts; every name that may pass the check is retrieved, as by brute force."""
    r = random.Random(3)
    names = ["".join(r.choice("abcdeilmnorst") for _ in range(r.randint(3, 10))) for _ in range(120)]
    reference = Reference([Entry(i, [n], n) for i, n in enumerate(dict.fromkeys(names))])

    def cosine(a, b):
        x, y = reference._weights(a), reference._weights(b)
        return sum(w * y.get(g, 0.0) for g, w in x.items())

    for name in names:
        at = r.randrange(len(name))
        value = name[:at] + r.choice("xyz") + name[at + r.randint(0, 1) :]
        for least in (0.05, THRESHOLD, 0.5):
            found = reference.candidates(value, set(), least)
            near = {n: cosine(value, n) for n in reference.names if abs(len(n) - len(value)) <= MOST_EDITS}
            assert {n for n, s in near.items() if s >= least} == set(found)
            assert all(abs(near[n] - s) < 1e-9 for n, s in found.items())
        got = reference.match(value)
        if got >= 0:
            assert max(cosine(value, n) for n in reference.names if reference.exact[n] == got) >= THRESHOLD
        assert reference.match(value, threshold=1.01) == -1


def test_all_learned_names_count(spark):
    names = [*(f"n{i:05d}" for i in range(20_000)), "zzword"]
    assert mapped(spark, "component_type", [*(f"{n} (Processor)" for n in names), "zzword"])[-1] == 10
