import random

import re
import unicodedata

import numpy as np

from quarrymill.llm.subjects import Bags, assign_subjects, structure, train_subjects

WORDS = {"law": "court appeal statute judge licence clause verdict", "sport": "match referee striker league goal stadium coach", "software": "module compiler thread branch library query commit"}
GENERAL = ["The rest of the day passed quietly.", "Readers sent several letters.", "It is not clear who wrote this."]


def sentence(r, subject):
    return "The " + " ".join(r.sample(WORDS[subject].split(), 4)) + "."


def corpus(n, seed):
    r, rows, truth = random.Random(seed), [], {}
    for i in range(n):
        own = r.sample(list(WORDS), r.choice([1, 1, 2]))
        parts = []
        for s in own:
            parts += [sentence(r, s) for _ in range(r.randint(3, 6))]
        if r.random() < 0.4:
            parts.insert(r.randint(0, len(parts)), sentence(r, r.choice([s for s in WORDS if s not in own])))
        parts.insert(r.randint(0, len(parts)), r.choice(GENERAL))
        rows.append((i, " ".join(parts), r.choice(["x", "y", None]), "clash", "clash"))
        truth[i] = set(own)
    return rows, truth


def frames(spark, rows, labels):
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string, subject string, slot string")
    areas = spark.createDataFrame([(s, s.title(), None, WORDS[s].split()[0]) for s in WORDS], "subject string, name_en string, name_zh string, description string")
    return documents, spark.createDataFrame(labels, "doc_id long, subject string, annotator string"), areas


def test_held_out(spark):
    rows, truth = corpus(400, 1)
    r = random.Random(2)
    labels = [(i, s, "a") for i in range(120) for s in truth[i] if r.random() > 0.05] + [(3, None, "a"), (4, "law", "b"), (4, "law", "c")]
    documents, labels, areas = frames(spark, rows, labels)
    found = {}
    for x in assign_subjects(documents, train_subjects(documents, labels, areas)).collect():
        assert x.subject not in found.setdefault(x.doc_id, set())
        found[x.doc_id].add(x.subject)
    right = sum(len(found.get(i, set()) & truth[i]) for i in range(120, 400))
    assert right / sum(len(truth[i]) for i in range(120, 400)) > 0.95
    assert right / sum(len(found.get(i, ())) for i in range(120, 400)) > 0.95


def test_edges(spark):
    rows, truth = corpus(60, 3)
    rows += [(900, None, None, "c", "c"), (901, "", "x", "c", "c"), (902, " \n ", "x", "c", "c"), (903, " ".join(sentence(random.Random(i), "law") for i in range(20_000)), "x", "c", "c")]
    documents, labels, areas = frames(spark, rows, [(i, s, "a") for i in range(60) for s in truth[i]])
    model = train_subjects(documents, labels, areas)
    found = [(x.doc_id, x.subject) for x in assign_subjects(documents, model).collect() if x.doc_id >= 900]
    assert found == [(903, "law")]
    assert assign_subjects(documents.limit(0), model).count() == 0
    unlabelled = train_subjects(documents, labels.limit(0), areas)
    assert assign_subjects(documents, unlabelled).count() >= 0


def sentences(text):
    """Sentences one by one, as the definition has them."""
    plain = re.sub(r"(?<=[A-Za-z,])\r?\n(?=[a-z])", " ", unicodedata.normalize("NFKC", text)).lower()
    return [s for s in (p.strip() for p in re.split(r"[。！？!?；\n\r]+|(?<=\S)\.(?=\s|$)", plain)) if s]


def words(sentence):
    out = []
    for run in re.findall(r"[a-z][a-z'’-]+|[一-鿿]+", sentence):
        out += [run] if run[0] <= "z" else [run[i : i + 2] for i in range(len(run) - 1)]
    return out


def test_sentences():
    assert sentences("One two.\nThree 3.5 four! 五六。七八\r\nwrapped,\nline") == ["one two", "three 3.5 four", "五六", "七八", "wrapped, line"]


def test_bags_against_one_by_one():
    r = random.Random(8)
    parts = ["word", "It's", "a", "B", "co-op", "-x", "--", "五六七", "中", " ", "  ", ".", ". ", "。", "！", "\n", "\r\n", ",\n", "3.5", "ＡＢ", "é", "\x85", "😀", "...", "’tis", "z\nq", "Q,\r\nr"]
    texts = [None, "", " ", ".", "\n", *("".join(r.choice(parts) for _ in range(r.randint(1, 30))) for _ in range(400))]
    bags = Bags.of(texts)
    slot_of, want = {}, []
    for d, t in enumerate(texts):
        want += [(d, sorted(found)) for s in (sentences(t) if t else []) if (found := words(s))]
    assert bags.documents.tolist() == [d for d, _ in want]
    for i, (_, terms) in enumerate(want):
        for t in set(terms):
            slot_of.setdefault(t, int(Bags.of([t + " " if t[0] <= "z" else t]).slots[0]))
        assert sorted(bags.slots[bags.bounds[i] : bags.bounds[i + 1]].tolist()) == sorted(slot_of[t] for t in terms), texts[want[i][0]]


def test_runs():
    """Sentences on a subject in a row, general remarks (the last class) left out."""
    best, documents = np.array([0, 2, 0, 1, 0, 0, 2, 0]), np.array([0, 0, 0, 0, 0, 1, 1, 3])
    counts, features = structure(np.eye(3)[best], documents, 4)
    assert counts.tolist() == [[3, 1], [1, 0], [0, 0], [1, 0]]
    assert (features[:, :, 4] * 4).tolist() == [[2, 1], [1, 0], [0, 0], [1, 0]]
