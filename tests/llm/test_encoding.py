import random

import quarrymill.llm.encoding as E
from quarrymill.llm.encoding import CHANNELS, Decoder, corpus_frequencies, decode_cells, peel

CLEAN = ["阴凉处保存，远离火源", "库存不足5瓶，已催货", "Größe der Körner über 27 µm", "ÂGE DU LOT : 8 mois", "NÃO MISTURAR com água", "réactif très sensible à l’humidité",
         "樣品由臺灣合作方提供", "含水量偏高，是否返工??", "客户自提，运费到付", "sample only??", "czułość próbki ±9 %"]
# A text whose UTF-8 happens to be valid GBK, so that nothing is lost when it is read so.
WHOLE = next(c for c in CLEAN if c > "\u2fff" and c.encode().decode("gbk", "ignore").encode("gbk") == c.encode())
SCHEMA = "row_id long, v string, cell string, p string, d string, restored string"


def frame(spark, cells):
    return spark.createDataFrame([(i, c, "x", "y", "z", "w") for i, c in enumerate(cells)], SCHEMA)


def latin(text, times=1):
    for _ in range(times):
        text = "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in text.encode())
    return text


def test_channels(spark):
    damaged = {
        latin("阴凉处保存，远离火源"): "阴凉处保存，远离火源",
        latin("客户自提，运费到付", 2): "客户自提，运费到付",
        "阴凉处" + latin("保存，远离火源"): "阴凉处保存，远离火源",
        "阴凉处保存，远离火源".encode().decode("latin-1"): "阴凉处保存，远离火源",
        "库存不足5瓶，已催货".encode("gbk").decode("latin-1"): "库存不足5瓶，已催货",
        "含水量偏高，是否返工??".encode("gbk").decode("big5"): "含水量偏高，是否返工??",
        WHOLE.encode().decode("gbk"): WHOLE,
        "Größe der Körner über 27 µm".encode().decode("latin-1"): "Größe der Körner über 27 µm",
        "阴凉处保存，远离火源".encode("gbk").decode("utf-8", "replace"): "",
        "阴凉处保存，远离火源".encode("gbk").decode("utf-8", "replace").encode().decode("gbk", "replace"): "",
        "阴凉处保".encode().decode("gbk", "replace") + "�": "",
    }
    df = frame(spark, CLEAN * 30 + list(damaged))
    got = {r.row_id: r.restored for r in decode_cells(df, ["v"]).collect()}
    base = len(CLEAN) * 30
    assert not [CLEAN[i % len(CLEAN)] for i in got if i < base]
    assert [(d, got.get(base + i)) for i, d in enumerate(damaged)] == list(damaged.items())


def test_lost_bytes_are_guessed(spark):
    df = frame(spark, CLEAN * 30)
    decoder = Decoder(corpus_frequencies(df, ["v"]))
    text = "阴凉处保存，远离火源"
    garbled, restored, guess = decoder.decode(text.encode().decode("gbk", "replace").replace("�", "�"))
    assert garbled and (restored == "" or restored == text) and guess == text


def test_edges(spark):
    assert decode_cells(frame(spark, [None, "", " ", "plain"]), ["v"]).count() == 0
    assert decode_cells(spark.createDataFrame([], SCHEMA), ["v"]).count() == 0
    long = latin("阴凉处保存，远离火源" * 300)
    rows = decode_cells(frame(spark, [*CLEAN * 5, long, long]), ["v"]).collect()
    assert [r.restored for r in rows] == ["阴凉处保存，远离火源" * 300] * 2
    assert peel("Ã©tÃ© NÃO") == "été NÃO"


def test_channels_open_whatever_the_corpus_holds(spark):
    """Clean copies at most twice the garbled ones: no character is much more frequent than its garbled form."""
    text = "".join(map(chr, range(0x4E00, 0x5200)))
    text = "".join(c for c in text if c.encode("gb2312", "ignore") and c.encode("gbk").decode("big5", "ignore") and c not in "".join(CLEAN))[:120]
    damaged = text.encode("gbk").decode("big5")
    df = frame(spark, CLEAN * 30 + [text] * 30 + [damaged] * 18)
    got = {r.row_id: r.restored for r in decode_cells(df, ["v"]).collect()}
    base = len(CLEAN) * 30 + 30
    assert got == {base + i: text for i in range(18)}
    assert {"gbk-as-big5", "utf8-as-gbk"} <= {c[0] for c in Decoder(corpus_frequencies(frame(spark, ["plain"]), ["v"])).channels(damaged + WHOLE.encode().decode("gbk"))}


def test_channels_left_out_are_not_on_the_best_path(spark):
    """The bound on what a channel may gain against the search through all channels."""
    decoder = Decoder(corpus_frequencies(frame(spark, CLEAN * 30), ["v"]))
    r = random.Random(5)
    ways = [("utf-8", "gbk"), ("utf-8", "big5"), ("gbk", "big5"), ("big5", "gbk"), ("gbk", "latin-1"), ("utf-8", "latin-1"), ("latin-1", "gbk"), ("gbk", "utf-8")]
    left_out = 0
    for _ in range(1500):
        text = r.choice(CLEAN)
        a, b = sorted(r.sample(range(len(text) + 1), 2))
        written, read = r.choice(ways)
        cell = r.choice([text, text[:a] + text[a:b].encode(written, "ignore").decode(read, "ignore") + text[b:]])
        opened = decoder.channels(cell)
        left_out += len(CHANNELS) - len(opened)
        all_of_them = decoder.best(cell, CHANNELS) if not cell.isascii() else (cell, False, 0.0)
        if all_of_them[1]:
            assert decoder.best(cell, opened)[::2] == all_of_them[::2], cell
        else:
            assert not decoder.decode(cell)[0] or peel(cell) != cell, cell
    assert left_out > 1500


def test_unseen_characters_and_big5(spark):
    df = frame(spark, CLEAN * 30)
    decoder = Decoder(corpus_frequencies(df, ["v"]))
    assert decoder.decode("饕餮魑魅魍魉".encode().decode("gbk")) == (True, "饕餮魑魅魍魉", "饕餮魑魅魍魉")
    text = "".join(c for c in "樣品由臺灣合作方提供" if (got := c.encode("big5").decode("gbk", "ignore")) and got.encode("gbk") == c.encode("big5"))
    assert len(text) > 5 and decoder.decode(text.encode("big5").decode("gbk")) == (True, text, text)


def test_many_garbled_cells_are_joined(spark, monkeypatch):
    monkeypatch.setattr(E, "MAX_BROADCAST_CHARACTERS", 0)
    cell = latin("阴凉处保存，远离火源")
    got = decode_cells(frame(spark, [*CLEAN, cell, cell, None]), ["v"]).collect()
    assert sorted((r.row_id, r.restored) for r in got) == [(len(CLEAN) + i, "阴凉处保存，远离火源") for i in range(2)]
