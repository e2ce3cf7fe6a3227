"""Text that was read with the wrong character encoding: find the cells and restore them.

Method: noisy-channel decoding. A channel is a pair of encodings (read as, written in). The
characters of a cell are turned back into bytes, a lost byte being a wildcard; a lattice holds
every way to read stretches of the cell through a channel or as they stand; Viterbi search under
the corpus frequencies of characters and character pairs picks the best path. ``restored`` is given
only if no byte was lost: with a wildcard in it a cell alone never determines the text, so the
best path is then no more than a guess.

Scale: frequencies are counted once over all cells with partial counts per partition. What is
sent to the driver and broadcast is bounded by construction: at most one number per Unicode
character and ``PAIR_SLOTS`` hashed pair counts. Every distinct cell is decoded once, and the garbled
ones go back to the rows by a broadcast behind a check of their size, beyond it by a salted join.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.session import cut_lineage

PAIR_SLOTS = 1 << 20
LOST = "�"
MAX_BROADCAST_CHARACTERS = 8_000_000
SALTS = 16
# The most that a preceding character can change in the score of a character.
CONTEXT = 0.5 * math.log(1.05 / 0.05)
INNER_LATIN = 5.0  # nats for a Chinese character inside a Latin word

# Channels: name, read as, written in, cost in nats of entering it. A stretch that is valid UTF-8
# is strong evidence of its own, so those channels are cheap to enter.
CHANNELS = (
    ("utf8-as-latin", "latin", "utf-8", 2.0),
    ("utf8-as-gbk", "gbk", "utf-8", 4.0),
    ("utf8-as-big5", "big5", "utf-8", 4.0),
    ("gbk-as-latin", "latin", "gbk", 4.0),
    ("gbk-as-big5", "big5", "gbk", 8.0),
    ("big5-as-gbk", "gbk", "big5", 8.0),
    ("latin-as-gbk", "gbk", "latin", 4.0),
    ("gbk-as-utf8", "utf-8", "gbk", 8.0),
)


def _slots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    mixed = left.astype(np.uint64) * np.uint64(0x9E3779B1) + right.astype(np.uint64) * np.uint64(0x85EBCA77)
    return ((mixed ^ (mixed >> np.uint64(15))) % np.uint64(PAIR_SLOTS)).astype(np.int64)


@dataclass
class Frequencies:
    """Counts of characters and, hashed, of character pairs over a corpus."""

    single: dict[str, int]
    pairs: np.ndarray
    total: int = field(init=False)

    def __post_init__(self) -> None:
        self.total = max(1, sum(self.single.values()))
        self.logs = {c: math.log(n / self.total + 1e-9) for c, n in self.single.items()}
        self.unseen = math.log(1e-9)
        self.known: dict[str, float] = {}

    def log_p(self, before: str, char: str) -> float:
        found = self.known.get(before + char)
        if found is None:
            if len(self.known) > 1 << 19:
                self.known.clear()
            found = self.known[before + char] = self._log_p(before, char)
        return found

    def _log_p(self, before: str, char: str) -> float:
        n = self.single.get(char, 0)
        # Damaged phrases recur as well and predict their own characters perfectly, so the pair
        # only adds a bounded bonus to the frequency of the character.
        follows = 0.0
        m = self.single.get(before, 0)
        if m and n:
            a, b = ord(before) * 0x9E3779B1, ord(char) * 0x85EBCA77
            mixed = (a + b) & 0xFFFFFFFFFFFFFFFF
            pair = int(self.pairs[(mixed ^ (mixed >> 15)) % PAIR_SLOTS])
            follows = min(pair, n, m) / m
        return self.logs.get(char, self.unseen) + 0.5 * math.log((0.05 + follows) / 1.05)


def corpus_frequencies(df: DataFrame, fields: Sequence[str]) -> Frequencies:
    """Counts over every cell of ``fields``; the result is bounded by the character set and ``PAIR_SLOTS``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single = np.zeros(0x110000, np.int64)
        pairs = np.zeros(PAIR_SLOTS, np.int64)
        for batch in batches:
            text = "\n".join("\n".join(t for t in c.to_pylist() if t) for c in batch.columns)
            codes = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
            if len(codes):
                single += np.bincount(codes, minlength=len(single))
                pairs += np.bincount(_slots(codes[:-1], codes[1:]), minlength=PAIR_SLOTS)
        for kind, counts in ((0, single), (1, pairs)):
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int64)), pa.array(counts[at])], ["kind", "slot", "n"]
            )

    counts = df.select(*[F.col(f"`{f}`").cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    rows = counts.mapInArrow(count, "kind int, slot long, n long").groupBy("kind", "slot").agg(F.sum("n").alias("n")).toPandas()
    pairs = np.zeros(PAIR_SLOTS, np.int64)
    hashed = rows[rows.kind == 1]
    pairs[hashed.slot.to_numpy()] = hashed.n.to_numpy()
    plain = rows[(rows.kind == 0) & (rows.slot != 10)]
    return Frequencies({chr(c): int(n) for c, n in zip(plain.slot, plain.n, strict=True)}, pairs)


def _latin_bytes() -> dict[str, bytes]:
    """Western single-byte reading: code page 1252, with the five holes read as control characters."""
    table = {chr(i): bytes([i]) for i in range(256)}
    for i in range(0x80, 0xA0):
        try:
            table[bytes([i]).decode("cp1252")] = bytes([i])
        except UnicodeDecodeError:
            pass
    return table


LATIN = _latin_bytes()
LATIN_CHARS = {data[0]: char for char, data in LATIN.items()}
_LEADS = re.compile("[\u00c2-\u00f4]")
# Encodings of one byte below 0x80 and two bytes beyond, with the code page that stands for them.
DOUBLE = {"gbk": "gbk", "big5": "cp950"}


def peel(text: str) -> str:
    """Every stretch that is UTF-8 read as a Western single-byte encoding, read rightly once."""
    out, i, n = [], 0, len(text)
    raw = [LATIN.get(c) for c in text]
    while i < n:
        head = raw[i][0] if raw[i] else 0
        size = 2 if 0xC2 <= head < 0xE0 else 3 if 0xE0 <= head < 0xF0 else 4 if 0xF0 <= head < 0xF5 else 1
        if size > 1 and i + size <= n and all(raw[i : i + size]):
            try:
                out.append(b"".join(raw[i : i + size]).decode())
                i += size
                continue
            except UnicodeDecodeError:
                pass
        out.append(text[i])
        i += 1
    return "".join(out)


def _bytes_of(char: str, encoding: str) -> bytes | None:
    if encoding == "latin":
        return LATIN.get(char)
    try:
        return char.encode("cp950" if encoding == "big5" else encoding)
    except UnicodeEncodeError:
        if encoding == "big5":
            try:
                return char.encode("big5hkscs")
            except UnicodeEncodeError:
                return None
        return None


class Decoder:
    """Viterbi search over the lattice of one cell at a time. Built once per Python worker."""

    def __init__(self, frequencies: Frequencies, rounds: int = 3) -> None:
        self.frequencies, self.rounds = frequencies, rounds
        self.cache: dict[tuple[str, str], bytes | None] = {}
        self.masks: dict[str, dict[tuple, list[str]]] = {}
        self.gains: dict[tuple[str, str], float] = {}
        self.values: dict[str, dict[bytes, float]] = {"utf-8": {}, "gbk": {}, "big5": {}}

    def channels(self, cell: str) -> list[tuple]:
        """The channels that the best path may use, whatever the corpus holds; the search weighs their readings."""
        return [] if cell.isascii() else [c for c in CHANNELS if self._opens(cell, c)]

    def _opens(self, cell: str, channel: tuple) -> bool:
        """Whether the best path may go through the channel. Never false for one that it goes through.

        Without lost bytes no stretch of a channel pays that can't gain what entering it costs even with the best
        neighbours; with them, a channel is open if its first byte can be read.
        """
        name, read_as, written_in, cost = channel
        if name == "utf8-as-latin":
            return _LEADS.search(cell) is not None and peel(cell) != cell
        if LOST not in cell:
            least = cost - CONTEXT - 1e-6
            if read_as in DOUBLE and written_in != "utf-8":
                return self._may_gain(cell, name, read_as, written_in) >= least
            return self._may_gain_across(cell, read_as, written_in, least)
        if read_as != "latin":
            return True
        data: list = []
        starts = []
        for char in cell:
            starts.append(len(data))
            data.extend(self._encoded(char, read_as) or ["barrier"])
        return any(data[i] != "barrier" and data[i] >= 0x80 and self._next(data, i, written_in) for i in starts)

    def _may_gain(self, cell: str, name: str, read_as: str, written_in: str) -> float:
        """The most that a stretch of the cell can gain by the channel, its cost left out."""
        best = run = 0.0
        plain = False
        gains, last = self.gains, len(cell) - 1
        for i, char in enumerate(cell):
            if char < "\x80":
                # Read as itself; only the character before it may differ.
                gain = 0.0 if plain else CONTEXT
                plain = True
            else:
                plain = False
                gain = gains.get((name, char))
                if gain is None:
                    gain = gains[name, char] = self._gain(char, read_as, written_in)
                if i < last and char > "\u2fff" and cell[i + 1].isascii() and cell[i + 1].isalpha():
                    gain += INNER_LATIN
            run = run + gain if run > 0.0 else gain
            if run > best:
                best = run
        return best

    def _may_gain_across(self, cell: str, read_as: str, written_in: str, least: float) -> bool:
        """Whether a stretch can gain ``least`` where the characters of the channel lie across those of the cell."""
        logs, unseen, values = self.frequencies.logs, self.frequencies.unseen, self.values[written_in]
        start, n = 0, len(cell)
        while start < n:
            data, starts, clean, plain = bytearray(), [], [0.0], False
            at = start
            while at < n and (raw := self._encoded(cell[at], read_as)) is not None:
                char = cell[at]
                starts.append(len(data))
                data += raw
                low = logs.get(char, unseen)
                if not (plain and char < "\x80"):
                    low -= CONTEXT
                if char > "\u2fff" and at + 1 < n and cell[at + 1].isascii() and cell[at + 1].isalpha():
                    low -= INNER_LATIN
                clean.append(clean[-1] + low)
                plain = char < "\x80"
                at += 1
            start = at + 1
            size = len(data)
            starts.append(size)
            run = bytes(data)
            score = [-math.inf] * (size + 4)
            for i, first in enumerate(starts):
                if score[first] - clean[i] >= least:
                    return True
                if first < size and run[first] >= 0x80 and clean[i] > score[first]:
                    score[first] = clean[i]
                for j in range(first, starts[i + 1] if first < size else first):
                    got = score[j]
                    if got == -math.inf:
                        continue
                    head = run[j]
                    width = 1 if head < 0x80 else 2 if written_in != "utf-8" or 0xC2 <= head < 0xE0 else 3 if head < 0xF0 else 4
                    part = run[j : j + width]
                    value = values.get(part)
                    if value is None:
                        value = values[part] = self._value(part, written_in)
                    if got + value > score[j + width]:
                        score[j + width] = got + value
        return False

    def _value(self, part: bytes, encoding: str) -> float:
        """The most that a character of a channel can score."""
        try:
            char = part.decode(DOUBLE.get(encoding, encoding))
        except UnicodeDecodeError:
            return -math.inf
        if len(char) != 1:
            return -math.inf
        # What follows a character that ends in a byte below 0x80 has another one before it than in the cell.
        return self.frequencies.logs.get(char, self.frequencies.unseen) + (CONTEXT if len(part) > 1 and part[-1] < 0x80 else 0.0)

    def _gain(self, char: str, read_as: str, written_in: str) -> float:
        """The most that one character can gain by being read anew."""
        raw = self._encoded(char, read_as)
        if raw is None:
            return -math.inf
        if len(raw) != 2:
            return math.inf
        score, at = 0.0, 0
        logs, unseen = self.frequencies.logs, self.frequencies.unseen
        while at < 2:
            found = self._next(list(raw), at, written_in)
            if not found:
                return -math.inf
            size, chars = found[0]
            score, at = score + logs.get(chars[0], unseen), at + size
        return score - logs.get(char, unseen) + CONTEXT

    def _encoded(self, char: str, encoding: str) -> bytes | None:
        key = (char, encoding)
        if key not in self.cache:
            self.cache[key] = _bytes_of(char, encoding)
        return self.cache[key]

    def _known(self, encoding: str, pattern: tuple) -> list[str]:
        """Characters of the corpus whose bytes fit a pattern with wildcards, the most frequent first."""
        if encoding not in self.masks:
            index = self.masks[encoding] = {}
            for char in sorted(self.frequencies.single, key=self.frequencies.logs.__getitem__, reverse=True):
                data = self._encoded(char, encoding)
                if not data or len(data) < 2 or char == LOST:
                    continue
                for mask in range(1, 1 << len(data)):
                    key = tuple(None if mask >> i & 1 else b for i, b in enumerate(data))
                    index.setdefault(key, []).append(char)
        return self.masks[encoding].get(pattern, [])

    def _next(self, data: list, at: int, encoding: str) -> list[tuple[int, Sequence[str]]]:
        """The characters that may start at a byte: (length in bytes, characters by falling frequency)."""
        head = data[at]
        if head is not None and head < 0x80:
            return [(1, chr(head))]
        if encoding == "latin":
            return [] if head in (None, "barrier") else [(1, LATIN_CHARS[head])]
        if encoding in DOUBLE:
            sizes = (2,)
        elif head is None:
            sizes = (3, 2)
        else:
            sizes = (2,) if 0xC2 <= head < 0xE0 else (3,) if head < 0xF0 else (4,)
        found: list[tuple[int, Sequence[str]]] = []
        for size in sizes:
            part = tuple(data[at : at + size])
            if len(part) < size or "barrier" in part:
                continue
            if None in part:
                chars = self._known(encoding, part)
                if chars:
                    found.append((size, chars))
            else:
                try:
                    char = bytes(part).decode(DOUBLE.get(encoding, encoding))
                except UnicodeDecodeError:
                    continue
                if len(char) == 1:
                    found.append((size, char))
        return found

    def best(self, cell: str, channels: Sequence[tuple]) -> tuple[str, bool, float]:
        """The best reading of the cell in one round, whether it uses a channel, and its score."""
        log_p, n = self.frequencies.log_p, len(cell)
        logs, unseen = self.frequencies.logs, self.frequencies.unseen
        streams = []
        for _, read_as, written_in, cost in channels:
            data: list = []
            starts = []
            high = False
            for char in cell:
                starts.append(len(data))
                if char == LOST and read_as != "latin":
                    data.append(None)
                    continue
                raw = self._encoded(char, read_as)
                if raw is None:
                    data.append("barrier")
                else:
                    data.extend(raw)
                    high = high or raw[0] >= 0x80
            starts.append(len(data))
            if high or None in data:
                streams.append((data, {b: i for i, b in enumerate(starts)}, starts, written_in, cost))
        # best[node] = (score, last character, previous node, emitted)
        clean: list = [None] * (n + 1)
        clean[0] = (0.0, "\n", None, "")
        inside: list[dict] = [{} for _ in streams]
        for i in range(n + 1):
            # Leave channels at this character boundary; steps within one go forward only.
            for k, (data, _, starts, _, _) in enumerate(streams):
                got = inside[k].get(starts[i])
                if got and (clean[i] is None or got[0] > clean[i][0]):
                    clean[i] = (got[0], got[1], ("in", k, starts[i]), "")
            here = clean[i]
            if i < n and here:
                char = cell[i]
                score = here[0] + (log_p(here[1], char) if char != LOST else -30.0)
                if char > "\u2fff" and i + 1 < n and cell[i + 1].isascii() and cell[i + 1].isalpha():
                    score -= INNER_LATIN  # a Chinese character hardly stands inside a Latin word
                if clean[i + 1] is None or score > clean[i + 1][0]:
                    clean[i + 1] = (score, char, ("clean", 0, i), char)
            for k, (data, _, starts, written_in, cost) in enumerate(streams):
                if i == n:
                    continue
                start = starts[i]
                if here and data[start] != "barrier" and (data[start] is None or data[start] >= 0x80):
                    old = inside[k].get(start)
                    if old is None or here[0] - cost > old[0]:
                        inside[k][start] = (here[0] - cost, here[1], ("clean", 0, i), "")
                for at in range(start, starts[i + 1]):
                    got = inside[k].get(at)
                    if not got or data[at] == "barrier":
                        continue
                    for size, chars in self._next(data, at, written_in):
                        old = inside[k].get(at + size)
                        most = old[0] if old else -math.inf
                        for char in chars:
                            if got[0] + logs.get(char, unseen) <= most:
                                break  # nor does a rarer character score more
                            score = got[0] + log_p(got[1], char)
                            if score > most:
                                most = score
                                inside[k][at + size] = (score, char, ("in", k, at), char)
        out, node, used = [], ("clean", 0, n), False
        while node is not None:
            kind, k, at = node
            _, _, node, emitted = clean[at] if kind == "clean" else inside[k][at]
            used = used or kind == "in"
            out.append(emitted)
        return "".join(reversed(out)), used, clean[n][0]

    def decode(self, cell: str) -> tuple[bool, str, str]:
        """``(garbled, restored, guess)``; restored is empty if bytes were lost, guess is the best reading."""
        lost = LOST in cell or "锟" in cell
        text = cell
        garbled = lost
        for _ in range(self.rounds):
            channels = self.channels(text)
            if not channels:
                break
            better, used, score = self.best(text, channels)
            outer = peel(text)
            if outer != text:
                # The text may have been misread twice: the lattice of what is below the outer layer.
                inner, _, below = self.best(outer, self.channels(outer))
                if below - 3.0 > score:
                    better, used = inner, True
            if not used or better == text:
                break
            text, garbled = better, True
            lost = lost or LOST in better
        return garbled, "" if lost else text if garbled else "", text


def decode_cells(df: DataFrame, fields: Sequence[str], key: str = "row_id", frequencies: Frequencies | None = None) -> DataFrame:
    """One row per garbled cell: ``row_id, field_name, restored, guess``.

    ``restored`` is the whole original cell, or the empty string when characters were lost and the
    cell alone no longer determines the text; ``guess`` is then the likeliest reading under the
    corpus frequencies. Null, empty and clean cells give no row. Extra columns are ignored.
    """
    frequencies = frequencies or corpus_frequencies(df, fields)
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(frequencies)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).unique()], ["cell"])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in batches:
            rows = [(c, *found[1:]) for c in batch.column(0).to_pylist() if (found := decoder.decode(c))[0]]
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in columns], ["cell", "restored", "guess"])

    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("cell")) for f in fields])
    cells = (
        df.select(F.col(key).cast("long").alias("row_id"), F.explode(pairs).alias("p"))
        .select("row_id", "p.field_name", "p.cell")
        .where(F.col("cell").rlike(r"[^\x00-\x7f]"))
    )
    # Repeated cells are dropped within their batch before the one shuffle; its number of partitions is given, since
    # decoding a cell costs far more than its bytes tell.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    distinct = cells.select("cell").mapInArrow(once, "cell string").repartition(n, "cell").distinct()
    read = cut_lineage(distinct.mapInArrow(decode, "cell string, restored string, guess string"))
    return back_to_rows(cells, read).select("row_id", "field_name", "restored", "guess")


def back_to_rows(cells: DataFrame, read: DataFrame) -> DataFrame:
    """Joins what was read from distinct cells to the rows: by a broadcast within ``MAX_BROADCAST_CHARACTERS`` of
    measured text; beyond it rows are spread by a salt, since one cell may hold a large part of them."""
    text = F.length("cell") + F.length("restored") + F.length("guess") + 32
    size = read.agg(F.coalesce(F.sum(text), F.lit(0)).alias("n")).first()["n"]
    if size <= MAX_BROADCAST_CHARACTERS:
        return cells.join(F.broadcast(read), "cell")
    salted = cells.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int"))
    return salted.join(read.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["cell", "salt"])
