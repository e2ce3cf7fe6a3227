"""Free-entered values mapped to the entries of a reference list; values that stand for none are reported.

Method: values are deduplicated and normalised; an inverted index of character n-grams retrieves
every name that shares a gram; a weighted cosine scores them, nothing else does; the best entry is
accepted above a threshold and a margin to the second. A check that can only refuse stands between:
a name has to be the value's part but for few misspellings, or its end. Other names of an entry are
learned from the values themselves: where a value states an entry's name beside another one
("mainboard (主板)"), the other one is a name of that entry, if it keeps company with that entry only.
A second round learns what ends in a name ("desktop CPU"), so that its misspellings are found as well.

Scale: only distinct values are scored, after a pre-aggregation on the map side; the reference list
is a bounded table, learned names are counted in Spark and all of them are held in memory; the mapping goes
back to the rows by a broadcast behind a check of its size, beyond it by a salted join.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.functions.text import is_no_value, trim_blanks
from quarrymill.session import cut_lineage

THRESHOLD = 0.2
MARGIN = 0.04
LEARNED_SHARE = 0.85
MAX_BROADCAST_CHARACTERS = 8_000_000
SALTS = 16

_SPLIT = re.compile(r"[()\[\]{}【】<>|/\\:;,，；、]|\s[-–—]\s|(?<=[一-鿿])-(?=\w)|->")
_JOIN = re.compile(r"[\s._\-–—'’®™©*#\"“”]+")
# Words around a name that don't belong to it.
WRAPPERS = {
    "inc", "incorporated", "ltd", "limited", "co", "corp", "corporation", "company", "gmbh", "ag", "sa", "spa", "llc", "plc", "bv", "kk",
    "group", "holdings", "technology", "technologies", "electronics", "international", "the", "by", "mfr", "manufacturer", "brand", "maker", "from",
    "new", "retail", "used", "oem", "x1", "pcs", "made", "全新", "二手",
}
_WRAPPERS_ZH = re.compile(r"^(?:厂商|品牌|制造商|生产商|厂家)|(?:股份有限公司|有限责任公司|有限公司|股份|集团|公司|科技|电子|技术|类|牌)$")


def plain(text: str) -> str:
    """Half-width lower case without accents."""
    spread = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", re.sub("[®™©]", "", text)))
    return "".join(c for c in spread if not unicodedata.combining(c)).lower()


def compact(text: str) -> str:
    """Without blanks, separators and wrappers."""
    for _ in range(4):
        shorter = _WRAPPERS_ZH.sub("", text.strip())
        if shorter == text or not shorter:
            break
        text = shorter
    words = [w for w in re.split(r"\s+", re.sub(r"[®™©]", "", text).replace("s.p.a", "spa")) if w]
    kept = [w for w in words if w.strip(".,") not in WRAPPERS] or words
    return _JOIN.sub("", "".join(kept)) if all(len(w) == 1 for w in kept) else _JOIN.sub("", " ".join(kept))


def pieces_of(value: str) -> list[str]:
    """The pieces between separators, in normal form."""
    pieces = list(dict.fromkeys(p for p in (compact(x) for x in _SPLIT.split(plain(value))) if p))
    return [p for p in pieces if p not in WRAPPERS] or pieces


def parts_of(value: str) -> list[str]:
    """The pieces, what is Latin and what is Chinese in the value, and the whole."""
    text = plain(value)
    latin = compact(re.sub("[^\x00-\x7f]+", " ", _SPLIT.sub(" ", text)))
    chinese = compact(re.sub("[\x00-\x7f]+", " ", text))
    return list(dict.fromkeys(p for p in [*pieces_of(value), latin, chinese, compact(_SPLIT.sub(" ", text))] if p))


def heads_of(value: str) -> list[str]:
    """Ends of the pieces, the longest first: what a compound name names comes last."""
    out = []
    for piece in _SPLIT.split(plain(value)):
        words = [w for w in re.split(r"[\s_-]+", re.sub("[^\x00-\x7f]+", " ", piece).strip(" .")) if w and w.strip(".,") not in WRAPPERS]
        out += [_JOIN.sub("", "".join(words[i:])) for i in range(1, len(words))]
        run = compact(re.sub("[\x00-\x7f]+", " ", piece))
        out += [run[i:] for i in range(1, len(run) - 1)]
    return [h for h in out if len(h) > 1]


def grams(text: str) -> list[str]:
    """Character pairs and triples of a bounded name; single characters for Chinese names."""
    bound = f"^{text}$"
    out = [bound[i : i + 2] for i in range(len(bound) - 1)] + [bound[i : i + 3] for i in range(len(bound) - 2)]
    return out + [c for c in text if c > "⿿"]


def edit_distance(a: str, b: str, limit: int) -> int:
    """Optimal string alignment distance, given up beyond ``limit``."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            now.append(cost)
        if min(now) > limit:
            return limit + 1
        before, last = last, now
    return last[-1]


MOST_EDITS = 3


def allowed_edits(length: int) -> int:
    """Misspellings that a name of this length may have."""
    return 0 if length < 5 else 1 if length < 6 else 2 if length < 10 else MOST_EDITS


def words_fit(value: str, name: str) -> bool:
    """Word by word, each within its own misspellings; names of unlike numbers of words are not compared."""
    a, b = ([w for w in re.split(r"[\s_-]+", plain(x).strip(" .")) if w] for x in (value, name))
    return len(a) != len(b) or all(edit_distance(x, y, 3) <= min(3, 1 + len(y) // 4, max(len(x), len(y)) // 2) for x, y in zip(a, b, strict=True))


@dataclass
class Entry:
    ref_id: int
    names: list[str]
    spelling: str = ""


class Reference:
    """Inverted index from n-grams to the names of one list."""

    def __init__(self, entries: Sequence[Entry], learned: dict[str, int] | None = None) -> None:
        self.exact: dict[str, int] = dict(learned or {})
        self.spelling = {e.ref_id: e.spelling for e in entries}
        for e in entries:
            for name in e.names:
                self.exact[name] = e.ref_id
        self.names = sorted(self.exact)
        df = Counter(g for name in self.names for g in set(grams(name)))
        n = len(self.names)
        self.idf = {g: math.log(1 + n / c) for g, c in df.items()}
        self.rare = math.log(1 + n)
        # By gram and length of the name: a misspelling has nearly the length of its name.
        self.postings: dict[tuple[str, int], list[tuple[int, float]]] = defaultdict(list)
        self.vectors = [self._weights(name) for name in self.names]
        for i, weights in enumerate(self.vectors):
            for g, w in weights.items():
                self.postings[g, len(self.names[i])].append((i, w))
        self.place = {name: i for i, name in enumerate(self.names)}

    def _weights(self, name: str) -> dict[str, float]:
        counts = Counter(grams(name))
        weights = {g: math.sqrt(c) * self.idf.get(g, self.rare) for g, c in counts.items()}
        norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        return {g: w / norm for g, w in weights.items()}

    def candidates(self, part: str, ends: set[str], least: float) -> dict[str, float]:
        """Names with a cosine of at least ``least`` that may pass the check: those at the end of the value and those
        whose length is within the most edits of the part's.

        A name that shares none of the grams read so far scores at most the norm of the rest, since names have unit
        length: rare grams are read first, until that is too little for a new one.
        """
        own = sorted(self._weights(part).items(), key=lambda x: -x[1])
        found = {self.place[name] for name in ends if name in self.place}
        rest = 1.0
        for g, w in own:
            if rest < least * least - 1e-9:
                break
            for length in range(len(part) - MOST_EDITS, len(part) + MOST_EDITS + 1):
                found.update(i for i, _ in self.postings.get((g, length), ()))
            rest -= w * w
        scores = {self.names[i]: sum(w * self.vectors[i].get(g, 0.0) for g, w in own) for i in found}
        return {name: score for name, score in scores.items() if score >= least}

    def _edits(self, part: str, name: str, value: str, ends: set[str]) -> int | None:
        """Edits from the part to the name; None where the part is neither its misspelling nor a compound that ends in it."""
        if part == name:
            return 0
        if name in ends and len(part) > len(name):
            return len(part) - len(name)
        limit = allowed_edits(len(name))
        edits = edit_distance(part, name, limit)
        if edits > limit:
            return None
        spelt = self.spelling.get(self.exact[name], "")
        return edits if compact(plain(spelt)) != name or any(words_fit(p, spelt) for p in _SPLIT.split(value) if p.strip()) else None

    def match(self, value: str, threshold: float = THRESHOLD, margin: float = MARGIN) -> int:
        """The entry a value stands for, -1 for none: the best cosine above the threshold and the margin to the second.

        Refused as well if another entry is no more edits away.
        """
        best: dict[int, float] = {}
        nearest: dict[int, int] = {}
        ends = set(heads_of(value))
        parts = parts_of(value)
        # An equal name scores 1: only names within the margin of it can still matter.
        least = max(threshold, 1.0 - margin) if any(p in self.exact for p in parts) else threshold
        for part in parts:
            for name, score in self.candidates(part, ends, least).items():
                ref = self.exact[name]
                edits = self._edits(part, name, value, ends)
                if edits is not None:
                    best[ref] = max(score, best.get(ref, 0.0))
                    nearest[ref] = min(edits, nearest.get(ref, edits))
        ranked = sorted(best.items(), key=lambda x: (-x[1], x[0]))
        if not ranked or (len(ranked) > 1 and ranked[0][1] - ranked[1][1] < margin):
            return -1
        first = ranked[0][0]
        return -1 if any(nearest[ref] <= nearest[first] for ref in nearest if ref != first) else first


def read_reference(reference: DataFrame, glossary: DataFrame | None = None) -> dict[str, list[Entry]]:
    """The entries by list, with further names from ``glossary`` (``ref_id, name``); bounded tables read on the driver."""
    further: dict[int, list[str]] = defaultdict(list)
    for r in glossary.select("ref_id", "name").where("name is not null").orderBy("ref_id", "name").collect() if glossary is not None else []:
        further[r["ref_id"]].append(r["name"])
    lists: dict[str, list[Entry]] = defaultdict(list)
    items = reference.where("canonical_name is not null").select("ref_id", "list_name", "canonical_name", "name_zh", "short_code")
    for r in items.orderBy("ref_id").collect():
        names = [compact(plain(x)) for x in (r["canonical_name"], r["name_zh"], r["short_code"], *further[r["ref_id"]]) if x]
        lists[r["list_name"]].append(Entry(r["ref_id"], list(dict.fromkeys(n for n in names if n)), r["canonical_name"]))
    return lists


def name_beside(value: str, known: dict[str, int]) -> tuple[str, int] | None:
    """Another name that a value gives to an entry: what stands beside one of the entry's names."""
    pieces = pieces_of(value)
    if len(pieces) != 2:
        return None
    named = [p for p in pieces if p in known]
    other = pieces[1] if named and named[0] == pieces[0] else pieces[0]
    return (other, known[named[0]]) if len(named) == 1 and len(other) > 1 else None


def compound(value: str, known: dict[str, int]) -> tuple[str, int] | None:
    """A value that ends in the name of one entry, taken for a name of it."""
    pieces = pieces_of(value)
    if len(pieces) != 1 or pieces[0] in known:
        return None
    refs = {known[h] for h in heads_of(value) if h in known}
    return (pieces[0], refs.pop()) if len(refs) == 1 else None


def learn_names(distinct: DataFrame, known: dict[str, dict[str, int]], rule: Callable) -> dict[str, dict[str, int]]:
    """Names by list that a rule finds in the values and that keep company with one entry in ``LEARNED_SHARE`` of them."""
    shared = distinct.sparkSession.sparkContext.broadcast(known)

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (field, *got) for field, value in zip(batch.field_name, batch.value, strict=True) if (got := rule(value, shared.value.get(field, {})))
            ]
            yield pd.DataFrame(rows, columns=["field_name", "part", "ref_id"])

    votes = distinct.select("field_name", "value").mapInPandas(vote, "field_name string, part string, ref_id int")
    counted = votes.groupBy("field_name", "part", "ref_id").count()
    summed = counted.groupBy("field_name", "part").agg(F.max_by("ref_id", "count").alias("ref_id"), F.max("count").alias("most"), F.sum("count").alias("n"))
    out = {field: dict(names) for field, names in known.items()}
    for r in summed.where(F.col("most") >= LEARNED_SHARE * F.col("n")).orderBy("field_name", "part").collect():
        out[r["field_name"]].setdefault(r["part"], r["ref_id"])
    return out


def map_to_reference(
    tables: Sequence[tuple[DataFrame, str, Sequence[str]]],
    reference: DataFrame,
    key: str = "row_id",
    threshold: float = THRESHOLD,
    margin: float = MARGIN,
    glossary: DataFrame | None = None,
) -> DataFrame:
    """One row per cell to be mapped: ``table_name, row_id, field_name, ref_id``, -1 for no entry.

    ``tables``: (frame, name, fields); the list of a field is named like it. ``glossary`` (``ref_id, name``): further
    names of entries, none by default. Cells that are null, a no-value token or exactly a canonical name of their
    list give no row. A value that is equally near two entries, or names two, counts as none. Extra columns are ignored.
    """
    lists = read_reference(reference, glossary)
    known = {name: {n: e.ref_id for e in entries for n in e.names} for name, entries in lists.items()}

    cells = None
    for df, table_name, fields in tables:
        for field in fields:
            value = F.col(f"`{field}`").cast("string")
            exactly = [e.spelling for e in lists.get(field, [])]
            part = df.select(
                F.lit(table_name).alias("table_name"), F.col(key).cast("long").alias("row_id"), F.lit(field).alias("field_name"), value.alias("value")
            ).where(~is_no_value(trim_blanks(F.col("value"))) & ~F.col("value").isin(exactly))
            cells = part if cells is None else cells.unionByName(part)
            known.setdefault(field, {})
    distinct = cut_lineage(cells.select("field_name", "value").distinct())
    names = learn_names(distinct, learn_names(distinct, known, name_beside), compound)
    shared = reference.sparkSession.sparkContext.broadcast((dict(lists), names))

    def match(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entries, learned = shared.value
        ready: dict[str, Reference] = {}
        for batch in batches:
            found = []
            for field, value in zip(batch.field_name, batch.value, strict=True):
                if field not in ready:
                    ready[field] = Reference(entries.get(field, []), learned.get(field))
                found.append(ready[field].match(value, threshold, margin))
            yield pd.DataFrame({"field_name": batch.field_name, "value": batch.value, "ref_id": pd.array(found, dtype="int32")})

    mapping = distinct.mapInPandas(match, "field_name string, value string, ref_id int")
    return back_to_rows(cells, mapping, distinct).select("table_name", "row_id", "field_name", "ref_id")


def back_to_rows(cells: DataFrame, mapping: DataFrame, distinct: DataFrame) -> DataFrame:
    """Joins the mapping of distinct values to the rows.

    Within ``MAX_BROADCAST_CHARACTERS`` of measured values the mapping is broadcast and rows don't
    move. Beyond it, rows are spread by a salt, since one value may hold a large part of them, and
    the mapping is repeated per salt.
    """
    size = distinct.agg(F.coalesce(F.sum(F.length("value") + 32), F.lit(0)).alias("n")).first()["n"]
    if size <= MAX_BROADCAST_CHARACTERS:
        return cells.join(F.broadcast(mapping), ["field_name", "value"])
    salted = cells.withColumn("salt", F.pmod(F.xxhash64("row_id"), F.lit(SALTS)).cast("int"))
    spread = mapping.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(spread, ["field_name", "value", "salt"])
