"""Text expressions. Every function maps columns to a column and stays in the JVM."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrymill.vocab import LIST_PREFIXES, LIST_SUFFIXES, NO_VALUE, ORGANISATION_WORDS, PRODUCER_WORDS

# Stands for a comma between locants while a list is split.
LOCANT_COMMA = "\ue002"

# White space of Unicode and zero-width marks.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(chr(c) for c in range(0x2000, 0x200C))


def trim_blanks(text: Column) -> Column:
    """Without blanks of any script at either end; null stays null."""
    return F.trim(text, F.lit(BLANKS))


def is_no_value(trimmed: Column, tokens: Iterable[str] = tuple(NO_VALUE)) -> Column:
    """True for null and for the tokens that stand for no value; expects trimmed text."""
    return trimmed.isNull() | trimmed.isin(list(tokens))


def clean_text(text: Column) -> Column:
    """Trimmed, runs of blanks as one, without control characters."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "), r"[\x00-\x1f\x7f]", ""))


def collapse_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def normalize_name(name: Column, prefixes: Iterable[str]) -> Column:
    """Clean text without grade prefixes, each removed once in order, and with ASCII brackets."""
    out = clean_text(name)
    for prefix in prefixes:
        out = F.regexp_replace(out, f"^{prefix} *", "")
    return F.regexp_replace(out, r"[（(]([^）)]*)[）)]", "($1)")


def fold_synonyms(text: Column, groups: Iterable[Iterable[str]]) -> Column:
    """Substring replacement by the first of each group, in order, each on the result of the last."""
    out = text
    for first, *others in groups:
        for other in others:
            out = F.replace(out, F.lit(other), F.lit(first))
    return out


def null_tokens(text: Column, tokens: Iterable[str]) -> Column:
    """Null where the trimmed text is one of the tokens."""
    return F.when(~F.trim(text).isin(list(tokens)), text)


def clean_node_name(name: Column, connectives: Iterable[str]) -> Column:
    """Chinese, letters, digits, hyphens and commas only; one longest trailing connective removed."""
    kept = F.regexp_replace(name, "[^一-龥a-zA-Z0-9,，-]", "")
    ends = "|".join(sorted(connectives, key=len, reverse=True))
    return F.regexp_replace(kept, f"(?:{ends})$", "")


# Brackets that enclose remarks, by opening and closing.
_ENCLOSED = "|".join(f"[{a}][^{b}]*[{b}]" for a, b in (("（(", "）)"), ("【\\[", "】\\]")))
_PUNCTUATION = "[（()）\\[\\]【】，,；;：:。. \\t\\n\\r\\f]"
_NO_NAME = "^(?:[0-9]+|[用于作为通过经过].*)$"


def clean_name(name: Column, fillers: Iterable[str]) -> Column:
    """What is left of a name without remarks in brackets, fillers, list number and punctuation.

    Remarks go first and fillers next, the longest first. A list number counts only at the very start of what is left
    and only with a dot or an enumeration comma. Blank where 2 to 50 characters don't remain, or only digits, or a
    start with a character of a purpose or a way.
    """
    words = "|".join(sorted(fillers, key=lambda w: (-len(w), w)))
    bare = F.translate(F.regexp_replace(F.regexp_replace(F.trim(name), _ENCLOSED, ""), words, ""), "（()）[]【】", "")
    left = F.regexp_replace(bare, f"^[0-9]+[.、][ \\t]*|{_PUNCTUATION}+", "")
    return F.when(F.length(left).between(2, 50) & ~left.rlike(_NO_NAME), left).otherwise("")


def clean_name_chinese(name: Column, stop_words: Iterable[str]) -> Column:
    """The Chinese characters of a name, outside of brackets of any kind; blank beyond 2 to 20 or for a stop word."""
    outside = F.regexp_replace(name, r"[()（）【】\[\]<>《》].*?[()（）【】\[\]<>《》]", "")
    chinese = F.array_join(F.regexp_extract_all(outside, F.lit("[一-龥·]+"), F.lit(0)), "")
    return F.when(F.length(chinese).between(2, 20) & ~chinese.isin(list(stop_words)), chinese).otherwise("")


def split_list(text: Column, separators: str = "[;；,，、]") -> Column:
    """Trimmed parts that are not blank."""
    return F.filter(F.transform(F.split(text, separators), lambda p: F.trim(p)), lambda p: p != "")


def split_first_separator(text: Column, separators: Iterable[str]) -> Column:
    """Split at the first of the separators that the text contains; the whole text if none."""
    out = F.when(F.trim(text) != "", F.array(F.trim(text))).otherwise(F.array().cast("array<string>"))
    for s in reversed(list(separators)):
        parts = F.filter(F.transform(F.split(text, f"[{s}]"), lambda p: F.trim(p)), lambda p: p != "")
        out = F.when(text.contains(s), parts).otherwise(out)
    return out


def truncate(text: Column, length: int, suffix: str = "...") -> Column:
    return F.when(F.length(text) > length, F.concat(F.left(text, F.lit(length - len(suffix))), F.lit(suffix))).otherwise(text)


def mask_tokens(text: Column, least: int = 20) -> Column:
    """Every run of at least ``least`` letters and digits keeps four characters at either end."""
    return F.regexp_replace(text, rf"([A-Za-z0-9]{{4}})[A-Za-z0-9]{{{least - 8},}}([A-Za-z0-9]{{4}})", "$1****$2")


def language_class(text: Column) -> Column:
    """Chinese if any Chinese character occurs, else English if a Latin letter does, else other."""
    return F.when(text.rlike("[一-鿿]"), "zh").when(text.rlike("[A-Za-z]"), "en").otherwise("other")


def clean_answer(value: Column, invalid: Iterable[str]) -> Column:
    """Null for invalid answers and placeholders in brackets; enclosing quotes removed."""
    bare = F.regexp_replace(F.trim(value), "^[\"']+|[\"']+$", "")
    bad = F.lower(bare).isin(list(invalid)) | bare.rlike(r"^<.*>$") | bare.rlike(r"^\[.*\]$")
    return F.when(~bad, bare)


def is_valid_field(value: Column, invalid: Iterable[str]) -> Column:
    """False for null, texts without information and single digits."""
    bare = F.trim(value)
    return F.coalesce(~F.upper(bare).isin(list(invalid)) & ~bare.rlike("^[0-9]$"), F.lit(False))


def remove_producers(text: Column) -> Column:
    """Without clauses that name producers or companies, without semicolons, blanks collapsed.

    The text is cut into clauses once, so a long one without punctuation is read once and not from each of its characters.
    """
    told = F.regexp_replace(text, rf"(?:{'|'.join(PRODUCER_WORDS)})[^。；;，,]*", "")
    clauses = F.regexp_extract_all(told, F.lit(r"[^。；;，,]*(?:[。；;，,]|\z)"), F.lit(0))
    companies = "|".join(ORGANISATION_WORDS)
    rest = F.when(told.rlike(companies), F.array_join(F.filter(clauses, lambda c: ~c.rlike(companies)), "")).otherwise(told)
    return F.trim(F.regexp_replace(F.regexp_replace(rest, "[；;]+", ""), r"\s+", " "))


def braced_items(text: Column) -> Column:
    """What stands in braces, split at separators; ordered, distinct, longer than one character."""
    groups = F.regexp_extract_all(text, F.lit(r"\{([^}]+)\}"), F.lit(1))
    parts = F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, "[;；、,，]"), lambda p: F.trim(p))))
    return F.array_distinct(F.filter(parts, lambda p: F.length(p) > 1))


def smart_split(text: Column) -> Column:
    """Names of a list; commas between the locants of a substance don't split.

    A comma between two numbers becomes a placeholder before the list is split and a comma again after it; two
    passes do, since matches share their numbers. Verbs before a name and what follows it are cut.
    """
    held = text
    for _ in range(2):
        held = F.regexp_replace(held, "([0-9]),([0-9])", f"$1{LOCANT_COMMA}$2")
    parts = F.split(F.regexp_replace(held, "[、;；,和与及或等]+", "、"), "、")
    names = F.transform(parts, lambda p: F.trim(F.translate(p, LOCANT_COMMA, ",")))
    return F.filter(F.transform(names, lambda p: cut_affixes(p, LIST_PREFIXES, LIST_SUFFIXES)), lambda p: F.length(p) >= 2)


def cut_affixes(name: Column, prefixes: Iterable[str], suffixes: Iterable[str]) -> Column:
    """Without one of the prefixes, and without the first of the suffixes and all that follows it."""
    begun = F.regexp_replace(name, f"^(?:{'|'.join(prefixes)})[ \\t\\n\\r\\f]*", "")
    return F.trim(F.regexp_replace(begun, f"(?s)[ \\t\\n\\r\\f]*(?:{'|'.join(suffixes)}).*$", ""))


def safe_name(text: Column, length: int = 80) -> Column:
    """Usable as a file name."""
    return F.left(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1f ]', "_"), F.lit(length))


def name_plausible(name: Column, invalid: Iterable[str], always: Iterable[str], marks: Iterable[str]) -> Column:
    """Whether a text may be the name of a substance: one of those that always are, or one with a mark of such names."""
    fine = F.length(name).between(1, 20) & ~name.isin(list(invalid)) & ~name.rlike(r"[-0-9%％+=*#@$&^~`|\\\"'\[\]<>《》]")
    return F.coalesce(fine & (name.isin(list(always)) | name.rlike("[" + "".join(marks) + "]")), F.lit(False))
