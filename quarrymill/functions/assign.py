"""Keys of an answer assigned to the attributes that were asked for, for use within Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from difflib import SequenceMatcher
from typing import Any

ACCEPTED_SCORE = 0.5
ACCEPTED_RATIO = 0.6
_KEYWORD = re.compile(r"\w+")


def key_ratio(a: str, b: str) -> float:
    """Matching characters of both in lower case, 0 to 1."""
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def key_score(wanted: str, key: str) -> float:
    """Six tenths of the ratio and four tenths of the share of the wanted keywords that the key has."""
    words = set(_KEYWORD.findall(wanted.lower()))
    shared = len(words & set(_KEYWORD.findall(key.lower()))) / max(len(words), 1)
    return 0.6 * key_ratio(wanted, key) + 0.4 * shared


def assign_keys(answer: Mapping[str, Any], wanted: Iterable[str]) -> dict[str, Any]:
    """The answer under the wanted names, in their order: an equal key, else the likest one with a score above 0.5.

    Every key serves once, the first of equally like ones; keys that serve none keep their names.
    """
    free, out = dict(answer), {}
    for name in wanted:
        if name in answer:
            out[name] = answer[name]
            free.pop(name, None)
            continue
        scored = [(key_score(name, key), -i, key) for i, key in enumerate(free)]
        score, _, key = max(scored, default=(0.0, 0, ""))
        if score > ACCEPTED_SCORE:
            out[name] = free.pop(key)
    return out | {k: v for k, v in free.items() if k not in out}


def assign_loosely(answer: Mapping[str, Any], wanted: Iterable[str]) -> dict[str, str]:
    """Only the wanted names, trimmed: an equal key, else the first that contains the name, is contained or is like it.

    Equal keys are taken first, for all names; values that are blank serve none.
    """
    names = list(wanted)
    filled = {k: str(v).strip() for k, v in answer.items() if v is not None and str(v).strip()}
    out = {n: filled.pop(n) for n in names if n in filled}
    for name in names:
        if name in out:
            continue
        low = name.lower()
        near = (k for k in filled if low in k.lower() or k.lower() in low or key_ratio(name, k) > ACCEPTED_RATIO)
        key = next(near, None)
        if key is not None:
            out[name] = filled.pop(key)
    return out
