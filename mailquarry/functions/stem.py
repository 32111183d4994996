"""The suffix-stripping stemmer published by M. F. Porter in 1980."""

from __future__ import annotations

import re

_V = "(?:[aeiou]|(?<=[^aeiou])y)"
_C = "(?:[^aeiouy]|(?<![^aeiou])y)"
_MEASURE = re.compile(f"{_V}+{_C}+")
_HAS_VOWEL = re.compile(_V)
_CVC = re.compile(f"{_C}{_V}(?![wxy]){_C}$")
_DOUBLE = re.compile(r"([^aeiouy])\1$")

# Fixed values of the published algorithm: suffixes, what replaces them; the longest that fits is tried.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def measure(word: str) -> int:
    return len(_MEASURE.findall(word))


def _replaced(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            body = word[: -len(suffix)]
            return body + table[suffix] if measure(body) > 0 else word
    return word


def _plural(word: str) -> str:
    for suffix, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(suffix):
            return word[: len(word) - len(suffix)] + new
    return word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for suffix in ("ed", "ing"):
        body = word[: -len(suffix)]
        if word.endswith(suffix) and _HAS_VOWEL.search(body):
            if body.endswith(("at", "bl", "iz")):
                return body + "e"
            if _DOUBLE.search(body) and body[-1] not in "lsz":
                return body[:-1]
            return body + "e" if measure(body) == 1 and _CVC.search(body) else body
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    word = _past(_plural(word))
    if word.endswith("y") and _HAS_VOWEL.search(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2), STEP_3)
    for suffix in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(suffix):
            body = word[: -len(suffix)]
            if measure(body) > 1 and (suffix != "ion" or body.endswith(("s", "t"))):
                word = body
            break
    if word.endswith("e") and (measure(word[:-1]) > 1 or measure(word[:-1]) == 1 and not _CVC.search(word[:-1])):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word) > 1 else word
