"""Terms of a keyword index: words folded to plain letters and stemmed by Porter's rules.

Both are functions of a word alone, so an index applies them once to each
distinct word of a batch (``operators.index``), and what is common is remembered.
"""

from __future__ import annotations

import functools
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Porter's suffixes by step, each with what takes its place.
DOUBLE = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble", "alli": "al",
    "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
SINGLE = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
LAST = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
#: Words of other lengths, in bytes, aren't stemmed.
SHORTEST, LONGEST = 3, 64
#: Combining marks that belong to a word and are dropped from it.
MARKS = "".join(map(chr, (*range(0x300, 0x305), *range(0x306, 0x30D), 0x30F, 0x311, 0x31B, *range(0x323, 0x329), 0x32D, 0x32E, 0x330, 0x331)))

_SPLIT = rf"[^\p{{L}}\p{{N}}\p{{Co}}{MARKS}]+"
_MARKS = re.compile(f"[{MARKS}]")


def _shape(stem: str) -> str:
    """v for each vowel and c for each other letter; a y is a vowel after a consonant."""
    out = ""
    for letter in stem:
        out += "v" if letter in "aeiou" or letter == "y" and out.endswith("c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often consonants follow vowels."""
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _closed(stem: str) -> bool:
    """Whether it ends in consonant, vowel and a consonant other than w, x and y."""
    return _shape(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s) and len(word) > len(s)), key=len, default=None)


def _plural(word: str) -> str:
    if word.endswith("es"):
        return word[:-2] if word.endswith("sses") and len(word) > 4 or word.endswith("ies") and len(word) > 3 else word[:-1]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _participle(word: str) -> str:
    suffix = _longest(word, ("eed", "ed", "ing"))
    stem = word[: -len(suffix)] if suffix else ""
    if suffix == "eed":
        return word[:-1] if _measure(stem) else word
    if not suffix or not _has_vowel(stem):
        return word
    if _longest(stem, ("at", "bl", "iz")):
        return stem + "e"
    if len(stem) > 1 and stem[-1] == stem[-2] and stem[-1] not in "aeioulsz":
        return stem[:-1]
    return stem + "e" if _measure(stem) == 1 and _closed(stem) else stem


def _replaced(word: str, table: dict[str, str]) -> str:
    suffix = _longest(word, table)
    return word[: -len(suffix)] + table[suffix] if suffix and _measure(word[: -len(suffix)]) else word


def _cut(word: str) -> str:
    suffix = _longest(word, LAST)
    stem = word[: -len(suffix)] if suffix else word
    return stem if suffix and _measure(stem) > 1 and (suffix != "ion" or stem[-1] in "st") else word


def _tidied(word: str) -> str:
    if word.endswith("e"):
        m = _measure(word[:-1])
        word = word[:-1] if m > 1 or m == 1 and not _closed(word[:-1]) else word
    return word[:-1] if word.endswith("ll") and _measure(word[:-1]) > 1 else word


def stemmed(word: str) -> str:
    """Porter's stem of a folded word."""
    if not SHORTEST <= len(word.encode("utf-8", "replace")) <= LONGEST:
        return word
    word = _participle(_plural(word))
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    return _tidied(_cut(_replaced(_replaced(word, DOUBLE), SINGLE)))


def folded(word: str) -> str:
    """A lower-case word with Latin letters without their marks."""
    if word.isascii():
        return word
    plain = (d[0] if (d := unicodedata.normalize("NFD", c))[0].isascii() else c for c in word)
    return _MARKS.sub("", "".join(plain))


@functools.lru_cache(1 << 16)
def term(word: str) -> str:
    """The term that a lower-case word is indexed as."""
    return stemmed(folded(word))


def words(text: str | Column) -> Column:
    """The lower-case words of a text, to be folded and stemmed; none for null."""
    found = F.split(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), _SPLIT)
    return F.filter(found, lambda w: w != "")
