"""Words as a full-text index has them: case and accents folded, reduced to stems; and snippets around them."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Suffixes and what takes their place in the second and third step of Porter's stemmer (1980), and those dropped in the fourth.
STEP_2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"))
STEP_3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")
_stems: dict[str, str] = {}
MOST_STEMS = 500_000


def shape(word: str) -> str:
    """A letter for each letter: v for vowels (y after a consonant, too), c for others."""
    out = ""
    for i, x in enumerate(word):
        out += "v" if x in "aeiou" or (x == "y" and i and out[-1] == "c") else "c"
    return out


def measure(stem: str) -> int:
    """How often a consonant follows a vowel."""
    return shape(stem).count("vc")


def short_end(stem: str) -> bool:
    return shape(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


def porter(word: str) -> str:
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    for end, by in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(end):
            word = word[: len(word) - len(end)] + by
            break
    if word.endswith("eed"):
        word = word[:-1] if measure(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and "v" in shape(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif shape(word)[-2:] == "cc" and word[-1:] == word[-2:-1] and word[-1] not in "lsz":
                    word = word[:-1]
                elif measure(word) == 1 and short_end(word):
                    word += "e"
                break
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    for table in (STEP_2, STEP_3):
        for end, by in sorted(table, key=lambda t: -len(t[0])):
            if word.endswith(end):
                word = word[: len(word) - len(end)] + by if measure(word[: len(word) - len(end)]) else word
                break
    for end in sorted(STEP_4, key=len, reverse=True):
        if word.endswith(end):
            stem = word[: len(word) - len(end)]
            word = stem if measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))) else word
            break
    if word.endswith("e") and (measure(word[:-1]) > 1 or (measure(word[:-1]) == 1 and not short_end(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and measure(word[:-1]) > 1 else word


def folded(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def stem(word: str) -> str:
    """Of a word as it stands in a text; kept in a bounded table, as texts repeat their words."""
    found = _stems.get(word)
    if found is None:
        if len(_stems) > MOST_STEMS:
            _stems.clear()
        found = _stems[word] = porter(folded(word))
    return found


def terms_of(text: str | None) -> list[str]:
    return [stem(w) for w in WORD.findall(text)] if text else []


def terms(text: Column) -> Column:
    """Stems of a text's words, in order."""

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([terms_of(t) for t in texts])

    return found(text)


def snippet_of(text: str | None, wanted: frozenset[str], words: int, begin: str, end: str, dots: str) -> str | None:
    """The run of ``words`` words with the most different wanted stems (then the most, then the first), those marked."""
    if text is None:
        return None
    found = list(WORD.finditer(text))
    hit = [stem(m[0]) if stem(m[0]) in wanted else None for m in found]
    best, at = (0, 0), 0
    for first in [0, *(i for i, h in enumerate(hit) if h)]:
        first = max(0, min(first, len(found) - words))
        inside = [h for h in hit[first: first + words] if h]
        if (len(set(inside)), len(inside)) > best:
            best, at = (len(set(inside)), len(inside)), first
    chosen = found[at: at + words]
    if not chosen:
        return text
    out, last = [dots if at else "", "" if at else text[: chosen[0].start()]], chosen[0].start()
    for m, h in zip(chosen, hit[at: at + words]):
        out += [text[last: m.start()], f"{begin}{m[0]}{end}" if h else m[0]]
        last = m.end()
    return "".join([*out, dots if at + words < len(found) else text[last:]])


def snippet(text: Column, wanted: list[str], words: int, begin: str = "<b>", end: str = "</b>", dots: str = "...") -> Column:
    stems = frozenset(wanted)

    @F.pandas_udf("string")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([snippet_of(t, stems, words, begin, end, dots) for t in texts])

    return cut(text)


def contains_folded(text: Column, part: str) -> Column:
    """Whether the text has the part, whatever the case and accents of both."""
    return F.coalesce(F.contains(F.collate(text, "UNICODE_CI_AI"), F.collate(F.lit(part), "UNICODE_CI_AI")), F.lit(False))
