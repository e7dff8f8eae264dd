"""Texts to chunks of a target size along paragraphs, lines, sentences or words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[^\S\n\r\x0b\x0c\x85\u2028\u2029]+"
#: All characters of ``BLANK``; there are none beyond.
BLANKS = "".join(c for c in map(chr, range(0x3001)) if re.match(BLANK, c))


def filled(parts: list[str], between: str, size: int) -> Iterator[str]:
    """Parts joined while they fit ``size``; a part that is larger stands alone."""
    held: str | None = None
    for part in parts:
        if held is not None and len(held) + len(between) + len(part) <= size:
            held = f"{held}{between}{part}"
        else:
            if held is not None:
                yield held
            held = part
    if held is not None:
        yield held


def parts_of(text: str) -> tuple[list[str], str]:
    """The coarsest division into two parts or more, and what joins them."""
    for between in ("\n\n", "\n"):
        parts = [p.strip() for p in text.split(between) if p.strip()]
        if len(parts) > 1:
            return parts, between
    # up to the last end mark, so that no search runs to the text's end in vain
    ended = text[: max(map(text.rfind, ".!?")) + 1]
    return [s.lstrip(BLANKS) for s in re.findall("[^.!?]+[.!?]+", ended)] or [text.strip()], " "


def chunks_of(text: str | None, size: int) -> list[str]:
    out: list[str] = []
    for chunk in filled(*parts_of(text), size) if text else ():
        if len(chunk) <= size:
            out.append(chunk)
            continue
        for piece in filled([w for w in re.split(BLANK, chunk) if w], " ", size):
            out += [piece[i: i + size] for i in range(0, len(piece), size)]
    return out


def text_chunks(text: Column, size: int = 800) -> Column:
    """Array of chunks of at most ``size`` code points.

    Paragraphs are taken if there are two or more, else lines, else sentences (what follows the last
    end mark is dropped if there is one), and merged while they fit; larger ones are cut between
    words, and a word that is larger in itself anywhere. Null and empty texts have none.
    """

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks_of(t, size))

    return run(text)
