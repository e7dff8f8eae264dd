"""Models that stand outside: interfaces, and offline forms that always answer alike."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomgraph.functions.search import terms_of

#: Texts to vectors, in the same order.
Embedder = Callable[[list[str]], np.ndarray]
#: A prompt to pieces of an answer.
Generator = Callable[[str], Iterator[str]]


def hashed_vectors(texts: list[str], dimension: int = 64) -> np.ndarray:
    """Unit vectors: each stem of a text adds one or takes one off at places that its digest names. Zero without words."""
    out = np.zeros((len(texts), dimension))
    for i, text in enumerate(texts):
        for term in terms_of(text):
            digest = hashlib.blake2b(term.encode(), digest_size=8).digest()
            places = np.frombuffer(digest, "<u2")
            np.add.at(out[i], places % dimension, np.where(places & 0x8000, 1.0, -1.0))
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms > 0, norms, 1)


def embedded(text: Column, model: Embedder = hashed_vectors) -> Column:
    """Vectors of texts, in batches; null for null."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        some = [t for t in texts if t is not None]
        found = iter(model(some).astype(np.float32)) if some else iter(())
        return pd.Series([None if t is None else next(found) for t in texts], dtype=object)

    return run(text)


def answered(prompt: Column, model: Generator) -> Column:
    """A model's whole answers; null where it fails or the prompt is null."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return pd.Series([answer(model, p) for p in prompts], dtype=object)

    return run(prompt)


def answer(model: Generator, prompt: str | None) -> str | None:
    try:
        return None if prompt is None else "".join(model(prompt))
    except Exception:  # noqa: BLE001 - whatever a model raises, its row has no answer
        return None


def first_lines(prompt: str) -> Iterator[str]:
    """A stand-in: the prompt's first line, word by word."""
    for word in (prompt.splitlines() or [""])[0].split():
        yield word + " "
