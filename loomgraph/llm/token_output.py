"""Operator 2: token ids in ORC files.

Texts are range-partitioned and sorted by doc_id, encoded in Arrow batches and written by Spark's
ORC writer: run-length encoded integers, a row index and Bloom filters on doc_id in every stripe.
Each file holds a contiguous range of documents, with each document's offset within its part; the
offset of a part is the sum of the parts before it, taken from the n_tokens column alone. Readers
work stripe by stripe, and look up documents through the stripes' statistics and Bloom filters.

A vocabulary whose file says that it lowers case, drops white space and never joins across it is read
piece by piece: texts are cut at spaces and newlines, the ids are those of the whole text, and frequent
pieces come from a bounded cache in each Python worker. With any other, whole texts go to the library.

Defined results: a null or empty text gives the end id alone; null doc_ids come first; equal
doc_ids follow each other in order of the text's digest, repeated rows in any order; a very long text
is one row; an empty table gives empty files; other columns are not written.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructType

from .common import new_path, text_key

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
STORED = StructType().add("part", IntegerType()).add("doc_id", LongType()).add("place", LongType()).add("local_start", LongType()).add("n_tokens", LongType()).add("ids", ArrayType(IntegerType()))
#: Pieces and parts kept by each worker; a cache is emptied when full, and longer pieces aren't kept.
MOST_PIECES, LONGEST_PIECE = 600_000, 64
#: A run of letters that lower-casing maps one to one, then ASCII signs other than the apostrophe.
SIMPLE = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\\[-`{-~]*)")

#: What a vocabulary's file has where pieces may be encoded one by one.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
WORDS = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}

_encoders: dict[str, PieceEncoder] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> str:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


def splits_at_spaces(path: str) -> bool:
    """Whether the vocabulary's own rules allow :class:`PieceEncoder`'s cutting and lower-casing."""
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    normalizer, cut = rules.get("normalizer") or {}, rules.get("pre_tokenizer") or {}
    first, *rest = cut.get("pretokenizers") or [{}]
    byte_level = [{k: r.get(k) for k in ("type", "add_prefix_space", "use_regex")} for r in rest] == [{"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
    words = first.get("pattern") == WORDS and first.get("behavior") == "Removed" and first.get("invert")
    return normalizer.get("normalizers") == NORMALIZER and bool(words) and byte_level and not rules["model"].get("dropout")


class _Parts(dict):
    """Ids of lower-case letter runs and of sign runs: each is one word of the library's model."""

    def __init__(self, model):
        super().__init__({"": b""})
        self.model, self.letters = model, byte_letters()

    def __missing__(self, part: str) -> bytes:
        if len(self) > MOST_PIECES:
            self.clear()
            self[""] = b""
        word = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        self[part] = ids = array("I", [t.id for t in self.model.tokenize(word)]).tobytes()
        return ids


class PieceEncoder(dict):
    """Ids of whole texts as little-endian unsigned 32-bit integers, by way of cached pieces."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.by_pieces = splits_at_spaces(path)
        self.parts = _Parts(self.tokenizer.model)

    def __missing__(self, piece: str) -> bytes:
        if simple := SIMPLE.fullmatch(piece):
            ids = self.parts[simple[1].lower()] + self.parts[simple[2]]
        else:
            ids = array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        if len(piece) <= LONGEST_PIECE:
            if len(self) > MOST_PIECES:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not self.by_pieces:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encoding(path: str, end_id: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, place, end = TaskContext.get().partitionId(), 0, 0, np.array([end_id], "<u4").tobytes()
        enc = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # ids of a few hundred texts at a time
                rows = batch.slice(at, 500)
                ids = [enc.encode(t or "") + end for t in rows.column("text").to_pylist()]
                counts = np.array([len(x) // 4 for x in ids], dtype=np.int64)
                ends = np.cumsum(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<i4")))
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), rows.column("doc_id").cast(pa.int64()), pa.array(np.arange(place, place + n)), pa.array(start + ends - counts), pa.array(counts), lists], names=STORED.names)
                start, place = start + int(ends[-1]), place + n

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, stripe_bytes: int = 64 << 20) -> None:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), text_key(F.col("text")).alias("digest"))
    ordered = rows.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest").select("doc_id", "text")
    encoded = ordered.mapInArrow(encoding(vocabulary or vocabulary_path(), end_id), STORED)
    (encoded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.create.index", "true").option("orc.stripe.size", str(stripe_bytes)).orc(path))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows; a filter on doc_id prunes stripes, and few columns mean few streams."""
    return spark.read.schema(STORED).orc(path)


def tokens_of(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of some documents; the filter reaches the stripes' statistics and Bloom filters."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids))


def part_starts(tokens: DataFrame) -> DataFrame:
    """part, part_start: a row per part; reads n_tokens only."""
    per = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return per.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("part_start"))


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("ids")
        values, offsets = np.asarray(lists.values).astype("<u4"), np.asarray(lists.offsets)
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("doc_id"), batch.column("local_start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    tokens = read_tokens(spark, path)
    rows = tokens.select("part", "doc_id", "local_start", "ids").mapInArrow(digested, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return rows.join(part_starts(tokens), "part").select("doc_id", (F.col("part_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_ids(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_digests(spark, path)
