"""Operator 13: suffix-array dedup by a depth-limited radix sort.

Suffixes are ordered through their first ``width`` bytes only; equal groups of that order are the
repeated windows. Every pass deals suffixes by a most significant digit and sends only those on that
share it with another document's:

1. The digit of a window is the least hash among its grams of ``width // 2`` bytes. Neighbouring
   windows mostly have it in common, so a run of them (at most ``width - width // 2 + 1``) is one item.
2. Runs whose digit occurs elsewhere are ordered by digit and whole text. If a digit has one text in
   all, its windows are equal wherever it stands and its smallest document decides on all of them.
3. The windows of the other runs are ordered one by one by digit and hash of all ``width`` bytes.

Texts lie in chunks in a table bucketed by chunk, and are never shuffled. A chunk sends each item once,
with its smallest document, packed by range of hashes; the answer is a code for each item: nothing,
a smaller document is elsewhere, or open. So a passage that all documents hold is one item of a chunk,
and what a range gathers is bounded by its share of hashes plus the number of chunks.

Two different windows count as equal only if 64-bit hashes of their bytes and of their least grams
both agree.

Defined results: lengths, matches and spans are in UTF-8 bytes; a null or empty text and one shorter
than ``width`` lose nothing; rows with the same doc_id are one document, repeated rows lose the same
bytes and none on account of each other; a null doc_id is smaller than all others; a very long text is
a chunk of its own; an empty table gives an empty result; other columns, whatever their names, are
ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, stored
from .line_dedup import doc_of

#: Bytes of text in a chunk (or one longer text), and items that a range of hashes is to hold.
CHUNK, RANGE = 4 << 20, 1 << 20
#: Windows that are hashed at once.
SLICE = 1 << 17
CHUNKS = "chunk long, docs binary, lengths binary, texts binary"
SENT = "bucket int, chunk long, keys binary, tags binary, docs binary"
ANSWER = "chunk long, bucket int, codes binary"
NOTHING, ELSEWHERE, OPEN = 0, 1, 2
_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _ODD2
    return x ^ (x >> np.uint64(32))


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = _mixed(left[: len(right)]) + right
    return x ^ (x >> np.uint64(31))  # else parts of one length could change places


def hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every window of ``width`` bytes, from hashes of its parts of 1, 2, 4, .. bytes."""
    part, whole, at = (data.astype(np.uint64) + np.uint64(1)) * _ODD, None, 0
    for bit in range(width.bit_length()):
        if width >> bit & 1:
            whole = part if whole is None else _joined(whole, part[at:])
            at += 1 << bit
        if width >> (bit + 1):
            part = _joined(part, part[1 << bit:])
    return whole[: len(data) - width + 1]


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` consecutive values."""
    span = 1
    while 2 * span <= n:
        values, span = np.minimum(values[: len(values) - span], values[span:]), 2 * span
    return values if span == n else np.minimum(values[: len(values) - (n - span)], values[n - span:])


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by ``keys`` (the first leads) and where each group of equal ones starts in it."""
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(new)


@dataclass
class Chunk:
    """The windows of a chunk's texts, in runs of equal digits."""

    docs: np.ndarray  # by text
    ends: np.ndarray  # by text, in bytes of the chunk
    data: np.ndarray
    digit: np.ndarray  # by window
    window: np.ndarray  # by window
    first: np.ndarray  # by run: its first and last window
    last: np.ndarray

    @classmethod
    def of(cls, docs: bytes, lengths: bytes, texts: bytes, width: int) -> Chunk:
        size = np.frombuffer(lengths, np.int64)
        data, ends, gram = np.frombuffer(zlib.decompress(texts), np.uint8), np.cumsum(size), width // 2
        n = max(0, len(data) - width + 1)
        digit, window = np.empty(n, np.uint64), np.empty(n, np.uint64)
        for lo in range(0, n, SLICE):
            piece = data[lo:lo + SLICE + width - 1]
            window[lo:lo + SLICE] = hashes(piece, width)
            digit[lo:lo + SLICE] = _mixed(least_of(_mixed(hashes(piece, gram)), width - gram + 1))
        inside = np.zeros(len(data) + 1, np.int8)
        whole = size >= width
        np.add.at(inside, (ends - size)[whole], 1)
        np.add.at(inside, (ends - width + 1)[whole], -1)
        inside = np.cumsum(inside[:n], dtype=np.int8).astype(bool)
        # two texts' windows never adjoin: the last width - 1 bytes of a text begin none
        before = np.zeros(n, bool)
        before[1:] = inside[:-1] & (digit[1:] == digit[:-1])
        first = np.flatnonzero(inside & ~before)
        after = np.zeros(n, bool)
        after[:-1] = before[1:] & inside[1:]
        last, most = np.flatnonzero(inside & ~after), width - gram + 1
        parts = (last - first) // most + 1  # text of short period has long runs
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = np.repeat(first, parts) + step * most
        return cls(np.frombuffer(docs, np.int64), ends, data, digit, window, begin, np.minimum(begin + most - 1, np.repeat(last, parts)))

    def doc_at(self, windows: np.ndarray) -> np.ndarray:
        return self.docs[np.searchsorted(self.ends, windows, side="right")]

    def digits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs in the order of their digits, where each group starts, and the groups' digits (rising)."""
        order, starts = grouped(self.digit[self.first])
        return order, starts, self.digit[self.first][order[starts]]


@dataclass
class Items:
    """Items that a chunk sends, with ``keys`` rising, and for each of its ``members`` its item and document."""

    keys: np.ndarray
    tags: np.ndarray | None
    docs: np.ndarray | None
    members: np.ndarray
    item: np.ndarray
    doc: np.ndarray

    def smaller(self, codes: np.ndarray) -> np.ndarray:
        """The members for which a smaller document holds the same."""
        return self.members[(codes[self.item] == ELSEWHERE) | (self.doc > self.docs[self.item])]


def digits(chunk: Chunk) -> Items:
    _, _, keys = chunk.digits()
    return Items(keys, None, None, *[np.zeros(0, np.int64)] * 3)


def shared_runs(chunk: Chunk, codes: np.ndarray) -> Items:
    """The digits that more than one document has, with the text of their runs; no tag (0): they have several."""
    order, starts, keys = chunk.digits()
    empty = np.zeros(0, np.int64)
    if not len(keys):
        return Items(keys, keys, empty, empty, empty, empty)
    doc = chunk.doc_at(chunk.first)[order]
    ends = _mixed(_mixed(chunk.window[chunk.first]) + chunk.window[chunk.last])
    text = (_mixed(ends + (chunk.last - chunk.first).astype(np.uint64) * _ODD) | np.uint64(1))[order]
    least, most = np.minimum.reduceat(doc, starts), np.maximum.reduceat(doc, starts)
    tag = np.minimum.reduceat(text, starts)
    tag[np.maximum.reduceat(text, starts) != tag] = 0
    kept = (codes == ELSEWHERE) | (least != most)
    item = np.repeat(np.cumsum(kept) - 1, np.diff(np.append(starts, len(order))))
    here = np.repeat(kept, np.diff(np.append(starts, len(order))))
    return Items(keys[kept], tag[kept], least[kept], order[here], item[here], doc[here])


def open_windows(chunk: Chunk, runs: Items, codes: np.ndarray) -> Items:
    """The single windows of the runs that are open."""
    mine = runs.members[codes[runs.item] == OPEN]
    n = chunk.last[mine] - chunk.first[mine] + 1
    windows = np.repeat(chunk.first[mine] - np.cumsum(n) + n, n) + np.arange(n.sum())
    keys, tags, doc = _mixed(chunk.window[windows]), chunk.digit[windows], chunk.doc_at(windows)
    order, starts = grouped(keys, tags)
    if not len(starts):
        return Items(keys, tags, doc, windows, windows, doc)
    item = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    return Items(keys[order[starts]], tags[order[starts]], np.minimum.reduceat(doc[order], starts), windows[order], item, doc[order])


def removed(chunk: Chunk, codes: list[np.ndarray]) -> np.ndarray:
    """For each byte, whether a window that a smaller document holds covers it."""
    width = len(chunk.data) - len(chunk.window) + 1
    runs = shared_runs(chunk, codes[0])
    singles = open_windows(chunk, runs, codes[1])
    sure = runs.smaller(np.where(codes[1] == OPEN, NOTHING, codes[1]))
    sure = sure[~np.isin(sure, runs.members[codes[1][runs.item] == OPEN], assume_unique=True)] if len(sure) else sure
    edge = np.zeros(len(chunk.data) + 1, np.int64)
    np.add.at(edge, chunk.first[sure], 1)
    np.add.at(edge, chunk.last[sure] + width, -1)
    single = singles.smaller(codes[2])
    np.add.at(edge, single, 1)
    np.add.at(edge, single + width, -1)
    return np.cumsum(edge[:-1]) > 0


def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, docs, texts, size = TaskContext.get().partitionId() << 32, [], [], 0

    def out() -> pa.RecordBatch:
        lengths = np.array([len(t) for t in texts], np.int64).tobytes()
        row = [number, np.array(docs, np.int64).tobytes(), lengths, zlib.compress(b"".join(texts), 1)]
        return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), *[pa.array([x], pa.binary()) for x in row[1:]]], names=["chunk", "docs", "lengths", "texts"])

    for batch in batches:
        for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text")):
            text = (text.as_py() or "").encode()
            if texts and size + len(text) > CHUNK:
                yield out()
                number, docs, texts, size = number + 1, [], [], 0
            docs.append(doc)
            texts.append(text)
            size += len(text)
    if texts:
        yield out()


def codes_of(lists: list[dict] | None) -> np.ndarray:
    """The answers to a chunk's items, in the items' order."""
    return np.frombuffer(b"".join(zlib.decompress(x["codes"]) for x in lists or []), np.uint8)


def sender(width: int, ranges: int, step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs the items of a pass by range of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.of(row["docs"], row["lengths"], row["texts"], width)
                items = digits(chunk) if step == 1 else shared_runs(chunk, codes_of(row["answer1"]))
                items = open_windows(chunk, items, codes_of(row["answer2"])) if step == 3 else items
                bucket = (items.keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                bounds = np.searchsorted(bucket, np.arange(ranges + 1, dtype=np.uint64))
                some = np.flatnonzero(np.diff(bounds))
                cut = lambda a: pa.array([a[bounds[b]:bounds[b + 1]].tobytes() for b in some], pa.binary()) if a is not None else pa.nulls(len(some), pa.binary())
                keys = items.keys.astype(np.uint32) if step == 1 else items.keys
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([row["chunk"]] * len(some), pa.int64()), cut(keys), cut(items.tags), cut(items.docs)], names=["bucket", "chunk", "keys", "tags", "docs"])

    return run


def answered(step: int) -> Callable[[pa.Table], pa.Table]:
    """Codes for the items of all chunks in a range of keys."""

    def run(table: pa.Table) -> pa.Table:
        joined = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
        keys = joined("keys", np.uint32 if step == 1 else np.uint64)
        sizes = np.array([len(x) for x in table.column("keys").to_pylist()]) // keys.itemsize
        tags, docs = (None, None) if step == 1 else (joined("tags", np.uint64), joined("docs", np.int64))
        order, starts = grouped(keys, tags) if step == 3 else grouped(keys)
        n = np.diff(np.append(starts, len(order)))
        if step == 1:
            code = np.repeat(np.where(n > 1, ELSEWHERE, NOTHING), n)
        else:
            code = np.where(docs[order] > np.repeat(np.minimum.reduceat(docs[order], starts), n), ELSEWHERE, NOTHING)
        if step == 2:
            low, high = (np.repeat(f.reduceat(tags[order], starts), n) for f in (np.minimum, np.maximum))
            code[(low != high) | (low == 0)] = OPEN
        codes = np.empty(len(order), np.uint8)
        codes[order] = code
        packed = [zlib.compress(x.tobytes(), 1) for x in np.split(codes, np.cumsum(sizes)[:-1])]
        return pa.table([table.column("chunk"), table.column("bucket"), pa.array(packed, pa.binary())], names=["chunk", "bucket", "codes"])

    return run


def with_answers(docs: DataFrame, width: int) -> DataFrame:
    """Chunks with the answers to all three passes."""
    spark = docs.sparkSession
    rows = docs.select(doc_of(F.col("doc_id")).alias("doc"), "text")
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (8 * CHUNK) + 1)
    ranges = max(buckets, size // 8 // RANGE + 1)  # about one window in twelve begins a run
    name = f"chunks_{uuid.uuid4().hex}"
    rows.mapInArrow(chunked, CHUNKS).write.bucketBy(buckets, "chunk").option("path", new_path(spark, "chunks")).saveAsTable(name)
    chunks = spark.table(name)
    for step in (1, 2, 3):
        sent = chunks.mapInArrow(sender(width, ranges, step), SENT)
        answer = stored(sent.groupBy("bucket").applyInArrow(answered(step), ANSWER), f"answer{step}")
        lists = answer.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "codes"))).alias(f"answer{step}"))
        chunks = chunks.join(lists, "chunk", "left")
    return chunks


def each_text(chunks: DataFrame, width: int, of: Callable[[bytes, np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Rows that ``of`` makes of each text's bytes and marks of what goes, after the text's doc."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk.of(row["docs"], row["lengths"], row["texts"], width)
                gone = removed(chunk, [codes_of(row[f"answer{s}"]) for s in (1, 2, 3)]) if len(chunk.window) else np.zeros(len(chunk.data), bool)
                begin = np.append(0, chunk.ends[:-1])
                rows = [(doc, *r) for doc, a, b in zip(chunk.docs.tolist(), begin, chunk.ends) for r in of(chunk.data[a:b], gone[a:b])]
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=to_arrow(schema))

    return chunks.mapInArrow(run, schema).withColumn("doc_id", F.when(F.col("doc") != doc_of(F.lit(None)), F.col("doc")))


def to_arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(","))])


def spans_of(gone: np.ndarray) -> np.ndarray:
    """(start, end) of the maximal runs of removed bytes."""
    return np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))).reshape(-1, 2)


def report(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; one row per row of ``docs``."""
    of = lambda data, gone: [(len(data), int(gone.sum()), len(spans_of(gone)), hashlib.sha256(data[~gone].tobytes()).hexdigest())]
    out = each_text(with_answers(docs, width), width, of, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def removed_spans(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, start, end of each maximal run of removed bytes."""
    of = lambda data, gone: [(int(a), int(b)) for a, b in spans_of(gone)]
    return each_text(with_answers(docs, width), width, of, "doc long, start long, end long").select("doc_id", "start", "end")


def kept_bytes(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id and what is left of each text, in bytes, since a span may end inside a character."""
    of = lambda data, gone: [(data[~gone].tobytes(),)]
    return each_text(with_answers(docs, width), width, of, "doc long, kept binary").select("doc_id", "kept")


def op13_suffix_windows(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, encode(coalesce(text, '')) AS x FROM documents),
p AS (SELECT doc_id, r, x, unnest(range(octet_length(x))) AS p FROM d),
b AS (SELECT doc_id, r, p, x[p + 1:p + 1] AS byte, CASE WHEN p + 50 <= octet_length(x) THEN x[p + 1:p + 50] END AS s FROM p),
m AS (SELECT s, min(doc_id) AS least FROM b WHERE s IS NOT NULL GROUP BY s HAVING min(doc_id) < max(doc_id)),
g AS (SELECT b.r, b.p, b.byte, CASE WHEN b.doc_id > m.least THEN b.p END AS start FROM b LEFT JOIN m ON b.s = m.s),
c AS (SELECT r, p, byte, coalesce(p - max(start) OVER (PARTITION BY r ORDER BY p ROWS UNBOUNDED PRECEDING) < 50, false) AS gone FROM g),
e AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY r ORDER BY p) AS begins FROM c),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(hex(byte), '' ORDER BY p) FILTER (NOT gone) AS kept FROM e GROUP BY r)
SELECT d.doc_id, octet_length(d.x) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN k ON d.r = k.r
"""
