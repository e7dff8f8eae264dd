"""Operator 8: line dedup by range-partitioned line hashes.

A line's key is the line without white space at its ends, A-Z in lower case; its 128-bit hash stands
for it. (hash, document, line number) rows are range-partitioned by hash with a secondary sort by
document, so one very common line spreads over several partitions. Each task streams its runs of
equal hashes: runs inside the partition are decided on the spot. The first and last run, which may
continue next door, give their lines and a summary each: largest and smallest document and how many
there are. A hash's summaries decide on its lines; there are as many as partitions that it reaches.
The decisions become one compressed bitmap of kept lines per document; texts never enter that shuffle,
and only texts that lose lines meet their bitmap in one.

A key of at least ``shortest`` code points found in at least ``documents`` documents loses all its
lines except in the largest doc_id that holds it.

Defined results: a null or empty text is one empty line; rows with the same doc_id count as one
document; rows with null doc_ids count as one document, smaller than all others; repeated rows lose
the same lines; a very long text is one row with many lines; an empty table gives an empty result;
other columns, whatever their names, are ignored by the report and kept by the filter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_ids, stored, text_key

SPACE = "\t\n\v\f\r "
NO_ID = -(1 << 63)
LINES = "h1 long, h2 long, doc long, row long, line int"
#: Lines, and summaries of open runs (no line; doc is the largest of the run, last the smallest, docs their number).
FOUND = "h1 long, h2 long, doc long, row long, line int, open boolean, last long, docs long"
#: Decisions on open runs that are broadcast; beyond, they are joined.
MOST_DECIDED = 500_000


def lines_of(shortest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            docs, rows, texts = (batch.column(c).to_pylist() for c in ("doc", "row", "text"))
            digest, at, numbers = [], [], []
            for i, text in enumerate(texts):
                for k, line in enumerate((text or "").split("\n")):
                    key = line.strip(SPACE)
                    if len(key) >= shortest:
                        digest.append(xxhash.xxh3_128_digest(key.encode().lower()))  # bytes.lower changes A-Z only
                        at.append(i)
                        numbers.append(k)
            pair = np.frombuffer(b"".join(digest), dtype="<i8").reshape(-1, 2)
            at = np.array(at, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(np.array(docs, np.int64)[at]), pa.array(np.array(rows, np.int64)[at]), pa.array(np.array(numbers, np.int32))], names=["h1", "h2", "doc", "row", "line"])

    return run


def runs(documents: int, most_held: int = 1_000_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows sorted by (hash, document falling): the lines to drop, and all lines of open runs.

    A run is open if it is the first or last of its partition, or too long to be held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "doc", "row", "line", "open", "last", "docs"]
        held: list[list[np.ndarray]] = []  # the run that goes on, in pieces
        key: tuple[int, int] | None = None
        is_open = True  # of the held run

        def out(cols: list[np.ndarray], undecided: bool) -> pa.RecordBatch:
            n = len(cols[0])
            return pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.full(n, undecided)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)

        def summary() -> pa.RecordBatch:
            docs = np.concatenate([piece[2] for piece in held])
            row = {"h1": held[0][0][0], "h2": held[0][1][0], "doc": docs[0], "row": None, "line": None, "open": True, "last": docs[-1], "docs": 1 + int((docs[1:] != docs[:-1]).sum())}
            return pa.RecordBatch.from_arrays([pa.array([row[c]], kind) for c, kind in zip(names, [pa.int64()] * 4 + [pa.int32(), pa.bool_(), pa.int64(), pa.int64()])], names=names)

        def decided(cols: list[np.ndarray], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Drops of whole runs. A run's first row has its largest document, rows of one document are adjacent."""
            n = len(cols[2])
            which = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
            new = np.ones(n, bool)
            new[1:] = (cols[2][1:] != cols[2][:-1]) | (which[1:] != which[:-1])
            drop = (np.add.reduceat(new.astype(np.int64), starts)[which] >= documents) & (cols[2] != cols[2][starts][which])
            if drop.any():
                yield out([c[drop] for c in cols], False)

        def closed(undecided: bool) -> Iterator[pa.RecordBatch]:
            if undecided and held:
                yield from (out(piece, True) for piece in held)
                yield summary()
            elif held:
                yield from decided([np.concatenate(c) for c in zip(*held)], np.array([0]))

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(c)) for c in names[:5]]
            bounds = [0, *(np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])) + 1).tolist(), batch.num_rows]
            if key is not None and key != (cols[0][0], cols[1][0]):
                yield from closed(is_open)
                held, is_open = [], False
            held.append([c[: bounds[1]] for c in cols])
            if len(bounds) > 2:  # that run ends here; those between it and the last one are decided at once
                yield from closed(is_open)
                lo, hi = bounds[1], bounds[-2]
                if hi > lo:
                    yield from decided([c[lo:hi] for c in cols], np.array(bounds[1:-2]) - lo)
                held, is_open = [[c[hi:] for c in cols]], False
            elif sum(len(piece[0]) for piece in held) > most_held:
                yield from closed(True)
                held, is_open = [], True
            key = (cols[0][-1], cols[1][-1])
        yield from closed(True)

    return run


def dropped_lines(docs: DataFrame, shortest: int = 20, documents: int = 3) -> DataFrame:
    """(doc, row, line) of every line that goes; doc is doc_id (the least long for null), row the text's digest."""
    rows = docs.select(doc_of(F.col("doc_id")).alias("doc"), text_key(F.col("text")).alias("row"), "text")
    lines = stored(rows.mapInArrow(lines_of(shortest), LINES), "hashes")  # range partitioning reads them twice
    ordered = lines.repartitionByRange("h1", "h2", F.desc("doc"), "row", "line").sortWithinPartitions("h1", "h2", F.desc("doc"), "row", "line")
    found = stored(ordered.mapInArrow(runs(documents), FOUND), "lines")
    # a document that goes on in the next run of its hash is counted in both
    of_hash = F.sort_array(F.collect_list(F.struct("doc", "last", "docs")), asc=False)
    shared = F.size(F.filter(F.sequence(F.lit(1), F.size("s") - 1, F.lit(1)), lambda i: F.col("s")[i - 1]["last"] == F.col("s")[i]["doc"]))
    shared = F.when(F.size("s") > 1, shared).otherwise(0)
    per = found.where("open and line is null").groupBy("h1", "h2").agg(of_hash.alias("s")).select("h1", "h2", (F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["docs"]) - shared).alias("n"), F.col("s")[0]["doc"].alias("keeper"))
    per = stored(per.where(F.col("n") >= documents).drop("n"), "decided")
    hint = F.broadcast if per.count() <= MOST_DECIDED else (lambda df: df)
    decided = found.where("open and line is not null").join(hint(per), ["h1", "h2"]).where(F.col("doc") != F.col("keeper"))
    return found.where("not open").select("doc", "row", "line").unionByName(decided.select("doc", "row", "line"))


def doc_of(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def packed(numbers) -> bytes:
    """Compressed bitmap with a bit for every line up to the last dropped one; 0: dropped."""
    bits = np.ones(int(max(numbers)) + 1, dtype=bool)
    bits[np.asarray(numbers)] = False
    return zlib.compress(np.packbits(bits).tobytes() + bytes([len(bits) % 8]), 6)


def bitmaps_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = [packed(x) for x in batch.column("lines").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), pa.array(keep, pa.binary())], names=["doc", "row", "keep"])


def keep_bitmaps(docs: DataFrame, shortest: int = 20, documents: int = 3) -> DataFrame:
    """(doc, row, keep) for the documents that lose lines; see :func:`kept_text` for its reading."""
    gone = dropped_lines(docs, shortest, documents)
    per = gone.groupBy("doc", "row").agg(F.collect_set("line").alias("lines"))
    return per.mapInArrow(bitmaps_of, "doc long, row long, keep binary")


def kept_text(text: str | None, keep: bytes | None) -> tuple[str, int, int]:
    """The text without the dropped lines; its lines before, and how many went."""
    lines = (text or "").split("\n")
    if keep is None:
        return text or "", len(lines), 0
    raw = zlib.decompress(keep)
    bits = np.unpackbits(np.frombuffer(raw[:-1], np.uint8))
    bits = bits[: len(bits) - (8 - raw[-1]) % 8]
    stay = [x for x, k in zip(lines, bits) if k] + lines[len(bits):]
    return "\n".join(stay), len(lines), len(lines) - len(stay)


def with_bitmaps(docs: DataFrame, shortest: int, documents: int) -> tuple[DataFrame, DataFrame]:
    """The documents, their columns numbered c0 on, that lose no line, and those that may with ``keep``."""
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    bitmaps = stored(keep_bitmaps(docs, shortest, documents), "bitmaps")
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()], doc_of(F.col("doc_id")).alias("doc"))
    some = by_ids(rows, bitmaps.select("doc"), key="doc").withColumn("row", text_key(F.col(at["text"])))
    rest = by_ids(rows, bitmaps.select("doc"), held=False, key="doc").drop("doc")
    return rest, some.join(bitmaps, ["doc", "row"], "left").drop("doc", "row")


def reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [kept_text(t, k) for t, k in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist())]
        sha = [hashlib.sha256(t.encode()).hexdigest() for t, _, _ in found]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([d for _, _, d in found], pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def report(docs: DataFrame, shortest: int = 20, documents: int = 3) -> DataFrame:
    rest, some = with_bitmaps(docs.select("doc_id", "text"), shortest, documents)
    rows = rest.withColumn("keep", F.lit(None).cast("binary")).unionByName(some).withColumnsRenamed({"c0": "doc_id", "c1": "text"})
    return rows.mapInArrow(reported, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def without_repeated_lines(docs: DataFrame, shortest: int = 20, documents: int = 3) -> DataFrame:
    """The documents with their repeated lines taken out, all columns kept."""

    @F.pandas_udf("string")
    def kept(text, keep):
        import pandas as pd

        return pd.Series([t if k is None else kept_text(t, k)[0] for t, k in zip(text, keep)])

    rest, some = with_bitmaps(docs, shortest, documents)
    text = f"c{docs.columns.index('text')}"
    both = rest.unionByName(some.withColumn(text, kept(text, "keep")).drop("keep"))
    return both.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, r, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM d),
k AS (SELECT *, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.keeper AS gone FROM k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""
