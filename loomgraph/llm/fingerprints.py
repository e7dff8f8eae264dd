"""Operator 9: document fingerprints from statistically improbable features.

Features are windows of 32 bytes. Each window's Shannon entropy, in steps of 1/16 bit, is looked up
in the corpus: the rarer a window's entropy among all windows of all documents, the better its rank.
A window is selected if it has the best rank in at least ``POPULAR`` of the ``NEAR`` neighbourhoods
of as many windows that hold it. Selected features go into Bloom filters of 256 bytes, up to ``PER_FILTER``
each, chained in text order. The likeness of two digests compares their filters' common bits with
those that chance and full agreement would give.

The whole corpus is scanned twice: once for the entropy histogram (a row of 81 counts per task),
once for the digests. For the second scan, documents travel once, compressed, to the task of their
doc_id range; the first document of each range also goes to the range before, so every document
meets its successor in order of doc_id.

Every text is read between ``MARGIN`` filler bytes on each side, so that one rule holds for all
lengths: a window has at least 12 bytes of the text, or all of a shorter one. A text of under some 50
bytes has one or two features, so any edit may change all of them.

Defined results: a null text is empty; if no window of a text is selected, its best is; the empty text
has the empty fingerprint, alike 1 to itself and 0 to others; a very long text is read in overlapping
pieces with the same result; repeated rows are compared with each other as successors; null doc_ids
come first and equal doc_ids go by the text's digest, then arbitrarily between equal rows; a single
row is its own successor; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_key

WINDOW, NEAR, POPULAR = 32, 24, 6
MARGIN, FILLER = 20, b"\xff"  # no byte of UTF-8
FILTER_BYTES, PER_FILTER, HASHES = 256, 128, 5
LEVELS = 5 * 16 + 1
#: Bytes of text worked on at once; a longer text is worked on in overlapping pieces.
PIECE = 256 << 10
COMPARED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

#: c log2 c in whole units, so that running sums are exact wherever a text lies.
_UNIT = 1 << 24
_PHI = np.rint(np.array([0.0] + [c * np.log2(c) for c in range(1, WINDOW + 1)]) * _UNIT).astype(np.int64)
_STEP = np.diff(_PHI)  # what the c-th equal byte adds
_rng = np.random.default_rng(9)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_levels(raw: np.ndarray) -> np.ndarray:
    """Entropy level of the window that begins at each byte (len(raw) - 31 of them)."""
    n = len(raw)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)  # equal bytes among the 31 before, after
    for d in range(1, WINDOW):
        same = (raw[d:] == raw[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    first = np.bincount(raw[:WINDOW], minlength=256)
    change = _STEP[before[WINDOW:]] - _STEP[after[: n - WINDOW]]
    total = np.concatenate([[_PHI[first].sum()], change]).cumsum()
    return np.clip(np.rint((5 - total / (WINDOW * _UNIT)) * 16), 0, LEVELS - 1).astype(np.uint8)


def pieces(texts: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int]]]]:
    """(bytes, [(text, begin, end)]): texts with margins joined to about PIECE bytes; a longer text comes alone."""
    held, spans, size, margin = [], [], 0, FILLER * MARGIN
    for i, t in enumerate(texts):
        if not t:
            continue
        t = margin + t + margin
        if size and size + len(t) > PIECE:
            yield b"".join(held), spans
            held, spans, size = [], [], 0
        held.append(t)
        spans.append((i, size, size + len(t)))
        size += len(t)
    if size:
        yield b"".join(held), spans


def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows per entropy level over all texts of the task."""
    counts = np.zeros(LEVELS, np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            texts = [(t or "").encode() for t in batch.column("text").slice(at, 200).to_pylist()]
            for data, spans in pieces(texts):
                raw = np.frombuffer(data, np.uint8)
                if len(spans) == 1 and len(raw) > 2 * PIECE:
                    for a in range(0, len(raw) - WINDOW + 1, PIECE):
                        counts += np.bincount(window_levels(raw[a: a + PIECE + WINDOW - 1]), minlength=LEVELS)
                    continue
                levels = window_levels(raw)
                for _, a, b in spans:
                    counts += np.bincount(levels[a: b - WINDOW + 1], minlength=LEVELS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS, dtype=np.int32)), pa.array(counts)], names=["level", "n"])


def ranks_of(counts: np.ndarray) -> np.ndarray:
    """Rank of each level, the rarest first; levels that no window has come last."""
    order = sorted(range(LEVELS), key=lambda x: (counts[x] == 0, counts[x], x))
    ranks = np.empty(LEVELS, np.uint32)
    ranks[order] = np.arange(LEVELS)
    return ranks


def selected(raw: np.ndarray, spans: list[tuple[int, int, int]], ranks: np.ndarray) -> list[np.ndarray]:
    """Places of the selected windows of each span."""
    rank = ranks[window_levels(raw)]
    found = []
    for _, a, b in spans:
        n = b - WINDOW + 1 - a
        key = (rank[a: a + n].astype(np.int64) << 40) + np.arange(n)
        span = min(NEAR, n)
        least, width = key, 1
        while width < span:  # minimum over `span` neighbours, by doubling
            step = min(width, span - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        best = np.bincount(least & ((1 << 40) - 1), minlength=n)
        popular = np.flatnonzero(best >= POPULAR)
        found.append(popular if len(popular) else np.array([key.argmin()]))
    return found


def feature_hashes(raw: np.ndarray, places: np.ndarray) -> np.ndarray:
    powers = np.cumprod(np.full(WINDOW, _ODD, np.uint64))
    return mixed((_BYTE[raw[places[:, None] + np.arange(WINDOW)]] * powers).sum(axis=1))


def filters_of(features: np.ndarray) -> np.ndarray:
    """Chained Bloom filters (bits), as few as hold the distinct features in order."""
    _, first = np.unique(features, return_index=True)
    features = features[np.sort(first)]
    count = -(-len(features) // PER_FILTER)
    bits = np.zeros((count, FILTER_BYTES * 8), bool)
    low, high = features & np.uint64(0xFFFFFFFF), features >> np.uint64(32) | np.uint64(1)
    which = np.arange(len(features)) // PER_FILTER
    for k in range(HASHES):
        bits[which, ((low + np.uint64(k) * high) % np.uint64(FILTER_BYTES * 8)).astype(np.int64)] = True
    return bits


def fingerprints(texts: list[bytes], ranks: np.ndarray) -> list[np.ndarray]:
    """The filters of each text, as bits."""
    found: list[np.ndarray | None] = [None] * len(texts)
    for data, spans in pieces(texts):
        raw = np.frombuffer(data, np.uint8)
        if len(spans) == 1 and len(raw) > 2 * PIECE:
            # overlapping pieces: each place is chosen where all its neighbourhoods are whole
            features, reach = [], WINDOW + 2 * NEAR
            for a in range(0, len(raw), PIECE):
                lo, hi = max(0, a - reach), min(len(raw), a + PIECE + reach)
                if hi - lo >= WINDOW:
                    at = selected(raw[lo:hi], [(0, 0, hi - lo)], ranks)[0] + lo
                    features.append(feature_hashes(raw, at[(at >= a) & (at < a + PIECE)]))
            places = [np.concatenate(features)]
        else:
            chosen = selected(raw, spans, ranks)
            starts = np.concatenate([p + a for p, (_, a, _) in zip(chosen, spans)])
            places = np.split(feature_hashes(raw, starts), np.cumsum([len(p) for p in chosen])[:-1])
        for (i, _, _), features in zip(spans, places):
            found[i] = filters_of(features)
    return [filters_of(np.empty(0, np.uint64)) if f is None else f for f in found]


def encoded(bits: np.ndarray) -> str:
    return base64.b64encode(np.packbits(bits, axis=1).tobytes()).decode() if len(bits) else ""


def decoded(fingerprint: str) -> np.ndarray:
    return np.unpackbits(np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, FILTER_BYTES), axis=1).astype(bool)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1. Each filter of the shorter digest counts with its best match in the other: its common
    bits beyond those expected by chance, over the most that there could be."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    m, best = a.shape[1], np.zeros(len(a))
    na, nb = a.sum(axis=1).astype(float), b.sum(axis=1).astype(float)
    common = a.astype(np.float32) @ b.T.astype(np.float32)
    chance, most = np.outer(na, nb) / m, np.minimum(na[:, None], nb[None, :])
    spread = np.sqrt(chance * (1 - na / m)[:, None] * (1 - nb / m)[None, :])
    least = chance + 3 * spread  # below that, agreement says nothing
    best = np.where(most > least, (common - least) / np.maximum(most - least, 1e-9), (common >= most).astype(float)).max(axis=1)
    return float(np.clip(best, 0, 1) @ na / na.sum())


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(ranks: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows sorted by (part, ahead, order): each row that isn't ahead, compared with the one behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        held: list[tuple] = []

        def done(last: bool) -> Iterator[pa.RecordBatch]:
            """Compares every held row with the next one; the last row waits unless it is the end."""
            pairs = [(x, y) for x, y in zip(held, held[1:]) if not x[2] and x[0] == y[0]]
            if pairs:
                own = [x[3].encode() for x, _ in pairs]
                changed = [edited(x[3], y[3]) for x, y in pairs]
                prints = fingerprints([*own, *(t.encode() for t in changed), *(y[3].encode() for _, y in pairs)], ranks)
                n = len(pairs)
                mine, theirs, following = prints[:n], prints[n: 2 * n], prints[2 * n:]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([x[1] for x, _ in pairs], pa.int64()), "n_chars": pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
                    "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed], "fingerprint": [encoded(p) for p in mine], "edited_fingerprint": [encoded(p) for p in theirs],
                    "near_edited": [likeness(a, b) for a, b in zip(mine, theirs)], "near_next": [likeness(a, b) for a, b in zip(mine, following)],
                })
            del held[:-1]

        size = 0
        for batch in batches:
            for part, doc_id, ahead, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ahead", "packed"))):
                if ahead and held and held[-1][2] and held[-1][0] == part:
                    continue  # the first row ahead is the successor; others equal its key
                text = unpack.decompress(packed).decode() if packed else ""
                held.append((part, doc_id, ahead, text))
                size += len(text)
                if size > 2_000_000:
                    yield from done(False)
                    size = 0
        yield from done(True)

    return run


def dealt(bounds: list[tuple]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compressed texts with their part; rows equal to a part's first key go ahead to the part before, too."""
    ids, marks = np.array([b[0] for b in bounds], np.int64), np.array([b[1] for b in bounds], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                key, mark = np.asarray(rows.column("key")), np.asarray(rows.column("mark"))
                packed = [pack.compress(t.encode()) if t else b"" for t in rows.column("text").to_pylist()]
                low, high = np.searchsorted(ids, key, "left"), np.searchsorted(ids, key, "right")
                part = np.array([a + int(np.searchsorted(marks[a:b], m, "right")) for a, b, m in zip(low, high, mark)]) - 1
                first = np.flatnonzero((ids[part] == key) & (marks[part] == mark))
                take = np.concatenate([np.arange(len(key)), first])
                where = np.concatenate([part, (part[first] - 1) % len(ids)]).astype(np.int32)
                ahead = np.repeat([False, True], [len(key), len(first)])
                yield pa.RecordBatch.from_pydict({"part": where, "key": key[take], "mark": mark[take], "ahead": ahead, "doc_id": rows.column("doc_id").take(pa.array(take)), "packed": pa.array([packed[i] for i in take], pa.binary())})

    return run


def corpus_ranks(docs: DataFrame) -> np.ndarray:
    """Ranks of the entropy levels, from all windows of all documents."""
    counts = np.zeros(LEVELS, np.int64)
    for r in docs.select("text").mapInArrow(histogram, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():  # LEVELS rows
        counts[r["level"]] = r["n"]
    return ranks_of(counts)


def report(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), text_key(F.col("text")).alias("mark"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the least key of each range: two ranges for each partition of the scan, so that a task's share stays the same
    scanned = docs.select(F.spark_partition_id().alias("p")).distinct().count()
    keys = rows.select("key", "mark").repartitionByRange(max(1, 2 * scanned), "key", "mark")
    bounds = sorted((r["b"]["key"], r["b"]["mark"]) for r in keys.groupBy(F.spark_partition_id()).agg(F.min(F.struct("key", "mark")).alias("b")).collect())
    if not bounds:
        return docs.sparkSession.createDataFrame([], COMPARED)
    parts = rows.mapInArrow(dealt(bounds), "part int, key long, mark long, ahead boolean, doc_id long, packed binary")
    parts = parts.repartitionById(len(bounds), F.col("part")).sortWithinPartitions("part", "ahead", "key", "mark")
    return parts.select("part", "doc_id", "ahead", "packed").mapInArrow(compared(corpus_ranks(docs)), COMPARED)


def op9_fingerprints(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
