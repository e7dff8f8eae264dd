"""Operator 5: quality classifier by an interpolated modified Kneser-Ney n-gram model.

The model is over characters: n-grams of ``ORDER`` Unicode code points, none folded, so its alphabet
is open and its tables grow with the trusted text (labelled quality 1 and not toxic; a quarter of it,
by digest, is held out and only sets thresholds). The tables are sharded by n-gram: raw counts of the
highest order, and per lower order the numbers of distinct left extensions; histories' totals and
back-off masses come from aggregations over them. Nothing of the model is collected but the numbers
of n-grams seen once to four times per order, from which the discounts follow.

Documents are cut into parts by file and row number. Each part's distinct n-grams are listed in its
task (so a frequent n-gram counts once a part, not once a use), dealt into buckets (one for ``BUCKET_TEXT`` bytes of text, ``BUCKETS`` at least) by a digest and
packed. The distinct ones of all parts are joined with the shards of every order; per bucket, the
resulting losses meet the parts' lists and go back to the parts, where they meet the documents'
compressed texts. That is the only shuffle of texts; a task streams them and holds the losses of one
part's n-grams. A bucket of many parts is split by part (``BUCKET_PARTS``), and a price goes only where it
is listed.

Two rates decide. The loss per character, over all characters, is high for nonsense. The loss per
character that a cache of the last ``CACHE`` places leaves (an n-gram seen there costs nothing) is low
for repetition. Each is drawn to its language's median by ``SHRINK`` characters, so that a few
characters don't decide, and must lie within a quantile of the trusted documents of the language,
widened by ``MARGIN``. Quantiles come from exact histograms of rates in steps of ``STEP``, so reruns
agree however rows are dealt.

Defined results: a null, empty or blank text has no perplexity and is not kept; a language (null, too)
with fewer than ``FEWEST`` trusted documents goes by all trusted documents' quantiles; labels that
repeat a doc_id count if any says trusted; without trusted text all texts that aren't blank are kept;
repeated rows are judged alike; ties at a threshold are kept; a very long text is worked on in pieces
with the same result; an empty table gives an empty result; other columns, whatever their names, are
ignored by the report and kept by the filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_ids, stored

ORDER = 5
#: Code points, each with the same chance where nothing is known; the place before a text's begin.
SYMBOLS = 0x110000
BEGIN = SYMBOLS
BITS, MASK = 21, (1 << 21) - 1
CACHE = 64
LOW, HIGH, MARGIN, STEP = 0.001, 0.999, 1.05, 0.001
SHRINK, FEWEST = 100.0, 50
#: Rows of a part at most, and bytes of text that its rows have at their mean length.
PART_ROWS, PART_BYTES = 8192, 32 << 20
#: Buckets of n-grams at least, bytes of text for each, and parts whose lists of a bucket meet in one task.
BUCKETS, BUCKET_TEXT, BUCKET_PARTS = 64, 16 << 20, 512
#: Characters worked on at once; a longer text is cut.
PIECE = 1 << 18
LISTED = "part int, bucket int, grams binary"
#: Distinct code points of a piece, so that an n-gram of its own numbers fits 64 bits.
MOST_SYMBOLS = 7131

Span = tuple[int, int, int]


def pieces(texts: list[str]) -> Iterator[list[Span]]:
    """(text, begin, end) of about PIECE characters together."""
    held, size = [], 0
    for i, text in enumerate(texts):
        for a in range(0, len(text), PIECE):
            b = min(len(text), a + PIECE)
            held.append((i, a, b))
            size += b - a
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


class Piece:
    """The n-grams that end at the characters of some spans.

    ``keys`` are the distinct ones, in numbers of the piece's own alphabet; for each character, ``at`` is
    its n-gram's place in ``keys``, ``owner`` its text, and ``recent`` whether the n-gram has occurred in
    the CACHE places before.
    """

    def __init__(self, keys: np.ndarray, at: np.ndarray, owner: np.ndarray, recent: np.ndarray, alphabet: np.ndarray):
        self.keys, self.at, self.owner, self.recent, self.alphabet = keys, at, owner, recent, alphabet

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """(hi, lo): the code points of the distinct n-grams, the last three in lo."""
        points, keys = [], self.keys
        for _ in range(ORDER):
            keys, at = np.divmod(keys, np.uint64(len(self.alphabet)))
            points.append(self.alphabet[at.astype(np.int64)])
        return points[4] << BITS | points[3], points[2] << 2 * BITS | points[1] << BITS | points[0]


def places(keys: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """The place of each key among the sorted distinct ones, by hashed slots; what shares a slot is searched."""
    bits = max(4, int(len(distinct) * 8).bit_length())
    slot = lambda k: (k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
    table = np.zeros(1 << bits, np.int32)
    table[slot(distinct)] = np.arange(len(distinct), dtype=np.int32)
    at = table[slot(keys)]
    other = np.flatnonzero(distinct[at] != keys)
    at[other] = np.searchsorted(distinct, keys[other])
    return at


def grams(texts: list[str], spans: list[Span], cached: bool = True, numbered: bool = True) -> Iterator[Piece]:
    """The spans as one piece, or as several when their alphabet is too large; ``at`` and ``recent`` only on demand."""
    back = [max(0, a - CACHE - ORDER + 1) for _, a, _ in spans]
    cut = [texts[i][c:b] for (i, _, b), c in zip(spans, back)]
    lengths = np.array([len(t) for t in cut])
    which = np.repeat(np.arange(len(cut)), lengths)
    offset = np.arange(len(which)) - (np.cumsum(lengths) - lengths)[which]
    codes = np.full(len(which) + (ORDER - 1) * len(cut), BEGIN, np.int64)
    codes[np.arange(len(which)) + (ORDER - 1) * (which + 1)] = np.frombuffer("".join(cut).encode("utf-32-le"), "<u4")
    table = np.zeros(SYMBOLS + 1, bool)
    table[codes] = True
    alphabet = np.flatnonzero(table)
    if len(alphabet) > MOST_SYMBOLS:
        half = len(spans) // 2
        (i, a, b) = spans[0]
        for part in (spans[:half], spans[half:]) if half else ([(i, a, (a + b) // 2)], [(i, (a + b) // 2, b)]):
            yield from grams(texts, part, cached, numbered)
        return
    number = np.zeros(SYMBOLS + 1, np.uint16)
    number[alphabet] = np.arange(len(alphabet))
    codes = number[codes].astype(np.uint64)
    keys = codes[: len(codes) - ORDER + 1].copy()
    for k in range(1, ORDER):
        keys *= np.uint64(len(alphabet))
        keys += codes[k: len(codes) - ORDER + 1 + k]
    keys = keys[np.arange(len(which)) + (ORDER - 1) * which]
    own = offset >= np.array([a - c for (_, a, _), c in zip(spans, back)])[which]
    if not numbered:
        yield Piece(np.unique(keys[own]), None, None, None, alphabet)
        return
    distinct = np.unique(keys)
    at = places(keys, distinct)
    recent = np.zeros(len(at), bool)
    if cached:
        near = np.minimum(offset, 255).astype(np.uint8)
        for d in range(1, min(CACHE, len(at) - 1) + 1):
            recent[d:] |= (at[d:] == at[:-d]) & (near[d:] >= d)
    at = at[own]
    used = np.bincount(at, minlength=len(distinct)) > 0  # not those before a cut only
    at, distinct = (np.cumsum(used, dtype=np.int32) - 1)[at], distinct[used]
    yield Piece(distinct, at, np.array([i for i, _, _ in spans])[which][own], recent[own], alphabet)


def counting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of each piece of the texts."""
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for spans in pieces(texts):
            for piece in grams(texts, spans, cached=False):
                yield pa.RecordBatch.from_arrays([*map(pa.array, (*piece.words(), np.bincount(piece.at)))], names=["hi", "lo", "n"])


def runs_of(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of runs of rows that agree in the columns."""
    change = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    edges = [0, *(np.flatnonzero(change) + 1).tolist(), len(columns[0])]
    yield from ((a, b) for a, b in zip(edges, edges[1:]) if b > a)


def bucket_of(hi, lo, buckets: int):
    """The bucket of an n-gram, alike for numpy arrays and columns."""
    return (lo % 1_000_003 * 31 + hi % 999_983) % buckets


def packed(hi: np.ndarray, lo: np.ndarray) -> bytes:
    """Sorted distinct n-grams as compressed differences."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([np.diff(hi, prepend=0), lo]).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(grams: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    flat = np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(grams), np.uint8).reshape(8, -1).T).view("<i8").ravel()
    n = len(flat) // 2
    return np.cumsum(flat[:n]), flat[n:]


def distinct(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((lo, hi))
    hi, lo = hi[order], lo[order]
    new = np.append(True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])) if len(hi) else np.empty(0, bool)
    return hi[new], lo[new]


def listing(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of each part's texts by bucket, as far as the part lies in the task's partition."""
    at, held = None, []

    def listed() -> Iterator[pa.RecordBatch]:
        hi, lo = distinct(*(np.concatenate(c) for c in zip(*held)))
        bucket = bucket_of(hi, lo, buckets)
        order = np.argsort(bucket, kind="stable")
        some, edges = np.unique(bucket[order], return_index=True)
        edges = np.append(edges, len(order))
        grams = [packed(hi[order[edges[k]: edges[k + 1]]], lo[order[edges[k]: edges[k + 1]]]) for k in range(len(some))]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), at, np.int32)), pa.array(some, pa.int32()), pa.array(grams, pa.binary())], names=["part", "bucket", "grams"])

    for batch in batches:
        parts, column = np.asarray(batch.column("part")), batch.column("text")
        for a, b in runs_of(parts):
            if held and parts[a] != at:
                yield from listed()
                held = []
            at = parts[a]
            texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
            for spans in pieces(texts):
                held += [piece.words() for piece in grams(texts, spans, numbered=False)]
                if len(held) > 16:  # what is held stays near the number of distinct n-grams
                    held = [distinct(*(np.concatenate(c) for c in zip(*held)))]
    if held:
        yield from listed()


def merging(batches: Iterator[pa.RecordBatch], salted: bool) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of lists sorted by bucket, or by bucket and salt, which comes along."""
    at, held = None, []

    def merged() -> Iterator[pa.RecordBatch]:
        hi, lo = distinct(*(np.concatenate(c) for c in zip(*held)))
        salt = [pa.array(np.full(len(hi), at[1], np.int32))] * salted
        yield pa.RecordBatch.from_arrays([*salt, pa.array(hi), pa.array(lo)], names=["salt"] * salted + ["hi", "lo"])

    for batch in batches:
        salts = batch.column("salt").to_pylist() if salted else [0] * batch.num_rows
        for bucket, salt, grams in zip(batch.column("bucket").to_pylist(), salts, batch.column("grams").to_pylist()):
            if held and (bucket, salt) != at:
                yield from merged()
                held = []
            at = (bucket, salt)
            held.append(unpacked(grams))
            if len(held) > 64:
                held = [distinct(*(np.concatenate(c) for c in zip(*held)))]
    if held:
        yield from merged()


def pricing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (bucket, salt, kind), n-grams with losses before lists: each list with its losses."""
    at, held, table = None, [], None
    for batch in batches:
        keys = [np.asarray(batch.column(c)) for c in ("bucket", "salt", "kind")]
        for a, b in runs_of(*keys):
            if (keys[0][a], keys[1][a]) != at:
                at, held, table = (keys[0][a], keys[1][a]), [], None
            rows = batch.slice(a, b - a)
            if keys[2][a] == 0:
                held.append(tuple(np.asarray(rows.column(c)) for c in ("hi", "lo", "loss")))
                continue
            if table is None:
                table, held = Losses(held), []
            losses = [table.of(*unpacked(g)).astype("<f4").tobytes() for g in rows.column("grams").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("part"), rows.column("grams"), pa.array(losses, pa.binary())], names=["part", "grams", "losses"])


def suffix(k: int) -> tuple[Column, Column]:
    """hi, lo of a k-gram without its first code point."""
    hi, lo = F.col("hi"), F.col("lo")
    none = F.lit(0).cast("long")
    return {5: (hi.bitwiseAND(MASK), lo), 4: (none, lo), 3: (none, lo.bitwiseAND((1 << 2 * BITS) - 1)), 2: (none, lo.bitwiseAND(MASK))}[k]


def history() -> tuple[Column, Column]:
    """hi, lo of an n-gram without its last code point."""
    hi, lo = F.col("hi"), F.col("lo")
    return F.shiftright(hi, BITS), F.shiftleft(hi.bitwiseAND(MASK), 2 * BITS).bitwiseOR(F.shiftright(lo, BITS))


def discounts(counts: DataFrame) -> list[float]:
    """What is taken off counts of 1, 2, and 3 or more, by the numbers of n-grams seen once to four times."""
    seen = {r["n"]: r["k"] for r in counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()}  # at most 4 rows
    n1, n2, n3, n4 = (float(seen.get(i, 0)) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.05), i - 0.05) for i, x in enumerate(d, 1)]


def train(trusted: DataFrame) -> list[tuple[DataFrame, DataFrame]] | None:
    """Per order from 1 on: (hi, lo, n, off) and its histories (hh, hl, total, back); None without text."""
    counts = trusted.select("text").mapInArrow(counting, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))
    levels = []
    for k in range(ORDER, 0, -1):
        counts = stored(counts, f"grams{k}")
        if counts.isEmpty():
            return None
        d = discounts(counts)
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        hh, hl = history()
        per = counts.groupBy(hh.alias("hh"), hl.alias("hl")).agg(F.sum("n").alias("total"), *[F.count_if(c).alias(f"n{i}") for i, c in enumerate((F.col("n") == 1, F.col("n") == 2, F.col("n") > 2), 1)])
        back = (d[0] * F.col("n1") + d[1] * F.col("n2") + d[2] * F.col("n3")) / F.col("total")  # from whole numbers: the same however rows are dealt
        levels.insert(0, (counts.withColumn("off", off), stored(per.select("hh", "hl", "total", back.alias("back")), f"histories{k}")))
        if k > 1:
            sh, sl = suffix(k)
            counts = counts.select(sh.alias("hi"), sl.alias("lo")).groupBy("hi", "lo").agg(F.count("*").alias("n"))
    return levels


def probabilities(levels: list[tuple[DataFrame, DataFrame]], wanted: DataFrame) -> DataFrame:
    """hi, lo, loss for the distinct n-grams ``wanted``, by joins with the counts of every order."""
    needed = {ORDER: wanted}
    for k in range(ORDER, 1, -1):
        sh, sl = suffix(k)
        needed[k - 1] = stored(needed[k].select(sh.alias("hi"), sl.alias("lo")).distinct(), f"needed{k - 1}")
    lower = None
    for k, (counts, histories) in enumerate(levels, 1):
        hh, hl = history()
        rows = needed[k].join(counts, ["hi", "lo"], "left").withColumns({"hh": hh, "hl": hl}).join(histories, ["hh", "hl"], "left")
        if lower is None:
            rows = rows.withColumn("lower", F.lit(1.0 / SYMBOLS))
        else:
            sh, sl = suffix(k)
            rows = rows.withColumns({"sh": sh, "sl": sl}).join(lower.select(F.col("hi").alias("sh"), F.col("lo").alias("sl"), F.col("p").alias("lower")), ["sh", "sl"])
        p = F.coalesce((F.col("n") - F.col("off")) / F.col("total"), F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("lower")
        lower = stored(rows.select("hi", "lo", p.alias("p")), f"probabilities{k}")
    return lower.select("hi", "lo", (-F.log("p")).cast("float").alias("loss"))


class Losses:
    """The losses of a part's n-grams."""

    def __init__(self, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        hi, lo, loss = (np.concatenate(c) for c in zip(*held))
        mark = self.mark(hi, lo)
        order = np.argsort(mark)
        self.marks, self.hi, self.lo, self.loss = mark[order], hi[order], lo[order], loss[order].astype(np.float64)

    @staticmethod
    def mark(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        return lo.astype(np.uint64) ^ hi.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def of(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.marks, self.mark(hi, lo)), len(self.marks) - 1)
        if not ((self.hi[at] == hi) & (self.lo[at] == lo)).all():
            raise ValueError("a part's list of n-grams lacks one of its texts'")
        return self.loss[at]


def text_losses(table: Losses | None, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each text's loss over all characters, and over those that the cache doesn't know."""
    total, fresh = np.zeros(len(texts)), np.zeros(len(texts))
    for spans in pieces(texts):
        for piece in grams(texts, spans):
            loss = table.of(*piece.words())[piece.at]
            total += np.bincount(piece.owner, loss, len(texts))
            fresh += np.bincount(piece.owner, np.where(piece.recent, 0, loss), len(texts))
    return total, fresh


def packing(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            packed = [None if t is None else pack.compress(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(packed, pa.binary())], names=[*columns, "packed"])

    return run


def scoring(columns: list[str], text_at: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows sorted by (part, kind), lists of n-grams with losses before texts: ``columns`` with loss, fresh, chars, blank;
    the text comes back in place ``text_at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        at, held, table = None, [], None
        for batch in batches:
            parts, kinds = np.asarray(batch.column("part")), np.asarray(batch.column("kind"))
            for a, b in runs_of(parts, kinds):
                if parts[a] != at:
                    at, held, table = parts[a], [], None
                if kinds[a] == 0:
                    for grams, losses in zip(*(batch.column(c).slice(a, b - a).to_pylist() for c in ("grams", "losses"))):
                        held.append((*unpacked(grams), np.frombuffer(losses, "<f4")))
                    continue
                if table is None and held:
                    table, held = Losses(held), []
                for c in range(a, b, 256):
                    rows = batch.slice(c, min(256, b - c))
                    texts = [None if x is None else unpack.decompress(x).decode() if x else "" for x in rows.column("packed").to_pylist()]
                    total, fresh = text_losses(table, [t or "" for t in texts])
                    out = [pa.array(texts, pa.string()) if i == text_at else rows.column(n) for i, n in enumerate(columns)]
                    chars, blank = [len(t or "") for t in texts], [not (t and t.strip()) for t in texts]
                    yield pa.RecordBatch.from_arrays([*out, pa.array(total), pa.array(fresh), pa.array(chars, pa.int64()), pa.array(blank)], names=[*columns, "loss", "fresh", "chars", "blank"])

    return run


def located(docs: DataFrame, part_rows: int) -> DataFrame:
    """``docs`` with part: a digest of file and row number, the same in every run; rows without a file are written first."""
    try:
        part = F.hash("_metadata.file_path", F.floor(F.col("_metadata.row_index") / part_rows))
        return docs.select("*", part.alias("part"))
    except AnalysisException:
        return located(stored(docs, "located"), part_rows)


def scored(docs: DataFrame, levels: list[tuple[DataFrame, DataFrame]], columns: list[str], text: str) -> DataFrame:
    """``columns`` of ``docs`` with loss, fresh, chars and blank. Names must not be those of this function's own columns."""
    size, n = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.count("*")).first()
    buckets = max(BUCKETS, size // BUCKET_TEXT + 1)
    placed = located(docs, max(1, min(PART_ROWS, PART_BYTES * n // max(1, size))))
    listed = stored(placed.select("part", F.col(text).alias("text")).mapInArrow(lambda b: listing(b, buckets), LISTED), "listed")
    wanted = listed.select("bucket", "grams").repartition("bucket").sortWithinPartitions("bucket")
    wanted = stored(wanted.mapInArrow(lambda b: merging(b, False), "hi long, lo long"), "wanted")
    salts = -(-listed.select("part").distinct().count() // BUCKET_PARTS)
    prices = probabilities(levels, wanted)
    if salts > 1:  # a price goes to those shares of its bucket's parts that list it
        of_share = listed.select("bucket", F.pmod("part", F.lit(salts)).alias("salt"), "grams").repartition("bucket", "salt").sortWithinPartitions("bucket", "salt")
        prices = prices.join(of_share.mapInArrow(lambda b: merging(b, True), "salt int, hi long, lo long"), ["hi", "lo"])
    else:
        prices = prices.withColumn("salt", F.lit(0))
    prices = prices.select(bucket_of(F.col("hi"), F.col("lo"), buckets).cast("int").alias("bucket"), "salt", F.lit(0).alias("kind"), "hi", "lo", "loss")
    lists = listed.select("bucket", F.pmod("part", F.lit(max(1, salts))).alias("salt"), F.lit(1).alias("kind"), "part", "grams")
    priced = prices.unionByName(lists, allowMissingColumns=True).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "kind")
    losses = priced.mapInArrow(pricing, "part int, grams binary, losses binary").withColumn("kind", F.lit(0))
    others = [c for c in columns if c != text]
    texts = placed.select("part", F.lit(1).alias("kind"), *others, F.col(text).alias("text"))
    schema = texts.select("part", "kind", *others).schema.add("packed", "binary")
    texts = texts.mapInArrow(packing(["part", "kind", *others]), schema)
    both = losses.unionByName(texts, allowMissingColumns=True).repartition("part").sortWithinPartitions("part", "kind")
    out = docs.select(*columns).schema.add("loss", "double").add("fresh", "double").add("chars", "long").add("blank", "boolean")
    return both.mapInArrow(scoring(columns, columns.index(text) if text in columns else None), out)


def quantiles(rows: DataFrame, value: Column, shares: dict[str, float]) -> DataFrame:
    """lang, n and a column for each share: the least step that so many of the language's rows don't exceed. Exact."""
    bins = rows.groupBy("lang", F.round(value / STEP).cast("long").alias("bin")).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("lang").orderBy("bin"))  # rates span a few thousand steps, whatever the rows
    bins = bins.withColumns({"upto": upto, "n": F.sum("k").over(Window.partitionBy("lang"))})
    return bins.groupBy("lang").agg(F.max("n").alias("n"), *[(F.min(F.when(F.col("upto") >= s * F.col("n"), F.col("bin"))) * STEP).alias(name) for name, s in shares.items()])


def gathered(*tables: DataFrame) -> DataFrame:
    """One row per language with the columns of all tables."""
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table, allowMissingColumns=True)
    return every.groupBy("lang").agg(*[F.max(c).alias(c) for c in every.columns if c != "lang"])


def drawn(what: str, middle: Column) -> Column:
    """Rate per character, drawn to the middle."""
    return (F.col(what) + SHRINK * middle) / (F.col("chars") + SHRINK)


def thresholds(trusted: DataFrame) -> DataFrame:
    """lang (null: all), middle, high, middle_fresh, low: from the scored trusted texts."""
    rows = trusted.where(~F.col("blank"))
    rows = rows.select(F.explode(F.array_distinct(F.array("lang", F.lit(None).cast("string")))).alias("lang"), "loss", "fresh", "chars")
    middles = gathered(quantiles(rows, F.col("loss") / F.col("chars"), {"middle": 0.5}), quantiles(rows, F.col("fresh") / F.col("chars"), {"middle_fresh": 0.5}))
    middles = stored(middles.where((F.col("n") >= FEWEST) | F.col("lang").isNull()).drop("n"), "middles")
    rows = rows.join(middles.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of")))
    bounds = gathered(middles, quantiles(rows, drawn("loss", F.col("middle")), {"high": HIGH}), quantiles(rows, drawn("fresh", F.col("middle_fresh")), {"low": LOW}))
    # languages that have rows but too few have no middle
    return bounds.where("middle is not null").select("lang", "middle", "middle_fresh", (F.col("high") * MARGIN).alias("high"), (F.col("low") / MARGIN).alias("low"))


def judged(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of all documents, numbered c0 on, with perplexity, fresh_perplexity, low, high and keep."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id")
    names = list(dict.fromkeys([*columns, "doc_id", "lang", "text"]))
    at = {c: f"c{i}" for i, c in enumerate(names)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in at.items()])
    trusted = by_ids(rows, good, key=at["doc_id"]).select(F.col(at["text"]).alias("text"))
    levels = train(trusted.where(F.pmod(F.xxhash64("text"), F.lit(4)) != 0))
    kept = [at[c] for c in columns]
    if levels is None:
        nothing = F.lit(None).cast("double")
        keep = F.coalesce(F.regexp_like(at["text"], F.lit(r"\S")), F.lit(False))
        return rows.select(*kept, *[nothing.alias(c) for c in ("perplexity", "fresh_perplexity", "low", "high")], keep.alias("keep"))
    wanted = list(dict.fromkeys([*kept, at["doc_id"], at["lang"]]))
    found = stored(scored(rows, levels, wanted, at["text"]), "scored")
    limits = stored(thresholds(by_ids(found, good, key=at["doc_id"]).withColumn("lang", F.col(at["lang"]))), "limits")
    own = limits.where("lang is not null").select(F.col("lang").alias("of"), F.struct("middle", "middle_fresh", "low", "high").alias("own"))
    every = limits.where("lang is null").select(F.struct("middle", "middle_fresh", "low", "high").alias("every"))
    # one row per language with FEWEST trusted documents; Spark broadcasts it while it is small
    found = found.join(own, F.col(at["lang"]) == F.col("of"), "left").join(F.broadcast(every), F.lit(True), "left")  # one row
    found = found.withColumn("by", F.coalesce("own", "every"))
    rate, fresh = drawn("loss", F.col("by.middle")), drawn("fresh", F.col("by.middle_fresh"))
    some = ~F.col("blank")
    keep = some & F.coalesce((F.round(rate / STEP) * STEP <= F.col("by.high")) & (F.round(fresh / STEP) * STEP >= F.col("by.low")), F.lit(True))
    return found.select(*kept, F.when(some, F.exp(rate)).alias("perplexity"), F.when(some, F.exp(fresh)).alias("fresh_perplexity"), F.exp("by.low").alias("low"), F.exp("by.high").alias("high"), keep.alias("keep"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, lang, perplexity, fresh_perplexity (both drawn), the bounds low (of the second) and high (of the first), keep."""
    return judged(docs, labels, ["doc_id", "lang"]).withColumnsRenamed({"c0": "doc_id", "c1": "lang"})


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, all columns kept."""
    rows = judged(docs, labels, docs.columns).where("keep")
    return rows.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op5_quality_kneser_ney(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
