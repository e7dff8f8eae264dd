"""Operator 11: runs of repeated words, by the linear-time method for all tandem repeats.

1. *Blocks.* Lempel-Ziv blocks (each the longest piece that begins earlier, too) of the word numbers
   give a set of squares that covers the leftmost occurrence of every kind of square: a square's halves
   are found by extending a match from a block's border both ways.
2. *Vocabulary.* Nodes of the suffix tree are intervals of the suffix array. From each square found, a
   walk along suffix links turns it by one word at a time (w x w x .. becomes x w x w ..), as long as
   the turned square occurs anywhere; after it has been turned once round, all kinds are complete.
3. *Places.* The interval of each kind has all its occurrences. Those of one period that adjoin merge
   into a maximal run.

All three work on arrays: names of all words of length 2^j give equality of any two pieces at once,
common extensions by halving, and the suffix array. Squares whose half is a power itself are left out,
as their shorter root gives the same run.

Stretches that can't hold a wanted run are left out before: in a run of period q all words but the
first q have their like at most q words before, so at least max(least - q, (times - 1) * q) consecutive
words do. That is a necessary condition, checked exactly by doubling q; nothing else is dropped.

A run is a stretch of words with smallest period q and at least max(``least``, ``times`` * q) words
that can't be extended. Texts are independent of each other and of how rows are dealt; a task holds
some 500 bytes for each word of the stretches it works on (``TOGETHER`` words, or one longer stretch)
and 60 for each word of the texts beside them (``TEXTS`` bytes, or one longer text).

Defined results: a null, empty or blank text has no words, no runs and an empty collapsed text;
repeated rows give equal rows; for the report a null doc_id is the empty string; of runs with equal
exponents the first, then the one of shorter period is reported; an empty table gives an empty result;
other columns, whatever their names, are ignored by the report and kept by the filter.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOGETHER, TEXTS = 200_000, 2 << 20
REPORT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Pieces:
    """A sequence with names for its pieces: equality, common extensions, suffix array.

    The sequence begins and ends with numbers that occur once, and has one wherever matches must end.
    """

    def __init__(self, sequence: np.ndarray) -> None:
        n = len(sequence)
        names = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
        self.names, self.n = [names.astype(np.int32)], n
        while names.max() < n - 1:
            step = 1 << (len(self.names) - 1)
            after = np.zeros(n, np.int64)
            after[: n - step] = names[step:] + 1
            names = np.unique(names * (n + 1) + after, return_inverse=True)[1]
            self.names.append(names.astype(np.int32))
        self.suffixes = np.empty(n, np.int64)
        self.suffixes[names] = np.arange(n)
        self.rank = names

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How long the same words follow from i and from j (i != j)."""
        done = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name = self.names[level]
            done += (name[i + done] == name[j + done]).astype(np.int64) << level
        return done

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How long the same words end before i and before j (i != j)."""
        done = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name, a, b = self.names[level], i - done - (1 << level), j - done - (1 << level)
            done += ((np.minimum(a, b) >= 0) & (name[np.maximum(a, 0)] == name[np.maximum(b, 0)])).astype(np.int64) << level
        return done

    def name_of(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two numbers that, with the length, tell pieces apart."""
        level = np.minimum(np.frexp(length.astype(np.float64))[1] - 1, len(self.names) - 1)
        table = np.stack(self.names)
        return table[level, i], table[level, i + length - (1 << level)]

    def prepared(self) -> None:
        """The least common extensions of ranges of the suffix array, for intervals."""
        common = np.zeros(self.n, np.int64)
        common[1:] = self.ahead(self.suffixes[:-1], self.suffixes[1:])
        self.least = [common]  # least[j][k]: of neighbours k .. k + 2^j - 1
        while 2 << (len(self.least) - 1) <= self.n:
            last, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[: len(last) - step], last[step:]))

    def interval(self, i: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes (first, last place in the array) that begin like the piece."""
        low, high = self.rank[i].astype(np.int64), self.rank[i].astype(np.int64)
        for level in range(len(self.least) - 1, -1, -1):
            least, step = self.least[level], 1 << level
            at = low - step + 1
            low = np.where((at > 0) & (least[np.maximum(at, 0)] >= length), low - step, low)
            at = high + 1
            inside = at + step <= self.n
            high = np.where(inside & (least[np.where(inside, at, 0)] >= length), high + step, high)
        return low, high

    def followed(self, low: np.ndarray, high: np.ndarray, length: np.ndarray, by: np.ndarray) -> np.ndarray:
        """A suffix of each interval that has the word ``by`` (a name) after ``length`` words, or -1."""
        low, end = low.copy(), high
        word = lambda k: self.names[0][np.minimum(self.suffixes[k] + length, self.n - 1)]
        top = high.copy()
        while (low < top).any():
            middle = (low + top) // 2
            less = word(middle) < by
            low, top = np.where(less & (low < top), middle + 1, low), np.where(less, top, middle)
        return np.where((low <= end) & (word(low) == by), self.suffixes[low], -1)


def blocks(pieces: Pieces) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin, and the end."""
    suffixes, n = pieces.suffixes.tolist(), pieces.n
    before, after, held = [-1] * n, [-1] * n, []
    for at in suffixes:  # nearest suffixes in order that begin earlier
        while held and held[-1] > at:
            after[held.pop()] = at
        before[at] = held[-1] if held else -1
        held.append(at)
    longest = np.zeros(n, np.int64)
    for other in (np.array(before), np.array(after)):
        some = np.flatnonzero(other >= 0)
        longest[some] = np.maximum(longest[some], pieces.ahead(some, other[some]))
    longest, begin, at = longest.tolist(), [], 0
    while at < n:
        begin.append(at)
        at += max(1, longest[at])
    return np.array([*begin, n])


def leftmost_squares(pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(start, half) of squares that cover the leftmost occurrence of each kind."""
    begin = blocks(pieces)
    found = []
    size = np.diff(begin)
    following = np.append(size[1:], 0)

    def each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        which = np.repeat(np.arange(len(counts)), counts)
        return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + 1

    word = pieces.names[0]
    # the right half goes on past the block's end
    which, half = each(size)
    border = begin[1:][which]
    other = border - half
    some = (border < pieces.n) & (word[np.minimum(border, pieces.n - 1)] == word[other])
    half, border, other = half[some], border[some], other[some]
    right, left = pieces.ahead(border, other), pieces.behind(border, other)
    good = right + left >= half
    found.append((np.maximum(other - left, other - half + 1)[good], half[good]))
    # the left half begins before the block
    which, half = each(size + following)
    border, end = begin[:-1][which], begin[1:][which]
    other = border + half
    some = (border > 0) & (other < pieces.n)
    some[some] = (word[border[some]] == word[other[some]]) & (word[border[some] - 1] == word[other[some] - 1])
    half, border, other, end = half[some], border[some], other[some], end[some]
    right, left = pieces.ahead(border, other), pieces.behind(border, other)
    start = np.maximum(border - left, border - half + 1)
    good = (right + left >= half) & (start + half <= end)
    found.append((start[good], half[good]))
    start, half = (np.concatenate(x) for x in zip(*found))
    return start, half


def primitive(pieces: Pieces, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether the half of each square is no power: for no prime divisor r it has the period half / r."""
    good, rest = np.ones(len(half), bool), half.copy()
    if not len(half):
        return good
    smallest = np.arange(half.max() + 1)
    for r in range(2, int(len(smallest) ** 0.5) + 1):
        if smallest[r] == r:
            smallest[r * r::r] = np.minimum(smallest[r * r::r], r)
    while (some := np.flatnonzero(good & (rest > 1))).size:
        r = smallest[rest[some]]
        shift = half[some] // r
        good[some] = pieces.ahead(start[some], start[some] + shift) < 2 * half[some] - shift
        rest[some] //= r
    return good


def vocabulary(pieces: Pieces, start: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, half), an occurrence of every kind of square, from a covering set of them."""
    kinds, turned = [], np.zeros(len(start), np.int64)
    while len(start):
        # this occurrence holds as many turns as its run goes on
        more = np.minimum(pieces.ahead(start, start + half) - half, half - 1 - turned)
        count = more + 1
        kinds.append((np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum()), np.repeat(half, count)))
        turned, start = turned + count, start + more
        going = turned < half
        start, half, turned = start[going], half[going], turned[going]
        # the suffix link of the square's node, then the first word again
        low, high = pieces.interval(start + 1, 2 * half - 1)
        at = pieces.followed(low, high, 2 * half - 1, pieces.names[0][start])
        start, half, turned = at[at >= 0], half[at >= 0], turned[at >= 0]
    if not kinds:
        return start, half
    start, half = (np.concatenate(x) for x in zip(*kinds))
    return distinct(pieces, start, half)


def distinct(pieces: Pieces, start: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one, two = pieces.name_of(start, 2 * half)
    order = np.lexsort((two, one, half))
    key = [x[order] for x in (one, two, half)]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
    return start[order[new]], half[order[new]]


def all_runs(sequence: np.ndarray, least: int, times: int) -> np.ndarray:
    """(start, length, period) of the runs of a sequence that :class:`Pieces` takes."""
    pieces = Pieces(sequence)
    start, half = leftmost_squares(pieces)
    good = primitive(pieces, start, half)
    start, half = start[good], half[good]
    if not len(start):
        return np.zeros((0, 3), np.int64)
    pieces.prepared()
    start, half = vocabulary(pieces, *distinct(pieces, start, half))
    low, high = pieces.interval(start, 2 * half)
    n = high - low + 1
    places = pieces.suffixes[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
    half = np.repeat(half, n)
    order = np.lexsort((places, half))
    places, half = places[order], half[order]
    new = np.ones(len(places), bool)
    new[1:] = (half[1:] != half[:-1]) | (places[1:] != places[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(places)) - 1
    length, period = places[last] - places[first] + 2 * half[first], half[first]
    good = length >= np.maximum(least, times * period)
    return np.stack([places[first], length, period], axis=1)[good]


def distances(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """How far back the same word stands in the same text (a very large number if nowhere)."""
    order = np.argsort(words, kind="stable")
    out = np.full(len(words), 1 << 62)
    same = (words[order][1:] == words[order][:-1]) & (text[order][1:] == text[order][:-1])
    out[order[1:][same]] = (order[1:] - order[:-1])[same]
    return out


def stretches(words: np.ndarray, text: np.ndarray, begins: np.ndarray, least: int, times: int) -> np.ndarray:
    """(start, end), apart from each other, of all stretches that can hold a wanted run."""
    far = distances(words, text)
    edge = np.zeros(len(words) + 1, np.int64)
    longest, q = int(np.bincount(text).max(initial=0)) if len(text) else 0, 1
    while times * q <= longest:
        most = 2 * q - 1  # periods q .. most
        near = np.concatenate([[False], far <= most, [False]])
        a, b = np.flatnonzero(np.diff(near.astype(np.int8))).reshape(-1, 2).T
        shortest = min(max(least - p, (times - 1) * p) for p in {q, most, *range(q, min(most, least) + 1)})
        long = b - a >= shortest
        np.add.at(edge, np.maximum(a[long] - most, begins[text[a[long]]]), 1)
        np.add.at(edge, b[long], -1)
        q *= 2
    inside = np.concatenate([[False], np.cumsum(edge[:-1]) > 0, [False]])
    # a text's end parts stretches even if the next text goes on at once
    cuts = begins[inside[1:-1][begins] & (begins > 0) & inside[begins]] if len(words) else begins
    pairs = np.flatnonzero(np.diff(inside.astype(np.int8))).reshape(-1, 2)
    return np.stack([np.sort(np.concatenate([pairs[:, 0], cuts])), np.sort(np.concatenate([pairs[:, 1], cuts]))], axis=1)


def runs_of(words: np.ndarray, counts: np.ndarray, least: int, times: int) -> np.ndarray:
    """(start, length, period), by place in ``words``, of texts' runs; ``counts``: words by text."""
    counts = counts[counts > 0]
    text, begins = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
    found, held, size = [np.zeros((0, 3), np.int64)], [], 0

    def work() -> None:
        parts, at, places = [np.array([-1])], 1, []
        for k, (a, b) in enumerate(held):
            parts += [words[a:b], np.array([-2 - k])]  # each with a number that occurs once behind it
            places.append((at, a))
            at += b - a + 1
        runs = all_runs(np.concatenate(parts), least, times)
        at, a = np.array(places).T
        which = np.searchsorted(at, runs[:, 0], side="right") - 1
        runs[:, 0] += (a - at)[which]
        found.append(runs)

    for a, b in stretches(words, text, begins, least, times).tolist():
        if held and size + b - a > TOGETHER:
            work()
            held, size = [], 0
        held.append((a, b))
        size += b - a
    if held:
        work()
    runs = np.concatenate(found)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one document in ten, the places its words are taken from, so that its end is periodic."""
    h = zlib.crc32(str(doc_id if doc_id is not None else "").encode())
    g = h // 10
    if h % 10 or not n:
        return None
    a, i = g % n, np.arange(n)
    p = 1 + (n - a) // (3 + g % 8)
    return np.where(i >= a, a + (i - a) % p, i)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts and their number in each."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, bounds = lists.flatten(), np.asarray(lists.offsets) - lists.offsets[0].as_py()
    full = np.asarray(pc.greater(pc.binary_length(flat), 0))
    return flat.filter(pa.array(full)), np.diff(np.concatenate([[0], np.cumsum(full)])[bounds])


def worked(batches: Iterator[pa.RecordBatch], least: int, times: int, plant: bool) -> Iterator[tuple]:
    """For some rows of a batch at a time: the rows, words, counts, runs and collapsed texts."""
    for batch in batches:
        texts = batch.column("text")
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TEXTS, side="right")))
            rows = batch.slice(at, to - at)
            at = to
            words, counts = split(rows.column("text"))
            begins = np.cumsum(counts) - counts
            if plant:
                source = np.arange(len(words))
                for doc, n, b in zip(rows.column("doc_id").to_pylist(), counts.tolist(), begins.tolist()):
                    if (places := planted(doc, n)) is not None:
                        source[b:b + n] = b + places
                words = words.take(pa.array(source))
            runs = runs_of(np.asarray(words.dictionary_encode().indices), counts, least, times)
            gone = np.zeros(len(words) + 1, np.int64)
            np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
            np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
            kept = np.cumsum(gone[:-1]) == 0
            bounds = np.concatenate([[0], np.cumsum(kept)])[np.append(begins, len(words))]
            collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words.filter(pa.array(kept))), " ")
            yield rows, begins, counts, runs, collapsed


def reported(least: int, times: int, plant: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for rows, begins, counts, runs, collapsed in worked(batches, least, times, plant):
            ends = np.searchsorted(runs[:, 0], begins + counts)
            first = np.searchsorted(runs[:, 0], begins)
            out = []
            for b, lo, hi, text in zip(begins.tolist(), first.tolist(), ends.tolist(), collapsed):
                own = [(s - b, n, q) for s, n, q in runs[lo:hi].tolist()]
                best = min(own, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
                milli = best[1] * 1000 // best[2] if own else None
                out.append((len(own), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in own)), sha(text.as_py())))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
            names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), *columns], names=names)

    return run


def report(docs: DataFrame, least: int = 24, times: int = 3, plant: bool = False) -> DataFrame:
    """The columns of ``REPORT``, a row per row of ``docs``; ``plant``: with runs put into one document in ten."""
    return docs.select("doc_id", "text").mapInArrow(reported(least, times, plant), REPORT)


def found_runs(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """doc_id, start, length, period of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins, counts, runs, _ in worked(batches, least, times, False):
            which = np.searchsorted(begins + counts, runs[:, 0], side="right")
            ids = rows.column("doc_id").cast(pa.int64()).take(pa.array(which))
            yield pa.RecordBatch.from_arrays([ids, pa.array(runs[:, 0] - begins[which]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], names=["doc_id", "start", "length", "period"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, period long")


def collapsed(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """The documents with each run cut down to its first period; texts without one stay as they are."""

    @F.pandas_udf("string")
    def cut(text):
        import pandas as pd

        column = pa.array(text, pa.string())
        out = []
        for rows, begins, counts, runs, short in worked([pa.record_batch([column], names=["text"])], least, times, False):
            hit = np.zeros(rows.num_rows, bool)
            hit[np.searchsorted(begins + counts, runs[:, 0], side="right")] = True
            out += [s if h else t for h, s, t in zip(hit, short.to_pylist(), rows.column("text").to_pylist())]
        return pd.Series(out, dtype=object)

    return docs.select(*[cut(F.col("`text`")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True)


#: All pairs of equal words of a text at one distance, in stretches. The crc32 by a table of 256 values.
OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
docs AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l, hex(encode(coalesce(doc_id::VARCHAR, ''))) AS x FROM documents),
hashed AS (SELECT doc_id, r, l, len(l) AS n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)),
                  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM docs, crc),
d AS (SELECT doc_id, r, n, h % 10 = 0 AND n > 0 AS planted, CASE WHEN n > 0 THEN (h // 10) % n END AS a, 3 + (h // 10) % 8 AS e FROM hashed),
own AS (SELECT r, unnest(l) AS word, generate_subscripts(l, 1) - 1 AS i FROM hashed),
place AS (SELECT own.r, n, i, CASE WHEN planted AND i >= a THEN a + (i - a) % (1 + (n - a) // e) ELSE i END AS at FROM own JOIN d ON own.r = d.r),
w AS (SELECT p.r, p.n, p.i, o.word FROM place p JOIN own o ON p.r = o.r AND p.at = o.i),
pairs AS (SELECT a.r, a.i, b.i - a.i AS q FROM w a JOIN w b ON a.r = b.r AND a.word = b.word AND b.i > a.i AND 3 * (b.i - a.i) <= a.n),
kept AS (SELECT * FROM pairs QUALIFY count(*) OVER (PARTITION BY r, q) >= 2 * q),
island AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS g FROM kept),
stretch AS (SELECT r, q, min(i) AS s, count(*) + q AS len FROM island GROUP BY r, q, g HAVING count(*) + q >= greatest(24, 3 * q)),
runs AS (SELECT r, s, len, min(q) AS q FROM stretch GROUP BY r, s, len),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY r ORDER BY len::DOUBLE / q DESC, s, q) = 1),
listed AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS lines FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM runs),
text AS (SELECT w.r, string_agg(word, ' ' ORDER BY w.i) AS collapsed FROM w ANTI JOIN gone ON w.r = gone.r AND w.i = gone.i GROUP BY w.r)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM d LEFT JOIN best ON d.r = best.r LEFT JOIN listed ON d.r = listed.r LEFT JOIN text ON d.r = text.r
"""
