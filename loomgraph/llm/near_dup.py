"""Operator 7: near-duplicate groups by MinHash with one-permutation hashing.

Every document gives one set of 64-bit shingle hashes. One permutation cut into ``bands * rows``
bins gives the signature: the least hash of each bin; an empty bin takes the value of the first
non-empty bin in its own fixed random order (optimal densification). Equal bands put documents in
one bucket. A bucket of n documents gives at most 2 (n - 1) candidate links, a star around its least
and one around its largest doc_id, instead of n (n - 1) / 2. Candidates are confirmed on full sets.

Documents with equal sets are one node from the start, so copies cost no candidates. A star's texts
meet in tasks by (hub, salt), with as many salts as the hub has members / ``SALTED``; the sets are
compared one member at a time. Groups are connected components, by label passing and pointer
jumping over tables in the shared folder.

A bucket whose other members are still in several components then has all its pairs across them
compared: its members are dealt into blocks, and each pair of blocks meets in a task, which holds
one block's sets and streams the other's, and drops pairs that a link in the task has joined by
then. A pair is compared in one of the buckets that it shares; of buckets with equal members one is
taken. So every two documents that share a bucket are compared or in one group.

With 28 bands of 4 rows a pair at the threshold 0.75 shares a bucket with probability 0.99998.

Defined results: a null, empty or blank text has no shingles and is linked with nothing; a row with
null doc_id is linked with nothing, has no component and is kept; rows that share a doc_id are one
node, linked by any of their texts; ties in size don't matter, the least doc_id stays; a very long text
is hashed in pieces with the same result; an empty table gives an empty result; other columns are
ignored by the report and kept by the filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_ids, discarded, stored

BANDS, ROWS, WORDS = 28, 4, 5
#: Members compared in one task group with a hub's set.
SALTED = 256
#: Shares in which a hub's members are counted.
SHARES = 64
#: Members and shingles of a block whose sets a task holds.
BLOCK, BLOCK_SHINGLES = 1024, 4 << 20
#: Bytes of text hashed at once; a longer text is cut at white space.
PIECE = 1 << 19
SHINGLED = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"

_rng = np.random.default_rng(20_231)
_BYTE = _rng.integers(1, 1 << 64, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 1 << 64, 16, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift until every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in UTF-8 bytes, and the place where it begins. No word crosses ``firsts``."""
    inside = ~_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[firsts[firsts < len(raw)]] = inside[firsts[firsts < len(raw)]]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    letters = _BYTE[_LOWER[raw[inside]]]
    word = np.cumsum(begins)[inside] - 1
    first = np.flatnonzero(begins[inside])
    within = np.arange(len(letters)) - first[word]
    powers = np.cumprod(np.full(int(within.max()) + 1, _BASE, np.uint64))
    return mixed(np.add.reduceat(letters * powers[within], first)), starts


def hashed_texts(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Word hashes of each text (``raw[offsets[i]:offsets[i + 1]]``), in order."""
    if len(raw) > 2 * PIECE and len(offsets) == 2:
        found, a = [], 0
        while a < len(raw):
            b = min(a + PIECE, len(raw))
            while b < len(raw) and not _SPACE[raw[b]]:  # to the end of the word
                more = np.flatnonzero(_SPACE[raw[b:b + PIECE]])
                b = b + int(more[0]) if len(more) else min(b + PIECE, len(raw))
            found.append(word_hashes(raw[a:b], np.empty(0, np.int64))[0])
            a = b
        return [np.concatenate(found)]
    words, starts = word_hashes(raw, offsets[:-1])
    return np.split(words, np.searchsorted(starts, offsets[1:-1]))


def shingle_set(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes."""
    if not len(words):
        return words
    if len(words) < n:
        return mixed((words * _PLACE[: len(words)]).sum(keepdims=True) + np.array([len(words)], np.uint64) * _PLACE[-1:])
    total = words[: len(words) - n + 1] * _PLACE[0]
    for j in range(1, n):
        total = total + words[j: len(words) - n + 1 + j] * _PLACE[j]
    return np.unique(mixed(total))


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets) of slices with about PIECE bytes; null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE, side="right")) - 1)
        yield a, b, data[offsets[a]: offsets[b]], offsets[a: b + 1] - offsets[a]
        a = b


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    for _, _, raw, offsets in text_slices(column):
        yield from map(shingle_set, hashed_texts(raw, offsets))


class Signer:
    """Band keys of sorted shingle sets."""

    def __init__(self, bands: int, rows: int):
        bins = bands * rows
        self.edges = np.append(np.arange(bins, dtype=np.uint64) * np.uint64((1 << 64) // bins), np.uint64((1 << 64) - 1))
        rng = np.random.default_rng(77)
        self.probes = np.stack([rng.permutation(bins) for _ in range(bins)])
        self.shape, self.places = (bands, rows), rng.integers(1, 1 << 64, (bands, rows), dtype=np.uint64) | np.uint64(1)

    def bands(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(hashes, self.edges)
        at[-1] = len(hashes)
        filled = at[:-1] < at[1:]
        least = hashes[np.minimum(at[:-1], len(hashes) - 1)]
        empty = np.flatnonzero(~filled)
        if len(empty):
            order = self.probes[empty]
            least[empty] = least[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
        return mixed((mixed(least.reshape(self.shape)) * self.places).sum(axis=1))


def shingled(bands: int, rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        signer = Signer(bands, rows)
        for batch in batches:
            sizes, keys, signed = [], [], []
            for found in shingle_sets(batch.column("text")):
                sizes.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()))
                signed.append(signer.bands(found).view(np.int64) if len(found) else None)
            pair = np.frombuffer(b"".join(keys), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(signed, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "s1", "s2", "bands"])

    return run


def confirmed(least_percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows sorted by (hub, salt, member first null): the members linked with their hub.

    A hub has as many sets as its doc_id has different texts; a member is linked by any of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own, begun = None, {}, False
        for batch in batches:
            hubs, members = batch.column("hub").to_pylist(), batch.column("member").to_pylist()
            linked = []
            for h, m, found in zip(hubs, members, shingle_sets(batch.column("text"))):
                if m is None:
                    if h != hub or begun:
                        hub, own, begun = h, {}, False
                    own[found.tobytes()] = found
                    continue
                assert h == hub, "a star without its hub"
                begun = True
                for mine in own.values():
                    both = len(np.intersect1d(mine, found, assume_unique=True))
                    if len(found) and 100 * both >= least_percent * (len(mine) + len(found) - both):
                        linked.append((h, m))
                        break
            yield joins(linked)

    return run


class Block:
    """Sets of a bucket's members with their components, and the links that join them with others."""

    def __init__(self, bucket: int, least_percent: int):
        self.bucket, self.least_percent = bucket, least_percent
        self.sets: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.own: list[int] = []
        self.roots, self.sizes, self.table, self.parent = np.empty(0, np.int64), np.empty(0, np.int64), None, {}

    def root(self, component: int) -> int:
        while component in self.parent:
            component = self.parent[component]
        return component

    def add(self, keys: np.ndarray, component: int, found: np.ndarray) -> None:
        self.keys.append(keys)
        self.own.append(component)
        self.sets.append(found)

    def seal(self) -> None:
        """No more members follow."""
        if self.table is None:
            self.table, self.sizes = np.array(self.keys), np.array([len(x) for x in self.sets])
            self.roots = np.array([self.root(c) for c in self.own], np.int64)

    def links(self, keys: np.ndarray, component: int, found: np.ndarray, upto: int | None = None) -> Iterator[tuple[int, int]]:
        """Pairs of components that the member joins by the first ``upto`` members held."""
        mine, n, p = self.root(component), len(found), self.least_percent
        if not n:
            return
        roots, sizes, table = self.roots[:upto], self.sizes[:upto], self.table[:upto]
        at = np.flatnonzero((roots != mine) & (100 * np.minimum(sizes, n) >= p * np.maximum(sizes, n)))
        same = (table[at] == keys) & (keys != 0)  # the first bucket that both are in
        at = at[keys[same.argmax(axis=1)] == self.bucket]
        if not len(at):
            return
        joined = np.concatenate([self.sets[i] for i in at])
        place = np.minimum(np.searchsorted(found, joined), n - 1)
        both = np.add.reduceat((found[place] == joined).astype(np.int64), np.cumsum(sizes[at]) - sizes[at])
        for other in np.unique(roots[at[100 * both >= p * (sizes[at] + n - both)]]).tolist():
            yield mine, other
            self.parent[other] = mine
            self.roots[self.roots == other] = mine


def compared(least_percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows sorted by (bucket, a, b, streamed): the components that a bucket's pairs join.

    A pair of equal blocks has its members only as held ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            linked = []
            columns = [batch.column(c).to_pylist() for c in ("bucket", "a", "b", "streamed", "component", "keys")]
            for bucket, a, b, streamed, component, keys, found in zip(*columns, shingle_sets(batch.column("text"))):
                if at != (bucket, a, b):
                    if held is not None:
                        linked += inner_links(held, at)
                    at, held = (bucket, a, b), Block(bucket, least_percent)
                keys = np.array(keys, np.int64)
                if not streamed:
                    held.add(keys, component, found)
                elif held.own:
                    held.seal()
                    linked += held.links(keys, component, found)
            yield joins(linked)
        if held is not None:
            yield joins(inner_links(held, at))

    return run


def inner_links(held: Block, at: tuple[int, int, int]) -> list[tuple[int, int]]:
    """Links among the members held, if the task has one block only."""
    if at[1] != at[2]:
        return []
    held.seal()
    return [pair for i in range(1, len(held.own)) for pair in held.links(held.keys[i], held.own[i], held.sets[i], i)]


def joins(linked: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in linked], pa.int64()), pa.array([b for _, b in linked], pa.int64())], names=["hub", "member"])


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in ``links`` (hub, member): the least id that can be reached."""
    both = stored(links.select(F.col("hub").alias("id"), F.col("member").alias("other")).unionByName(links.select(F.col("member").alias("id"), F.col("hub").alias("other"))), "links")
    labels = stored(both.groupBy("id").agg(F.min("other").alias("least")).select("id", F.least("id", "least").alias("component")), "labels")
    before = None
    while True:
        heard = both.join(labels.select(F.col("id").alias("other"), "component"), "other").groupBy("id").agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, "id").select("id", F.col("component").alias("was"), F.least("component", "heard").alias("component"))
        jump = labels.select(F.col("id").alias("component"), F.col("component").alias("beyond"))
        after = stored(nearer.join(jump, "component").select("id", "was", F.least("component", "beyond").alias("component")), "labels")
        if before is not None:
            discarded(before)
        before, labels = after, after.select("id", "component")
        if after.where(F.col("component") != F.col("was")).isEmpty():
            return labels


def with_rest(texts: DataFrame, nodes: DataFrame, others: DataFrame, groups: DataFrame, least_percent: int) -> DataFrame:
    """``groups`` joined by the links between ``others`` (id, bucket) of a bucket; its hubs' pairs are compared already."""
    places = nodes.select("id", "n_shingles").join(groups, "id", "left").groupBy("id").agg(F.max("n_shingles").alias("n_shingles"), F.min(F.coalesce("component", "id")).alias("component"))
    others = stored(others.distinct().join(places, "id"), "others")
    buckets = others.groupBy("bucket").agg(
        F.min("component").alias("first"), F.max("component").alias("last"), F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"),
        F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("digest"),
    ).where(F.col("first") < F.col("last"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    buckets = stored(buckets.groupBy("n", "digest").agg(F.min("bucket").alias("bucket"), F.any_value(blocks).alias("blocks")), "buckets")
    if buckets.isEmpty():
        return groups
    rest = others.join(buckets.select("bucket", "blocks"), "bucket")
    rest = rest.groupBy("id", "component").agg(F.collect_list(F.struct("bucket", "blocks")).alias("within"))
    taken = F.transform("bands", lambda k: F.when(F.array_contains(F.col("within.bucket"), k), k).otherwise(F.lit(0).cast("long")))
    rest = rest.join(nodes.select("id", "bands"), "id").select(F.col("id").alias("doc_id"), "component", "within", taken.alias("keys"))
    # as in the stars: the list grows with the corpus
    rest = stored(rest, "others")
    rest = by_ids(texts, rest.select("doc_id")).hint("merge").join(rest.hint("merge"), "doc_id").select("doc_id", "component", "keys", "text", F.explode("within").alias("w"))
    rest = rest.select("doc_id", "component", "keys", "text", "w.*").withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("bucket", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("streamed"), "component", "keys", "text")
    rest = rest.repartition("bucket", "a", "b").sortWithinPartitions("bucket", "a", "b", "streamed")
    links = stored(rest.mapInArrow(compared(least_percent), "hub long, member long").distinct(), "rest")
    if links.isEmpty():
        return groups
    # the links join components, whose ids are their least members
    further = components(links).select(F.col("id").alias("component"), F.col("component").alias("least"))
    every = places.select("id", "component").join(further, "component", "left")
    return every.select("id", F.coalesce("least", "component").alias("component"))


def report(docs: DataFrame, least_percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row per row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows_ = stored(texts.mapInArrow(shingled(bands, rows), SHINGLED), "shingled")
    sets = rows_.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    nodes = stored(sets.groupBy("s1", "s2", "n_shingles").agg(F.min("doc_id").alias("id"), F.any_value("bands").alias("bands")), "nodes")
    keys = nodes.select("id", F.explode("bands").alias("bucket"))
    hubs = keys.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where(F.col("low") < F.col("high"))
    shared = stored(keys.join(hubs, "bucket"), "shared")
    star = shared.select("id", F.explode(F.array("low", "high")).alias("hub")).where(F.col("id") != F.col("hub"))
    pairs = star.groupBy(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).agg(F.min("hub").alias("hub"))
    pairs = stored(pairs.select("hub", (F.col("a") + F.col("b") - F.col("hub")).alias("member")), "pairs")
    # the texts of each node; a hub's members are counted and salted in shares, so that no task meets all of them
    share = F.pmod(F.xxhash64("member"), F.lit(SHARES)).cast("int")
    counted = pairs.groupBy("hub", share.alias("share")).agg(F.count("*").alias("n"))
    salts = stored(counted.groupBy("hub").agg(F.ceil(F.sum("n") / SALTED).cast("int").alias("salts")), "salts")
    large = counted.select("hub", "share").join(salts.where("salts > 1"), "hub")
    wanted = pairs.withColumn("share", share).join(large, ["hub", "share"], "left")
    wanted = wanted.select(F.col("member").alias("doc_id"), "hub", "member", F.pmod(F.xxhash64("member", F.lit(1)), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    own = salts.select(F.col("hub").alias("doc_id"), "hub", F.lit(None).cast("long").alias("member"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    wanted = stored(wanted.unionByName(own), "wanted")
    # only candidates' texts are shuffled; their list grows with the corpus: never broadcast, whatever its size looks like
    stars = by_ids(texts, wanted.select("doc_id")).hint("merge").join(wanted.hint("merge"), "doc_id").select("hub", "salt", "member", "text")
    stars = stars.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.asc_nulls_first("member"))
    links = stars.mapInArrow(confirmed(least_percent), "hub long, member long")
    groups = components(stored(links, "confirmed"))
    groups = with_rest(texts, nodes, shared.where((F.col("id") != F.col("low")) & (F.col("id") != F.col("high"))).select("id", "bucket"), groups, least_percent)
    of_node = nodes.select("s1", "s2", "n_shingles", "id").join(groups, "id", "left").select("s1", "s2", "n_shingles", F.coalesce("component", "id").alias("component"))
    # empty sets have no node: they are dealt by row, not by set
    alone = F.when(F.col("n_shingles") == 0, F.xxhash64("doc_id")).otherwise(F.col("s1"))
    linked = rows_.select("doc_id", "n_shingles", alone.alias("s1"), "s2").join(of_node, ["s1", "s2", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return linked.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, all columns kept; of rows with equal doc_id and text one stays.

    Rows without doc_id stay as they are. Only texts under a doc_id with such repeated rows are shuffled.
    """
    kept = by_ids(docs, report(docs, **options).where(~F.col("kept")).select("doc_id"), held=False)
    rows = docs.select("doc_id", F.xxhash64(F.col("text").isNull(), F.col("text")).alias("__t")).where("doc_id is not null")
    repeated = stored(rows.groupBy("doc_id", "__t").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    once = by_ids(kept, repeated, held=False)
    return once.unionByName(by_ids(kept, repeated).dropDuplicates(["doc_id", "text"]))


def op7_minhash_near_dup(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
