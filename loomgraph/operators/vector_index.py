"""A stored vector index: vectors by cell, nearest cells probed, what they hold ranked exactly.

``build`` trains the cells' centres on a bounded sample, gives every vector to its nearest centre and
writes the vectors sorted by cell, so that a search reads few row groups. A cell's radius bounds how
near its vectors can be to a query (triangle inequality). ``search`` probes the nearest cells of each
query; with ``exact`` it then reads those further cells that may hold something nearer than the k-th
found, and gives what a scan gives. Without, the number of cells comes from the recall that the sample
showed when the index was built.

``similar_pairs`` joins a table with itself: every vector is at home in its nearest centre's cell and
visits a cell only if it lies within the threshold of the plane between both centres, since all that
is at home there lies beyond. No pair is lost; what is compared is cut by the clusters that there are.
Vectors lie in bins of neighbouring cells and are not copied for their visits: pairs of bins meet, and
which rows of them are compared is worked out there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators import similarity
from loomgraph.operators.storage import written

#: Vectors that centres are trained on, cells at most, queries in a list, vectors in a block.
SAMPLE, MOST_CELLS, LIST, BLOCK = 20_000, 8192, 256, 2048
#: Distances are compared with this much room for rounding.
ROOM = 1e-9


def unit(v: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, length, out=np.zeros_like(v), where=length > 0)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def l2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return similarity.distances(a, b, "l2")


def centres_of(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Centres by Lloyd's rounds, from vectors far from each other to begin with."""
    rng = np.random.default_rng(7)
    found = [int(rng.integers(len(sample)))]
    far = l2(sample, sample[found])[:, 0] ** 2
    for _ in range(min(cells, len(sample)) - 1):
        if not far.sum() > 0:
            break
        found.append(int(rng.choice(len(sample), p=far / far.sum())))
        far = np.minimum(far, l2(sample, sample[found[-1:]])[:, 0] ** 2)
    centres = sample[found]
    for _ in range(rounds):
        home = l2(sample, centres).argmin(axis=1)
        sums, n = np.zeros_like(centres), np.bincount(home, minlength=len(centres))
        np.add.at(sums, home, sample)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def sampled(vectors: DataFrame, size: int) -> np.ndarray:
    """At most ``size`` vectors, picked by a digest of their ids, so that reruns agree."""
    rows = vectors.orderBy(F.xxhash64("id"), "id").limit(size).select("v").toPandas()
    return np.array(rows.v.tolist(), dtype=np.float64)


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    metric: str
    centres: np.ndarray
    sizes: np.ndarray  # by cell
    radii: np.ndarray
    probes: int  # cells that reach the recall asked for

    def rows(self) -> DataFrame:
        """cell, id, v and the other columns of what was indexed."""
        return self.spark.read.parquet(self.path)


def clean(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("v").isNotNull() & (F.size("v") > 0))


def at_home(centres: np.ndarray, metric: str, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column("v"))
            d = l2(unit(v) if metric == "cosine" else v, centres)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(d[np.arange(len(cell)), cell]), *batch.columns], names=["cell", "gap", *names])

    return run


def build(vectors: DataFrame, path: str, metric: str = "l2", cells: int | None = None, recall: float = 0.95, k: int = 5, sample: int = SAMPLE) -> VectorIndex:
    """Indexes every row of ``vectors`` (id, v and any other columns) by "l2" (which serves "l1", too) or "cosine".

    Rows without a vector are left out. ``cells`` is the root of the number of rows, unless given, and
    ``MOST_CELLS`` at most. Everything is indexed; only centres and ``probes`` come from the sample.
    """
    vectors = clean(vectors)
    n = vectors.count()
    seen = sampled(vectors.select("id", "v"), sample)
    space = unit(seen) if metric == "cosine" and len(seen) else seen
    centres = centres_of(space, min(MOST_CELLS, cells or max(1, round(n**0.5)))) if n else np.zeros((1, 1))
    schema = "cell int, gap double, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema)
    rows = vectors.mapInArrow(at_home(centres, metric, vectors.columns), schema)
    rows.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.parquet(path)
    spark = vectors.sparkSession
    sizes, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
    for r in spark.read.parquet(path).groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("gap")).collect():  # a row per cell
        sizes[r["cell"]], radii[r["cell"]] = r["n"], r["gap"]
    return VectorIndex(spark, path, metric, centres, sizes, radii, probes_for(space, centres, recall, k))


def probes_for(sample: np.ndarray, centres: np.ndarray, recall: float, k: int, queries: int = 500) -> int:
    """How many cells the sample's first vectors need for that share of their k nearest in the sample."""
    if len(sample) < 2:
        return 1
    home = l2(sample, centres).argmin(axis=1)
    some = sample[:queries]
    d = l2(some, sample)
    d[np.arange(len(some)), np.arange(len(some))] = np.inf
    near = np.argsort(d, axis=1)[:, : min(k, len(sample) - 1)]
    place = np.argsort(np.argsort(l2(some, centres), axis=1), axis=1)  # of each cell, by query
    needed = np.sort(place[np.arange(len(some))[:, None], home[near]].ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def lists(rows: DataFrame) -> DataFrame:
    """Rows (cell, id, v, limit) gathered into lists of about ``LIST`` of a cell."""
    counted = rows.groupBy("cell").agg(F.ceil(F.count("*") / LIST).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64("id"), F.col("shares")).alias("share")
    per = rows.join(counted, "cell").select("cell", share, F.struct("id", "v", "limit").alias("q")).groupBy("cell", "share").agg(F.collect_list("q").alias("qs"))
    return per.select("cell", F.col("qs.id").alias("ids"), F.flatten("qs.v").cast("array<double>").alias("flat"), F.col("qs.limit").alias("limits"))


def cell_blocks(rows: DataFrame) -> DataFrame:
    """Rows (cell, id, v) gathered where they lie into blocks of one cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, ids = batch.column("cell").to_numpy(), batch.column("id").to_numpy()
            v = matrix(batch.column("v")) if batch.num_rows else np.zeros((0, 1))
            order = np.argsort(cells, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
                for at in range(0, len(part), BLOCK):
                    some = part[at:at + BLOCK]
                    yield pa.RecordBatch.from_arrays([pa.array([cells[some[0]]], pa.int32()), pa.array([ids[some]], pa.list_(pa.int64())), pa.array([v[some].ravel()], pa.list_(pa.float64()))], names=["cell", "ids2", "flat2"])

    return rows.select("cell", F.col("id").cast("long").alias("id"), "v").mapInArrow(run, "cell int, ids2 array<long>, flat2 array<double>")


def routed(index: VectorIndex, queries: DataFrame, skip: int, most: int) -> DataFrame:
    """id, v, limit, cell: the cells of each query from the ``skip``-th nearest to the ``most``-th that can hold anything under its limit."""
    centres, sizes, radii, cosine = index.centres, index.sizes, index.radii, index.metric == "cosine"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not sizes.any():
                continue
            v = matrix(batch.column("v"))
            d = l2(unit(v) if cosine else v, centres)
            limit = batch.column("limit").to_numpy(zero_copy_only=False)
            # of unit vectors: cosine distance = l2 * l2 / 2
            reach = np.sqrt(np.maximum(0, 2 * limit)) if cosine else limit
            order = np.argsort(d, axis=1, kind="stable")[:, skip:most]
            near = np.take_along_axis(d, order, axis=1) - radii[order] <= reach[:, None] * (1 + ROOM) + ROOM
            q, at = np.nonzero(near & (sizes[order] > 0))
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(q)) for c in ("id", "v", "limit")], pa.array(order[q, at], pa.int32())], names=["id", "v", "limit", "cell"])

    kind = queries.schema["v"].dataType.simpleString()
    return queries.select("id", "v", "limit").mapInArrow(run, f"id long, v {kind}, limit double, cell int")


def compared(base: DataFrame, wanted: DataFrame, k: int, metric: str, itself: bool) -> DataFrame:
    """query, id, distance: of each list of queries and each block of its cell, the k nearest of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                q, flat, limit, ids, flat2 = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "flat", "limits", "ids2", "flat2"))
                d = similarity.distances(flat.reshape(len(q), -1), flat2.reshape(len(ids), -1), metric)
                if not itself:
                    d[q[:, None] == ids[None, :]] = np.inf
                d[~(d <= limit[:, None] * (1 + ROOM) + ROOM)] = np.inf
                order = np.lexsort((np.broadcast_to(ids, d.shape), np.round(d, 9)), axis=1)[:, :k]
                rows = np.repeat(np.arange(len(q)), order.shape[1])
                found = d[rows, order.ravel()]
                fine = np.isfinite(found)
                yield pa.RecordBatch.from_arrays([pa.array(q[rows][fine]), pa.array(ids[order.ravel()][fine]), pa.array(found[fine])], names=["query", "id", "distance"])

    pairs = lists(wanted).join(cell_blocks(base), "cell")
    return pairs.select("ids", "flat", "limits", "ids2", "flat2").mapInArrow(run, "query long, id long, distance double")


def best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.round("distance", 9), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int, exact: bool = True, probes: int | None = None, metric: str | None = None, within: float | None = None, where: Column | None = None, itself: bool = False) -> DataFrame:
    """query, id, distance, rank (from 1): the k nearest by (distance, id) to each row of ``queries`` (id, v).

    ``where`` is a filter on any stored columns (id, partition keys, metadata), applied before vectors are
    compared; ``within`` is a strict bound on the distance. ``exact`` gives what a scan gives; else
    ``probes`` cells of each query are read, by default those that reached the index's recall.
    """
    metric = metric or index.metric
    if (metric == "cosine") != (index.metric == "cosine") or metric not in ("l2", "l1", "cosine"):
        raise ValueError(f"an index by {index.metric} has no bounds for {metric}")
    base = index.rows() if where is None else index.rows().where(where)
    far = float("inf") if within is None else within
    asked = clean(queries.select(F.col("id").cast("long").alias("id"), "v")).withColumn("limit", F.lit(far))
    probes = min(probes or index.probes, len(index.centres))
    found = best(compared(base, routed(index, asked, 0, probes), k, metric, itself), k)
    if exact:
        # written: the second round and the result both read it
        found = found.checkpoint()
        last = found.where(F.col("rank") == k).select(F.col("query").alias("id"), F.col("distance").alias("last"))
        rest = asked.join(last, "id", "left").select("id", "v", F.least("limit", F.coalesce("last", F.lit(float("inf")))).alias("limit"))
        further = compared(base, routed(index, rest, probes, len(index.centres)), k, metric, itself)
        found = best(found.drop("rank").unionByName(further), k)
    return found.where(F.col("distance") < far)


def rows_compared(index: VectorIndex, queries: DataFrame, probes: int | None = None) -> DataFrame:
    """query, rows: what the cells hold that a search without ``exact`` reads for each query."""
    sizes = index.spark.createDataFrame([(i, int(n)) for i, n in enumerate(index.sizes)], "cell int, n long")
    asked = clean(queries.select(F.col("id").cast("long").alias("id"), "v")).withColumn("limit", F.lit(float("inf")))
    return routed(index, asked, 0, probes or index.probes).join(F.broadcast(sizes), "cell").groupBy(F.col("id").alias("query")).agg(F.sum("n").alias("rows"))  # a row per cell


@dataclass
class Bins:
    """Which bins hold a cell: neighbouring small cells share a bin, a cell of over ``BLOCK`` vectors has several."""

    first: np.ndarray  # by cell
    shares: np.ndarray  # by cell
    bins: int

    def of(self, cells: np.ndarray, ids: np.ndarray) -> np.ndarray:
        mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        return self.first[cells] + (mixed % self.shares[cells].astype(np.uint64)).astype(np.int64)


def bins_of(centres: np.ndarray, sizes: np.ndarray) -> Bins:
    """Cells in order from one centre to the nearest one left, put into bins while those have room."""
    first, shares = np.zeros(len(centres), np.int64), np.maximum(1, -(-sizes // BLOCK))
    left, at, filled, bins = np.ones(len(centres), bool), 0, 0, 0
    for _ in range(len(centres)):
        left[at] = False
        if filled and filled + sizes[at] > BLOCK:
            filled, bins = 0, bins + 1
        first[at] = bins
        filled += sizes[at]
        if shares[at] > 1:
            filled, bins = 0, bins + int(shares[at])
        if left.any():
            d = ((centres - centres[at]) ** 2).sum(axis=1)
            at = int(np.where(left, d, np.inf).argmin())
    return Bins(first, shares, bins + 1)


def visited(centres: np.ndarray, radii: np.ndarray, within: float, v: np.ndarray, home: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Of vectors at home in a cell and ``cells``: which later cells may hold something within the distance."""
    d = l2(v, centres[cells])
    own = np.linalg.norm(v - centres[home], axis=1)[:, None]
    # all that is at home in a cell lies on its side of the plane between the centres, and within its radius
    places, number = np.unique(home, return_inverse=True)
    apart = l2(centres[places], centres[cells])[number]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (d * d - own * own) / (2 * apart)
    return (cells[None, :] > home[:, None]) & ~(plane > within + ROOM) & ~(d - radii[cells][None, :] > within + ROOM)


BINNED = "bin long, cells array<int>, ids array<long>, flat binary, visits array<int>"


def binned(index: VectorIndex, within: float) -> DataFrame:
    """A row per bin: its vectors, their cells and the bins that any of them visits. Every vector is in one bin."""
    centres, radii, sizes, cosine = index.centres, index.radii, index.sizes, index.metric == "cosine"
    bins = bins_of(centres, sizes)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number = bins.of(batch.column("cell").to_numpy(), batch.column("id").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), *batch.columns], names=["bin", *batch.schema.names])

    def block(number: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        cells, ids, v = (np.concatenate(x) for x in zip(*parts))
        seen = np.zeros(bins.bins, bool)
        filled = np.flatnonzero(sizes)
        for at in range(0, len(ids), 256):
            here = slice(at, at + 256)
            for c in filled[visited(centres, radii, within, v[here], cells[here], filled).any(axis=0)]:
                seen[bins.first[c]: bins.first[c] + bins.shares[c]] = True
        for c in np.unique(cells):  # the shares of a cell meet each other
            seen[number + 1: bins.first[c] + bins.shares[c]] = True
        seen[number] = True
        columns = [pa.array([number], pa.int64()), pa.array([cells], pa.list_(pa.int32())), pa.array([ids], pa.list_(pa.int64())), pa.array([v.tobytes()], pa.binary()), pa.array([np.flatnonzero(seen)], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays(columns, names=["bin", "cells", "ids", "flat", "visits"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            number, v = batch.column("bin").to_numpy(), matrix(batch.column("v"))
            v = unit(v) if cosine else v
            cells, ids = batch.column("cell").to_numpy(), batch.column("id").to_numpy()
            edges = np.flatnonzero(np.diff(number)) + 1
            for begin, end in zip([0, *edges], [*edges, len(number)]):
                if held is not None and number[begin] != held:
                    yield block(held, parts)
                    parts = []
                held = int(number[begin])
                parts.append((cells[begin:end], ids[begin:end], v[begin:end].copy()))
        if held is not None:
            yield block(held, parts)

    rows = index.rows().select("cell", F.col("id").cast("long").alias("id"), "v")
    kind = rows.schema["v"].dataType.simpleString()
    return rows.mapInArrow(dealt, f"bin long, cell int, id long, v {kind}").repartition(min(64, bins.bins), "bin").sortWithinPartitions("bin").mapInArrow(gathered, BINNED)


def bin_pairs(index: VectorIndex, within: float) -> DataFrame:
    """Pairs of bins with something to compare; bins are written once, and not copied for their pairs."""
    bins = written(binned(index, within), "bins")
    return bins.crossJoin(bins.drop("visits").withColumnsRenamed({c: f"{c}2" for c in bins.columns})).where(F.array_contains("visits", F.col("bin2").cast("int")))


def compared_in(index: VectorIndex, within: float) -> Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, ...]]]:
    """ids, vectors, ids2, vectors2 to be compared, out of pairs of bins: a cell with itself, or with its visitors."""
    centres, radii = index.centres, index.radii

    def run(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for i in range(batch.num_rows):
            bin1, bin2 = (batch.column(c)[i].as_py() for c in ("bin", "bin2"))
            cells, ids, cells2, ids2 = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("cells", "ids", "cells2", "ids2"))
            v, v2 = (np.frombuffer(batch.column(c)[i].as_buffer()).reshape(n, -1) for c, n in (("flat", len(ids)), ("flat2", len(ids2))))
            there = np.unique(cells2)
            near = np.concatenate([visited(centres, radii, within, v[at: at + 256], cells[at: at + 256], there) for at in range(0, len(ids), 256)])
            for c, near_c in zip(there, near.T):
                home = np.flatnonzero(cells2 == c)
                some = np.flatnonzero(near_c)
                if len(some):
                    yield ids[some], v[some], ids2[home], v2[home]
                same = np.flatnonzero(cells == c) if bin1 <= bin2 else []
                if len(same):
                    yield ids[same], v[same], ids2[home], v2[home]

    return run


def block_pairs_of(index: VectorIndex, within: float) -> DataFrame:
    """The pairs of blocks that are compared for pairs of vectors within the distance (in the space of the cells)."""
    compared = compared_in(index, within)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, v, ids2, v2 in compared(batch):
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([v.ravel()], pa.list_(pa.float64())), pa.array([ids2], pa.list_(pa.int64())), pa.array([v2.ravel()], pa.list_(pa.float64()))], names=["ids", "flat", "ids2", "flat2"])

    return bin_pairs(index, within).mapInArrow(run, "ids array<long>, flat array<double>, ids2 array<long>, flat2 array<double>")


def paired(index: VectorIndex, within: float, metric: str, accept: Callable[[np.ndarray], np.ndarray], most: int | None = None) -> DataFrame:
    """a < b, distance: pairs that ``accept`` takes, compared a slab at a time; ``most`` as in :func:`similarity.slabs`."""
    compared = compared_in(index, within)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, v, ids2, v2 in compared(batch):
                for found in similarity.slabs(ids, v, ids2, v2, metric, accept, most):
                    yield pa.RecordBatch.from_arrays([*map(pa.array, found)], names=["a", "b", "distance"])

    return bin_pairs(index, within).mapInArrow(run, "a long, b long, distance double")


def similar_pairs(index: VectorIndex, above: float) -> DataFrame:
    """a < b, similarity: all pairs with a cosine above the threshold, for an index by "cosine"; a zero vector is like none."""
    within = float(np.sqrt(max(0.0, 2 * (1 - above))))
    return paired(index, within, "cosine", lambda d: 1 - d > above).select("a", "b", (1 - F.col("distance")).alias("similarity"))


def near_pairs(index: VectorIndex, similarity_: float, most: int) -> DataFrame:
    """a < b, distance, similarity: the ``most`` nearest pairs with an L2 distance under sqrt(2 (1 - similarity)), for an index by "l2"."""
    bound = float(np.sqrt(2 * (1 - similarity_)))
    found = paired(index, bound, "l2", lambda d: d < bound, most).withColumn("similarity", 1 - F.col("distance") * F.col("distance") / 2)
    return found.orderBy(F.round("distance", 9), "a", "b").limit(most)
