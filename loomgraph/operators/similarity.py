"""Vector search and similarity joins, exact, by products of blocks of vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block, distances held at once.
BLOCK, SLAB = 2048, 1 << 20
#: More than single precision can be wrong by, of a product of unit vectors.
SCREEN = 1e-4
PACKED = "block long, ids array<long>, flat array<double>"


def packed(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (id, v) gathered into blocks of up to ``block`` vectors, where they lie; a block goes by its least id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                rows = batch.slice(at, block)
                flat = rows.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                ids = rows.column("id").to_pylist()
                yield pa.RecordBatch.from_pydict({"block": pa.array([min(ids)], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "flat": pa.array([flat], pa.list_(pa.float64()))})

    return vectors.where(F.col("v").isNotNull() & (F.size("v") > 0)).mapInArrow(run, PACKED)


def distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):  # NaN for a zero vector
            return 1 - (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
    if metric == "hamming":  # of sign bits
        return ((a[:, None, :] > 0) != (b[None, :, :] > 0)).sum(axis=2).astype(np.float64)
    if metric == "l1":
        return np.stack([np.abs(b - x).sum(axis=1) for x in a])
    return np.sqrt(np.maximum(0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T))


def block_pairs(pairs: DataFrame, pick: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, ...]], schema: str) -> DataFrame:
    """Applies ``pick(ids, vectors, other ids, other vectors)`` to each pair of blocks."""
    names = [f.split()[0] for f in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, av, b, bv = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "flat", "ids2", "flat2"))
                yield pa.RecordBatch.from_arrays([*map(pa.array, pick(a, av.reshape(len(a), -1), b, bv.reshape(len(b), -1)))], names=names)

    return pairs.select("ids", "flat", "ids2", "flat2").mapInArrow(run, schema)


def second(blocks: DataFrame) -> DataFrame:
    return blocks.withColumnsRenamed({"block": "block2", "ids": "ids2", "flat": "flat2"})


def least_of_rows(d: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k least finite values of each row, to nine digits, equal ones by id."""
    r = np.round(d, 9)
    if k < r.shape[1]:
        i, j = np.nonzero(np.isfinite(r) & (r <= np.partition(r, k - 1, axis=1)[:, k - 1: k]))
    else:
        i, j = np.nonzero(np.isfinite(r))
    order = np.lexsort((ids[j], r[i, j], i))
    i, j = i[order], j[order]
    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[kept], j[kept]


def nearest(queries: DataFrame, base: DataFrame, k: int, metric: str = "cosine", within: float | None = None, where: Column | None = None, itself: bool = False) -> DataFrame:
    """query, id, distance, rank (from 1): the k nearest of ``base`` by (distance, id).

    ``where`` is a filter on any columns of ``base`` (ids, partition keys, metadata), applied before the
    search; ``within`` is a strict bound on the distance. Each query itself is excluded, unless ``itself``.
    """

    def pick(q, qv, ids, v):
        d = np.concatenate([distances(qv[i: i + 64], v, metric) for i in range(0, len(q), 64)]) if metric == "hamming" else distances(qv, v, metric)
        if not itself:
            d[q[:, None] == ids[None, :]] = np.inf
        d[~(d < (np.inf if within is None else within))] = np.inf
        i, j = least_of_rows(d, ids, k)
        return q[i], ids[j], d[i, j]

    base = base if where is None else base.where(where)
    pairs = packed(queries.select("id", "v")).crossJoin(second(packed(base.select("id", "v"))))  # blocks, not rows
    found = block_pairs(pairs, pick, "query long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.round("distance", 9), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest_levels(queries: DataFrame, base: DataFrame, levels: int, digits: int, metric: str = "l2") -> DataFrame:
    """query, id, distance (rounded to ``digits``): all of ``base`` at the ``levels`` least different rounded distances, but the query itself."""

    def pick(q, qv, ids, v):
        d = distances(qv, v, metric)
        d[q[:, None] == ids[None, :]] = np.inf
        # where numpy and Spark round a half differently, a level of the one touches three of the other's at most
        near, most = np.sort(np.round(d, digits), axis=1), 3 * levels
        level = np.cumsum(np.diff(near, axis=1, prepend=near[:, :1]) > 0, axis=1)
        bound = np.where(level < most, near, -np.inf).max(axis=1)
        i, j = np.nonzero(np.isfinite(d) & (np.round(d, digits) <= bound[:, None]))
        return q[i], ids[j], d[i, j]

    pairs = packed(queries.select("id", "v")).crossJoin(second(packed(base.select("id", "v"))))  # blocks, not rows
    found = block_pairs(pairs, pick, "query long, id long, distance double").withColumn("distance", F.round("distance", digits))
    rank = F.dense_rank().over(Window.partitionBy("query").orderBy("distance"))
    return found.withColumn("rank", rank).where(F.col("rank") <= levels).drop("rank")


def slabs(a: np.ndarray, av: np.ndarray, b: np.ndarray, bv: np.ndarray, metric: str, accept: Callable[[np.ndarray], np.ndarray], most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The accepted pairs (least id, greatest id, distance) of two blocks, ``SLAB`` distances at a time.

    Of a block with itself each pair comes once. With ``most``, a slab leaves out what is farther than
    that many of its pairs, by more than a rounding to nine digits can change.
    """
    itself, step = np.array_equal(a, b), max(1, SLAB // max(1, len(b)))
    for at in range(0, len(a), step):
        d = distances(av[at: at + step], bv, metric)
        i, j = np.nonzero(accept(d) & (a[at: at + step, None] != b[None, :]))
        if itself:
            i, j = i[i + at < j], j[i + at < j]
        far = d[i, j]
        if most is not None and len(far) > most:
            kept = far <= np.partition(far, most - 1)[most - 1] + 1e-8
            i, j, far = i[kept], j[kept], far[kept]
        x, y = a[at: at + step][i], b[j]
        yield np.minimum(x, y), np.maximum(x, y), far


def all_pairs(vectors: DataFrame, metric: str, accept: Callable[[np.ndarray], np.ndarray], value: str, most: int | None = None) -> DataFrame:
    """a < b and ``value``, the distance: pairs that ``accept`` takes, from the upper triangle of blocks; ``most`` as in :func:`slabs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, av, b, bv = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "flat", "ids2", "flat2"))
                for found in slabs(a, av.reshape(len(a), -1), b, bv.reshape(len(b), -1), metric, accept, most):
                    yield pa.RecordBatch.from_arrays([*map(pa.array, found)], names=["a", "b", value])

    blocks = packed(vectors)
    pairs = blocks.crossJoin(second(blocks)).where(F.col("block") <= F.col("block2"))
    return pairs.select("ids", "flat", "ids2", "flat2").mapInArrow(run, f"a long, b long, {value} double")


def similar_pairs(vectors: DataFrame, above: float) -> DataFrame:
    """a < b, similarity: all pairs with a cosine above the threshold; ids must be distinct. A zero vector is like none."""
    near = all_pairs(vectors, "cosine", lambda d: 1 - d > above, "distance")
    return near.select("a", "b", (1 - F.col("distance")).alias("similarity"))


def near_pairs(vectors: DataFrame, similarity: float, most: int) -> DataFrame:
    """a < b, distance, similarity: the ``most`` nearest pairs with an L2 distance under sqrt(2 (1 - similarity)), as of unit vectors."""
    bound = float(np.sqrt(2 * (1 - similarity)))
    pairs = all_pairs(vectors, "l2", lambda d: d < bound, "distance", most).withColumn("similarity", 1 - F.col("distance") * F.col("distance") / 2)
    return pairs.orderBy(F.round("distance", 9), "a", "b").limit(most)


def best_partners(queries: DataFrame, base: DataFrame, above: float) -> DataFrame:
    """id, partner, similarity: of each query the other vector with the highest cosine above the threshold (to nine digits, then by id).

    Blocks are screened in single precision; what comes near the best of its row is computed again, term by
    term, so that both vectors of a pair get the same number.
    """

    def best(a: np.ndarray, av: np.ndarray, b: np.ndarray, bv: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y, s = above_in(av, bv, above, best=True, ids=a, others=b)
        order = np.lexsort((b[y], -np.round(s, 9), x))
        first = order[np.unique(x[order], return_index=True)[1]]
        return a[x[first]], b[y[first]], s[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "ids2"))
                av, bv = (np.frombuffer(batch.column(c)[i].as_buffer()).reshape(n, -1) for c, n in (("flat", len(a)), ("flat2", len(b))))
                yield pa.RecordBatch.from_arrays([*map(pa.array, best(a, av, b, bv))], names=["id", "partner", "similarity"])

    pairs = packed_units(queries).drop("block").crossJoin(second(packed_units(base)).drop("block2"))  # blocks, not rows
    found = pairs.mapInArrow(run, "id long, partner long, similarity double")
    least = F.min(F.struct((-F.round("similarity", 9)).alias("order"), "partner", "similarity")).alias("best")
    return found.groupBy("id").agg(least).select("id", "best.partner", "best.similarity")


def above_in(av: np.ndarray, bv: np.ndarray, above: float, best: bool = False, ids: np.ndarray | None = None, others: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, other row, cosine: pairs of unit vectors above the threshold; with ``best`` those near the best of their row. Equal ids are no pair."""
    rough_a, rough_b = av.astype(np.float32), bv.astype(np.float32)
    found, step = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], max(1, SLAB // len(bv))
    for at in range(0, len(av), step):
        rough = rough_a[at: at + step] @ rough_b.T
        if ids is not None:
            rough[ids[at: at + step, None] == others[None, :]] = -2
        high = np.maximum(rough.max(axis=1), above) if best else np.full(len(rough), above)
        i, j = np.nonzero(rough >= high[:, None].astype(np.float32) - np.float32(SCREEN))
        for part in range(0, len(i), SLAB // 16):
            x, y = i[part: part + SLAB // 16] + at, j[part: part + SLAB // 16]
            s = (av[x] * bv[y]).sum(axis=1)
            found.append((x[s > above], y[s > above], s[s > above]))
    return tuple(map(np.concatenate, zip(*found)))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def units(v: np.ndarray) -> np.ndarray:
    """Rows of unit length; zero rows stay."""
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return np.divide(v, length, out=np.zeros_like(v), where=length > 0)


def packed_units(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """As :func:`packed`, of unit length and as bytes; a zero vector, which is like none, is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                rows = batch.slice(at, block)
                v = rows.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)
                length = np.linalg.norm(v, axis=1)
                ids = rows.column("id").to_numpy()[length > 0]
                if len(ids):
                    unit = v[length > 0] / length[length > 0, None]
                    yield pa.RecordBatch.from_arrays([pa.array([ids.min()], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([unit.tobytes()], pa.binary())], names=["block", "ids", "flat"])

    return vectors.where(F.col("v").isNotNull() & (F.size("v") > 0)).select("id", "v").mapInArrow(run, "block long, ids array<long>, flat binary")


def pair_counts(vectors: DataFrame, above: float) -> DataFrame:
    """id, n: how many similar pairs have the vector as their lesser id, in parts to be summed; pairs are counted where they are found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, av, b, bv = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("ids", "flat", "ids2", "flat2"))
                for low, _, _ in slabs(a, av.reshape(len(a), -1), b, bv.reshape(len(b), -1), "cosine", lambda d: 1 - d > above):
                    ids, n = np.unique(low, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["id", "n"])

    blocks = packed(vectors)
    pairs = blocks.crossJoin(second(blocks)).where(F.col("block") <= F.col("block2"))
    return pairs.select("ids", "flat", "ids2", "flat2").mapInArrow(run, "id long, n long")
