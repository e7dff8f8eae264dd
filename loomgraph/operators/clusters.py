"""Theme artifacts: centroids, exemplars, top entities and families per cluster."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.vectors import cosine_similarity
from loomgraph.operators.storage import written


def weighted_means(rows: DataFrame, key: list[str], vector: str, weight: str | None = None) -> DataFrame:
    """key, mean: element-wise weighted mean of the vectors, as an array.

    Each Arrow batch adds up its vectors per key first, so a key's vectors reach the shuffle as few sums;
    those are sorted by key and added up in a stream.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    parts = rows.where(F.col(vector).isNotNull() & w.isNotNull()).select(*key, w.alias("__w"), F.col(vector).cast("array<double>").alias("__v"))
    kinds = ", ".join(f"`{k}` {parts.schema[k].dataType.simpleString()}" for k in key)
    sums = parts.mapInArrow(added_up(key), f"{kinds}, __w double, __v array<double>")
    ordered = sums.repartition(*key).sortWithinPartitions(*key)
    return ordered.mapInArrow(means(key), f"{kinds}, mean array<double>")


def groups_of(batch: pa.RecordBatch, key: list[str]) -> np.ndarray:
    """A number for each row, equal for equal keys (null equals null)."""
    number = np.zeros(batch.num_rows, np.int64)
    for k in key:
        codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
        number = np.unique(number * (codes.max(initial=0) + 1) + codes, return_inverse=True)[1]
    return number


def vector_sums(batch: pa.RecordBatch, number: np.ndarray, weights: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the vectors by number, and each number's first row; all vectors of a batch have one length."""
    flat, v = batch.column("__v").flatten().to_numpy(zero_copy_only=False), None
    if len(flat) % batch.num_rows or len(set(np.diff(batch.column("__v").offsets.to_numpy()))) > 1:
        raise ValueError("vectors of different dimensions")
    v = flat.reshape(batch.num_rows, -1) * (1 if weights is None else weights[:, None])
    first = np.unique(number, return_index=True)[1]
    out = np.zeros((len(first), v.shape[1]))
    np.add.at(out, number, v)
    return out, first


def added_up(key: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                number, weights = groups_of(batch, key), batch.column("__w").to_numpy()
                sums, first = vector_sums(batch, number, weights)
                yield rows_of(batch, key, first, {"__w": pa.array(np.bincount(number, weights))}, "__v", sums)

    return run


def rows_of(batch: pa.RecordBatch, key: list[str], first: np.ndarray, more: dict[str, pa.Array], name: str, v: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel()))
    return pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(first)) for k in key], *more.values(), lists], names=[*key, *more, name])


def means(key: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From sums sorted by key: the mean of each key; a key may go on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        finish = lambda b: rows_of(b, key, np.arange(b.num_rows), {}, "mean", b.column("__v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) / b.column("__w").to_numpy()[:, None])
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            number = groups_of(batch, key)
            number = np.cumsum(np.concatenate([[0], number[1:] != number[:-1]]))
            sums, first = vector_sums(batch, number, None)
            done = rows_of(batch, key, first, {"__w": pa.array(np.bincount(number, batch.column("__w").to_numpy()))}, "__v", sums)
            if done.num_rows > 1:
                yield finish(done.slice(0, done.num_rows - 1))
            held = done.slice(done.num_rows - 1)
        if held is not None:
            yield finish(held)

    return run


#: Bytes of the sums that one group of keys may take in a worker.
GROUP_BYTES = 256 << 20


def pooled(rows: DataFrame, vectors: DataFrame, key: list[str], sides: int = 1, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """key, m0, m1 ...: for each side the weighted mean of the vectors that a key's rows name, null without any.

    ``rows`` has the key's columns, id (of a vector), w and, from 0, side; ``vectors`` id, v. Keys without any vector
    have no row. Keys are dealt into groups and a vector goes once to each group that names it, not to every row:
    sorted by id it comes right before the rows, which add it to the sums of their keys. For few keys of very many
    rows see :func:`weighted_means`.
    """
    spark = rows.sparkSession
    rows, vectors = written(rows.where("id is not null and w is not null"), "pooled"), vectors.where("id is not null and v is not null").select("id", "v")
    first = vectors.limit(1).collect()
    n = rows.agg(F.approx_count_distinct(F.xxhash64(*key)).alias("n")).collect()[0]["n"]
    many = math.ceil(n * sides * 8 * len(first[0]["v"]) / group_bytes) if first else 1
    groups = math.ceil(max(many, 1) / spark.sparkContext.defaultParallelism) * spark.sparkContext.defaultParallelism
    dealt = rows.withColumn("g", F.pmod(F.xxhash64(*key), F.lit(groups)).cast("int"))
    sent = dealt.select("g", "id").distinct().join(vectors, "id").select("g", "id", F.lit(0).alias("kind"), "v", *[F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in key], F.lit(None).cast("int").alias("side"), F.lit(None).cast("double").alias("w"))
    side = F.col("side").cast("int") if sides > 1 else F.lit(0)
    named = dealt.select("g", "id", F.lit(1).alias("kind"), F.lit(None).cast(vectors.schema["v"].dataType).alias("v"), *key, side.alias("side"), F.col("w").cast("double").alias("w"))
    ordered = sent.unionByName(named).repartitionById(groups, "g").sortWithinPartitions("g", "id", "kind")
    kinds = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in key] + [f"m{i} array<double>" for i in range(sides)]
    return ordered.select("id", "kind", "v", *key, "side", "w").mapInArrow(pools(key, sides), ", ".join(kinds))


def vector_rows(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column("v")
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) % batch.num_rows or len(set(np.diff(v.offsets.to_numpy()))) > 1:
        raise ValueError("vectors of different dimensions")
    return flat.reshape(batch.num_rows, -1)


def pools(key: list[str], sides: int, rows_out: int = 4096) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A group's means from its vectors (kind 0) and rows (kind 1), sorted by id and kind; vectors of one id are added up and counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: dict[tuple, int] = {}
        sums, weights, schema = np.zeros((0, 0)), np.zeros(0), None
        last_id, last, last_n = None, np.zeros((1, 0)), 0  # the vector that the next batch's first rows may name
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            kind = batch.column("kind").to_numpy()
            ids = batch.column("id")
            found = np.flatnonzero(kind == 0)
            v = vector_rows(batch.filter(pc.equal(batch.column("kind"), 0))) if len(found) else np.zeros((0, last.shape[1]))
            if last_n and v.shape[1] != last.shape[1]:
                raise ValueError("vectors of different dimensions")
            counts = np.ones(len(v))
            of = ids.take(pa.array(found)).to_pylist()
            if last_n:
                v, counts, of = np.concatenate([last, v]), np.concatenate([[last_n], counts]), [last_id, *of]
            if not of:
                continue
            starts = np.flatnonzero([True, *(a != b for a, b in zip(of, of[1:]))])
            v, counts, of = np.add.reduceat(v, starts), np.add.reduceat(counts, starts), [of[i] for i in starts]
            # rows take the last vector before them, if it is theirs
            ends = np.searchsorted(starts, np.cumsum(kind == 0) + bool(last_n), "left") - 1
            named = np.flatnonzero(kind == 1)
            at = ends[named]
            own = np.array([i >= 0 and of[i] == x for i, x in zip(at.tolist(), ids.take(pa.array(named)).to_pylist())], bool)
            named, at = named[own], at[own]
            if len(named):
                if not sums.shape[1]:
                    sums = np.zeros((0, v.shape[1]))
                part = batch.take(pa.array(named))
                code = np.array([places.setdefault(k, len(places)) for k in zip(*(part.column(c).to_pylist() for c in key))]) * sides + part.column("side").to_numpy()
                if len(places) * sides > len(sums):
                    room = max(len(places) * sides, len(sums) * 5 // 4, 4096 * sides)
                    sums.resize((room, v.shape[1]), refcheck=False)
                    weights.resize(room, refcheck=False)
                w = part.column("w").to_numpy()
                order = np.argsort(code, kind="stable")
                begin = np.flatnonzero(np.diff(code[order], prepend=-1))
                sums[code[order[begin]]] += np.add.reduceat(w[order, None] * v[at[order]], begin)
                np.add.at(weights, code, w * counts[at])
            last_id, last, last_n = of[-1], v[-1:], counts[-1]
        keys = list(places)
        for i in range(0, len(keys), rows_out):
            some = keys[i:i + rows_out]
            out = [pa.array([k[c] for k in some], schema.field(name).type) for c, name in enumerate(key)]
            for side in range(sides):
                at = np.arange(i, i + len(some)) * sides + side
                none = weights[at] == 0
                mean = sums[at[~none]] / weights[at[~none], None]
                offsets = np.concatenate([[0], np.cumsum(~none) * sums.shape[1]]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(mean.ravel()), mask=pa.array(none)))
            yield pa.RecordBatch.from_arrays(out, names=[*key, *(f"m{s}" for s in range(sides))])

    return run


def exemplars(members: DataFrame, centroids: DataFrame, k: int = 10) -> DataFrame:
    """cluster, id, similarity, rank (from 0): the members nearest to their centroid."""
    scored = members.join(centroids, "cluster").select("cluster", "id", cosine_similarity(F.col("v"), F.col("mean")).alias("similarity"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc(F.round("similarity", 9)), "id")) - 1
    return scored.withColumn("rank", rank).where(F.col("rank") < k)


def top_by_sum(rows: DataFrame, key: str, label: str, value: str, k: int) -> DataFrame:
    per = rows.groupBy(key, label).agg(F.sum(value).alias("score"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), label))
    return per.withColumn("rank", rank).where(F.col("rank") <= k)


def auto_labels(entities: DataFrame, families: DataFrame) -> DataFrame:
    """cluster, label: its two first entities and its first family (rows as of ``top_by_sum``); "Cluster" without entities."""
    first = entities.where("rank <= 2").groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "node"))), lambda s: s["node"]), ", ").alias("names"))
    both = first.join(families.where("rank = 1").select("cluster", "family"), "cluster", "full")
    label = F.when(F.col("names").isNull(), "Cluster").otherwise(F.concat_ws(" — ", "names", "family"))
    return both.select("cluster", label.alias("label"))
