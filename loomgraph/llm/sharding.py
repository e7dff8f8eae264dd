"""Operator 10: sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal texts form a group that stays in one shard. Groups of at least ``1/fine`` of a
shard are items of their own: there are at most ``fine`` x shards of them, whatever the data. The
smaller groups are hashed into ``fine`` x shards packets, which are items too. So the packing runs
over a number of items that is bounded by the parameters, and rows only meet their item's shard in
a join of narrow rows; texts are read, never shuffled.

Items in decreasing size enter the bin with the tightest sufficient remaining capacity, found in a
balanced tree. Without a given capacity, the least one for which the shards suffice is searched.

Defined results: a null text has 0 bytes and is equal to other null texts, not to the empty text;
size counts one more than the bytes; a group larger than the capacity opens a shard of its own or,
when none is left, goes to the emptiest; groups of equal size go by their digests; repeated rows are
one group and have slots of their own; a row with null doc_id is a row like others; a very long text
is a large group; an empty table gives an empty result; other columns, whatever their names, are
ignored by the report and written along.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from random import Random

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import stored


@dataclass
class _Node:
    key: tuple[int, int]
    rank: float
    left: _Node | None = None
    right: _Node | None = None


@dataclass
class CapacityTree:
    """A balanced tree (treap) of (remaining capacity, bin): insert, remove, tightest fit."""

    root: _Node | None = None
    random: Random = field(default_factory=lambda: Random(7))

    def _split(self, node, key):
        if node is None:
            return None, None
        if node.key < key:
            node.right, more = self._split(node.right, key)
            return node, more
        less, node.left = self._split(node.left, key)
        return less, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a.rank > b.rank:
            a.right = self._merge(a.right, b)
            return a
        b.left = self._merge(a, b.left)
        return b

    def insert(self, key: tuple[int, int]) -> None:
        less, more = self._split(self.root, key)
        self.root = self._merge(self._merge(less, _Node(key, self.random.random())), more)

    def remove(self, key: tuple[int, int]) -> None:
        less, more = self._split(self.root, key)
        _, more = self._split(more, (key[0], key[1] + 1))
        self.root = self._merge(less, more)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The smallest (remaining, bin) with remaining >= size."""
        node, best = self.root, None
        while node is not None:
            node, best = (node.left, node.key) if node.key[0] >= size else (node.right, best)
        return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item. Bins open as needed; an item above the capacity has a bin of its own."""
    tree, bins, n = CapacityTree(), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.tightest(sizes[i])
        if found is None:
            found, n = (max(capacity, sizes[i]), n), n + 1
        else:
            tree.remove(found)
        bins[i] = found[1]
        tree.insert((found[0] - sizes[i], found[1]))
    return bins


def pack_into(sizes: list[int], shards: int) -> list[int]:
    """Best fit decreasing at the least capacity that needs no more than ``shards`` bins."""
    if not sizes:
        return []
    low, high = max(max(sizes), -(-sum(sizes) // shards)), max(max(sizes), -(-2 * sum(sizes) // shards)) + max(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if max(best_fit_decreasing(sizes, middle)) < shards else (middle + 1, high)
    return best_fit_decreasing(sizes, low)


def byte_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def numbered(rows: DataFrame, by: str, order: list[str], cell: Column | None = None, cells: int = 1024) -> DataFrame:
    """Adds slot, a gapless number from 0 within ``by``. ``by`` has few values, so each is cut into
    cells: numbers run within (by, cell) and a table of cell counts gives each cell its start. Without
    ``cell``, whose order the numbers follow, rows are dealt by hash."""
    cell = F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int") if cell is None else cell
    rows = rows.withColumn("__cell", cell)
    starts = rows.groupBy(by, "__cell").agg(F.count("*").alias("__n"))
    starts = starts.withColumn("__start", F.coalesce(F.sum("__n").over(Window.partitionBy(by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    within = rows.withColumn("__in", F.row_number().over(Window.partitionBy(by, "__cell").orderBy(*order)) - 1)
    return within.join(starts, [by, "__cell"]).withColumn("slot", (F.col("__start") + F.col("__in")).cast("long")).drop("__cell", "__in", "__start")


def shard(rows: DataFrame, group: list[str], size: str, shards: int | None = 16, capacity: int | None = None, fine: int = 256) -> DataFrame:
    """Adds the int column shard to narrow ``rows``: near equal in ``size``, ``group`` undivided.

    With ``capacity`` the number of shards follows (as few as best fit decreasing needs), else there
    are ``shards`` of them.
    """
    spark = rows.sparkSession
    groups = stored(rows.groupBy(*group).agg(F.sum(size).alias("__bytes")), "groups")
    total = groups.agg(F.coalesce(F.sum("__bytes"), F.lit(0))).first()[0]
    room = capacity or max(1, -(-total // shards))
    least, packets = max(1, room // fine), fine * (-(-total // room) if capacity else shards)
    large = groups.where(F.col("__bytes") >= least)
    packet = F.pmod(F.xxhash64(*group, F.lit(10)), F.lit(packets))
    # at most total / least large groups and `packets` packets: bounded by the parameters
    small = groups.where(F.col("__bytes") < least).groupBy(packet.alias("__packet")).agg(F.sum("__bytes").alias("__bytes")).orderBy("__packet").collect()
    alone = large.orderBy(*group).collect()
    sizes = [r["__bytes"] for r in alone] + [r["__bytes"] for r in small]
    bins = best_fit_decreasing(sizes, capacity) if capacity else pack_into(sizes, shards)
    of_packet = {r["__packet"]: b for r, b in zip(small, bins[len(alone):])}
    own = spark.createDataFrame([(*(r[g] for g in group), b) for r, b in zip(alone, bins)], large.select(*group).schema.add("__own", IntegerType()))
    table = spark.createDataFrame(list(of_packet.items()), "__packet long, __shared int")
    placed = rows.withColumn("__packet", packet).join(F.broadcast(own), group, "left").join(F.broadcast(table), "__packet", "left")
    return placed.withColumn("shard", F.coalesce("__own", "__shared")).drop("__own", "__shared", "__packet")


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id with its text's size, crc32 and the digests that stand for the text (never null)."""
    text = F.col("text")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    return docs.select("doc_id", byte_size(text).alias("size"), crc.alias("text_crc32"), F.xxhash64(text.isNull(), text).alias("__text"))


def report(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; one row per row of ``docs``."""
    rows = stored(narrow(docs), "rows")
    placed = shard(rows, ["__text", "text_crc32"], "size", shards)
    return numbered(stored(placed, "placed"), "shard", ["doc_id", "__text"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_shard_best_fit(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def placed(docs: DataFrame, shards: int) -> DataFrame:
    """``docs``, columns numbered c0 on, with __size, __text, __crc and shard."""
    text = F.col("`text`")
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], byte_size(text).alias("__size"), F.xxhash64(text.isNull(), text).alias("__text"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("__crc"))
    return shard(rows, ["__text", "__crc"], "__size", shards)


#: Columns that :func:`in_order` adds; documents' columns of those names are left out.
ADDED = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def in_order(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The documents with the columns of ``ADDED``; slots of a shard follow the order of ``docs``' files and their rows.

    Rows that don't come from Parquet files are written first, as they come.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED])
    at = [f"c{i}" for i in range(len(docs.columns))]
    try:
        rows = docs.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__at"))
    except AnalysisException:
        return in_order(stored(docs.toDF(*at), "documents").toDF(*docs.columns), shards)
    rows = placed(rows, shards).withColumnsRenamed({f"c{len(at)}": "__file", f"c{len(at) + 1}": "__at"})
    # narrow rows are numbered; a file is a range of the order, whose rows come from one task
    # by the number in the file's name: from 100,000 files on names don't sort like numbers
    number = F.regexp_extract("__file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    slots = numbered(stored(rows.select("shard", "__file", "__at"), "places"), "shard", ["__at"], F.struct(F.coalesce(number, F.lit(-1)).alias("n"), F.col("__file").alias("file"))).select("__file", "__at", "shard", "slot")
    found = rows.drop("shard").join(slots.hint("merge"), ["__file", "__at"])
    return found.select(*[F.col(n).alias(c) for n, c in zip(at, docs.columns)], F.col("__size").alias("size"), F.col("__crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16) -> None:
    """Writes whole documents to ``path``/__shard=N, each shard in order of doc_id over several files."""
    rows = placed(docs, shards)
    key = f"c{docs.columns.index('doc_id')}"
    ordered = rows.repartitionByRange("shard", key, "__text").sortWithinPartitions("shard", key)
    ordered.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)], F.col("shard").alias("__shard")).write.partitionBy("__shard").parquet(path)
