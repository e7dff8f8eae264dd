"""What the training-data operators share: the shared folder, tables written there, text basics."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words and is stripped from lines.
ASCII_SPACE = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a local session gets a temporary folder of its own; a cluster's
    executors would each write to their own disk, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder for a table of this run."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it: later reads start from the files."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discarded(table: DataFrame) -> None:
    """Deletes the files of a table that :func:`stored` gave, once nothing reads them any more."""
    jvm = table.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(table.stored_at)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: Bitmaps of 32,768 ids that are broadcast, of 4 KB each; beyond, ids are joined by sorting.
MOST_BITMAPS = 8192


def by_ids(docs: DataFrame, ids: DataFrame, held: bool = True, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose ``key`` is (or with ``held=False`` is not) in the one column of ``ids``.

    The ids become bitmaps, so that dense ids take an eighth of a byte each and no text is shuffled;
    if they are so many or so sparse that there are over ``MOST_BITMAPS``, both sides are sorted.
    A null key is in no list.
    """
    ids = stored(ids.toDF("__id").select(F.col("__id").cast("long").alias("__id")).where("__id is not null").distinct(), "ids")
    bitmaps = stored(ids.groupBy(F.bitmap_bucket_number("__id").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("__id")).alias("__bits")), "bitmaps")
    doc = docs[key].cast("long")
    if bitmaps.count() > MOST_BITMAPS:
        return docs.join(ids.hint("merge"), doc == ids["__id"], "left_semi" if held else "left_anti")
    place = F.bitmap_bit_position(doc)
    byte = F.conv(F.hex(F.substring(bitmaps["__bits"], F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1, F.lit(False))
    found = docs.join(F.broadcast(bitmaps), F.bitmap_bucket_number(doc) == bitmaps["__bucket"], "left")
    return found.where(hit if held else ~hit).select(*[docs[f"`{c}`"] for c in docs.columns])


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else unchanged. ``lower`` does that to pure ASCII, and is much faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def text_key(text: Column) -> Column:
    """A 64-bit digest of a text; null has a digest too. Used beside doc_id to tell rows apart."""
    return F.xxhash64(text)
