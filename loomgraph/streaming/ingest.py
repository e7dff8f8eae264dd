"""Streaming ingestion: files of feed items to deduplicated micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgraph.operators.pipelines import Extractor, processed


def feed_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_seen(items: DataFrame, key: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Each key once while within the watermark."""
    return items.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def write_batches(items: DataFrame, path: str, checkpoint: str, enrich: Callable[[DataFrame], DataFrame] = lambda df: df):
    """Appends every micro-batch, enriched, under its batch number, so that a repeated batch replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        enrich(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return items.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def process_batches(items: DataFrame, path: str, checkpoint: str, extract: Extractor):
    """Every micro-batch of items to new rows of the hypergraph's tables and a status row each, all under its batch number.

    A batch that is repeated replaces itself; a failed one leaves its items failed, for a later run.
    """

    def run(batch: DataFrame, number: int) -> None:
        status = batch.sparkSession.createDataFrame([], batch.select("id").schema.add("status", "string").add("error", "string"))
        rows, after = processed(batch, status, extract)
        for name, table in (rows | {"status": after}).items():
            table.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return items.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_status(spark: SparkSession, path: str) -> DataFrame:
    """id, status, error of the latest batch that had the item."""
    rows = spark.read.parquet(f"{path}/status")
    return rows.groupBy("id").agg(F.max_by(F.struct("status", "error"), "batch").alias("s")).select("id", "s.*")


def event_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
