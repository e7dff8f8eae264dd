"""The status of every item over a stream: pending, processing, completed, failed, with retries by timers.

State is kept per item, so an item is processed once, whatever batch or run brings it again; a failed one
is tried again when it is sent again, and by itself after ``wait`` seconds, ``most`` times in all. The
stream's checkpoint keeps states and timers over restarts and lost executors. A run with ``availableNow``
looks at timers in the batches that it has; one that goes on looks at them without new items, too.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What an item's text gives, as a value that JSON can hold; it may raise.
Extract = Callable[[int, str], object]
TRANSITIONS = "id long, attempt int, step int, status string, error string, result string"
STATE = "status string, attempts int, content string"
PENDING, PROCESSING, COMPLETED, FAILED = "pending", "processing", "completed", "failed"


class ItemStatus(StatefulProcessor):
    def __init__(self, extract: Extract, most: int, wait: float) -> None:
        self.extract, self.most, self.wait = extract, most, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("item", STATE)

    def tried(self, item: int, content: str, attempts: int, now: int) -> list[tuple]:
        """One attempt: the transitions that it makes, state and timer set."""
        steps = [(item, attempts, 0, PROCESSING, None, None)]
        try:
            result = json.dumps(self.extract(item, content))
        except Exception as e:  # noqa: BLE001 - the extraction is the caller's
            self.state.update((FAILED, attempts, content))
            if attempts < self.most:
                self.handle.registerTimer(now + max(1, int(self.wait * 1000)))  # never in the same batch
            return [*steps, (item, attempts, 1, FAILED, f"{type(e).__name__}: {e}", None)]
        self.state.update((COMPLETED, attempts, None))  # its text is needed no more
        return [*steps, (item, attempts, 1, COMPLETED, None, result)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # rows of one item in one batch are one arrival: the last text that isn't empty, in order of texts
        texts = sorted({t for part in rows for t in part["content"] if t})
        status, attempts, _ = self.state.get() if self.state.exists() else (PENDING, 0, None)
        if not texts:  # without content an item stays pending
            if status == PENDING and not self.state.exists():
                self.state.update((PENDING, 0, None))
                yield frame([(int(key[0]), 0, 0, PENDING, None, None)])
        elif status != COMPLETED:
            self.cleared()
            yield frame(self.tried(int(key[0]), texts[-1], attempts + 1, timerValues.getCurrentProcessingTimeInMs()))

    def cleared(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        status, attempts, content = self.state.get()
        if status == FAILED:
            yield frame(self.tried(int(key[0]), content, attempts + 1, timerValues.getCurrentProcessingTimeInMs()))

    def close(self) -> None:
        pass


def frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in TRANSITIONS.split(", ")])


def prepared(spark: SparkSession) -> None:
    """State of this kind needs the store that keeps it in files."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def transitions(items: DataFrame, extract: Extract, most: int = 3, wait: float = 60.0) -> DataFrame:
    """The transitions (columns of ``TRANSITIONS``) of a stream of items (id, content)."""
    prepared(items.sparkSession)
    return items.select(F.col("id").cast("long").alias("id"), "content").groupBy("id").transformWithStateInPandas(
        statefulProcessor=ItemStatus(extract, most, wait), outputStructType=TRANSITIONS, outputMode="Append", timeMode="ProcessingTime")


def write_transitions(items: DataFrame, path: str, checkpoint: str, extract: Extract, most: int = 3, wait: float = 60.0, trigger: dict | None = None):
    """Starts a stream that appends transitions under each batch's number, so that a repeated batch replaces itself."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    trigger = trigger or {"availableNow": True}
    # with timers there is always one more batch without data: a run that is to end goes without those
    spark, empty = items.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(empty)
    spark.conf.set(empty, "false" if "availableNow" in trigger else "true")
    try:
        out = transitions(items, extract, most, wait).writeStream.outputMode("append").foreachBatch(save)
        return out.option("checkpointLocation", checkpoint).trigger(**trigger).start()
    finally:
        spark.conf.set(empty, before)


def current(spark: SparkSession, path: str) -> DataFrame:
    """id, status, attempts, error, result: where each item stands."""
    rows = spark.read.schema(TRANSITIONS).parquet(path)
    last = rows.groupBy("id").agg(F.max_by(F.struct("status", "attempt", "error", "result"), F.struct("attempt", "step")).alias("s"))
    return last.select("id", "s.status", F.col("s.attempt").alias("attempts"), "s.error", "s.result")
