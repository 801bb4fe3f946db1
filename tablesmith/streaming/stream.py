"""Micro-batch versions: pages arrive as a stream, are parsed, extracted, validated and appended as they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablesmith.operators.validate import Field, validate
from tablesmith.plans.engine import page_rows


def validated_pages(pages: DataFrame, fields: list[Field], min_confidence: float = 0.5) -> DataFrame:
    """pages, batch or streaming -> validated rows; the same plan for both."""
    rows = page_rows(pages, fields).withColumn("seq", F.xxhash64("source_url", "place", "data"))
    return validate(rows, fields, min_confidence)


def distinct_arrivals(rows: DataFrame, key: str, at: str, within: str = "1 day") -> DataFrame:
    """The first arrival of each key within the watermark."""
    return rows.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, at: str, by: str, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n"))


class Stopped(Exception):
    """Raised in place of a batch that came after the stop, so that it isn't committed."""


class Appending:
    """A running append that a rule can stop; see append_until."""

    def __init__(self, query: StreamingQuery, done: dict):
        self.query, self._done = query, done

    @property
    def stopped(self) -> bool:
        """Whether the rule has stopped it."""
        return self._done["stop"]

    def awaitTermination(self, timeout: float | None = None) -> bool | None:
        """As StreamingQuery's; ends without an error if the rule stopped the query."""
        try:
            return self.query.awaitTermination(timeout)
        except StreamingQueryException:
            if not self.stopped:
                raise
            return True

    def stop(self) -> None:
        self.query.stop()


def append_until(rows: DataFrame, path: str, checkpoint: str, stop: Callable[[DataFrame, int], bool], **trigger) -> Appending:
    """Append micro-batches to Parquet; after the batch for which stop(batch, id) is true no further one is written.

    A batch that comes after the stop fails and so isn't committed: a restart from the checkpoint (resuming) begins with
    it and loses nothing. A batch that is written again, after a lost driver, replaces its own folder.
    """
    done = {"stop": False}

    def write(batch: DataFrame, number: int) -> None:
        if done["stop"]:
            raise Stopped(f"batch {number} comes after the stop")
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        done["stop"] = bool(stop(batch, number))

    return Appending(rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(), done)


def stream_table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def drained(appending: Appending) -> Appending:
    """Waits until all that a stream's source has now is written, then ends the stream; for sources that admit a part
    of it at a time."""
    try:
        appending.query.processAllAvailable()
    except StreamingQueryException:
        if not appending.stopped:
            raise
    appending.stop()
    return appending


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a key, batch or stream: key, start, last, n. Events of a key that are less than `gap` apart are one.

    In a stream a session comes once the watermark has passed its end; rows older than the watermark are dropped, and
    counted by metrics.Counters (late).
    """
    w = F.session_window(at, gap)
    return events.withWatermark(at, late).groupBy(key, w).agg(F.min(at).alias("start"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n")).drop("session_window")
