"""Change capture with Structured Streaming: files or change logs in, synced snapshots out.

A stream serialises its micro-batches, so no other lock guards a sync; a batch that fails is run again from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.functions import paths
from graphloom.schemas import EXCLUDE
from graphloom.storage import shared_folder
from graphloom.streaming.debounce import session_bursts

CHANGES = "path string, event string, ts timestamp"


def file_events(spark: SparkSession, root: str, exclude: tuple[str, ...] = EXCLUDE) -> DataFrame:
    """(path, event, ts) of new and changed files under a tree, as a stream.  The file source shows no deletions; a sync
    that any event starts finds those."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.*").load(root)
    out = files.select("path", F.lit("modified").alias("event"), F.col("modificationTime").alias("ts"))
    return out.where(paths.language_of(F.col("path")).isNotNull() & ~paths.excluded(paths.basename(F.col("path")), exclude) & ~F.col("path").contains("/.graphloom/"))


def logged_events(spark: SparkSession, folder: str, exclude: tuple[str, ...] = EXCLUDE) -> DataFrame:
    """The same from a folder to which something appends JSON lines of (path, event, ts); deletions included."""
    out = spark.readStream.schema(CHANGES).json(folder)
    return out.where(paths.language_of(F.col("path")).isNotNull() & ~paths.excluded(F.col("path"), exclude))


def bursts(events: DataFrame, quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Debounced in event time: one row for changes of a top folder that follow each other within ``quiet``.

    Folders are keys of their own, so a busy tree is no single group; ``on_change`` acts once for all bursts that end together.
    """
    folder = F.when(F.contains("path", F.lit("/")), F.substring_index("path", "/", 1)).otherwise("")
    return session_bursts(events.withColumn("key", folder), quiet, ["key"], "ts", late)


def on_change(events: DataFrame, act: Callable[[], object], every: str = "2 seconds", checkpoint: str | None = None) -> StreamingQuery:
    """Calls ``act`` once for each micro-batch with events, at most every so often: debouncing in processing time."""

    def batch(df: DataFrame, _: int) -> None:
        if not df.isEmpty():
            act()

    at = checkpoint or f"{shared_folder(events.sparkSession)}-stream"
    return events.writeStream.foreachBatch(batch).trigger(processingTime=every).option("checkpointLocation", at).start()


def upsert_stream(events: DataFrame, keys: list[str], order: str, merge: Callable[[DataFrame, int], None], checkpoint: str | None = None) -> StreamingQuery:
    """Hands each micro-batch's last row of every key to ``merge`` with the batch's number, so a batch that is run again
    can be recognised."""

    def batch(df: DataFrame, number: int) -> None:
        last = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.col(order)).alias("_r")).select("_r.*")
        merge(last, number)

    at = checkpoint or f"{shared_folder(events.sparkSession)}-stream"
    return events.writeStream.foreachBatch(batch).trigger(availableNow=True).option("checkpointLocation", at).start()
