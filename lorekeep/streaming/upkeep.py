"""Structured Streaming upkeep of an index folder (survey Z1-Z9, K10).

A micro-batch of change events (path, kind 'add' | 'change' | 'unlink' | 'unreadable', seq, mtime, content) is coalesced to the
last event of each path, events older than the stored state are dropped, and the new snapshot is written beside
the old one under a name of its own; the pointer then names it with the number of the batch.  A batch whose number the
pointer already has, or has passed, is skipped, and a snapshot that a run left without a pointer is never read, so a
batch that runs again has the same effect and no snapshot is overwritten while it is read.

A deleted path leaves a tombstone with its place in the order, so that an event which comes late does not bring it back; tombstones go
when events are ``KEEP`` later.  A file that is no text is quarantined: its path has no current row until a readable
version comes, and the stream goes on.  With a ``SegmentedIndex`` the notes of each batch are parsed, cut into chunks and indexed as one segment.
File sources give new paths only: ``sync`` finds changes and deletions from an inventory.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.maintenance import diff, latest_events, upsert
from ..operators.segments import SegmentedIndex
from ..session import stored
from ..sources import markdown, scans

#: ``status``: live, gone or unreadable.
STATE = "path string, mtime timestamp, content string, revision long, seq long, status string"
KEEP = "30 days"


def pointer(spark: SparkSession, folder: str) -> tuple[int, str] | None:
    """Number and snapshot of the newest batch; none only if no pointer was ever written, any other failure is raised."""
    try:
        row = spark.read.schema("batch long, snapshot string").json(f"{folder}/pointer").agg(F.max("batch"), F.max_by("snapshot", "batch")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return None if row[0] is None else (row[0], row[1])


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """What the newest pointer names, tombstones and quarantined paths included; empty at first."""
    newest = pointer(spark, folder)
    return spark.read.schema(STATE).parquet(f"{folder}/{newest[1]}") if newest else spark.createDataFrame([], STATE)


def current(spark: SparkSession, folder: str) -> DataFrame:
    """(path, mtime, content, revision) of the notes there are."""
    return snapshot(spark, folder).where("status = 'live'").select("path", "mtime", "content", "revision")


def quarantined(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind) of files that cannot be read as text."""
    return snapshot(spark, folder).where("status = 'unreadable'").select("path", F.lit("md").alias("kind"))


def changes(state: DataFrame, events: DataFrame) -> DataFrame:
    """The last event of each path that is newer than what is stored, by seq and by mtime, with the ``revision`` it leads to."""
    known = state.select("path", F.col("seq").alias("known_seq"), F.col("mtime").alias("known_mtime"), F.col("revision").alias("before"))
    last = latest_events(events.where("path is not null")).join(known, "path", "left")
    newer = (F.col("known_seq").isNull() | (F.col("seq") > F.col("known_seq"))) & (F.col("known_mtime").isNull() | F.col("mtime").isNull() | (F.col("mtime") >= F.col("known_mtime")))
    status = F.when(F.col("kind") == "unlink", "gone").when(F.col("kind") == "unreadable", "unreadable").otherwise("live")
    revision = F.coalesce("before", F.lit(0)) + F.when(status == "live", 1).otherwise(0)
    return last.where(newer).select("path", F.coalesce("mtime", "known_mtime").alias("mtime"), F.when(status == "live", F.col("content")).alias("content"), revision.cast("long").alias("revision"), F.col("seq").cast("long").alias("seq"), status.alias("status"))


def apply(state: DataFrame, events: DataFrame, keep: str = KEEP) -> DataFrame:
    """The state after a batch of events."""
    return _merged(state, changes(state, events), keep)


def _merged(state: DataFrame, fresh: DataFrame, keep: str) -> DataFrame:
    every = upsert(state, fresh, fresh.limit(0))
    newest = fresh.agg(F.max("mtime").alias("newest"))  # one row
    expired = (F.col("status") == "gone") & (F.col("mtime") < F.col("newest") - F.expr(f"interval {keep}"))
    return every.crossJoin(F.broadcast(newest)).where(~F.coalesce(expired, F.lit(False))).drop("newest")


def batch_writer(folder: str, index: SegmentedIndex | None = None, keep: str = KEEP):
    """For ``foreachBatch``: exactly once by batch number, for the state and for the index."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = pointer(spark, folder)
        if newest and number <= newest[0]:
            return
        state = snapshot(spark, folder)
        fresh = stored(changes(state, batch), "upkeep-changes")
        if index:
            append_notes(index, number, fresh)  # before the pointer: if it fails, the batch runs again and the index skips what it has
        name = f"snapshot-{number}-{uuid.uuid4().hex}"
        _merged(state, fresh, keep).write.parquet(f"{folder}/{name}")
        spark.createDataFrame([(number, name)], "batch long, snapshot string").coalesce(1).write.mode("append").json(f"{folder}/pointer")

    return write


def append_notes(index: SegmentedIndex, number: int, fresh: DataFrame) -> None:
    """One segment of the chunks of the live notes; paths that are gone or unreadable are dropped from the index."""
    notes = stored(markdown.notes(fresh.where("status = 'live'")), "upkeep-notes")
    index.append(number, notes.select("path", "body"), markdown.chunk_rows(notes).select("path", "chunk_index", "content", "title", "aliases"), fresh.where("status <> 'live'").select("path"))


def deletions(live: DataFrame, state: DataFrame) -> DataFrame:
    """Unlink events for stored paths that an inventory no longer has."""
    return diff(live, state).where("change = 'deleted'").select("path")


def sync(spark: SparkSession, root: str, folder: str, index: SegmentedIndex | None = None, strict: bool = False, pattern: str = "md") -> dict[str, int]:
    """One batch from an inventory of ``root``: files that are new or changed since the newest snapshot are read, those that have gone are unlinked.

    How many of each there were is returned.  ``strict`` raises on a file that is no text before anything is written; else it is quarantined.
    Only files at least as young as the oldest change are opened (the age is a filter that the scan takes)."""
    files = scans.files(spark, root, pattern)
    state = snapshot(spark, folder)
    there = state.where("status <> 'gone'")
    found = stored(diff(files.select("path", "mtime"), there).where("change <> 'unchanged'").join(files.select("path", "mtime"), "path", "left"), "sync-diff")
    counts = {r.change: r.n for r in found.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return counts
    oldest = found.agg(F.min("mtime")).first()[0]
    changed = found.where("change <> 'deleted'").select("path")
    fresh = (files.where(F.col("mtime") >= F.lit(oldest)) if oldest else files.limit(0)).join(changed, "path", "left_semi")
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    known = state.select("path", F.col("seq").alias("before"))
    seq = F.greatest(F.unix_micros("mtime"), F.coalesce("before", F.lit(0)) + 1)  # after all that is known of the path
    read = fresh.join(known, "path", "left").select("path", F.when(valid, "change").otherwise("unreadable").alias("kind"), seq.alias("seq"), "mtime", F.when(valid, text).alias("content"))
    gone = found.where("change = 'deleted'").join(known, "path", "left").select("path", F.lit("unlink").alias("kind"), (F.col("before") + 1).alias("seq"), F.lit(None).cast("timestamp").alias("mtime"), F.lit(None).cast("string").alias("content"))
    events = stored(read.unionByName(gone), "sync-events")
    counts["unreadable"] = events.where("kind = 'unreadable'").count()
    if strict and counts["unreadable"]:
        raise ValueError(f"{counts['unreadable']} files are not valid UTF-8, such as {events.where(F.col('kind') == 'unreadable').first().path}")
    newest = pointer(spark, folder)
    batch_writer(folder, index)(events, newest[0] + 1 if newest else 0)
    return counts


def file_events(spark: SparkSession, folder: str, max_files: int = 1000, pattern: str = "*.md") -> DataFrame:
    """A stream of new files, at most ``max_files`` a micro-batch, read whole; ``seq`` is the time of the change, paths are relative to the folder.

    What is waiting beyond that stays in the source until the next batch, so a burst never grows a batch.  A file that is not valid UTF-8 is
    an event of kind ``unreadable`` without content.  Spark's file source gives each path once: changes and deletions are what ``sync`` finds."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    return files.select(
        scans.below(folder, F.col("path")).alias("path"), F.when(valid, "change").otherwise("unreadable").alias("kind"), F.unix_micros("modificationTime").alias("seq"), F.col("modificationTime").alias("mtime"), F.when(valid, text).alias("content"),
    )


def start(events: DataFrame, folder: str, checkpoint: str, available_now: bool = True, index: SegmentedIndex | None = None):
    writer = events.writeStream.foreachBatch(batch_writer(folder, index)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Event counts by time window with a watermark (an addition: event time plays no part in index upkeep)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
