"""Incremental ingest, job states and windowed counts with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .. import constants as C
from ..operators import catalog
from ..operators.index_store import SearchIndex
from ..plans.tables import at_rest


def file_stream(spark: SparkSession, path: str, session_id: str = "default") -> DataFrame:
    """A stream of files with sha256 and document_id. It holds no state; ingest_stream keeps out what was there before."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)
    named = raw.select("path", "content", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), F.lit(session_id).alias("session_id"))
    return catalog.register(named)


def ingest_stream(files: DataFrame, ingest: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs ingest(batch, batch_id) for every batch of files that is there, each content once for a session; the checkpoint makes a
    restart go on after the last one. What has been seen is a table of hashes beside the checkpoint, not state of the stream: 256 folders by a hash's first
    two digits, in each of which the last two batches that met it left all its hashes. So a batch reads one folder for each first digits of its own, however many
    batches there were, and one that is run again finds what it found before."""

    def run(batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, f"{checkpoint}/seen"
        new = at_rest(catalog.latest(batch, ["session_id", "sha256"], [F.col("document_id")]).select(*batch.columns, F.substring("sha256", 1, 2).alias("first")), "batch")
        here = {r["first"]: _batches(spark, f"{at}/first={r['first']}") for r in new.select("first").distinct().collect()}  # 256 at most
        last = {f: max((n for n in found if n < number), default=None) for f, found in here.items()}
        held = [f"{at}/first={f}/batch={n}" for f, n in last.items() if n is not None]
        keys = new.select("session_id", "sha256", "first")
        if held:
            before = spark.read.schema("session_id string, sha256 string, first string, batch bigint").option("basePath", at).parquet(*held).drop("batch")
            new = at_rest(new.join(before, ["session_id", "sha256"], "left_anti"), "new")
            keys = before.unionByName(new.select(keys.columns))
        told = keys.withColumn("batch", F.lit(number).cast("bigint")).repartition("first")
        told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("first", "batch").parquet(at)
        ingest(new.select(batch.columns), number)
        for f, found in here.items():
            for n in found:
                if n < number and n != last[f]:
                    _delete(spark, f"{at}/first={f}/batch={n}")

    return files.writeStream.foreachBatch(run).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def _place(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _batches(spark: SparkSession, path: str) -> list[int]:
    fs, at = _place(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))


def _delete(spark: SparkSession, path: str) -> None:
    fs, at = _place(spark, path)
    fs.delete(at, True)


def index_stream(nodes: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Adds every batch of a stream of nodes to the search index in a folder. A batch that is run again replaces its documents by themselves."""

    def run(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            SearchIndex.open(batch.sparkSession, root).add(at_rest(batch, "nodes"))

    return nodes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_states(events: DataFrame) -> DataFrame:
    """(job_id, status, updated_at, is_terminal): the last state of each job, for a batch or stream of job events. Of states of one time the one
    that stands later in a job's course."""
    course = F.array_position(F.array(*map(F.lit, C.JOB_STATES)), F.col("status"))
    last = events.where(F.col("status").isin(*C.JOB_STATES)).groupBy("job_id").agg(F.max(F.struct("updated_at", course.alias("course"), "status")).alias("last"))
    return last.select("job_id", "last.status", "last.updated_at", F.col("last.status").isin(*C.JOB_TERMINAL).alias("is_terminal"))


class _JobCourse(StatefulProcessor):
    """A job's last state by event time, and a timer that fails it when nothing has come for too long."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms
        self.place = {s: n for n, s in enumerate(C.JOB_STATES)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, at_ms bigint")

    def _told(self, key: tuple, status: str, at_ms: int, stale: bool) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "status": [status], "updated_at": [pd.Timestamp(at_ms, unit="ms")], "is_terminal": [status in C.JOB_TERMINAL], "stale": [stale]})

    def _keep(self, status: str, at_ms: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.last.update((status, at_ms))
        if status not in C.JOB_TERMINAL:
            self.handle.registerTimer(at_ms + self.timeout_ms)

    def handleInputRows(self, key: tuple, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.last.get()) if self.last.exists() else None
        new = [(int(at), s) for part in rows for at, s in zip(part["at_ms"], part["status"], strict=True)]
        # What has ended stays so, and an event from before the last one changes nothing.
        best = max(new, key=lambda x: (x[0], self.place[x[1]]))
        if before is not None and (before[0] in C.JOB_TERMINAL or (before[1], self.place[before[0]]) >= (best[0], self.place[best[1]])):
            return
        self._keep(best[1], best[0])
        yield self._told(key, best[1], best[0], False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.last.exists() or self.last.get()[0] in C.JOB_TERMINAL:
            return
        at_ms = int(expiredTimerInfo.getExpiryTimeInMs())
        self.last.update(("failed", at_ms))
        yield self._told(key, "failed", at_ms, True)


def job_course(events: DataFrame, timeout: timedelta, late: str = "0 seconds") -> DataFrame:
    """(job_id, status, updated_at, is_terminal, stale) for each change of a job's state in a stream of events (job_id, status, updated_at timestamp).

    Events count by their own time: one that comes late, but within `late`, changes a state only if its time is later than that of the state. A job
    that isn't at its end and tells nothing for `timeout` of event time fails, with stale true. Run it with the RocksDB state store; the state outlives a restart."""
    known = events.where(F.col("status").isin(*C.JOB_STATES)).select("job_id", "status", F.col("updated_at").cast("timestamp").alias("updated_at")).withWatermark("updated_at", late)
    told = known.withColumn("at_ms", F.unix_millis("updated_at")).groupBy("job_id")
    out = "job_id string, status string, updated_at timestamp_ntz, is_terminal boolean, stale boolean"
    return told.transformWithStateInPandas(_JobCourse(int(timeout.total_seconds() * 1000)), out, "Append", "EventTime")


def windowed(events: DataFrame, keys: list[str], aggregates: dict[str, Column], width: str = "1 hour", slide: str | None = None, late: str | None = None, time: str = "ts") -> DataFrame:
    """keys, window_start and aggregates by windows of event time; late is the watermark of a stream."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    if late:
        stamped = stamped.withWatermark(time, late)
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return stamped.groupBy(w.alias("w"), *keys).agg(*(c.alias(n) for n, c in aggregates.items())).select(F.col("w.start").alias("window_start"), *keys, *aggregates)
