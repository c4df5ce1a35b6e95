"""Catalog tables as immutable DataFrames: upserts, deletes, look-ups and job states are anti-joins, unions and windows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..errors import ConflictError, DocumentNotFoundError, JobNotFoundError, SessionNotFoundError
from ..functions import ids


def upsert(existing: DataFrame, new: DataFrame, key: list[str], version: str | None = None, keep: tuple[str, ...] = ("created_at",)) -> DataFrame:
    """existing with new's rows in place of those of the same key; of several new ones the last by version. Without a version new must
    hold a key once: rows of a table have no order, so there is no last one (checked, ConflictError). Columns in keep stay as they were."""
    if version:
        last = Window.partitionBy(*key).orderBy(F.desc(version))
        new = new.withColumn("_no", F.row_number().over(last)).where("_no = 1").drop("_no")
    elif new.groupBy(*key).count().where("count > 1").limit(1).count():
        raise ConflictError(f"several new rows of one {', '.join(key)}; name the column of their version")
    held = [c for c in keep if c in existing.columns and c not in key]
    if held:
        old = existing.select(*key, *(F.col(c).alias(f"_old_{c}") for c in held))
        new = new.join(old, key, "left")
        new = new.withColumns({c: F.coalesce(f"_old_{c}", c) if c in new.columns else F.col(f"_old_{c}") for c in held}).drop(*(f"_old_{c}" for c in held))
    return existing.join(new.select(*key), key, "left_anti").select(existing.columns).unionByName(new.select(existing.columns))


def latest(log: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in an append-only log."""
    w = Window.partitionBy(*key).orderBy(*order)
    return log.withColumn("_no", F.row_number().over(w)).where("_no = 1").drop("_no")


def upsert_by_hash(existing: DataFrame, new: DataFrame) -> DataFrame:
    """new (filename, path, sha256, session_id, status) with document_id: the one that (sha256, session_id) has, else a fresh one."""
    known = existing.groupBy("sha256", "session_id").agg(F.min("document_id").alias("known_id"))
    fresh = F.concat(F.lit("doc_"), F.substring("sha256", 1, 16))
    return new.join(known, ["sha256", "session_id"], "left").withColumn("document_id", F.coalesce("known_id", fresh)).drop("known_id")


def register(files: DataFrame) -> DataFrame:
    """files (session_id, filename, content) with sha256 and document_id."""
    hashed = files.withColumn("sha256", ids.file_hash(F.col("content")))
    return hashed.withColumn("document_id", ids.stable_id("doc", F.col("session_id"), F.col("filename"), F.col("sha256")))


def unseen(files: DataFrame, documents: DataFrame) -> DataFrame:
    """The first of files of each (session_id, sha256) that documents doesn't hold ready."""
    ready = documents.where("status = 'ready'").select("session_id", "sha256")
    return latest(files.join(ready, ["session_id", "sha256"], "left_anti"), ["session_id", "sha256"], [F.col("document_id")])


def delete_documents(tables: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without rows of the documents in gone (document_id); and the ids of the deleted chunks. Jobs stay."""
    doomed = gone.select("document_id").distinct()
    chunk_ids = tables["chunks"].join(doomed, "document_id", "left_semi").select("chunk_id")
    return {n: t if n == "jobs" else t.join(doomed, "document_id", "left_anti") for n, t in tables.items()}, chunk_ids


def delete_sessions(sessions: DataFrame, tables: dict[str, DataFrame], gone: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Sessions without those in gone (session_id), and tables without their documents' rows."""
    docs = tables["documents"].join(gone.select("session_id").distinct(), "session_id", "left_semi")
    return sessions.join(gone.select("session_id").distinct(), "session_id", "left_anti"), delete_documents(tables, docs)[0]


def replace_children(existing: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """existing with all rows of the parents in new replaced by new's."""
    return existing.join(new.select(parent).distinct(), parent, "left_anti").select(existing.columns).unionByName(new.select(existing.columns))


def childless(parents: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """parents of which child has no row."""
    return parents.join(child.select(key), key, "left_anti")


def fail_stale(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """documents, those left in processing without any chunk marked failed."""
    stale = childless(documents.where("status = 'processing'"), chunks, "document_id").select("document_id", F.lit(True).alias("stale"))
    return documents.join(stale, "document_id", "left").withColumn("status", F.when(F.col("stale"), "failed").otherwise(F.col("status"))).drop("stale")


def ordered_lookup(wanted: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """wanted (list_id, ids ARRAY) exploded to its rows, with place; ids without a row fall out."""
    return wanted.select("list_id", F.posexplode("ids").alias("place", key)).join(rows, key)


def nodes_for_session(nodes: DataFrame, documents: DataFrame, session: str | None = None) -> DataFrame:
    """nodes with the session_id of their document, of one session or all."""
    docs = documents.select("document_id", "session_id")
    return nodes.join(docs.where(F.col("session_id") == session) if session is not None else docs, "document_id")


# Scans


def documents_of(documents: DataFrame, session: str | None = None, sha256: str | None = None) -> DataFrame:
    """Documents, newest first; of one session, and with one content, where given."""
    rows = documents if session is None else documents.where(F.col("session_id") == session)
    rows = rows if sha256 is None else rows.where(F.col("sha256") == sha256)
    return rows.orderBy(F.desc("created_at"), "document_id")


def nodes_in_order(nodes: DataFrame, documents: list[str] | None = None) -> DataFrame:
    """Nodes by document, depth and position."""
    rows = nodes if documents is None else nodes.where(F.col("document_id").isin(documents))
    return rows.orderBy("document_id", "depth", "position", "node_id")


def chunks_of(chunks: DataFrame, document: str | None = None, session: str | None = None) -> DataFrame:
    """Chunks in reading order, of a document or session where given."""
    rows = chunks if document is None else chunks.where(F.col("document_id") == document)
    rows = rows if session is None else rows.where(F.col("session_id") == session)
    return rows.orderBy("document_id", "sequence")


def concepts_of(concepts: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Concepts by title; of these ids where given."""
    rows = concepts if wanted is None else concepts.where(F.col("concept_id").isin(wanted))
    return rows.orderBy("title", "concept_id")


def one(table: DataFrame, key: str, value: str, error: type[Exception]) -> DataFrame:
    """The row of a key, for the edge of the engine: raises where there is none."""
    row = table.where(F.col(key) == value)
    if not row.limit(1).count():
        raise error(f"no row with {key} {value!r}")
    return row


def document(documents: DataFrame, document_id: str) -> DataFrame:
    return one(documents, "document_id", document_id, DocumentNotFoundError)


def job(log: DataFrame, job_id: str) -> DataFrame:
    """The state of a job: its newest event."""
    return latest(one(log, "job_id", job_id, JobNotFoundError), ["job_id"], [F.desc("updated_at"), F.desc("stage")])


def document_nodes(nodes: DataFrame) -> DataFrame:
    """(document_id, node_ids): each document's nodes in order."""
    place = F.struct("depth", "position", "node_id")
    gathered = nodes.groupBy("document_id").agg(F.array_sort(F.collect_list(place)).alias("n"))
    return gathered.select("document_id", F.transform("n", lambda x: x["node_id"]).alias("node_ids"))


# Sessions


def ensure_sessions(sessions: DataFrame, wanted: DataFrame) -> DataFrame:
    """sessions with those in wanted (session_id, title) made, or renamed where they are there; created_at stays."""
    new = wanted.select("session_id", "title").withColumn("created_at", F.current_timestamp())
    return upsert(sessions, new, ["session_id"])


def new_session(sessions: DataFrame, title: str) -> tuple[DataFrame, str]:
    """sessions with a new one of this title, and its id."""
    if not title.strip():
        raise ValueError("a session needs a title")
    made = f"session_{uuid.uuid4().hex[:16]}"
    row = sessions.sparkSession.createDataFrame([(made, title.strip())], "session_id string, title string")
    return ensure_sessions(sessions, row), made


def rename_session(sessions: DataFrame, session_id: str, title: str) -> DataFrame:
    """sessions with another title for one that is there."""
    one(sessions, "session_id", session_id, SessionNotFoundError)
    return sessions.withColumn("title", F.when(F.col("session_id") == session_id, F.lit(title)).otherwise(F.col("title")))


# Jobs: an append-only log of events, whose newest is a job's state


def job_events(subjects: DataFrame, status: str, message: str, stage: int) -> DataFrame:
    """Events of jobs (job_id, document_id, session_id) that enter a state; messages hold 500 characters."""
    if status not in C.JOB_STATES:
        raise ValueError(f"unknown state {status!r}")
    now = F.current_timestamp()
    return subjects.select("job_id", "document_id", "session_id", F.lit(status).alias("status"), F.substring(F.lit(message), 1, 500).alias("progress_message"), now.alias("created_at"), now.alias("updated_at"), F.lit(stage).alias("stage"))


def transitions(log: DataFrame) -> DataFrame:
    """log with previous (the state before) and is_terminal; messages cut to 500 characters."""
    w = Window.partitionBy("job_id").orderBy("updated_at", "stage")
    return log.withColumns({"previous": F.lag("status").over(w), "is_terminal": F.col("status").isin(*C.JOB_TERMINAL), "progress_message": F.substring("progress_message", 1, 500)})


def latest_jobs(log: DataFrame) -> DataFrame:
    """Each document's newest job."""
    return latest(log, ["document_id"], [F.desc("created_at"), F.desc("job_id")])


def resolve_slugs(concepts: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """concepts with slugs made unique: later ones of a slug (by arrival, then id) get the last eight characters of their id, and so do
    those whose slug is taken (slug); one whose suffixed slug is there too gets its whole id."""
    own = Window.partitionBy("slug").orderBy("arrival", "concept_id")
    rows = concepts.withColumns({"_no": F.row_number().over(own), "_first": F.col("slug")})
    held = rows.where("_no = 1").select("slug").unionByName(taken.select("slug") if taken is not None else rows.select("slug").limit(0)).distinct().withColumn("_held", F.lit(True))
    if taken is not None:
        rows = rows.join(taken.select("slug").distinct().withColumn("_taken", F.lit(True)), "slug", "left")
    late = (F.col("_no") > 1) | (F.coalesce("_taken", F.lit(False)) if taken is not None else F.lit(False))
    rows = rows.withColumn("slug", F.when(late, F.concat_ws("-", "_first", F.substring("concept_id", -8, 8))).otherwise(F.col("_first"))).withColumn("_late", late)
    rows = rows.join(held, "slug", "left").withColumn("slug", F.when(F.col("_late") & F.col("_held"), F.concat_ws("-", "_first", "concept_id")).otherwise(F.col("slug")))
    return rows.select(concepts.columns)


def status_counts(documents: DataFrame) -> DataFrame:
    """(session_id, status, n)."""
    return documents.groupBy("session_id", "status").agg(F.count("*").alias("n"))


def enrich_citations(citations: DataFrame, documents: DataFrame) -> DataFrame:
    """citations with file_name; the document's id where there is no document."""
    names = documents.select("document_id", "filename")
    return citations.join(names, "document_id", "left").withColumn("file_name", F.coalesce("filename", "document_id")).drop("filename")


# Answers


def keep_answers(existing: DataFrame, given: DataFrame) -> DataFrame:
    """existing answers with given ones (schema ANSWERS) in place of those of the same id; an answer and its citations are one row, so they are replaced together."""
    return upsert(existing, given, ["answer_id"])


def answer_citations(answers: DataFrame) -> DataFrame:
    """(answer_id, position, source_id, node_id, document_id, page_start, page_end, excerpt): a row for each citation, in the answer's order."""
    return answers.select("answer_id", F.posexplode("citations").alias("position", "c")).select("answer_id", "position", "c.*")
