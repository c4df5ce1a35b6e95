"""Explicit schemas of the catalog's tables, and queries for rows that violate a constraint (none should)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import constants as C

SESSIONS = "session_id string, title string, created_at timestamp"
DOCUMENTS = "document_id string, filename string, sha256 string, path string, status string, session_id string, created_at timestamp"
NODES = "node_id string, document_id string, parent_id string, node_type string, title string, text string, page_start int, page_end int, depth int, position int, heading_path array<string>"
CHUNKS = "chunk_id string, document_id string, page_number int, sequence int, text string, section_path array<string>, chunk_type string, metadata map<string,string>, session_id string"
CONCEPTS = "concept_id string, title string, slug string, text string, source_chunk_ids array<string>, verification_status string, aliases array<string>, tags array<string>, related array<string>, depends_on array<string>, path string"
JOBS = "job_id string, document_id string, session_id string, status string, progress_message string, created_at timestamp, updated_at timestamp"
ANSWERS = "answer_id string, session_id string, question string, answer string, answerable boolean, strategy string, citations array<struct<source_id:string,node_id:string,document_id:string,page_start:int,page_end:int,excerpt:string>>"
BLOCKS = "document_id string, block_pos int, page_number int, text string, font_size double, font_name string, is_bold boolean, indent double, line_spacing double, bbox array<double>"

#: What each table's rows must satisfy.
CHECKS = {
    "nodes": {"page_start": "page_start >= 1", "page_order": "page_end >= page_start", "type": f"node_type in {C.NODE_TYPES}", "id": "node_id <> ''"},
    "documents": {"status": f"status in {C.DOCUMENT_STATES}", "filename": "trim(filename) <> ''"},
    "jobs": {"status": f"status in {C.JOB_STATES}", "message": "length(progress_message) <= 500"},
    "sessions": {"title": "trim(title) <> ''"},
    "queries": {"question": "trim(question) <> ''"},
}


def violations(df: DataFrame, table: str) -> DataFrame:
    """(rule, and df's columns) for every rule that a row breaks; a null breaks a rule."""
    checks = CHECKS[table]
    broken = F.array(*(F.when(F.coalesce(F.expr(ok), F.lit(False)), None).otherwise(F.lit(name)) for name, ok in checks.items()))
    return df.withColumn("rule", F.explode(F.filter(broken, lambda r: r.isNotNull())))


def is_terminal(status, kind: str = "job"):
    return status.isin(*(C.JOB_TERMINAL if kind == "job" else C.DOCUMENT_TERMINAL))
