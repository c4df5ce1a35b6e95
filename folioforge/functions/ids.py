"""Content-derived identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 16 hex digits of the hash of the parts joined by the unit separator; the prefix isn't hashed."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.concat_ws("\x1f", *(p.cast("string") for p in parts)), 256), 1, 16))


def node_id(document_id: Column, depth: Column, position: Column, heading_path: Column, parent_id: Column | None = None) -> Column:
    """node_ and 32 hex digits of the hash of a compact JSON list; with parent_id, nodes that differ only in their parent get different ids."""
    quoted = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    pieces = [F.lit('["node",'), quoted(document_id), F.lit(","), depth.cast("string"), F.lit(","), position.cast("string"), F.lit(","), F.to_json(heading_path)]
    if parent_id is not None:
        pieces += [F.lit(","), quoted(F.coalesce(parent_id, F.lit("")))]
    return F.concat(F.lit("node_"), F.substring(F.sha2(F.concat(*pieces, F.lit("]")), 256), 1, 32))


def concept_id(slug: Column, chunk_ids: Column) -> Column:
    """From the slug and the chunk ids as a Python list's text."""
    listed = F.concat(F.lit("["), F.array_join(F.transform(chunk_ids, lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", "), F.lit("]"))
    return stable_id("concept", slug, listed)
