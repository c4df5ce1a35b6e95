"""Readers: plain and Markdown files, bundles, PDFs by a pluggable backend, index snapshots; all through Spark's sources."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, structure

PLAIN, PDF = ("txt", "md"), ("pdf",)


def files(spark: SparkSession, path: str, session_id: str = "default") -> DataFrame:
    """(path, filename, suffix, content, session_id, sha256, document_id) of the supported files below a folder."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    named = raw.withColumns({"filename": F.regexp_extract("path", r"([^/]+)$", 1), "suffix": F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)), "session_id": F.lit(session_id)})
    return catalog.register(named.where(F.col("suffix").isin(*PLAIN, *PDF)))


def plain_texts(found: DataFrame) -> DataFrame:
    """(document_id, text) of plain and Markdown files; bytes that aren't UTF-8 are replaced."""
    return found.where(F.col("suffix").isin(*PLAIN)).select("document_id", F.make_valid_utf8(F.col("content").cast("string")).alias("text"))


def pdf_blocks(found: DataFrame, extract: Callable[[bytes], list[dict]]) -> DataFrame:
    """Layout blocks of PDF files by a backend: bytes to dicts of page_number, text, font_size, font_name, is_bold, indent, line_spacing."""
    schema = "document_id string, block_pos int, page_number int, text string, font_size double, font_name string, is_bold boolean, indent double, line_spacing double"
    fields = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("document_id", pa.string()), ("block_pos", pa.int32()), ("page_number", pa.int32()), ("text", pa.string()), ("font_size", pa.float64()), ("font_name", pa.string()), ("is_bold", pa.bool_()), ("indent", pa.float64()), ("line_spacing", pa.float64())])
        for batch in batches:
            for doc, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = [{f: b.get(f) for f in fields} | {"document_id": doc, "block_pos": i} for i, b in enumerate(extract(content))]
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return found.where(F.col("suffix").isin(*PDF)).select("document_id", "content").mapInArrow(run, schema)


def pdf_pages(found: DataFrame, text_layer: Callable[[bytes], list[str]], recognise: Callable[[bytes], str] | None = None) -> DataFrame:
    """(document_id, page_number, text, section_path) of PDF files: a row for each page of the text layer that isn't blank, or, with a recogniser
    and less than 20 characters a page on average, one row of what it reads. A backend that fails gives no rows. section_path is the file's stem."""

    def rows(content: bytes) -> list[tuple[int, str]]:
        try:
            pages = text_layer(content)
        except Exception:  # whatever a backend raises on a damaged file
            pages = []
        enough = pages and sum(len(p.strip()) for p in pages) / len(pages) >= structure.ENOUGH_CHARS
        if not enough and recognise is not None:
            try:
                read = recognise(content)
            except Exception:
                read = ""
            if read.strip():
                return [(1, read)]
        return [(i, p) for i, p in enumerate(pages, 1) if p.strip()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, stem, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = rows(content)
                yield pa.record_batch([pa.array([doc] * len(got), pa.string()), pa.array([n for n, _ in got], pa.int32()), pa.array([t for _, t in got], pa.string()), pa.array([[stem]] * len(got), pa.list_(pa.string()))], ["document_id", "page_number", "text", "section_path"])

    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    return found.where(F.col("suffix").isin(*PDF)).select("document_id", stem.alias("stem"), "content").mapInArrow(run, "document_id string, page_number int, text string, section_path array<string>")


def with_fallback(first: DataFrame, documents: DataFrame, fallback: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """first's blocks, and the fallback reader's for documents without any or with too little text."""
    poor = structure.needs_fallback(first).where("not sufficient").select("document_id")
    missing = documents.join(first.select("document_id"), "document_id", "left_anti").select("document_id").unionByName(poor)
    again = fallback(documents.join(missing, "document_id", "left_semi"))
    return first.join(missing, "document_id", "left_anti").unionByName(again, allowMissingColumns=True)


def bundle(spark: SparkSession, path: str) -> DataFrame:
    """(path relative to the folder, value) of the Markdown files of a concept bundle."""
    raw = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    root = path.rstrip("/").split("/")[-1]
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), f"/{root}/(.+)$", 1).alias("path"), "value")


def save_index(tables: dict[str, DataFrame], path: str) -> None:
    """Index tables (postings, doc_stats, ...) as Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, names: tuple[str, ...] = ("postings", "doc_stats")) -> dict[str, DataFrame]:
    """Index tables that were saved; one that is missing or unreadable is told in a warning and left out."""
    out = {}
    for n in names:
        try:
            out[n] = spark.read.parquet(f"{path}/{n}")
        except AnalysisException as e:
            warnings.warn(f"index table {n} can't be read: {e}", stacklevel=2)
    return out
