"""End-to-end plans: ingest files, retrieve for questions, answer them."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, replace
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from .. import schemas
from ..errors import ConfigurationError, DuplicateDocumentError, EmptyDocumentError, ParseError
from ..functions import ids
from ..functions import text as T
from ..operators import answer, catalog, concepts, entities, retrieval, structure
from .tables import at_rest
from .versions import Versions, new_name

#: Tables of a saved engine, as they are when empty.
TABLES = {
    "documents": schemas.DOCUMENTS, "nodes": schemas.NODES, "concepts": schemas.CONCEPTS, "answers": schemas.ANSWERS,
    "chunks": "document_id string, page_number int, sequence int, text string, n_words bigint, chunk_id string",
}


@dataclass(frozen=True)
class Settings:
    """Limits and thresholds of retrieval and answering."""

    lexical_k: int = 40
    ranked_k: int = 32
    final_k: int = 8
    expand_depth: int = 2
    gate_least: float = 0.15
    full_scan_nodes: int = 200
    signals: tuple[str, ...] = ("fts", "heading", "phrase")
    scope: str = "pre"
    id_mode: str = "safe"
    concepts: int = 12

    def __post_init__(self):
        if min(self.lexical_k, self.ranked_k, self.final_k, self.expand_depth, self.concepts) < 1 or not 0 <= self.gate_least <= 1:
            raise ConfigurationError("limits must be positive and thresholds from 0 to 1")
        if self.scope not in ("pre", "post") or self.id_mode not in ("safe", "compat"):
            raise ConfigurationError("scope is pre or post, id_mode safe or compat")

    @staticmethod
    def from_environment(environ: Mapping[str, str] = os.environ, env_file: str | None = None, prefix: str = "RAG_") -> Settings:
        """Settings from variables named as the fields, in upper case behind the prefix; a file of lines NAME=value comes first, the environment
        overrides it. Lists are comma-joined."""
        values = {}
        if env_file and os.path.exists(env_file):
            with open(env_file, encoding="utf-8") as lines:
                pairs = [line.strip().removeprefix("export ").partition("=") for line in lines if "=" in line and not line.strip().startswith("#")]
            values = {k.strip(): v.strip().strip("\"'") for k, _, v in pairs}
        values |= environ
        found = {}
        for f in fields(Settings):
            if (text := values.get(prefix + f.name.upper())) is not None:
                try:
                    kind = type(f.default)
                    found[f.name] = tuple(x.strip() for x in text.split(",")) if kind is tuple else kind(text)
                except ValueError as e:
                    raise ConfigurationError(f"{prefix}{f.name.upper()}: {text!r} is no {kind.__name__}") from e
        return Settings(**found)


def _none(files: DataFrame, error: type[Exception], what: str) -> None:
    """Raises where there are such files, naming some."""
    if found := [r.filename for r in files.select("filename").limit(5).collect()]:
        raise error(f"files {what}: {', '.join(found)}")


@dataclass(frozen=True)
class Engine:
    """The catalog's tables and the plans over them; every method returns new tables."""

    documents: DataFrame
    nodes: DataFrame
    chunks: DataFrame
    concepts: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)
    answers: DataFrame | None = None
    #: Of the saved tables that these started from.
    version: int = 0

    # Ingest

    @staticmethod
    def structure(blocks: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
        """Nodes and chunks of layout blocks."""
        clean = blocks.withColumn("text", F.trim("text")).where("text <> ''")
        headed = at_rest(structure.detect_headings(clean), "blocks")
        nodes = at_rest(structure.build_tree(headed, settings.id_mode), "nodes")
        return nodes, at_rest(structure.chunk_pages(structure.page_texts(nodes)), "chunks")

    def ingest(self, files: DataFrame, blocks: Callable[[DataFrame], DataFrame], force: bool = False, strict: bool = False) -> Engine:
        """The engine with new files in it; those that are there already (same content and session) are skipped unless forced. Files without text become
        documents that have failed; strict raises instead, for empty files, for files that are there, and for those whose blocks hold no text."""
        new = files if force else catalog.unseen(files, self.documents)
        if strict:
            _none(files.where(F.coalesce(F.octet_length("content"), F.lit(0)) == 0), EmptyDocumentError, "without content")
            if not force:
                _none(files.join(new.select("document_id"), "document_id", "left_anti"), DuplicateDocumentError, "ready already")
        nodes, chunks = self.structure(blocks(new), self.settings)
        done = chunks.select("document_id").distinct().withColumn("ok", F.lit(True))
        if strict:
            _none(new.join(done, "document_id", "left_anti"), ParseError, "without readable text")
        rows = new.join(done, "document_id", "left").withColumns({"status": F.when(F.col("ok"), "ready").otherwise("failed"), "created_at": F.current_timestamp()})
        documents = catalog.upsert(self.documents, rows.select(self.documents.columns), ["document_id"])
        return replace(self, documents=documents, nodes=catalog.replace_children(self.nodes, nodes, "document_id"), chunks=catalog.replace_children(self.chunks, chunks, "document_id"))

    def ingest_logged(self, files: DataFrame, blocks: Callable[[DataFrame], DataFrame], log: DataFrame, force: bool = False) -> tuple[Engine, DataFrame]:
        """ingest, and log with a job for each new file: an event for each stage, the last one completed or failed."""
        new = at_rest(files if force else catalog.unseen(files, self.documents), "files")
        at = F.date_format(F.lit(datetime.now(timezone.utc)), "yyyyMMddHHmmssSSS")
        jobs = at_rest(new.select(ids.stable_id("job", F.col("document_id"), at).alias("job_id"), "document_id", "session_id"), "jobs")
        stages = C.JOB_STAGES[:-1]
        log = reduce(DataFrame.unionByName, [catalog.job_events(jobs, state, told, n) for n, (state, told) in enumerate(stages)], log)
        engine = self.ingest(new, blocks, force=True)
        states = engine.documents.select("document_id", "status")
        done = jobs.join(states.where("status = 'ready'").select("document_id"), "document_id", "left_semi")
        failed = jobs.join(states.where("status = 'failed'").select("document_id"), "document_id", "left_semi")
        log = log.unionByName(catalog.job_events(done, *C.JOB_STAGES[-1], len(stages))).unionByName(catalog.job_events(failed, "failed", "No text found", len(stages)))
        return engine, at_rest(log, "log")

    def mine_concepts(self) -> Engine:
        return replace(self, concepts=concepts.mine(self.chunks, self.settings.concepts))

    def import_concepts(self, files: DataFrame, fail_on_error: bool = True) -> tuple[Engine, DataFrame]:
        """The engine with a bundle's concepts (path, value) in place of those of the same ids, and the bundle's issues."""
        held = self.nodes.sparkSession.createDataFrame([], schemas.CONCEPTS) if self.concepts is None else self.concepts
        made, issues = concepts.import_bundle(files, held, fail_on_error=fail_on_error)
        return replace(self, concepts=made), issues

    def delete(self, gone: DataFrame) -> Engine:
        left, _ = catalog.delete_documents({"documents": self.documents, "nodes": self.nodes, "chunks": self.chunks}, gone)
        return replace(self, documents=left["documents"], nodes=left["nodes"], chunks=left["chunks"])

    # Retrieve

    def scoped_nodes(self) -> DataFrame:
        return catalog.nodes_for_session(self.nodes, self.documents)

    def retrieve(self, queries: DataFrame) -> DataFrame:
        """Ranked evidence of questions (query_id, question, session_id): lexical hits, their tree context, all small sessions' nodes
        where nothing hit, re-ranked: query_id, question, rank, score, node_id, title, text, ..."""
        s, nodes = self.settings, self.scoped_nodes()
        hits = at_rest(retrieval.lexical(nodes, queries, s.lexical_k, s.signals, s.scope), "hits")
        placed = structure.expand(nodes, hits, s.expand_depth).join(nodes.where("trim(text) <> '' or title is not null").select("node_id"), "node_id", "left_semi")
        small = nodes.groupBy("session_id").agg(F.count("*").alias("n")).where(F.col("n") <= s.full_scan_nodes).select("session_id")
        empty = queries.join(hits.select("query_id"), "query_id", "left_anti").join(small, "session_id", "left_semi")
        every = empty.join(nodes.where("trim(text) <> ''").select("node_id", "session_id"), "session_id").select("query_id", "node_id", F.lit(1).alias("place"))
        candidates = self.candidates(placed.withColumn("in_tree", F.lit(True)).unionByName(every.withColumn("in_tree", F.lit(False))), queries)
        return retrieval.rank_nodes(candidates, s.ranked_k)

    def candidates(self, placed: DataFrame, queries: DataFrame) -> DataFrame:
        return placed.join(self.nodes, "node_id").join(queries.select("query_id", "question"), "query_id")

    def retrieve_routed(self, queries: DataFrame) -> DataFrame:
        """Evidence by the question's class: facts without tree context, topics led by headings, each side of a comparison, summaries in
        reading order, others as retrieve."""
        s, nodes = self.settings, self.scoped_nodes()
        typed = queries.withColumn("query_type", T.classify(F.col("question")))
        of = lambda *kinds: typed.where(F.col("query_type").isin(*kinds))

        def hit_rows(q: DataFrame, k: int) -> DataFrame:
            h = at_rest(retrieval.lexical(nodes, q, k, s.signals, s.scope), "hits")
            return h.select("query_id", "node_id", F.col("score").alias("hit"), F.col("rank").alias("place"), F.lit(False).alias("in_tree"))

        fast = retrieval.rank_fast_fact(self.candidates(hit_rows(of("fast_fact"), 4 * s.final_k), typed), s.final_k)
        topic_hits = hit_rows(of("topic"), 4 * s.final_k)
        around = structure.expand(nodes, topic_hits.withColumnRenamed("place", "rank"), s.expand_depth).join(topic_hits.select("query_id", "node_id", "hit"), ["query_id", "node_id"], "left").fillna(0.0, ["hit"]).withColumn("in_tree", F.lit(True))
        topic = retrieval.rank_topic(self.candidates(around, typed), s.final_k)
        sides = of("comparison").select("session_id", F.col("query_id").alias("whole_id"), F.posexplode(T.comparison_parts(F.col("question"))).alias("side", "question")).withColumn("query_id", F.concat_ws("#", "whole_id", "side"))
        halves = hit_rows(sides, 2 * s.final_k).withColumn("query_id", F.substring_index("query_id", "#", 1)).groupBy("query_id", "node_id").agg(F.max("hit").alias("hit"), F.min("place").alias("place")).withColumn("in_tree", F.lit(False))
        compared = retrieval.rank_nodes(self.candidates(halves.withColumn("query_id", F.col("query_id").cast(typed.schema["query_id"].dataType)), typed), s.final_k)
        summary_hits = hit_rows(of("summary"), 4 * s.final_k).withColumnRenamed("place", "rank")
        read = self.candidates(structure.expand(nodes, summary_hits, 3, with_siblings=False), typed)
        order = F.row_number().over(structure.Window.partitionBy("query_id").orderBy("document_id", "page_start", "position", "node_id"))
        summary = read.where("trim(text) <> ''").withColumns({"rank": order, "score": F.lit(0.0)}).where(F.col("rank") <= s.final_k)
        other = self.retrieve(typed.where(~F.col("query_type").isin("fast_fact", "topic", "comparison", "summary")).drop("query_type")).where(F.col("rank") <= s.final_k)
        keep = ["query_id", "question", "rank", "score", "node_id", "document_id", "title", "text", "page_start", "page_end", "heading_path"]
        return reduce(DataFrame.unionByName, [x.select(keep) for x in (fast, topic, compared, summary, other)]).join(typed.select("query_id", "query_type"), "query_id")

    def retrieve_passages(self, queries: DataFrame) -> DataFrame:
        """Concept-first retrieval: chunks of matching concepts, nodes as chunks where none matches: query_id, passage_id, text, way."""
        if self.concepts is None:
            found = None
        else:
            found = concepts.concept_chunks(concepts.match_concepts(self.concepts, queries), self.concepts, self.chunks).select("query_id", F.col("chunk_id").alias("passage_id"), "text", F.lit("concept").alias("way"))
        rest = queries if found is None else queries.join(found.select("query_id"), "query_id", "left_anti")
        nodes = self.retrieve(rest).where(F.col("rank") <= self.settings.final_k).select("query_id", F.col("node_id").alias("passage_id"), "text", F.lit("nodes").alias("way"))
        return nodes if found is None else found.unionByName(nodes)

    # Answer

    def ask(self, queries: DataFrame, generate: Callable[[Column], Column] | None = None, recognise: entities.Recogniser | None = None) -> DataFrame:
        """query_id, question, answer, answerable, strategy, node_id, file_name, excerpt of questions (query_id, question, session_id)."""
        s = self.settings
        evidence = at_rest(self.retrieve(queries).where((F.col("rank") <= s.final_k) & (F.trim("text") != "")), "evidence")
        passed = retrieval.gate(evidence, s.gate_least).where("passed").select("query_id")
        fit = evidence.join(passed, "query_id", "left_semi")
        out = answer.extractive(queries, fit, recognise)
        if generate is not None:
            typed = queries.withColumn("query_type", T.classify(F.col("question")))
            best = retrieval.best_scores(fit)
            chosen = typed.join(best, "query_id").where(retrieval.strategy(F.col("query_type"), F.col("best"), True, s.gate_least) == "GENERATE").select("query_id", "question")
            out = answer.generated(chosen, fit, generate, out)
        cited = out.join(self.nodes.select("node_id", "document_id", F.col("text").alias("node_text")), "node_id", "left")
        return catalog.enrich_citations(cited, self.documents).select("query_id", "question", "answer", "answerable", "strategy", "node_id", "file_name", T.excerpt(F.col("node_text")).alias("excerpt"))

    def ask_and_keep(self, queries: DataFrame, **how) -> tuple[Engine, DataFrame]:
        """ask, and the engine with the answers and their citations among its tables; a question that a session asks again replaces its answer."""
        given = at_rest(self.ask(queries, **how), "answers")
        place = given.join(self.nodes.select("node_id", "document_id", "page_start", "page_end"), "node_id", "left").join(queries.select("query_id", "session_id"), "query_id")
        cited = F.struct(F.lit("S1").alias("source_id"), *(F.col(c) for c in ("node_id", "document_id", "page_start", "page_end", "excerpt")))
        none = F.array().cast("array<struct<source_id:string,node_id:string,document_id:string,page_start:int,page_end:int,excerpt:string>>")
        rows = place.select(
            ids.stable_id("answer", F.coalesce("session_id", F.lit("")), F.col("question")).alias("answer_id"), "session_id", "question", "answer", "answerable", "strategy",
            F.when(F.col("node_id").isNotNull(), F.array(cited)).otherwise(none).alias("citations"),
        ).dropDuplicates(["answer_id"])
        held = self.nodes.sparkSession.createDataFrame([], schemas.ANSWERS) if self.answers is None else self.answers
        return replace(self, answers=at_rest(catalog.keep_answers(held, rows), "answers")), given

    # Tables at rest

    @staticmethod
    def open(spark: SparkSession, path: str, settings: Settings = Settings()) -> Engine:
        """The last version that was saved below path; empty tables where there is none."""
        version, state = Versions(spark, path).latest()
        held = {} if state is None else state["tables"]
        read = {n: spark.read.schema(held[n]["schema"]).parquet(f"{path}/{n}/{held[n]['folder']}") if n in held else spark.createDataFrame([], schema) for n, schema in TABLES.items()}
        return Engine(read["documents"], read["nodes"], read["chunks"], read["concepts"] if "concepts" in held else None, settings, read["answers"], version)

    def tables(self) -> dict[str, DataFrame]:
        held = {"documents": self.documents, "nodes": self.nodes, "chunks": self.chunks, "concepts": self.concepts, "answers": self.answers}
        return {n: df for n, df in held.items() if df is not None}

    def save(self, path: str) -> Engine:
        """The engine on Parquet copies of its tables, all of one new version: plans after it start from files, not from how the tables came to be. Where
        writing fails, the version before stays the last one; where another engine saved since this one was opened, ConflictError."""
        spark, versions = self.nodes.sparkSession, Versions(self.nodes.sparkSession, path)
        folder, told = new_name("v"), {}
        for name, df in self.tables().items():
            df.write.parquet(f"{path}/{name}/{folder}")
            told[name] = {"folder": folder, "schema": df._jdf.schema().toDDL()}
        versions.commit({"tables": told}, self.version)
        versions.forget(tuple(TABLES), lambda s: [f"{n}/{t['folder']}" for n, t in s["tables"].items()])
        return Engine.open(spark, path, self.settings)

    def status(self) -> DataFrame:
        return catalog.status_counts(self.documents)
