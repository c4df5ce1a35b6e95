"""Rank fusion, retrieval with three signals, re-ranking and gates, for many questions at once."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InsufficientEvidenceError
from ..functions import text as T
from ..functions.fuzzy import token_set_ratio_column
from . import index
from .entities import Recogniser

RRF = 60


def fuse(*ranked: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of (query_id, node_id, rank) lists: the sum of 1 / (60 + rank)."""
    whole = reduce(DataFrame.unionByName, [r.select("query_id", "node_id", "rank") for r in ranked])
    return index.top_k(whole.groupBy("query_id", "node_id").agg(F.sum(1 / (F.lit(RRF) + F.col("rank"))).alias("score")), k)


def lexical(nodes: DataFrame, queries: DataFrame, k: int = 40, signals: tuple[str, ...] = ("fts", "heading", "phrase"), scope: str = "pre") -> DataFrame:
    """Fused hits with the breakdown of signals: query_id, node_id, score, rank, fts, heading, phrase, keyword_coverage, structural.

    nodes and queries may have session_id; then a question sees its session's nodes only. scope 'pre': each signal's k best are
    those of the session, so nothing that other sessions hold crowds a hit out; 'post': other sessions' hits leave the fused list only.
    """
    session = index.shared_session(nodes, queries)
    after = bool(session) and scope == "post"
    searched = nodes.drop("session_id") if after else nodes
    lists = {}
    if "fts" in signals:
        lists["fts"] = index.bm25(searched, queries, 2 * k)
    if "heading" in signals:
        found = index.heading_search(searched, queries, k)
        lists["heading"] = found.withColumn("score", 1 - 0.05 * (F.col("rank") - 1))
    if "phrase" in signals:
        lists["phrase"] = index.phrase_search(searched, queries, k)
    fused = fuse(*lists.values(), k=k)
    for name, hits in lists.items():
        fused = fused.join(hits.select("query_id", "node_id", F.col("score").alias(name)), ["query_id", "node_id"], "left").fillna(0.0, [name])
    text = nodes.select("node_id", "title", "text", *(c for c in ("node_type", "heading_path") if c in nodes.columns), *([F.col("session_id").alias("_held_in")] if after else []))
    whole = fused.join(text, "node_id").join(queries.select("query_id", "question", *([F.col("session_id").alias("_asked_in")] if after else [])), "query_id")
    if after:
        whole = whole.where("_held_in = _asked_in").drop("_held_in", "_asked_in")
    return whole.withColumns({"keyword_coverage": token_set_ratio_column(F.col("question"), F.col("text")), "structural": structural(whole)}).drop("title", "text", "question", "node_type", "heading_path")


def structural(df: DataFrame) -> Column:
    """1 for headings and titled nodes, 0.6 below a heading, else 0.2."""
    titled = F.coalesce(F.col("title"), F.lit("")) != ""
    if "node_type" in df.columns:
        titled = titled | F.col("node_type").isin("chapter", "section", "subsection")
    score = F.when(titled, 1.0)
    return (score.when(F.size("heading_path") > 0, 0.6) if "heading_path" in df.columns else score).otherwise(0.2)


def heading_match(question: Column, title: Column) -> Column:
    q, t = F.lower(question), F.lower(title)
    inside = q.contains(t) | t.contains(q)
    return F.when(F.coalesce(title, F.lit("")) == "", 0.0).when(inside, 1.0).otherwise(T.jaccard(T.token_set(q), T.token_set(t)))


def page_score(page: Column, last: int = 500) -> Column:
    return F.when(page <= 0, 0.5).otherwise(F.greatest(F.lit(0.0), 1 - F.log(page + 1) / math.log(last + 2)))


def density_score(text: Column) -> Column:
    n = T.word_count(text)
    return F.when(n < 10, 0.0).when(n < 30, 0.5).otherwise(1.0)


def person_score(question: Column, text: Column, has_person: Column | None = None) -> Column:
    """1 where the question asks for a name and a short text holds a person's: as has_person tells, else two capitalised words in a row (an
    approximation by pattern)."""
    wants = F.lower(question).rlike(T.bounded("name"))
    held = text.rlike(r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b") if has_person is None else F.coalesce(has_person, F.lit(False))
    return F.when(wants & (F.length(text) <= 500) & held, 1.0).otherwise(0.0)


def with_persons(candidates: DataFrame, recognise: Recogniser) -> DataFrame:
    """candidates with has_person, for the rankings: whether a recogniser finds a full name in the text."""
    held = recognise(candidates.select("node_id", "text").distinct()).where(F.col("kind") == "person").where(F.size(F.split(F.trim("name"), r"\s+")) > 1)
    return candidates.join(held.select("node_id").distinct().withColumn("has_person", F.lit(True)), "node_id", "left")


def signals(df: DataFrame) -> DataFrame:
    """Adds overlap, heading, page, density and entity to rows with question, title, text and page_start, and has_person where it is known."""
    q, t = F.col("question"), F.coalesce(F.col("text"), F.lit(""))
    return df.withColumns({"overlap": T.jaccard(T.token_set(q), T.token_set(t)), "heading": heading_match(q, F.col("title")), "page": page_score(F.col("page_start")), "density": density_score(t), "entity": person_score(q, t, F.col("has_person") if "has_person" in df.columns else None)})


def rank_nodes(candidates: DataFrame, k: int | None = None) -> DataFrame:
    """Weighted signals of candidates (query_id, question, node_id, title, text, page_start, in_tree), four decimals, best first."""
    source = F.when(F.col("in_tree"), 1.0).otherwise(0.0)
    score = 0.5 * F.col("overlap") + 0.2 * F.col("heading") + 0.15 * source + 0.1 * F.col("page") + 0.05 * F.col("density") + 0.3 * F.col("entity")
    return _best(signals(candidates).withColumn("score", F.round(score, 4)), k)


def rank_fast_fact(candidates: DataFrame, k: int | None = None) -> DataFrame:
    """As rank_nodes, led by the retrieval score in `hit`."""
    score = 0.55 * F.col("hit") + 0.3 * F.col("overlap") + 0.1 * F.col("heading") + 0.05 * F.col("density")
    return _best(signals(candidates).withColumn("score", F.round(score, 4)), k)


def rank_topic(candidates: DataFrame, k: int | None = None) -> DataFrame:
    """As rank_nodes, led by the heading."""
    score = 0.45 * F.col("heading") + 0.3 * F.col("overlap") + 0.15 * F.col("hit") + 0.1 * F.col("page")
    return _best(signals(candidates).withColumn("score", F.round(score, 4)), k)


def _best(scored: DataFrame, k: int | None) -> DataFrame:
    return index.top_k(scored, k if k is not None else 2**31 - 1, 4)


def rerank(candidates: DataFrame, k: int | None = None) -> DataFrame:
    """Coverage of the question's tokens plus their density among the text's, four decimals."""
    q, t = F.array_distinct(T.tokens(F.col("question"))), F.array_distinct(T.tokens(F.coalesce(F.col("text"), F.lit(""))))
    both = F.size(F.array_intersect(q, t))
    score = F.when((F.size(q) == 0) | (F.size(t) == 0), 0.0).otherwise(both / F.size(q) + both / F.size(t))
    return _best(candidates.withColumn("score", F.round(score, 4)), k)


def gate_signals(nodes: DataFrame, target: int = 3) -> DataFrame:
    """(query_id, n, count_signal, density_signal) of the nodes (query_id, text) found for each question."""
    words = F.length("text") - F.length(F.replace(F.col("text"), F.lit(" "))) + 1
    return nodes.groupBy("query_id").agg(F.count("*").alias("n"), F.avg(words).alias("avg_words")).select(
        "query_id", "n", F.least(F.col("n") / target, F.lit(1.0)).alias("count_signal"), F.least(F.col("avg_words") / 50, F.lit(1.0)).alias("density_signal")
    )


def gate(nodes: DataFrame, least: float = 0.15) -> DataFrame:
    """Whether the evidence (query_id, question, rank, text) suffices: query_id, score, passed, reason."""
    if not 0 <= least <= 1:
        raise ValueError("least must be from 0 to 1")
    text = nodes.groupBy("query_id").agg(F.first("question").alias("question"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]), " ").alias("whole"))
    likeness = text.select("query_id", token_set_ratio_column(F.col("question"), F.col("whole")).alias("overlap_signal"))
    score = 0.6 * F.col("overlap_signal") + 0.25 * F.col("count_signal") + 0.15 * F.col("density_signal")
    out = likeness.join(gate_signals(nodes), "query_id").withColumn("score", score).withColumn("passed", F.col("score") >= least)
    return out.select("query_id", "score", "passed", F.when(F.col("passed"), "sufficient evidence").otherwise("insufficient evidence").alias("reason"))


def check_or_raise(nodes: DataFrame, least: float = 0.15) -> DataFrame:
    """gate, for callers that can't go on without evidence: raises where a question doesn't pass."""
    judged = gate(nodes, least)
    failed = [r.query_id for r in judged.where("not passed").select("query_id").limit(5).collect()]
    if failed:
        raise InsufficientEvidenceError(f"not enough evidence for questions {failed}")
    return judged


# What a node's score may be called; the best of them counts.
SCORE_COLUMNS = ("score", "fused_score", "fast_fact_score", "topic_score", "keyword_coverage", "structural_score", "confidence")


def best_scores(nodes: DataFrame) -> DataFrame:
    """(query_id, best): the largest of a question's scores, whichever of SCORE_COLUMNS hold them; null scores count as 0."""
    held = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in SCORE_COLUMNS if c in nodes.columns]
    each = F.greatest(*held) if len(held) > 1 else held[0] if held else F.lit(0.0)
    return nodes.groupBy("query_id").agg(F.max(each).alias("best"))


def strategy(query_type: Column, best: Column, has_llm: bool, least: float = 0.15, extract_above: float = 0.65) -> Column:
    """EXTRACTIVE, GENERATE or INSUFFICIENT for a question's class and best score."""
    if not has_llm:
        return F.lit("EXTRACTIVE")
    return (
        F.when(best < least, "INSUFFICIENT")
        .when(query_type.isin("comparison", "summary"), "GENERATE")
        .when(query_type.isin("fast_fact", "topic") & (best > extract_above), "EXTRACTIVE")
        .otherwise("GENERATE")
    )
