"""Extractive answers with citations, and checks of answers against what they cite; rows are questions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import phones
from ..functions import text as T
from ..functions.fuzzy import token_set_ratio_column
from . import entities

SENTENCE_LEAST, SENTENCE_WORDS = 0.4, 5


def sentence_rows(evidence: DataFrame) -> DataFrame:
    """(query_id, question, rank, node_id, title, at, sentence) of evidence (query_id, question, rank, node_id, title, text)."""
    return evidence.select("query_id", "question", "rank", "node_id", "title", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("at", "sentence"))


def best_sentences(evidence: DataFrame, least: float = SENTENCE_LEAST) -> DataFrame:
    """(query_id, node_id, answer, score): the sentence most like the question; first sentences and fitting titles gain."""
    rows = sentence_rows(evidence).where(T.word_count(F.col("sentence")) >= SENTENCE_WORDS)
    q = F.col("question")
    score = token_set_ratio_column(q, F.col("sentence")) + F.when(F.col("at") == 0, 0.2).otherwise(0.0) + 0.15 * token_set_ratio_column(q, F.coalesce("title", F.lit("")))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "at")
    scored = rows.withColumn("score", F.round(score, 6)).where(F.col("score") >= least)
    return scored.withColumn("no", F.row_number().over(w)).where("no = 1").select("query_id", "node_id", F.col("sentence").alias("answer"), "score")


#: Kinds of facts: the question's words, and the expression that finds the fact in a text.
FACTS: list[tuple[str, str, Callable[[Column], Column]]] = [
    ("institution", r"college|collage|university|institute|school|academy|campus", T.institution),
    ("cgpa", r"c?gpa|percentage", T.cgpa),
    ("name", r"name", T.person_name),
    ("degree", r"degree|course|qualification", T.degree),
    ("email", r"e-?mail", T.email),
    ("phone", r"phone|contact|mobile|number", phones.phone),
]


#: Kinds of facts that a recogniser finds, by its names for them.
RECOGNISED = {"institution": "institution", "name": "person"}


def facts(evidence: DataFrame, recognise: entities.Recogniser | None = None) -> DataFrame:
    """(query_id, node_id, kind, answer): the first node's fact of the first kind that the question asks for and any text has. Names come from the recogniser
    where there is one, else from patterns."""
    q, t = F.lower("question"), F.coalesce(F.col("text"), F.lit(""))
    find_by = {kind: find(t) for kind, _, find in FACTS}
    if recognise is not None:
        named = entities.first_names(recognise(evidence.select("node_id", "text").distinct()))
        evidence = evidence.join(named, "node_id", "left")
        find_by |= {kind: F.col("names")[name] for kind, name in RECOGNISED.items()}
    found = F.array(*(F.struct(F.lit(k).alias("order"), F.lit(kind).alias("kind"), F.when(q.rlike(T.bounded(words)), find_by[kind]).alias("answer")) for k, (kind, words, _) in enumerate(FACTS)))
    rows = evidence.where(T.is_fast_fact(F.col("question")) | q.rlike(T.bounded("|".join(w for _, w, _ in FACTS)))).select("query_id", "rank", "node_id", F.explode(found).alias("f"))
    w = Window.partitionBy("query_id").orderBy("f.order", "rank")
    return rows.where("f.answer is not null").withColumn("no", F.row_number().over(w)).where("no = 1").select("query_id", "node_id", "f.kind", "f.answer")


def definitions(evidence: DataFrame) -> DataFrame:
    """(query_id, node_id, answer) for definition questions: the best sentence above one half (70 words), the best node in detail
    (170 words) where detail is asked for, else the first node's 60 words."""
    asked = evidence.where(T.is_definition(F.col("question"))).withColumn("topic", T.core_topic(F.col("question")))
    detailed = F.lower("question").rlike(r"everything|all about|detail|explain|describe")
    by_node = asked.withColumn("likeness", token_set_ratio_column(F.col("topic"), F.coalesce("text", F.lit(""))))
    node = Window.partitionBy("query_id").orderBy(F.desc("likeness"), "rank")
    best = by_node.where(detailed).withColumn("no", F.row_number().over(node)).where("no = 1").select("query_id", "node_id", F.lit(0).alias("kind"), T.truncate_words(F.col("text"), 170).alias("answer"))
    rows = asked.where(~detailed).select("query_id", "topic", "rank", "node_id", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("at", "s")).withColumn("likeness", token_set_ratio_column(F.col("topic"), F.col("s")))
    line = Window.partitionBy("query_id").orderBy(F.desc("likeness"), "rank", "at")
    sentence = rows.where("likeness > 0.5").withColumn("no", F.row_number().over(line)).where("no = 1").select("query_id", "node_id", F.lit(1).alias("kind"), T.truncate_words(F.col("s"), 70).alias("answer"))
    order = Window.partitionBy("query_id").orderBy("rank")
    first = asked.withColumn("no", F.row_number().over(order)).where("no = 1").select("query_id", "node_id", F.lit(2).alias("kind"), T.truncate_words(F.col("text"), 60).alias("answer"))
    every = best.unionByName(sentence).unionByName(first)
    return every.withColumn("no", F.row_number().over(Window.partitionBy("query_id").orderBy("kind"))).where("no = 1 and trim(answer) <> ''").select("query_id", "node_id", "answer")


def overlap_sentences(evidence: DataFrame) -> DataFrame:
    """(query_id, node_id, answer, overlap): the sentence with most of the question's terms; two of them if it has several."""
    stop = F.array(*map(F.lit, C.QUERY_STOPWORDS))
    terms = F.array_distinct(F.filter(T.tokens(F.col("question")), lambda t: ~F.array_contains(stop, t)))
    rows = sentence_rows(evidence).withColumn("terms", terms).withColumn("overlap", F.size(F.array_intersect("terms", T.tokens(F.col("sentence")))))
    enough = rows.where(F.col("overlap") >= F.when(F.size("terms") > 1, 2).otherwise(1))
    w = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "rank", "at", "node_id")
    return enough.withColumn("no", F.row_number().over(w)).where("no = 1").select("query_id", "node_id", F.col("sentence").alias("answer"), "overlap")


def citations(evidence: DataFrame) -> DataFrame:
    """evidence with source_id S1, S2, ... by rank, and excerpt."""
    w = Window.partitionBy("query_id").orderBy("rank", "node_id")
    return evidence.withColumn("source_id", F.concat(F.lit("S"), F.row_number().over(w).cast("string"))).withColumn("excerpt", T.excerpt(F.col("text")))


def selected_citation(evidence: DataFrame, answers: DataFrame) -> DataFrame:
    """The citations of answers (query_id, node_id): the node that an answer was taken from, as S1; all of a question's where it names none."""
    own = answers.where("node_id is not null").select("query_id", "node_id")
    chosen = citations(evidence.join(own, ["query_id", "node_id"], "left_semi"))
    rest = citations(evidence.join(own.select("query_id"), "query_id", "left_anti"))
    return chosen.unionByName(rest)


def used_citations(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """Those of cited (query_id, source_id, ...) that an answer marks."""
    marks = answers.select("query_id", F.explode(T.source_marks(F.col("answer"))).alias("source_id")).distinct()
    return cited.join(marks, ["query_id", "source_id"], "left_semi")


def chunk_answers(questions: DataFrame, evidence: DataFrame, generate: Callable[[Column], Column] | None = None) -> DataFrame:
    """(query_id, answer, way): the four tiers over chunks: a fact or definition, a sentence with the question's terms, a generator's answer,
    the first sentence in 45 words; questions without evidence are left out."""
    tiers = [facts(evidence).select("query_id", "answer", F.lit(0).alias("way")), definitions(evidence).select("query_id", "answer", F.lit(0).alias("way")), overlap_sentences(evidence).select("query_id", "answer", F.lit(1).alias("way"))]
    if generate is not None:
        made = questions.select("query_id", "question").join(evidence_block(evidence, 200), "query_id").select("query_id", generate(prompt(F.col("question"), F.col("block"))).alias("answer"))
        valid = validate(made, citations(evidence)).where("valid").select("query_id")
        tiers.append(made.join(valid, "query_id", "left_semi").withColumn("way", F.lit(2)))
    first = Window.partitionBy("query_id").orderBy("rank", "node_id")
    head = evidence.where("trim(text) <> ''").withColumn("no", F.row_number().over(first)).where("no = 1")
    tiers.append(head.select("query_id", T.truncate_words(F.get(T.sentences(F.col("text")), F.lit(0)), 45).alias("answer"), F.lit(3).alias("way")))
    every = tiers[0]
    for tier in tiers[1:]:
        every = every.unionByName(tier)
    best = Window.partitionBy("query_id").orderBy("way", "answer")
    return every.where("trim(answer) <> ''").withColumn("no", F.row_number().over(best)).where("no = 1").select("query_id", T.with_source_mark(F.col("answer")).alias("answer"), "way")


def evidence_block(evidence: DataFrame, n_words: int = 90) -> DataFrame:
    """(query_id, block): numbered sources with pages, section and text. evidence has page_start, page_end and heading_path."""
    cited = citations(evidence)
    head = F.concat(F.lit("["), "source_id", F.lit("] Pages: "), T.page_label(F.col("page_start"), F.col("page_end")), F.lit(" | Section: "), T.section_label(F.col("heading_path")))
    entry = F.concat_ws("\n", head, T.truncate_words(F.coalesce("text", F.lit("")), n_words))
    rows = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "node_id", entry.alias("entry")))).alias("e"))
    return rows.select("query_id", F.array_join(F.transform("e", lambda x: x["entry"]), "\n\n").alias("block"))


def prompt(question: Column, block: Column) -> Column:
    return F.concat(F.lit("Answer from the sources only, and mark each claim with its source like [S1].\n\nSources:\n"), block, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:"))


def extractive(questions: DataFrame, evidence: DataFrame, recognise: entities.Recogniser | None = None) -> DataFrame:
    """(query_id, question, answer, answerable, strategy, node_id): fact, else definition, else best sentence, else no evidence."""
    parts = [facts(evidence, recognise).select("query_id", "node_id", "answer", F.lit(0).alias("way")), definitions(evidence).withColumn("way", F.lit(1)), best_sentences(evidence).select("query_id", "node_id", "answer", F.lit(2).alias("way"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    first = every.withColumn("no", F.row_number().over(Window.partitionBy("query_id").orderBy("way"))).where("no = 1")
    out = questions.select("query_id", "question").join(first, "query_id", "left")
    answer = F.coalesce(T.with_source_mark(F.col("answer")), F.lit(C.NO_EVIDENCE))
    return out.select("query_id", "question", answer.alias("answer"), F.col("answer").isNotNull().alias("answerable"), F.when(F.col("answer").isNotNull(), "EXTRACTIVE").otherwise("INSUFFICIENT").alias("strategy"), "node_id")


def generated(questions: DataFrame, evidence: DataFrame, generate: Callable[[Column], Column], fallback: DataFrame) -> DataFrame:
    """Answers of a pluggable generator (a column of prompts to a column of texts), the fallback's where they fail the checks."""
    made = questions.select("query_id", "question").join(evidence_block(evidence, 200), "query_id").withColumn("made", generate(prompt(F.col("question"), F.col("block")))).where("trim(made) <> ''")
    checked = validate(made.select("query_id", F.col("made").alias("answer")), citations(evidence)).where("valid").select("query_id")
    good = made.join(checked, "query_id").select("query_id", "question", F.col("made").alias("answer"), F.lit(True).alias("answerable"), F.lit("GENERATE").alias("strategy"), F.lit(None).cast("string").alias("node_id"))
    return good.unionByName(fallback.join(good.select("query_id"), "query_id", "left_anti"))


def supported(answer: Column, evidence: Column, least: float = 0.35) -> Column:
    """Whether a claim's words, numbers, dates, names and directions stand in the evidence."""
    plain = F.regexp_replace(answer, r"\[S\d+\]", "")
    a, e = T.content_words(plain), T.content_words(evidence)
    # The evidence is searched only where the claim holds any of a kind.
    within = lambda f, x: F.when(F.size(f(x)) == 0, F.when(evidence.isNotNull(), True)).otherwise(F.size(F.array_except(f(x), f(evidence))) == 0)
    ok = (F.size(a) == 0) | (F.size(F.array_intersect(a, e)) / F.greatest(F.size(a), F.lit(1)) >= least)
    ok = ok & within(T.numbers, answer) & within(T.dates, answer) & within(T.proper_names, plain)
    told = F.when(plain == answer, a).otherwise(T.content_words(answer))
    for group in C.DIRECTIONS:
        words = F.array(*map(F.lit, group))
        ok = ok & (~F.arrays_overlap(told, words) | F.arrays_overlap(e, words))
    return ok


def validate(answers: DataFrame, cited: DataFrame, least: float = 0.35) -> DataFrame:
    """(query_id, valid): answers (query_id, answer) against the sources (query_id, source_id, excerpt) that they mark."""
    marks = answers.select("query_id", F.explode(T.source_marks(F.col("answer"))).alias("source_id"))
    used = cited.join(marks, ["query_id", "source_id"], "left_semi").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("source_id", "excerpt"))).alias("u"))
    both = answers.join(used, "query_id", "left").withColumn("evidence", F.array_join(F.transform("u", lambda x: x["excerpt"]), " "))
    ok = (F.trim("answer") != "") & F.col("u").isNotNull() & supported(F.col("answer"), F.col("evidence"), least)
    return both.select("query_id", F.coalesce(ok, F.lit(False)).alias("valid"))


def unsupported_numbers(answer: Column, evidence: Column) -> Column:
    return F.array_except(T.numbers(answer), T.numbers(evidence))
