"""Registered queries over the test tables, and the same in SQL.

documents stand for files (source is the session), their lines for nodes, the first
eight words of benchmark items for questions.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import constants as C
from . import oracles
from .functions import ids, phones, registered
from .functions import text as T
from .operators import answer, catalog, concepts, entities, index, retrieval, structure
from .operators.index_store import SearchIndex
from .plans.tables import at_rest, shared_folder
from .streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINES = "lines AS (SELECT doc_id, source, pos, trim(line) AS line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents))"
NODES = LINES + ", nodes AS (SELECT doc_id || ':' || pos AS node_id, doc_id AS document_id, source AS session_id, pos, CASE WHEN pos = 0 THEN line END AS title, line AS text, pos // 50 + 1 AS page_start FROM lines WHERE line <> '')"
WORDS = r"list_filter(string_split(trim(regexp_replace({}, '\s+', ' ', 'g')), ' '), lambda x: x <> '')"
ASKED = "asked AS (SELECT item_id AS query_id, array_to_string(list_slice(" + WORDS.format("text") + ", 1, 8), ' ') AS question FROM benchmark)"
FOLD = "strip_accents(lower({}))"


_DEPTH = r"CASE WHEN regexp_matches(line, '^\s*\d+\.\d+\.\d+[\s.]') THEN 3 WHEN regexp_matches(line, '^\s*\d+\.\d+[\s.]') THEN 2 WHEN regexp_matches(line, '^\s*\d+[\s.]') THEN 1 WHEN regexp_matches(line, '(?i)^\s*(chapter|section|part)\s+[\p{L}\p{N}_]+') THEN 1 ELSE 0 END"


def _tok(c: str) -> str:
    pattern = C.TOKEN.replace("'", "''")
    return f"list_distinct(list_transform(regexp_extract_all({c}, '{pattern}'), lambda x: lower(x)))"


_STOP = f"[{', '.join(repr(s) for s in C.QUERY_STOPWORDS)}]"


def filled(sql: str) -> str:
    """sql with @words(x) and @tokens(x), the stop words and heading depth of this module's SQL in place of their marks."""
    sql = sql.replace("@parts", oracles.PARTS.strip()).replace("@stop", _STOP)
    for mark, put in (("@words", WORDS.format), ("@tokens", _tok), ("@depth", lambda x: _DEPTH.replace("line", x))):
        sql = re.sub(mark + r"\((\w+)\)", lambda m, put=put: put(m[1]), sql)
    return sql


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return rows.withColumn("line", F.trim("line"))


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).where("line <> ''").select(
        F.concat_ws(":", "doc_id", "pos").alias("node_id"), F.col("doc_id").alias("document_id"), F.col("source").alias("session_id"), "pos", F.when(F.col("pos") == 0, F.col("line")).alias("title"), F.col("line").alias("text"), (F.floor(F.col("pos") / 50) + 1).alias("page_start")
    )


def asked(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.slice(T.words(F.col("text")), 1, 8), " ").alias("question"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


# Text


@query(f"WITH {LINES}, t AS (SELECT unnest(list_transform(regexp_extract_all(line, '{C.TOKEN.replace(chr(39), chr(39) * 2)}'), lambda x: lower(x))) AS token FROM lines) SELECT token, count(*) AS n FROM t GROUP BY token")
def q_tokenize_stats(spark, sf):
    return lines(spark, sf).select(F.explode(T.tokens(F.col("line"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query(f"WITH {LINES} SELECT doc_id, pos, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line FROM lines")
def q_normalize_lines(spark, sf):
    return lines(spark, sf).select("doc_id", "pos", T.normalize_space(F.col("line")).alias("line"))


@query(f"SELECT doc_id, CASE WHEN len({WORDS.format('text')}) <= 30 THEN text ELSE array_to_string(list_slice({WORDS.format('text')}, 1, 30), ' ') || '...' END AS short FROM documents")
def q_truncate_words(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.truncate_words(F.col("text"), 30).alias("short"))


@query(f"WITH {LINES}, s AS (SELECT doc_id, regexp_replace(regexp_replace(lower(line), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM lines WHERE pos = 0) SELECT doc_id, CASE WHEN slug = '' THEN 'concept' ELSE slug END AS slug FROM s")
def q_slug(spark, sf):
    return lines(spark, sf).where("pos = 0").select("doc_id", T.slug(F.col("line")).alias("slug"))


@query("SELECT source AS session_id, sha256(text) AS sha256, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1, 2")
def q_sha_dedup_docs(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("source").alias("session_id"), F.sha2("text", 256).alias("sha256"), "doc_id")
    return docs.groupBy("session_id", "sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query(f"WITH {LINES} SELECT doc_id, pos, 'doc_' || substr(sha256(source || chr(31) || doc_id || chr(31) || pos), 1, 16) AS id, 'node_' || substr(sha256('[\"node\",\"' || doc_id || '\",1,' || pos || ',[\"' || source || '\"]]'), 1, 32) AS node_id FROM lines")
def q_stable_ids(spark, sf):
    rows = lines(spark, sf)
    return rows.select("doc_id", "pos", ids.stable_id("doc", F.col("source"), F.col("doc_id"), F.col("pos")).alias("id"), ids.node_id(F.col("doc_id").cast("string"), F.lit(1), F.col("pos"), F.array("source")).alias("node_id"))


@query(f"WITH {LINES}, n AS (SELECT source, doc_id, pos, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS norm FROM lines), m AS (SELECT *, row_number() OVER (PARTITION BY source, doc_id ORDER BY pos) AS a, row_number() OVER (PARTITION BY source, doc_id ORDER BY pos DESC) AS z FROM n WHERE norm <> ''), c AS (SELECT source, norm, count(DISTINCT doc_id) AS n_pages FROM m WHERE a <= 3 OR z <= 3 GROUP BY 1, 2), p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM m GROUP BY 1) SELECT source AS document_id, norm, n_pages FROM c JOIN p USING (source) WHERE pages >= 3 AND n_pages >= greatest(3, floor(pages * 0.05)) AND length(norm) < 120")
def q_header_footer(spark, sf):
    rows = lines(spark, sf).select(F.col("source").alias("document_id"), F.col("doc_id").alias("page_number"), F.col("pos").alias("line_no"), "line")
    return structure.repeated_lines(rows, share=0.05)


@query("SELECT doc_id, CASE WHEN regexp_extract(substr(text, 1, 400), '^[^.!?]*[.!?]') <> '' THEN regexp_extract(substr(text, 1, 400), '^[^.!?]*[.!?]') ELSE substr(text, 1, 200) END AS sentence FROM documents")
def q_first_sentence(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.first_sentence(F.col("text")).alias("sentence"))




@query(f"WITH {LINES}, d AS (SELECT doc_id, pos, line, {_DEPTH} AS depth0, len({WORDS.format('line')}) AS n FROM lines WHERE line <> ''), s AS (SELECT doc_id, pos, depth0, round(CASE WHEN depth0 > 0 THEN 0.9 ELSE 0.0 END + CASE WHEN upper(line) = line AND lower(line) <> line AND n <= 12 THEN 0.7 ELSE 0.0 END + CASE WHEN n <= 12 AND NOT regexp_matches(line, '[.!?]$') THEN 0.2 ELSE 0.0 END + CASE WHEN n > 20 THEN -0.4 ELSE 0.0 END, 6) AS score FROM d) SELECT doc_id, pos, CAST(score AS DOUBLE) AS score, score >= 0.5 AS is_heading, CASE WHEN score >= 0.5 THEN depth0 ELSE 0 END AS depth FROM s")
def q_heading_score(spark, sf):
    blocks = lines(spark, sf).where("line <> ''").select(F.col("doc_id").alias("document_id"), F.col("pos").alias("block_pos"), F.col("line").alias("text"))
    return structure.detect_headings(blocks).select(F.col("document_id").alias("doc_id"), F.col("block_pos").alias("pos"), "score", "is_heading", "depth")


_LAYOUT = "CASE WHEN depth0 > 0 THEN 0.9 ELSE 0.0 END + CASE WHEN upper(line) = line AND lower(line) <> line AND n <= 12 THEN 0.7 ELSE 0.0 END + CASE WHEN size > 1.2 * base THEN 0.6 ELSE 0.0 END + CASE WHEN pos % 7 = 0 THEN 0.5 ELSE 0.0 END + CASE WHEN n <= 12 AND NOT regexp_matches(line, '[.!?]$') THEN 0.2 ELSE 0.0 END + CASE WHEN pos * 3 % 30 >= 18 THEN 0.25 ELSE 0.0 END + CASE WHEN n > 20 THEN -0.4 ELSE 0.0 END + CASE WHEN pos * 7 % 20 < 10 THEN 0.1 ELSE 0.0 END"


@query(f"WITH {LINES}, d AS (SELECT doc_id, pos, line, 9.0 + pos * pos % 6 AS size, {_DEPTH} AS depth0, len({WORDS.format('line')}) AS n FROM lines WHERE line <> ''), b AS (SELECT doc_id, list_sort(list(size))[len(list(size)) // 2 + 1] AS base FROM d GROUP BY 1), s AS (SELECT doc_id, pos, depth0, round({_LAYOUT}, 6) AS score FROM d JOIN b USING (doc_id)) SELECT doc_id, pos, CAST(score AS DOUBLE) AS score, score >= 0.5 AS is_heading, CASE WHEN score >= 0.5 THEN depth0 ELSE 0 END AS depth FROM s")
def q_heading_layout(spark, sf):
    at = F.col("pos")
    layout = {"font_size": (at * at % 6 + 9).cast("double"), "is_bold": at % 7 == 0, "line_spacing": (at * 3 % 30).cast("double"), "indent": (at * 7 % 20).cast("double")}
    blocks = lines(spark, sf).where("line <> ''").withColumns(layout).select(F.col("doc_id").alias("document_id"), at.alias("block_pos"), F.col("line").alias("text"), *layout)
    return structure.detect_headings(blocks).select(F.col("document_id").alias("doc_id"), F.col("block_pos").alias("pos"), "score", "is_heading", "depth")


@query("SELECT o_custkey AS document_id, CAST(list_sort(list(o_totalprice))[len(list(o_totalprice)) // 2 + 1] AS DOUBLE) AS baseline FROM orders GROUP BY 1")
def q_heading_baseline(spark, sf):
    return structure.baseline_size(table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_totalprice").cast("double").alias("font_size")))


def _bounded(p: str) -> str:
    return T.bounded(p).replace("'", "''")


_CLASSES = " ".join(f"WHEN regexp_matches(q, '{_bounded(p)}') THEN '{n}'" for n, p in C.QUESTION_CLASSES)


@query(f"WITH c AS (SELECT conv_id, turn, text, replace(replace(lower(text), 'collage', 'college'), 'transection', 'transaction') AS q FROM conversations) SELECT conv_id, turn, CASE {_CLASSES} WHEN len({WORDS.format('text')}) <= 4 THEN 'follow_up_or_short' ELSE 'direct_factual' END AS query_type FROM c")
def q_classify_queries(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.classify(F.col("text")).alias("query_type"))


@query(f"SELECT conv_id, turn, len({WORDS.format('text')}) <= 15 AND regexp_matches(text, '(?i){'|'.join(map(_bounded, C.FAST_FACT))}') AS fast_fact FROM conversations")
def q_fast_fact_flag(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.is_fast_fact(F.col("text")).alias("fast_fact"))


_SIDE = "regexp_replace(regexp_replace(regexp_extract(q, '{p}', {n}), '(?i)(?:^|[^\\p{{L}}\\p{{N}}_])(?:compare|comparison|difference|between)($|[^\\p{{L}}\\p{{N}}_])', ' \\1', 'g'), '^[ ?.,:;]+|[ ?.,:;]+$', '', 'g')"
_COMPARE = r"(?i)^(?:\s*(?:compare|comparison|difference(?:\s+between)?))?\s*(.+?)\s+(?:vs\.?|versus|and|with|to)\s+(.+?)\s*\??$"


@query(f"WITH c AS (SELECT item_id, 'compare ' || array_to_string({WORDS.format('text')}, ' ') AS q FROM benchmark) SELECT item_id, CASE WHEN regexp_matches(q, '{_COMPARE}') THEN {_SIDE.format(p=_COMPARE, n=1)} ELSE q END AS first_part, CASE WHEN regexp_matches(q, '{_COMPARE}') THEN {_SIDE.format(p=_COMPARE, n=2)} END AS second_part FROM c")
def q_comparison_split(spark, sf):
    q = F.concat(F.lit("compare "), F.array_join(T.words(F.col("text")), " "))
    parts = table(spark, sf, "benchmark").select("item_id", T.comparison_parts(q).alias("p"))
    return parts.select("item_id", F.get("p", F.lit(0)).alias("first_part"), F.get("p", F.lit(1)).alias("second_part"))


# Structure


@query(f"WITH {LINES} SELECT doc_id AS document_id, pos // 10 + 1 AS page_number, count(*) AS n_blocks, sum(length(line)) AS chars FROM lines WHERE line <> '' GROUP BY 1, 2")
def q_page_split(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")
    blocks = structure.plain_blocks(docs, lines_per_page=10, block_sep="\n")
    return blocks.groupBy("document_id", "page_number").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text")).alias("chars"))


@query(f"WITH {LINES}, p AS (SELECT doc_id, pos // 50 + 1 AS page_number, pos, line, len({WORDS.format('line')}) AS wc FROM lines WHERE trim(regexp_replace(line, '\\s+', ' ', 'g')) <> ''), g AS (SELECT *, CAST(sum(wc) OVER (PARTITION BY doc_id, page_number ORDER BY pos) AS BIGINT) // 360 AS grp FROM p), c AS (SELECT doc_id, page_number, grp, CAST(sum(wc) AS BIGINT) AS n_words, count(*) AS n_paras FROM g GROUP BY 1, 2, 3) SELECT doc_id AS document_id, page_number, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, grp) - 1 AS sequence, n_words FROM c")
def q_chunk_cumsum(spark, sf):
    rows = lines(spark, sf).groupBy(F.col("doc_id").alias("document_id"), (F.floor(F.col("pos") / 50) + 1).alias("page_number")).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    pages = rows.select("document_id", "page_number", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("text"))
    return structure.chunk_pages(pages).select("document_id", "page_number", "sequence", "n_words")


@query(f"WITH {LINES}, p AS (SELECT doc_id, max(pos // 5 + 1) AS pages FROM lines WHERE line <> '' GROUP BY 1) SELECT doc_id AS document_id, g AS \"group\", (g - 1) * 5 + 1 AS page_start, least(g * 5, pages) AS page_end FROM (SELECT doc_id, pages, unnest(generate_series(1, CAST(ceil(pages / 5.0) AS BIGINT))) AS g FROM p)")
def q_page_groups(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")
    blocks = structure.plain_blocks(docs, lines_per_page=5, block_sep="\n").withColumns({"is_heading": F.lit(False), "depth": F.lit(0)})
    tree = structure.build_tree(blocks).where("node_type = 'section'")
    return tree.select("document_id", (F.col("position") + 1).alias("group"), "page_start", "page_end")


@query(filled("WITH RECURSIVE src AS (SELECT doc_id AS k1, 0 AS k2, text FROM documents), @parts SELECT k1 AS doc_id, part, len(@words(body)) AS n_words, md5(body) AS digest FROM parts"))
def q_para_split(spark, sf):
    parts = table(spark, sf, "documents").select("doc_id", F.posexplode(structure.split_long(F.col("text"))).alias("part", "body"))
    return parts.select("doc_id", "part", T.word_count(F.col("body")).alias("n_words"), F.md5("body").alias("digest"))


@query(filled(f"WITH RECURSIVE {LINES}, {oracles.TREE} SELECT n.node_id, n.doc_id AS document_id, p.node_id AS parent_id, n.node_type, n.depth, n.position, array_to_string(n.hp, ' > ') AS path FROM named n LEFT JOIN named p ON p.doc_id = n.doc_id AND p.key = n.parent_key"))
def q_document_tree(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), "text")
    blocks = structure.detect_headings(structure.plain_blocks(docs, block_sep="\n"))
    return structure.build_tree(blocks).select("node_id", "document_id", "parent_id", "node_type", "depth", "position", F.array_join("heading_path", " > ").alias("path"))


# Trees: conversations hold turns; regions nations, nations customers


def _turns(spark, sf) -> DataFrame:
    rows = table(spark, sf, "conversations")
    turn = rows.select(F.concat_ws(":", "conv_id", "turn").alias("node_id"), F.col("conv_id").alias("document_id"), F.concat(F.lit("c"), "conv_id").alias("parent_id"), F.lit("paragraph").alias("node_type"), F.col("turn").cast("int").alias("position"))
    root = rows.select("conv_id").distinct().select(F.concat(F.lit("c"), "conv_id").alias("node_id"), F.col("conv_id").alias("document_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("document").alias("node_type"), F.lit(0).alias("position"))
    return turn.unionByName(root)


@query("SELECT n_regionkey AS anchor, n_nationkey AS node_id FROM nation")
def q_tree_children(spark, sf):
    rows = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.lit(0).alias("document_id"), F.col("n_nationkey").alias("position"))
    parents = table(spark, sf, "region").select(F.col("r_regionkey").alias("anchor"), F.concat(F.lit("r"), "r_regionkey").alias("node_id"))
    return structure.children(rows, parents).select("anchor", F.col("position").alias("node_id"))


@query("SELECT conv_id || ':' || turn AS node_id, lag(conv_id || ':' || turn) OVER w AS previous_id, lead(conv_id || ':' || turn) OVER w AS next_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, conv_id || ':' || turn)")
def q_tree_siblings(spark, sf):
    return structure.siblings(_turns(spark, sf)).where("node_id not like 'c%'")


def _places(spark, sf) -> DataFrame:
    top = table(spark, sf, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_regionkey").cast("int").alias("position"))
    mid = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_nationkey").cast("int").alias("position"))
    low = table(spark, sf, "customer").select(F.concat(F.lit("k"), "c_custkey").alias("node_id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_custkey").cast("int").alias("position"))
    return top.unionByName(mid).unionByName(low)


@query("SELECT 'r' || n_regionkey AS ancestor_id, 'n' || n_nationkey AS node_id, 1 AS level FROM nation UNION ALL SELECT 'n' || c_nationkey, 'k' || c_custkey, 1 FROM customer UNION ALL SELECT 'r' || n_regionkey, 'k' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q_tree_descendants(spark, sf):
    return structure.descendants(_places(spark, sf)).select("ancestor_id", "node_id", "level")


@query("WITH h AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations), x AS (SELECT h.conv_id, c.turn, h.rank, CASE WHEN c.turn = h.turn THEN 0 WHEN c.turn < h.turn THEN 2 ELSE 3 END AS kind FROM h JOIN conversations c ON c.conv_id = h.conv_id AND c.turn BETWEEN h.turn - 1 AND h.turn + 1), f AS (SELECT conv_id, turn, min(rank * 10 + kind) AS first_at FROM x GROUP BY 1, 2) SELECT conv_id AS query_id, conv_id || ':' || turn AS node_id, row_number() OVER (PARTITION BY conv_id ORDER BY first_at, conv_id || ':' || turn) AS place FROM f")
def q_tree_expand(spark, sf):
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    hits = table(spark, sf, "conversations").withColumn("rank", rank).select(F.col("conv_id").alias("query_id"), F.concat_ws(":", "conv_id", "turn").alias("node_id"), "rank")
    return structure.expand(_turns(spark, sf), hits)


# Catalog


@query(f"WITH {NODES} SELECT session_id, count(*) AS n, count(DISTINCT document_id) AS n_documents FROM nodes GROUP BY 1")
def q_nodes_for_session(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("session_id"))
    joined = catalog.nodes_for_session(nodes(spark, sf).drop("session_id"), docs)
    return joined.groupBy("session_id").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("n_documents"))


@query("WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem) SELECT l_orderkey AS list_id, l_linenumber AS place, l_partkey AS p_partkey, p_name FROM w JOIN part ON p_partkey = l_partkey")
def q_ordered_lookup(spark, sf):
    wanted = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("list_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("l"))
    flat = wanted.select("list_id", F.transform("l", lambda x: x["l_partkey"]).alias("ids"), F.transform("l", lambda x: x["l_linenumber"]).alias("places"))
    found = catalog.ordered_lookup(flat, table(spark, sf, "part").select("p_partkey", "p_name"), "p_partkey")
    return found.join(flat.select("list_id", "places"), "list_id").select("list_id", F.get("places", F.col("place")).alias("place"), "p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def q_stale_docs(spark, sf):
    child = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return catalog.childless(table(spark, sf, "customer"), child, "c_custkey").select("c_custkey", "c_name")


@query("SELECT o_orderkey AS document_id, count(l_orderkey) AS n_chunks FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F' GROUP BY 1")
def q_cascade_delete(spark, sf):
    docs = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "document_id")
    chunks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("chunk_id"))
    left, _ = catalog.delete_documents({"documents": docs, "chunks": chunks}, docs.where("o_orderstatus = 'F'"))
    return left["documents"].join(left["chunks"], "document_id", "left").groupBy("document_id").agg(F.count("chunk_id").alias("n_chunks"))


@query("WITH n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) SELECT user_id, event_id, event_type FROM n WHERE r = 1")
def q_upsert_latest(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    old = rows.groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.lit("old").alias("event_type"))
    return catalog.upsert(old, rows, ["user_id"], version="event_id")


@query("WITH n AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) SELECT user_id AS document_id, event_id AS job_id, event_type AS status FROM n WHERE r = 1")
def q_latest_job(spark, sf):
    log = table(spark, sf, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("created_at"))
    return catalog.latest_jobs(log).select("document_id", "job_id", "status")


@query("SELECT c_mktsegment AS slug0, c_custkey AS concept_id, CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_name) > 1 THEN c_mktsegment || '-' || right(c_name, 8) ELSE c_mktsegment END AS slug FROM customer")
def q_resolve_slugs(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("slug0"), F.col("c_mktsegment").alias("slug"), F.col("c_name").alias("concept_id"), F.col("c_acctbal").alias("arrival"), "c_custkey")
    return catalog.resolve_slugs(rows).select("slug0", F.col("c_custkey").alias("concept_id"), "slug")


# Index and search

TERMS = (
    r"asked_words AS (SELECT query_id, list_filter(" + WORDS.format(r"regexp_replace(replace(replace(question, '\"', ' '), '''', ' '), '[^\p{L}\p{N}_\s\-]', ' ', 'g')") + r", lambda x: true) AS w FROM asked), "
    f"kept AS (SELECT query_id, w, list_filter(w, lambda x: NOT list_contains([{', '.join(repr(s) for s in C.QUERY_STOPWORDS)}], lower(x))) AS k FROM asked_words), "
    r"term AS (SELECT query_id, " + FOLD.format("unnest(CASE WHEN len(k) > 0 THEN k ELSE w END)") + " AS t FROM kept)"
)
POSTED = r"posted AS (SELECT node_id, unnest(regexp_extract_all(" + FOLD.format("text") + r", '[\p{L}\p{N}]+')) AS term FROM nodes UNION ALL SELECT node_id, unnest(regexp_extract_all(" + FOLD.format("title") + r", '[\p{L}\p{N}]+')) FROM nodes WHERE title IS NOT NULL)"
BM25 = (
    "f AS (SELECT node_id, term, count(*) AS f FROM posted GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM f GROUP BY 1), dl AS (SELECT n.node_id, count(p.term) AS dl FROM nodes n LEFT JOIN posted p ON p.node_id = n.node_id GROUP BY 1), whole AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), "
    "w AS (SELECT query_id, t AS term, count(*) AS times FROM term WHERE t <> '' GROUP BY 1, 2), "
    "part AS (SELECT query_id, node_id, times * {idf} * f * {k1} / (f + {k} * ({b1} + {b} * dl / avgdl)) AS part FROM w JOIN f USING (term) JOIN df USING (term) JOIN dl USING (node_id), whole), "
    "scored AS (SELECT query_id, node_id, sum(part) AS score FROM part GROUP BY 1, 2)"
)
FTS = BM25.format(idf="CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END", k1=2.2, k=1.2, b1=0.25, b=0.75)
TOP = "SELECT query_id, node_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) AS rank FROM {}) WHERE rank <= {}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("query_id", "node_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {NODES}, {POSTED} SELECT term, count(DISTINCT node_id) AS df, count(*) AS cf FROM posted GROUP BY 1")
def q_postings_df(spark, sf):
    return index.node_term_stats(nodes(spark, sf))


@query(f"WITH {NODES}, {ASKED}, {TERMS}, {POSTED}, {FTS} {TOP.format('scored', 20)}")
def q_bm25_fts(spark, sf):
    return _rounded(index.bm25(nodes(spark, sf), asked(spark, sf), 20))


@query(f"WITH {NODES}, {ASKED}, {TERMS}, {POSTED}, {BM25.format(idf='ln(1 + (n - df + 0.5) / (df + 0.5))', k1=2.5, k=1.5, b1=0.25, b=0.75)} {TOP.format('scored', 20)}")
def q_bm25_lucene(spark, sf):
    return _rounded(index.bm25(nodes(spark, sf), asked(spark, sf), 20, "lucene", k1=1.5))


@query(f"WITH {NODES}, {ASKED}, q AS (SELECT DISTINCT query_id, unnest({WORDS.format('lower(question)')}) AS w FROM asked), h AS (SELECT DISTINCT node_id, unnest({WORDS.format('lower(text)')}) AS w FROM nodes), scored AS (SELECT query_id, node_id, CAST(count(*) AS DOUBLE) AS score FROM q JOIN h USING (w) GROUP BY 1, 2) {TOP.format('scored', 20)}")
def q_term_presence(spark, sf):
    return _rounded(index.term_presence(nodes(spark, sf), asked(spark, sf), 20))


@query(f"WITH {NODES}, {ASKED}, {TERMS.replace(FOLD.format('unnest(CASE WHEN len(k) > 0 THEN k ELSE w END)'), 'lower(unnest(CASE WHEN len(k) > 0 THEN k ELSE w END))')}, d AS (SELECT DISTINCT t FROM term WHERE length(t) > 1), hit AS (SELECT t, node_id FROM d JOIN nodes ON contains(lower(text), t)), scored AS (SELECT DISTINCT query_id, node_id, 1.0::DOUBLE AS score FROM term JOIN hit USING (t)) {TOP.format('scored', 20)}")
def q_like_search(spark, sf):
    return _rounded(index.like_search(nodes(spark, sf), asked(spark, sf), 20))


HEADS = (
    r"heads AS (SELECT node_id, norm, list_distinct(regexp_extract_all(norm, '[\p{L}\p{N}_]{2,}')) AS toks FROM (SELECT node_id, regexp_replace(trim(regexp_replace(lower(title), '\s+', ' ', 'g')), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') AS norm FROM nodes WHERE title IS NOT NULL) WHERE norm <> ''), "
    r"hq AS (SELECT query_id, q, list_distinct(regexp_extract_all(q, '[\p{L}\p{N}_]{2,}')) AS qt FROM (SELECT query_id, regexp_replace(trim(regexp_replace(lower(question), '\s+', ' ', 'g')), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g') AS q FROM asked)), "
    "hs AS (SELECT query_id, node_id, CASE WHEN norm = q THEN 1.0 WHEN starts_with(norm, q) OR starts_with(q, norm) THEN 0.8 ELSE CAST(len(list_intersect(toks, qt)) AS DOUBLE) / len(list_distinct(list_concat(toks, qt))) END AS score FROM heads, hq), "
    "headed AS (SELECT query_id, node_id, CAST(score AS DOUBLE) AS score FROM hs WHERE score >= 0.15)"
)


@query(f"WITH {NODES}, {ASKED}, {HEADS} {TOP.format('headed', 20)}")
def q_heading_search(spark, sf):
    return _rounded(index.heading_search(nodes(spark, sf), asked(spark, sf), 20))


PHRASES = (
    r"pw AS (SELECT node_id, regexp_extract_all(lower(concat_ws(' ', title, trim(CASE WHEN regexp_extract(substr(text, 1, 400), '^[^.!?]*[.!?]') <> '' THEN regexp_extract(substr(text, 1, 400), '^[^.!?]*[.!?]') ELSE substr(text, 1, 200) END))), '[\p{L}\p{N}_]+') AS w FROM nodes), "
    "pn AS (SELECT node_id, w, n, unnest(generate_series(1, CAST(len(w) - n + 1 AS BIGINT))) AS i FROM pw, (SELECT unnest([2, 3, 4]) AS n) WHERE len(w) >= n), phrases AS (SELECT DISTINCT array_to_string(list_slice(w, i, i + n - 1), ' ') AS phrase, node_id FROM pn), "
    r"qw AS (SELECT query_id, regexp_extract_all(lower(CASE WHEN regexp_extract(question, '\"([^\"]+)\"', 1) <> '' THEN regexp_extract(question, '\"([^\"]+)\"', 1) WHEN contains(trim(question), ' ') THEN trim(question) ELSE '' END), '[\p{L}\p{N}_]+') AS w FROM (SELECT query_id * 100 + n * 10 + i AS query_id, array_to_string(list_slice(w, i, i + n - 1), ' ') AS question FROM (SELECT query_id, string_split(question, ' ') AS w, n, unnest(generate_series(1, CAST(len(string_split(question, ' ')) - n + 1 AS BIGINT))) AS i FROM asked, (SELECT unnest([2, 3, 4]) AS n)))), "
    "pq AS (SELECT query_id, array_to_string(w, ' ') AS phrase, 1.0 AS score FROM qw WHERE len(w) > 1 UNION ALL SELECT query_id, array_to_string(list_slice(w, 1, len(w) - 1), ' '), 0.5 FROM qw WHERE len(w) >= 3 UNION ALL SELECT query_id, array_to_string(list_slice(w, 2, len(w)), ' '), 0.5 FROM qw WHERE len(w) >= 3), "
    "phrased AS (SELECT query_id, node_id, CAST(max(score) AS DOUBLE) AS score FROM phrases JOIN pq USING (phrase) GROUP BY 1, 2)"
)


def runs_asked(spark, sf) -> DataFrame:
    """Every run of two to four words of a question as a question of its own (query_id * 100 + words * 10 + place)."""
    w = asked(spark, sf).select("query_id", F.split("question", " ").alias("w"), F.explode(F.array(*map(F.lit, (2, 3, 4)))).alias("n"))
    at = w.where("size(w) >= n").withColumn("i", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)))
    return at.select((F.col("query_id") * 100 + F.col("n") * 10 + F.col("i")).alias("query_id"), F.array_join(F.slice("w", F.col("i"), F.col("n")), " ").alias("question"))


@query(f"WITH {NODES}, {ASKED}, {PHRASES} {TOP.format('phrased', 20)}")
def q_phrase_search(spark, sf):
    return _rounded(index.phrase_search(nodes(spark, sf), runs_asked(spark, sf), 20))


def _ranked(source: str, k: int) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, node_id) AS rank FROM {source}) WHERE rank <= {k}"


RRF = f"fused AS (SELECT query_id, node_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, node_id, rank FROM {_ranked('scored', 40)} UNION ALL SELECT query_id, node_id, rank FROM {_ranked('headed', 20)} UNION ALL SELECT query_id // 100, node_id, min(rank) FROM {_ranked('phrased', 20)} GROUP BY 1, 2) GROUP BY 1, 2)"


@query(f"WITH {NODES}, {ASKED}, {TERMS}, {POSTED}, {FTS}, {HEADS}, {PHRASES}, {RRF} {TOP.format('fused', 20)}")
def q_rrf(spark, sf):
    n, q = nodes(spark, sf), asked(spark, sf)
    runs = index.phrase_search(n, runs_asked(spark, sf), 20).groupBy(F.floor(F.col("query_id") / 100).alias("query_id"), "node_id").agg(F.min("rank").alias("rank"))
    return _rounded(retrieval.fuse(index.bm25(n, q, 40), index.heading_search(n, q, 20), runs, k=20))


@query(f"WITH {NODES}, {ASKED}, {TERMS}, {POSTED}, {FTS}, best AS ({TOP.format('scored', 8)}) SELECT query_id, node_id, rank, round(score, 6) AS score, 'S' || rank AS source_id, substr(text, 1, 300) AS excerpt, session_id FROM best JOIN nodes USING (node_id)")
def q_lexical_retrieve(spark, sf):
    n = nodes(spark, sf)
    hits = _rounded(index.bm25(n, asked(spark, sf), 8))
    found = hits.join(n.select("node_id", "text", "session_id"), "node_id")
    return answer.citations(found).select("query_id", "node_id", "rank", "score", "source_id", "excerpt", "session_id")


@query(f"WITH {NODES}, {ASKED}, {TERMS}, {POSTED}, {FTS}, best AS ({TOP.format('scored', 8)}), held AS (SELECT item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), hit AS (SELECT DISTINCT query_id AS item_id FROM best JOIN nodes USING (node_id) JOIN held h ON h.item_id = query_id AND h.doc_id = document_id) SELECT item_id, count(*) AS n_documents, item_id IN (SELECT item_id FROM hit) AS found FROM held GROUP BY 1")
def q_retrieval_recall(spark, sf):
    n, bench = nodes(spark, sf), table(spark, sf, "benchmark")
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("whole"))
    # A document that holds an item holds its first six words in a row, which an equi-join finds.
    head = lambda c: F.array_join(F.slice(T.words(F.col(c)), 2, 6), " ")
    w = docs.select("doc_id", T.words(F.col("whole")).alias("w"))
    runs = w.where("size(w) >= 6").select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 5), lambda i: F.array_join(F.slice("w", i, 6), " "))).alias("head"))
    maybe = runs.join(index.few(bench.select("item_id", head("text").alias("head"))), "head").select("doc_id", "item_id").distinct()
    held = maybe.join(docs, "doc_id").join(bench, "item_id").where(F.col("whole").contains(F.col("text"))).select("item_id", "doc_id")
    best = index.bm25(n, asked(spark, sf), 8).join(n.select("node_id", "document_id"), "node_id").select(F.col("query_id").alias("item_id"), F.col("document_id").alias("doc_id"), F.lit(True).alias("hit")).distinct()
    return held.join(best, ["item_id", "doc_id"], "left").groupBy("item_id").agg(F.count("*").alias("n_documents"), F.coalesce(F.bool_or("hit"), F.lit(False)).alias("found"))


# Ranking

def _ts(c: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]{{2,}}'))"


def _jac(c: str) -> str:
    q, t = _ts("question"), _ts(c)
    return f"CASE WHEN len(list_distinct(list_concat({q}, {t}))) = 0 THEN 0.0 ELSE CAST(len(list_intersect({q}, {t})) AS DOUBLE) / len(list_distinct(list_concat({q}, {t}))) END"


_HEAD = f"CASE WHEN coalesce(title, '') = '' THEN 0.0 WHEN contains(lower(question), lower(title)) OR contains(lower(title), lower(question)) THEN 1.0 ELSE {_jac('title')} END"
_PAGE = "CASE WHEN page_start <= 0 THEN 0.5 ELSE greatest(0.0, 1 - ln(page_start + 1) / ln(502)) END"
_DENS = f"CASE WHEN len({WORDS.format('text')}) < 10 THEN 0.0 WHEN len({WORDS.format('text')}) < 30 THEN 0.5 ELSE 1.0 END"
CANDIDATES = f"cand AS (SELECT query_id, question, node_id, title, text, page_start, round(score, 6) AS hit FROM ({TOP.format('scored', 20)}) JOIN nodes USING (node_id) JOIN asked USING (query_id))"
SIGNALS = f"sig AS (SELECT *, {_jac('text')} AS overlap, {_HEAD} AS heading, {_PAGE} AS page, {_DENS} AS density FROM cand)"
RANKED = f"WITH {NODES}, {ASKED}, {TERMS}, {POSTED}, {FTS}, {CANDIDATES}, {SIGNALS}, r AS (SELECT query_id, node_id, round(@score, 4) AS score FROM sig) SELECT query_id, node_id, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, node_id) AS rank FROM r"


def _candidates(spark, sf) -> DataFrame:
    n, q = nodes(spark, sf), asked(spark, sf)
    hits = _rounded(index.bm25(n, q, 20)).select("query_id", "node_id", F.col("score").alias("hit"))
    return hits.join(n, "node_id").join(q, "query_id").withColumn("in_tree", F.lit(True))


def _ranks(df: DataFrame) -> DataFrame:
    return df.select("query_id", "node_id", "score", "rank")


@query(RANKED.replace("@score", "0.5 * overlap + 0.2 * heading + 0.15 + 0.1 * page + 0.05 * density"))
def q_jaccard_rank(spark, sf):
    return _ranks(retrieval.rank_nodes(_candidates(spark, sf)))


@query(RANKED.replace("@score", "0.55 * hit + 0.3 * overlap + 0.1 * heading + 0.05 * density"))
def q_rank_fast_fact(spark, sf):
    return _ranks(retrieval.rank_fast_fact(_candidates(spark, sf)))


@query(RANKED.replace("@score", "0.45 * heading + 0.3 * overlap + 0.15 * hit + 0.1 * page"))
def q_rank_topic(spark, sf):
    return _ranks(retrieval.rank_topic(_candidates(spark, sf)))


@query(f"WITH {NODES}, {ASKED}, {TERMS}, {POSTED}, {FTS}, {CANDIDATES}, t AS (SELECT query_id, node_id, {_tok('question')} AS q, {_tok('text')} AS c FROM cand), r AS (SELECT query_id, node_id, CASE WHEN len(q) = 0 OR len(c) = 0 THEN 0.0 ELSE round(CAST(len(list_intersect(q, c)) AS DOUBLE) / len(q) + CAST(len(list_intersect(q, c)) AS DOUBLE) / len(c), 4) END AS score FROM t) SELECT query_id, node_id, CAST(score AS DOUBLE) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 4) DESC, node_id) AS rank FROM r")
def q_rerank(spark, sf):
    return _ranks(retrieval.rerank(_candidates(spark, sf)))


@query(f"WITH {NODES} SELECT node_id, {_DENS} AS density, round(CAST({_PAGE} AS DOUBLE), 6) AS page FROM nodes")
def q_density_page(spark, sf):
    return nodes(spark, sf).select("node_id", retrieval.density_score(F.col("text")).alias("density"), F.round(retrieval.page_score(F.col("page_start")), 6).alias("page"))


@query(f"WITH {NODES}, {ASKED}, {TERMS}, {POSTED}, {FTS}, {CANDIDATES} SELECT query_id, count(*) AS n, CAST(least(count(*) / 3.0, 1.0) AS DOUBLE) AS count_signal, round(least(avg(length(text) - length(replace(text, ' ', '')) + 1) / 50, 1.0), 6) AS density_signal FROM cand GROUP BY 1")
def q_gate_signals(spark, sf):
    return retrieval.gate_signals(_candidates(spark, sf)).withColumn("density_signal", F.round("density_signal", 6)).withColumn("count_signal", F.col("count_signal").cast("double"))


@query()
def q_gate_full(spark, sf):
    ranked = retrieval.rank_nodes(_candidates(spark, sf), 8)
    return retrieval.gate(ranked).withColumn("score", F.round("score", 6))


@query("WITH t AS (SELECT event_id, CASE user_id % 5 WHEN 0 THEN 'fast_fact' WHEN 1 THEN 'topic' WHEN 2 THEN 'comparison' WHEN 3 THEN 'summary' ELSE 'direct_factual' END AS kind, event_id % 100 / 100.0 AS best FROM events) SELECT event_id, CASE WHEN best < 0.15 THEN 'INSUFFICIENT' WHEN kind IN ('comparison', 'summary') THEN 'GENERATE' WHEN kind IN ('fast_fact', 'topic') AND best > 0.65 THEN 'EXTRACTIVE' ELSE 'GENERATE' END AS strategy FROM t")
def q_strategy(spark, sf):
    m = F.col("user_id") % 5
    kind = F.when(m == 0, "fast_fact").when(m == 1, "topic").when(m == 2, "comparison").when(m == 3, "summary").otherwise("direct_factual")
    return table(spark, sf, "events").select("event_id", retrieval.strategy(kind, F.col("event_id") % 100 / 100, True).alias("strategy"))


# Extraction and checks


@query(f"WITH {LINES}, e AS (SELECT doc_id, pos, regexp_extract(line, '{C.EMAIL}', 1) AS email, regexp_extract(line, '{C.CGPA}', 1) AS cgpa FROM lines) SELECT doc_id, pos, nullif(email, '') AS email, nullif(cgpa, '') AS cgpa FROM e WHERE email <> '' OR cgpa <> ''")
def q_email_cgpa(spark, sf):
    found = lines(spark, sf).select("doc_id", "pos", T.email(F.col("line")).alias("email"), T.cgpa(F.col("line")).alias("cgpa"))
    return found.where("email is not null or cgpa is not null")


@query(f"WITH {LINES}, n AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(line, '{C.NUMBER}')) AS number FROM lines) SELECT doc_id, number FROM n")
def q_numbers(spark, sf):
    return lines(spark, sf).select("doc_id", F.explode(T.numbers(F.col("line"))).alias("number")).distinct()


#: RE2's word borders know ASCII only; with other letters as '_' they are the same.
ASCII = "regexp_replace({}, '[^\\x00-\\x7F]', '_', 'g')"


@query(f"WITH {LINES}, l AS (SELECT doc_id, {ASCII.format('line')} AS line FROM lines) SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(line, '{C.DATE}'))) AS found, 'date' AS kind FROM l UNION ALL SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(line, '{C.PROPER_NAME}'))), 'name' FROM l")
def q_dates_names(spark, sf):
    found = lambda f, kind: lines(spark, sf).select("doc_id", F.explode(f(F.col("line"))).alias("found")).distinct().withColumn("kind", F.lit(kind))
    return found(T.dates, "date").unionByName(found(T.proper_names, "name"))


def _cw(c: str) -> str:
    pattern = C.CONTENT_WORD.replace("'", "''")
    return f"list_filter(list_distinct(list_transform(regexp_extract_all({c}, '{pattern}'), lambda x: lower(x))), lambda x: NOT list_contains([{', '.join(repr(s) for s in C.CITATION_STOPWORDS)}], x))"


def _within(pattern: str, lower: bool) -> str:
    """All matches in a are matches in e."""
    found = lambda c: f"list_transform(regexp_extract_all({c}, '{pattern}'), lambda x: {'lower(x)' if lower else 'x'})"
    return f"len(list_filter({found('a')}, lambda x: NOT list_contains({found('e')}, x))) = 0"


_DIR = " AND ".join(f"(NOT list_has_any({_cw("a")}, {list(g)!r}) OR list_has_any({_cw("e")}, {list(g)!r}))" for g in C.DIRECTIONS)


@query(f"WITH {LINES}, p AS (SELECT c.doc_id, c.pos, {ASCII.format('c.line')} AS a, {ASCII.format('e.line')} AS e FROM lines c JOIN lines e ON e.doc_id = c.doc_id AND e.pos = c.pos - 1) SELECT doc_id, pos, (len({_cw('a')}) = 0 OR CAST(len(list_intersect({_cw('a')}, {_cw('e')})) AS DOUBLE) / greatest(len({_cw('a')}), 1) >= 0.35) AND {_within(C.NUMBER, False)} AND {_within(C.DATE, True)} AND {_within(C.PROPER_NAME, True)} AND {_DIR} AS valid FROM p")
def q_citation_validate(spark, sf):
    # A line and the one before it are paired in their document's row; no text is shuffled.
    held = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    zipped = held.select("doc_id", F.posexplode(F.arrays_zip(F.slice("l", F.lit(2), F.size("l")).alias("a"), F.slice("l", F.lit(1), F.size("l") - 1).alias("e"))).alias("pos", "p"))
    pairs = zipped.select("doc_id", (F.col("pos") + 1).alias("pos"), F.trim("p.a").alias("a"), F.trim("p.e").alias("e"))
    return pairs.select("doc_id", "pos", answer.supported(F.col("a"), F.col("e")).alias("valid"))


@query(f"WITH {LINES}, p AS (SELECT c.doc_id, c.pos, {ASCII.format('c.line')} AS a, {ASCII.format('e.line')} AS e FROM lines c JOIN lines e ON e.doc_id = c.doc_id AND e.pos = c.pos - 1) SELECT DISTINCT doc_id, pos, unnest(list_filter(regexp_extract_all(a, '{C.NUMBER}'), lambda x: NOT list_contains(regexp_extract_all(e, '{C.NUMBER}'), x))) AS number FROM p")
def q_unsupported_numbers(spark, sf):
    rows = lines(spark, sf)
    pairs = rows.select("doc_id", "pos", F.col("line").alias("a")).join(rows.select("doc_id", (F.col("pos") + 1).alias("pos"), F.col("line").alias("e")), ["doc_id", "pos"])
    return pairs.select("doc_id", "pos", F.explode(answer.unsupported_numbers(F.col("a"), F.col("e"))).alias("number"))


def _evidence(spark, sf) -> DataFrame:
    ranked = retrieval.rerank(_candidates(spark, sf), 8)
    return ranked.withColumns({"page_end": F.col("page_start"), "heading_path": F.array(F.concat(F.lit("doc "), F.col("document_id").cast("string")))})


@query()
def q_best_sentence(spark, sf):
    return answer.best_sentences(_evidence(spark, sf))


@query()
def q_extractive_answer(spark, sf):
    return answer.extractive(asked(spark, sf), _evidence(spark, sf)).drop("node_id")


EVIDENCE = ORACLES["q_rerank"].replace(" SELECT query_id, node_id, CAST(score", ", ev0 AS (SELECT query_id, node_id, CAST(score", 1) + "), ev AS (SELECT e.query_id, e.rank, c.question, c.node_id, c.title, c.text, c.page_start, n.document_id FROM ev0 e JOIN cand c USING (query_id, node_id) JOIN nodes n USING (node_id) WHERE e.rank <= 8)"


@query(f"{EVIDENCE}, b AS (SELECT query_id, rank, '[S' || rank || '] Pages: ' || page_start || ' | Section: doc ' || document_id || chr(10) || CASE WHEN len({WORDS.format('text')}) <= 90 THEN text ELSE array_to_string(list_slice({WORDS.format('text')}, 1, 90), ' ') || '...' END AS entry FROM ev) SELECT query_id, string_agg(entry, chr(10) || chr(10) ORDER BY rank) AS block FROM b GROUP BY 1")
def q_evidence_block(spark, sf):
    return answer.evidence_block(_evidence(spark, sf))


@query(filled(f"{EVIDENCE}, {oracles.OVERLAP}"))
def q_overlap_sentence(spark, sf):
    return answer.overlap_sentences(_evidence(spark, sf))


# Concepts: a document's lines are its chunks and sentences


def _chunks(spark, sf) -> DataFrame:
    return lines(spark, sf).where("line <> ''").select(F.col("source").alias("document_id"), F.concat_ws(":", "doc_id", "pos").alias("chunk_id"), F.regexp_replace("line", "[.!?]", "").alias("text"))


_CSTOP = f"[{', '.join(repr(s) for s in C.CONCEPT_STOPWORDS)}]"
_FINE = f"(length({{0}}) >= 3 AND NOT list_contains({_CSTOP}, {{0}}))"
GRAMS = (
    f"{LINES}, tk AS (SELECT source AS document_id, doc_id || ':' || pos AS chunk_id, list_transform(regexp_extract_all(regexp_replace(line, '[.!?]', '', 'g'), '{C.TOKEN.replace(chr(39), chr(39) * 2)}'), lambda x: lower(x)) AS t FROM lines WHERE line <> ''), "
    "gi AS (SELECT document_id, chunk_id, t, n, unnest(generate_series(1, CAST(len(t) - n + 1 AS BIGINT))) AS i FROM tk, (SELECT unnest([1, 2, 3]) AS n) WHERE len(t) >= n), "
    f"gr AS (SELECT document_id, chunk_id, n, list_slice(t, i, i + n - 1) AS g FROM gi), "
    f"found AS (SELECT document_id, chunk_id, array_to_string(g, ' ') AS phrase, g FROM gr WHERE {_FINE.format('g[1]')} AND {_FINE.format('g[len(g)]')} AND (n = 1 OR len(list_filter(g, lambda x: regexp_matches(x, '^[0-9]+$'))) = 0))"
)
SCORED = "sc AS (SELECT document_id, phrase, count(*) AS hits, count(DISTINCT chunk_id) AS n_sentences, round(count(DISTINCT chunk_id) * (1 + 0.35::DOUBLE * (len(list_distinct(any_value(g))) - 1)), 6) AS score FROM found GROUP BY 1, 2)"


@query(f"WITH {GRAMS} SELECT phrase, count(*) AS n FROM found GROUP BY 1")
def q_concept_ngrams(spark, sf):
    return concepts.phrases(_chunks(spark, sf)).groupBy("phrase").agg(F.count("*").alias("n"))


@query(f"WITH {GRAMS}, {SCORED} SELECT document_id, phrase, hits, n_sentences, score FROM sc")
def q_concept_score(spark, sf):
    return concepts.scores(_chunks(spark, sf))


@query(f"WITH RECURSIVE {GRAMS}, {SCORED}, {oracles.TOP_CONCEPTS}")
def q_concept_top12(spark, sf):
    return concepts.top_concepts(concepts.scores(_chunks(spark, sf), hits=False))


CHOSEN = "ch AS (SELECT document_id, phrase FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY score DESC, phrase) AS r FROM sc) WHERE r <= 12)"


@query(f"WITH {GRAMS}, {SCORED}, {CHOSEN}, k AS (SELECT DISTINCT document_id, phrase, chunk_id FROM found JOIN ch USING (document_id, phrase)), z AS (SELECT document_id, phrase, count(*) AS n FROM k GROUP BY 1, 2), m AS (SELECT a.document_id, a.phrase, b.phrase AS other, count(*) AS m FROM k a JOIN k b ON a.document_id = b.document_id AND a.chunk_id = b.chunk_id AND a.phrase <> b.phrase GROUP BY 1, 2, 3), j AS (SELECT m.document_id, m.phrase, other, round(CAST(m AS DOUBLE) / (z.n + y.n - m), 6) AS jaccard FROM m JOIN z ON z.document_id = m.document_id AND z.phrase = m.phrase JOIN z y ON y.document_id = m.document_id AND y.phrase = other) SELECT document_id, phrase, other, jaccard, place FROM (SELECT *, row_number() OVER (PARTITION BY document_id, phrase ORDER BY jaccard DESC, other) AS place FROM j) WHERE place <= 5")
def q_concept_related(spark, sf):
    found, chosen = concepts.best_phrases(_chunks(spark, sf))
    return concepts.related(found, chosen)


_WORDY = f"list_filter({WORDS.format('lower(replace(@, chr(45), chr(32)))')}, lambda x: length(x) > 2)"


@query(f"WITH {ASKED}, {LINES}, c AS (SELECT DISTINCT doc_id AS concept_id, unnest({_WORDY.replace('@', 'line')}) AS w FROM lines UNION SELECT doc_id, lower(lang) FROM documents WHERE length(lang) > 2 UNION SELECT doc_id, unnest({_WORDY.replace('@', 'source')}) FROM documents), q AS (SELECT DISTINCT query_id, unnest({_WORDY.replace('@', 'question')}) AS w FROM asked), s AS (SELECT query_id, concept_id, count(*) AS overlap FROM c JOIN q USING (w) GROUP BY 1, 2) SELECT query_id, concept_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, concept_id) AS r FROM s) WHERE r <= 5")
def q_concept_match(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("concept_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("slug"), "text", F.array("lang").alias("aliases"), F.array("source").alias("tags"))
    return concepts.match_concepts(rows, asked(spark, sf))


# Events


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def q_events_windowed(spark, sf):
    rows = ingest.windowed(table(spark, sf, "events"), ["event_type"], {"n": F.count("*"), "total": F.round(F.sum("value"), 4)})
    return rows.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# More of the operators: orders, merges, look-ups, catalog changes, index maintenance, checks


@query(f"WITH {NODES} SELECT document_id, page_start AS page_number, md5(string_agg(text, chr(10) || chr(10) ORDER BY pos, node_id)) AS digest, any_value(session_id) AS section FROM nodes GROUP BY 1, 2")
def q_page_texts(spark, sf):
    tree = nodes(spark, sf).withColumns({"node_type": F.lit("paragraph"), "depth": F.lit(1), "position": F.col("pos"), "heading_path": F.array("session_id")})
    pages = structure.page_texts(tree)
    return pages.select("document_id", "page_number", F.md5("text").alias("digest"), F.get("section_path", F.lit(0)).alias("section"))


@query("WITH p AS (SELECT r_regionkey AS r, -1 AS n, -1 AS c, 'r' || r_regionkey AS node_id FROM region UNION ALL SELECT n_regionkey, n_nationkey, -1, 'n' || n_nationkey FROM nation UNION ALL SELECT n_regionkey, n_nationkey, c_custkey, 'k' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT r AS document_id, node_id, row_number() OVER (PARTITION BY r ORDER BY n, c) - 1 AS place FROM p")
def q_preorder(spark, sf):
    up = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("parent_id"), "n_regionkey")
    places = _places(spark, sf).join(up, "parent_id", "left")
    region = F.regexp_extract(F.coalesce("parent_id", "node_id"), "^r([0-9]+)$", 1)
    return structure.preorder(places.withColumn("document_id", F.coalesce("n_regionkey", F.when(region != "", region.cast("int")))), depth=2)


@query("WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations WHERE role = 'user'), b AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations), u AS (SELECT conv_id, turn, 0 AS side, place FROM a UNION ALL SELECT conv_id, turn, 1, place FROM b), f AS (SELECT conv_id, turn, min(side * 1000000 + place) AS first_at FROM u GROUP BY 1, 2) SELECT conv_id AS query_id, turn AS node_id, row_number() OVER (PARTITION BY conv_id ORDER BY first_at) AS place FROM f")
def q_merge_ordered(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("node_id"), "role")
    by = lambda df, order: df.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(order)))
    return structure.merge_ordered(by(rows.where("role = 'user'"), F.desc("node_id")), by(rows, F.col("node_id")))


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 7 AS batch FROM events")
def q_batches(spark, sf):
    return structure.batches(table(spark, sf, "events").select("user_id", "event_id"), ["user_id", "event_id"], 7)


@query(f"WITH {LINES}, m AS (SELECT item_id AS query_id, doc_id FROM benchmark JOIN documents ON doc_id % 40 = item_id % 40) SELECT query_id, m.doc_id || ':' || pos AS chunk_id, length(line) AS n FROM m JOIN lines USING (doc_id) WHERE line <> ''")
def q_concept_chunks(spark, sf):
    rows = lines(spark, sf).where("line <> ''").select("doc_id", "pos", F.concat_ws(":", "doc_id", "pos").alias("chunk_id"), F.length("line").alias("n"))
    held = rows.groupBy(F.col("doc_id").alias("concept_id")).agg(F.collect_list("chunk_id").alias("source_chunk_ids"))
    matched = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("m")).join(held.select("concept_id", (F.col("concept_id") % 40).alias("m")), "m").drop("m")
    twice = matched.unionByName(matched)  # a chunk comes once for a question
    return concepts.concept_chunks(twice, held, rows.select("chunk_id", "n"))


@query("SELECT conv_id, turn, coalesce(source, CAST(conv_id * 20 + turn AS VARCHAR)) AS file_name FROM conversations LEFT JOIN documents ON doc_id = conv_id * 20 + turn")
def q_enrich_citations(spark, sf):
    names = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("filename"))
    # Some of the numbers are those of documents, others are of none.
    cited = table(spark, sf, "conversations").select("conv_id", "turn", (F.col("conv_id") * 20 + F.col("turn")).cast("string").alias("document_id"))
    return catalog.enrich_citations(cited, names).select("conv_id", "turn", "file_name")


def _bundle(spark, sf) -> DataFrame:
    """A concept file for each document: some lack a title, an id or a body, some link to files that aren't there."""
    d = table(spark, sf, "documents").select("doc_id", "lang")
    front = F.concat(
        F.lit("---\ntype: concept\n"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("title: Document "), "doc_id", F.lit("\n"))).otherwise(F.lit("")),
        F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("id: d"), "doc_id", F.lit("\n"))).otherwise(F.lit("")), F.when(F.col("doc_id") % 5 == 0, F.lit("tags: one\n")).otherwise(F.concat(F.lit("tags: ["), "lang", F.lit("]\n"))), F.lit("---\n"),
    )
    body = F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("See [next](doc-"), F.col("doc_id") + 1, F.lit(".md).\n")))
    return d.select(F.concat(F.lit("doc-"), "doc_id", F.lit(".md")).alias("path"), F.concat(front, body).alias("value"))


_ISSUES = "SELECT 'doc-' || doc_id || '.md' AS path, '{s}' AS severity, '{k}' AS kind FROM documents WHERE {w}"


@query(" UNION ALL ".join((
    _ISSUES.format(s="error", k="title", w="doc_id % 3 = 0"), _ISSUES.format(s="error", k="id", w="doc_id % 4 = 0"), _ISSUES.format(s="error", k="tags", w="doc_id % 5 = 0"),
    _ISSUES.format(s="warning", k="empty", w="doc_id % 7 = 0"), _ISSUES.format(s="warning", k="found", w="doc_id % 7 <> 0 AND doc_id + 1 NOT IN (SELECT doc_id FROM documents)"),
)))
def q_bundle_issues(spark, sf):
    found = concepts.validate_bundle(concepts.bundle_files(_bundle(spark, sf)))
    return found.select("path", "severity", F.regexp_extract(F.lower("message"), r"(title|\bid\b|tags|empty|found)", 1).alias("kind"))


@query("SELECT CASE WHEN doc_id % 4 > 0 THEN 'd' || doc_id ELSE 'concept_' || substr(sha256('doc-' || doc_id || '.md'), 1, 16) END AS concept_id, CASE WHEN doc_id % 3 > 0 THEN 'Document ' ELSE 'Doc ' END || doc_id AS title, CASE WHEN doc_id % 3 > 0 THEN 'document-' ELSE 'doc-' END || doc_id AS slug, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS n_tags FROM documents")
def q_bundle_concepts(spark, sf):
    made = concepts.concepts_of_bundle(concepts.bundle_files(_bundle(spark, sf)))
    return made.select("concept_id", "title", "slug", F.size("tags").alias("n_tags"))


@query("WITH k AS (SELECT sha256(text) AS sha, source, min('known_' || doc_id) AS known FROM documents WHERE doc_id % 2 = 0 GROUP BY 1, 2) SELECT d.doc_id, coalesce(known, 'doc_' || substr(sha256(text), 1, 16)) AS document_id FROM documents d LEFT JOIN k ON k.sha = sha256(d.text) AND k.source = d.source")
def q_upsert_by_hash(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.col("source").alias("session_id"))
    known = rows.where("doc_id % 2 = 0").withColumn("document_id", F.concat(F.lit("known_"), "doc_id"))
    return catalog.upsert_by_hash(known, rows).select("doc_id", "document_id")


@query("SELECT source AS session_id, count(*) AS n_documents, CAST(sum(n_lines) AS BIGINT) AS n_chunks FROM (SELECT source, len(string_split(text, chr(10))) AS n_lines FROM documents WHERE length(source) % 2 = 0) GROUP BY 1")
def q_delete_sessions(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("session_id"))
    chunks = lines(spark, sf).select(F.col("doc_id").alias("document_id"), F.concat_ws(":", "doc_id", "pos").alias("chunk_id"))
    sessions = docs.select("session_id").distinct()
    left, tables = catalog.delete_sessions(sessions, {"documents": docs, "chunks": chunks}, sessions.where("length(session_id) % 2 = 1"))
    n_chunks = tables["chunks"].groupBy("document_id").agg(F.count("*").alias("n"))
    rows = tables["documents"].join(n_chunks, "document_id").groupBy("session_id").agg(F.count("*").alias("n_documents"), F.sum("n").alias("n_chunks"))
    return left.join(rows, "session_id")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 0, -1 FROM orders WHERE o_orderstatus = 'F'")
def q_replace_children(spark, sf):
    old = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), F.col("l_partkey").cast("bigint").alias("l_partkey"))
    new = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.lit(-1).cast("bigint").alias("l_partkey"))
    return catalog.replace_children(old, new, "l_orderkey")


@query("SELECT c_mktsegment AS session_id, o_orderstatus AS status, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2")
def q_status_counts(spark, sf):
    docs = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return catalog.status_counts(docs.select(F.col("c_mktsegment").alias("session_id"), F.col("o_orderstatus").alias("status")))


@query("SELECT o_orderkey AS document_id, CASE WHEN o_orderstatus = 'P' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F') THEN 'failed' WHEN o_orderstatus = 'P' THEN 'processing' ELSE o_orderstatus END AS status FROM orders")
def q_fail_stale(spark, sf):
    docs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "P", "processing").otherwise(F.col("o_orderstatus")).alias("status"))
    return catalog.fail_stale(docs, table(spark, sf, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("document_id")))


@query("WITH e AS (SELECT user_id, event_id, ts, CASE event_id % 4 WHEN 0 THEN 'queued' WHEN 1 THEN 'parsing' WHEN 2 THEN 'completed' ELSE 'failed' END AS status, substr(repeat(props, 20), 1, 500) AS m FROM events) SELECT user_id AS job_id, event_id AS stage, status, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, status IN ('completed', 'failed', 'cancelled') AS is_terminal, md5(m) AS message FROM e")
def q_job_transitions(spark, sf):
    kinds = F.element_at(F.array(*map(F.lit, ("queued", "parsing", "completed", "failed"))), (F.col("event_id") % 4 + 1).cast("int"))
    log = table(spark, sf, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("stage"), kinds.alias("status"), F.repeat("props", 20).alias("progress_message"), F.col("ts").alias("updated_at"))
    return catalog.transitions(log).select("job_id", "stage", "status", "previous", "is_terminal", F.md5("progress_message").alias("message"))


@query("WITH s AS (SELECT DISTINCT c_mktsegment AS session_id, 'old ' || c_mktsegment AS title FROM customer), w AS (SELECT DISTINCT c_mktsegment AS session_id, 'new ' || c_mktsegment AS title FROM customer WHERE length(c_mktsegment) > 8 UNION ALL SELECT r_name, r_name FROM region) SELECT coalesce(w.session_id, s.session_id) AS session_id, coalesce(w.title, s.title) AS title, s.session_id IS NOT NULL AS kept FROM s FULL JOIN w USING (session_id)")
def q_ensure_sessions(spark, sf):
    segments = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("session_id")).distinct()
    long_ago = F.lit("2001-01-01").cast("timestamp")
    old = segments.select("session_id", F.concat(F.lit("old "), "session_id").alias("title"), long_ago.alias("created_at"))
    wanted = segments.where("length(session_id) > 8").select("session_id", F.concat(F.lit("new "), "session_id").alias("title")).unionByName(table(spark, sf, "region").select(F.col("r_name").alias("session_id"), F.col("r_name").alias("title")))
    return catalog.ensure_sessions(old, wanted).select("session_id", "title", (F.col("created_at") == long_ago).alias("kept"))


@query("SELECT o_custkey AS document_id, o_orderkey AS node_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) - 1 AS place FROM orders")
def q_document_nodes(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("depth"), F.col("o_orderkey").alias("position"), F.col("o_orderkey").alias("node_id"))
    return catalog.document_nodes(rows).select("document_id", F.posexplode("node_ids").alias("place", "node_id"))


_REACHED = f"WITH {NODES}, n AS (SELECT * FROM nodes WHERE document_id % 3 <> 0), {ASKED}, {TERMS}, {POSTED.replace('FROM nodes', 'FROM n')}, {FTS.replace('FROM nodes n', 'FROM n')} {TOP.format('scored', 10)}"


@query(_REACHED)
def q_index_maintenance(spark, sf):
    """A stored index after additions, a replacement and a removal finds what a fresh one over the remaining nodes does."""
    found = at_rest(nodes(spark, sf), "nodes")
    root = f"{shared_folder(spark)}/folioforge/index-{uuid.uuid4().hex}"
    store = SearchIndex.open(spark, root).add(found.where("document_id % 2 = 0").withColumn("text", F.upper("text"))).add(found.where("document_id % 2 = 1"))
    store = store.add(found.where("document_id % 2 = 0")).remove(found.where("document_id % 3 = 0").select("document_id"))
    return _rounded(SearchIndex.open(spark, root).bm25(asked(spark, sf), 10))


@query()
def q_lexical(spark, sf):
    found = retrieval.lexical(nodes(spark, sf).drop("session_id"), asked(spark, sf), 20)
    return found.select("query_id", "node_id", "rank", *(F.round(c, 6).alias(c) for c in ("score", "fts", "heading", "phrase", "structural")))


# The three signals of q_lexical; a question of eight words is one phrase, with its two parts of seven.
_WHOLE = PHRASES[: PHRASES.index("qw AS (")] + r"qw AS (SELECT query_id, regexp_extract_all(lower(question), '[\p{L}\p{N}_]+') AS w FROM asked), " + PHRASES[PHRASES.index("pq AS (") :]
ORACLES["q_lexical"] = (
    f"WITH {NODES}, {ASKED}, {TERMS}, {POSTED}, {FTS}, {HEADS}, {_WHOLE}, l0 AS (SELECT * FROM {_ranked('scored', 40)}), l1 AS (SELECT query_id, node_id, 1 - 0.05::DOUBLE * (rank - 1) AS score, rank FROM {_ranked('headed', 20)}), l2 AS (SELECT * FROM {_ranked('phrased', 20)}), "
    "fu AS (SELECT query_id, node_id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT query_id, node_id, rank FROM l0 UNION ALL SELECT query_id, node_id, rank FROM l1 UNION ALL SELECT query_id, node_id, rank FROM l2) GROUP BY 1, 2) "
    f"SELECT f.query_id, f.node_id, f.rank, round(f.score, 6) AS score, round(coalesce(l0.score, 0), 6) AS fts, round(coalesce(l1.score, 0), 6) AS heading, round(coalesce(l2.score, 0), 6) AS phrase, CASE WHEN coalesce(n.title, '') <> '' THEN 1.0 ELSE 0.2 END::DOUBLE AS structural FROM (SELECT * FROM {_ranked('fu', 20)}) f LEFT JOIN l0 USING (query_id, node_id) LEFT JOIN l1 USING (query_id, node_id) LEFT JOIN l2 USING (query_id, node_id) JOIN nodes n ON n.node_id = f.node_id"
)


@query(filled("WITH RECURSIVE src AS (SELECT doc_id AS k1, 0 AS k2, text FROM documents), @parts SELECT k1 AS doc_id, part, len(@words(body)) AS n_words, md5(body) AS digest FROM parts"))
def q_para_split_sql(spark, sf):
    """q_para_split through the table function, in SQL."""
    registered.register(spark)
    table(spark, sf, "documents").createOrReplaceTempView("folioforge_documents")
    parts = spark.sql("SELECT doc_id, p.part, p.body FROM folioforge_documents, LATERAL split_paragraphs(text) p")
    return parts.select("doc_id", "part", T.word_count(F.col("body")).alias("n_words"), F.md5("body").alias("digest"))


@query(f"WITH {ASKED}, n AS (SELECT count(*) AS n FROM benchmark), d AS (SELECT term, count(DISTINCT item_id) AS df FROM (SELECT item_id, unnest(regexp_extract_all({FOLD.format('text')}, '[\\p{{L}}\\p{{N}}]+')) AS term FROM benchmark) GROUP BY 1) SELECT term, df, round(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END, 9) AS idf FROM d, n")
def q_idf_sql(spark, sf):
    """Terms of the questions' texts with their weights, by the SQL function."""
    registered.register(spark)
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("node_id"), F.lit(None).cast("string").alias("title"), "text")
    index.term_stats(index.postings(items)).createOrReplaceTempView("folioforge_terms")
    return spark.sql(f"SELECT term, df, round(bm25_idf({items.count()}, df), 9) AS idf FROM folioforge_terms")


@query(RANKED.replace("@score", "0.5 * overlap + 0.2 * heading + CASE WHEN title IS NOT NULL THEN 0.15 ELSE 0.0 END + 0.1 * page + 0.05 * density"))
def q_rank_outside_tree(spark, sf):
    """Candidates of which some come from the tree and others from a full scan."""
    return _ranks(retrieval.rank_nodes(_candidates(spark, sf).withColumn("in_tree", F.col("title").isNotNull())))


@query(r"SELECT doc_id AS node_id, substr(array_to_string(list_slice(list_filter(list_transform(string_split(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: trim(x)), lambda x: x <> ''), 1, 2), ' '), 1, 300) AS summary FROM documents WHERE trim(text) <> ''")
def q_summaries(spark, sf):
    return structure.summaries(table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), F.lit(None).cast("string").alias("title"), "text"))


_SPACED = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}]+(?:[''’.\-][\p{{L}}\p{{N}}]+)*|&')"


@query(
    f"WITH RECURSIVE w AS (SELECT doc_id, {_SPACED.format('text')} AS w FROM documents), b AS (SELECT item_id, {_SPACED.format('text')} AS w FROM benchmark), "
    "names AS (SELECT m, lower(array_to_string(list_slice(w, 1, m), ' ')) AS key, min(array_to_string(list_slice(w, 1, m), ' ')) AS name FROM b, (SELECT unnest([2, 3, 5]) AS m) WHERE len(w) >= m GROUP BY 1, 2), "
    "runs AS (SELECT doc_id, m, i - 1 AS spot, lower(array_to_string(list_slice(w, i, i + m - 1), ' ')) AS key FROM (SELECT doc_id, w, m, unnest(generate_series(1, CAST(len(w) - m + 1 AS BIGINT))) AS i FROM w, (SELECT unnest([2, 3, 5]) AS m) WHERE len(w) >= m)), "
    "met AS (SELECT doc_id, spot, max(m) AS m, max_by(name, m) AS name FROM runs JOIN names USING (m, key) GROUP BY 1, 2), "
    "walk AS (SELECT doc_id, min(spot) AS spot FROM met GROUP BY 1 UNION ALL SELECT doc_id, spot FROM (SELECT c.doc_id, n.spot, row_number() OVER (PARTITION BY c.doc_id ORDER BY n.spot) AS no FROM walk JOIN met c USING (doc_id, spot) JOIN met n ON n.doc_id = c.doc_id AND n.spot >= c.spot + c.m) WHERE no = 1) "
    "SELECT doc_id, 'item' AS kind, name, CAST(spot AS INTEGER) AS \"at\" FROM walk JOIN met USING (doc_id, spot)"
)
def q_known_names(spark, sf):
    """Names (the first two, three and five words of the benchmark's items) in all documents."""
    w = entities._spaced(F.col("text"))
    names = table(spark, sf, "benchmark").select(F.explode(F.transform(F.array(*map(F.lit, (2, 3, 5))), lambda m: F.when(F.size(w) >= m, F.array_join(F.slice(w, F.lit(1), m), " ")))).alias("name")).where("name is not null")
    found = entities.find_names(table(spark, sf, "documents").select(F.col("doc_id").alias("node_id"), "text"), names.withColumn("kind", F.lit("item")))
    return found.select(F.col("node_id").alias("doc_id"), "kind", "name", "at")


@query()
def q_phone_numbers(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.posexplode(phones.numbers(F.col("text"))).alias("no", "number"))
    return rows.select("doc_id", "no", "number")


#: Each question in two sessions: the sources of its id's and the next one's place among all sources.
_SESSIONS = "src AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS no, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL))"


@query()
def q_lexical_sessions(spark, sf):
    """Questions asked in two sessions each see the best nodes of these, whatever the others hold."""
    n = nodes(spark, sf)
    sources = sorted(r.source for r in table(spark, sf, "documents").select("source").where("source is not null").distinct().collect())
    every = F.array(*map(F.lit, sources))
    places = F.explode(F.transform(F.array(F.lit(0), F.lit(1)), lambda i: F.element_at(every, ((F.col("query_id") + i) % len(sources) + 1).cast("int"))))
    q = asked(spark, sf).select("question", "query_id", places.alias("session_id")).withColumn("query_id", F.concat_ws("@", "query_id", "session_id"))
    found = retrieval.lexical(n, q, 10)
    return found.select("query_id", "node_id", "rank", *(F.round(c, 6).alias(c) for c in ("score", "fts", "heading", "phrase")))


ORACLES["q_lexical_sessions"] = (
    ORACLES["q_lexical"]
    .replace(ASKED, ASKED.replace("asked AS", "asked0 AS") + f", {_SESSIONS}, asked AS (SELECT a.query_id || '@' || s.source AS query_id, a.question, s.source AS session_id FROM asked0 a, src s WHERE s.no = a.query_id % s.n OR s.no = (a.query_id + 1) % s.n)")
    .replace("l0 AS (", "own AS (SELECT query_id, node_id FROM asked JOIN nodes USING (session_id)), l0 AS (")
    .replace(_ranked("scored", 40), _ranked("(SELECT * FROM scored SEMI JOIN own USING (query_id, node_id))", 20))
    .replace(_ranked("headed", 20), _ranked("(SELECT * FROM headed SEMI JOIN own USING (query_id, node_id))", 10))
    .replace(_ranked("phrased", 20), _ranked("(SELECT * FROM phrased SEMI JOIN own USING (query_id, node_id))", 10))
    .replace(_ranked("fu", 20), _ranked("fu", 10))
    .replace(", CASE WHEN coalesce(n.title, '') <> '' THEN 1.0 ELSE 0.2 END::DOUBLE AS structural", "")
)


@query(f"WITH {LINES} SELECT doc_id, pos, regexp_matches(trim(line), '{C.OUTLINE_HEADING.replace(chr(39), chr(39) * 2)}') AND NOT regexp_matches(trim(line), '{C.OUTLINE_END}') AND length(trim(line)) <= {C.OUTLINE_CHARS} AND len({WORDS.format('line')}) BETWEEN 1 AND {C.OUTLINE_WORDS} AS heading FROM lines")
def q_outline_heading(spark, sf):
    return lines(spark, sf).select("doc_id", "pos", T.looks_like_heading(F.col("line")).alias("heading"))


@query(f"SELECT doc_id, array_to_string(list_slice({WORDS.format('text')}, 1, 200), ' ') || CASE WHEN len({WORDS.format('text')}) > 200 THEN '…' ELSE '' END AS block FROM documents")
def q_truncate_block(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.truncate_block(F.col("text")).alias("block"))


@query("SELECT conv_id, turn, contains(lower(text), 'everything about') OR contains(lower(text), 'tell me') OR contains(lower(text), 'explain') AS topic FROM conversations")
def q_topic_flag(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.is_topic(F.col("text")).alias("topic"))


@query(f"WITH {LINES}, s AS (SELECT doc_id, regexp_replace(regexp_replace(lower(line), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, substr(regexp_replace(regexp_replace(lower(md5(line)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 8) AS own FROM lines WHERE pos = 0) SELECT doc_id, CASE WHEN slug = '' THEN 'concept' ELSE slug END || '-' || own AS slug FROM s")
def q_document_slug(spark, sf):
    return lines(spark, sf).where("pos = 0").select("doc_id", T.document_slug(F.col("line"), F.concat(F.lit("doc_"), F.md5("line"))).alias("slug"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '\\[S\\d+\\]') THEN text ELSE rtrim(text) || ' [S1]' END AS marked, regexp_replace(text || ' [S7]', '\\[S\\d+\\]', '[S1]', 'g') AS renumbered FROM (SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN ' [S2]' ELSE '' END AS text FROM documents)")
def q_source_marks(spark, sf):
    t = F.concat("text", F.when(F.col("doc_id") % 2 == 0, F.lit(" [S2]")).otherwise(F.lit("")))
    return table(spark, sf, "documents").select("doc_id", T.with_source_mark(t).alias("marked"), T.renumbered(F.concat(t, F.lit(" [S7]"))).alias("renumbered"))


@query(f"WITH {LINES}, a AS (SELECT doc_id AS query_id, {ASCII.format('line')} || CASE doc_id % 3 WHEN 0 THEN ' [S1]' WHEN 1 THEN ' [S2]' ELSE '' END AS answer, doc_id FROM lines WHERE pos = 0), c AS (SELECT doc_id AS query_id, 'S' || (pos + 1) AS source_id, substr({ASCII.format('line')}, 1, 300) AS excerpt FROM lines WHERE line <> ''), u AS (SELECT a.query_id, regexp_replace(answer, '\\[S\\d+\\]', '', 'g') AS a, answer, coalesce(excerpt, '') AS e, excerpt IS NOT NULL AS has FROM a LEFT JOIN c ON c.query_id = a.query_id AND contains(answer, '[' || source_id || ']')) SELECT query_id, trim(answer) <> '' AND has AND (len({_cw('a')}) = 0 OR CAST(len(list_intersect({_cw('a')}, {_cw('e')})) AS DOUBLE) / greatest(len({_cw('a')}), 1) >= 0.35) AND {_within(C.NUMBER, False).replace('regexp_extract_all(a,', 'regexp_extract_all(answer,')} AND {_within(C.DATE, True).replace('regexp_extract_all(a,', 'regexp_extract_all(answer,')} AND {_within(C.PROPER_NAME, True)} AND {_DIR} AS valid FROM u")
def q_validate_answers(spark, sf):
    plain = F.regexp_replace("line", r"[^\x00-\x7F]", "_")
    mark = F.when(F.col("doc_id") % 3 == 0, " [S1]").when(F.col("doc_id") % 3 == 1, " [S2]").otherwise("")
    answers = lines(spark, sf).where("pos = 0").select(F.col("doc_id").alias("query_id"), F.concat(plain, mark).alias("answer"))
    cited = lines(spark, sf).where("line <> ''").select(F.col("doc_id").alias("query_id"), F.concat(F.lit("S"), F.col("pos") + 1).alias("source_id"), T.excerpt(plain).alias("excerpt"))
    return answer.validate(answers, cited)


@query("SELECT o_custkey AS query_id, max(greatest(o_totalprice, o_orderkey * 10.0, 0)) AS best FROM orders GROUP BY 1")
def q_best_scores(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_totalprice").alias("score"), (F.col("o_orderkey") * 10.0).alias("keyword_coverage"), F.lit(None).cast("double").alias("confidence"))
    return retrieval.best_scores(rows)


@query("WITH s AS (SELECT q.r_regionkey AS query_id, n_nationkey FROM region q JOIN nation ON n_regionkey = q.r_regionkey), c AS (SELECT query_id, c_custkey FROM s JOIN customer ON c_nationkey = n_nationkey WHERE c_custkey % 2 = 0), e AS (SELECT query_id, 'k' || c_custkey AS node_id, n_nationkey AS doc, c_custkey AS pos FROM c JOIN customer USING (c_custkey) JOIN nation ON n_nationkey = c_nationkey), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY doc, pos, node_id) AS place FROM e) SELECT query_id, node_id, place FROM o WHERE place <= 12")
def q_tree_route(spark, sf):
    """Nations are documents with a root, whose sections are customers; a chooser follows every second one."""
    region = F.col("n_regionkey").cast("string").alias("session_id")
    nation = table(spark, sf, "nation").select("n_nationkey", region)
    roots = nation.select("session_id", F.col("n_nationkey").alias("document_id"), F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("bigint").alias("position"))
    leaves = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("session_id", F.col("n_nationkey").alias("document_id"), F.concat(F.lit("k"), "c_custkey").alias("node_id"), F.concat(F.lit("n"), "n_nationkey").alias("parent_id"), F.col("c_custkey").alias("position"))
    tree = roots.unionByName(leaves).withColumns({"page_start": F.lit(1), "depth": F.lit(1)})
    queries = table(spark, sf, "region").select(F.col("r_regionkey").alias("query_id"), F.lit("which").alias("question"), F.col("r_regionkey").cast("string").alias("session_id"))
    return structure.route(tree, queries, lambda level: level.where("position % 2 = 0"))
