"""Structure, trees, catalog, search, answers, concepts and the engine on small cases."""

import math
import sqlite3

import pytest
from pyspark.sql import functions as F

from folioforge.operators import answer, catalog, concepts, index, retrieval, structure
from folioforge.plans.engine import Engine, Settings
from folioforge import schemas


def blocks(spark, texts, page=1):
    rows = [("d", i, page if isinstance(page, int) else page[i], t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "document_id string, block_pos int, page_number int, text string")


def test_heading_tree(spark):
    b = blocks(spark, ["1 Intro", "Body one.", "1.1 Scope", "Body two.", "2 End", "Body three."])
    tree = {r.title or r.text: r for r in structure.build_tree(structure.detect_headings(b)).collect()}
    assert [tree[t].depth for t in ("1 Intro", "1.1 Scope", "2 End")] == [1, 2, 1]
    assert tree["Body two."].parent_id == tree["1.1 Scope"].node_id and tree["Body two."].heading_path == ["1 Intro", "1.1 Scope"]
    assert tree["1.1 Scope"].parent_id == tree["1 Intro"].node_id and tree["1.1 Scope"].position == 1
    assert tree["Body three."].depth == 2 and tree["2 End"].position == 1


def test_page_groups(spark):
    b = blocks(spark, [f"words of page {i}." for i in range(6)], page=[1, 2, 3, 4, 5, 6])
    tree = structure.build_tree(structure.detect_headings(b)).collect()
    assert sorted((r.page_start, r.page_end) for r in tree if r.node_type == "section") == [(1, 5), (6, 6)]
    assert len({r.node_id for r in tree}) == len(tree) == 9


def test_split_long(spark):
    text = " ".join(f"w{i}." if i % 50 == 49 else f"w{i}" for i in range(700))
    parts = spark.createDataFrame([(text,)], "t string").select(structure.split_long(F.col("t")).alias("p")).first().p
    assert " ".join(parts) == text and [len(p.split()) for p in parts] == [200, 200, 200, 100]
    long = " ".join(f"x{i}" for i in range(950))
    parts = spark.createDataFrame([(long,)], "t string").select(structure.split_long(F.col("t")).alias("p")).first().p
    assert " ".join(parts) == long and max(len(p.split()) for p in parts) == 200


def test_chunks(spark):
    paras = [" ".join([f"p{k}"] * n) for k, n in enumerate((200, 100, 100, 300))]
    pages = spark.createDataFrame([("d", 1, "\n\n".join(paras))], "document_id string, page_number int, text string")
    assert [r.n_words for r in structure.chunk_pages(pages).orderBy("sequence").collect()] == [300, 400]
    assert [r.n_words for r in structure.chunk_pages(pages, mode="greedy").orderBy("sequence").collect()] == [300, 100, 300]


def test_repeated_lines(spark):
    rows = [("d", p, i, t) for p in range(1, 5) for i, t in enumerate(["Head", f"body {p}", f"more {p}", f"end {p}", "Foot"])]
    lines = spark.createDataFrame(rows, "document_id string, page_number int, line_no int, line string")
    assert {r.line for r in structure.remove_repeated_lines(lines).collect()} == {f"{k} {p}" for k in ("body", "more", "end") for p in range(1, 5)}


def test_expand(spark):
    rows = [("r", "d", None, "document", 0), ("a", "d", "r", "chapter", 0), ("b", "d", "r", "chapter", 1), ("a1", "d", "a", "paragraph", 0), ("a2", "d", "a", "paragraph", 1), ("a1x", "d", "a1", "paragraph", 0)]
    nodes = spark.createDataFrame(rows, "node_id string, document_id string, parent_id string, node_type string, position int")
    hits = spark.createDataFrame([(1, "a", 1), (1, "a2", 2)], "query_id int, node_id string, rank int")
    got = [r.node_id for r in structure.expand(nodes, hits).orderBy("place").collect()]
    assert got == ["a", "b", "a1", "a1x", "a2"]


def test_span_blocks(spark):
    span = "struct<text:string,size:double,font:string,flags:int>"
    df = spark.createDataFrame([("d", [(10.0, [("He", 12.0, "Arial", 0), ("llo", 14.0, "Arial-Bold", 0)]), (25.0, [("x", 9.0, "A", 16)])], [5.0, 1.0, 2.0, 3.0])], f"document_id string, lines array<struct<y:double,spans:array<{span}>>>, bbox array<double>")
    r = structure.span_blocks(df).first()
    assert (r.text, r.font_size, r.font_name, r.is_bold, r.indent, r.line_spacing) == ("Hellox", 14.0, "Arial", True, 5.0, 15.0)


def test_upsert_and_deletes(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 10)], "id int, v string, created_at int")
    new = spark.createDataFrame([(2, "c", 20, 1), (2, "d", 20, 2), (3, "e", 20, 1)], "id int, v string, created_at int, ver int")
    assert sorted(map(tuple, catalog.upsert(old, new, ["id"], version="ver").collect())) == [(1, "a", 10), (2, "d", 10), (3, "e", 20)]
    docs = spark.createDataFrame([("d1", "s", "processing"), ("d2", "s", "processing")], "document_id string, session_id string, status string")
    chunks = spark.createDataFrame([("d2", "c1")], "document_id string, chunk_id string")
    assert {r.document_id: r.status for r in catalog.fail_stale(docs, chunks).collect()} == {"d1": "failed", "d2": "processing"}
    left, gone = catalog.delete_documents({"documents": docs, "chunks": chunks}, docs.where("document_id = 'd2'"))
    assert [r.chunk_id for r in gone.collect()] == ["c1"] and left["chunks"].count() == 0 and left["documents"].count() == 1


def nodes_of(spark, texts):
    return spark.createDataFrame([(f"n{i}", t, x) for i, (t, x) in enumerate(texts)], "node_id string, title string, text string")


def test_bm25_is_fts5(spark):
    texts = [("Leave policy", "Employees earn annual leave of twenty days."), (None, "Leave may be carried forward; leave is paid."), ("Other", "Nothing about it."), (None, ""), ("Café rules", "Open-source café annual leave leave")]
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(text, title)")
    con.executemany("insert into f(rowid, text, title) values (?, ?, ?)", [(i, x, t or "") for i, (t, x) in enumerate(texts)])
    q = "annual leave open-source cafe leave"
    expected = dict(con.execute("select 'n' || rowid, -rank from f where f match ?", ['"annual" OR "leave" OR "open-source" OR "cafe" OR "leave"']).fetchall())
    got = index.bm25(nodes_of(spark, texts), spark.createDataFrame([(1, q)], "query_id int, question string"), 10).collect()
    assert {r.node_id for r in got} == set(expected)
    assert all(math.isclose(r.score, expected[r.node_id], rel_tol=1e-9) for r in got)


def test_searches(spark):
    n = nodes_of(spark, [("Annual Leave", "Twenty days."), ("Annual", "x"), ("Sick leave rules", "y"), (None, "annual leave here.")])
    q = spark.createDataFrame([(1, "annual leave")], "query_id int, question string")
    heads = {r.node_id: r.score for r in index.heading_search(n, q, 10).collect()}
    assert heads["n0"] == 1.0 and heads["n1"] == 0.8 and math.isclose(heads["n2"], 0.25)
    assert {r.node_id for r in index.phrase_search(n, q, 10).collect()} == {"n0", "n3"}
    assert {r.node_id for r in index.like_search(n, q, 10).collect()} == {"n3"}
    fused = retrieval.fuse(index.heading_search(n, q, 10), index.phrase_search(n, q, 10), k=5).orderBy("rank").collect()
    assert fused[0].node_id == "n0" and math.isclose(fused[0].score, 2 / 61)


def test_lexical_scopes_sessions(spark):
    n = nodes_of(spark, [("A", "annual leave here"), ("B", "annual leave there")]).withColumn("session_id", F.when(F.col("node_id") == "n0", "s1").otherwise("s2"))
    q = spark.createDataFrame([(1, "annual leave", "s2")], "query_id int, question string, session_id string")
    for scope in ("pre", "post"):
        assert [r.node_id for r in retrieval.lexical(n, q, 5, scope=scope).collect()] == ["n1"]


def test_ranking(spark):
    rows = [(1, "annual leave", "a", "Annual leave", "annual leave " * 10, 1, True), (1, "annual leave", "b", None, "other text", 200, False)]
    c = spark.createDataFrame(rows, "query_id int, question string, node_id string, title string, text string, page_start int, in_tree boolean")
    got = retrieval.rank_nodes(c).orderBy("rank").collect()
    page = 1 - math.log(2) / math.log(502)
    assert got[0].node_id == "a" and math.isclose(got[0].score, round(0.5 + 0.2 + 0.15 + 0.1 * page + 0.025, 4), abs_tol=1e-4)


@pytest.mark.parametrize(("claim", "source", "valid"), [
    ("Leave is 20 days [S1].", "Annual leave is 20 days a year.", True),
    ("Leave is 25 days [S1].", "Annual leave is 20 days a year.", False),
    ("Sales increased strongly [S1].", "Sales decreased strongly last year.", False),
    ("John Smith leads sales [S1].", "Sales are led by Mary Jones.", False),
    ("Leave is 20 days [S2].", "Annual leave is 20 days a year.", False),
    ("Leave is 20 days.", "Annual leave is 20 days a year.", False),
])
def test_validator(spark, claim, source, valid):
    a = spark.createDataFrame([(1, claim)], "query_id int, answer string")
    c = spark.createDataFrame([(1, "S1", source)], "query_id int, source_id string, excerpt string")
    assert answer.validate(a, c).first().valid is valid


def test_extractive(spark):
    rows = [(1, "what is her email", 1, "n1", None, "Reach Ada at ada@x.org today."), (2, "which days are paid leave days", 1, "n2", None, "Staff get coffee. Paid leave days are the first twenty days."), (3, "zzz qqq", 1, "n3", None, "Nothing in common whatsoever here today.")]
    e = spark.createDataFrame(rows, "query_id int, question string, rank int, node_id string, title string, text string")
    got = {r.query_id: r for r in answer.extractive(e.select("query_id", "question"), e).collect()}
    assert got[1].answer == "ada@x.org [S1]" and got[2].answer == "Paid leave days are the first twenty days. [S1]"
    assert not got[3].answerable and got[3].strategy == "INSUFFICIENT"


def test_concepts(spark):
    c = spark.createDataFrame([("d", "c1", 1, "Neural network training. Neural network depth."), ("d", "c2", 1, "Neural network training again.")], "document_id string, chunk_id string, page_number int, text string")
    found = concepts.phrases(c)
    top = [r.phrase for r in concepts.top_concepts(concepts.scores(c), 3, first=2).orderBy("place").collect()]
    assert top[0] == "neural network" and not any(set(a.split()) <= set(b.split()) for a in top for b in top if a != b)
    mined = concepts.mine(c, 3)
    assert mined.count() == len(top)
    files = concepts.render_concepts(mined, c).collect()
    parsed = concepts.bundle_files(spark.createDataFrame([(f.path, f.value) for f in files], "path string, value string"))
    assert concepts.validate_bundle(parsed).where("severity = 'error'").count() == 0
    assert {r.concept_id for r in concepts.concepts_of_bundle(parsed).collect()} == {r.concept_id for r in mined.collect()}


def test_bundle_rules(spark):
    files = [("a.md", "---\ntype: concept\ntitle: A\ntags: x\n---\nSee [b](b.md) and [c](gone.md).\n"), ("b.md", "---\ntitle: B\n---\n"), ("index.md", "x")]
    issues = {(r.path, r.message) for r in concepts.validate_bundle(concepts.bundle_files(spark.createDataFrame(files, "path string, value string"))).collect()}
    assert issues == {("a.md", "Concept files must include id."), ("a.md", "tags must be a list."), ("a.md", "Link target not found: gone.md."), ("b.md", "Missing required field: type."), ("b.md", "File body is empty.")}


def test_yaml():
    block = 'title: "A: b"\nflag: true\ntags: [x, y]\nalias:\n  - p\n  - q\nsource_chunks:\n  - chunk_id: c1\n    page: 2\n'
    assert concepts.parse_yaml(block) == {"title": "A: b", "flag": True, "tags": ["x", "y"], "alias": ["p", "q"], "source_chunks": [{"chunk_id": "c1", "page": "2"}]}


def test_engine(spark, tmp_path):
    files = spark.createDataFrame([("s", "a.txt", bytearray(b"1 Leave\n\nStaff earn twenty days of annual leave each year.\n\n2 Pay\n\nSalaries are paid monthly to all staff.")), ("s", "b.txt", bytearray(b""))], "session_id string, filename string, content binary")
    files = catalog.register(files).withColumn("path", F.col("filename"))
    empty = lambda schema: spark.createDataFrame([], schema)
    chunks = "document_id string, page_number int, sequence int, text string, n_words bigint, chunk_id string"
    engine = Engine(empty(schemas.DOCUMENTS), empty(schemas.NODES), empty(chunks), settings=Settings(final_k=4))
    read = lambda f: structure.plain_blocks(f.select("document_id", F.col("content").cast("string").alias("text")))
    engine = engine.ingest(files, read).save(str(tmp_path / "a"))
    assert {r.filename: r.status for r in engine.documents.collect()} == {"a.txt": "ready", "b.txt": "failed"}
    assert catalog.unseen(files, engine.documents).count() == 1
    q = spark.createDataFrame([(1, "how many days of annual leave do staff earn", "s"), (2, "summary of pay", "s"), (3, "leave versus pay", "s")], "query_id int, question string, session_id string")
    got = {r.query_id: r for r in engine.ask(q).collect()}
    assert "twenty days of annual leave" in got[1].answer and got[1].file_name == "a.txt"
    routed = engine.retrieve_routed(q).collect()
    assert {r.query_id for r in routed} == {1, 2, 3} and {r.query_type for r in routed} == {"summary", "comparison", "direct_factual"}
    assert engine.mine_concepts().concepts.count() > 0
    assert engine.delete(engine.documents.select("document_id")).nodes.count() == 0


def test_sentences_keep_their_digits(spark):
    """Phrases, scores, parts and summaries of sentences that begin or end with their own number."""
    text = "0997 and 4928819459423830. 19.37.233.111"
    docs = spark.createDataFrame([(1, "d", text)], "node_id int, title string, text string")
    assert structure.summaries(docs).first().summary == text
    chunks = spark.createDataFrame([("d", "c", "0997 and 4928819459423830")], "document_id string, chunk_id string, text string")
    assert {r.phrase for r in concepts.phrases(chunks).collect()} == {"0997", "4928819459423830"}
    assert {(r.phrase, r.hits, r.n_sentences) for r in concepts.scores(chunks).collect()} == {("0997", 1, 1), ("4928819459423830", 1, 1)}
    long = " ".join(f"0{n}" for n in range(300)) + ". " + " ".join(f"1{n}" for n in range(300)) + "1"
    parts = docs.select(F.explode(structure.split_long(F.lit(long))).alias("p")).collect()
    assert " ".join(r.p for r in parts) == long


def test_like_search_looks_in_distinct_pieces(spark):
    texts = ["Alpha beta-gamma\tdelta", "xalphax  y", "", None, "BETA", "a b", "gam ma", "beta alpha alpha"]
    nodes = spark.createDataFrame([(f"n{i}", t) for i, t in enumerate(texts)], "node_id string, text string")
    asked = ["alpha", "ta-g", "a gamma", "beta BETA nothing"]
    queries = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "query_id int, question string")
    found = index.like_search(nodes, queries, 10)
    want = {(i, f"n{j}") for i, q in enumerate(asked) for j, t in enumerate(texts) for w in q.lower().split() if len(w) > 1 and w in (t or "").lower()}
    assert {(r.query_id, r.node_id) for r in found.collect()} == want
    lines = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(lines) if "Contains(" in line)
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    below = [line for line in lines[at + 1 :] if len(line) - len(line.lstrip(" :+-")) > depth]
    assert any("Aggregate [piece" in line for line in below)  # terms meet each piece once, however many nodes hold it
