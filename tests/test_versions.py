"""Versions of tables, segments that are merged, sessions in searches, and the command line's concepts."""

import json
import os

import pytest
from pyspark.sql import functions as F

from folioforge import cli, schemas
from folioforge.errors import ConflictError, DuplicateDocumentError, EmptyDocumentError, ParseError
from folioforge.operators import catalog, index, index_store, retrieval, structure
from folioforge.operators.index_store import SearchIndex
from folioforge.plans.engine import Engine
from folioforge.plans.versions import Versions


def test_versions(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"))
    assert versions.latest() == (0, None)
    assert versions.commit({"x": ["a/1"]}, 0) == 1
    with pytest.raises(ConflictError):
        versions.commit({"x": ["a/2"]}, 0)
    assert versions.latest() == (1, {"x": ["a/1"]})
    # A commit that was cut off doesn't count, and its number isn't used again.
    (tmp_path / "v" / "versions" / "000000002.json").write_text('{"x": [')
    assert versions.latest()[0] == 1 and versions.commit({"x": ["a/3"]}, 1) == 3
    for name in ("1", "3", "4"):
        (tmp_path / "v" / "a" / name).mkdir(parents=True)
    versions.commit({"x": ["a/4"]}, 3)
    assert versions.forget(("a",), lambda s: s["x"], keep=2) == ["a/1"]
    assert sorted(os.listdir(tmp_path / "v" / "a")) == ["3", "4"] and versions.latest()[1] == {"x": ["a/4"]}


def nodes_of(spark, rows):
    return spark.createDataFrame(rows, "node_id string, document_id string, title string, text string")


def test_segments_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_store, "SMALL", 2)
    monkeypatch.setattr(index_store, "MERGE", 2)
    root, rows = str(tmp_path / "index"), []
    store = SearchIndex.open(spark, root)
    for i in range(8):
        # Every other call replaces a document of an earlier one.
        new = [(f"n{i}.{j}", f"d{i}", f"Title {i}", f"annual leave number {i} of staff {j}") for j in range(2)]
        new += [(f"m{i}", f"d{i - 2}", None, f"changed in {i}")] if i % 2 and i > 2 else []
        store = store.add(nodes_of(spark, new))
        rows = [r for r in rows if r[1] not in {n[1] for n in new}] + new
    store = store.remove(spark.createDataFrame([("d7",)], "document_id string"))
    left = nodes_of(spark, [r for r in rows if r[1] != "d7"])
    again = SearchIndex.open(spark, root)
    again.check(left)
    q = spark.createDataFrame([(1, "annual leave of staff"), (2, "title 4"), (3, "changed in 5")], "query_id int, question string")
    hits = lambda df: sorted((r.query_id, r.node_id, round(r.score, 9)) for r in df.collect())
    assert hits(again.bm25(q, 20)) == hits(index.bm25(left, q, 20)) and hits(again.headings(q, 20)) == hits(index.heading_search(left, q, 20))
    # Eight additions of two nodes and more: fewer segments of each size than are merged, and old folders are gone.
    assert len(again.segments) <= 4 and len(again.tombstones) <= 2
    kept = {s.name for _, state in [Versions(spark, root).latest()] for s in again.segments}
    assert kept <= set(os.listdir(f"{root}/segment")) and len(os.listdir(f"{root}/segment")) <= 8


def test_session_is_not_crowded_out(spark):
    rows = [("z1", "s1", "d0", "Leave", "earned leave once")] + [(f"a{i:03}", "s2", "d1", "Earned leave", "earned leave earned leave") for i in range(200)]
    nodes = spark.createDataFrame(rows, "node_id string, session_id string, document_id string, title string, text string")
    q = spark.createDataFrame([(1, "earned leave", "s1"), (2, "earned leave", "s2"), (3, "earned leave", "s3"), (4, "earned leave", None)], "query_id int, question string, session_id string")
    found = retrieval.lexical(nodes, q, 40).collect()
    assert [r.node_id for r in found if r.query_id == 1] == ["z1"] and sum(r.query_id == 2 for r in found) == 40 and {r.query_id for r in found} == {1, 2}
    assert {r.query_id for r in retrieval.lexical(nodes, q, 40, scope="post").collect()} == {2}
    whole = index.bm25(nodes.drop("session_id"), q, 500).where("query_id = 1")
    assert {(r.query_id, r.node_id, r.score) for r in index.bm25(nodes, q, 40).collect() if r.query_id == 1} == {(r.query_id, r.node_id, r.score) for r in whole.collect() if r.node_id == "z1"}


def test_bm25_reads_nodes_once(spark, sf):
    from folioforge import queries

    df = queries.QUERIES["q_bm25_fts"](spark, sf)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("documents.parquet") == 1 and "ReusedExchange" in final


def test_heading_candidates_are_few(spark):
    titles = [(f"n{i}", f"report part{i} about topic{i} of year{i}") for i in range(300)]
    heads = index.headings(spark.createDataFrame([(*t, "") for t in titles], "node_id string, title string, text string"))
    asked = spark.createDataFrame([(i, f"report part{i} about stuff of plan{i} here") for i in range(100)], "query_id int, q string").withColumn("q_toks", F.split("q", " "))
    pairs = index.heading_candidates(heads, asked, 0.15).select("query_id", "node_id").distinct().count()
    # "report", "about" and "of" are in every title; alone they reach 3 / 9, so those pairs are results. With a higher bound only the own part counts.
    assert pairs == 100 * 300
    few = index.heading_candidates(heads, asked, 0.35).select("query_id", "node_id").distinct().count()
    assert few <= 200


def test_save_is_one_version(spark, tmp_path, monkeypatch):
    files = catalog.register(spark.createDataFrame([("s", "a.txt", bytearray(b"1 Leave\n\nStaff earn twenty days."))], "session_id string, filename string, content binary")).withColumn("path", F.col("filename"))
    read = lambda f: structure.plain_blocks(f.select("document_id", F.col("content").cast("string").alias("text")))
    home = str(tmp_path / "home")
    one = Engine.open(spark, home).ingest(files, read).save(home)
    again = Engine.open(spark, home)
    assert one.version == again.version == 1 and again.nodes.count() == one.nodes.count() > 0
    # A writer that fails between two tables leaves the version before.
    broken = again.delete(again.documents.select("document_id"))
    lost = again.chunks.withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        Engine(broken.documents, broken.nodes, lost, version=again.version).save(home)
    assert Engine.open(spark, home).nodes.count() == one.nodes.count()
    # Of two writers from one version the second fails.
    other = Engine.open(spark, home)
    saved = again.delete(again.documents.select("document_id")).save(home)
    assert saved.nodes.count() == 0 and saved.version > 1
    with pytest.raises(ConflictError):
        other.save(home)
    assert Engine.open(spark, home).nodes.count() == 0


def test_strict_ingest(spark):
    file = lambda name, content: catalog.register(spark.createDataFrame([("s", name, bytearray(content))], "session_id string, filename string, content binary")).withColumn("path", F.col("filename"))
    read = lambda f: structure.plain_blocks(f.select("document_id", F.col("content").cast("string").alias("text")))
    empty = Engine.open(spark, "/nowhere/at/all")
    for name, content, error in (("a.txt", b"", EmptyDocumentError), ("b.txt", b" \n \n", ParseError)):
        with pytest.raises(error, match=name):
            empty.ingest(file(name, content), read, strict=True)
    engine = empty.ingest(file("c.txt", b"Some text."), read, strict=True)
    with pytest.raises(DuplicateDocumentError, match="c.txt"):
        engine.ingest(file("c.txt", b"Some text."), read, strict=True)
    assert engine.ingest(file("c.txt", b"Some text."), read, force=True, strict=True).documents.count() == 1


def test_imported_concepts_are_kept_and_found(spark, tmp_path, capsys):
    home, told = str(tmp_path / "home"), {}
    for name, title in (("one", "Annual leave"), ("two", "Monthly pay")):
        folder = tmp_path / name
        folder.mkdir()
        (folder / f"{name}.md").write_text(f"---\ntype: concept\nid: {name}\ntitle: {title}\n---\n\nText of {title}.\n")
        for _ in range(2):
            assert cli.main(["--home", home, "import", str(folder)]) == 0
        told[name] = title
    capsys.readouterr()
    held = Engine.open(spark, home).concepts.collect()
    assert {r.concept_id: r.title for r in held} == told and len(held) == 2
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("1 Leave\n\nStaff earn twenty days of annual leave.")
    assert cli.main(["--home", home, "ingest", str(tmp_path / "docs")]) == 0
    chunk = Engine.open(spark, home).chunks.first().chunk_id
    (tmp_path / "one" / "one.md").write_text(f"---\ntype: concept\nid: one\ntitle: Annual leave\nsource_chunks:\n  - chunk_id: {chunk}\n---\n\nText.\n")
    assert cli.main(["--home", home, "import", str(tmp_path / "one")]) == 0
    capsys.readouterr()
    assert cli.main(["--home", home, "retrieve", "annual leave"]) == 0
    assert [json.loads(x)["way"] for x in capsys.readouterr().out.splitlines()] == ["concept"]
    assert schemas.CONCEPTS.startswith("concept_id")
