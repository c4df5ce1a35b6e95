"""The registered reader and functions, and job states with timers."""

import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

from folioforge.functions import registered
from folioforge.functions.fuzzy import _lcs, lcs_column, token_set_ratio, token_set_ratio_column
from folioforge.operators import structure
from folioforge.sources import layout_source
from folioforge.streaming import ingest

TEXTS = ["First paragraph.\n\nSecond one.", "a\r\nb\r\rc\x0bd\x85e", "", "\n\n \n", "x\n" * 130, " kept\xa0\n\n\tinner"]


def test_layout_blocks_source(spark, tmp_path):
    registered.register(spark)
    for i, text in enumerate(TEXTS):
        (tmp_path / f"f{i}.txt").write_bytes(text.encode())
    (tmp_path / "other.bin").write_text("no")
    read = spark.read.format("layout_blocks").option("path", str(tmp_path)).option("bytes_per_partition", "40").load()
    assert read.rdd.getNumPartitions() > 2
    got = sorted((r.path.rsplit("/", 1)[-1], r.block_pos, r.page_number, r.text) for r in read.collect())
    docs = spark.createDataFrame([(f"f{i}.txt", t) for i, t in enumerate(TEXTS)], "document_id string, text string")
    assert got == sorted((r.document_id, r.block_pos, r.page_number, r.text) for r in structure.plain_blocks(docs).collect())
    with pytest.raises(Exception, match="path"):
        spark.read.format("layout_blocks").load().collect()


def upper_blocks(content: bytes, name: str) -> list[dict]:
    return [{"page_number": 3, "text": content.decode().upper(), "font_name": name, "is_bold": True}]


def test_layout_blocks_parser_and_stream(spark, tmp_path):
    registered.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.md").write_text("one")
    options = {"path": str(folder), "parser": "tests.test_sources:upper_blocks"}
    (row,) = spark.read.format("layout_blocks").options(**options).load().collect()
    assert (row.text, row.font_name, row.is_bold, row.page_number) == ("ONE", "a.md", True, 3)

    def run():
        stream = spark.readStream.format("layout_blocks").options(path=str(folder)).load()
        stream.select("text").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(once=True).start().awaitTermination()
        return sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["one"]
    time.sleep(0.02)
    (folder / "b.txt").write_text("two\n\nthree")
    assert run() == ["one", "three", "two"] and run() == ["one", "three", "two"]


def test_plain_blocks_of_is_plain_blocks():
    assert layout_source.plain_blocks_of(b"a\n\n b \n\n\nc", 2) == [{"page_number": 1, "text": "a"}, {"page_number": 2, "text": "b"}, {"page_number": 3, "text": "c"}]


def test_sql_functions(spark, sf):
    registered.register(spark)
    spark.read.parquet(f"{sf}/documents.parquet").createOrReplaceTempView("some_documents")
    got = spark.sql("SELECT doc_id, p.part, p.body FROM some_documents, LATERAL split_paragraphs(text) p")
    want = spark.table("some_documents").select("doc_id", F.posexplode(structure.split_long(F.col("text"))).alias("part", "body"))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() > 200
    row = spark.sql("SELECT bm25_idf(10, 2) a, bm25_idf(10, 6) b, bm25_idf_lucene(10, 2) c, bm25_part(2, 3, 7, 5) d").first()
    from folioforge.operators import index

    kinds = spark.range(1).select(*(index.idf(F.lit(10), F.lit(n), k).alias(c) for c, n, k in (("a", 2, "fts"), ("b", 6, "fts"), ("c", 2, "lucene")))).first()
    assert (row.a, row.b, row.c) == (kinds.a, kinds.b, kinds.c) and abs(row.d - 2 * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 7 / 5))) < 1e-12


def test_long_paragraphs_in_sql():
    long = " ".join(f"w{i}" for i in range(1300))
    cases = [long, " ".join("Some words here. " + f"n{i}" for i in range(300)), long + ". Short one. " + "Next? " * 700, "short"]
    for text in cases:
        parts = list(registered.paragraph_parts(text))
        assert " ".join(parts).split() == text.split() and (len(parts) > 1 or text == "short")


def test_ratio_column(spark):
    import random

    rng = random.Random(3)
    words = ["alpha", "Beta", "x1", "don't", "İst", "naïve", "the", "of", *(f"w{i}" for i in range(30))]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pairs = [("", "a"), (None, None), ("a b", "b a"), ("abc", "acb"), ("a", "a b"), ("x" * 59, "y" + "x" * 61), ("ab" * 40, "ba" * 45), ("q w", "e r")]
    pairs += [(text(rng.randrange(1, 12)), text(rng.randrange(1, 80))) for _ in range(150)] + [(text(60), text(70)) for _ in range(5)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    told = df.select("i", token_set_ratio_column(F.col("a"), F.col("b")).alias("r"))
    assert "Python" not in told._jdf.queryExecution().executedPlan().toString()
    got = {r.i: r.r for r in told.collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == token_set_ratio(a or "", b or "") / 100, (a, b)
    raw = [(i, "".join(rng.choice("ab c") for _ in range(rng.randrange(1, 150))), "".join(rng.choice("abc d") for _ in range(rng.randrange(1, 150)))) for i in range(60)]
    told = {r.i: r.n for r in spark.createDataFrame(raw, "i int, a string, b string").select("i", lcs_column(F.col("a"), F.col("b")).alias("n")).collect()}
    assert told == {i: _lcs(a, b) for i, a, b in raw}


def test_job_course(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda m: datetime.datetime(2024, 1, 1, 12) + datetime.timedelta(minutes=m)
    folder, schema = str(tmp_path / "in"), "job_id string, status string, updated_at timestamp"

    def run(no, rows):
        os.makedirs(folder, exist_ok=True)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{no}")
        events = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
        course = ingest.job_course(events, datetime.timedelta(minutes=30), "10 minutes")
        course.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.job_id, r.updated_at, r.status, r.is_terminal, r.stale) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    try:
        first = run(0, [("a", "queued", at(0)), ("b", "queued", at(0)), ("b", "parsing", at(0)), ("c", "queued", at(1)), ("c", "odd", at(2))])
        assert [(j, s) for j, _, s, _, _ in first] == [("a", "queued"), ("b", "parsing"), ("c", "queued")]
        # Started anew: an event that comes late changes nothing, a later one does.
        second = run(1, [("b", "queued", at(-1)), ("a", "parsing", at(5)), ("c", "completed", at(6))])
        assert [x for x in second if x not in first] == [("a", at(5), "parsing", False, False), ("c", at(6), "completed", True, False)]
        # Time goes on with another job: those without news fail, what has ended stays.
        third = run(2, [("d", "queued", at(60))])
        fourth = run(3, [("d", "parsing", at(61))])
        assert [x for x in fourth if x[4]] == [("a", at(35), "failed", True, True), ("b", at(30), "failed", True, True)] and len(third) >= 6
        fifth = run(4, [("a", "completed", at(62)), ("d", "completed", at(63))])
        assert [x for x in fifth if x not in fourth] == [("d", at(63), "completed", True, False)]
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_equal_times_go_by_the_course(spark):
    events = spark.createDataFrame([("j", "queued", 1), ("j", "parsing", 1), ("k", "completed", 2), ("k", "cleaning", 2)], "job_id string, status string, updated_at int")
    assert {r.job_id: r.status for r in ingest.job_states(events).collect()} == {"j": "parsing", "k": "completed"}


def test_seen_hashes_stay_few(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    for i in range(4):
        for j in range(3):
            (folder / f"f{i}{j}.txt").write_text(f"text {i if j else 0} {j}")
        ingest.ingest_stream(ingest.file_stream(spark, str(folder)), lambda df, _: seen.extend(r.filename for r in df.collect()), str(tmp_path / "check")).awaitTermination()
    assert len(seen) == 9 and len(set(seen)) == 9
    for first in (tmp_path / "check" / "seen").glob("first=*"):
        assert len(list(first.glob("batch=*"))) <= 2
