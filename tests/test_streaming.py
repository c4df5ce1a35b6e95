"""Streams over small folders."""

from pyspark.sql import functions as F

from folioforge.sources import readers
from folioforge.streaming import ingest


def test_ingest_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("one")
    (folder / "b.txt").write_text("one")
    (folder / "c.md").write_text("two")
    seen = []
    run = lambda df, _: seen.extend(r.filename for r in df.select("filename").collect())
    for _ in range(2):
        ingest.ingest_stream(ingest.file_stream(spark, str(folder)), run, str(tmp_path / "check")).awaitTermination()
    assert len(seen) == 2 and "c.md" in seen
    (folder / "d.txt").write_text("three")
    ingest.ingest_stream(ingest.file_stream(spark, str(folder)), run, str(tmp_path / "check")).awaitTermination()
    assert seen[2:] == ["d.txt"]


def test_job_states_and_windows(spark, sf):
    events = spark.createDataFrame([("j1", "queued", 1), ("j1", "completed", 3), ("j2", "parsing", 2), ("j2", "odd", 9)], "job_id string, status string, updated_at int")
    assert {r.job_id: (r.status, r.is_terminal) for r in ingest.job_states(events).collect()} == {"j1": ("completed", True), "j2": ("parsing", False)}
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    counts = ingest.windowed(stream, ["event_type"], {"n": F.count("*")}, late="1 hour")
    q = counts.writeStream.outputMode("append").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = ingest.windowed(spark.read.parquet(f"{sf}/events.parquet"), ["event_type"], {"n": F.count("*")})
    done = spark.table("w")
    assert done.count() > 0 and done.exceptAll(batch).count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Hello\n\nWorld")
    (tmp_path / "x.pdf").write_bytes(b"pdf")
    (tmp_path / "y.bin").write_bytes(b"no")
    found = readers.files(spark, str(tmp_path))
    assert sorted(r.filename for r in found.collect()) == ["a.txt", "x.pdf"]
    assert readers.plain_texts(found).first().text == "Hello\n\nWorld"
    made = readers.pdf_blocks(found, lambda content: [{"page_number": 1, "text": content.decode(), "is_bold": True}])
    assert made.first().text == "pdf"
