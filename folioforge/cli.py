"""Command line: ingest a folder into Parquet tables, show their state, retrieve and ask.

    python -m folioforge.cli --home DIR init|status|ingest PATH|validate PATH|import PATH|retrieve QUESTION|ask QUESTION [--session ID]
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from .errors import UnsupportedFileError
from .operators import concepts, structure
from .plans.engine import Engine
from .plans.tables import scratch
from .sources import readers


def main(argv: list[str]) -> int:
    args = argparse.ArgumentParser(description=__doc__)
    args.add_argument("--home", required=True)
    args.add_argument("--session", default="default")
    args.add_argument("command", choices=("init", "status", "ingest", "validate", "import", "retrieve", "ask"))
    args.add_argument("what", nargs="?", default="")
    a = args.parse_args(argv)
    spark = SparkSession.builder.appName("folioforge").getOrCreate()
    with scratch(spark):
        for row in _run(spark, a).toJSON().toLocalIterator():
            print(json.dumps(json.loads(row), ensure_ascii=False))
    return 0


def _run(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    engine = Engine.open(spark, a.home)
    if a.command == "ingest":
        files = readers.files(spark, a.what, a.session)
        if files.where("suffix = 'pdf'").limit(1).count():
            raise UnsupportedFileError("PDF files need a reader; see sources.readers.pdf_blocks")
        engine = engine.ingest(files, lambda f: structure.plain_blocks(readers.plain_texts(f))).save(a.home)
    if a.command == "import":
        engine, issues = engine.import_concepts(readers.bundle(spark, a.what))
        engine.save(a.home)
    questions = spark.createDataFrame([(1, a.what, a.session)], "query_id int, question string, session_id string")
    return {"init": engine.status, "status": engine.status, "ingest": engine.status, "validate": lambda: concepts.validate_bundle(concepts.bundle_files(readers.bundle(spark, a.what))), "import": lambda: issues, "retrieve": lambda: engine.retrieve_passages(questions), "ask": lambda: engine.ask(questions)}[a.command]()


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
