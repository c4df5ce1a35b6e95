"""The engine's functions under SQL names: a table function for LATERAL, scalar functions of built-in expressions, and the layout reader.

    register(spark)
    spark.sql("SELECT doc_id, p.* FROM documents, LATERAL split_paragraphs(text) p")
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.structure import KEEP_WORDS, PACK_WORDS
from ..sources.layout_source import LayoutBlocks

_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t\n\r\f\v]+")


def _words(text: str) -> list[str]:
    return [w for w in _SPACE.sub(" ", text).strip(" ").split(" ") if w]


def _windows(words: list[str]) -> Iterator[str]:
    return (" ".join(words[i : i + PACK_WORDS]) for i in range(0, len(words), PACK_WORDS))


def paragraph_parts(text: str) -> Iterator[str]:
    """The parts of structure.split_long, one by one."""
    words = _words(text)
    if len(words) <= KEEP_WORDS:
        yield text
        return
    sentences = [s for s in (x.strip(" ") for x in _SENTENCE.split(text)) if s]
    if len(sentences) < 2:
        yield from _windows(words)
        return
    held: list[str] = []
    n = 0
    for s in sentences:
        own = _words(s)
        if held and (len(own) > KEEP_WORDS or n + len(own) > PACK_WORDS):
            yield " ".join(held)
            held, n = [], 0
        if len(own) > KEEP_WORDS:
            yield from _windows(own)
        else:
            held.append(s)
            n += len(own)
    if held:
        yield " ".join(held)


@udtf(returnType="part: int, body: string", useArrow=False)
class SplitParagraphs:
    """(part, body) of a text; none of a null text."""

    def eval(self, text: str):
        if text is not None:
            yield from enumerate(paragraph_parts(text))


#: name: (parameters, type, expression)
SQL_FUNCTIONS = {
    "bm25_idf": ("n DOUBLE, df DOUBLE", "DOUBLE", "CASE WHEN n - df + 0.5D <= df + 0.5D THEN 1e-6D ELSE ln((n - df + 0.5D) / (df + 0.5D)) END"),
    "bm25_idf_lucene": ("n DOUBLE, df DOUBLE", "DOUBLE", "ln(1 + (n - df + 0.5D) / (df + 0.5D))"),
    "bm25_part": ("idf DOUBLE, f DOUBLE, dl DOUBLE, avgdl DOUBLE", "DOUBLE", "idf * f * 2.2D / (f + 1.2D * (0.25D + 0.75D * dl / avgdl))"),
}


def register(spark: SparkSession) -> None:
    """In a session, until it ends."""
    spark.udtf.register("split_paragraphs", SplitParagraphs)
    spark.dataSource.register(LayoutBlocks)
    for name, (parameters, kind, expression) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {expression}")
