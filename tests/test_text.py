"""Text functions on small cases."""

import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioforge import schemas
from folioforge.functions import ids
from folioforge.functions import text as T
from folioforge.functions.fuzzy import _lcs, token_set_ratio


def value(spark, column, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize(("f", "text", "expected"), [
    (T.normalize_space, "  a \t b\n c ", "a b c"),
    (T.tokens, "Well-known it's A_1 x--y", ["well-known", "it's", "a_1", "x", "y"]),
    (T.paragraphs, "a b\r\n\r\n \n c\n\n\n", ["a b", "c"]),
    (T.first_sentence, "One. Two.", "One."),
    (T.first_sentence, "x" * 300, "x" * 200),
    (T.sentences, "0990 is it.  11 of 11! 22?  ", ["0990 is it.", "11 of 11!", "22?"]),
    (T.slug, " Hello, Wörld! ", "hello-w-rld"),
    (T.slug, "!!", "concept"),
    (T.match_expression, "what is the leave policy?", '"leave" OR "policy"'),
    (T.match_expression, "what is", '"what" OR "is"'),
    (T.phrase_query, 'find "annual leave" now', "annual leave"),
    (T.phrase_query, "single", ""),
    (T.classify, "What is her email?", "fast_fact"),
    (T.classify, "Explain the process of it", "topic"),
    (T.classify, "apples versus pears in autumn", "comparison"),
    (T.classify, "give me an overview of this", "summary"),
    (T.classify, "the highest value this year", "numeric_or_table"),
    (T.classify, "the clause about leave days here", "exact_identifier"),
    (T.classify, "and then?", "follow_up_or_short"),
    (T.classify, "does the plan cover all dental work", "direct_factual"),
    (T.comparison_parts, "compare apples and pears?", ["apples", "pears"]),
    (T.comparison_parts, "nothing here", ["nothing here"]),
    (T.is_fast_fact, "who wrote this", True),
    (T.is_fast_fact, "please go on", False),
    (T.numbering_depth, "2.1.3 Scope", 3),
    (T.numbering_depth, "Chapter one", 1),
    (T.numbers, "12% of 3.5 in 2020", ["12", "3.5", "2020"]),
    (T.dates, "on 12/03/2021 and March 3, 2020", ["12/03/2021", "march 3, 2020"]),
    (T.proper_names, "met John Smith in Paris", ["john smith"]),
    (T.email, "write to A.b@x.org now", "A.b@x.org"),
    (T.cgpa, "CGPA: 8.75", "8.75"),
    (T.degree, "holds a B.Tech (CSE)", "Bachelor of Technology"),
    (T.with_source_mark, "yes", "yes [S1]"),
    (T.with_source_mark, "yes [S3]", "yes [S3]"),
    (T.markdown_links, "see [a](./a.md) and [b](x/b.md) not [c](c.txt)", ["a.md", "x/b.md"]),
])
def test_text(spark, f, text, expected):
    assert value(spark, f(F.col("t")), t=text) == expected


def test_truncate(spark):
    assert value(spark, T.truncate_words(F.col("t"), 2), t="a b c") == "a b..."
    assert value(spark, T.truncate_words(F.col("t"), 3), t="a b c") == "a b c"


def test_ids(spark):
    got = value(spark, ids.stable_id("doc", F.lit("s"), F.lit("f"), F.lit(3)))
    assert got == "doc_" + hashlib.sha256("s\x1ff\x1f3".encode()).hexdigest()[:16]
    payload = json.dumps(["node", 'd"1', 2, 0, ["A", "é"]], ensure_ascii=False, separators=(",", ":"))
    got = value(spark, ids.node_id(F.lit('d"1'), F.lit(2), F.lit(0), F.array(F.lit("A"), F.lit("é"))))
    assert got == "node_" + hashlib.sha256(payload.encode()).hexdigest()[:32]


def test_token_set_ratio():
    assert token_set_ratio("new york mets", "new york mets vs braves") == 100
    assert token_set_ratio("", "a") == 0
    assert token_set_ratio("abc", "acb") == 67


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert _lcs(a, b) == table[-1][-1]


def test_violations(spark):
    rows = spark.createDataFrame([("n1", 1, 1, "section"), ("", 0, -1, "odd")], "node_id string, page_start int, page_end int, node_type string")
    assert sorted(r.rule for r in schemas.violations(rows, "nodes").collect()) == ["id", "page_order", "page_start", "type"]
