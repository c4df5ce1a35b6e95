"""Steps whose work must follow the input: what they shuffle, and that their rows stay the same."""

import random
import re
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from folioforge.operators import answer, concepts, index
from folioforge.operators.index_store import SearchIndex
from folioforge.queries import QUERIES


def shuffled_by(df):
    """The keys of a plan's shuffles, without the numbers of columns."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", keys) for keys in re.findall(r"hashpartitioning\((.*), \d+\)", plan)]


def test_node_term_stats(spark):
    rows = [("a", "Tree tree stone", None), ("b", None, "stone Über"), ("c", "", ""), ("d", "uber tree stone", "Stone")]
    nodes = spark.createDataFrame(rows, "node_id string, text string, title string")
    told = index.node_term_stats(nodes)
    assert shuffled_by(told) == ["term"]  # no pairs of term and node
    assert {tuple(r) for r in told.collect()} == {("tree", 2, 3), ("stone", 3, 4), ("uber", 2, 2)}
    assert told.exceptAll(index.term_stats(index.postings(nodes))).count() == 0
    assert dict(told.dtypes) == dict(index.term_stats(index.postings(nodes)).dtypes)


def test_citation_pairs_stay_in_their_row(spark, sf):
    assert shuffled_by(QUERIES["q_citation_validate"](spark, sf)) == []


def test_supported(spark):
    rows = [
        ("Sales rose [S1] in 2020.", "sales rose in 2020", True), ("Sales rose in 2020", "sales rose", False), ("Sales rose", None, None), ("12 of 3", None, None), ("", None, None), ("", "x", True),
        ("Sales rose[S1]up", "sales", False), ("Sales figures rose", "sales figures fell", False), ("Ada Lovelace wrote notes", "Ada Lovelace wrote notes", True), ("Ada Lovelace wrote notes", "ada lovelace wrote notes", False),
    ]
    told = spark.createDataFrame(rows, "a string, e string, want boolean").select("a", "e", "want", answer.supported(F.col("a"), F.col("e")).alias("got"))
    assert [(r.a, r.e, r.got) for r in told.collect()] == [(r.a, r.e, r.want) for r in told.collect()]


def test_like_search_hands_on_k_nodes_of_a_piece(spark):
    texts = [f"Xtreehouse tree{n % 7}" if n % 2 else "house" for n in range(300)]
    nodes = spark.createDataFrame([(f"n{n % 290}", t) for n, t in enumerate(texts)], "node_id string, text string")  # ten ids stand twice
    queries = spark.createDataFrame([(1, "tree"), (2, "house"), (3, "tree5 none"), (4, "none")], "query_id int, question string")
    found = index.like_search(nodes, queries, 3)
    want = set()
    for q, terms in ((1, ["tree"]), (2, ["house"]), (3, ["tree5", "none"])):
        held = sorted({f"n{n % 290}" for n, t in enumerate(texts) if any(w in t.lower() for w in terms)})
        want |= {(q, node, rank) for rank, node in enumerate(held[:3], 1)}
    assert {(r.query_id, r.node_id, r.rank) for r in found.collect()} == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit \[piece[^\n]* 3, Partial", plan)  # before the shuffle by piece


@pytest.mark.parametrize("able", [1000, 15])
def test_best_phrases_counts_what_can_be_best(spark, monkeypatch, able):
    monkeypatch.setattr(concepts, "ABLE", able)
    rng = random.Random(5)
    words = [f"word{n}" for n in range(200)] + ["the", "12", "999", "ox", "big tree", "big tree house", "big big big", "2020 tree"]
    text = lambda n: " ".join(words[min(int(rng.paretovariate(0.7)), len(words)) - 1] for _ in range(n)) + rng.choice([".", "! ", "? The tree"])
    rows = [(doc, f"{doc}:{n}", " ".join(text(9) for _ in range(3))) for doc in ("a", "b") for n in range(150)] + [("c", "c:0", "Tree house. Big tree"), ("d", "d:0", None), ("e", "e:0", "ox 12.")]
    chunks = spark.createDataFrame(rows, "document_id string, chunk_id string, text string")
    found, chosen = concepts.best_phrases(chunks)
    every = concepts.scores(chunks, hits=False)
    best = Window.partitionBy("document_id").orderBy(F.desc("score"), "phrase")
    want = {(r.document_id, r.phrase, r.score) for r in every.withColumn("r", F.row_number().over(best)).where("r <= 12").collect()}
    assert {tuple(r) for r in chosen.select("document_id", "phrase", "score").collect()} == want
    whole = concepts.phrases(chunks)
    told = {tuple(r) for r in concepts.related(found, chosen).collect()}
    assert told == {tuple(r) for r in concepts.related(whole, chosen).collect()} and told
    if able == 1000:  # most phrases have too rare words
        assert found.select("document_id", "phrase").distinct().count() < every.count() / 2


def test_index_leaves_no_shuffle_files(spark, tmp_path):
    """Segments are packed closely, and what was shuffled for them is gone when they are written."""
    rows = [(f"n{i}", f"d{i // 3}", f"Title {i}", f"annual leave number {i}") for i in range(30)]
    nodes = spark.createDataFrame(rows, "node_id string, document_id string, title string, text string")
    held = lambda: {f for f in re.findall(r"shuffle_\d+_\d+_\d+\.data", spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().toString())}
    before = held()
    store = SearchIndex.open(spark, str(tmp_path / "index")).add(nodes).remove(nodes.where("document_id = 'd1'").select("document_id"))
    until = time.time() + 20
    while held() - before and time.time() < until:  # they are deleted in the background
        time.sleep(0.2)
    assert not held() - before
    files = [f.name for f in (tmp_path / "index" / "segment").rglob("*.parquet")]
    assert files and all(".zstd." in f for f in files)
    store.check(nodes.where("document_id <> 'd1'"))
