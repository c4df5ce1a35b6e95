"""Names, phone numbers, summaries by a generator, answers as tables."""

from pyspark.sql import functions as F

from folioforge import schemas
from folioforge.functions import phones
from folioforge.functions import text as T
from folioforge.operators import answer, catalog, concepts, entities, retrieval, structure
from folioforge.plans.engine import Engine


def test_phones(spark):
    cases = {
        "call +91 98765 43210 or 011-2345": ["+91 98765 43210"], "09876543210": ["+91 98765 43210"], "98765-43210, (987) 654-3211": ["+91 98765 43210", "+91 98765 43211"], "0091 9876543210": ["+91 98765 43210"],
        "+1 (650) 253-0000 x": ["+1 650-253-0000"], "+44 20 7946 0958": ["+44 2079460958"], "order 12345": [], "id a9876543210": [], "12345678901234567890123": [], "": [], "+999 12345678": [],
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want array<string>")
    assert [(r.t, r.got) for r in df.select("t", "want", phones.numbers(F.col("t")).alias("got")).collect() if r.got != r.want] == []
    assert df.where("t = '+1 (650) 253-0000 x'").select(phones.phone(F.col("t"), "US")).first()[0] == "+1 650-253-0000"
    us = spark.createDataFrame([("650-253-0000",), ("1 650 253 0000",), (None,)], "t string").select(phones.phone(F.col("t"), "US").alias("p")).collect()
    assert [r.p for r in us] == ["+1 650-253-0000", "+1 650-253-0000", None]


def test_institution_pattern(spark):
    t = "Amartya Kumar, B.Tech at Shri Ram Institute of Science & Technology, 2021. College days."
    row = spark.createDataFrame([(t,)], "t string").select(T.institution(F.col("t")).alias("i")).first()
    assert row.i == "Shri Ram Institute of Science & Technology"


TEXTS = [("n1", "Resume of amartya KUMAR  sen from the Delhi School of Economics"), ("n2", "the Delhi School of nothing; Asha Rao"), ("n3", "plain words"), ("n4", None), ("n5", "O'Neil-Smith & Sons, Delhi School of Economics and Delhi School")]
NAMES = [("person", "Amartya Kumar"), ("person", "Amartya Kumar Sen"), ("person", "Kumar Sen Gupta"), ("institution", "Delhi School of Economics"), ("institution", "Delhi School"), ("institution", "O'Neil-Smith & Sons"), ("person", "")]


def brute_names(text):
    import re

    split = lambda t: re.findall(r"[^\W_]+(?:['’.\-][^\W_]+)*|&", t or "")
    w, out, i = [x.lower() for x in split(text)], [], 0
    known = {tuple(x.lower() for x in split(n)): (k, n) for k, n in NAMES if n}
    while i < len(w):
        m = max((len(n) for n in known if tuple(w[i : i + len(n)]) == n), default=0)
        if m:
            out.append((*known[tuple(w[i : i + m])], i))
        i += m or 1
    return out


def test_find_names(spark):
    texts, names = spark.createDataFrame(TEXTS, "node_id string, text string"), spark.createDataFrame(NAMES, "kind string, name string")
    got = sorted((r.node_id, r.kind, r.name, r.at) for r in entities.find_names(texts, names).collect())
    assert got == sorted((n, *x) for n, t in TEXTS for x in brute_names(t)) and len(got) == 6
    assert entities.find_names(texts, names.where("false")).count() == 0
    both = {(r.node_id, r.kind): r.name for r in entities.gazetteer_recogniser(names)(texts).collect() if r.at == 0 or r.node_id == "n1"}
    assert both["n1", "person"] == "Amartya Kumar Sen" and ("n2", "person") in both and ("n3", "person") not in both


def test_facts_by_recogniser(spark):
    evidence = spark.createDataFrame([(1, 1, "whats amartya collage name?", "n1", None, TEXTS[0][1]), (2, 1, "what is the phone number", "n6", None, "Phone: 09876543210")], "query_id int, rank int, question string, node_id string, title string, text string")
    names = spark.createDataFrame(NAMES, "kind string, name string")
    got = {r.query_id: (r.kind, r.answer) for r in answer.facts(evidence, entities.gazetteer_recogniser(names)).collect()}
    assert got[1] == ("institution", "Delhi School of Economics") and got[2] == ("phone", "+91 98765 43210")
    ranked = retrieval.with_persons(evidence.withColumns({"page_start": F.lit(1), "in_tree": F.lit(False)}), entities.gazetteer_recogniser(names))
    assert {r.query_id: r.entity for r in retrieval.signals(ranked).collect()} == {1: 1.0, 2: 0.0}


def test_ranking_outside_the_tree(spark):
    rows = spark.createDataFrame([(1, "leave", n, "Leave", "leave of staff", 1, t) for n, t in (("a", True), ("b", False))], "query_id int, question string, node_id string, title string, text string, page_start int, in_tree boolean")
    got = {r.node_id: r.score for r in retrieval.rank_nodes(rows).collect()}
    assert round(got["a"] - got["b"], 9) == 0.15


def test_summaries(spark):
    nodes = spark.createDataFrame([("a", "T", "One. Two! Three?"), ("b", None, "long " * 400), ("c", "x", " "), ("d", None, "Short.")], "node_id string, title string, text string")
    plain = {r.node_id: r.summary for r in structure.summaries(nodes).collect()}
    assert plain["a"] == "One. Two!" and len(plain["b"]) == 300 and set(plain) == {"a", "b", "d"}
    made = {r.node_id: r.summary for r in structure.summaries(nodes, lambda p: F.when(p.contains("Three"), F.repeat(F.lit("s"), 500)).when(p.contains("Short"), " ")).collect()}
    assert made["a"] == "s" * 400 and made["d"] == "Short." and made["b"] == plain["b"]


def test_empty_bundle(spark):
    none = spark.createDataFrame([], "path string, value string")
    issues = concepts.validate_bundle(concepts.bundle_files(none)).collect()
    assert [(r.severity, r.path) for r in issues] == [("error", "")]
    one = spark.createDataFrame([("a.md", "---\ntype: concept\nid: a\ntitle: A\n---\n\nText.\n")], "path string, value string")
    assert concepts.validate_bundle(concepts.bundle_files(one)).count() == 0


def test_answers_are_kept_with_citations(spark, tmp_path):
    files = catalog.register(spark.createDataFrame([("s", "a.txt", bytearray(b"1 Leave\n\nStaff earn twenty days of annual leave each year."))], "session_id string, filename string, content binary")).withColumn("path", F.col("filename"))
    home = str(tmp_path / "home")
    engine = Engine.open(spark, home).ingest(files, lambda f: structure.plain_blocks(f.select("document_id", F.col("content").cast("string").alias("text")))).save(home)
    q = spark.createDataFrame([(1, "how many days of annual leave do staff earn", "s"), (2, "zebra quagga", "none")], "query_id int, question string, session_id string")
    for _ in range(2):
        engine, given = engine.ask_and_keep(q)
        engine = engine.save(home)
    kept = Engine.open(spark, home).answers.collect()
    assert len(kept) == 2 and sorted(len(r.citations) for r in kept) == [0, 1] and given.count() == 2
    (cited,) = catalog.answer_citations(Engine.open(spark, home).answers).collect()
    assert cited.source_id == "S1" and cited.position == 0 and "twenty days" in cited.excerpt and cited.page_start == 1
    assert dict(Engine.open(spark, home).answers.dtypes) == dict(spark.createDataFrame([], schemas.ANSWERS).dtypes)


def test_phone_numbers_brute(spark, sf):
    """q_phone_numbers by other means: a regex engine and plain Python."""
    import regex

    from folioforge import queries

    pattern = regex.compile(r"(?<![\p{L}\p{N}+.])(\+?\(?[0-9][0-9\s().\-/]{5,18}[0-9])(?![\p{L}\p{N}])")

    def read(raw):
        digits = "".join(c for c in raw if c in "0123456789")
        abroad = digits if raw.lstrip().startswith("+") else digits[2:] if digits.startswith("00") else None
        regions = phones.REGIONS.items() if abroad is not None else [("IN", phones.REGIONS["IN"])]
        for _, (code, least, most, trunk, groups) in regions:
            tries = [abroad[len(code) :]] if abroad is not None and abroad.startswith(code) else [] if abroad is not None else [digits, *([digits[len(trunk) :]] if trunk and digits.startswith(trunk) else [])]
            for d in tries:
                if least <= len(d) <= most and not d.startswith("0"):
                    sep = " " if " " in groups else "-"
                    sizes = [int(n) for n in groups.split(sep)] if groups else [len(d)]
                    if sum(sizes) != len(d):
                        sizes = [len(d)]
                    at, parts = 0, []
                    for n in sizes:
                        parts.append(d[at : at + n])
                        at += n
                    return f"+{code} {sep.join(parts)}"
        return None

    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        found = [n for n in (read(m.group(1)) for m in pattern.finditer(r.text or "")) if n]
        want |= {(r.doc_id, i, n) for i, n in enumerate(found)}
    assert {(r.doc_id, r.no, r.number) for r in queries.q_phone_numbers(spark, sf).collect()} == want and want
