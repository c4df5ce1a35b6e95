"""Concepts mined from chunks: phrase candidates, scores, pruning, relations, bundles."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..errors import BundleError
from ..functions import text as T
from ..plans.tables import at_rest
from . import catalog
from .index import few, is_few


def _ngrams(marked: Column, n: int) -> Column:
    """Runs of n of a sentence's words (w, edge, number) whose first and last word may stand at an edge, longer ones without numbers."""
    last = F.size(marked) - n
    fine = lambda i: F.get(marked, i)["edge"] if n == 1 else F.get(marked, i)["edge"] & F.get(marked, i + n - 1)["edge"] & ~_any_number(marked, i, n)
    starts = F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), fine)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", *(F.get(marked, i + j)["w"] for j in range(n))))


def _any_number(marked: Column, i: Column, n: int) -> Column:
    out = F.get(marked, i)["number"]
    for j in range(1, n):
        out = out | F.get(marked, i + j)["number"]
    return out


def sentence_tokens(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_id, sentence, grams): each sentence's candidates of one to three words, with repeats. Each word is looked at once: whether it
    may begin or end a phrase, and whether it is a number."""
    s = chunks.select("document_id", "chunk_id", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("sentence", "s"))
    mark = lambda w: F.struct(w.alias("w"), ((F.length(w) >= 3) & ~w.isin(*C.CONCEPT_STOPWORDS)).alias("edge"), w.rlike("^[0-9]+$").alias("number"))
    marked = s.select("document_id", "chunk_id", "sentence", F.transform(T.tokens(F.col("s")), mark).alias("t"))
    return marked.select("document_id", "chunk_id", "sentence", F.concat(*(_ngrams(F.col("t"), n) for n in (3, 2, 1))).alias("grams"))


def phrases(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_id, sentence, phrase), one row for each occurrence of a candidate of one to three words."""
    # Exploded as structs: a plain explode has the candidates worked out again for a filter on their number (ten times as slow).
    rows = F.explode(F.transform("grams", lambda p: F.struct(p.alias("phrase")))).alias("p")
    return sentence_tokens(chunks).select("document_id", "chunk_id", "sentence", rows).select("document_id", "chunk_id", "sentence", "p.phrase")


def scores(chunks: DataFrame, hits: bool = True) -> DataFrame:
    """(document_id, phrase, hits, n_sentences, score): distinct sentences, times 1 + 0.35 for each further token. Without hits there is no such
    column, and half the rows.

    A sentence's distinct phrases are told before the shuffle, so both numbers are sums that partial aggregation shrinks."""
    one = lambda hit, first: lambda p: F.struct(p.alias("phrase"), F.lit(hit).alias("hits"), F.lit(first).alias("n_sentences"))
    firsts = F.transform(F.array_distinct("grams"), one(0, 1))
    both = F.concat(F.transform("grams", one(1, 0)), firsts) if hits else firsts
    rows = sentence_tokens(chunks).select("document_id", F.explode(both).alias("p")).select("document_id", "p.*")
    more = F.size(F.array_distinct(F.split("phrase", " "))) - 1
    sums = [F.sum(c).alias(c) for c in (("hits", "n_sentences") if hits else ("n_sentences",))]
    return rows.groupBy("document_id", "phrase").agg(*sums).withColumn("score", F.round(F.col("n_sentences") * (1 + 0.35 * more), 6))


def _prune(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of document, score and phrase: the first `most` of each document whose tokens hold none of its kept ones, nor are held."""
    current, kept, out = None, [], {"document_id": [], "phrase": [], "score": [], "place": []}
    kind = None
    for batch in batches:
        kind = batch.schema.field("document_id").type
        for doc, phrase, score in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("document_id", "phrase", "score")), strict=True):
            if doc != current:
                current, kept = doc, []
            if len(kept) >= most:
                continue
            t = frozenset(phrase.split(" "))
            if not any(t <= k or k <= t for k in kept):
                kept.append(t)
                for c, v in (("document_id", doc), ("phrase", phrase), ("score", score), ("place", len(kept))):
                    out[c].append(v)
        yield pa.record_batch([pa.array(out["document_id"], kind), pa.array(out["phrase"], pa.string()), pa.array(out["score"], pa.float64()), pa.array(out["place"], pa.int32())], ["document_id", "phrase", "score", "place"])
        out = {c: [] for c in out}


#: Phrases of each document that are looked at first; sixteen times as many where they don't suffice.
FIRST = 256


def top_concepts(scored: DataFrame, most: int = 12, first: int = FIRST) -> DataFrame:
    """(document_id, phrase, score, place): greedy choice by score. Each document's best phrases only meet in one task; those of
    documents that need more of them are looked at again with more."""
    scored = at_rest(scored.select("document_id", "phrase", "score"), "scores")
    kind = dict(scored.dtypes)["document_id"]
    order = Window.partitionBy("document_id").orderBy(F.desc("score"), "phrase")
    sizes = scored.groupBy("document_id").agg(F.count("*").alias("size"))
    open_, out, n = scored, None, first
    while True:
        best = open_.withColumn("no", F.row_number().over(order)).where(F.col("no") <= n).drop("no").repartition("document_id").sortWithinPartitions("document_id", F.desc("score"), "phrase")
        kept = at_rest(best.mapInArrow(lambda b: _prune(b, most), f"document_id {kind}, phrase string, score double, place int"), "concepts")
        counted = kept.groupBy("document_id").agg(F.count("*").alias("kept")).join(sizes, "document_id")
        short = at_rest(counted.where((F.col("kept") < most) & (F.col("size") > n)).select("document_id"), "short")
        full = kept.join(short, "document_id", "left_anti")
        out = full if out is None else out.unionByName(full)
        if not short.limit(1).count():
            return out
        open_, n = scored.join(short, "document_id", "left_semi"), 16 * n


#: Words of a document that are looked for in each of its sentences; of a document with more, all phrases are candidates.
ABLE = 1000


def best_phrases(chunks: DataFrame, most: int = 12) -> tuple[DataFrame, DataFrame]:
    """(found, chosen): the `most` phrases of each document with the best scores, ties to the smaller one (document_id, phrase, score), and the sentences with a
    phrase that may be one of them (document_id, chunk_id, sentence, phrase).

    A phrase stands in no more sentences than its first and last word. So words are counted first: the `most`-th best score among words that are candidates bounds
    those of the chosen from below, and a phrase whose outer words are too rare to reach it isn't counted. What can reach it is counted exactly."""
    s = chunks.select("document_id", "chunk_id", F.posexplode(T.sentences(F.coalesce("text", F.lit("")))).alias("sentence", "s"))
    told = s.select("document_id", "chunk_id", "sentence", T.tokens(F.col("s")).alias("t"))
    edge = lambda w: (F.length(w) >= 3) & ~w.isin(*C.CONCEPT_STOPWORDS)
    counts = at_rest(told.select("document_id", F.explode(F.array_distinct("t")).alias("w")).where(edge(F.col("w"))).groupBy("document_id", "w").agg(F.count("*").alias("n")), "words")
    nth = Window.partitionBy("document_id").orderBy(F.desc("n"), "w")
    least = counts.withColumn("no", F.row_number().over(nth)).where(F.col("no") <= most).groupBy("document_id").agg(F.when(F.count("*") == most, F.min("n")).otherwise(0).alias("least"))
    able = at_rest(counts.join(least, "document_id").where("n * 1.7 + 0.001 >= least").select("document_id", "w"), "able")
    lists = able.groupBy("document_id").agg(F.count("*").alias("size")).where(F.col("size") <= ABLE).join(able, "document_id").groupBy("document_id").agg(F.collect_list("w").alias("able"))
    lists = F.broadcast(lists) if is_few(able) else lists

    hit = F.when(F.col("able").isNull(), F.filter(F.array_distinct("t"), edge)).otherwise(F.array_intersect("t", "able"))
    sentence = told.join(lists, "document_id", "left").withColumn("hit", hit).where("size(hit) > 0")
    outer = lambda n: lambda i: F.array_contains("hit", F.get("t", i)) & F.array_contains("hit", F.get("t", i + n - 1))
    starts = lambda n: F.when(F.size("t") >= n, F.filter(F.sequence(F.lit(0), F.size("t") - n), outer(n))).otherwise(F.array().cast("array<int>"))
    runs = lambda n: F.transform(starts(n), lambda i: F.concat_ws(" ", *(F.get("t", i + j) for j in range(n))))
    longer = F.filter(F.concat(runs(3), runs(2)), lambda p: ~p.rlike("(^| )[0-9]+( |$)"))
    held = at_rest(sentence.select("document_id", "chunk_id", "sentence", F.array_distinct(F.concat(longer, "hit")).alias("grams")), "candidates")
    found = held.select("document_id", "chunk_id", "sentence", F.explode("grams").alias("phrase"))
    score = F.round(F.col("n_sentences") * (1 + 0.35 * (F.size(F.array_distinct(F.split("phrase", " "))) - 1)), 6)
    scored = found.groupBy("document_id", "phrase").agg(F.count("*").alias("n_sentences")).select("document_id", "phrase", score.alias("score"))
    best = Window.partitionBy("document_id").orderBy(F.desc("score"), "phrase")
    return found, at_rest(scored.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most).drop("r"), "chosen")


def related(found: DataFrame, chosen: DataFrame, most: int = 5) -> DataFrame:
    """(document_id, phrase, other, jaccard, place): chosen phrases of a document that share sentences."""
    keys = found.join(few(chosen.select("document_id", "phrase")), ["document_id", "phrase"], "left_semi").select("document_id", "phrase", "chunk_id", "sentence").distinct()
    keys = at_rest(keys, "keys")
    size = keys.groupBy("document_id", "phrase").agg(F.count("*").alias("n"))
    other = keys.select("document_id", F.col("phrase").alias("other"), "chunk_id", "sentence")
    both = keys.join(other, ["document_id", "chunk_id", "sentence"]).where("phrase <> other").groupBy("document_id", "phrase", "other").agg(F.count("*").alias("m"))
    sized = both.join(size, ["document_id", "phrase"]).join(size.select("document_id", F.col("phrase").alias("other"), F.col("n").alias("n2")), ["document_id", "other"])
    scored = sized.withColumn("jaccard", F.round(F.col("m") / (F.col("n") + F.col("n2") - F.col("m")), 6))
    w = Window.partitionBy("document_id", "phrase").orderBy(F.desc("jaccard"), "other")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("document_id", "phrase", "other", "jaccard", "place")


def top_chunks(found: DataFrame, chosen: DataFrame, most: int = 5) -> DataFrame:
    """(document_id, phrase, chunk_id, hits): the chunks that hold a chosen phrase most often."""
    hits = found.join(few(chosen.select("document_id", "phrase")), ["document_id", "phrase"], "left_semi").groupBy("document_id", "phrase", "chunk_id").agg(F.count("*").alias("hits"))
    w = Window.partitionBy("document_id", "phrase").orderBy(F.desc("hits"), "chunk_id")
    return hits.withColumn("no", F.row_number().over(w)).where(F.col("no") <= most).drop("no")


def match_concepts(concepts: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, concept_id, overlap): concepts with most of a question's words in title, slug, text, aliases and tags."""
    terms = lambda t: F.array_distinct(F.filter(T.words(F.lower(F.replace(t, F.lit("-"), F.lit(" ")))), lambda w: F.length(w) > 2))
    lists = [F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ") for c in ("aliases", "tags")]
    held = concepts.select("concept_id", F.explode(terms(F.concat_ws(" ", "title", "slug", "text", *lists))).alias("w"))
    asked = queries.select("query_id", F.explode(terms(F.col("question"))).alias("w"))
    both = held.join(asked, "w").groupBy("query_id", "concept_id").agg(F.count("*").alias("overlap"))
    order = Window.partitionBy("query_id").orderBy(F.desc("overlap"), "concept_id")
    return both.withColumn("no", F.row_number().over(order)).where(F.col("no") <= k).drop("no")


def concept_chunks(matched: DataFrame, concepts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, chunk_id, ...) the source chunks of matched concepts, each once for a question."""
    ids = matched.join(concepts.select("concept_id", "source_chunk_ids"), "concept_id").select("query_id", F.explode("source_chunk_ids").alias("chunk_id")).distinct()
    return ids.join(chunks, "chunk_id")


# Bundles of Markdown files


def split_front_matter(value: Column) -> tuple[Column, Column]:
    """The metadata block and the body of a Markdown file."""
    parts = F.split(value, "(?m)^---\n", 3)
    has = value.startswith("---\n") & (F.size(parts) == 3)
    return F.when(has, F.get(parts, F.lit(1))).otherwise(F.lit("")), F.when(has, F.get(parts, F.lit(2))).otherwise(value)


def _scalar(v: str):
    v = v.strip()
    if len(v) > 1 and v[0] == v[-1] and v[0] in "\"'":
        return v[1:-1]
    if v.lower() in ("true", "false"):
        return v.lower() == "true"
    if v.startswith("[") and v.endswith("]"):
        return [_scalar(x) for x in v[1:-1].split(",") if x.strip()]
    return v


def parse_yaml(block: str) -> dict:
    """A small YAML: scalars, inline lists, block lists, and lists of maps."""
    out: dict = {}
    key: str | None = None
    for line in block.splitlines():
        bare = line.strip()
        if not bare or bare.startswith("#"):
            continue
        if bare.startswith("- ") and key is not None:
            if not isinstance(out.get(key), list):
                out[key] = []
            item = bare[2:]
            name, colon, rest = item.partition(":")
            pair = colon and not item.startswith(("\"", "'")) and (rest.startswith(" ") or not rest)
            out[key].append({name.strip(): _scalar(rest)} if pair else _scalar(item))
        elif line[0] in " \t" and key is not None and isinstance(out.get(key), list) and out[key] and isinstance(out[key][-1], dict) and ":" in bare:
            name, _, rest = bare.partition(":")
            out[key][-1][name.strip()] = _scalar(rest)
        elif ":" in bare:
            key, _, rest = bare.partition(":")
            key = key.strip()
            out[key] = _scalar(rest) if rest.strip() else []
    return out


def _json(blocks: pa.Array) -> pa.Array:
    return pa.array([None if b is None else json.dumps(parse_yaml(b), ensure_ascii=False) for b in blocks.to_pylist()], pa.string())


def yaml_json(blocks: Column) -> Column:
    """Metadata blocks as JSON."""
    return F.arrow_udf(_json, "string")(blocks)


def render_yaml(pairs: list[tuple[str, Column]]) -> Column:
    """A metadata block of string and array<string> columns; lists as block lists, texts quoted where they need it."""
    def quote(c: Column) -> Column:
        return F.when(c.rlike(r"[:#\[\]{}\"']|^\s|\s$|^$"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(c)

    lines = []
    for name, c in pairs:
        if name.endswith("[]"):
            items = F.concat_ws("\n", F.transform(c, lambda v: F.concat(F.lit("  - "), quote(v))))
            lines.append(F.when(F.size(c) > 0, F.concat(F.lit(f"{name[:-2]}:\n"), items)).otherwise(F.lit(f"{name[:-2]}: []")))
        else:
            lines.append(F.concat(F.lit(f"{name}: "), quote(F.coalesce(c, F.lit("")))))
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"))


def bundle_files(files: DataFrame) -> DataFrame:
    """(path, name, meta JSON, body, links) of Markdown files (path relative to the bundle, value); index.md is left out."""
    block, body = split_front_matter(F.col("value"))
    rows = files.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).where("name <> 'index.md' and path like '%.md'")
    return rows.select("path", "name", yaml_json(block).alias("meta"), body.alias("body"), T.markdown_links(body).alias("links"))


def validate_bundle(parsed: DataFrame) -> DataFrame:
    """(path, severity, message) for every broken rule of a bundle."""
    get = lambda k: F.get_json_object("meta", f"$.{k}")
    empty = lambda k: F.coalesce(get(k), F.lit("")) == ""
    rules = [
        (empty("type"), "error", "Missing required field: type."),
        ((get("type") == "concept") & empty("title"), "error", "Concept files must include title."),
        ((get("type") == "concept") & empty("id"), "error", "Concept files must include id."),
        (F.trim("body") == "", "warning", "File body is empty."),
        *((~empty(k) & ~get(k).startswith("["), "error", f"{k} must be a list.") for k in ("tags", "aliases", "related", "depends_on")),
    ]
    issue = lambda s, m: F.struct(F.lit(s).alias("severity"), F.lit(m).alias("message"))
    found = parsed.select("path", F.explode(F.filter(F.array(*(F.when(F.coalesce(t, F.lit(False)), issue(s, m)) for t, s, m in rules)), lambda x: x.isNotNull())).alias("i")).select("path", "i.*")
    links = parsed.select("path", F.explode("links").alias("link")).withColumns({"target": F.concat(F.regexp_extract("path", r"^(.*/)?[^/]*$", 1), "link"), "base": F.regexp_extract("link", r"([^/]+)$", 1)})
    known, names = parsed.select(F.col("path").alias("target")), parsed.select(F.col("name").alias("base")).distinct()
    lost = links.join(known, "target", "left_anti").join(known.withColumnRenamed("target", "link"), "link", "left_anti").join(names, "base", "left_anti")
    none = parsed.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("").alias("path"), F.lit("error").alias("severity"), F.lit("The bundle has no concept files.").alias("message"))
    return found.unionByName(none).unionByName(lost.select("path", F.lit("warning").alias("severity"), F.concat(F.lit("Link target not found: "), "link", F.lit(".")).alias("message")))


def concepts_of_bundle(parsed: DataFrame) -> DataFrame:
    """Concept rows of parsed files, with defaults from file names."""
    get = lambda k: F.get_json_object("meta", f"$.{k}")
    stem = F.regexp_replace("name", r"\.md$", "")
    title = F.coalesce(get("title"), F.initcap(F.regexp_replace(stem, "[-_]+", " ")))
    items = lambda k: F.coalesce(F.from_json(get(k), "array<string>"), F.array().cast("array<string>"))
    chunk_ids = F.from_json(get("source_chunks"), "array<struct<chunk_id:string>>")
    sources = F.coalesce(F.filter(F.transform(chunk_ids, lambda c: c["chunk_id"]), lambda c: c.isNotNull()), F.array().cast("array<string>"))
    return parsed.where(get("type") == "concept").select(
        F.coalesce(get("id"), F.concat(F.lit("concept_"), F.substring(F.sha2("path", 256), 1, 16))).alias("concept_id"), title.alias("title"), T.slug(title).alias("slug"), F.trim("body").alias("text"), sources.alias("source_chunk_ids"),
        F.coalesce(get("verification_status"), F.lit("unverified")).alias("verification_status"), *(items(k).alias(k) for k in ("aliases", "tags", "related", "depends_on")), "path",
    )


def render_concepts(concepts: DataFrame, chunks: DataFrame) -> DataFrame:
    """(path, value): a Markdown file for each concept (metadata, excerpts of 90 words, sources)."""
    rows = concepts.select("concept_id", F.explode_outer("source_chunk_ids").alias("chunk_id")).join(chunks.select("chunk_id", "text", "page_number"), "chunk_id", "left")
    told = rows.groupBy("concept_id").agg(F.array_sort(F.collect_list(F.struct("page_number", "chunk_id", T.truncate_words(F.col("text"), 90).alias("t")))).alias("s"))
    head = render_yaml([("type", F.lit("concept")), ("id", F.col("concept_id")), ("title", F.col("title")), ("slug", F.col("slug")), ("verification_status", F.col("verification_status")), ("aliases[]", F.col("aliases")), ("tags[]", F.col("tags")), ("related[]", F.col("related")), ("depends_on[]", F.col("depends_on"))])
    quotes = F.concat_ws("\n\n", F.transform(F.filter("s", lambda x: x["t"].isNotNull()), lambda x: F.concat(F.lit("> "), x["t"])))
    sources = F.concat_ws("\n", F.transform(F.filter("s", lambda x: x["t"].isNotNull()), lambda x: F.concat(F.lit("- "), x["chunk_id"], F.lit(", page "), x["page_number"].cast("string"))))
    links = F.concat_ws("\n", F.transform("related", lambda r: F.concat(F.lit("- ["), r, F.lit("]("), T.slug(r), F.lit(".md)"))))
    value = F.concat(head, F.lit("\n# "), F.col("title"), F.lit("\n\n"), quotes, F.lit("\n\n## Related\n\n"), links, F.lit("\n\n## Sources\n\n"), sources, F.lit("\n"))
    return concepts.join(told, "concept_id").select(F.concat("slug", F.lit(".md")).alias("path"), value.alias("value"))


def mine(chunks: DataFrame, most: int = 12) -> DataFrame:
    """Concept rows of chunks: the chosen phrases of each document with their chunks and relations."""
    from ..functions import ids

    found = phrases(chunks)
    chosen = top_concepts(scores(chunks, hits=False), most)
    sources = top_chunks(found, chosen).groupBy("document_id", "phrase").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("hits")).alias("h"), "chunk_id"))), lambda x: x["chunk_id"]).alias("source_chunk_ids"))
    near = related(found, chosen).groupBy("document_id", "phrase").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "other"))), lambda x: x["other"]).alias("related"))
    none = F.array().cast("array<string>")
    rows = chosen.join(sources, ["document_id", "phrase"]).join(near, ["document_id", "phrase"], "left")
    slug = F.concat_ws("-", T.slug(F.col("document_id").cast("string")), T.slug(F.col("phrase")))
    return rows.select(
        ids.concept_id(slug, F.col("source_chunk_ids")).alias("concept_id"), F.initcap("phrase").alias("title"), slug.alias("slug"), F.col("phrase").alias("text"), "source_chunk_ids", F.lit("unverified").alias("verification_status"),
        none.alias("aliases"), F.array_sort(F.split("phrase", " ")).alias("tags"), F.coalesce("related", none).alias("related"), none.alias("depends_on"), F.lit(None).cast("string").alias("path"),
    )


def render_indexes(files: DataFrame) -> DataFrame:
    """(path, value) of the bundle's two tables of contents, for concept files (path below concepts/). The list of concepts is one file's
    text by its nature."""
    front = lambda title: f"---\ntype: index\ntitle: {title}\n---\n\n# {title}\n\n"
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.md$", "")
    entry = F.struct(stem.alias("stem"), F.concat(F.lit("- ["), F.initcap(F.replace(stem, F.lit("-"), F.lit(" "))), F.lit("]("), stem, F.lit(".md)")).alias("line"))
    listed = files.agg(F.array_sort(F.collect_list(entry)).alias("e")).select(F.lit("concepts/index.md").alias("path"), F.concat(F.lit(front("Concepts")), F.array_join(F.transform("e", lambda x: x["line"]), "\n")).alias("value"))
    root = files.sparkSession.createDataFrame([("index.md", front("Knowledge Index") + "- [Concepts](concepts/index.md)\n")], "path string, value string")
    return root.unionByName(listed)


def import_bundle(files: DataFrame, existing: DataFrame, target: str | None = None, fail_on_error: bool = True) -> tuple[DataFrame, DataFrame]:
    """(concepts, issues): existing with the concepts of a bundle's files (path, value) in it. The bundle is checked first; errors
    raise BundleError, or leave out their files. With target, the concept files taken over are written below it."""
    parsed = at_rest(bundle_files(files), "bundle")
    issues = at_rest(validate_bundle(parsed), "issues")
    wrong = issues.where("severity = 'error'")
    if fail_on_error and (first := wrong.limit(5).collect()):
        raise BundleError("; ".join(f"{r.path}: {r.message}" for r in first))
    fine = parsed.join(wrong.select("path").distinct(), "path", "left_anti")
    new = at_rest(concepts_of_bundle(fine), "imported")
    if target is not None:
        files.join(new.select("path"), "path", "left_semi").write.mode("append").parquet(target)
    return catalog.upsert(existing, new.select(existing.columns), ["concept_id"], version="path"), issues
