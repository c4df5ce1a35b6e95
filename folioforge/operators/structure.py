"""From layout blocks to headings, trees, pages and chunks, without loops over documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import ids
from ..functions import text as T

LINES_PER_PAGE, PAGES_PER_GROUP = 50, 5
KEEP_WORDS, PACK_WORDS, CHUNK_WORDS = 500, 200, 360


def plain_blocks(docs: DataFrame, lines_per_page: int = LINES_PER_PAGE, block_sep: str = r"\n{2,}") -> DataFrame:
    """(document_id, block_pos, page_number, text): pages of so many lines, cut at block_sep, trimmed, blanks dropped."""
    lines = docs.select("document_id", F.posexplode(F.split(T.unify_breaks(F.col("text")), "\n")).alias("pos", "line"))
    pages = lines.groupBy("document_id", (F.floor(F.col("pos") / lines_per_page) + 1).cast("int").alias("page_number")).agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    whole = pages.select("document_id", "page_number", F.posexplode(F.split(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), block_sep)).alias("at", "text"))
    kept = whole.withColumn("text", T.F.regexp_replace("text", r"^\s+|\s+$", "")).where("text <> ''")
    order = Window.partitionBy("document_id").orderBy("page_number", "at")
    return kept.select("document_id", (F.row_number().over(order) - 1).alias("block_pos"), "page_number", "text")


def span_blocks(blocks: DataFrame) -> DataFrame:
    """Layout facts of blocks with lines ARRAY<STRUCT<y, spans ARRAY<STRUCT<text, size, font, flags>>>> and bbox."""
    spans = F.flatten(F.transform("lines", lambda line: line["spans"]))
    bold = F.exists(spans, lambda s: (s["flags"].bitwiseAND(F.lit(16)) != 0) | F.lower(s["font"]).contains("bold"))
    return blocks.select(
        *(c for c in blocks.columns if c not in ("lines", "bbox")),
        F.array_join(F.transform(spans, lambda s: s["text"]), "").alias("text"), F.array_max(F.transform(spans, lambda s: s["size"])).alias("font_size"), F.get(F.transform(spans, lambda s: s["font"]), F.lit(0)).alias("font_name"),
        F.coalesce(bold, F.lit(False)).alias("is_bold"), "bbox", F.get("bbox", F.lit(0)).alias("indent"), F.when(F.size("lines") > 1, F.get("lines", F.lit(1))["y"] - F.get("lines", F.lit(0))["y"]).otherwise(0.0).alias("line_spacing"),
    )


#: Characters that a page of a readable document has on average.
ENOUGH_CHARS = 20


def needs_fallback(pages: DataFrame, least: float = ENOUGH_CHARS) -> DataFrame:
    """Documents whose pages hold less than so many characters on average: (document_id, chars, sufficient)."""
    return pages.groupBy("document_id").agg(F.avg(F.length(F.trim("text"))).alias("chars")).withColumn("sufficient", F.col("chars") >= least)


def baseline_size(blocks: DataFrame) -> DataFrame:
    """(document_id, baseline): the upper median of font sizes, 12 without any."""
    sizes = F.sort_array(F.collect_list("font_size"))
    return blocks.groupBy("document_id").agg(sizes.alias("s")).select("document_id", F.coalesce(F.get("s", F.floor(F.size("s") / 2).cast("int")), F.lit(12.0)).alias("baseline"))


def heading_score(text: Column, size: Column, baseline: Column, bold: Column, spacing: Column, indent: Column) -> Column:
    """Sum of the weights of what makes a heading, in a fixed order."""
    w, n = C.HEADING_WEIGHTS, T.word_count(text)
    on = lambda test, name: F.when(F.coalesce(test, F.lit(False)), w[name]).otherwise(0.0)
    caps = (F.upper(text) == text) & (F.lower(text) != text) & (n <= 12)
    return (
        on(T.numbering_depth(text) > 0, "numbering") + on(caps, "caps") + on(size > baseline * 1.2, "size") + on(bold, "bold") + on((n <= 12) & ~text.rlike(r"[.!?]$"), "short")
        + on(spacing >= 18, "spacing") + on(n > 20, "long") + on(indent < 10, "indent")
    )


def detect_headings(blocks: DataFrame) -> DataFrame:
    """blocks with score, is_heading and depth; missing layout columns count as unknown."""
    have = blocks.columns
    col = lambda name, default: F.col(name) if name in have else F.lit(default)
    base = blocks.join(baseline_size(blocks), "document_id") if "font_size" in have else blocks.withColumn("baseline", F.lit(12.0))
    text = F.trim("text")
    score = heading_score(text, col("font_size", None).cast("double"), F.col("baseline"), col("is_bold", False), col("line_spacing", 0.0), col("indent", 1e9))
    scored = base.withColumn("score", F.round(score, 6)).withColumn("is_heading", F.col("score") >= C.HEADING_THRESHOLD)
    return scored.withColumn("depth", F.when(F.col("is_heading"), T.numbering_depth(text)).otherwise(0)).drop("baseline")


def split_long(text: Column) -> Column:
    """Parts of a paragraph: whole up to KEEP_WORDS words, else sentences packed to PACK_WORDS, longer sentences in windows."""
    window = lambda w, n: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / n).cast("int")), lambda i: F.array_join(F.slice(w, i * n + 1, n), " "))
    start = F.struct(F.lit("").alias("cur"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
    flushed = lambda a: F.when(a["n"] > 0, F.array_append(a["out"], a["cur"])).otherwise(a["out"])

    def step(a: Column, s: Column) -> Column:
        w = T.words(s)
        long = F.struct(F.lit("").alias("cur"), F.lit(0).alias("n"), F.concat(flushed(a), window(w, PACK_WORDS)).alias("out"))
        fresh = F.struct(s.alias("cur"), F.size(w).alias("n"), flushed(a).alias("out"))
        more = F.struct(F.when(a["n"] > 0, F.concat_ws(" ", a["cur"], s)).otherwise(s).alias("cur"), (a["n"] + F.size(w)).alias("n"), a["out"].alias("out"))
        return F.when(F.size(w) > KEEP_WORDS, long).when((a["n"] > 0) & (a["n"] + F.size(w) > PACK_WORDS), fresh).otherwise(more)

    parts = T.sentences(text)
    packed = F.when(F.size(parts) > 1, F.aggregate(parts, start, step, flushed)).otherwise(window(T.words(text), PACK_WORDS))
    return F.when(T.word_count(text) <= KEEP_WORDS, F.array(text)).otherwise(packed)


def build_tree(blocks: DataFrame, id_mode: str = "safe") -> DataFrame:
    """Document nodes of blocks with is_heading and depth: by headings, or in groups of five pages where a document has none.

    A heading's parent is the nearest heading before it of a smaller depth, a paragraph's the nearest
    heading at all; else the document's root. Headings without a number count as depth 1.
    """
    doc = Window.partitionBy("document_id")
    b = blocks.withColumn("any_heading", F.max(F.col("is_heading").cast("int")).over(doc)).withColumn("d", F.when(F.col("is_heading"), F.greatest("depth", F.lit(1))))
    headed = b.where("any_heading = 1")
    before = doc.orderBy("block_pos").rowsBetween(Window.unboundedPreceding, -1)
    at = {k: F.last(F.when(F.col("d") == k, F.col("block_pos")), ignorenulls=True).over(before) for k in (1, 2, 3)}
    h = headed.withColumns({f"p{k}": c for k, c in at.items()})
    none = F.lit(-1)
    last = lambda *ks: F.greatest(none, *(F.coalesce(f"p{k}", none) for k in ks))
    parent = F.when(F.col("d") == 1, none).when(F.col("d") == 2, F.greatest(none, F.coalesce("p1", none))).when(F.col("d") == 3, last(1, 2)).otherwise(last(1, 2, 3))
    parts = F.when(F.col("d").isNull(), split_long(F.col("text"))).otherwise(F.array(F.lit("")))
    rows = h.withColumn("parent_pos", parent).select("document_id", "block_pos", "page_number", "d", "parent_pos", F.when(F.col("d").isNotNull(), F.col("text")).alias("title"), F.posexplode(parts).alias("part", "body"))
    # The path of titles above: three levels at most.
    heads = rows.where("d is not null").select("document_id", F.col("block_pos").alias("parent_pos"), F.col("parent_pos").alias("up"), F.col("title").alias("t"), F.col("d").alias("pd"))
    up = lambda n: heads.select("document_id", F.col("parent_pos").alias(f"k{n}"), F.col("up").alias(f"k{n + 1}"), F.col("t").alias(f"t{n}"), *([F.col("pd")] if n == 1 else []))
    r = rows.withColumn("k1", F.col("parent_pos"))
    for n in (1, 2, 3):
        r = r.join(up(n), ["document_id", f"k{n}"], "left")
    path = F.filter(F.array("t3", "t2", "t1"), lambda t: t.isNotNull())
    kinds = F.when(F.col("d") == 1, "chapter").when(F.col("d") == 2, "section").when(F.col("d") == 3, "subsection").otherwise("paragraph")
    place = Window.partitionBy("document_id", "parent_pos").orderBy("block_pos", "part")
    headed_nodes = r.select(
        "document_id", F.concat_ws(":", F.lit("b"), "block_pos", F.when(F.col("d").isNull(), F.col("part"))).alias("key"), F.when(F.col("parent_pos") >= 0, F.concat_ws(":", F.lit("b"), "parent_pos")).otherwise("root").alias("parent_key"), kinds.alias("node_type"), "title",
        F.col("body").alias("text"), F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), F.coalesce("d", F.coalesce("pd", F.lit(0)) + 1).alias("depth"), (F.row_number().over(place) - 1).alias("position"), path.alias("heading_path"),
    )

    flat = b.where("any_heading = 0").withColumn("group", F.ceil(F.col("page_number") / PAGES_PER_GROUP).cast("int"))
    last_page = flat.groupBy("document_id").agg(F.max("page_number").alias("pages"))
    groups = last_page.select("document_id", "pages", F.explode(F.sequence(F.lit(1), F.ceil(F.col("pages") / PAGES_PER_GROUP).cast("int"))).alias("group"))
    empty = F.array().cast("array<string>")
    first, final = (F.col("group") - 1) * PAGES_PER_GROUP + 1, F.least(F.col("group") * PAGES_PER_GROUP, F.col("pages"))
    group_nodes = groups.select(
        "document_id", F.concat_ws(":", F.lit("g"), "group").alias("key"), F.lit("root").alias("parent_key"), F.lit("section").alias("node_type"), F.concat(F.lit("Pages "), first, F.lit("-"), final).alias("title"), F.lit("").alias("text"),
        first.alias("page_start"), final.alias("page_end"), F.lit(1).alias("depth"), (F.col("group") - 1).alias("position"), empty.alias("heading_path"),
    )
    in_group = Window.partitionBy("document_id", "group").orderBy("block_pos", "part")
    leaves = flat.select("document_id", "group", "block_pos", "page_number", F.posexplode(split_long(F.col("text"))).alias("part", "body")).select(
        "document_id", F.concat_ws(":", F.lit("b"), "block_pos", "part").alias("key"), F.concat_ws(":", F.lit("g"), "group").alias("parent_key"), F.lit("paragraph").alias("node_type"), F.lit(None).cast("string").alias("title"), F.col("body").alias("text"),
        F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), F.lit(2).alias("depth"), (F.row_number().over(in_group) - 1).alias("position"), empty.alias("heading_path"),
    )
    roots = blocks.groupBy("document_id").agg(F.min("page_number").alias("page_start"), F.max("page_number").alias("page_end")).select(
        "document_id", F.lit("root").alias("key"), F.lit(None).cast("string").alias("parent_key"), F.lit("document").alias("node_type"), F.lit(None).cast("string").alias("title"), F.lit("").alias("text"), "page_start", "page_end", F.lit(0).alias("depth"), F.lit(0).alias("position"), empty.alias("heading_path"),
    )
    every = roots.unionByName(headed_nodes).unionByName(group_nodes).unionByName(leaves)
    return with_ids(every, id_mode)


def with_ids(rows: DataFrame, id_mode: str = "safe") -> DataFrame:
    """node_id and parent_id in place of key and parent_key. 'safe' hashes the parent's key too, 'compat' doesn't and may collide."""
    doc = F.col("document_id").cast("string")
    extra = F.col("parent_key") if id_mode == "safe" else None
    named = rows.withColumn("node_id", ids.node_id(doc, F.col("depth"), F.col("position"), F.col("heading_path"), extra))
    parents = named.where("node_type <> 'paragraph'").select("document_id", F.col("key").alias("parent_key"), F.col("node_id").alias("parent_id"))
    return named.join(parents, ["document_id", "parent_key"], "left").select("node_id", "document_id", "parent_id", "node_type", "title", "text", "page_start", "page_end", "depth", "position", "heading_path")


def page_texts(nodes: DataFrame) -> DataFrame:
    """(document_id, page_number, text, section_path) of the non-blank nodes below the root, joined by blank lines."""
    body = nodes.where("node_type <> 'document' and trim(text) <> ''")
    part = F.struct("depth", "position", "node_id", "text", "heading_path")
    pages = body.groupBy("document_id", F.col("page_start").alias("page_number")).agg(F.array_sort(F.collect_list(part)).alias("p"))
    return pages.select("document_id", "page_number", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text"), F.get("p", F.lit(0))["heading_path"].alias("section_path"))


def chunk_pages(pages: DataFrame, target: int = CHUNK_WORDS, mode: str = "cumsum") -> DataFrame:
    """(document_id, page_number, sequence, text, n_words, chunk_id): a page's paragraphs grouped by running words div target.

    mode 'greedy' closes a group before the paragraph that would exceed the target.
    """
    paras = pages.select("document_id", "page_number", F.posexplode(T.paragraphs(F.col("text"))).alias("pos", "p")).withColumn("wc", T.word_count(F.col("p")))
    page = Window.partitionBy("document_id", "page_number").orderBy("pos")
    if mode == "cumsum":
        grouped = paras.withColumn("grp", F.floor(F.sum("wc").over(page.rowsBetween(Window.unboundedPreceding, 0)) / target))
    else:
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("grp"), F.array().cast("array<int>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            over = (a["n"] > 0) & (a["n"] + x["wc"] > target)
            grp = F.when(over, a["grp"] + 1).otherwise(a["grp"])
            return F.struct(F.when(over, x["wc"]).otherwise(a["n"] + x["wc"]).alias("n"), grp.alias("grp"), F.array_append(a["out"], grp).alias("out"))

        rows = paras.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("pos", "p", "wc"))).alias("l"))
        numbered = rows.withColumn("g", F.aggregate("l", start, step, lambda a: a["out"]))
        grouped = numbered.select("document_id", "page_number", F.explode(F.arrays_zip("l", "g")).alias("z")).select("document_id", "page_number", "z.l.*", F.col("z.g").alias("grp"))
    chunks = grouped.groupBy("document_id", "page_number", "grp").agg(F.array_sort(F.collect_list(F.struct("pos", "p"))).alias("l"), F.sum("wc").alias("n_words"))
    order = Window.partitionBy("document_id").orderBy("page_number", "grp")
    out = chunks.select("document_id", "page_number", (F.row_number().over(order) - 1).alias("sequence"), F.array_join(F.transform("l", lambda x: x["p"]), "\n\n").alias("text"), "n_words")
    return out.withColumn("chunk_id", ids.stable_id("chunk", F.col("document_id"), F.col("page_number"), F.col("sequence"), F.col("text")))


def repeated_lines(lines: DataFrame, share: float = 0.6, edge: int = 3, least_pages: int = 3, longest: int = 120) -> DataFrame:
    """(document_id, norm, n_pages): headers and footers, lines among the first or last three of many pages.

    lines: document_id, page_number, line_no, line.
    """
    norm = lines.withColumn("norm", T.normalize_space(F.col("line"))).where("norm <> ''")
    page = Window.partitionBy("document_id", "page_number")
    edges = norm.withColumns({"a": F.row_number().over(page.orderBy("line_no")), "z": F.row_number().over(page.orderBy(F.desc("line_no")))}).where(f"a <= {edge} or z <= {edge}")
    pages = norm.groupBy("document_id").agg(F.countDistinct("page_number").alias("pages")).where(f"pages >= {least_pages}")
    counted = edges.select("document_id", "page_number", "norm").distinct().groupBy("document_id", "norm").agg(F.count("*").alias("n_pages"))
    enough = F.greatest(F.lit(least_pages), F.floor(F.col("pages") * share))
    return counted.join(pages, "document_id").where((F.col("n_pages") >= enough) & (F.length("norm") < longest)).select("document_id", "norm", "n_pages")


def remove_repeated_lines(lines: DataFrame, **limits) -> DataFrame:
    """lines without headers and footers, anywhere on a page."""
    known = repeated_lines(lines, **limits).select("document_id", "norm")
    return lines.withColumn("norm", T.normalize_space(F.col("line"))).join(known, ["document_id", "norm"], "left_anti").drop("norm")


# Trees


def children(nodes: DataFrame, parents: DataFrame) -> DataFrame:
    """(anchor, node_id, document_id) of the children of parents (anchor, node_id)."""
    return parents.select("anchor", F.col("node_id").alias("parent_id")).join(nodes.select("node_id", "parent_id", "document_id", "position"), "parent_id").drop("parent_id")


def siblings(nodes: DataFrame) -> DataFrame:
    """(node_id, previous_id, next_id)."""
    order = Window.partitionBy("document_id", "parent_id").orderBy("position", "node_id")
    return nodes.select("node_id", F.lag("node_id").over(order).alias("previous_id"), F.lead("node_id").over(order).alias("next_id"))


def descendants(nodes: DataFrame, depth: int = 2) -> DataFrame:
    """(ancestor_id, node_id, level, path) down to depth levels; path orders them depth first."""
    down = nodes.where("parent_id is not null").select(F.col("parent_id").alias("up"), "node_id", "position")
    level = down.select(F.col("up").alias("ancestor_id"), "node_id", F.lit(1).alias("level"), F.array(F.struct("position", "node_id")).alias("path"))
    out = level
    for n in range(2, depth + 1):
        step = level.select("ancestor_id", F.col("node_id").alias("up"), "path")
        level = step.join(down, "up").select("ancestor_id", "node_id", F.lit(n).alias("level"), F.concat("path", F.array(F.struct("position", "node_id"))).alias("path"))
        out = out.unionByName(level)
    return out


def expand(nodes: DataFrame, hits: DataFrame, depth: int = 2, with_siblings: bool = True) -> DataFrame:
    """(query_id, node_id, place): each hit (query_id, node_id, rank), its parent unless the root, its siblings and descendants,
    in that order, each node once for a question."""
    info = nodes.select("node_id", "parent_id")
    base = hits.select("query_id", "node_id", "rank")
    none = F.array().cast("array<struct<position:int,node_id:string>>")
    row = lambda df, node, kind, path=none: df.select("query_id", F.col(node).alias("node_id"), "rank", F.lit(kind).alias("kind"), path.alias("path")).where("node_id is not null")
    roots = nodes.where("node_type = 'document'").select(F.col("node_id").alias("parent_id"))
    parent = base.join(info, "node_id").join(roots, "parent_id", "left_anti")
    parts = [row(base, "node_id", 0), row(parent, "parent_id", 1)]
    if with_siblings:
        beside = base.join(siblings(nodes), "node_id")
        parts += [row(beside, "previous_id", 2), row(beside, "next_id", 3)]
    below = base.join(descendants(nodes, depth).select(F.col("ancestor_id").alias("node_id"), F.col("node_id").alias("below_id"), F.transform("path", lambda x: F.struct(x["position"].cast("int").alias("position"), x["node_id"].alias("node_id"))).alias("path")), "node_id")
    parts.append(row(below, "below_id", 4, F.col("path")))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    first = every.groupBy("query_id", "node_id").agg(F.min(F.struct("rank", "kind", "path")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "node_id"))).select("query_id", "node_id", "place")


def merge_ordered(first: DataFrame, second: DataFrame) -> DataFrame:
    """(query_id, node_id, place): first's nodes, then second's that it lacks."""
    both = first.select("query_id", "node_id", F.lit(0).alias("side"), "place").unionByName(second.select("query_id", "node_id", F.lit(1).alias("side"), "place"))
    once = both.groupBy("query_id", "node_id").agg(F.min(F.struct("side", "place")).alias("at"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "node_id"))).select("query_id", "node_id", "place")


def preorder(nodes: DataFrame, depth: int = 4) -> DataFrame:
    """(document_id, node_id, place): nodes depth first, the root first."""
    roots = nodes.where("parent_id is null").select("document_id", F.col("node_id").alias("ancestor_id"))
    below = roots.join(descendants(nodes, depth), "ancestor_id").select("document_id", "node_id", "path")
    top = roots.select("document_id", F.col("ancestor_id").alias("node_id"), F.array().cast(below.schema["path"].dataType).alias("path"))
    order = Window.partitionBy("document_id").orderBy("path", "node_id")
    return top.unionByName(below).select("document_id", "node_id", (F.row_number().over(order) - 1).alias("place"))


def summary(text: Column, n: int = 300) -> Column:
    """The first two sentences, so many characters at most."""
    return F.substring(F.array_join(F.slice(T.sentences(text), 1, 2), " "), 1, n)


#: Characters of a section that a generator reads, and of a summary that it gives.
READ_CHARS, SUMMARY_CHARS = 1200, 400


def summaries(nodes: DataFrame, generate: Callable[[Column], Column] | None = None) -> DataFrame:
    """(node_id, summary): what a generator (a column of prompts to a column of texts) makes of each node with text; the first two sentences without one,
    and where it gives nothing."""
    text = F.coalesce("text", F.lit(""))
    rows = nodes.where(F.trim(text) != "")
    own = summary(F.trim(text))
    if generate is None:
        return rows.select("node_id", own.alias("summary"))
    asked = F.concat(F.lit("Summarise the section in 40 to 80 words, with facts from it only.\n\nTitle: "), F.coalesce("title", F.lit("")), F.lit("\nText:\n"), F.substring(text, 1, READ_CHARS), F.lit("\n\nSummary:"))
    made = F.substring(F.trim(F.col("made")), 1, SUMMARY_CHARS)
    return rows.withColumn("made", generate(asked)).select("node_id", F.when(F.coalesce(made, F.lit("")) != "", made).otherwise(own).alias("summary"))


def batches(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """df with batch: consecutive rows in groups of n, counted within each of order's first column."""
    w = Window.partitionBy(order[0]).orderBy(*order[1:])
    return df.withColumn("batch", F.floor((F.row_number().over(w) - 1) / n))


def route(nodes: DataFrame, queries: DataFrame, choose: Callable[[DataFrame], DataFrame] | None = None, depth: int = 3, k: int = 12) -> DataFrame:
    """(query_id, node_id, place) for queries and nodes with session_id: nodes that a walk down each document's tree ends at, level by level. choose takes the
    candidates of a level (query_id, question, node_id, title, text, ...) and gives those to follow (query_id, node_id); without it all are
    followed. A walk ends with the chosen nodes where none of them has children, or at the last level; nodes without children beside ones that have some
    are left behind."""
    place = ["document_id", "page_start", "depth", "position", "node_id"]
    tops = nodes.where("parent_id is null").select(F.col("node_id").alias("parent_id"))
    # A question walks the trees of its session; without sessions it would meet every document.
    candidates = queries.select("query_id", "question", "session_id").join(nodes.join(tops, "parent_id"), "session_id")
    out = None
    for n in range(1, depth + 1):
        chosen = candidates if choose is None else candidates.join(choose(candidates).select("query_id", "node_id").distinct(), ["query_id", "node_id"], "left_semi")
        below = chosen.select("query_id", "question", F.col("node_id").alias("parent_id")).join(nodes, "parent_id")
        going = below.select("query_id", "document_id").distinct()
        ended = chosen if n == depth else chosen.join(going, ["query_id", "document_id"], "left_anti")
        ended = ended.select("query_id", *place)
        out = ended if out is None else out.unionByName(ended)
        candidates = below
    order = Window.partitionBy("query_id").orderBy(*place)
    return out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "node_id", "place")
