"""Text expressions: normalising, tokens, truncation, slugs, classification, extraction. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

_EDGE_L, _EDGE_R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


_W = r"[\p{L}\p{N}_]"
#: A border of Unicode words, whatever the Java version takes \b for.
_BORDER = f"(?:(?<={_W})(?!{_W})|(?<!{_W})(?={_W}))"


def unicode_borders(pattern: str) -> str:
    return pattern.replace(r"\b", _BORDER)


def bounded(pattern: str) -> str:
    """pattern between borders of Unicode words."""
    return f"{_EDGE_L}(?:{pattern}){_EDGE_R}"


def normalize_space(t: Column) -> Column:
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def words(t: Column) -> Column:
    """White-space separated words; none for blank text."""
    return F.filter(F.split(normalize_space(t), " "), lambda w: w != "")


def word_count(t: Column) -> Column:
    return F.size(words(t))


def tokens(t: Column) -> Column:
    """Lower-cased ASCII tokens, with one inner hyphen or apostrophe."""
    return F.transform(F.regexp_extract_all(t, F.lit(C.TOKEN), F.lit(0)), F.lower)


def unify_breaks(t: Column) -> Column:
    """Every line break as one line feed."""
    return F.regexp_replace(t, r"\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]", "\n")


def paragraphs(t: Column) -> Column:
    """Non-blank paragraphs between blank lines, their space normalised."""
    parts = F.split(F.regexp_replace(t, "\r\n?", "\n"), r"\n\s*\n+")
    return F.filter(F.transform(parts, normalize_space), lambda p: p != "")


def truncate_words(t: Column, n: int, mark: str = "...") -> Column:
    w = words(t)
    return F.when(F.size(w) <= n, t).otherwise(F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit(mark)))


def first_sentence(t: Column) -> Column:
    """Up to the first full stop, exclamation or question mark within 400 characters, else 200 characters."""
    head = F.substring(t, 1, 400)
    found = F.regexp_extract(head, r"(?s)^[^.!?]*[.!?]", 0)
    return F.when(found != "", found).otherwise(F.substring(t, 1, 200))


def sentences(t: Column) -> Column:
    # Not F.trim itself: transform would hand it a sentence's number as the characters to take off.
    return F.filter(F.transform(F.split(t, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")  # noqa: PLW0108


def slug(t: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(s == "", F.lit("concept")).otherwise(s)


def document_slug(stem: Column, document_id: Column) -> Column:
    return F.concat_ws("-", slug(stem), F.substring(slug(F.regexp_replace(document_id, "^doc_", "")), 1, 8))


def fold(t: Column) -> Column:
    """Lower case without Latin diacritics, as full-text search has it (letters with two diacritics stay)."""
    return F.translate(F.lower(t), C.FOLD_FROM, C.FOLD_TO)


def fold_tokens(t: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.regexp_extract_all(fold(t), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(q: Column) -> Column:
    """Search terms of a question, in order and with repeats; stop words only if there is nothing else."""
    stop = F.array(*map(F.lit, C.QUERY_STOPWORDS))
    plain = words(F.regexp_replace(F.regexp_replace(q, "[\"']", " "), r"[^\p{L}\p{N}_\s\-]", " "))
    kept = F.filter(plain, lambda w: ~F.array_contains(stop, F.lower(w)))
    return F.when(F.size(kept) > 0, kept).otherwise(plain)


def match_expression(q: Column) -> Column:
    """The terms as quoted alternatives."""
    return F.array_join(F.transform(query_terms(q), lambda w: F.concat(F.lit('"'), w, F.lit('"'))), " OR ")


def phrase_query(q: Column) -> Column:
    """The first quoted run, else the whole question if it has several words, else nothing."""
    quoted = F.regexp_extract(q, '"([^"]+)"', 1)
    whole = F.trim(q)
    return F.when(quoted != "", quoted).when(whole.contains(" "), whole).otherwise(F.lit(""))


def classify(q: Column) -> Column:
    """The class of a question."""
    norm = F.replace(F.replace(F.lower(q), F.lit("collage"), F.lit("college")), F.lit("transection"), F.lit("transaction"))
    kind = None
    for name, pattern in C.QUESTION_CLASSES:
        test = norm.rlike(bounded(pattern))
        kind = F.when(test, F.lit(name)) if kind is None else kind.when(test, F.lit(name))
    return kind.when(word_count(q) <= 4, F.lit("follow_up_or_short")).otherwise(F.lit("direct_factual"))


def is_fast_fact(q: Column) -> Column:
    return (word_count(q) <= 15) & q.rlike("(?i)" + "|".join(bounded(p) for p in C.FAST_FACT))


def is_definition(q: Column) -> Column:
    return F.lower(q).rlike(unicode_borders(C.DEFINITION_QUESTION))


def core_topic(q: Column) -> Column:
    """A definition question without its opening and punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(q), unicode_borders(C.DEFINITION_QUESTION), " "), r"[?.!]", " "))


def comparison_parts(q: Column) -> Column:
    """The two sides of a comparison, or the question alone."""
    bare = lambda s: F.regexp_replace(F.regexp_replace(s, C.COMPARISON_WORD, " "), r"^[ ?.,:;]+|[ ?.,:;]+$", "")
    pattern = C.COMPARISON
    left, right = bare(F.regexp_extract(q, pattern, 1)), bare(F.regexp_extract(q, pattern, 2))
    return F.when(q.rlike(pattern), F.array(left, right)).otherwise(F.array(q))


def truncate_block(t: Column, n: int = 200) -> Column:
    """The first n words, their space normalised, with an ellipsis where there are more."""
    w = words(t)
    return F.concat(F.array_join(F.slice(w, 1, n), " "), F.when(F.size(w) > n, F.lit("…")).otherwise(F.lit("")))


def looks_like_heading(t: Column) -> Column:
    """The predicate of outlines: an upper-case opening after an optional number, few words, no stop at the end."""
    line = F.trim(t)
    fits = line.rlike(C.OUTLINE_HEADING) & ~line.rlike(C.OUTLINE_END)
    return fits & (F.length(line) <= C.OUTLINE_CHARS) & word_count(line).between(1, C.OUTLINE_WORDS)


def is_topic(q: Column) -> Column:
    """Whether a question names a topic in words, as debugging output tells it."""
    return F.exists(F.array(*map(F.lit, C.TOPIC_WORDS)), lambda w: F.contains(F.lower(q), w))


def numbering_depth(t: Column) -> Column:
    depth = None
    for pattern, d in C.HEADING_PATTERNS:
        depth = F.when(t.rlike(pattern), d) if depth is None else depth.when(t.rlike(pattern), d)
    return depth.otherwise(0)


def distinct_matches(t: Column, pattern: str, lower: bool = True) -> Column:
    found = F.regexp_extract_all(t, F.lit(unicode_borders(pattern)), F.lit(0))
    return F.array_distinct(F.transform(found, F.lower) if lower else found)


def numbers(t: Column) -> Column:
    return distinct_matches(t, C.NUMBER, lower=False)


def dates(t: Column) -> Column:
    return distinct_matches(t, C.DATE)


def proper_names(t: Column) -> Column:
    return distinct_matches(t, C.PROPER_NAME)


def content_words(t: Column) -> Column:
    """Distinct content words of a claim or evidence, lower-cased, without citation stop words."""
    return F.filter(distinct_matches(t, C.CONTENT_WORD), lambda w: ~w.isin(*C.CITATION_STOPWORDS))


def source_marks(t: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(t, F.lit(r"\[(S\d+)\]"), F.lit(1)))


def with_source_mark(t: Column, mark: str = "S1") -> Column:
    """t with a source mark at its end, unless it has one."""
    return F.when(t.rlike(r"\[S\d+\]"), t).otherwise(F.concat(F.rtrim(t), F.lit(f" [{mark}]")))


def renumbered(t: Column, mark: str = "S1") -> Column:
    return F.regexp_replace(t, r"\[S\d+\]", f"[{mark}]")


def _found(t: Column, pattern: str, group: int = 1) -> Column:
    x = F.regexp_extract(t, pattern, group)
    return F.when(x != "", x)


def email(t: Column) -> Column:
    return _found(t, C.EMAIL)


def cgpa(t: Column) -> Column:
    return _found(t, C.CGPA)


def degree(t: Column) -> Column:
    raw = _found(t, C.DEGREE)
    flat = F.lower(F.regexp_replace(raw, r"[.\s]", ""))
    full = F.when(flat.isin("btech", "bacheloroftechnology"), "Bachelor of Technology").when(flat.isin("mtech", "masteroftechnology"), "Master of Technology")
    return full.otherwise(raw)


def institution(t: Column) -> Column:
    """The first run of capitalised words with a word for an institution, and what it is of or for (an approximation by pattern)."""
    word = r"[A-Z][\p{L}'’.\-]*"
    return _found(t, rf"((?:{word}\s+)+(?:University|College|Institute|School|Academy)\b(?:\s+(?:of|for)\s+{word}(?:\s*(?:&|,|\band\b)?\s*{word})*)?)")


def person_name(t: Column) -> Column:
    """The first two or more capitalised words in a row (an approximation by pattern)."""
    return _found(t, r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b")


def token_set(t: Column, least: int = 2) -> Column:
    """Distinct lower-cased words of at least so many characters."""
    return F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(rf"[\p{{L}}\p{{N}}_]{{{least},}}"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def markdown_links(body: Column) -> Column:
    links = F.regexp_extract_all(body, F.lit(r"\[[^\]]+\]\(([^)]+\.md)\)"), F.lit(1))
    return F.transform(links, lambda x: F.regexp_replace(x, r"^(\./|/)+", ""))


def page_label(start: Column, end: Column) -> Column:
    span = F.concat(start.cast("string"), F.lit("-"), end.cast("string"))
    return F.when((start > 0) & (end > 0) & (start != end), span).when(start > 0, start.cast("string")).otherwise(F.lit("Unknown"))


def section_label(path: Column) -> Column:
    return F.when(F.size(path) > 0, F.array_join(path, " > ")).otherwise(F.lit("Unknown"))


def excerpt(t: Column, n: int = 300) -> Column:
    return F.substring(t, 1, n)
