"""Vocabularies, patterns and weights that results depend on."""

import unicodedata

# Query stop words of full-text search.
QUERY_STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "could", "did", "do", "does", "for", "from", "had", "has", "have", "how", "i", "if", "in",
    "into", "is", "it", "its", "of", "on", "or", "our", "that", "the", "their", "there", "these", "this", "those", "to", "was", "were", "what", "when",
    "where", "which", "who", "whom", "why", "will", "with", "you", "your", "many", "much", "tell", "me", "about", "please",
)

# Stop words of concept phrases.
CONCEPT_STOPWORDS = (
    "the", "and", "for", "with", "from", "this", "that", "are", "was", "were", "have", "has", "into", "shall", "will", "should", "would", "could", "been",
    "being", "their", "there", "where", "when", "what", "which", "while", "about", "above", "after", "again", "against", "also", "among", "before", "below",
    "between", "both", "during", "each", "either", "further", "here", "however", "more", "most", "neither", "none", "other", "over", "same", "some", "such",
    "than", "then", "these", "those", "through", "under", "until", "upon", "within", "without", "your", "you", "they", "them", "its", "our", "his", "her",
    "all", "any", "but", "not", "may", "can",
)

# Stop words of citation checks.
CITATION_STOPWORDS = (
    "the", "and", "for", "with", "that", "this", "from", "into", "onto", "was", "were", "are", "has", "have", "had", "its", "their", "there", "source",
    "according", "citation",
)

# Words of one direction; a claim with one of a group needs evidence with one of the same group.
DIRECTIONS = (
    ("increase", "increased", "increases", "increasing", "rise", "rose", "up"),
    ("decrease", "decreased", "decreases", "decreasing", "fall", "fell", "down"),
    ("before", "prior", "earlier"),
    ("after", "following", "later"),
    ("above", "over", "greater"),
    ("below", "under", "less"),
)

# Question classes, the first whose words stand in the question wins.
QUESTION_CLASSES = (
    ("fast_fact", r"name|email|phone|contact|address|date|location|college|university|institute|school|academy|campus|department|dept|cgpa|gpa|percentage"),
    ("topic", r"what is|what are|define|explain|describe|details? about"),
    ("comparison", r"compare|versus|vs\.?"),
    ("summary", r"summarize|summary|overview"),
    ("numeric_or_table", r"table|highest|lowest|total|amount|number"),
    ("exact_identifier", r"id|order|clause|section|code"),
)

# Patterns of questions with a short factual answer (words bounded on both sides).
FAST_FACT = (
    r"what['s| ]+(is|are|was|were)",
    r"define",
    r"meaning\s+of",
    r"what\s+does\s+.*\s+mean",
    r"who\s+(is|was|were|are|did|wrote|directed|built)",
    r"creator\s+of",
    r"when\s+(is|was|did|were|are|happened|occurred)",
    r"(date|year)\s+of",
    r"where\s+(is|was|are|were|located|situated|find)",
    r"headquarters\s+of",
    r"how\s+(many|much|tall|old|far|long|heavy|fast)",
    r"population\s+of",
    r"age\s+of",
    r"(list\s+of|name\s+all|give\s+me\s+a\s+list)",
    r"(name|college|collage|institute|university|school|academy|campus|dept|department)",
)

# Extraction patterns.
EMAIL = r"(?i)([A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,})"
CGPA = r"(?i)(?:^|[^\p{L}\p{N}_])C?GPA\s*(?:[:=\-]|is|of)?\s*([0-9]+(?:\.[0-9]+)?)"
DEGREE = r"(?i)(?:^|[^\p{L}\p{N}_])(B\.?\s?Tech|BTECH|Bachelor of Technology|M\.?\s?Tech|MTECH|Master of Technology|B\.?\s?E\.?|BCA|MCA|BSc|MSc|MBA)(?:$|[^\p{L}\p{N}_])"
NUMBER = r"\b\d+(?:\.\d+)?%?\b"
DATE = r"(?i)\b(?:\d{4}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4})\b"
PROPER_NAME = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"
CONTENT_WORD = r"\b[a-zA-Z][a-zA-Z0-9'-]{2,}\b"
TOKEN = r"[A-Za-z0-9_]+(?:[-'][A-Za-z0-9_]+)?"
DEFINITION_QUESTION = r"\b(what is|what are|define|explain|describe|tell me(?: everything| all)? about|everything about)\b"

# Comparisons; their words, and the two sides around a joining word.
COMPARISON_WORD = r"(?i)(?:^|[^\p{L}\p{N}_])(?:compare|comparison|difference|between)(?=$|[^\p{L}\p{N}_])"
COMPARISON = r"(?i)^(?:\s*(?:compare|comparison|difference(?:\s+between)?))?\s*(.+?)\s+(?:vs\.?|versus|and|with|to)\s+(.+?)\s*\??$"

# Headings of outlines; limits of characters and words, and what they don't end with.
OUTLINE_HEADING = r"^(?:\d+[\.\d]*\s+)?[A-Z][A-Za-z0-9 \-,:'\"]{0,90}$"
OUTLINE_CHARS, OUTLINE_WORDS = 100, 14
OUTLINE_END = r"[.?!,;]$"

# Words of a question about a topic, for debugging.
TOPIC_WORDS = ("everything about", "tell me", "explain")

# Heading detection.
HEADING_PATTERNS = ((r"^\s*\d+\.\d+\.\d+[\s.]", 3), (r"^\s*\d+\.\d+[\s.]", 2), (r"^\s*\d+[\s.]", 1), (r"(?i)^\s*(chapter|section|part)\s+[\p{L}\p{N}_]+", 1))
HEADING_WEIGHTS = {"numbering": 0.9, "caps": 0.7, "size": 0.6, "bold": 0.5, "short": 0.2, "spacing": 0.25, "indent": 0.1, "long": -0.4}
HEADING_THRESHOLD = 0.5

# State vocabularies.
NODE_TYPES = ("document", "chapter", "section", "subsection", "paragraph", "table", "list")
DOCUMENT_STATES = ("pending", "processing", "ready", "failed")
JOB_STATES = ("queued", "parsing", "cleaning", "structuring", "chunking", "indexing", "generating_okf", "completed", "failed", "cancelled")
JOB_TERMINAL = ("completed", "failed", "cancelled")
DOCUMENT_TERMINAL = ("ready", "failed")

# What a job's log tells of each stage, and the state that it is in meanwhile.
JOB_STAGES = (
    ("queued", "Queued"), ("parsing", "Parsing layout"), ("cleaning", "Cleaning text"), ("structuring", "Detecting structure"), ("chunking", "Building nodes"),
    ("indexing", "Indexing full text"), ("indexing", "Indexing headings"), ("completed", "Completed"),
)

# Combining marks that full-text search drops, and letters that it reads as another one.
FOLD_DROPPED = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u0309\u030a\u030b\u030c\u030f\u0311\u031b\u0323\u0324\u0325\u0326\u0327\u0328\u032d\u032e\u0330\u0331"
FOLD_LETTERS = {"µ": "μ", "ſ": "s", "ẛ": "s", "ς": "σ", "ϐ": "β", "ϑ": "θ", "ϕ": "φ", "ϖ": "π", "ϰ": "κ", "ϱ": "ρ", "ϵ": "ε"}


def _latin() -> dict[str, str]:
    """Lower-case Latin letters with one diacritic, and the letter without it."""
    parts = {c: unicodedata.normalize("NFD", c) for c in map(chr, range(0xC0, 0x1F00)) if c == c.lower()}
    return {c: d[0] for c, d in parts.items() if len(d) == 2 and d[0].isascii() and unicodedata.combining(d[1])}


#: What `translate` needs to fold a lower-cased text as full-text search does; characters beyond FOLD_TO's length are dropped.
_FOLDED = _latin() | FOLD_LETTERS
FOLD_FROM, FOLD_TO = "".join(_FOLDED) + FOLD_DROPPED, "".join(_FOLDED.values())

# Fixed value: the answer where evidence is missing.
NO_EVIDENCE = "I could not find sufficient evidence in the documents to answer this question."
