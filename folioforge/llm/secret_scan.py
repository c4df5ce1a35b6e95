"""Secret scans: rules, and character Markov models for what the rules miss.

Rules (kinds assign, access, hex) find leftmost non-overlapping matches by regular
expressions. The method then judges every run of RUN_MIN or more characters of
ALPHABET: two first-order character models, of random strings and of ordinary
identifiers, both trained from labelled samples, are compared by their
log-likelihood ratio. A stretch of a run whose ratio reaches THRESHOLD is a span of
kind markov: the sum runs along the run, begins anew where it falls to 0, and a stretch
ends where it has fallen by DROP below its best. So a secret behind a long ordinary path is
found; a stretch that leaves fewer than EDGE characters of the run at an end takes them too.

The ordinary model counts the words of all documents (a word's steps, weighted by how often it stands
there, alone and joined with itself by '_' and by a capital).

Only DataFrame operations, in time linear in the text's length and its matches: a match's place
is a running sum of the lengths of the pieces between matches (split) and the matches
(regexp_extract_all), summed in blocks; places in bytes are kept beside those in code points, so
that pieces are cut without counting from the start. The models are one constant array of
log-ratios (WIDTH x WIDTH, whatever the input). Rows are independent: scanning needs no
shuffle, and no text is cut. Training shuffles distinct words with their counts.

Defined cases: a null text is the empty text and has no spans; places count code
points from 0, ends are exclusive; equal starts are ordered by kind as listed; a stretch
that overlaps a rule's span is left out. Samples with a null text or label are
left out; with no samples of a kind its model is uniform. Rare contexts lean on the frequencies of single
characters; characters outside ALPHABET count as one by their bytes. Repeated rows each give a row, null ids are kept, an empty
table gives an empty result, extra columns are left out unless named in `keep`.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import text_of

# The rules' patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 12, 18, 16

#: Equal to matches of at least the least length: both patterns match whole runs, whose end a shorter match shares.
_ACCESS_LONG = rf"{ACCESS[:-1]}{{{ACCESS_MIN - 4},}}"
_HEX_LONG = rf"(?<![0-9a-f]){HEX[:-1]}{{{HEX_MIN},}}"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN_MIN = 20
RUN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{RUN_MIN},}}"
WIDTH = len(ALPHABET) + 1
#: Nats by which a stretch must be likelier random than ordinary, and by which a sum may fall within a stretch.
THRESHOLD, DROP = 15.0, 15.0
#: Characters left over at an end of a run that a stretch takes along.
EDGE = 8
#: Made random strings that serve as samples of label 1.
SAMPLE_RANDOM = 6_000
#: Values that a running operation copies at once.
BLOCK = 256

_SPAN = "struct<start:int,kind:int,end:int,from:int,to:int>"


def let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join, zero: Column, kind: str) -> Column:
    """The running results of an associative operation over an array: in blocks, as appending copies."""

    def plain(xs: Column) -> Column:
        start = F.struct(zero.alias("v"), F.array().cast(f"array<{kind}>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            v = join(acc["v"], x)
            return F.struct(v.alias("v"), F.concat(acc["out"], F.array(v)).alias("out"))

        return F.aggregate(xs, start, step, lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        before = plain(F.concat(F.array(zero), F.transform(F.slice(blocks, 1, F.size(blocks) - 1), lambda w: F.element_at(w, -1))))
        return F.flatten(F.zip_with(blocks, before, lambda w, o: F.transform(w, lambda x: join(o, x))))

    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: plain(F.slice(values, k * BLOCK + 1, F.lit(BLOCK))))
    return F.when(F.size(values) <= BLOCK, plain(values)).otherwise(let(cut, joined))


def _ends(pieces: Column, matches: Column) -> Column:
    """Where each piece and each match ends, in code points (c) and bytes (b), in turn."""
    size = lambda x: F.struct(F.char_length(x).alias("c"), F.octet_length(x).alias("b"))
    lengths = F.flatten(F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda p, m: F.array(size(p), size(m))))
    add = lambda x, y: F.struct((x["c"] + y["c"]).alias("c"), (x["b"] + y["b"]).alias("b"))
    return let(lengths, lambda n: running(n, add, F.struct(F.lit(0).alias("c"), F.lit(0).alias("b")), "struct<c:int,b:int>"))


def _placed(matches: Column, ends: Column, kind: int) -> Column:
    """array<start, kind, end, from, to, match>"""

    def one(m: Column, i: Column) -> Column:
        a, z = F.get(ends, 2 * i), F.get(ends, 2 * i + 1)
        return F.struct(a["c"].alias("start"), F.lit(kind).alias("kind"), z["c"].alias("end"), a["b"].alias("from"), z["b"].alias("to"), m.alias("match"))

    return F.transform(matches, one)


def _bare(spans: Column) -> Column:
    return F.coalesce(F.transform(spans, lambda s: F.struct(*(s[n].alias(n) for n in ("start", "kind", "end", "from", "to")))), F.array().cast(f"array<{_SPAN}>"))


def _constant(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _codes(text: Column) -> Column:
    """For each byte of a text 1 and on if it is a character of ALPHABET, else 0."""
    table = _constant([ALPHABET.find(chr(k)) + 1 if k else 0 for k in range(128)], "int")
    one = lambda data, i: F.coalesce(F.get(table, F.ascii(data.substr(i, F.lit(1)).cast("string"))), F.lit(0))
    return F.when(F.octet_length(text) > 0, let(text.cast("binary"), lambda data: F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: one(data, i))))


def _steps(codes: Column) -> Column:
    """For each character WIDTH times the code before it (0 at the start), and its own."""
    return F.transform(codes, lambda c, i: F.when(i == 0, F.lit(0)).otherwise(F.get(codes, i - 1)) * WIDTH + c)


def train(samples: DataFrame, smoothing: float = 10.0) -> list[float]:
    """Log-ratios log P(b | a, random) - log P(b | a, ordinary), row by row of a (0: the start).

    samples: text, label (1 random, 0 ordinary) and, if there, n (how often it counts). At most 2 * WIDTH ** 2 counts reach the driver.
    """
    n = samples["n"].cast("bigint") if "n" in samples.columns else F.lit(1)
    clean = samples.select(samples["text"].cast("string").alias("t"), samples["label"].cast("int").alias("label"), n.alias("n")).where("t is not null and label in (0, 1) and t <> ''")
    steps = clean.select("label", "n", F.explode(let(_codes(F.col("t")), _steps)).alias("step"))
    counts = {(r.label, *divmod(r.step, WIDTH)): r.n for r in steps.groupBy("label", "step").agg(F.sum("n").alias("n")).collect()}
    logs = []
    for label in (1, 0):
        rows = [[counts.get((label, x, y), 0) for y in range(WIDTH)] for x in range(WIDTH)]
        alone = [sum(row[y] for row in rows) + 0.5 for y in range(WIDTH)]  # characters whatever stands before, for rare contexts
        alone = [v / sum(alone) for v in alone]
        logs += [[math.log((n + smoothing * p) / (sum(row) + smoothing)) for n, p in zip(row, alone, strict=True)] for row in rows]
    return [r - o for x in range(WIDTH) for r, o in zip(logs[x], logs[WIDTH + x], strict=True)]


def samples_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Labelled samples with their numbers: made random strings (label 1), and the words and numbers of all documents, alone and joined (label 0)."""
    spark: SparkSession = docs.sparkSession
    number = spark.range(0, SAMPLE_RANDOM, 1, 1).select(F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 256).alias("h"), "id")
    code = F.when(F.col("id") % 3 == 0, F.substring("h", 1, 40)).otherwise(F.substring(F.translate(F.base64(F.unhex("h")), "\r\n", ""), 1, 40))
    random = number.select(code.alias("text"), F.lit(1).alias("label"), F.lit(1).cast("bigint").alias("n"))
    words = docs.select(F.explode(F.regexp_extract_all(text_of(docs, text_col), F.lit(r"[A-Za-z]{3,}|[0-9]{4,}"), F.lit(0))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    forms = words.select("n", F.explode(F.array("w", F.concat("w", F.lit("_"), "w"), F.concat("w", F.initcap("w")))).alias("text"))
    return random.unionByName(forms.select("text", F.lit(0).alias("label"), "n"))


def log_ratios(run: Column, model: list[float]) -> Column:
    """How much likelier each character of a run is after the one before it under the random model, in nats."""
    table = _constant([round(x, 6) for x in model], "double")
    return let(_codes(run), lambda codes: F.transform(_steps(codes), lambda k: F.get(table, k)))


def log_ratio(run: Column, model: list[float]) -> Column:
    """The sum of log_ratios; 0 for the empty run."""
    return F.coalesce(F.aggregate(log_ratios(run, model), F.lit(0.0), lambda acc, x: acc + x), F.lit(0.0))


def stretches(ratios: Column) -> Column:
    """array<begin, end> of the stretches that reach THRESHOLD and RUN_MIN, in order."""
    none = F.array().cast("array<struct<begin:int,end:int>>")
    zero = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("sum"), F.lit(0).alias("since"), F.lit(0.0).alias("best"), F.lit(0).alias("begin"), F.lit(0).alias("end"), none.alias("out"))

    def kept(acc: Column) -> Column:
        return F.when((acc["best"] >= THRESHOLD) & (acc["end"] - acc["begin"] >= RUN_MIN), F.concat(acc["out"], F.array(F.struct(acc["begin"].alias("begin"), acc["end"].alias("end"))))).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        # `sum` belongs to the characters before; a sum that isn't above 0, or has fallen too far, is over.
        over = (acc["sum"] <= 0) | (acc["sum"] < acc["best"] - DROP)
        now = F.when(over, F.lit(0.0)).otherwise(acc["sum"]) + x
        since = F.when(over, acc["i"]).otherwise(acc["since"])
        best = F.when(over, F.lit(0.0)).otherwise(acc["best"])
        better = now > best
        return F.struct(
            (acc["i"] + 1).alias("i"), now.alias("sum"), since.alias("since"), F.greatest(now, best).alias("best"), F.when(better, since).otherwise(acc["begin"]).alias("begin"),
            F.when(better, acc["i"] + 1).otherwise(acc["end"]).alias("end"), F.when(over, kept(acc)).otherwise(acc["out"]).alias("out"),
        )

    return F.aggregate(ratios, zero, step, kept)


def _judged(run: Column, model: list[float]) -> Column:
    """The spans of kind markov in a placed run."""
    n = F.octet_length(run["match"])

    def span(s: Column) -> Column:
        a, z = F.when(s["begin"] < EDGE, F.lit(0)).otherwise(s["begin"]), F.when(n - s["end"] < EDGE, n).otherwise(s["end"])
        return F.struct((run["start"] + a).alias("start"), F.lit(3).alias("kind"), (run["start"] + z).alias("end"), (run["from"] + a).alias("from"), (run["from"] + z).alias("to"))

    return F.transform(stretches(log_ratios(run["match"], model)), span)


def _apart(added: Column, base: Column) -> Column:
    """The spans in added that overlap none in base (which are in order)."""

    def chosen(all_: Column) -> Column:
        rule = lambda s: s["kind"] < 3
        reach = running(F.transform(all_, lambda s: F.when(rule(s), s["end"]).otherwise(F.lit(-1))), F.greatest, F.lit(-1), "int")
        ahead = F.reverse(running(F.reverse(F.transform(all_, lambda s: F.when(rule(s), s["start"]).otherwise(F.lit(2**31 - 1)))), F.least, F.lit(2**31 - 1), "int"))
        both = F.zip_with(F.zip_with(all_, reach, lambda s, r: F.struct(s.alias("s"), r.alias("r"))), ahead, lambda x, a: F.struct(x["s"].alias("s"), ((x["r"] <= x["s"]["start"]) & (a >= x["s"]["end"])).alias("free")))
        return F.transform(F.filter(both, lambda x: (x["s"]["kind"] == 3) & x["free"]), lambda x: x["s"])

    return F.when((F.size(added) == 0) | (F.size(base) == 0), added).otherwise(let(F.array_sort(F.concat(base, added)), chosen))


def secret_spans(docs: DataFrame, model: list[float], id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row of docs: doc_id, scanned (the text), base and added (arrays of start, kind, end, and from, to in bytes; kind an index of KINDS),
    and the columns in keep."""
    others = [F.col(f"kept_{n}") for n in range(len(keep or []))]
    rows = docs.select(docs[id_col].alias("doc_id"), text_of(docs, text_col).alias("scanned"), *[docs[f"`{c}`"].alias(f"kept_{n}") for n, c in enumerate(keep or [])])
    patterns = (ASSIGN, _ACCESS_LONG, _HEX_LONG, RUN)
    found = rows.withColumns({f"m{k}": F.regexp_extract_all("scanned", F.lit(p), F.lit(0)) for k, p in enumerate(patterns)})
    placed = found.withColumns({f"e{k}": F.when(F.size(f"m{k}") > 0, _ends(F.split("scanned", p, -1), F.col(f"m{k}"))) for k, p in enumerate(patterns)})
    placed = placed.withColumns({f"p{k}": F.when(F.size(f"m{k}") > 0, _placed(F.col(f"m{k}"), F.col(f"e{k}"), k)) for k in range(len(patterns))})
    long_enough = F.filter("p0", lambda s: F.char_length(F.regexp_extract(s["match"], ASSIGN, 2)) >= ASSIGN_MIN)
    spans = placed.select(
        "doc_id", "scanned", *others, F.array_sort(F.concat(_bare(long_enough), _bare(F.col("p1")), _bare(F.col("p2")))).alias("base"),
        F.coalesce(F.flatten(F.transform("p3", lambda run: _judged(run, model))), F.array().cast(f"array<{_SPAN}>")).alias("judged"),
    )
    return spans.select("doc_id", "scanned", "base", _apart(F.col("judged"), F.col("base")).alias("added"), *[c.alias(name) for c, name in zip(others, keep or [], strict=True)])


def spans_text(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every stretch that spans cover replaced by mark; overlapping spans are one stretch."""

    def clean(data: Column, sorted_: Column, reach: Column) -> Column:
        cut = lambda a, n: data.substr(a + 1, n).cast("string")

        def before(s: Column, i: Column) -> Column:
            done = F.when(i == 0, F.lit(0)).otherwise(F.get(reach, i - 1))
            return F.when(s["from"] >= done, F.concat(cut(done, s["from"] - done), F.lit(mark))).otherwise(F.lit(""))

        return F.concat(F.array_join(F.transform(sorted_, before), ""), cut(F.element_at(reach, -1), F.octet_length(data)))

    ends = lambda s: running(F.transform(s, lambda x: x["to"]), F.greatest, F.lit(0), "int")
    whole = let(text.cast("binary"), lambda data: let(F.array_sort(spans), lambda s: let(ends(s), lambda reach: clean(data, s, reach))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)
