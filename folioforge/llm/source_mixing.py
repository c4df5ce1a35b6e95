"""Mixing sources to target weights by temperature.

Shares p of the sources' tokens become weights proportional to p ** alpha. The
exponent is bisected to the least flattening limit asked for: an entropy of the
weights, and/or a limit on how often a source may be repeated. The budget in tokens
is given, or such that every source is used whole at least once. A source with
budget r times its tokens gives floor(r) whole epochs and a part of one more.

Realisation: a source's documents are dealt by a hash into blocks of about
BLOCK_TOKENS tokens (a document counts one besides its own). In each block the documents stand in a pseudo-random
permutation, and the part epoch takes its first documents up to the block's part of
the budget. Output rows carry epoch, block and order_key: reading by these is
the mixed order, a fresh permutation of every block in every epoch.

Only DataFrame operations. Text is read once, for its word count, and never
shuffled: the shuffles hold ids and counts; a hot source is many blocks, and rows of one id are counted together before they meet
in a block. The
sources' totals are collected (at most MAX_SOURCES rows of about 100 bytes, else an error: the exponent needs all of them). One cutoff
for each block is joined to the documents, by broadcast up to BROADCAST_BLOCKS
rows, else by a shuffle.

Defined cases: a null source is a source of its own; a null or empty text has no tokens
and comes with each whole epoch (at least one); rows of one id go together, rows without an id are told apart by their texts; an empty
table gives an empty result; extra columns are kept by `mix`, whatever their names: where one is named as an added column,
the added one gets `_mix` after its name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import durable, text_of

MAX_SOURCES = 100_000
BLOCK_TOKENS = 1_000_000
BROADCAST_BLOCKS = 500_000
#: The exponent is sought from 0 (equal weights) to this (the largest source nearly alone).
STEEPEST = 32.0


def weights(tokens: list[float], alpha: float) -> list[float]:
    """Shares to the power alpha, normalised. Sources without tokens have weight 0."""
    most = max(tokens, default=0)
    raised = [(t / most) ** alpha if t > 0 else 0.0 for t in tokens]
    total = sum(raised)
    return [x / total for x in raised] if total else raised


def entropy(w: list[float]) -> float:
    return -sum(x * math.log(x) for x in w if x > 0)


def repeats(tokens: list[float], w: list[float], budget: float | None) -> list[float]:
    """How often each source is used. Without a budget, the least used source is used once."""
    live = [x / t for t, x in zip(tokens, w, strict=True) if t > 0 and x > 0]
    if not live:
        return [1.0] * len(tokens)
    budget = 1 / min(live) if budget is None else budget
    return [budget * x / t if t > 0 else 1.0 for t, x in zip(tokens, w, strict=True)]


def _bisect(holds, low: float, high: float) -> float:
    """The least value between low and high at which `holds`, which stays true above it."""
    if holds(low):
        return low
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if holds(middle) else (middle, high)
    return high


def exponent(tokens: list[float], target_entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> float:
    """The smallest exponent whose weights keep to the entropy (nats, at most) and the repetition limit; 1 with neither."""
    if target_entropy is None and max_repeats is None:
        return 1.0
    need = [0.0]
    if target_entropy is not None:
        need.append(_bisect(lambda a: entropy(weights(tokens, a)) <= target_entropy, 0.0, STEEPEST))
    if max_repeats is not None:
        need.append(_bisect(lambda a: max(repeats(tokens, weights(tokens, a), budget), default=0) <= max_repeats * (1 + 1e-12), 0.0, 1.0))
    return max(need)


@dataclass(frozen=True)
class Plan:
    """What a mixture needs to be dealt out: sources (key, weight, whole epochs, part, blocks) and the part epoch's cutoff in each block."""

    sources: DataFrame
    cutoffs: DataFrame
    alpha: float
    seed: int


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t-\r]+")).cast("bigint")


def row_key(row_id: Column, text: Column) -> Column:
    """What places a row: its id, or its text's digest where it has none."""
    return F.coalesce(F.concat(F.lit("="), row_id.cast("string")), F.md5(text))


def _number(key: Column, *salt) -> Column:
    """A number below 2 ** 60 from a hash of a key."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key, *(x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in salt))), 1, 15), 16, 10).cast("bigint")


def _block(key: Column, blocks: Column, seed: int) -> Column:
    return F.pmod(_number(key, seed, "block"), blocks)


def counted_rows(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    """key (of the row), source_key, tokens; what a plan is made from."""
    text = text_of(docs, text_col)
    return docs.select(row_key(docs[id_col], text).alias("key"), source_key(docs[source_col]).alias("source_key"), word_count(text).alias("tokens"))


def make_plan(counted: DataFrame, target_entropy=None, max_repeats=None, budget=None, block_tokens: int = BLOCK_TOKENS, seed: int = 0) -> Plan:
    """The plan for counted rows (key, source_key, tokens)."""
    spark = counted.sparkSession
    totals = counted.groupBy("source_key").agg(F.sum("tokens").alias("t"), F.count("*").alias("rows")).orderBy("source_key").limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    tokens = [float(r.t or 0) for r in totals]
    alpha = exponent(tokens, target_entropy, max_repeats, budget)
    w = weights(tokens, alpha)
    made = [
        (r.source_key, x, int(math.floor(n + 1e-9)), max(0.0, n - math.floor(n + 1e-9)), max(1, math.ceil((t + r.rows) / block_tokens)))
        for r, t, x, n in zip(totals, tokens, w, repeats(tokens, w, budget), strict=True)
    ]
    sources = spark.createDataFrame(made, "source_key string, weight double, whole int, part double, blocks int")
    parts = counted.join(F.broadcast(sources.where("part > 0")), "source_key")
    place = {"block": _block(F.col("key"), F.col("blocks"), seed), "order": _number(F.col("key"), seed)}
    dealt = parts.select("source_key", "key", "tokens", "part", *(c.alias(n) for n, c in place.items())).groupBy("source_key", "block", "order", "key", "part").agg(F.sum("tokens").alias("tokens"))
    block = Window.partitionBy("source_key", "block")
    running = block.orderBy("order", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = dealt.withColumns({"so_far": F.sum("tokens").over(running), "all": F.sum("tokens").over(block)})
    taken = summed.where("so_far - tokens / 2 <= part * all")
    cutoffs = taken.groupBy("source_key", "block").agg(F.max("order").alias("cutoff"))
    return Plan(sources, durable(cutoffs, "cutoffs"), alpha, seed)


def added_names(columns: list[str]) -> list[str]:
    """What mix calls the columns that it adds to these."""
    out = []
    for name in ("epoch", "block", "order_key", "weight"):
        while name.lower() in {c.lower() for c in columns}:
            name += "_mix"
        out.append(name)
    return out


def deal(rows: DataFrame, plan: Plan) -> DataFrame:
    """rows (row: a struct, key, source_key) as often as the plan has them: row, epoch (from 1), block, order_key, weight."""
    placed = rows.join(F.broadcast(plan.sources), "source_key", "left")
    few = plan.cutoffs.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    placed = placed.withColumn("block", _block(F.col("key"), F.col("blocks"), plan.seed)).join(F.broadcast(plan.cutoffs) if few else plan.cutoffs, ["source_key", "block"], "left")
    copies = F.col("whole") + F.when(_number(F.col("key"), plan.seed) <= F.col("cutoff"), 1).otherwise(0)
    dealt = placed.withColumn("copies", copies).where("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return dealt.select("row", "epoch", F.col("block").cast("int").alias("block"), _number(F.col("key"), plan.seed, F.col("epoch")).alias("order_key"), "weight")


def _spread(dealt: DataFrame, columns: list[str]) -> DataFrame:
    return dealt.select(*[F.col("row")[c].alias(c) for c in columns], *[F.col(c).alias(n) for c, n in zip(("epoch", "block", "order_key", "weight"), added_names(columns), strict=True)])


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """docs dealt out by their sources' temperature weights, all columns kept; limits as in make_plan."""
    plan = make_plan(durable(counted_rows(docs, id_col, source_col, text_col), "tokens"), **limits)
    own = F.struct(*(docs[f"`{c}`"].alias(c) for c in docs.columns)).alias("row")
    rows = docs.select(own, row_key(docs[id_col], text_of(docs, text_col)).alias("key"), source_key(docs[source_col]).alias("source_key"))
    return _spread(deal(rows, plan), docs.columns)


def mix_counts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """As mix, but rows hold only doc_id, source and n_tokens besides what is added."""
    text, source = text_of(docs, text_col), docs[source_col]
    counted = docs.select(docs[id_col].alias("doc_id"), source.alias("source"), row_key(docs[id_col], text).alias("key"), source_key(source).alias("source_key"), word_count(text).alias("tokens"))
    counted = durable(counted, "tokens")
    own = F.struct("doc_id", "source", F.col("tokens").alias("n_tokens")).alias("row")
    return _spread(deal(counted.select(own, "key", "source_key"), make_plan(counted.select("key", "source_key", "tokens"), **limits)), ["doc_id", "source", "n_tokens"])
