"""Token counts through a digest cache.

Texts are looked up by (digest of the normalised text, digest of the tokenizer's
file and of the normal form's name). Only distinct normalised texts that the cache lacks are encoded; their counts are
appended to the cache, one row for each digest, and all documents take their count from it by a join on
the digest.

A normal form must keep the counts: `folded` (white space in a row is one space, none at the ends; A-Z in lower
case) does so for tokenizers that drop white space and fold case themselves, and leaves texts with '<|' their case, as
strings of special tokens are found before folding. `as_it_is` does for every tokenizer.

The cache is a Parquet folder (digest binary, version string, n_tokens bigint).
Appends never change existing rows, so a failed run leaves a valid cache. Two
runs at once may both append a digest; readers take the larger of equal counts.

Which row is encoded: of the rows of a missing digest those with the least id. Rows that share digest and id, or have no id,
are told apart within a task only: each task encodes a digest once, and one of equal counts is appended.
Rows that need no encoding (copies, and texts that the cache has) are kept out by an anti-join on (id, digest): by broadcast up
to broadcast_rows of them, else by a shuffle, which moves the texts once.

Inside a task, words between spaces and line feeds are counted once and remembered
(at most MEMO of them): the tokenizer's pattern never matches across white space,
so a text's count is the sum over them.

Defined cases: a null text is the empty text (0 bytes, 0 tokens); repeated rows
each give a row; rows with a null id are counted like others; an empty table
gives an empty result and leaves the cache as it was; extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, drop, durable, lean, text_of, trim

MEMO = 300_000
#: Most rows of id and digest that are broadcast (40 bytes each); beyond it the same join is shuffled.
BROADCAST_ROWS = 1_000_000
CACHE_SCHEMA = "digest binary, version string, n_tokens bigint"

_loaded: dict = {}


def as_it_is(text: Column) -> Column:
    return text


def folded(text: Column) -> Column:
    """One space for white space in a row (0x20, 0x09-0x0D), none at the ends, and A-Z in lower case where no '<|' stands."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    one = F.trim(F.regexp_replace(text, r"[ \t-\r]+", " "))
    return F.when(F.contains(text, F.lit("<|")), one).otherwise(F.translate(one, upper, upper.lower()))


def _counter(tokenizer_json: bytes, memo: dict[str, int]):
    """A function from a text to its token count; words' counts are remembered in memo."""
    key = hash(tokenizer_json)
    if key not in _loaded:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json.decode())
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded.clear()
        _loaded[key] = tokenizer
    tokenizer = _loaded[key]

    def count(text: str) -> int:
        words = text.replace("\n", " ").split(" ")
        if new := [w for w in set(words) if w not in memo]:
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = list(set(words))
            memo.update(zip(new, (len(e.ids) for e in tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        return sum(map(memo.__getitem__, words))

    return count


def _count_misses(batches: Iterator[pa.RecordBatch], tokenizer_json: bytes) -> Iterator[pa.RecordBatch]:
    """(digest, n_tokens) of rows (digest, text), each digest once."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    lean()
    memo: dict[str, int] = {}
    count, done = _counter(tokenizer_json, memo), set()
    try:
        for batch in batches:
            digests = batch.column(0).to_pylist()
            new = [i for i, d in enumerate(digests) if d not in done and not done.add(d)]
            yield pa.record_batch([pa.array([digests[i] for i in new], pa.binary()), pa.array([count(batch.column(1)[i].as_py()) for i in new], pa.int64())], ["digest", "n_tokens"])
    finally:
        memo.clear()
        trim()


def read_cache(spark: SparkSession, cache_path: str) -> DataFrame:
    """The cache's rows; none where the folder isn't there yet."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(cache_path)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache_path)


def token_counts(docs: DataFrame, tokenizer_json: bytes, cache_path: str, id_col: str = "doc_id", text_col: str = "text", normal: Callable[[Column], Column] = as_it_is, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, digest (of the normalised text), n_tokens."""
    spark = docs.sparkSession
    bounded_batches(spark)
    version = hashlib.sha256(tokenizer_json).hexdigest() + ":" + normal.__name__
    raw = text_of(docs, text_col)
    texts = docs.select(docs[id_col].alias("doc_id"), F.octet_length(raw).cast("bigint").alias("n_bytes"), normal(raw).alias("text"))
    digested = texts.select("doc_id", "n_bytes", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    keyed = durable(digested.drop("text"), "digests")
    known = lambda: read_cache(spark, cache_path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    firsts = keyed.groupBy("digest").agg(F.min("doc_id").alias("first_id"))
    missing = firsts.join(known(), "digest", "left_anti")
    # Rows that need no encoding. A row without an id does only where no row of its digest has one.
    spare = keyed.join(missing.withColumn("is_missing", F.lit(True)), "digest", "left").where("is_missing is null or not (doc_id <=> first_id)")
    spare = durable(spare.select(F.col("doc_id").alias("spare_id"), F.col("digest").alias("spare_digest")).distinct(), "spare")
    few = F.broadcast(spare) if spare.limit(broadcast_rows + 1).count() <= broadcast_rows else spare
    on = digested["doc_id"].eqNullSafe(few["spare_id"]) & (digested["digest"] == few["spare_digest"])
    misses = digested.join(few, on, "left_anti").select("digest", "text")
    counted = durable(misses.mapInArrow(lambda b: _count_misses(b, tokenizer_json), "digest binary, n_tokens bigint"), "counted")
    new = counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    new.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache_path)
    drop(spare, counted)
    return keyed.join(known(), "digest").select("doc_id", "n_bytes", "digest", "n_tokens")
