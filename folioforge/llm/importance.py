"""Target-distribution importance resampling with hashed n-grams, long texts cut into overlapping chunks.

A text's features are its runs of 1 to n consecutive words; each falls into one of `buckets` by its CRC-32. Documents resemble the target where
their features fall into buckets that the target fills more than the corpus: the gains of a document's features add up to its weight, and Gumbel noise that
depends on the id alone makes the highest scores a sample without replacement.

Texts of more than LONG bytes would keep one task busy while others are done. They are cut into chunks of about LONG bytes at word
boundaries, and dealt to all tasks. A chunk owns the features that start in it and carries the n - 1 words behind it, so features that run over its end are
whole, and every feature is counted once. Chunks' counts and weights are summed by document.

Corpus and target counts are `buckets` numbers: each task adds up its own, and the gains (as many) go to the workers with the task.
Ranks come from one sort by ranges of the scores: a row's place is the number of rows in earlier ranges plus its place in its own.

Defined cases: a null text is the empty text; without words: no features, weight 0; a null id has the noise of the word 'null' and comes last among ties;
repeated rows are counted, scored and ranked each; empty tables give an empty result; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bounded_batches, drop, durable, lean, text_of, trim
from .wordhash import slices

#: Bytes from which on a text is cut, and of a chunk.
LONG = 1 << 16
#: Features that are longer are hashed one by one, others together byte by byte.
LENGTHY = 64
#: Bytes hashed together.
TOGETHER = 2 << 20

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Bytes of words after lowering: 0-9, a-z and all of other letters.
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[97:123] = _INSIDE[128:] = True


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_CRC = _crc_table()


def crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of the stretches of data."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    c = np.full(len(start), 0xFFFFFFFF, np.uint32)
    lengthy = int(np.searchsorted(-length, -LENGTHY, side="left"))
    for i in range(lengthy):
        c[i] = zlib.crc32(data[start[i] : start[i] + length[i]].tobytes()) ^ 0xFFFFFFFF
    # The stretches still open at byte j are the first ones behind the lengthy.
    for j in range(int(length[lengthy]) if lengthy < len(length) else 0):
        open_ = slice(lengthy, int(np.searchsorted(-length, -j, side="left")))
        c[open_] = _CRC[(c[open_] ^ data[start[open_] + j]) & 0xFF] ^ (c[open_] >> np.uint32(8))
    out = np.empty(len(c), np.uint32)
    out[order] = c ^ np.uint32(0xFFFFFFFF)
    return out


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(_INSIDE[data], prepend=False, append=False))
    return edge[::2], edge[1::2]


def features(texts: list[bytes], n: int, buckets: int, own: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, text of each feature, words of each text). own: how many first words a text's features may start at (None: all)."""
    data = np.frombuffer(b" ".join(texts).translate(_LOWER) + b" ", np.uint8)
    begin_of = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    start, end = _words(data)
    text = np.searchsorted(begin_of, start, side="right") - 1
    words = np.bincount(text, minlength=len(texts))
    first = np.cumsum(words) - words
    most = np.array([w if o is None else min(o, w) for o, w in zip(own, words.tolist(), strict=True)], np.int64)
    owned = np.arange(len(start)) - first[text] < most[text]
    # Runs of m words joined by one space: their bytes side by side, words and spaces in turn.
    told, of = [crcs(data, start[owned], end[owned])], [text[owned]]
    for m in range(2, n + 1):
        at = np.flatnonzero(owned[: len(start) - m + 1] & (text[: len(start) - m + 1] == text[m - 1 :])) if len(start) >= m else np.zeros(0, np.int64)
        told.append(np.array([zlib.crc32(b" ".join(data[start[i + j] : end[i + j]].tobytes() for j in range(m))) for i in at.tolist()], np.uint32))
        of.append(text[at])
    return np.concatenate(told).astype(np.int64) % buckets, np.concatenate(of), most


def cut(text: bytes, n: int, size: int) -> Iterator[tuple[bytes, int]]:
    """(chunk, words that it owns): a chunk's own words end `size` bytes behind its start at most, or with its first word; n - 1 words more are carried.
    A text without words is one empty chunk."""
    start, end = _words(np.frombuffer(text.translate(_LOWER), np.uint8))
    at = 0
    while at < len(start):
        z = max(at + 1, int(np.searchsorted(end, start[at] + size, side="right")))
        yield text[start[at] : end[min(z + n - 1, len(end)) - 1]], z - at
        at = z
    if not len(start):
        yield b"", 0


# Tasks


def _chunked(batches: Iterator[pa.RecordBatch], n: int, size: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, row, text) as (doc_id, row, chunk, own, text)."""
    lean()
    for batch in batches:
        for i in range(batch.num_rows):
            doc, row = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            held: list[tuple] = []
            for k, (piece, own) in enumerate(cut(batch.column(2)[i].as_py(), n, size)):
                held.append((doc, row, k, own, piece))
                if len(held) * size >= TOGETHER:
                    yield _chunk_batch(held)
                    held = []
            if held:
                yield _chunk_batch(held)
    trim()


def _chunk_batch(held: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
    return pa.record_batch([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], ["doc_id", "row", "chunk", "own", "text"])


def _features_of(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[tuple[pa.RecordBatch, int, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Features of rows (..., own, text), some texts at a time, with the batch and the place of their first one."""
    lean()
    for batch in batches:
        own = batch.column("own").to_pylist()
        for begin, texts in slices(batch.column("text"), TOGETHER):
            yield batch, begin, features(texts, n, buckets, own[begin : begin + len(texts)])
    trim()


def _counts(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """(bucket, features) of all rows of a task."""
    total = np.zeros(buckets, np.int64)
    for _, _, (bucket, _, _) in _features_of(batches, n, buckets):
        total += np.bincount(bucket, minlength=buckets)
    held = np.flatnonzero(total)
    yield pa.record_batch([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])


def _weighed(batches: Iterator[pa.RecordBatch], n: int, gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, row, n_words, n_features, weight) of rows (doc_id, row, own, text)."""
    for batch, begin, (bucket, text, words) in _features_of(batches, n, len(gains)):
        weight = np.bincount(text, gains[bucket], minlength=len(words)).astype(np.int64)  # exact up to 2 ** 53
        yield pa.record_batch(
            [batch.column("doc_id").slice(begin, len(words)), batch.column("row").slice(begin, len(words)), pa.array(words), pa.array(np.bincount(text, minlength=len(words))), pa.array(weight)],
            ["doc_id", "row", "n_words", "n_features", "weight"],
        )


# The operator


def _short(docs: DataFrame, id_col: str | None, text_col: str, size: int) -> DataFrame:
    doc = docs[id_col].cast("bigint") if id_col else F.lit(None).cast("bigint")
    text = text_of(docs, text_col)
    return docs.where(F.octet_length(text) <= size).select(doc.alias("doc_id"), F.lit(None).cast("bigint").alias("row"), F.lit(None).cast("bigint").alias("own"), text.cast("binary").alias("text"))


def _chunks(docs: DataFrame, id_col: str | None, text_col: str, n: int, size: int) -> DataFrame:
    """Chunks of the long texts, dealt to all tasks, at rest."""
    doc = docs[id_col].cast("bigint") if id_col else F.lit(None).cast("bigint")
    text = text_of(docs, text_col)
    long_ = docs.where(F.octet_length(text) > size).select(doc.alias("doc_id"), F.monotonically_increasing_id().alias("row"), text.cast("binary").alias("text"))
    cut_ = long_.mapInArrow(lambda b: _chunked(b, n, size), "doc_id bigint, row bigint, chunk int, own bigint, text binary")
    return durable(cut_.repartition("row", "chunk"), "chunks")


def bucket_counts(pieces: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Features of all pieces (own, text) by bucket."""
    told = pieces.select("own", "text").mapInArrow(lambda b: _counts(b, n, buckets), "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in told.collect():  # at most `buckets` rows
        out[r.bucket] = r.n
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of shares) of each bucket, each count one larger."""
    buckets, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.float64)


def noise(doc_id: Column, seed: str) -> Column:
    """Gumbel noise in thousandths, from the id alone."""
    told = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8)
    return F.floor(-1000 * F.log(-F.log((F.conv(told, 16, 10).cast("bigint") + 0.5) / 4294967296)))


def resample(
    docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10000, least_words: int = 20, percent: int = 10, seed: str = "2024",
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", size: int = LONG,
) -> DataFrame:
    """Per row of docs: doc_id, n_features, weight, score, rank. Of the documents with least_words words or more, `percent` in a hundred are drawn and ranked from 1."""
    spark = docs.sparkSession
    bounded_batches(spark)
    columns = ("doc_id", "row", "own", "text")
    short, chunks = _short(docs, id_col, text_col, size), _chunks(docs, id_col, text_col, n, size)
    aims = _chunks(target, None, target_col, n, size)
    corpus = bucket_counts(short.unionByName(chunks.select(*columns)), n, buckets)
    gains = bucket_gains(corpus, bucket_counts(_short(target, None, target_col, size).unionByName(aims.select(*columns)), n, buckets))
    schema = "doc_id bigint, row bigint, n_words bigint, n_features bigint, weight bigint"
    weighed = lambda pieces: pieces.select(*columns).mapInArrow(lambda b: _weighed(b, n, gains), schema)
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]
    whole = weighed(chunks).groupBy("row", "doc_id").agg(*sums).drop("row")
    rows = durable(weighed(short).drop("row").unionByName(whole).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scores")
    in_order = rows.repartitionByRange(F.desc(F.col("n_words") >= least_words), F.desc("score"), F.asc_nulls_last("doc_id"))
    in_order = in_order.sortWithinPartitions(F.desc(F.col("n_words") >= least_words), F.desc("score"), F.asc_nulls_last("doc_id"))
    # The id is the partition's number before a row's place in it.
    placed = durable(in_order.withColumn("place", F.monotonically_increasing_id()), "placed")
    drop(chunks, aims, rows)
    part = F.shiftright("place", 33)
    ends, before = [], 0
    for r in sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):  # a row for each partition
        ends.append((r.part, before))
        before += r.n
    drawn = placed.where(F.col("n_words") >= least_words).count() * percent // 100
    starts = F.broadcast(spark.createDataFrame(ends, "part bigint, before bigint"))
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("part", part).join(starts, "part").select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
