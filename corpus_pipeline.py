"""From raw documents to token ids, in stages; each stage's result is written as Parquet and read by the next.

1. quality: documents that the pairwise ranking scores below its threshold go.
2. near_duplicates: one document of each component of the n-gram Jaccard join stays.
3. secrets: spans found by rules and Markov models are replaced by a mark; every document stays.
4. mixing: sources are repeated towards equal weights, at most twice as often as the least
   repeated one; nothing is dropped. A document that is repeated gives equal rows. The files by their numbers, and the rows in each of them, stand in the mixed
   order: epoch by epoch, the permuted blocks of all sources interleaved. A table that is read from files has no order of its own, as Spark deals
   files to tasks by size; so the last stage tells each row's file and place.
5. byte_bpe: texts become token ids. shard and place are the number of the file and the row in it that a document stood in: in order
   of both, the rows have the order of stage 4 (null where the documents don't come from files).

Defined cases, for every stage: a null text is the empty text (stages 1 and 2 hand it on as it is, from stage 3 on it is empty); a
null id stays null, and such a row is never a label's; repeated rows are scored alike, one of those equal in all columns stays behind
stage 2; ties go to the smaller id; an empty table gives an empty result; columns besides those of documents are left out by the
first stage that meets them, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import byte_bpe, ngram_join, quality_rank, secret_scan, source_mixing
from folioforge.llm.queries import pattern, vocabulary
from folioforge.llm.shared import durable, table, text_of

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A source is repeated at most this often.
MAX_REPEATS = 2.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_rank.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_rank.score_column(text_of(docs), model) >= model.threshold).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs.select(COLUMNS)).select(COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = secret_scan.train(secret_scan.samples_of(docs))
    found = secret_scan.secret_spans(docs.select(COLUMNS), model, keep=["lang", "source"])
    clean = found.select("doc_id", secret_scan.redacted(F.col("scanned"), F.concat("base", "added")).alias("text"), "lang", "source")
    return clean.withColumn("n_chars", F.char_length("text").cast("bigint")).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = source_mixing.mix(docs.select(COLUMNS), max_repeats=MAX_REPEATS)
    return mixed.orderBy("epoch", "order_key").select(COLUMNS)


def _with_places(docs: DataFrame) -> DataFrame:
    """docs with shard and place of each row in the files that it is read from."""
    try:
        return docs.select(*COLUMNS, F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("int").alias("shard"), F.col("_metadata.row_index").alias("place"))
    except AnalysisException:  # not read from files
        return docs.select(*COLUMNS, F.lit(None).cast("int").alias("shard"), F.lit(None).cast("bigint").alias("place"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    placed = _with_places(docs)
    ids = byte_bpe.encode_column(text_of(placed), vocabulary("byte_bpe_50k.tiktoken"), pattern())
    return placed.select("doc_id", "lang", "source", "shard", "place", ids.alias("ids")).withColumn("n_tokens", F.size("ids").cast("bigint"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("byte_bpe", encoding)]

#: Ranking, similarity components and merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
