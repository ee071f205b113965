"""Operators as steps of a corpus pipeline: documents in, documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import table
from lexispark.llm.minhash import near_duplicates
from lexispark.llm.mixing import mix_sources
from lexispark.llm.packing import default_tokenizer, pack_documents
from lexispark.llm.quality import score_quality
from lexispark.llm.secrets import redact_secrets

REJECT_BELOW = 0.3
NEAR_PERCENT = 80
ROW = "__row"


def _marked(docs: DataFrame) -> DataFrame:
    """With a column that names a row: its doc_id (null last) and a hash of its text. Rows that agree in both are one document."""
    return docs.withColumn(ROW, F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id"), F.xxhash64("text").alias("hash")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject.

    Each row is judged by its own text, null and empty ones and rows that repeat a doc_id or have none included; repeated
    rows share their fate; an empty table gives no rows. Without labels nothing is rejected.
    """
    scores = score_quality(docs, table(spark, sf_dir, "labels"), with_hash=True)
    rejected = scores.filter(F.col("score") < REJECT_BELOW).select(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", F.col("text_hash").alias("hash")).alias(ROW)).distinct()
    return _marked(docs).join(rejected, ROW, "left_anti").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, the one with the smallest doc_id (null last, then by text).

    Rows that repeat doc_id and text become one, rows that repeat a doc_id only are judged by their texts. Documents without
    words stay, repeated ones too; an empty table gives no rows.
    """
    marked = _marked(docs)
    found = near_duplicates(marked.select(ROW, "text"), key=ROW, percent=NEAR_PERCENT)
    gone = found.filter(~F.col("kept")).select(ROW).distinct()
    repeated = found.filter("kept and n_shingles > 0").groupBy(ROW).agg(F.count("*").alias("rows")).filter("rows > 1").select(ROW)
    left = marked.join(gone, ROW, "left_anti")
    # repeated rows are rare; only they pass through the aggregation
    once = left.join(repeated, ROW, "left_semi").dropDuplicates([ROW])
    return left.join(repeated, ROW, "left_anti").unionByName(once).select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; secrets in their texts are replaced by a mark.

    Rows without secrets, null and empty texts among them, and repeated rows pass as they are; an empty table gives no rows.
    """
    return redact_secrets(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; those that it doesn't take are left out.

    A document is its doc_id, text and source; rows that agree in all three are taken together, rows that share a doc_id
    each for themselves. Documents without words come as often as their source is certain to; an empty table gives no rows.
    """
    marked = _marked(docs)
    taken = mix_sources(marked, key=ROW).filter("copies > 0").groupBy(ROW, "source").agg(F.max("copies").alias("copies"))
    taken = taken.select(F.col(ROW).alias("taken_row"), F.col("source").alias("taken_source"), F.col("copies").alias("taken_copies"))
    own = marked.alias("own").join(taken, (F.col(f"own.{ROW}") == F.col("taken_row")) & F.col("own.source").eqNullSafe(F.col("taken_source")))
    return own.withColumn("taken_copy", F.explode(F.sequence(F.lit(1), F.col("taken_copies")))).select(*[F.col(f"own.{c}") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the mix; a document taken twice is packed twice, null texts as empty ones; no rows for no documents."""
    return pack_documents(docs, default_tokenizer())
