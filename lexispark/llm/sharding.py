"""Weighted rendezvous sharding (operator 8)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.llm.common import table, unit

SLOT_BUCKETS = 4096


def rendezvous(key: Column, weights: list[float], seed: int = 0) -> Column:
    """The shard whose weighted random score for the key is highest (ties: the lower number).

    A shard's score depends on the key, its own number and its own weight, so appending a shard moves only
    the keys that it wins. A null key is a key of its own.
    """
    if not weights or any(not (w > 0 and math.isfinite(w)) for w in weights):
        raise ValueError("weights must be positive and finite")
    scores = [F.struct((-F.lit(float(w)) / F.log(unit(key, F.lit(i), F.lit(seed)))).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)]
    return -F.array_max(F.array(*scores))["shard"]


def shard_documents(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text", grown_weight: float | None = 1.0, slot_buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Shard, slot and, after one more shard is added, the shard of every row.

    Returns key, size (UTF-8 bytes of the text, null 0, plus 1), text_crc32, shard, slot and grown_shard.
    Slots run without gaps from 0 in each shard. They are numbered in ``slot_buckets`` hash ranges of the key
    and shifted by the counts of the ranges before, so no task sorts a whole shard. Repeated rows get slots of
    their own; a null key is sharded as one more key; an empty table gives no rows.
    """
    k = F.col(key)
    placed = docs.select(
        k.alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        rendezvous(k, weights).cast("int").alias("shard"),
        (rendezvous(k, [*weights, grown_weight]) if grown_weight else F.lit(None)).cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64(k, F.lit("slot")), F.lit(slot_buckets)).cast("int").alias("bucket"),
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n")).select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("shard", "bucket").orderBy("key", "text_crc32")
    return (
        placed.withColumn("rank", F.row_number().over(inside) - 1)
        .join(shifts, ["shard", "bucket"])
        .select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("shift") + F.col("rank")).cast("long").alias("slot"), "grown_shard")
    )


def op8_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), [1.0] * 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
