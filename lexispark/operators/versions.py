"""Document versions as relational operations on a log of writes.

A log has _shard, _id, _seq_no, _primary_term, op ('index' or 'delete') and _source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = "_shard int, _id string, _seq_no long, _primary_term long, op string, _source string"


def latest(log: DataFrame, live_only: bool = True) -> DataFrame:
    """The last operation on each id; deleted ids are left out unless ``live_only`` is off.

    A partial maximum per id is taken before the shuffle, so an id that is rewritten all the time costs one row per task.
    """
    last = F.max_by(F.struct("_primary_term", "op", "_source"), "_seq_no").alias("v")
    out = log.groupBy("_shard", "_id").agg(last, F.max("_seq_no").alias("_seq_no"))
    out = out.select("_shard", "_id", "_seq_no", "v._primary_term", "v.op", "v._source")
    return out.filter(F.col("op") == "index") if live_only else out


def snapshot(log: DataFrame, low: int = 0, high: int | None = None) -> DataFrame:
    """Operations with low <= _seq_no <= high, one per sequence number."""
    kept = log.filter(F.col("_seq_no") >= low) if high is None else log.filter(F.col("_seq_no").between(low, high))
    return kept.dropDuplicates(["_shard", "_seq_no"])


def counts(log: DataFrame) -> DataFrame:
    """(_shard, live, deleted): live documents, and written versions that are no longer live."""
    state = log.groupBy("_shard", "_id").agg(F.max_by("op", "_seq_no").alias("op"), F.count_if(F.col("op") == "index").alias("written"))
    live = (F.col("op") == "index").cast("long")
    return state.groupBy("_shard").agg(F.sum(live).alias("live"), F.sum(F.col("written") - live).alias("deleted"))


def delete_by_term(docs: DataFrame, deletes: DataFrame, terms: str = "terms") -> DataFrame:
    """Documents that no delete hits. ``docs`` has _seq_no and an array of terms, ``deletes`` has term and _delete_seq.

    A delete hits documents that hold its term and were written before it, so only the last delete of a
    term matters.
    """
    last = deletes.groupBy("term").agg(F.max("_delete_seq").alias("_delete_seq"))
    hit = docs.select("_seq_no", F.explode(F.array_distinct(terms)).alias("term")).join(last, "term").filter(F.col("_seq_no") < F.col("_delete_seq"))
    return docs.join(hit.select("_seq_no").distinct(), "_seq_no", "left_anti")
