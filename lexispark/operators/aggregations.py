"""Aggregations over all documents that match, not only the hits returned."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.plans.view import View


def terms(view: View, found: DataFrame, field: str, size: int = 10) -> DataFrame:
    """(key, doc_count) of the most frequent values, ties by key; all with size <= 0; none for numbers and texts."""
    spec = view.mapping.fields.get(field)
    if spec is None or spec.type not in ("keyword", "boolean"):
        return found.select(F.lit("").alias("key"), F.lit(0).cast("long").alias("doc_count")).limit(0)
    counted = found.select(view.value(field).alias("key")).filter(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("doc_count"))
    ordered = counted.orderBy(F.desc("doc_count"), "key")
    return ordered.limit(size) if size > 0 else ordered


def value_count(view: View, found: DataFrame, *fields: str) -> DataFrame:
    """One row with the number of documents that have a value in each field; 0 for texts and unknown fields."""
    has = lambda f: f in view.mapping.fields and view.mapping.fields[f].has_value
    return found.agg(*[(F.count(view.value(f)) if has(f) else F.lit(0).cast("long")).alias(f) for f in fields])


def result(view: View, found: DataFrame, kind: str, field: str, size: int) -> dict[str, Any]:
    if kind == "terms":
        return {"buckets": [{"key": r["key"], "doc_count": r["doc_count"]} for r in terms(view, found, field, size).collect()]}
    return {"value": value_count(view, found, field).first()[0]}
