"""From documents to packed token sequences, in five stages.

Every stage is written as Parquet to the shared folder and read again by the next, so a lost executor costs at most
the stage it ran.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexispark.llm import stages
from lexispark.llm.common import Scratch, table, temporary_tables

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", stages.keep_good),
    ("near_dedup", stages.keep_one_of_each),
    ("secrets", stages.without_secrets),
    ("mixing", stages.mixed),
    ("packing", stages.packed),
]

#: Sketches, a fitted model and tokenizer ids can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Nulls, repeated rows and empty tables are treated as each stage's docstring says; what a stage
    wrote for itself and the stage before it left goes as soon as its result is written."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    before = ""
    for number, (name, stage) in enumerate(STAGES):
        with temporary_tables():
            docs = scratch.save(stage(spark, docs, sf_dir), f"{number}-{name}")
        if before:
            scratch.drop(before)
        before = f"{number}-{name}"
    return docs
