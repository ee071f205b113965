"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.common import Scratch

_EDGES = "a bigint, b bigint"


def spanning_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as stars: every node but the smallest of its component, with that smallest node."""
    nodes, both = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = both[: len(a)], both[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
        if (label == before).all():
            break
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _contract(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = np.concatenate([a, batch.column(0).to_numpy()]), np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > most:
            a, b = spanning_stars(a, b)
            if len(a) > most // 2:  # a forest that doesn't fit is handed on as it is
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
                a, b = a[:0], b[:0]
    if len(a):
        a, b = spanning_stars(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def connected_components(links: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(id, component) for every node of ``links`` (a, b: long) but the smallest of each component.

    Each partition first replaces its links by stars, so a hub of any degree costs each partition one row per
    neighbour at most. Rounds of large star and small star follow until only stars are left: every node links to
    one smaller node that links to none. Minima are combined before the shuffle, and rounds are written to the shared folder. Self links and repeated links are harmless.
    """
    edges, done = links.filter(F.col("a") != F.col("b")).mapInArrow(_contract, _EDGES), 0
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter(F.col("a") != F.col("b")).distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a")
        stars = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter(F.col("a") != F.col("b")).distinct()
        step = scratch.save(stars, f"{name}{done}")
        if done:
            scratch.drop(f"{name}{done - 1}")
        ends = step.select(F.col("a").alias("v"), F.lit(1).alias("low"), F.lit(0).alias("top")).unionByName(step.select(F.col("b").alias("v"), F.lit(0).alias("low"), F.lit(1).alias("top")))
        roles = ends.groupBy("v").agg(F.sum("low").alias("low"), F.max("top").alias("top"))
        if not roles.filter((F.col("low") > 1) | ((F.col("low") > 0) & (F.col("top") > 0))).head(1):
            return step.select(F.col("a").alias("id"), F.col("b").alias("component"))
        edges, done = step.mapInArrow(_contract, _EDGES), done + 1
