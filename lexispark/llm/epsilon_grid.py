"""Embedding near-duplicates by the epsilon grid order join (operator 1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import Scratch, bounded_sample, table
from lexispark.llm.components import connected_components, spanning_stars
from lexispark.llm.vectors import matrix_rows, packed, runs, unpacked

BLOCK = 512
LEAF = 64
AXES = 8
SAMPLE_ROWS = 4_096


def _vector_rows(kind: np.dtype):
    """Rows with their vector as packed numbers, null where it can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uid", "id", "label", "vector", "dims"]
        for batch in batches:
            uid, ids, labels, vectors = batch.columns
            alone = np.ones(len(uid), bool)
            open_ = ids.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False)
            for rows, values in matrix_rows(vectors):
                good = open_[rows] & (np.abs(values).max(1) > 0)
                rows, values = rows[good], values[good].astype(kind)
                if not len(rows):
                    continue
                alone[rows] = False
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([uid.take(take), ids.take(take), labels.take(take), packed(values), pa.array(np.full(len(rows), values.shape[1], np.int32))], names)
            take = pa.array(np.flatnonzero(alone))
            yield pa.RecordBatch.from_arrays([uid.take(take), ids.take(take), labels.take(take), pa.nulls(len(take), pa.binary()), pa.nulls(len(take), pa.int32())], names)

    return run


def _units(values: np.ndarray) -> np.ndarray:
    values = values.astype(np.float64)
    values = values / np.abs(values).max(1, keepdims=True)  # no overflow in the squares
    return values / np.sqrt((values * values).sum(1, keepdims=True))


def _axes(sample: list[bytes], dims: int, kind: np.dtype) -> np.ndarray:
    """The leading principal axes of a bounded sample; they order and prune, results don't depend on them."""
    units = _units(np.frombuffer(b"".join(sample), kind).reshape(-1, dims))
    _, axes = np.linalg.eigh(units.T @ units)
    return np.ascontiguousarray(axes[:, ::-1][:, : min(AXES, dims)])


def _cells(axes: dict[int, np.ndarray], epsilon: float, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(4).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                spots = np.floor((_units(unpacked(part.column(2), kind)) @ axes[int(d)] + 2.0) / epsilon).astype(">u2")
                yield pa.RecordBatch.from_arrays([*part.columns, packed(spots)], ["id", "label", "vector", "weight", "dims", "cells"])

    return run


def _blocks(axes: dict[int, np.ndarray], schema_label: pa.DataType, kind: np.dtype):
    """Sorted rows as blocks of one label: ids, weights, vectors as they came and the box of their units on the leading axes."""

    def emit(label, dims: int, ids: np.ndarray, weight: np.ndarray, vectors: np.ndarray, number: int) -> pa.RecordBatch:
        spots = _units(vectors) @ axes[dims]
        values = [[number], [label], [dims], [ids.tobytes()], [weight.tobytes()], [vectors.tobytes()], [spots.min(0).tolist()], [spots.max(0).tolist()]]
        kinds = [pa.int64(), schema_label, pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["block", "label", "dims", "ids", "weights", "vectors", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list = []  # rows of the block being filled, one label and dimension

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            if held:
                label, dims = held[0][0]
                yield emit(label, dims, *(np.concatenate([h[i] for h in held]) for i in (1, 2, 3)), number)
                number, held = number + 1, []

        for batch in batches:
            label, dims = batch.column(1), batch.column(4).to_numpy()
            names = np.array(label.to_pylist(), dtype=object)
            for lo, hi in runs(names, dims):
                key = (names[lo], int(dims[lo]))
                if held and held[0][0] != key:
                    yield from flush()
                ids, weight = batch.column(0)[lo:hi].to_numpy(), batch.column(3)[lo:hi].to_numpy()
                vectors = unpacked(batch.column(2)[lo:hi], kind)
                while len(ids):
                    room = BLOCK - sum(len(h[1]) for h in held)
                    held.append((key, ids[:room], weight[:room], vectors[:room]))
                    ids, weight, vectors = ids[room:], weight[room:], vectors[room:]
                    if sum(len(h[1]) for h in held) == BLOCK:
                        yield from flush()
        yield from flush()

    return run


def interval_join(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, epsilon: float, cosine: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with cosine >= ``cosine``; halves intervals of the two sequences while their boxes are near.

    ``pa_`` and ``pb`` are the rows on the leading axes. Boxes further apart than ``epsilon`` hold no pair, since a
    projection never lengthens a distance. With ``same`` each unordered pair comes once.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    bound = epsilon * epsilon + 1e-9

    def visit(alo: int, ahi: int, blo: int, bhi: int) -> None:
        if same and alo >= bhi:
            return
        x, y = pa_[alo:ahi], pb[blo:bhi]
        gap = np.maximum(0.0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
        if gap @ gap > bound:
            return
        if ahi - alo <= LEAF and bhi - blo <= LEAF:
            hit = a[alo:ahi] @ b[blo:bhi].T >= cosine
            i, j = np.nonzero(hit)
            i, j = i + alo, j + blo
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                found.append((i, j))
        elif ahi - alo >= bhi - blo:
            mid = (alo + ahi) // 2
            visit(alo, mid, blo, bhi)
            visit(mid, ahi, blo, bhi)
        else:
            mid = (blo + bhi) // 2
            visit(alo, ahi, blo, mid)
            visit(alo, ahi, mid, bhi)

    if len(a) and len(b):
        visit(0, len(a), 0, len(b))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _join_blocks(axes: dict[int, np.ndarray], epsilon: float, cosine: float, kind: np.dtype):
    """For each pair of blocks: (true, id, links) counts and (false, id, smaller id) stars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids_a, ids_b = (np.frombuffer(r[f"ids_{s}"], np.int64) for s in "ab")
                w_a, w_b = (np.frombuffer(r[f"weights_{s}"], np.int64) for s in "ab")
                a, b = (_units(np.frombuffer(r[f"vectors_{s}"], kind).reshape(-1, r["dims"])) for s in "ab")
                same = r["block_a"] == r["block_b"]
                axis = axes[r["dims"]]
                i, j = interval_join(a, b, a @ axis, b @ axis, epsilon, cosine, same)
                if not len(i):
                    continue
                one = np.bincount(i, w_b[j], len(a)).astype(np.int64)
                two = np.bincount(j, w_a[i], len(b)).astype(np.int64)
                x, y = spanning_stars(ids_a[i], ids_b[j])
                ids = np.concatenate([ids_a[one > 0], ids_b[two > 0], x])
                values = np.concatenate([one[one > 0], two[two > 0], y])
                is_count = np.arange(len(ids)) < len(ids) - len(x)
                yield pa.RecordBatch.from_arrays([pa.array(is_count), pa.array(ids), pa.array(values)], ["is_count", "a", "b"])

    return run


def embedding_near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label", cosine: float = 0.93) -> DataFrame:
    """Direct links and components of vectors with a cosine similarity of at least ``cosine``.

    Vectors are compared only under equal labels that aren't null (all of them with ``label=None``), and only
    with vectors of their length. Equal vectors of a label become one weighted row first, so copies in any number cost one
    row. Rows are put in epsilon grid order (cells of the leading principal axes of unit vectors, cell width = the
    distance of ``cosine``), the sequence is cut into blocks of a fixed size, whatever the label, and pairs of
    blocks whose boxes are near are joined by recursive halving. A pair of blocks hands on a count per vector and
    one spanning star per component, never its links.

    Returns key, n_links, component_id (smallest key reachable, itself included) and kept, one row per row of input.
    Vectors that are null, empty, zero or hold null or non-finite components, and those under a null label or key,
    link with nothing. Rows are told apart by more than their key: repeated rows count each other as links, rows that repeat
    a key with other vectors have links of their own; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "epsilon-grid")
    by = F.col(label) if label else F.lit(0)
    single = dict(vectors.dtypes)[vector] == "array<float>"  # half the bytes, and the same numbers
    number = np.dtype(np.float32 if single else np.float64)
    base = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("id"), by.alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    kind = dict(base.dtypes)["label"]
    epsilon = float(np.sqrt(max(0.0, 2.0 - 2.0 * cosine))) or 1e-6
    rows = scratch.save(base.mapInArrow(_vector_rows(number), f"uid bigint, id bigint, label {kind}, vector binary, dims int"), "rows")
    same = ["label", "vector", "dims"]
    classes = rows.filter("vector is not null").groupBy(*same).agg(F.min("uid").alias("id"), F.min("id").alias("least"), F.count("*").alias("weight")).select("id", *same[:2], "weight", "dims", "least")
    classes = scratch.save(classes, "classes")

    sample = bounded_sample(classes, "id", SAMPLE_ROWS).select("dims", "vector").collect()
    axes = {d: _axes([r["vector"] for r in sample if r["dims"] == d], d, number) for d in {r["dims"] for r in sample}}
    for (d,) in classes.select("dims").distinct().collect():  # lengths that the sample missed
        axes.setdefault(d, np.eye(d)[:, : min(AXES, d)])

    label_type = _arrow_schema(classes).field("label").type
    ordered = classes.drop("least").mapInArrow(_cells(axes, epsilon, number), f"id bigint, label {kind}, vector binary, weight bigint, dims int, cells binary").repartitionByRange("label", "dims", "cells", "id").sortWithinPartitions("label", "dims", "cells", "id")
    blocks = scratch.save(
        ordered.mapInArrow(_blocks(axes, label_type, number), f"block bigint, label {kind}, dims int, ids binary, weights binary, vectors binary, low array<double>, high array<double>"),
        "blocks",
    )
    # blocks that share a cell of the first axis, or have adjacent ones, and whose boxes are no further apart than epsilon
    cell = lambda c: F.floor((c[0] + 2.0) / epsilon).cast("int")
    near = blocks.select("block", "label", "dims", "low", "high")
    left = near.select(F.col("block").alias("block_a"), "label", "dims", F.col("low").alias("low_a"), F.col("high").alias("high_a"), F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    right = near.select(F.col("block").alias("block_b"), "label", "dims", F.col("low").alias("low_b"), F.col("high").alias("high_b"), F.explode(F.sequence(cell(F.col("low")) - 1, cell(F.col("high")) + 1)).alias("cell"))
    gaps = F.transform(
        F.arrays_zip("low_a", "high_a", "low_b", "high_b"),
        lambda z: F.pow(F.greatest(F.lit(0.0), z["low_a"] - z["high_b"], z["low_b"] - z["high_a"]), 2),
    )
    pairs = left.join(right, ["label", "dims", "cell"]).filter("block_a <= block_b").filter(F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) <= epsilon * epsilon + 1e-9).select("block_a", "block_b", "dims").distinct()
    side = lambda s: blocks.select(*[F.col(c).alias(f"{c}_{s}") for c in ("block", "ids", "weights", "vectors")])
    spread = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = scratch.save(
        pairs.repartition(spread).join(side("a"), "block_a").join(side("b"), "block_b").mapInArrow(_join_blocks(axes, epsilon, cosine, number), "is_count boolean, a bigint, b bigint"),
        "found",
    )
    counts = found.filter("is_count").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    labels = connected_components(found.filter("not is_count").select("a", "b"), scratch)

    named = classes.withColumnRenamed("id", "rep").join(counts, "rep", "left")
    named = named.join(labels, named["rep"] == labels["id"], "left").select(*same, "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    named = scratch.save(named, "named")
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    per_class = named.join(smallest, "component").select(*same, "n_links", "component_id")
    linked = rows.filter("vector is not null").join(per_class, same).select("id", "n_links", "component_id")
    alone = rows.filter("vector is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return linked.unionByName(alone).select(F.col("id").cast(dict(vectors.dtypes)[key]).alias(key), "n_links", "component_id", kept.alias("kept"))


def _arrow_schema(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def op1_epsilon_grid_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_near_duplicates(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (
  select a as id, b as seen from links
  union
  select r.id, l.b from reach r join links l on r.seen = l.a),
low as (select id, least(id, min(seen)) as component_id from reach group by id),
deg as (select a as id, count(*) as n from links group by a)
select e.vec_id, coalesce(n, 0)::bigint as n_links, coalesce(component_id, e.vec_id)::bigint as component_id,
       e.vec_id = coalesce(component_id, e.vec_id) as kept
from embeddings e left join low on low.id = e.vec_id left join deg on deg.id = e.vec_id
"""
