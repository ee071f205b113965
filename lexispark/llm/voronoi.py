"""Exact top-k search by inner product with a Voronoi kNN join (operator 9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexispark.llm.common import Scratch, bounded_sample, table
from lexispark.llm.vectors import matrix_rows, packed, runs, unpacked

PIVOTS, MOST_PIVOTS, ROWS_PER_PIVOT = 48, 1_024, 65_536
SAMPLE_ROWS = 4_096
QUERY_BLOCK = 256
DATA_BLOCK = 1_024


def _scaled_rows(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, ids, is_query, vectors = batch.columns
            for rows, values in matrix_rows(vectors):
                values = np.floor(values * scale)
                take = pa.array(rows)
                columns = [uid.take(take), ids.take(take), is_query.take(take), packed(values), pa.array((values * values).sum(1)), pa.array(np.full(len(rows), values.shape[1], np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "id", "is_query", "vector", "norm2", "dims"])

    return run


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Well spread rows of the bounded sample: the first, then always the row furthest from those chosen."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


class Space:
    """Rows lifted by one coordinate, so that the nearest row by distance has the largest inner product.

    A data row x becomes (x, sqrt(M - |x|^2)) with M the largest squared norm, a query q becomes (q, 0); then
    |q - x|^2 = |q|^2 + M - 2 q.x.
    """

    def __init__(self, pivots: np.ndarray, most: float):
        self.pivots, self.most = pivots, most

    def lift(self, values: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(values)) if query else np.sqrt(np.maximum(0.0, self.most - (values * values).sum(1)))
        return np.column_stack([values, extra])

    def nearest(self, lifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        square = (lifted * lifted).sum(1)[:, None] - 2.0 * lifted @ self.pivots.T + (self.pivots * self.pivots).sum(1)
        cell = square.argmin(1)
        return cell.astype(np.int32), np.sqrt(((lifted - self.pivots[cell]) ** 2).sum(1))

    @property
    def margin(self) -> float:
        """Far above the rounding of any distance here, far below anything that matters for pruning."""
        return 1e-6 * (1.0 + float(np.sqrt(self.most)) + float(np.abs(self.pivots).max(initial=0.0)))


def _assign(spaces: dict[int, Space], query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                space = spaces[int(d)]
                cell, far = space.nearest(space.lift(unpacked(part.column(2)), query))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell), pa.array(far)], ["uid", "id", "vector", "dims", "cell", "far"])

    return run


def _closest(k: int):
    """Per cell and partition, the k smallest distances to the pivot: partial summaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            dims, cell, far = (batch.column(i).to_numpy() for i in range(3))
            for d, c in set(zip(dims.tolist(), cell.tolist())):
                mine = far[(dims == d) & (cell == c)]
                best[d, c] = np.sort(np.concatenate([best.get((d, c), far[:0]), mine]))[:k]
        rows = [(d, c, x) for (d, c), v in best.items() for x in v.tolist()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(col, kind) for col, kind in zip(zip(*rows), (pa.int32(), pa.int32(), pa.float64()))], ["dims", "cell", "far"])

    return run


def _blocks(most: int):
    """Rows sorted by (dims, cell, far) as blocks: packed ids and vectors, and the ring of distances they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []
        names = ["block", "dims", "cell", "near", "far", "uids", "ids", "vectors"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number, held
            if held:
                far = np.concatenate([h[2] for h in held])
                values = [number, *held[0][0], far.min(), far.max(), np.concatenate([h[4] for h in held]).tobytes(), np.concatenate([h[1] for h in held]).tobytes(), b"".join(v for h in held for v in h[3])]
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(values, kinds)], names)
                number, held = number + 1, []

        for batch in batches:
            uid, ids, dims, cell, far = (batch.column(i).to_numpy() for i in (0, 1, 3, 4, 5))
            vectors = batch.column(2).to_pylist()
            for lo, hi in runs(dims, cell):
                key = (int(dims[lo]), int(cell[lo]))
                if held and held[0][0] != key:
                    yield from flush()
                while lo < hi:
                    step = min(hi - lo, most - sum(len(h[1]) for h in held))
                    held.append((key, ids[lo : lo + step], far[lo : lo + step], vectors[lo : lo + step], uid[lo : lo + step]))
                    lo += step
                    if sum(len(h[1]) for h in held) == most:
                        yield from flush()
        yield from flush()

    return run


def _needed(spaces: dict[int, Space], summary: dict[int, list[tuple[int, float]]], k: int):
    """For each query block, the ring of each cell that can hold one of its k nearest rows.

    The k + 1 smallest of |p_i - p_j| + R_i + d over the summaries bound every query's k-th distance from above,
    its own row left aside; a row at distance d from pivot j lies at least | |p_i - p_j| - d | - R_i away.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, dims, cell, radius in zip(*(batch.column(i).to_pylist() for i in range(4))):
                space = spaces[dims]
                apart = np.sqrt(((space.pivots - space.pivots[cell]) ** 2).sum(1))
                bounds = np.sort([apart[j] + radius + d for j, d in summary.get(dims, ())])
                limit = (float(bounds[k]) if len(bounds) > k else np.inf) + radius + space.margin
                out += [(block, dims, j, float(max(0.0, apart[j] - limit)), float(apart[j] + limit)) for j in range(len(apart))]
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], ["q_block", "dims", "cell", "lo", "hi"])

    return run


_exact = np.vectorize(int, otypes=[object])


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products, in doubles while every partial sum fits 53 bits, else in 64-bit integers, else in
    integers of any size, of which those beyond 64 bits count as the largest (or smallest) that fits."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    if bound < 2.0**63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = (1 << 63) - 1
    return np.clip(_exact(a) @ _exact(b).T, -most, most).astype(np.int64)


def _solve(k: int):
    """The k best rows of a data block for each query of a query block, ties to the smaller id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                quid, cuid, qid, cid = (np.frombuffer(r[name], np.int64) for name in ("q_uids", "uids", "q_ids", "ids"))
                order = np.lexsort((cuid, cid))
                cid, cuid = cid[order], cuid[order]
                score = _product(np.frombuffer(r["q_vectors"], np.float64).reshape(-1, r["dims"]), np.frombuffer(r["vectors"], np.float64).reshape(-1, r["dims"])[order])
                other = quid[:, None] != cuid[None, :]
                rank = np.where(other, score, np.iinfo(np.int64).min + 1)  # its negative exists too
                # a stable sort of the negated score keeps the smaller id first among ties
                top = np.argsort(-rank, axis=1, kind="stable")[:, :k]
                row = np.arange(len(qid))[:, None]
                keep = other[row, top].ravel()
                wide = top.shape[1]
                columns = [np.repeat(quid, wide), np.repeat(qid, wide), cuid[top].ravel(), cid[top].ravel(), score[row, top].ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], ["query", "query_id", "uid", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding", scale: float = 64.0, pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of floor(scale * x) for every query row.

    Rows are assigned to the nearest of the pivots (from a bounded sample, one for 65,536 rows, at least 48 and at most 1,024;
    results don't depend on them) and stored as blocks of rows at similar distances. Summaries of the cells bound each query block's k-th
    distance, and only blocks with a ring inside that bound are joined to it; every other pair is
    skipped as provably worse. Blocks have a fixed size, so a cell with any share of the rows is many tasks.

    Rows that are null, empty or hold null or non-finite components, or with a null key, take no part, and rows are
    compared with rows of their length. Every row but the query itself is a candidate, so repeated rows find each other and rows
    that repeat a key have a list each; ties go to the smaller key; with fewer than k candidates all are returned; an
    empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "voronoi")
    base = vectors.select(F.monotonically_increasing_id().alias("uid"), F.col(key).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.col(vector).cast("array<double>").alias("vector")).filter("id is not null")
    rows = scratch.save(base.mapInArrow(_scaled_rows(scale), "uid bigint, id bigint, is_query boolean, vector binary, norm2 double, dims int"), "rows")
    counted = rows.groupBy("dims").agg(F.max("norm2").alias("most"), F.count("*").alias("rows")).collect()
    most = {r["dims"]: r["most"] for r in counted}
    pivots = pivots or min(MOST_PIVOTS, max(PIVOTS, sum(r["rows"] for r in counted) // ROWS_PER_PIVOT))
    sample = bounded_sample(rows, "uid", SAMPLE_ROWS).select("dims", "vector").collect()
    spaces: dict[int, Space] = {}
    for d, largest in most.items():
        mine = [r["vector"] for r in sample if r["dims"] == d] or [np.zeros(d).tobytes()]
        space = Space(np.zeros((1, d + 1)), largest)
        space.pivots = _pivots(space.lift(np.frombuffer(b"".join(mine), np.float64).reshape(-1, d), False), pivots)
        spaces[d] = space

    assigned = "uid bigint, id bigint, vector binary, dims int, cell int, far double"
    data = scratch.save(rows.select("uid", "id", "vector", "dims").mapInArrow(_assign(spaces, False), assigned), "data")
    close = data.select("dims", "cell", "far").mapInArrow(_closest(k + 1), "dims int, cell int, far double")
    nearest = Window.partitionBy("dims", "cell").orderBy("far")
    bounded = close.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k + 1).select("dims", "cell", "far").collect()
    summary: dict[int, list[tuple[int, float]]] = {}
    for r in bounded:
        summary.setdefault(r["dims"], []).append((r["cell"], r["far"]))

    shape = "block bigint, dims int, cell int, near double, far double, uids binary, ids binary, vectors binary"
    order = ["dims", "cell", "far", "uid"]
    data_blocks = scratch.save(data.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(DATA_BLOCK), shape), "data-blocks")
    asked = rows.filter("is_query").select("uid", "id", "vector", "dims").mapInArrow(_assign(spaces, True), assigned)
    asked = asked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(QUERY_BLOCK), shape)
    query_blocks = scratch.save(asked.select(F.col("block").alias("q_block"), "dims", F.col("cell").alias("q_cell"), F.col("far").alias("radius"), F.col("uids").alias("q_uids"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors")), "query-blocks")

    rings = query_blocks.select("q_block", "dims", "q_cell", "radius").mapInArrow(_needed(spaces, summary, k), "q_block bigint, dims int, cell int, lo double, hi double")
    pairs = rings.join(data_blocks.select("block", "dims", "cell", "near", "far"), ["dims", "cell"]).filter("far >= lo and near <= hi").select("q_block", "block")
    spread = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    work = pairs.repartition(spread).join(data_blocks.select("block", "uids", "ids", "vectors"), "block").join(query_blocks.select("q_block", "q_uids", "q_ids", "q_vectors", "dims"), "q_block")
    local = work.select("dims", "q_uids", "q_ids", "q_vectors", "uids", "ids", "vectors").mapInArrow(_solve(k), "query bigint, query_id bigint, uid bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "uid")
    return local.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_voronoi_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP9_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as e
  from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""
