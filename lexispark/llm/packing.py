"""Best-fit packing by hierarchical residual packing (operator 6)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import Scratch, table, text_buffers
from lexispark.llm.tokens import encoder

CAPACITY = 1024
END_ID = 2
LEAF_ITEMS = 32_768
FAN_IN = 16
MERGE_ITEMS = 131_072
#: A round of merging that leaves more than this share of the underfull bins apart is the last one.
STALLED = 0.98
SLICE_BYTES = 6 << 20


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best fit, longest first: the bin and offset of each item, and the fill of each bin.

    Bins are kept by the room they have, with one bit per room in use, so an item costs one bit scan.
    """
    bins, offsets, fills = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = used >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                used &= ~(1 << room)
        else:
            b, room = len(fills), capacity
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += size
        left = room - size
        by_room[left].append(b)
        used |= 1 << left
    return bins, offsets, fills


def _cut(key: pa.Array, ids: np.ndarray, at: np.ndarray, capacity: int) -> pa.RecordBatch:
    """Pieces of every row; a row of more than ``capacity`` ids is cut so that only its first piece is shorter."""
    raw, size = ids.astype("<u4").tobytes(), np.diff(at)
    pieces = np.maximum(1, -(-size // capacity))
    row = np.repeat(np.arange(len(size)), pieces)
    number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    head = size - (pieces - 1) * capacity
    start = np.where(number > 0, head[row] + (number - 1) * capacity, 0)
    length = np.where(number > 0, capacity, head[row])
    low = at[:-1][row] + start
    view = memoryview(raw)
    crc = [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in zip(low.tolist(), length.tolist())]
    return pa.RecordBatch.from_arrays(
        [key.take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
        ["key", "piece", "start", "length", "ids_crc32"],
    )


def tokenized_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` ids of every row: ids of the whole text, then ``end_id``. Null counts as empty."""
    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        for batch in batches:
            body, offsets = text_buffers(batch.column(1))
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + SLICE_BYTES, "right")) - 1)
                ids, at = encode(body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                ids = np.insert(ids, at[1:], end_id)
                yield _cut(batch.column(0).slice(lo, hi - lo), ids, at + np.arange(len(at)), capacity)
                lo = hi

    kind = dict(source.dtypes)["key"]
    return source.mapInArrow(run, f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def _local(capacity: int, enough: int):
    def run(group: pa.Table) -> pa.Table:
        # the order of rows within a group isn't fixed, the row numbers are
        uid, length = group["uid"].to_numpy(), group["length"].to_numpy()
        order = np.argsort(uid)
        uid, length = uid[order], length[order]
        bins, offsets, fills = best_fit(length, capacity)
        lead = np.zeros(len(fills), np.int64)
        lead[bins[offsets == 0]] = uid[offsets == 0]
        fill = np.array(fills, np.int64)
        head = offsets == 0
        return pa.table(
            {
                "uid": pa.array(uid), "bin": pa.array(lead[bins]), "offset": pa.array(offsets), "fill": pa.array(fill[bins]),
                "bucket": pa.array(np.full(len(uid), group["bucket"][0].as_py(), np.int64)), "open": pa.array(head & (fill[bins] < enough)),
            }
        )

    return run


def pack(pieces: DataFrame, scratch: Scratch, capacity: int = CAPACITY, leaf_items: int = LEAF_ITEMS, fan_in: int = FAN_IN, merge_items: int = MERGE_ITEMS) -> DataFrame:
    """uid, sequence_id and offset of every piece (uid, length); a sequence is named by the uid of its first piece.

    Groups of about ``leaf_items`` pieces are packed by best fit on their own. Bins at least 63/64 full are
    done; all others become items of the next round, in which ``fan_in`` groups are packed together, until one group is left.
    Where more than ``merge_items`` bins would meet in one task they are spread over more groups instead, other ones each
    round; where they are too full to go together (pieces of two thirds of the capacity, say) rounds stop as soon as one joins
    next to nothing.
    """
    n = pieces.count()
    groups = max(1, -(-n // leaf_items))
    enough = capacity - capacity // 64
    items = pieces.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(groups)).alias("bucket"))
    schema = "uid bigint, bin bigint, offset bigint, fill bigint, bucket bigint, open boolean"
    placed, level = None, 0
    while True:
        step = scratch.save(items.groupBy("bucket").applyInArrow(_local(capacity, enough), schema), f"level{level}")
        if placed is None:
            placed = step.select("uid", "bin", "offset")
        else:
            up = step.select(F.col("uid").alias("child"), F.col("bin").alias("parent"), F.col("offset").alias("shift"))
            placed = placed.join(up, placed["bin"] == up["child"], "left").select(
                "uid", F.coalesce("parent", "bin").alias("bin"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")
            )
        left = step.filter("open").count() if groups > 1 else 0
        if groups == 1 or (level and left > STALLED * n):
            return placed.select("uid", F.col("bin").alias("sequence_id"), "offset")
        merged, needed = -(-groups // fan_in), -(-left // merge_items)
        groups, level, n = max(merged, needed), level + 1, left
        to = F.col("bucket") if merged >= needed else F.xxhash64("bin", F.lit(level))
        items = step.filter("open").select(F.col("bin").alias("uid"), F.col("fill").alias("length"), F.pmod(to, F.lit(groups)).alias("bucket"))


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Whole texts as token sequences of at most ``capacity`` ids.

    Returns key, piece, start, length, ids_crc32, sequence_id and offset, one row per piece. Full pieces are
    sequences by themselves. Null texts count as empty and still carry the end id; repeated rows are
    packed once each; an empty table gives no rows. Texts are read once: pieces are written to the shared folder and
    everything after works on their lengths.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.save(tokenized_pieces(docs, tokenizer, key, text, capacity, end_id).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    short = pieces.filter(F.col("length") < capacity)
    placed = pack(short.select("uid", "length"), scratch, capacity).withColumnRenamed("uid", "id")
    joined = short.join(placed, short["uid"] == placed["id"]).drop("id")
    full = pieces.filter(F.col("length") == capacity).withColumns({"sequence_id": F.col("uid"), "offset": F.lit(0).cast("long")})
    return joined.unionByName(full).select(F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())
