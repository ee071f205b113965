"""Shared helpers: scratch tables that cut lineage, size estimates, packed columns."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.sources.store import shared_folder

WORD = r"[^\x20\x09-\x0D]+"
#: Remove a query's shuffle files when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the shared folder, so that a lost executor never costs more than the stage it ran.

    They stay as long as a result may still read them: until the enclosing ``temporary_tables`` ends, else until the
    driver does.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        _made.append(self)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path, conf = f"{self.root}/{name}", self.spark.conf
        before = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")  # the table takes the place of what was shuffled for it
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        """Remove a table that no later plan reads, or all of them."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_made: list[Scratch] = []


@contextmanager
def temporary_tables() -> Iterator[None]:
    """Remove the scratch tables of all operators called inside; their results must be written before the block ends."""
    before = len(_made)
    try:
        yield
    finally:
        while len(_made) > before:
            _made.pop().drop()


def _clear() -> None:
    while _made:
        made = _made.pop()
        if made.spark.sparkContext._jsc is not None:  # the session still runs
            made.drop()


atexit.register(_clear)


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of a text column, counted: the planner's figure is that of compressed files, or a guess after joins."""
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of the key; ``rows`` must be cheap to count (a written table).

    Rows are thinned by a second hash first, so that a task passes on its share of the sample and not ``most`` rows.
    """
    every = max(1, rows.count() // (2 * most))
    return rows.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(every)) == 0).orderBy(F.xxhash64(key)).limit(most)


def unit(*parts: Column | str) -> Column:
    """A uniform number in (0, 1) that depends on the parts alone."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts), 12)
    return (bits.cast("double") + 0.5) / float(1 << 52)


# Arrow helpers ---------------------------------------------------------------


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows back to back, and the n + 1 offsets; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in the buffer, and the index of the first word of each row (n + 1 entries)."""
    if not len(body):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~_SPACE[body]
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    cut = offsets[:-1]
    cut = cut[cut < len(body)]
    first[cut] = ink[cut]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    stop = offsets[1:]
    stop = stop[stop > 0] - 1
    last[stop] = ink[stop]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit lanes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_R = 0xD6E8FEB86659FD93
_R_INV = pow(_R, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for name, base in (("up", _R), ("down", _R_INV)):
            out = np.ones(1, np.uint64)
            step = base
            while len(out) < size:
                out = np.concatenate([out, out * np.uint64(step)])
                step = step * step % (1 << 64)
            _powers[name] = out
    return _powers["up"], _powers["down"]


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False, block: int = 1 << 17) -> np.ndarray:
    """64-bit hash of each word, from prefix sums over blocks of the buffer; equal words hash alike anywhere."""
    out = np.empty(len(starts), np.uint64)
    value = _BYTE
    if fold_case:
        value = _BYTE.copy()
        value[65:91] = _BYTE[97:123]
    i, n = 0, len(starts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _power_table(hi - lo + 1)
        run = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(value[body[lo:hi]] * up[: hi - lo], out=run[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((run[e] - run[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
        i = j
    return out
