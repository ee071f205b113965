"""Saved indexes: versions of Parquet tables in a folder, and a pointer to the current one."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.errors import IndexNotFoundError, SearchError
from lexispark.mapping import Mapping
from lexispark.plans.view import View


class Files:
    """Small files of a folder through the cluster's file system."""

    def __init__(self, spark: SparkSession, folder: str):
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        self.folder = folder.rstrip("/")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.folder).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        self._overwrite = spark.sparkContext._gateway.new_array(rename, 1)
        self._overwrite[0] = rename.OVERWRITE

    def at(self, name: str):
        return self._path(f"{self.folder}/{name}")

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self.at(name) if name else self._path(self.folder))

    def read(self, name: str) -> str:
        stream = self._fs.open(self.at(name))
        try:
            return self._io.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Written aside, then renamed over the old file in one step: readers see the old text or the new one, always one of them."""
        pending = self.at(f".pending-{uuid.uuid4().hex}")
        stream = self._fs.create(pending, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self._context.rename(pending, self.at(name), self._overwrite)

    def delete(self, name: str = "") -> None:
        self._fs.delete(self.at(name) if name else self._path(self.folder), True)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)))


_fallback: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares, named by spark.checkpoint.dir; a temporary one where driver and executors are
    one process. A cluster without a shared folder is refused: executors would write to disks of their own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise SearchError("spark.checkpoint.dir must name a folder that all executors share")
    if not _fallback:
        path = tempfile.mkdtemp(prefix="lexispark-")
        atexit.register(shutil.rmtree, path, True)
        _fallback.append(f"file://{path}")
    return _fallback[0]


def own_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"


_BLOCK = "_shard int, term string, docs array<bigint>, tfs array<int>, lens array<int>, positions array<array<int>>"
BLOCKS = f"{_BLOCK}, field string"


#: Tokens that a Python worker turns into blocks at once. What a worker holds beyond the batch it was sent grows with these alone;
#: a document with more of them is taken by itself.
TOKENS_AT_ONCE = 1 << 19


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows, from and to, with at most ``most`` tokens each, or one row with more."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, stop
        start = stop


def _sizes(lists: pa.ListArray) -> np.ndarray:
    size = np.diff(lists.offsets.to_numpy())
    size[lists.is_null().to_numpy(zero_copy_only=False)] = 0
    return size


def _blocks_of(batch: pa.RecordBatch, keyword: bool) -> pa.RecordBatch:
    """Posting blocks of some documents, one for each term and shard: all their tokens are sorted by term at once."""
    shard, doc, lists = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2))
    size = _sizes(lists)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    coded = flat.dictionary_encode()
    code = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    row, place, code = (x[code >= 0] for x in (row, place, code))
    length = np.bincount(row, minlength=len(size))
    shards, which = np.unique(shard, return_inverse=True)
    # terms in the order of the dictionary sorted, then shards; the sort is stable, so documents and places stay in order
    names = pa.compute.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(names), np.int64)
    rank[names] = np.arange(len(names))
    key = rank[code] * max(1, len(shards)) + which[row]
    order = np.argsort(key, kind="stable")
    key, row, place = key[order], row[order], place[order]
    block = np.diff(key, prepend=-1) != 0
    head = np.flatnonzero(block | (np.diff(row, prepend=-1) != 0))
    ends = np.append(head, len(key))
    first = np.flatnonzero(block[head])  # postings that open a block
    limits = pa.array(np.append(first, len(head)), pa.int32())
    if keyword:
        inner = pa.ListArray.from_arrays(pa.array(np.arange(len(head) + 1), pa.int32()), pa.array(np.zeros(len(head)), pa.int32()))
        tf, lens = np.ones(len(head), np.int64), np.zeros(len(head), np.int64)
    else:
        inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place, pa.int32()))
        tf, lens = np.diff(ends), length[row[head]]
    term = coded.dictionary.take(pa.array(names[key[head[first]] // max(1, len(shards))]))
    lists = [pa.ListArray.from_arrays(limits, v) for v in (pa.array(doc[row[head]], pa.int64()), pa.array(tf, pa.int32()), pa.array(lens, pa.int32()), inner)]
    return pa.RecordBatch.from_arrays([pa.array(shards[key[head[first]] % max(1, len(shards))], pa.int32()), term, *lists], ["_shard", "term", "docs", "tfs", "lens", "positions"])


def _token_blocks(keyword: bool, most: int = TOKENS_AT_ONCE):
    """Posting blocks of token arrays, ``most`` tokens of a batch at a time.

    A keyword counts once a document, at position 0 and without a length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in _slices(_sizes(batch.column(2)), most):
                yield _blocks_of(batch.slice(start, stop - start), keyword)

    return run


def blocks(view: View) -> DataFrame:
    """Postings of every field with terms as blocks: a term, a shard, and arrays over the documents of a part of a batch.

    A document's tokens lie in one row, so grouping them needs no shuffle. Keywords have tf 1 and no length.
    """
    parts = []
    for name, spec in view.mapping.fields.items():
        if spec.has_terms:
            rows = view.docs.select("_shard", "_doc", view.tokens(name).alias("tokens")).mapInArrow(_token_blocks(spec.type != "text"), _BLOCK)
            parts.append(rows.withColumn("field", F.lit(name)))
    return reduce(DataFrame.unionByName, parts) if parts else view.docs.sparkSession.createDataFrame([], BLOCKS)


def postings(view: View) -> DataFrame:
    """(_shard, field, term, _doc, tf, len, positions), one row per document and term."""
    return replace(view, postings=blocks(view)).posted()


def field_statistics(view: View) -> DataFrame:
    """(_shard, field, n, sum_len): live documents of the shard, with or without the field, and the sum of its lengths."""
    texts = [n for n, s in view.mapping.fields.items() if s.type == "text"]
    stored = [f"_tokens_{n}" for n in texts]
    known = all(c in view.docs.columns for c in stored)
    size = lambda n: F.col(f"_tokens_{n}") if known else tokens_of(view, n)
    lengths = [F.coalesce(F.sum(size(n)), F.lit(0)).alias(f"sum{i}") for i, n in enumerate(texts)]
    per_shard = view.docs.groupBy("_shard").agg(F.count(F.lit(1)).alias("n"), *lengths)
    rows = [F.struct(F.lit(n).alias("field"), F.col(f"sum{i}").alias("sum_len")) for i, n in enumerate(texts)]
    rows.append(F.struct(F.lit("").alias("field"), F.lit(0).cast("long").alias("sum_len")))
    return per_shard.select("_shard", "n", F.explode(F.array(*rows)).alias("r")).select("_shard", "r.field", "n", "r.sum_len")


def tokens_of(view: View, name: str) -> Column:
    return F.size(F.filter(view.tokens(name), lambda t: t.isNotNull())) if view.is_array(name) else F.size(view.tokens(name))


def term_dictionary(posted: DataFrame, field: str) -> DataFrame:
    return posted.filter(F.col("field") == field).select("term").distinct().orderBy("term")


POINTER = "_current"


def _sorted_blocks(made: DataFrame, files: int) -> DataFrame:
    """By field, term, shard and first document: a term reads few row groups, and a frequent one is many tasks and files."""
    by = ("field", "term", "_shard", "_first")
    made = made.withColumn("_first", F.col("docs")[0])
    made = made.repartitionByRange(files, *by) if files else made.repartitionByRange(*by)
    return made.sortWithinPartitions(*by).drop("_first")


def write_tables(view: View, disk: Files, name: str, files: int = 0, made: DataFrame | None = None) -> None:
    """Documents with their numbers of tokens, posting blocks (``made`` where they exist already) and statistics below ``name``.

    Texts are analyzed for the blocks and for the lengths, nowhere else. Blocks are written as they come first: a range partitioning
    samples its input, and must not analyze every text twice for it.
    """
    spark, at = view.docs.sparkSession, f"{disk.folder}/{name}"
    docs = view.docs.repartitionByRange(files, "_shard", "_doc") if files else view.docs.repartition("_shard", "_doc")
    texts = [n for n, s in view.mapping.fields.items() if s.type == "text" and f"_tokens_{n}" not in view.docs.columns]
    docs = docs.withColumns({f"_tokens_{n}": tokens_of(view, n) for n in texts}) if texts else docs
    docs.sortWithinPartitions("_shard", "_doc").write.mode("overwrite").parquet(f"{at}/docs")
    saved = replace(view, docs=spark.read.schema(docs.schema).parquet(f"{at}/docs"), postings=None, dead=None)
    (blocks(saved) if made is None else made).write.mode("overwrite").parquet(f"{at}/unsorted")
    _sorted_blocks(spark.read.schema(BLOCKS).parquet(f"{at}/unsorted"), files).write.mode("overwrite").partitionBy("field").parquet(f"{at}/postings")
    disk.delete(f"{name}/unsorted")
    field_statistics(saved).coalesce(1).write.mode("overwrite").parquet(f"{at}/fields")


def save(view: View, folder: str, files: int = 0, keep: int = 2) -> int:
    """Write a new version and make it current; versions older than the last ``keep`` go. Returns the version."""
    disk = Files(view.docs.sparkSession, folder)
    version = (json.loads(disk.read(POINTER))["version"] if disk.exists(POINTER) else 0) + 1
    write_tables(replace(view, postings=None), disk, f"v{version}", files, view.postings)
    disk.replace(POINTER, json.dumps({"version": version, "shards": view.shards, "mapping": view.mapping.to_dict()}))
    for name in disk.names():
        if name.startswith("v") and name[1:].isdigit() and int(name[1:]) <= version - keep:
            disk.delete(name)
    return version


def load(spark: SparkSession, folder: str) -> View:
    """The current version; its plans keep working while newer versions are written."""
    disk = Files(spark, folder)
    if not disk.exists(POINTER):
        raise IndexNotFoundError(f"no saved index in [{folder}]")
    meta = json.loads(disk.read(POINTER))
    at = f"{disk.folder}/v{meta['version']}"
    return View(
        spark.read.parquet(f"{at}/docs"), Mapping.of(meta["mapping"]), meta["shards"],
        spark.read.schema(BLOCKS).parquet(f"{at}/postings"), spark.read.parquet(f"{at}/fields"),
    )


def compact(spark: SparkSession, folder: str, files: int = 0) -> int:
    """Rewrite the current version into ``files`` files per table (0: as many as its size asks for); the posting blocks are moved, no text is analyzed again."""
    return save(load(spark, folder), folder, files)
