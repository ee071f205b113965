"""An index that grows by segments: documents, posting blocks and statistics of one refresh each, and lists of dead documents.

A manifest names what is current and is replaced as a whole, so a reader sees one state or the next, and what a lost driver
left half written is never named. A segment is never changed: documents that a later operation replaced or deleted are listed
as dead, with the lengths that the statistics must give back. Merging moves documents and blocks; no text is analyzed again.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.mapping import Mapping
from lexispark.plans.view import View
from lexispark.sources import store
from lexispark.sources.store import Files

MANIFEST = "_segments"
#: With more segments than this the smaller half is merged.
MOST_SEGMENTS = 8


class Segments:
    """The segments of one index, as the manifest names them."""

    def __init__(self, spark: SparkSession, files: Files, mapping: Mapping, shards: int):
        self.spark, self.files, self.mapping, self.shards = spark, files, mapping, shards
        state = json.loads(files.read(MANIFEST)) if files.exists(MANIFEST) else {}
        #: segment name to its documents, dead ones included
        self.rows: dict[str, int] = state.get("segments", {})
        #: list of dead documents to its rows for each segment
        self.dead: dict[str, dict[str, int]] = state.get("dead", {})
        self.visible: dict[int, int] = {int(s): n for s, n in state.get("visible", {}).items()}
        self.texts = [n for n, f in mapping.fields.items() if f.type == "text"]

    def _commit(self) -> None:
        self.files.replace(MANIFEST, json.dumps({"segments": self.rows, "dead": self.dead, "visible": self.visible}))

    def _read(self, names: list[str], table: str, schema: str | None = None) -> DataFrame | None:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        parts = [reader.parquet(f"{self.files.folder}/{n}/{table}").withColumn("_segment", F.lit(n)) for n in names]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def _dead(self, names: list[str]) -> DataFrame | None:
        lists = [n for n, of in self.dead.items() if set(of) & set(names)]
        if not lists:
            return None
        found = self.spark.read.parquet(*[f"{self.files.folder}/{n}" for n in lists])
        return found.filter(F.col("_segment").isin(names))

    def _live(self, names: list[str]) -> DataFrame | None:
        docs, dead = self._read(names, "docs"), self._dead(names)
        return docs.join(dead.select("_shard", "_doc"), ["_shard", "_doc"], "left_anti") if docs is not None and dead is not None else docs

    def view(self, empty: DataFrame, names: list[str] | None = None) -> View:
        """Live documents of some segments (all by default) with their blocks; ``empty`` is a table of no documents."""
        names = list(self.rows) if names is None else names
        docs = self._live(names)
        if docs is None:
            return View(empty, self.mapping, self.shards)
        dead = self._dead(names)
        stats = self._read(names, "fields").select("_shard", "field", "n", "sum_len")
        if dead is not None:
            lost = dead.groupBy("_shard").agg(F.count("*").alias("n"), *[F.sum(f"_tokens_{t}").alias(f"_tokens_{t}") for t in self.texts])
            rows = [F.struct(F.lit(t).alias("field"), F.col(f"_tokens_{t}").cast("long").alias("sum_len")) for t in self.texts]
            rows.append(F.struct(F.lit("").alias("field"), F.lit(0).cast("long").alias("sum_len")))
            lost = lost.select("_shard", (-F.col("n")).alias("n"), F.explode(F.array(*rows)).alias("r"))
            stats = stats.unionByName(lost.select("_shard", "r.field", "n", (-F.col("r.sum_len")).alias("sum_len")))
        stats = stats.groupBy("_shard", "field").agg(F.sum("n").alias("n"), F.sum("sum_len").alias("sum_len"))
        blocks = self._read(names, "postings", store.BLOCKS).drop("_segment")
        return View(docs.drop("_segment"), self.mapping, self.shards, blocks, stats, dead.select("_shard", "_doc") if dead is not None else None)

    def add(self, docs: DataFrame, ids: DataFrame, visible: dict[int, int]) -> None:
        """A segment of ``docs``; documents of earlier segments under one of ``ids`` (_shard, _id) die."""
        old, name, gone = list(self.rows), f"s-{uuid.uuid4().hex}", f"d-{uuid.uuid4().hex}"
        store.write_tables(View(docs, self.mapping, self.shards), self.files, name)
        rows = self.spark.read.parquet(f"{self.files.folder}/{name}/docs").count()
        if old:
            lengths = [f"_tokens_{t}" for t in self.texts]
            dying = self._live(old).select("_segment", "_shard", "_doc", "_id", *lengths).join(ids.select("_shard", "_id"), ["_shard", "_id"], "left_semi")
            dying.select("_segment", "_shard", "_doc", *lengths).write.mode("overwrite").parquet(f"{self.files.folder}/{gone}")
            counts = {r["_segment"]: r["n"] for r in self.spark.read.schema(dying.select("_segment", "_shard", "_doc", *lengths).schema).parquet(f"{self.files.folder}/{gone}").groupBy("_segment").agg(F.count("*").alias("n")).collect()}
            if counts:
                self.dead[gone] = counts
        if rows:
            self.rows[name] = rows
        self.visible = visible
        self._commit()

    def merge(self, names: list[str] | None = None, files: int = 0) -> None:
        """Make one segment of some (all by default), without their dead documents."""
        names = list(self.rows) if names is None else names
        if not names:
            return
        live, name = self.view(None, names), f"s-{uuid.uuid4().hex}"
        made = live.postings
        if live.dead is not None:
            by = ["_shard", "field", "term", "_block"]
            rows = live.posted().withColumn("_block", F.floor(F.col("_doc") / 4096))
            packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("_doc", "tf", "len", "positions"))).alias("r"))
            made = packed.select("_shard", "term", F.col("r._doc").alias("docs"), F.col("r.tf").alias("tfs"), F.col("r.len").alias("lens"), F.col("r.positions").alias("positions"), "field")
        store.write_tables(replace(live, postings=None, dead=None), self.files, name, files, made)
        kept = self.spark.read.parquet(f"{self.files.folder}/{name}/docs").count()
        self.rows = {n: r for n, r in self.rows.items() if n not in names} | ({name: kept} if kept else {})
        self.dead = {d: {n: c for n, c in of.items() if n not in names} for d, of in self.dead.items()}
        self.dead = {d: of for d, of in self.dead.items() if of}
        self._commit()

    def tidy(self) -> None:
        """Merge the smaller half once there are too many; a large segment is rewritten as rarely as it doubles."""
        if len(self.rows) > MOST_SEGMENTS:
            self.merge(sorted(self.rows, key=self.rows.get)[: MOST_SEGMENTS // 2 + 1])

    def clear(self) -> None:
        """Delete what no manifest names any more; open plans on older states end with it."""
        named = {*self.rows, *self.dead}
        for n in self.files.names():
            if n[:2] in ("s-", "d-") and n not in named:
                self.files.delete(n)

    def counts(self) -> tuple[int, int]:
        """Live documents, and dead ones that no merge has removed yet."""
        dead = sum(c for of in self.dead.values() for c in of.values())
        return sum(self.rows.values()) - dead, dead
