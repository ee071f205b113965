"""Writes, real-time reads, refresh, flush and merge of one index: a log of operations, and segments built from it."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.errors import MapperParsingError, SearchError, VersionConflictError
from lexispark.functions import routing
from lexispark.mapping import Mapping, parse_document
from lexispark.operators import versions
from lexispark.operators.search import Searcher
from lexispark.plans.view import View
from lexispark.sources import documents
from lexispark.sources.bulk import Action
from lexispark.sources.segments import Segments
from lexispark.sources.store import Files

PRIMARY_TERM = 1


@dataclass(frozen=True)
class Version:
    seq_no: int
    op: str
    source: str | None


@dataclass
class Engine:
    """One index in a folder. Every call's operations are one file set of the log, written before it returns.

    A refresh turns the operations since the last one into a segment (documents, postings, dead documents) that searches read;
    gets and version checks see all. With ``refresh_interval`` (seconds) a search refreshes first when the last refresh is older.
    Opening an engine on an existing folder replays what the log holds beyond the segments. A flush
    removes the part of the log that the segments hold.
    """

    spark: SparkSession
    folder: str
    mapping: Mapping
    shards: int = 1
    refresh_interval: float | None = None
    _next: dict[int, int] = field(default_factory=dict)
    _refreshed: float = 0.0
    _recent: dict[str, Version] = field(default_factory=dict)

    def __post_init__(self):
        self.files = Files(self.spark, self.folder)
        self.segments = Segments(self.spark, self.files, self.mapping, self.shards)
        self._next = {s: n + 1 for s, n in self.segments.visible.items()}
        self._number(self.log())
        self.refresh()

    def log(self) -> DataFrame:
        if not self.files.exists("ops"):
            return self.spark.createDataFrame([], versions.LOG)
        return self.spark.read.schema(versions.LOG).parquet(f"{self.files.folder}/ops")

    def _number(self, rows: DataFrame) -> None:
        for r in rows.groupBy("_shard").agg(F.max("_seq_no").alias("m")).collect():
            self._next[r["_shard"]] = max(r["m"] + 1, self._next.get(r["_shard"], 0))

    def _write(self, rows: DataFrame, name: str | None = None) -> str:
        path = f"{self.files.folder}/ops/part={name or uuid.uuid4().hex}"
        rows.write.mode("overwrite").parquet(path)
        return path

    def _take(self, shard: int) -> int:
        seq = self._next.get(shard, 0)
        self._next[shard] = seq + 1
        return seq

    def append(self, rows: DataFrame, name: str | None = None) -> None:
        """Add a table of writes (_id, _source, and op if some delete) of any size, in the order of its rows.

        Sequence numbers rise with the rows and may have gaps, and later reads and version checks see these writes. The same ``name`` again replaces what it wrote before,
        which makes a repeated stream batch harmless. Documents that don't fit the mapping are refused and left out.
        """
        op = F.col("op") if "op" in rows.columns else F.lit("index")
        base = max(self._next.values(), default=0)
        numbered = rows.select("_id", "_source", op.alias("op"), (F.monotonically_increasing_id() + base).alias("_seq_no"))
        # parsing costs far more than reading: rows are spread first, however few files they come from, and written, as a filter would move below the shuffle
        pending = f"pending-{uuid.uuid4().hex}"
        numbered.repartition("_seq_no").write.parquet(f"{self.files.folder}/{pending}")
        spread = self.spark.read.schema(numbered.schema).parquet(f"{self.files.folder}/{pending}")
        good = documents.parse(spread, self.mapping).filter((F.col("op") == "delete") | F.col("_error").isNull())
        out = good.select(routing.shard(F.col("_id"), self.shards).alias("_shard"), "_id", "_seq_no", F.lit(PRIMARY_TERM).cast("long").alias("_primary_term"), "op", F.when(F.col("op") == "index", F.col("_source")).alias("_source"))
        path = self._write(out, name)
        self.files.delete(pending)
        self._number(self.spark.read.schema(versions.LOG).parquet(path))
        self._recent = {}  # any of them may be older now

    def _versions(self, ids: list[str]) -> dict[str, Version]:
        """The latest version of each id, from memory for recent writes, else from the log, else from the segments, pruned by shard and id."""
        out = {i: self._recent[i] for i in ids if i in self._recent}

        def wanted() -> Column | None:
            rest = sorted({i for i in ids if i not in out})
            shards = sorted({routing.shard_of(i, self.shards) for i in rest})
            return F.col("_shard").isin(shards) & F.col("_id").isin(rest) if rest else None

        if self.files.exists("ops") and wanted() is not None:
            found = versions.latest(self.log().filter(wanted()), live_only=False)
            out |= {r["_id"]: Version(r["_seq_no"], r["op"], r["_source"]) for r in found.collect()}
        if self.segments.rows and wanted() is not None:
            found = self.segments.view(None).docs.filter(wanted()).select("_id", "_seq_no", "_source")
            out |= {r["_id"]: Version(r["_seq_no"], "index", r["_source"]) for r in found.collect()}
        return out

    @staticmethod
    def _check(current: Version | None, if_seq_no: int | None, if_primary_term: int | None) -> None:
        if if_seq_no is None or if_primary_term is None:
            return
        if current is None or current.op == "delete":
            raise VersionConflictError("document doesn't exist")
        if (current.seq_no, PRIMARY_TERM) != (if_seq_no, if_primary_term):
            raise VersionConflictError(f"current version is [{current.seq_no}, {PRIMARY_TERM}]")

    def _apply(self, kind: str, doc_id: str, source: str | None, current: Version | None) -> tuple[dict[str, Any], tuple]:
        shard = routing.shard_of(doc_id, self.shards)
        seq = self._take(shard)
        live = current is not None and current.op == "index"
        if kind == "delete":
            # a delete of a missing document takes a number too; one that repeats a recent delete still counts as found
            result = "deleted" if live or doc_id in self._recent else "not_found"
        else:
            result = "updated" if live else "created"
        self._recent[doc_id] = Version(seq, "delete" if kind == "delete" else "index", source)
        row = (shard, doc_id, seq, PRIMARY_TERM, "delete" if kind == "delete" else "index", source)
        return {"_id": doc_id, "result": result, "_seq_no": seq, "_primary_term": PRIMARY_TERM}, row

    def _rows(self, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, versions.LOG).coalesce(1)

    def index(self, doc_id: str, source: str, if_seq_no: int | None = None, if_primary_term: int | None = None) -> dict[str, Any]:
        parse_document(source, self.mapping)
        current = self._versions([doc_id]).get(doc_id)
        self._check(current, if_seq_no, if_primary_term)
        out, row = self._apply("index", doc_id, source, current)
        self._write(self._rows([row]))
        return out

    def delete(self, doc_id: str, if_seq_no: int | None = None, if_primary_term: int | None = None) -> dict[str, Any]:
        current = self._versions([doc_id]).get(doc_id)
        self._check(current, if_seq_no, if_primary_term)
        out, row = self._apply("delete", doc_id, None, current)
        self._write(self._rows([row]))
        return out

    def get(self, doc_id: str) -> dict[str, Any]:
        """The latest version, refreshed or not."""
        current = self._versions([doc_id]).get(doc_id)
        if current is None or current.op == "delete":
            return {"_id": doc_id, "found": False}
        return {"_id": doc_id, "found": True, "_source": current.source, "_seq_no": current.seq_no, "_primary_term": PRIMARY_TERM}

    def bulk(self, actions: list[Action]) -> list[dict[str, Any]]:
        """Results in request order; an action that fails doesn't stop the others. All operations are one write."""
        current = self._versions([a.id for a in actions])
        out, rows = [], []
        for a in actions:
            try:
                if a.kind != "delete":
                    parse_document(a.source or "", self.mapping)
                now = self._recent.get(a.id, current.get(a.id))
                if a.kind == "create" and now is not None and now.op == "index":
                    raise VersionConflictError("document already exists")
                result, row = self._apply(a.kind, a.id, a.source, now)
                rows.append(row)
                status = 201 if result["result"] == "created" else 200
                out.append({a.kind: {"_index": a.index} | result | {"status": status}})
            except SearchError as e:
                out.append({a.kind: {"_index": a.index, "_id": a.id, "status": e.status, "error": {"type": e.kind, "reason": str(e)}}})
        if rows:
            self._write(self._rows(rows))
        return out

    def refresh(self) -> None:
        """Make all operations so far visible to searches; nothing is done where there are no new ones."""
        now = {s: n - 1 for s, n in self._next.items()}
        seen = self.segments.visible
        if any(n > seen.get(s, -1) for s, n in now.items()):
            fresh = [(F.col("_shard") == s) & F.col("_seq_no").between(seen.get(s, -1) + 1, n) for s, n in now.items()]
            pending = f"{self.files.folder}/pending-{uuid.uuid4().hex}"
            versions.latest(self.log().filter(reduce(lambda a, b: a | b, fresh)), live_only=False).write.parquet(pending)
            last = self.spark.read.schema(versions.LOG).parquet(pending)
            self.segments.add(self._documents(last.filter("op = 'index'")), last, now)
            self.files.delete(pending.rsplit("/", 1)[1])
            self.segments.tidy()
        self._recent = {}
        self._refreshed = time.monotonic()

    def _documents(self, log: DataFrame) -> DataFrame:
        """Parsed documents; their order is write order."""
        parsed = documents.parse(log, self.mapping).withColumn("_doc", F.col("_seq_no"))
        return parsed.select("_shard", "_doc", "_id", "_seq_no", "_source", *self.mapping.fields)

    def view(self) -> View:
        """Live documents as of the last refresh, with their postings."""
        if self.refresh_interval is not None and time.monotonic() - self._refreshed >= self.refresh_interval:
            self.refresh()
        return self.segments.view(self._documents(self.spark.createDataFrame([], versions.LOG)))

    def searcher(self) -> Searcher:
        view = self.view()
        return Searcher(view, view.docs)

    def counts(self) -> tuple[int, int]:
        """Live documents, and dead ones that segments still hold, as of the last refresh."""
        return self.segments.counts()

    def delete_by_term(self, name: str, term: str) -> int:
        """Delete the documents, as of now, that hold a term in a field; returns how many. They are found in the postings and
        deleted by one write, whatever their number."""
        self.refresh()
        view = self.view()
        if view.postings is None:
            return 0
        hit = view.posted(False).filter((F.col("field") == name) & (F.col("term") == term)).select("_shard", "_doc")
        rows = view.docs.join(hit, ["_shard", "_doc"], "left_semi").select("_id", F.lit(None).cast("string").alias("_source"), F.lit("delete").alias("op"))
        before = self.counts()[0]
        self.append(rows)
        self.refresh()
        return before - self.counts()[0]

    def flush(self) -> None:
        """Refresh, and remove from the log what the segments hold; numbers go on from the last one."""
        old = self._parts()
        self.refresh()
        for name in old:
            self.files.delete(f"ops/{name}")

    def _parts(self) -> list[str]:
        return [n for n in Files(self.spark, f"{self.files.folder}/ops").names() if n.startswith("part=")] if self.files.exists("ops") else []

    def compact(self, files: int = 0) -> None:
        """Flush, and merge all segments into one of ``files`` files a table (0: as many as its size asks for), without the dead. What no
        state names any more is deleted."""
        self.flush()
        self.segments.merge(files=files)
        self.segments.clear()


__all__ = ["Engine", "MapperParsingError"]
