"""Search: top-k by score or fields, totals, positions and aggregations of one query."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lexispark.errors import QueryParsingError
from lexispark.operators import aggregations
from lexispark.plans import dsl
from lexispark.plans.compile import matches
from lexispark.plans.query import Query, terms_of
from lexispark.plans.view import View

SCORE, DOC = "_score", "_doc"


@dataclass(frozen=True)
class SortField:
    """A field, the score or the document order; a missing number counts as 0, a missing string as the smallest."""

    name: str
    reverse: bool = False


def sort_value(view: View, name: str) -> Column:
    if name in (SCORE, DOC):
        return F.col(name)
    spec = view.mapping.fields.get(name)
    if spec is None or not spec.has_value:
        raise QueryParsingError(f"can't sort by [{name}]")
    value = view.value(name)
    return F.coalesce(value, F.lit(0)) if spec.type in ("long", "double") else value


def _ordered(view: View, found: DataFrame, sort: list[SortField] | None) -> DataFrame:
    if not sort:
        return found.orderBy(F.desc(SCORE), "_shard", "_doc")
    keys = [sort_value(view, s.name) for s in sort]
    return found.orderBy(*[k.desc_nulls_last() if s.reverse else k.asc_nulls_first() for k, s in zip(keys, sort)], "_shard", "_doc")


def top_k(view: View, query: Query, k: int = 10, sort: list[SortField] | None = None, digits: int | None = None) -> DataFrame:
    """The best k documents; ties go to the lower shard, then to the earlier document. ``digits`` rounds scores before ordering."""
    needs_score = not sort or any(s.name == SCORE for s in sort)
    found = matches(query, view, needs_score)
    found = found.withColumn(SCORE, F.round(SCORE, digits)) if digits is not None and needs_score else found
    return _ordered(view, found, sort).limit(max(1, k))


def with_sort_values(view: View, hits: DataFrame, sort: list[SortField]) -> DataFrame:
    return hits.withColumn("_sort", F.array(*[sort_value(view, s.name).cast("string") for s in sort]))


def positions(view: View, hits: DataFrame, query: Query) -> DataFrame:
    """_shard, _doc, _id, field, term and positions of the query's terms (not the excluded ones) in each hit."""
    wanted = [(f, t) for f, t in terms_of(query) if f in view.mapping.fields and view.mapping.fields[f].has_terms]
    keys = ["_shard", "_doc", "_id"]
    if not wanted:
        return hits.select(*keys, F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("term"), F.array().cast("array<int>").alias("positions")).limit(0)

    def at(field: str, term: str) -> Column:
        if view.mapping.fields[field].type != "text":
            return F.when(F.array_contains(view.tokens(field), F.lit(term)), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
        numbered = F.transform(view.tokens(field), lambda x, i: F.when(x == F.lit(term), i))
        return F.filter(numbered, lambda i: i.isNotNull())

    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(t).alias("term"), at(f, t).alias("positions")) for f, t in wanted])
    out = hits.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.field", "r.term", "r.positions")
    return out.filter(F.size("positions") > 0)


def position_map(found: DataFrame) -> DataFrame:
    """One row per hit: map of field to map of term to positions."""
    by_field = found.groupBy("_shard", "_doc", "_id", "field").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("terms"))
    return by_field.groupBy("_shard", "_doc", "_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "terms"))).alias("positions"))


class Searcher:
    """Queries on one snapshot of an index."""

    def __init__(self, view: View, sources: DataFrame | None = None):
        self.view, self.sources = view, sources

    def hits(self, query: Query, k: int = 10, sort: list[SortField] | None = None) -> DataFrame:
        return top_k(self.view, query, k, sort)

    def count(self, query: Query) -> int:
        return matches(query, self.view, False).count()

    def search(self, request: dict[str, Any] | None = None, size: int | None = None) -> dict[str, Any]:
        """Response of a request {query, size, aggs}: total, max_score, hits with sources, aggregations."""
        request = request or {}
        query = dsl.parse(request.get("query") or {"match_all": {}}, self.view.mapping)
        aggs = dsl.parse_aggregations(request.get("aggs", request.get("aggregations")))
        k = size if size is not None else request.get("size") or 0
        if not isinstance(k, (int, float)) or isinstance(k, bool):
            raise QueryParsingError(f"size [{k}] isn't a number")
        k = int(k) if k > 0 else 10
        # hits, total and aggregations read the matches once; only keys and aggregated fields are held
        used = dict.fromkeys(f for _, f, _ in aggs.values() if f in self.view.mapping.fields)
        found = matches(query, self.view).select("_shard", "_doc", "_id", SCORE, *used).persist()
        try:
            rows = _ordered(self.view, found, None).limit(k).select("_shard", "_doc", "_id", SCORE).collect()
            total = found.count()
            results = {name: aggregations.result(self.view, found, *spec) for name, spec in aggs.items()}
        finally:
            found.unpersist()
        sources = self._fetch(rows)
        hits = [{"_id": r["_id"], "_score": r[SCORE], "_source": sources.get((r["_shard"], r["_doc"]))} for r in rows]
        out = {"hits": {"total": {"value": total, "relation": "eq"}, "max_score": max((r[SCORE] for r in rows), default=0.0), "hits": hits}}
        return out | ({"aggregations": results} if aggs else {})

    def _fetch(self, rows: list[Row]) -> dict[tuple[int, int], str]:
        """Sources of the k hits only: the keys of the hits go to the table, not the table to the hits."""
        if self.sources is None or not rows:
            return {}
        wanted = F.lit(False)
        for shard in {r["_shard"] for r in rows}:
            wanted = wanted | ((F.col("_shard") == shard) & F.col("_doc").isin([r["_doc"] for r in rows if r["_shard"] == shard]))
        found = self.sources.filter(wanted).select("_shard", "_doc", "_source").collect()
        return {(r["_shard"], r["_doc"]): r["_source"] for r in found}
