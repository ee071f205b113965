"""Registered queries of the search engine, each with SQL that says the same independently.

Scores are compared rounded to six digits, and top-k lists are cut on the rounded score with the key as tie breaker, so
that the last bit of a logarithm can't change a result.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.errors import VersionConflictError
from lexispark.functions import analysis, routing
from lexispark.operators import aggregations, versions
from lexispark.operators.engine import Engine
from lexispark.operators.node import Node
from lexispark.operators.search import SortField, position_map, positions, sort_value, top_k, with_sort_values
from lexispark.mapping import Mapping
from lexispark.plans import dsl
from lexispark.plans.compile import matches
from lexispark.plans.query import Bool, Exists, MatchAll, Phrase, Query, Range, Term, scored_terms_of
from lexispark.plans.view import View
from lexispark.sources import documents, store
from lexispark.streaming.ingest import ingest

WHITE = r"[ \t\n\r]+"


@dataclass(frozen=True)
class Source:
    table: str
    key: str
    fields: dict[str, str]
    sql: str = ""

    def load(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if self.table == "labelled":
            return read("documents").join(read("labels"), "doc_id", "left")
        return read(self.table)

    def view(self, spark: SparkSession, sf_dir: str, shards: int = 1) -> View:
        return View.of_table(self.load(spark, sf_dir), self.key, self.fields, shards)

    @property
    def relation(self) -> str:
        if self.sql:
            return f"({self.sql})"
        return "(select d.*, quality, toxic from documents d left join labels using (doc_id))" if self.table == "labelled" else self.table


DOCS = Source("documents", "doc_id", {"text": "text", "lang": "keyword", "source": "keyword", "n_chars": "long"})
LABELLED = Source("labelled", "doc_id", {"text": "text", "lang": "keyword", "quality": "long", "toxic": "long"})
PARTS = Source("part", "p_partkey", {"p_name": "text", "p_brand": "keyword", "p_type": "text", "p_size": "long", "p_retailprice": "double"})
EVENTS = Source("events", "event_id", {"event_type": "keyword", "value": "double", "user_id": "long", "props": "text"})
ORDERS = Source("orders", "o_orderkey", {"o_orderstatus": "keyword", "o_orderpriority": "text", "o_totalprice": "double"})

class Sql:
    """A second, independent meaning of query trees: SQL over token lists."""

    def __init__(self, source: Source, query: Query):
        self.source, self.query = source, query
        self.mapping = Mapping.of(source.fields)
        self.texts = [n for n, s in self.mapping.fields.items() if s.type == "text" and any(n == f for f, _ in self._all_terms(query))]
        self.scored = [(f, t) for f, t in scored_terms_of(query) if f in self.mapping.fields and self.mapping.fields[f].has_terms]

    def _all_terms(self, q: Query) -> list[tuple[str, str]]:
        if isinstance(q, Term):
            return [(q.field, q.term)]
        if isinstance(q, Phrase):
            return [(q.field, t) for t in q.terms]
        if isinstance(q, Exists):
            return [(q.field, "")]
        return [t for c in q.children() for t in self._all_terms(c)]

    @staticmethod
    def text(value: str) -> str:
        return "'" + value.replace("'", "''") + "'"

    def has(self, f: str, t: str) -> str:
        kind = self.mapping.fields[f].type if f in self.mapping.fields else None
        if kind == "text":
            return f"list_contains(t_{f}, {self.text(t)})"
        return f"coalesce({f} = {self.text(t)}, false)" if kind == "keyword" else "false"

    def match(self, q: Query) -> str:
        if isinstance(q, MatchAll):
            return "true"
        if isinstance(q, Term):
            return self.has(q.field, q.term)
        if isinstance(q, Phrase):
            return f"contains(' ' || array_to_string(t_{q.field}, ' ') || ' ', {self.text(' ' + ' '.join(q.terms) + ' ')})"
        if isinstance(q, Exists):
            return f"len(t_{q.field}) > 0" if self.mapping.fields[q.field].type == "text" else f"coalesce({q.field}::varchar <> '', false)"
        if isinstance(q, Range):
            return f"coalesce({q.field} between {q.low!r} and {q.high!r}, false)"
        if isinstance(q, Bool):
            needed = [self.match(c) for c in q.must + q.filter]
            if not needed and q.should:
                needed = ["(" + " or ".join(self.match(c) for c in q.should) + ")"]
            return "(" + " and ".join(needed + [f"not {self.match(c)}" for c in q.must_not]) + ")" if needed else "false"
        return "false"

    def score(self, q: Query) -> str:
        if isinstance(q, Term):
            return self.bm25(q.field, q.term)
        if isinstance(q, Phrase):
            return "(" + " + ".join(self.bm25(q.field, t) for t in q.terms) + ")"
        if isinstance(q, Bool):
            parts = [self.score(c) for c in q.must] + [f"case when {self.match(c)} then {self.score(c)} else 0 end" for c in q.should]
            return "(" + " + ".join(parts or ["0.0::double"]) + ")"
        return "1.0::double"

    def bm25(self, f: str, t: str) -> str:
        if (f, t) not in self.scored:
            return "0.0::double"
        df = f"df{self.scored.index((f, t))}"
        idf = f"ln(1 + (n - {df} + 0.5) / ({df} + 0.5))"
        if self.mapping.fields[f].type != "text":
            return f"{idf} * (2.2 / (1 + 1.2 * 0.25))::double"
        tf = f"len(list_filter(t_{f}, lambda x: x = {self.text(t)}))"
        return f"{idf} * (({tf} * 2.2::double) / ({tf} + 1.2::double * (0.25::double + 0.75::double * len(t_{f}) / (case when s_{f} = 0 then 1 else s_{f} / n end))))"

    def rows(self, columns: str) -> str:
        """with ... select: matching rows with ``columns`` and score."""
        tokens = "".join(f", list_filter(regexp_split_to_array(lower({f}), '{WHITE}'), lambda x: x <> '') as t_{f}" for f in self.texts)
        stats = "".join(f", sum(len(t_{f}))::double as s_{f}" for f in self.texts) + "".join(f", count_if({self.has(f, t)})::double as df{i}" for i, (f, t) in enumerate(self.scored))
        return (
            f"with tok as (select *{tokens} from {self.source.relation}), st as (select count(*)::double as n{stats} from tok), "
            f"found as (select tok.*, round({self.score(self.query)}, 6)::double as score from tok, st where {self.match(self.query)}) select {columns} from found"
        )


@dataclass(frozen=True)
class Search:
    source: Source
    body: dict[str, Any]
    k: int = 10
    sort: tuple[tuple[str, bool], ...] = field(default=())

    def query(self) -> Query:
        return dsl.parse(self.body, Mapping.of(self.source.fields))

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        view = self.source.view(spark, sf_dir)
        if self.sort:
            keys = [SortField(n, r) for n, r in self.sort]
            hits = top_k(view, self.query(), self.k, keys, digits=6)
            return hits.select(F.col("_doc").alias("doc"), *[sort_value(view, n).alias(f"sort_{i}") for i, (n, _) in enumerate(self.sort)])
        return top_k(view, self.query(), self.k, digits=6).select(F.col("_doc").alias("doc"), F.col("_score").alias("score"))

    def sql(self) -> str:
        made = Sql(self.source, self.query())
        if not self.sort:
            return made.rows(f"{self.source.key}::bigint as doc, score") + f" order by score desc, doc limit {self.k}"
        kinds = Mapping.of(self.source.fields).fields
        values = ["score" if n == "_score" else f"coalesce({n}, 0)" if kinds[n].type in ("long", "double") else n for n, _ in self.sort]
        columns = ", ".join(f"{v} as sort_{i}" for i, v in enumerate(values))
        order = ", ".join(f"{v} {'desc nulls last' if r else 'asc nulls first'}" for v, (_, r) in zip(values, self.sort))
        return made.rows(f"{self.source.key}::bigint as doc, {columns}") + f" order by {order}, doc limit {self.k}"


_text = lambda kind, body: {kind: {"text": body}}
SEARCHES: dict[str, Search] = {
    "term_keyword": Search(DOCS, {"term": {"lang": "de"}}),
    "term_text_bm25": Search(DOCS, _text("term", "the")),
    "term_number_on_long_no_match": Search(DOCS, {"term": {"n_chars": 416}}),
    "term_unknown_field": Search(DOCS, {"term": {"nothing": "x"}}),
    "match_single": Search(DOCS, _text("match", "The")),
    "match_multi_should": Search(DOCS, _text("match", "the in und")),
    "match_duplicate_terms": Search(DOCS, _text("match", "the the in")),
    "match_zero_tokens": Search(DOCS, _text("match", "  ")),
    "match_on_keyword": Search(PARTS, {"match": {"p_brand": {"query": "Brand#13"}}}),
    "phrase_two": Search(DOCS, _text("match_phrase", "of the")),
    "phrase_three": Search(DOCS, _text("match_phrase", "the the the")),
    "phrase_repeated_term": Search(DOCS, _text("match_phrase", "the the")),
    "phrase_one": Search(DOCS, _text("match_phrase", "and")),
    "multi_match_sum": Search(PARTS, {"multi_match": {"query": "promo steel part", "fields": ["p_name", "p_type"]}}),
    "bool_must": Search(DOCS, {"bool": {"must": [_text("term", "the"), _text("term", "with")]}}),
    "bool_filter_only_zero_score": Search(DOCS, {"bool": {"filter": [{"term": {"lang": "fr"}}]}}),
    "bool_filter_must": Search(DOCS, {"bool": {"must": [_text("match", "the")], "filter": [{"term": {"source": "src3"}}]}}),
    "bool_should": Search(DOCS, {"bool": {"should": [_text("term", "und"), {"term": {"lang": "fr"}}]}}),
    "bool_must_should": Search(DOCS, {"bool": {"must": [_text("term", "the")], "should": [_text("term", "of"), {"range": {"n_chars": {"lt": 500}}}]}}),
    "bool_must_not": Search(DOCS, {"bool": {"must": [_text("term", "the")], "must_not": [_text("match_phrase", "of the"), {"term": {"source": "src1"}}]}}),
    "bool_only_must_not_empty": Search(DOCS, {"bool": {"must_not": [_text("term", "the")]}}),
    "bool_nested": Search(DOCS, {"bool": {"must": [{"bool": {"should": [_text("match_phrase", "to the"), _text("term", "und")]}}], "filter": [{"bool": {"must": [{"range": {"n_chars": {"gte": 300}}}], "must_not": [{"term": {"lang": "es"}}]}}]}}),
    "range_long_gte_lt": Search(DOCS, {"range": {"n_chars": {"gte": 400, "lt": 500}}}, 50),
    "range_long_gt_lte": Search(DOCS, {"range": {"n_chars": {"gt": "400", "lte": 500.9}}}, 50),
    "range_double": Search(PARTS, {"range": {"p_retailprice": {"gt": 950.0, "lt": 1200.0}}}, 50),
    "range_open": Search(EVENTS, {"range": {"value": {"gte": 50}}}, 50),
    "range_empty": Search(DOCS, {"range": {"n_chars": {"gt": 9223372036854775807}}}),
    "exists_text": Search(DOCS, {"exists": {"field": "text"}}, 50),
    "exists_keyword": Search(PARTS, {"exists": {"field": "p_brand"}}, 50),
    "exists_long": Search(LABELLED, {"bool": {"must": [{"exists": {"field": "quality"}}], "should": [_text("match", "the")]}}, 50),
    "exists_unmapped": Search(DOCS, {"exists": {"field": "nothing"}}),
    "match_all_topk": Search(DOCS, {"match_all": {}}, 25),
    "keyword_score": Search(PARTS, {"bool": {"must": [{"term": {"p_brand": "Brand#13"}}], "should": [{"match": {"p_type": "STEEL"}}]}}),
    "sort_numeric_asc": Search(DOCS, {"match_all": {}}, 20, (("n_chars", False),)),
    "sort_numeric_desc": Search(PARTS, {"match_all": {}}, 20, (("p_retailprice", True),)),
    "sort_numeric_missing_zero": Search(LABELLED, {"term": {"lang": "en"}}, 40, (("quality", False),)),
    "sort_string_missing_first": Search(DOCS, _text("match", "the"), 20, (("source", False),)),
    "sort_multi": Search(DOCS, {"match_all": {}}, 30, (("lang", False), ("n_chars", True))),
    "sort_by_score": Search(DOCS, {"term": {"lang": "en"}}, 20, (("_score", True), ("n_chars", False))),
    "sort_by_score_ascending": Search(PARTS, {"bool": {"should": [{"term": {"p_brand": "Brand#13"}}, {"range": {"p_size": {"lte": 10}}}]}}, 20, (("_score", False), ("p_size", False))),
}


def _filtered(body: dict[str, Any], source: Source = DOCS) -> tuple[Search, Callable]:
    search = Search(source, body)
    return search, lambda spark, sf_dir: (source.view(spark, sf_dir), matches(search.query(), source.view(spark, sf_dir), False))


def _terms(body: dict[str, Any], name: str, size: int, source: Source = DOCS) -> tuple[Callable, str]:
    search, found = _filtered(body, source)
    where = Sql(source, search.query()).rows(f"{name} as key")
    sql = f"select key, count(*) as doc_count from ({where}) where key is not null and key <> '' group by key order by doc_count desc, key" + (f" limit {size}" if size > 0 else "")
    return lambda spark, sf_dir: aggregations.terms(*found(spark, sf_dir), name, size), sql


def _value_counts(body: dict[str, Any], names: list[str], source: Source) -> tuple[Callable, str]:
    search, found = _filtered(body, source)
    columns = ", ".join(f"count({n}) as {n}" if Mapping.of(source.fields).fields[n].has_value else f"0::bigint as {n}" for n in names)
    return lambda spark, sf_dir: aggregations.value_count(*found(spark, sf_dir), *names), f"select {columns} from ({Sql(source, search.query()).rows('*')})"


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total hits and the best score in one pass over the matches."""
    query = SEARCHES["match_multi_should"].query()
    return matches(query, DOCS.view(spark, sf_dir)).agg(F.count("*").alias("total"), F.round(F.max("_score"), 6).alias("max_score"))


def tokens_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = DOCS.load(spark, sf_dir)
    return docs.select("doc_id", F.posexplode(analysis.get("standard").tokens(F.col("text"))).alias("position", "term"))


def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = PARTS.load(spark, sf_dir)
    return parts.select("p_partkey", F.explode(analysis.token_details(F.col("p_name"), analysis.get("standard"))).alias("t")).select("p_partkey", "t.term", "t.position", "t.start", "t.end")


def tokens_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = PARTS.load(spark, sf_dir)
    return parts.select("p_partkey", F.posexplode(analysis.get("ngram").tokens(F.col("p_name"))).alias("position", "term"))


def _posted(spark: SparkSession, sf_dir: str) -> View:
    view = View.of_table(DOCS.load(spark, sf_dir), "doc_id", {"text": "text", "lang": "keyword"})
    return replace(view, postings=store.blocks(view))


def postings_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _posted(spark, sf_dir).posted().filter(F.col("field").isin("text", "lang") & F.col("term").isin("the", "und", "de"))
    return found.select(F.col("_doc").alias("doc"), "field", "term", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def term_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.term_dictionary(_posted(spark, sf_dir).postings, "text")


def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _posted(spark, sf_dir).term_stats.select("field", "term", "df")


def collection_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.field_statistics(DOCS.view(spark, sf_dir)).filter("field = 'text'").select("field", "n", "sum_len")


def positions_for_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    view, query = DOCS.view(spark, sf_dir), dsl.parse(_text("match", "the of"), DOCS.view(spark, sf_dir).mapping)
    found = matches(query, view)
    hits = found.withColumn("rounded", F.round("_score", 6)).orderBy(F.desc("rounded"), "_doc").limit(10)
    return positions(view, hits, query).select(F.col("_doc").alias("doc"), "field", "term", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def position_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maps of ten hits, field to term to positions, as rows."""
    view = PARTS.view(spark, sf_dir)
    query = dsl.parse({"multi_match": {"query": "promo steel", "fields": ["p_name", "p_type"]}}, view.mapping)
    made = position_map(positions(view, top_k(view, query, 10, digits=6), query))
    fields = made.select("_id", F.explode("positions").alias("field", "terms"))
    return fields.select("_id", "field", F.explode("terms").alias("term", "at")).select("_id", "field", "term", F.array_join(F.col("at").cast("array<string>"), ",").alias("positions"))


def fetch_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top hits joined to their stored rows: the few keys go to the table."""
    view = DOCS.view(spark, sf_dir)
    found = matches(dsl.parse({"bool": {"filter": [{"range": {"n_chars": {"gte": 1000}}}]}}, view.mapping), view, False)
    hits = found.orderBy("_doc").limit(20).select("_doc")
    rows = DOCS.load(spark, sf_dir)
    return rows.join(F.broadcast(hits), rows["doc_id"] == hits["_doc"], "left_semi").select("doc_id", "lang", "source", "n_chars")


def sort_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    view, sort = DOCS.view(spark, sf_dir), [SortField("lang"), SortField("n_chars", True)]
    hits = with_sort_values(view, top_k(view, MatchAll(), 15, sort), sort)
    return hits.select(F.col("_doc").alias("doc"), F.array_join("_sort", "/").alias("sort_values"))


def shard_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DOCS.load(spark, sf_dir).select("doc_id", routing.shard(F.col("doc_id").cast("string"), 5).alias("shard"), routing.murmur3(F.col("doc_id").cast("string")).alias("hash"))


def per_shard_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores from each shard's own statistics, merged: ties go to the lower shard."""
    view = DOCS.view(spark, sf_dir, 3)
    hits = top_k(view, dsl.parse(_text("match", "the und"), view.mapping), 20, digits=6)
    return hits.select(F.col("_shard").alias("shard"), F.col("_doc").alias("doc"), F.col("_score").alias("score"))


def _murmur_sql(relation: str, key: str) -> tuple[str, str]:
    """CTEs m0 to m9 over ids of at most eleven bytes: Murmur3 step by step, ending in ``hash`` (signed)."""
    rot = lambda x, r: f"(((({x}) << {r}) | (({x}) >> {32 - r})) & 4294967295)"
    code = lambda i: f"case when {i} <= length(s) then ascii(substr(s, {i}, 1)) else 0 end"
    word = lambda i: " + ".join(f"(({code(f'{i} + {j}')}) << {8 * j})" for j in range(1, 4)) + f" + ({code(str(i))})"
    steps = [f"m0 as (select *, {key}::varchar as s from {relation})"]
    add = lambda columns: steps.append(f"m{len(steps)} as (select *, {columns} from m{len(steps) - 1})")
    add(f"({word(1)})::ubigint as w0, ({word(5)})::ubigint as w1, ({word(9)})::ubigint as w2, length(s) as n, 0::ubigint as h0")
    add(", ".join(f"(w{i} * 3432918353) & 4294967295 as a{i}" for i in range(3)))
    add(", ".join(f"({rot(f'a{i}', 15)} * 461845907) & 4294967295 as k{i}" for i in range(3)))
    for i in range(2):  # whole words change h as blocks, the rest as the tail
        add(f"xor(h{i}, k{i}) as x{i}")
        add(f"case when n >= {4 * i + 4} then ({rot(f'x{i}', 13)} * 5 + 3864292196) & 4294967295 when n > {4 * i} then x{i} else h{i} end as h{i + 1}")
    add("xor(case when n > 8 then xor(h2, k2) else h2 end, n::ubigint) as f0")
    add("(xor(f0, f0 >> 16) * 2246822507) & 4294967295 as f1")
    add("(xor(f1, f1 >> 13) * 3266489909) & 4294967295 as f2")
    add("xor(f2, f2 >> 16)::bigint as f3")
    add("(case when f3 >= 2147483648 then f3 - 4294967296 else f3 end)::int as hash")
    return ", ".join(steps), f"m{len(steps) - 1}"


_HASHED, _LAST = _murmur_sql("documents", "doc_id")


def _per_shard_sql() -> str:
    term = lambda t, df: f"ln(1 + (n_ - {df} + 0.5) / ({df} + 0.5)) * ((tf_{t} * 2.2::double) / (tf_{t} + 1.2::double * (0.25::double + 0.75::double * len(t) / (sum_ / n_))))"
    return (
        f"with {_HASHED}, tok as (select doc_id, ((hash % 3) + 3) % 3 as shard, list_filter(regexp_split_to_array(lower(text), '{WHITE}'), lambda x: x <> '') as t from {_LAST}), "
        "tf as (select *, len(list_filter(t, lambda x: x = 'the')) as tf_the, len(list_filter(t, lambda x: x = 'und')) as tf_und from tok), "
        "st as (select shard, count(*)::double as n_, sum(len(t))::double as sum_, count_if(tf_the > 0)::double as df_the, count_if(tf_und > 0)::double as df_und from tf group by shard) "
        f"select shard::int as shard, doc_id as doc, round(case when tf_the > 0 then {term('the', 'df_the')} else 0 end + case when tf_und > 0 then {term('und', 'df_und')} else 0 end, 6) as score "
        "from tf join st using (shard) where tf_the > 0 or tf_und > 0 order by score desc, shard, doc limit 20"
    )


def global_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three shards with collection-wide statistics give the scores of one."""
    view = DOCS.view(spark, sf_dir, 3).in_one_shard()
    found = matches(dsl.parse(_text("match", "the und"), view.mapping), view)
    return found.select(F.col("_doc").alias("doc"), F.round("_score", 6).alias("score")).orderBy(F.desc("score"), "doc").limit(20)


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a log of writes to customers: every tenth order deletes."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    op = F.when(F.col("o_orderkey") % 10 == 0, "delete").otherwise("index")
    return orders.select(F.lit(0).alias("_shard"), F.col("o_custkey").cast("string").alias("_id"), F.col("o_orderkey").alias("_seq_no"), F.lit(1).cast("long").alias("_primary_term"), op.alias("op"), F.col("o_orderpriority").alias("_source"))


_LOG_SQL = "log as (select o_custkey::varchar as id, o_orderkey as seq, case when o_orderkey % 10 = 0 then 'delete' else 'index' end as op, o_orderpriority as source from orders), last as (select id, max(seq) as seq, arg_max(op, seq) as op, arg_max(source, seq) as source, count_if(op = 'index') as written from log group by id)"


def upsert_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.latest(_log(spark, sf_dir)).select(F.col("_id").alias("id"), F.col("_seq_no").alias("seq"), F.col("_source").alias("source"))


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.latest(_log(spark, sf_dir), live_only=False).filter("op = 'delete'").select(F.col("_id").alias("id"), F.col("_seq_no").alias("seq"))


def live_deleted_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.counts(_log(spark, sf_dir)).select("live", "deleted")


def log_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    return versions.snapshot(log.unionByName(log), 100, 5000).select(F.col("_seq_no").alias("seq"), "op")


def delete_by_term_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose type holds a term that an order deletes later: deletes hit only what was written before."""
    parts = PARTS.load(spark, sf_dir).select(F.col("p_partkey").alias("_seq_no"), analysis.get("standard").tokens(F.col("p_type")).alias("terms"))
    deletes = spark.createDataFrame([("steel", 150), ("promo", 60), ("steel", 40)], "term string, _delete_seq long")
    return versions.delete_by_term(parts, deletes).select(F.col("_seq_no").alias("part"))


def json_document_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ["p_name", "p_brand", "p_size", "p_retailprice"]
    rows = PARTS.load(spark, sf_dir).select("p_partkey", F.to_json(F.struct(*fields)).alias("_source"))
    made = documents.parse(rows, Mapping.of({n: PARTS.fields[n] for n in fields}))
    return made.select("p_partkey", "_error", *[F.element_at(n, -1).alias(n) for n in fields])


def rejected_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as numbers are refused, with the field that refuses."""
    rows = PARTS.load(spark, sf_dir).select("p_partkey", F.to_json(F.struct(F.col("p_size").alias("a"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(F.lit("7")).alias("b"))).alias("_source"))
    return documents.parse(rows, Mapping.of({"a": "long", "b": "long"})).filter("_error is not null").select("p_partkey", F.col("_error").alias("error"))


def _folder(spark: SparkSession) -> str:
    return store.own_folder(spark)


def saved_index_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search from saved postings."""
    folder = _folder(spark)
    store.save(View.of_table(DOCS.load(spark, sf_dir), "doc_id", {"text": "text", "lang": "keyword"}), folder)
    view = store.load(spark, folder)
    query = dsl.parse({"bool": {"must": [_text("match", "the in und")], "filter": [{"term": {"lang": "en"}}], "must_not": [_text("match_phrase", "of the")]}}, view.mapping)
    return matches(query, view).select(F.col("_doc").alias("doc"), F.round("_score", 6).alias("score")).orderBy(F.desc("score"), "doc").limit(10)


def compacted_index_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    store.save(View.of_table(PARTS.load(spark, sf_dir), "p_partkey", PARTS.fields), folder)
    store.compact(spark, folder)
    view = store.load(spark, folder)
    query = dsl.parse({"bool": {"must": [{"range": {"p_size": {"gte": 10, "lt": 20}}}], "should": [{"match": {"p_type": "steel"}}]}}, view.mapping)
    return matches(query, view).select(F.col("_doc").alias("doc"), F.round("_score", 6).alias("score"))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written twice by a stream, refreshed, and counted by brand."""
    folder = _folder(spark)
    schema = PARTS.load(spark, sf_dir).schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/part.parque[t]")
    rows = stream.select(F.explode(F.array(*[F.col("p_partkey").cast("string")] * 2)).alias("_id"), F.to_json(F.struct("p_brand", "p_size")).alias("_source"))
    engine = Engine(spark, f"{folder}/index", Mapping.of({"p_brand": "keyword", "p_size": "long"}), 2)
    ingest(rows, engine, f"{folder}/progress").awaitTermination()
    view = engine.view()
    return aggregations.terms(view, matches(MatchAll(), view, False), "p_brand", 0)


_CHANGED = (
    "select p_partkey, case when p_partkey % 5 = 0 then 'renewed ' || p_name else p_name end as p_name, p_brand, p_type, p_size::bigint as p_size, p_retailprice "
    "from part where p_partkey % 7 <> 0"
)
CHANGED = Source("part", "p_partkey", PARTS.fields, _CHANGED)
_RENEWED = {"bool": {"must": [{"match": {"p_type": "steel promo"}}], "should": [{"match": {"p_name": "renewed"}}, {"match_phrase": {"p_type": "promo plated"}}], "must_not": [{"term": {"p_brand": "Brand#13"}}]}}


def _changed_parts(spark: SparkSession, sf_dir: str, shards: int = 1) -> Engine:
    """Parts in one segment, every fifth renewed and every seventh deleted by a second one."""
    parts = PARTS.load(spark, sf_dir)
    engine = Engine(spark, _folder(spark), Mapping.of(PARTS.fields), shards)
    row = lambda name: F.to_json(F.struct(name, "p_brand", "p_type", "p_size", "p_retailprice")).alias("_source")
    key = F.col("p_partkey").cast("string").alias("_id")
    engine.append(parts.select(key, row(F.col("p_name"))))
    engine.refresh()
    op = F.when(F.col("p_partkey") % 7 == 0, "delete").otherwise("index").alias("op")
    engine.append(parts.filter("p_partkey % 5 = 0 or p_partkey % 7 = 0").select(key, row(F.concat(F.lit("renewed "), "p_name").alias("p_name")), op))
    engine.refresh()
    return engine


def segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search over two segments and their dead documents, with the statistics of the live ones."""
    view = _changed_parts(spark, sf_dir).view()
    found = matches(dsl.parse(_RENEWED, view.mapping), view)
    return found.select(F.col("_id").cast("long").alias("doc"), F.round("_score", 6).alias("score"))


def merged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after flush and merge, by a new reader."""
    engine = _changed_parts(spark, sf_dir)
    engine.compact()
    view = Engine(spark, engine.folder, engine.mapping).view()
    found = matches(dsl.parse(_RENEWED, view.mapping), view)
    return found.select(F.col("_id").cast("long").alias("doc"), F.round("_score", 6).alias("score"))


def segment_delete_by_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left, with its latest name, when all parts of a brand are deleted by their postings."""
    engine = _changed_parts(spark, sf_dir)
    engine.delete_by_term("p_brand", "Brand#13")
    return engine.view().docs.select(F.col("_id").cast("long").alias("p_partkey"), F.element_at("p_name", -1).alias("p_name"))


def get_after_bulk_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real-time reads and version checks after single writes that a bulk write replaced; nothing is refreshed."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    engine = Engine(spark, _folder(spark), Mapping.of({"n": "keyword"}))
    for i in range(3):
        engine.index(str(i), '{"n":"old"}')
    key = F.col("n_nationkey").cast("string").alias("_id")
    engine.append(nations.select(key, F.to_json(F.struct(F.col("n_name").alias("n"))).alias("_source")))
    out = []
    for i, v in engine._versions([str(i) for i in range(25)]).items():
        conflict = None
        if int(i) < 3:
            try:
                engine.index(i, "{}", if_seq_no=int(i), if_primary_term=1)
                conflict = False
            except VersionConflictError:
                conflict = True
        out.append((int(i), json.loads(v.source)["n"], conflict))
    return spark.createDataFrame(out, "n_nationkey long, name string, conflict boolean")


def numbers_after_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last operation is a delete; after compaction and reopening the next write has a higher number all the same."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    engine = Engine(spark, _folder(spark), Mapping.of({"n": "keyword"}))
    engine.append(nations.select(F.col("n_nationkey").cast("string").alias("_id"), F.to_json(F.struct(F.col("n_name").alias("n"))).alias("_source")))
    last = engine.delete("7")["_seq_no"]
    engine.compact()
    again = Engine(spark, engine.folder, engine.mapping)
    found = again.index("new", '{"n":"x"}')
    again.refresh()
    return again.view().docs.select("_id", F.lit(found["_seq_no"] > last).alias("higher"), F.lit(found["result"]).alias("result"))


def node_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, default number of hits, and two aggregations of one request to a node of three shards."""
    node = Node(spark, _folder(spark))
    node.create_index("parts", {n: PARTS.fields[n] for n in ("p_type", "p_brand", "p_size")}, shards=3)
    parts = PARTS.load(spark, sf_dir)
    node.engine("parts").append(parts.select(F.col("p_partkey").cast("string").alias("_id"), F.to_json(F.struct("p_type", "p_brand", "p_size")).alias("_source")))
    node.bulk('{"delete":{"_id":"1"}}\n{"index":{"_id":"2"}}\n{"p_type":"STEEL BRUSHED","p_brand":"Brand#99"}\n', "parts")
    node.refresh("parts")
    made = node.search("parts", {"query": {"match": {"p_type": "brushed"}}, "size": -1, "aggs": {"brands": {"terms": {"field": "p_brand", "size": 1000}}, "sized": {"value_count": {"field": "p_size"}}}})
    rows = [("total", "", made["hits"]["total"]["value"]), ("hits", "", len(made["hits"]["hits"])), ("sized", "", made["aggregations"]["sized"]["value"])]
    rows += [("brands", b["key"], b["doc_count"]) for b in made["aggregations"]["brands"]["buckets"]]
    return spark.createDataFrame(rows, "kind string, key string, value long")


#: SQL by hand for queries of the JSON language, so that bounds and shapes aren't read by the parser twice.
BY_HAND = {
    "term_keyword": "select doc_id as doc, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * (2.2 / 1.3), 6) as score from documents, (select count(*)::double as n, count_if(lang = 'de')::double as df from documents) where lang = 'de' order by doc limit 10",
    "term_number_on_long_no_match": "select doc_id as doc, 0.0::double as score from documents where false",
    "bool_filter_only_zero_score": "select doc_id as doc, 0.0::double as score from documents where lang = 'fr' order by doc limit 10",
    "bool_only_must_not_empty": "select doc_id as doc, 0.0::double as score from documents where false",
    "range_long_gte_lt": "select doc_id as doc, 1.0::double as score from documents where n_chars >= 400 and n_chars < 500 order by doc limit 50",
    "range_long_gt_lte": "select doc_id as doc, 1.0::double as score from documents where n_chars > 400 and n_chars <= 500 order by doc limit 50",
    "range_double": "select p_partkey as doc, 1.0::double as score from part where p_retailprice > 950 and p_retailprice < 1200 order by doc limit 50",
    "range_open": "select event_id as doc, 1.0::double as score from events where value >= 50 order by doc limit 50",
    "range_empty": "select doc_id as doc, 1.0::double as score from documents where false",
    "exists_keyword": "select p_partkey as doc, 1.0::double as score from part where p_brand <> '' order by doc limit 50",
    "exists_unmapped": "select doc_id as doc, 1.0::double as score from documents where false",
    "match_all_topk": "select doc_id as doc, 1.0::double as score from documents order by doc limit 25",
    "sort_numeric_asc": "select doc_id as doc, n_chars as sort_0 from documents order by n_chars, doc_id limit 20",
    "sort_multi": "select doc_id as doc, lang as sort_0, n_chars as sort_1 from documents order by lang nulls first, n_chars desc, doc_id limit 30",
}

_TOK = f"tok as (select doc_id, lang, list_filter(regexp_split_to_array(lower(text), '{WHITE}'), lambda x: x <> '') as t from documents)"
_PLACED = f"{_TOK}, placed as (select doc_id, unnest(t) as term, unnest(range(0, len(t))) as p from tok)"

OTHERS: dict[str, tuple[Callable, str | None]] = {
    "match_none": (lambda spark, sf_dir: Search(DOCS, _text("match", "")).run(spark, sf_dir), Search(DOCS, _text("match", "")).sql()),
    "terms_agg_all": _terms({"match_all": {}}, "source", 10),
    "terms_agg_filtered": _terms(_text("match", "und"), "lang", 10),
    "terms_agg_size": _terms({"range": {"n_chars": {"gte": 500}}}, "source", 3),
    "terms_agg_every_bucket": _terms({"match_all": {}}, "p_brand", 0, PARTS),
    "value_count_keyword": _value_counts(_text("match", "the"), ["lang", "source", "text"], DOCS),
    "value_count_numeric_nullable": _value_counts({"match_all": {}}, ["quality", "toxic", "lang"], LABELLED),
    "totals": (totals, f"select count(*) as total, max(score) as max_score from ({Sql(DOCS, SEARCHES['match_multi_should'].query()).rows('score')})"),
    "tokens_whitespace": (tokens_whitespace, f"with {_PLACED} select doc_id, p::int as position, term from placed"),
    "token_offsets": (
        token_offsets,
        f"with t as (select p_partkey, list_filter(regexp_split_to_array(p_name, '{WHITE}'), lambda x: x <> '') as t from part), u as (select p_partkey, unnest(t) as w, unnest(range(0, len(t))) as i, t from t) "
        "select p_partkey, lower(w) as term, i::int as position, (i + coalesce(list_sum(list_transform(t[1:i], lambda x: strlen(x))), 0))::int as start, (i + coalesce(list_sum(list_transform(t[1:i], lambda x: strlen(x))), 0) + strlen(w))::int as \"end\" from u",
    ),
    "tokens_ngram": (
        tokens_ngram,
        "with g as (select p_partkey, list_concat(list_transform(range(1, length(p_name)), lambda i: substr(lower(p_name), i, 2)), list_transform(range(1, length(p_name) - 1), lambda i: substr(lower(p_name), i, 3))) as t from part) "
        "select p_partkey, unnest(range(0, len(t)))::int as position, unnest(t) as term from g",
    ),
    "postings_scan": (
        postings_scan,
        f"with {_PLACED} select doc_id as doc, 'text' as field, term, count(*)::int as tf, string_agg(p::varchar, ',' order by p) as positions from placed where term in ('the', 'und', 'de') group by all "
        "union all select doc_id, 'lang', lang, 1, '0' from documents where lang in ('the', 'und', 'de')",
    ),
    "term_dictionary": (term_dictionary, f"with {_PLACED} select distinct term from placed"),
    "term_stats": (term_stats, f"with {_PLACED} select 'text' as field, term, count(distinct doc_id) as df from placed group by term union all select 'lang', lang, count(*) from documents group by lang"),
    "collection_stats": (collection_stats, f"with {_TOK} select 'text' as field, count(*) as n, sum(len(t))::bigint as sum_len from tok"),
    "positions_for_hits": (
        positions_for_hits,
        f"with hits as ({Sql(DOCS, dsl.parse(_text('match', 'the of'), Mapping.of(DOCS.fields))).rows('doc_id, score')} order by score desc, doc_id limit 10), {_PLACED} "
        "select doc_id as doc, 'text' as field, term, string_agg(p::varchar, ',' order by p) as positions from placed join hits using (doc_id) where term in ('the', 'of') group by all",
    ),
    "position_maps": (
        position_maps,
        f"with hits as ({Sql(PARTS, dsl.parse({'multi_match': {'query': 'promo steel', 'fields': ['p_name', 'p_type']}}, Mapping.of(PARTS.fields))).rows('p_partkey, score')} order by score desc, p_partkey limit 10), "
        f"w as (select p_partkey, 'p_name' as field, regexp_split_to_array(lower(p_name), '{WHITE}') as t from part union all select p_partkey, 'p_type', regexp_split_to_array(lower(p_type), '{WHITE}') from part), "
        "u as (select p_partkey, field, unnest(t) as term, unnest(range(0, len(t))) as p from w) "
        "select p_partkey::varchar as _id, field, term, string_agg(p::varchar, ',' order by p) as positions from u join hits using (p_partkey) where term in ('promo', 'steel') group by all",
    ),
    "fetch_sources": (fetch_sources, "select doc_id, lang, source, n_chars from documents where n_chars >= 1000 order by doc_id limit 20"),
    "sort_values": (sort_values, "select doc_id as doc, lang || '/' || n_chars::varchar as sort_values from documents order by lang, n_chars desc, doc_id limit 15"),
    "shard_routing": (shard_routing, f"with {_HASHED} select doc_id, (((hash % 5) + 5) % 5)::int as shard, hash from {_LAST}"),
    "per_shard_topk": (per_shard_topk, _per_shard_sql()),
    "global_merge": (global_merge, Search(DOCS, _text("match", "the und"), 20).sql()),
    "upsert_latest_wins": (upsert_latest_wins, f"with {_LOG_SQL} select id, seq, source from last where op = 'index'"),
    "tombstones": (tombstones, f"with {_LOG_SQL} select id, seq from last where op = 'delete'"),
    "live_deleted_counts": (live_deleted_counts, f"with {_LOG_SQL} select count_if(op = 'index')::bigint as live, sum(written - (op = 'index')::int)::bigint as deleted from last"),
    "log_snapshot": (log_snapshot, f"with {_LOG_SQL} select seq, op from log where seq between 100 and 5000"),
    "delete_by_term_ordered": (
        delete_by_term_ordered,
        f"with t as (select p_partkey, regexp_split_to_array(lower(p_type), '{WHITE}') as t from part) select p_partkey as part from t where not (list_contains(t, 'steel') and p_partkey < 150) and not (list_contains(t, 'promo') and p_partkey < 60)",
    ),
    "json_document_parse": (json_document_parse, "select p_partkey, null::varchar as _error, p_name, p_brand, p_size::bigint as p_size, p_retailprice from part"),
    "rejected_documents": (rejected_documents, "select p_partkey, 'failed to parse field [b] of type [long]' as error from part where p_partkey % 3 = 0"),
    "saved_index_match": (
        saved_index_match,
        Search(DOCS, {"bool": {"must": [_text("match", "the in und")], "filter": [{"term": {"lang": "en"}}], "must_not": [_text("match_phrase", "of the")]}}).sql(),
    ),
    "compacted_index_range": (compacted_index_range, Sql(PARTS, dsl.parse({"bool": {"must": [{"range": {"p_size": {"gte": 10, "lt": 20}}}], "should": [{"match": {"p_type": "steel"}}]}}, Mapping.of(PARTS.fields))).rows("p_partkey as doc, score")),
    "segment_search": (segment_search, Sql(CHANGED, dsl.parse(_RENEWED, Mapping.of(PARTS.fields))).rows("p_partkey::bigint as doc, score")),
    "merged_search": (merged_search, Sql(CHANGED, dsl.parse(_RENEWED, Mapping.of(PARTS.fields))).rows("p_partkey::bigint as doc, score")),
    "segment_delete_by_term": (segment_delete_by_term, f"select p_partkey, p_name from ({_CHANGED}) where p_brand <> 'Brand#13'"),
    "get_after_bulk_write": (get_after_bulk_write, "select n_nationkey::bigint as n_nationkey, n_name as name, case when n_nationkey < 3 then true end as conflict from nation"),
    "numbers_after_compaction": (numbers_after_compaction, "select n_nationkey::varchar as _id, true as higher, 'created' as result from nation where n_nationkey <> 7 union all select 'new', true, 'created'"),
    "node_response": (
        node_response,
        "with d as (select case when p_partkey = 2 then 'STEEL BRUSHED' else p_type end as t, case when p_partkey = 2 then 'Brand#99' else p_brand end as b, case when p_partkey = 2 then null else p_size end as z from part where p_partkey <> 1), "
        f"f as (select * from d where list_contains(regexp_split_to_array(lower(t), '{WHITE}'), 'brushed')) "
        "select 'total' as kind, '' as key, count(*) as value from f union all select 'hits', '', least(10, count(*)) from f union all select 'sized', '', count(z) from f union all select 'brands', b, count(*) from f group by b",
    ),
    "stream_ingest": (stream_ingest, "select p_brand as key, count(*) as doc_count from part group by p_brand"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: s.run for name, s in SEARCHES.items()} | {name: run for name, (run, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s.sql() for name, s in SEARCHES.items()} | BY_HAND | {name: sql for name, (_, sql) in OTHERS.items() if sql}
