import json

import pytest
from pyspark.sql import functions as F

from lexispark.errors import AlreadyExistsError, IndexNotFoundError, InvalidNameError, MapperParsingError, QueryParsingError, VersionConflictError
from lexispark.mapping import Mapping
from lexispark.operators import versions
from lexispark.operators.engine import Engine
from lexispark.operators.node import Node
from lexispark.plans.query import MatchAll, Phrase, Term
from lexispark.streaming.ingest import ingest


@pytest.fixture
def node(spark, tmp_path):
    return Node(spark, f"file://{tmp_path}/node")


def test_index_names_and_errors(node):
    node.create_index("docs", {"t": "text"}, shards=2, replicas=1)
    with pytest.raises(AlreadyExistsError):
        node.create_index("docs")
    for bad in ("Docs", "_x", "", "a b"):
        with pytest.raises(InvalidNameError):
            node.create_index(bad)
    with pytest.raises(MapperParsingError):
        node.create_index("other", {"t": "vector"})
    with pytest.raises(IndexNotFoundError):
        node.search("nope")
    assert node.get_index("docs")["docs"]["mapping"] == {"t": {"type": "text"}}
    assert node.cat_health()["status"] == "yellow"
    assert Node(node.spark, node.files.folder).get_index("docs") == node.get_index("docs")
    node.delete_index("docs")
    with pytest.raises(IndexNotFoundError):
        node.get_index("docs")


def test_writes_versions_and_visibility(node):
    node.create_index("docs", {"title": "text", "status": "keyword"})
    first = node.index("docs", "a", '{"title":"hello world"}')
    assert (first["result"], first["_seq_no"], first["_primary_term"]) == ("created", 0, 1)
    assert node.search("docs")["hits"]["total"]["value"] == 0 and node.get("docs", "a")["found"]
    assert node.delete("docs", "a")["result"] == "deleted"
    assert node.delete("docs", "a") == {"_index": "docs", "_id": "a", "result": "deleted", "_seq_no": 2, "_primary_term": 1}
    assert node.index("docs", "a", '{"title":"hello again"}')["_seq_no"] == 3
    node.refresh("docs")
    assert node.index("docs", "a", '{"title":"hello go"}', if_seq_no=3, if_primary_term=1)["result"] == "updated"
    for conditions in ({"if_seq_no": 3, "if_primary_term": 1}, {"if_seq_no": 4, "if_primary_term": 2}):
        with pytest.raises(VersionConflictError):
            node.index("docs", "a", "{}", **conditions)
    with pytest.raises(VersionConflictError):
        node.delete("docs", "missing", if_seq_no=0, if_primary_term=1)
    assert node.search("docs", {"query": {"match": {"title": "again"}}})["hits"]["total"]["value"] == 1
    node.refresh("docs")
    assert node.delete("docs", "missing")["result"] == "not_found"
    reopened = Node(node.spark, node.files.folder)
    assert reopened.get("docs", "a")["_source"] == '{"title":"hello go"}'
    assert reopened.index("docs", "b", "{}")["_seq_no"] == 6
    assert reopened.cat_indices()[0] | {"docs.count": 1} == reopened.cat_indices()[0]


def test_bulk_and_search(node):
    node.create_index("products", {"name": "text", "category": "keyword", "price": "double"}, shards=2)
    items = [("1", "wireless mouse", "electronics", 25), ("2", "mechanical keyboard", "electronics", 80), ("3", "wireless headphones", "electronics", 120), ("4", "cotton shirt", "clothing", 15)]
    body = "".join(json.dumps({"index": {"_index": "products", "_id": i}}) + "\n" + json.dumps({"name": n, "category": c, "price": p}) + "\n" for i, n, c, p in items)
    body += '{"create":{"_index":"products","_id":"1"}}\n{}\n{"index":{"_index":"products","_id":"5"}}\n{"price":"much"}\n{"delete":{"_index":"gone","_id":"1"}}\n{"delete":{"_index":"products","_id":"zz"}}\n'
    out = node.bulk(body)
    assert out["errors"] and [next(iter(i.values()))["status"] for i in out["items"]] == [201, 201, 201, 201, 409, 400, 404, 200]
    node.refresh("products")
    total = lambda q: node.search("products", {"query": q})["hits"]["total"]["value"]
    assert total({"match": {"name": "wireless"}}) == 2 and total({"term": {"category": "electronics"}}) == 3
    hits = node.search("products", {"query": {"bool": {"must": [{"term": {"category": "electronics"}}], "must_not": [{"match": {"name": "wireless"}}]}}, "aggs": {"c": {"terms": {"field": "category"}}}})
    assert [json.loads(h["_source"])["name"] for h in hits["hits"]["hits"]] == ["mechanical keyboard"]
    assert hits["aggregations"]["c"]["buckets"] == [{"key": "electronics", "doc_count": 1}]
    assert len(node.search("products", {"size": 2})["hits"]["hits"]) == 2 == len(node.search("products", size=2)["hits"]["hits"])
    with pytest.raises(QueryParsingError):
        node.search("products", {"query": {"fuzzy": {}}})
    node.engine("products").compact()
    assert total({"match_all": {}}) == 4


def test_array_values(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/index", Mapping.of({"t": "text", "k": "keyword", "n": "long"}))
    engine.index("1", '{"t":["one two","three"],"k":["a","a","b"],"n":[1,9]}')
    engine.index("2", '{"t":"two three","k":"b"}')
    engine.refresh()
    search = engine.searcher()
    ids = lambda q: {r["_id"] for r in search.hits(q).collect()}
    assert ids(Phrase("t", ("two", "three"))) == {"2"} and ids(Term("t", "three")) == {"1", "2"} and ids(Term("k", "a")) == {"1"}
    assert search.search({"aggs": {"k": {"terms": {"field": "k"}}, "n": {"value_count": {"field": "n"}}}})["aggregations"] == {"k": {"buckets": [{"key": "b", "doc_count": 2}]}, "n": {"value": 1}}


def test_log_operations(spark):
    rows = [(0, "a", 0, 1, "index", "1"), (0, "a", 2, 1, "index", "2"), (0, "b", 1, 1, "index", "3"), (0, "b", 3, 1, "delete", None), (1, "c", 0, 1, "delete", None)]
    log = spark.createDataFrame(rows, versions.LOG)
    assert [(r["_id"], r["_seq_no"], r["_source"]) for r in versions.latest(log).collect()] == [("a", 2, "2")]
    assert {(r["_shard"], r["live"], r["deleted"]) for r in versions.counts(log).collect()} == {(0, 1, 2), (1, 0, 0)}
    assert versions.snapshot(log.unionByName(log), 1, 2).count() == 2
    docs = spark.createDataFrame([(0, ["x"]), (5, ["x", "y"]), (6, ["z"])], "_seq_no long, terms array<string>")
    deletes = spark.createDataFrame([("x", 3), ("y", 5), ("z", 100)], "term string, _delete_seq long")
    assert {r["_seq_no"] for r in versions.delete_by_term(docs, deletes).collect()} == {5}


def test_stream_batches_count_once(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/index", Mapping.of({"k": "keyword"}), 2)
    source = f"file://{tmp_path}/in"
    spark.range(20).select(F.col("id").cast("string").alias("_id"), F.format_string('{"k":"v%d"}', F.col("id") % 3).alias("_source"), F.lit("index").alias("op")).write.parquet(source)
    stream = spark.readStream.schema("_id string, _source string, op string").parquet(source)
    ingest(stream, engine, f"file://{tmp_path}/progress").awaitTermination()
    assert engine.searcher().count(MatchAll()) == 20
    engine.append(spark.createDataFrame([("0", None, "delete"), ("1", '{"k":7}', "index"), ("x", '{"k":{}}', "index")], "_id string, _source string, op string"), "again")
    engine.append(spark.createDataFrame([("0", None, "delete"), ("1", '{"k":7}', "index")], "_id string, _source string, op string"), "again")
    engine.refresh()
    assert engine.searcher().count(MatchAll()) == 19 and engine.searcher().count(Term("k", "7")) == 1
