import pytest

from lexispark.errors import MapperParsingError, QueryParsingError
from lexispark.functions import analysis, routing
from lexispark.mapping import Mapping, parse_document
from lexispark.plans import dsl
from lexispark.plans.query import Bool, Exists, MatchAll, MatchNone, Phrase, Range, Term, terms_of
from lexispark.sources import bulk, documents

MAPPING = Mapping.of({"t": "text", "g": {"type": "text", "analyzer": "ngram"}, "k": "keyword", "n": "long", "d": "double", "b": "boolean"})


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ({"match_all": {}}, MatchAll()),
        ({"term": {"t": "A b"}}, Term("t", "A b")),
        ({"term": {"b": True}}, Term("b", "true")),
        ('{"term": {"n": 1000000}}', Term("n", "1000000")),
        ({"match": {"t": "Fox"}}, Term("t", "fox")),
        ({"match": {"t": "a B a"}}, Bool(should=(Term("t", "a"), Term("t", "b"), Term("t", "a")))),
        ({"match": {"t": " "}}, MatchNone()),
        ({"match": {"g": "abc"}}, Bool(should=(Term("g", "ab"), Term("g", "bc"), Term("g", "abc")))),
        ({"match": {"t": {"query": "ab", "analyzer": "ngram"}}}, Term("t", "ab")),
        ({"match_phrase": {"t": "one"}}, Phrase("t", ("one",))),
        ({"match_phrase": {"t": ""}}, MatchNone()),
        ({"multi_match": {"query": "x", "fields": ["t", "k"]}}, Bool(should=(Term("t", "x"), Term("k", "x")))),
        ({"exists": {"field": "k"}}, Exists("k")),
        ({"exists": {"field": "zz"}}, MatchNone()),
        ({"bool": {"must": [{"term": {"k": "a"}}], "must_not": []}}, Bool(must=(Term("k", "a"),))),
        ({"range": {"n": {"gt": 1, "lt": 5}}}, Range("n", 2, 4)),
        ({"range": {"n": {"gte": 0, "gt": 3}}}, Range("n", 4, dsl.LONG_MAX)),
        ({"range": {"n": {"gt": dsl.LONG_MAX}}}, MatchNone()),
        ({"range": {"n": {"lt": dsl.LONG_MIN}}}, MatchNone()),
        ('{"range": {"n": {"gte": 9007199254740993}}}', Range("n", 9007199254740993, dsl.LONG_MAX)),
        ({"range": {"d": {"gte": 1.5}}}, Range("d", 1.5, dsl.DOUBLE_MAX)),
        ({"range": {"d": {"gt": 2, "lt": 2}}}, MatchNone()),
    ],
)
def test_queries(body, expected):
    assert dsl.parse(body, MAPPING) == expected


@pytest.mark.parametrize(
    "body",
    [
        {}, {"a": 1, "b": 2}, {"fuzzy": {}}, {"term": {"t": {"x": 1}}}, {"term": {"t": ["x"]}}, {"term": {"t": "a", "k": "b"}}, {"match": {"t": {"analyzer": "standard"}}},
        {"match": {"t": {"query": "x", "analyzer": "nope"}}}, {"multi_match": {"query": "x", "fields": []}}, {"multi_match": {"fields": ["t"]}}, {"exists": {}}, {"bool": {}},
        {"bool": {"must": {"match_all": {}}}}, {"bool": {"other": []}}, {"range": {"t": {"gte": 1}}}, {"range": {"zz": {"gte": 1}}}, {"range": {"n": {"gte": "1.5"}}},
        {"range": {"n": {"gte": True}}}, {"range": {"n": {"from": 1}}}, {"range": {"d": {"gte": "x"}}}, {"range": {"n": 5}},
    ],
)
def test_refused_queries(body):
    with pytest.raises(QueryParsingError):
        dsl.parse(body, MAPPING)


def test_aggregation_requests():
    assert dsl.parse_aggregations({"a": {"terms": {"field": "k", "size": 3}}, "b": {"value_count": {"field": "n"}}}) == {"a": ("terms", "k", 3), "b": ("value_count", "n", 10)}
    for bad in ({"a": {"sum": {"field": "n"}}}, {"a": {"terms": {}}}, {"a": {}}):
        with pytest.raises(QueryParsingError):
            dsl.parse_aggregations(bad)


def test_terms_of_a_tree():
    tree = Bool(must=(Term("t", "a"), Phrase("t", ("a", "b"))), must_not=(Term("t", "c"),), should=(Bool(filter=(Term("k", "d"),)),))
    assert terms_of(tree) == [("t", "a"), ("t", "b"), ("k", "d")]
    assert ("t", "c") in terms_of(tree, excluded=True)


TEXTS = ["the Quick\tbrown\n\rfox, jumps", "", "  a  ", "日本語 テスト", "ＦＵＬＬ width", "İstanbul ΟΔΟΣ", "😀 x𠀋y", "café CAFÉ"]


def test_columns_and_constants_analyze_alike(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for name in ("standard", "ngram"):
        made = analysis.get(name)
        assert [r[0] for r in df.select(made.tokens(df["t"])).collect()] == [made.analyze(t) for t in TEXTS]
    assert analysis.get("ngram").analyze("abc") == ["ab", "bc", "abc"]
    details = df.limit(1).select(analysis.token_details(df["t"], analysis.get("standard"))).first()[0]
    assert [(d["term"], d["position"], d["start"], d["end"]) for d in details][:3] == [("the", 0, 0, 3), ("quick", 1, 4, 9), ("brown", 2, 10, 15)]


def test_custom_analyzers():
    analysis.register("trigrams", analysis.ngram(3, 3))
    assert dsl.parse({"match": {"t": {"query": "abcd", "analyzer": "trigrams"}}}, MAPPING) == Bool(should=(Term("t", "abc"), Term("t", "bcd")))


HASHES = {"": 0, "test": -1167338989, "hello": 613153351, "doc1": -657533388, "doc2": -1895630836, "abc": -1277324294, "elasticsearch": 1171729715, "0": -764297089, "1": -1810453357, "12345": 329585043}


def test_routing(spark):
    df = spark.createDataFrame([(k,) for k in [*HASHES, "größe", "長い文字列です"]], "i string")
    got = {r["i"]: r["h"] for r in df.select("i", routing.murmur3(df["i"]).alias("h")).collect()}
    assert got == HASHES | {k: routing.murmur3_32(k.encode()) for k in ("größe", "長い文字列です")}
    assert {k: routing.shard_of(k, 5) for k in ("test", "hello", "doc1", "doc2", "elasticsearch", "0", "1", "12345")} == {"test": 1, "hello": 1, "doc1": 2, "doc2": 4, "elasticsearch": 0, "0": 1, "1": 3, "12345": 3}


SOURCES = {
    '{"t":"x","k":7,"n":42.7,"d":"1.5","b":true}': {"t": ["x"], "k": ["7"], "n": [42], "d": [1.5], "b": ["true"]},
    '{"n":9007199254740993,"zz":{"a":1}}': {"n": [9007199254740993]},
    '{"k":["a","b",3],"n":["5",-2.5],"t":[]}': {"k": ["a", "b", "3"], "n": [5, -2], "t": []},
    '{"b":"F"}': {"b": ["false"]},
    "{}": {},
    '{"n":"4.5"}': None, '{"n":true}': None, '{"t":null}': None, '{"t":{"a":1}}': None, '{"b":1}': None, '{"b":"yes"}': None, '{"d":"x"}': None, '{"k":[null]}': None, "[1]": None, "no": None,
}


def test_documents_on_the_driver_and_as_columns(spark):
    for source, expected in SOURCES.items():
        if expected is None:
            with pytest.raises(MapperParsingError):
                parse_document(source, MAPPING)
        else:
            assert parse_document(source, MAPPING) == expected
    rows = documents.parse(spark.createDataFrame([(s,) for s in SOURCES], "_source string"), MAPPING).collect()
    for r in rows:
        expected = SOURCES[r["_source"]]
        assert (r["_error"] is None) == (expected is not None), r
        assert {n: r[n] for n in MAPPING.fields if r[n] is not None} == (expected or {})


def test_bulk_lines():
    body = '{"index":{"_id":"1"}}\n{"a":1}\n\n  \n{"delete":{"_index":"o","_id":2}}\n{"create":{"_id":"3"}}\n{"b":"' + "x" * 100_000 + '"}\n'
    made = bulk.parse_bulk(body, "i")
    assert [(a.kind, a.index, a.id) for a in made] == [("index", "i", "1"), ("delete", "o", "2"), ("create", "i", "3")]
    assert made[0].source == '{"a":1}' and len(made[2].source) > 100_000
    for bad in ('{"index":{"_id":"1"}}', '{"update":{"_id":"1"}}\n{}', "x\n{}", '{"index":{}}\n{}'):
        with pytest.raises(QueryParsingError):
            bulk.parse_bulk(bad, "i")
