import random

import pytest

from lexispark.errors import QueryParsingError
from lexispark.functions import bm25
from lexispark.operators import aggregations
from lexispark.operators.search import Searcher, SortField, position_map, positions, top_k
from lexispark.plans import dsl
from lexispark.plans.compile import matches
from lexispark.plans.query import Bool, Exists, MatchAll, MatchNone, Phrase, Range, Term
from lexispark.plans.view import View
from lexispark.sources import store

CORPUS = ["the quick brown fox", "the lazy brown dog", "the quick red fox jumps", "brown fox brown fox"]


@pytest.fixture(scope="module")
def view(spark):
    return View.of_table(spark.createDataFrame(list(enumerate(CORPUS)), "id long, body string").cache(), "id", {"body": "text"})


def scores(view, query, k=10):
    query = dsl.parse(query, view.mapping) if isinstance(query, dict) else query
    return {int(r["_id"]): round(r["_score"], 6) for r in top_k(view, query, k).collect()}


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        (Term("body", "brown"), {0: 0.365470, 1: 0.365470, 3: 0.498678}),
        (Term("body", "fox"), {0: 0.365470, 2: 0.332659, 3: 0.498678}),
        (Term("body", "quick"), {0: 0.710238, 2: 0.646476}),
        (Phrase("body", ("brown", "fox")), {0: 0.730939, 3: 0.997356}),
        (Phrase("body", ()), {}),
        (Bool(filter=(Term("body", "brown"),)), {0: 0.0, 1: 0.0, 3: 0.0}),
        (Bool(must=(Term("body", "brown"),), filter=(Term("body", "fox"),)), {0: 0.365470, 3: 0.498678}),
        (Bool(filter=(Term("body", "brown"), Term("body", "fox"))), {0: 0.0, 3: 0.0}),
        (Bool(filter=(Term("body", "brown"),), should=(Term("body", "quick"),)), {0: 0.710238, 1: 0.0, 3: 0.0}),
        (Bool(must_not=(Term("body", "brown"),)), {}),
        (Bool(should=(Term("body", "quick"), Term("body", "quick"))), {0: 1.420477, 2: 1.292952}),
        (MatchAll(), {0: 1.0, 1: 1.0, 2: 1.0, 3: 1.0}),
        (MatchNone(), {}),
        (Term("other", "brown"), {}),
        (Term("body", "Brown"), {}),
        (Term("body", "brown fox"), {}),
    ],
)
def test_fixture_scores(view, query, expected):
    assert scores(view, query) == pytest.approx(expected, abs=2e-6)


def test_order_of_hits_and_ties(view):
    assert [r["_id"] for r in top_k(view, Term("body", "brown")).collect()] == ["3", "0", "1"]
    assert [r["_id"] for r in top_k(view, MatchAll(), 0).collect()] == ["0"]


def test_repeated_phrases(spark):
    v = View.of_table(spark.createDataFrame([(0, "foo foo foo bar"), (1, "foo bar foo")], "id long, t string"), "id", {"t": "text"})
    assert set(scores(v, Phrase("t", ("foo", "foo")))) == {0} == set(scores(v, Phrase("t", ("foo", "foo", "foo"))))


def test_positions_of_hits(view):
    query = dsl.parse({"bool": {"must": [{"term": {"body": "brown"}}], "must_not": [{"term": {"body": "lazy"}}], "should": [{"term": {"body": "fox"}}]}}, view.mapping)
    found = position_map(positions(view, top_k(view, query), query)).collect()
    assert {r["_id"]: r["positions"] for r in found} == {"0": {"body": {"brown": [2], "fox": [3]}}, "3": {"body": {"brown": [0, 2], "fox": [1, 3]}}}


def test_ranges_and_exists(spark):
    rows = [(1, "cheap widget", 10, 3.5), (2, "mid widget", 50, 4.0), (3, "premium widget", 100, 4.5), (4, "luxury widget", 200, 5.0), (5, None, None, float("inf"))]
    v = View.of_table(spark.createDataFrame(rows, "id long, title string, price long, rating double"), "id", {"title": "text", "price": "long", "rating": "double"})
    assert set(scores(v, {"range": {"price": {"gte": 50, "lte": 100}}})) == {2, 3}
    assert set(scores(v, {"range": {"price": {"gt": 50.9, "lt": "200"}}})) == {3}
    assert set(scores(v, {"range": {"rating": {"gt": 3.5, "lt": 5.0}}})) == {2, 3}
    assert set(scores(v, {"range": {"rating": {"gte": 0}}})) == {1, 2, 3, 4}
    assert set(scores(v, {"bool": {"must": [{"match": {"title": "widget"}}], "filter": [{"range": {"price": {"lte": 50}}}]}})) == {1, 2}
    assert set(scores(v, {"bool": {"must": [{"match_all": {}}], "must_not": [{"range": {"price": {"lte": 100}}}]}})) == {4, 5}
    assert set(scores(v, {"exists": {"field": "price"}})) == set(scores(v, {"exists": {"field": "title"}})) == {1, 2, 3, 4}
    assert scores(v, {"term": {"price": 10}}) == {}


def test_sorts(spark):
    rows = [(0, "b", 200), (1, "a", 300), (2, "b", 100), (3, "a", 100), (4, None, None)]
    v = View.of_table(spark.createDataFrame(rows, "id long, c string, p long"), "id", {"c": "keyword", "p": "long"})
    order = lambda *sort, k=10: [int(r["_id"]) for r in top_k(v, MatchAll(), k, list(sort)).collect()]
    assert order(SortField("p")) == [4, 2, 3, 0, 1]
    assert order(SortField("p", True), k=2) == [1, 0]
    assert order(SortField("c")) == [4, 1, 3, 0, 2]
    assert order(SortField("c", True)) == [0, 2, 1, 3, 4]
    assert order(SortField("c"), SortField("p")) == [4, 3, 1, 2, 0]
    assert order(SortField("_doc", True)) == [4, 3, 2, 1, 0]
    best = top_k(v, Bool(should=(Term("c", "a"), Range("p", 150, 400))), 2, [SortField("_score")]).collect()
    assert [int(r["_id"]) for r in best] == [0, 3]  # 1.0 and one keyword term; the document with both is cut off
    with pytest.raises(QueryParsingError):
        order(SortField("nothing"))


def test_aggregations(spark):
    rows = [(i, s, n) for i, (s, n) in enumerate([("active", 1), ("inactive", None), ("active", 2), ("", None), (None, 3), ("pending", 4), ("inactive", 5)])]
    v = View.of_table(spark.createDataFrame(rows, "id long, s string, n long"), "id", {"s": "keyword", "n": "long"})
    found = matches(MatchAll(), v, False)
    assert [tuple(r) for r in aggregations.terms(v, found, "s").collect()] == [("active", 2), ("inactive", 2), ("pending", 1)]
    assert [tuple(r) for r in aggregations.terms(v, found, "s", 1).collect()] == [("active", 2)]
    assert aggregations.terms(v, found, "n").count() == 0
    assert tuple(aggregations.value_count(v, found, "s", "n", "gone").first()) == (5, 5, 0)
    response = Searcher(v).search({"query": {"term": {"s": "nobody"}}, "aggs": {"a": {"terms": {"field": "s"}}, "b": {"value_count": {"field": "n"}}}})
    assert response["aggregations"] == {"a": {"buckets": []}, "b": {"value": 0}} and response["hits"]["max_score"] == 0.0


def test_shards_keep_their_own_statistics(spark):
    rows = [(i, f"fox {'dog ' * (i % 5)}") for i in range(40)]
    table = spark.createDataFrame(rows, "id long, t string").cache()
    one, three = (View.of_table(table, "id", {"t": "text"}, n) for n in (1, 3))
    query = Bool(should=(Term("t", "dog"), Term("t", "fox")))
    per_shard = {}
    from lexispark.functions.routing import shard_of

    for i, text in rows:
        per_shard.setdefault(shard_of(str(i), 3), []).append((i, text.split()))
    expected = {}
    for docs in per_shard.values():
        n, total = len(docs), sum(len(t) for _, t in docs)
        for i, t in docs:
            expected[i] = sum(bm25.score_value(t.count(w), len(t), n, sum(w in u for _, u in docs), total) for w in ("dog", "fox") if w in t)
    assert {int(r["_id"]): r["_score"] for r in top_k(three, query, 50).collect()} == pytest.approx(expected)
    merged = {r["_id"]: r["_score"] for r in top_k(three.in_one_shard(), query, 50).collect()}
    assert merged == pytest.approx({r["_id"]: r["_score"] for r in top_k(one, query, 50).collect()})


# random trees against a plain evaluator ------------------------------------------------------------


def evaluate(query, docs, everything):
    """(matches, score) of a document in plain Python."""
    n, total = len(everything), sum(len(d["t"]) for d in everything)

    def term(f, w, doc):
        has = lambda d: w in d["t"] if f == "t" else d["k"] == w
        if f not in ("t", "k") or not has(doc):
            return False, 0.0
        df = sum(map(has, everything))
        return True, bm25.score_value(doc["t"].count(w), len(doc["t"]), n, df, total) if f == "t" else bm25.score_value(1, 0, n, df, 0)

    def visit(q, doc):
        if isinstance(q, MatchAll):
            return True, 1.0
        if isinstance(q, Term):
            return term(q.field, q.term, doc)
        if isinstance(q, Phrase):
            size = len(q.terms)
            hit = any(tuple(doc["t"][i : i + size]) == q.terms for i in range(len(doc["t"]) - size + 1))
            return hit, sum(term("t", w, doc)[1] for w in q.terms)
        if isinstance(q, Exists):
            return (bool(doc["t"]) if q.field == "t" else doc[q.field] is not None), 1.0
        if isinstance(q, Range):
            return doc["p"] is not None and q.low <= doc["p"] <= q.high, 1.0
        if isinstance(q, Bool):
            needed = [visit(c, doc) for c in q.must]
            filters = [visit(c, doc) for c in q.filter]
            optional = [visit(c, doc) for c in q.should]
            if any(visit(c, doc)[0] for c in q.must_not):
                return False, 0.0
            if needed or filters:
                ok = all(m for m, _ in needed + filters)
            else:
                ok = any(m for m, _ in optional)
            return ok, sum(s for _, s in needed) + sum(s for m, s in optional if m)
        return False, 0.0

    return {d["id"]: visit(query, d) for d in docs}


def random_tree(rng, depth=0):
    kinds = ["term", "term", "phrase", "exists", "range", "key"] + (["bool"] * 6 if depth < 3 else []) + ["all"]
    kind = rng.choice(kinds)
    word = lambda: rng.choice("abcde")
    if kind == "term":
        return Term("t", word())
    if kind == "key":
        return Term("k", rng.choice("xyz"))
    if kind == "phrase":
        return Phrase("t", tuple(word() for _ in range(rng.randrange(1, 4))))
    if kind == "exists":
        return Exists(rng.choice("tkp"))
    if kind == "range":
        low = rng.randrange(10)
        return Range("p", low, low + rng.randrange(5))
    if kind == "all":
        return MatchAll()
    pick = lambda most: tuple(random_tree(rng, depth + 1) for _ in range(rng.randrange(most)))
    return Bool(pick(3), pick(2), pick(3), pick(2))


def test_random_trees_in_both_modes(spark, tmp_path):
    rng = random.Random(12)
    docs = [{"id": i, "t": [rng.choice("abcde") for _ in range(rng.randrange(8))], "k": rng.choice(["x", "y", "z", None]), "p": rng.choice([None, *range(12)])} for i in range(25)]
    table = spark.createDataFrame([(d["id"], " ".join(d["t"]), d["k"], d["p"]) for d in docs], "id long, t string, k string, p long").coalesce(1).cache()
    scan = View.of_table(table, "id", {"t": "text", "k": "keyword", "p": "long"})
    store.save(scan, f"file://{tmp_path}/index")
    saved = store.load(spark, f"file://{tmp_path}/index")
    for _ in range(8):
        query = random_tree(rng)
        want = {i: s for i, (m, s) in evaluate(query, docs, docs).items() if m}
        for view in (scan, saved):
            got = {int(r["_id"]): r["_score"] for r in matches(query, view).collect()}
            assert got == pytest.approx(want, abs=1e-9), query


def test_saved_versions_and_compaction(spark, view, tmp_path):
    folder = f"file://{tmp_path}/index"
    assert [store.save(view, folder) for _ in range(3)] == [1, 2, 3]
    assert store.compact(spark, folder) == 4
    disk = store.Files(spark, folder)
    assert [n for n in disk.names() if n.startswith("v")] == ["v3", "v4"]
    assert scores(store.load(spark, folder), Phrase("body", ("brown", "fox"))) == pytest.approx({0: 0.730939, 3: 0.997356}, abs=2e-6)
    assert [r["term"] for r in store.term_dictionary(store.load(spark, folder).postings, "body").limit(3).collect()] == ["brown", "dog", "fox"]
