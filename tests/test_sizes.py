"""What a step holds or runs at once stays bounded as tables grow."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexispark.mapping import Mapping
from lexispark.operators.engine import Engine
from lexispark.sources import documents, store


def test_blocks_take_a_bounded_number_of_tokens_at_once():
    sizes = np.array([500] * 3000 + [0, store.TOKENS_AT_ONCE + 7, 3])
    words = np.arange(sizes.sum()) % 11
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(words.astype(str)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(sizes)) % 2, pa.int32()), pa.array(np.arange(len(sizes)), pa.int64()), lists], ["_shard", "_doc", "tokens"])
    made = list(store._token_blocks(False)(iter([batch])))
    found: dict[str, int] = {}
    for part in made:
        docs = {d for block in part.column(2).to_pylist() for d in block}
        assert len(docs) == 1 or sum(sizes[list(docs)]) <= store.TOKENS_AT_ONCE
        for shard, term, ids, tfs, lens, places in zip(*(c.to_pylist() for c in part.columns)):
            assert ids == sorted(ids) and all(i % 2 == shard for i in ids) and lens == [sizes[i] for i in ids] and tfs == [len(p) for p in places]
            found[term] = found.get(term, 0) + sum(tfs)
    assert found == {str(w): int(n) for w, n in enumerate(np.bincount(words))}


def test_blocks_don_t_depend_on_where_a_batch_is_cut():
    rows = [["b", "a", None, "b"], None, [], ["a"], ["c", "a"], ["b"]]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 0, 1, 0, 1], pa.int32()), pa.array(range(6), pa.int64()), pa.array(rows, pa.list_(pa.string()))], ["_shard", "_doc", "tokens"])
    for keyword in (False, True):

        def postings(most: int) -> list[tuple]:
            blocks = [r for b in store._token_blocks(keyword, most)(iter([batch])) for r in b.to_pylist()]
            return sorted((r["_shard"], r["term"], *x) for r in blocks for x in zip(r["docs"], r["tfs"], r["lens"], map(tuple, r["positions"])))

        assert postings(1) == postings(2) == postings(3) == postings(1 << 19) != []


def test_a_value_of_a_document_is_computed_once(spark):
    mapping = Mapping.of({"a": "text", "b": "keyword", "c": "long", "d": "double"})
    rows = spark.createDataFrame([("1", '{"a":"x","c":1}'), ("2", '{"c":"z"}')], "_id string, _source string")
    kept = documents.parse(rows, mapping).filter("_error is null").select("_id")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert [r["_id"] for r in kept.collect()] == ["1"]
    assert plan.count("get_json_object(") == len(mapping.fields), plan


def test_writes_and_merges_are_many_tasks(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/index", Mapping.of({"k": "keyword"}))
    value = F.concat(*[F.sha2(F.concat("id", F.lit(f"-{i}")), 512) for i in range(4)])
    rows = spark.range(12_000).coalesce(1).select(F.col("id").cast("string").alias("_id"), F.to_json(F.struct(value.alias("k"))).alias("_source"))
    engine.append(rows)
    log = engine.log()
    assert len(log.inputFiles()) > 1
    assert [int(r["_id"]) for r in log.orderBy("_seq_no").select("_id").collect()] == list(range(12_000))
    engine.compact()
    assert len(engine.segments.view(None).docs.inputFiles()) > 1 and engine.counts() == (12_000, 0)
    assert not [n for n in engine.files.names() if n.startswith("pending-")]
