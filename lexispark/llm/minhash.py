"""MinHash near-duplicates (operator 3): fast similarity sketches, bands, and exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark.llm.common import WORD, Scratch, mix, table, text_buffers, word_bounds, word_hashes
from lexispark.llm.components import connected_components

WIDTH = 5
COORDINATES = 128
BAND = 4
SLICE_BYTES = 3 << 20
#: Members of a bucket that meet in one task; larger buckets are compared part by part.
PART = 2_048
#: Cells of the counts that rule pairs out before their sets are fetched.
CELLS = 512
#: Sets whose cells are counted at a time.
CELL_ROWS = 1_024
#: Partners of one hub whose sets are compared in one task.
FAN = 1_024
_SEEDS = mix(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(body: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of word shingles of each row, ascending and back to back, and their offsets (n + 1).

    A-Z count as a-z. A row of fewer words than ``width`` has its whole sequence as one shingle, a row without words none.
    """
    starts, ends, first = word_bounds(body, offsets)
    words = word_hashes(body, starts, ends, fold_case=True)
    count = np.diff(first)
    rows = len(count)
    n = len(words)
    full = np.zeros(n, np.uint64)
    if n >= width:
        run = np.full(n - width + 1, np.uint64(width))
        for k in range(width):
            run = mix(run * _STEP + words[k : n - width + 1 + k])
        full[: len(run)] = run
    row = np.repeat(np.arange(rows), count)
    valid = np.arange(n) + width <= first[1:][row] if n else np.zeros(0, bool)
    short = np.flatnonzero((count > 0) & (count < width))
    tiny = np.empty(len(short), np.uint64)
    for size in range(1, width):
        of = np.flatnonzero(count[short] == size)
        run = np.full(len(of), np.uint64(size))
        for k in range(size):
            run = mix(run * _STEP + words[first[:-1][short[of]] + k])
        tiny[of] = run
    value, owner = np.concatenate([full[valid], tiny]), np.concatenate([row[valid], short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(rows + 1))


def sketches(values: np.ndarray, at: np.ndarray, size: int = COORDINATES) -> np.ndarray:
    """A row of ``size`` minima for each set, of 64 bits.

    Round i puts every element into one bin at random with the value i + v, v random in [0, 1), for the first ``size``
    rounds; each of ``size`` further rounds puts all elements into one given bin, so that every bin fills. A set
    leaves the rounds once it has no empty bin: later rounds have larger values and can't change a minimum.
    """
    rows = len(at) - 1
    out = np.full(rows * size, np.uint64(0xFFFFFFFFFFFFFFFF))
    owner = np.repeat(np.arange(rows), np.diff(at))
    for i in range(2 * size):
        if not len(values):
            break
        h = mix(values ^ _SEEDS[i])
        bins = (h % np.uint64(size)).astype(np.int64) if i < size else i - size
        np.minimum.at(out, owner * size + bins, np.uint64(i) << np.uint64(48) | h >> np.uint64(16))
        empty = (out.reshape(rows, size) == np.uint64(0xFFFFFFFFFFFFFFFF)).any(1)
        more = empty[owner]
        values, owner = values[more], owner[more]
    return out.reshape(rows, size)


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """Four coordinates of 16 bits make one band of 64 bits; the bands together are the short sketch."""
    return mix(sketch).astype(np.uint16).reshape(len(sketch), -1).view(np.int64)


def _slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        body, offsets = text_buffers(batch.column(1))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
            yield batch.column(0).slice(lo, hi - lo), body[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


def _signatures(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set; with its size they name the set."""
    out = []
    for seed in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        run = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mix(values ^ np.uint64(seed)), out=run[1:])
        out.append((run[at[1:]] - run[at[:-1]]).view(np.int64))
    return out[0], out[1]


def _sketch_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, body, offsets in _slices(batches):
            values, at = shingle_sets(body, offsets, width)
            bands = band_keys(sketches(values, at))
            one, two = _signatures(values, at)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, bands.shape[1]), pa.int32()), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays([key, pa.array(np.diff(at)), pa.array(one), pa.array(two), lists], ["key", "n", "one", "two", "bands"])

    return run


def _set_rows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, body, offsets in _slices(batches):
            values, at = shingle_sets(body, offsets, width)
            one, two = _signatures(values, at)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(at)), pa.array(one), pa.array(two), lists], ["n", "one", "two", "items"])

    return run


def _cell_counts(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES // 8) -> Iterator[pa.RecordBatch]:
    """How many elements of each set fall into each of CELLS cells, 255 and more as 255.

    Counted over CELL_ROWS sets and ``most`` elements at a time, so that memory depends neither on the batch nor on the largest set.
    """
    for batch in batches:
        lists = batch.column(2)
        at, items = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
        for lo in range(0, batch.num_rows, CELL_ROWS):
            own = at[lo : lo + CELL_ROWS + 1]
            rows = len(own) - 1
            counts = np.zeros(rows * CELLS, np.int64)
            for i in range(int(own[0]), int(own[-1]), most):
                j = min(i + most, int(own[-1]))
                row = np.repeat(np.arange(rows), np.diff(np.clip(own, i, j)))
                counts += np.bincount(row * CELLS + (mix(items[i:j]) % np.uint64(CELLS)).astype(np.int64), minlength=len(counts))
            raw = np.minimum(counts, 255).astype(np.uint8).tobytes()
            cells = pa.array([raw[i : i + CELLS] for i in range(0, len(raw), CELLS)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, rows), batch.column(1).slice(lo, rows), cells], ["uid", "n", "cells"])


def _cross_pairs(percent: int):
    """Pairs of one part of a bucket from different components that may be similar enough.

    Two sets have at most the smaller count of each cell in common. A pair whose sum of these is too small for the
    threshold can't be a link, so leaving it out is exact; full cells count without a limit.
    """

    def run(group: pa.Table) -> pa.Table:
        uid, component, part, n = (group[c].to_numpy() for c in ("uid", "component", "part", "n"))
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        cells = np.frombuffer(b"".join(group["cells"].to_pylist()), np.uint8).reshape(len(uid), CELLS)
        full = cells == 255
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        a, b = [uid[:0]], [uid[:0]]
        for i in left.tolist():
            others = right[right > i] if low == high else right
            others = others[(component[others] != component[i]) & (np.minimum(n[others], n[i]) * 100 >= np.maximum(n[others], n[i]) * percent)]
            common = np.minimum(cells[others], cells[i]).sum(1, dtype=np.int64)
            if full[i].any():
                common = np.where((full[others] & full[i]).any(1), n[i], common)
            others = others[common * (100 + percent) >= (n[others] + n[i]) * percent]
            a.append(np.full(len(others), uid[i]))
            b.append(uid[others])
        return pa.table({"a": pa.array(np.concatenate(a), pa.int64()), "b": pa.array(np.concatenate(b), pa.int64())})

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 80, width: int = WIDTH) -> DataFrame:
    """Components of documents whose sets of word shingles have a Jaccard similarity of ``percent`` / 100 or more.

    Equal sets are one class from the start, whatever their number, and only a class's first row goes on. Bands
    of its sketch propose pairs; in a bucket everyone is first compared with one hub, and what the
    hubs' links leave in different components is compared in turn, all of it, larger buckets in parts of ``PART`` members: first by
    counts of shingles in cells, which bound what two sets have in common from above, then on the sets. No bucket is cut
    short, and pairs within one component are never emitted. A link is confirmed on the full sets of 64-bit shingle
    hashes; a hub with many partners meets them in several tasks.

    With 32 bands of 4 coordinates a pair at the threshold 0.85 fails to meet in any bucket with a chance of 6e-11, at
    0.8 of 5e-8. Returns key, n_shingles, component_id (the smallest key reachable) and kept (key = component_id), one row
    per row of ``docs``. Null and blank texts have no shingles and link with nothing; a null key takes part but never
    names a component unless the component has no other; repeated rows share a component.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent must be between 1 and 100")
    scratch = Scratch(docs.sparkSession, "minhash")
    source = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = dict(source.dtypes)["key"]
    rows = source.mapInArrow(_sketch_rows(width), f"key {kind}, n bigint, one bigint, two bigint, bands array<bigint>")
    rows = scratch.save(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")

    same = ["n", "one", "two"]
    classes = rows.filter("n > 0").groupBy(*same).agg(F.min("uid").alias("rep"))
    members = scratch.save(rows.drop("bands").join(classes, same, "left").withColumn("rep", F.coalesce("rep", "uid")), "members")
    reps = rows.filter("n > 0").join(classes.select("rep"), rows["uid"] == F.col("rep"), "left_semi")

    banded = reps.select("uid", F.posexplode("bands").alias("at", "value")).select("uid", F.xxhash64("at", "value").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("uid").alias("hub"), F.count("*").alias("size")).filter("size > 1").drop("size")
    buckets = scratch.save(banded.join(hubs, "band"), "buckets")
    scratch.drop("rows")

    wanted = buckets.select("uid").distinct()
    known = scratch.save(members.join(wanted, "uid", "left_semi").select("uid", "key", *same), "wanted")
    keys = known.select(F.col("key").alias("k")).distinct()
    texts = source.join(keys, source["key"].eqNullSafe(keys["k"]), "left_semi")
    found = texts.mapInArrow(_set_rows(width), "n bigint, one bigint, two bigint, items array<bigint>")
    sets = scratch.save(found.join(known.select("uid", *same), same).dropDuplicates(["uid"]).select("uid", "n", "items"), "sets")
    scratch.drop("wanted")

    def confirm(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("uid").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
        right = sets.select(F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
        slim = pairs.join(left.drop("ia"), "a").join(right.drop("ib"), "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b")
        # the set of an element with many partners goes to as many tasks as it takes
        fan = slim.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > FAN).select(F.col("a").alias("hub"), F.ceil(F.col("n") / FAN).cast("int").alias("parts"))
        spread = slim.join(fan, slim["a"] == fan["hub"], "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("salt"))
        copies = left.join(fan, left["a"] == fan["hub"], "left").select("a", "na", "ia", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt"))
        both = spread.join(copies, ["a", "salt"]).drop("salt").join(right, "b")
        common = F.size(F.array_intersect("ia", "ib"))
        return both.withColumn("common", common).filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b")

    first = scratch.save(confirm(buckets.filter("uid != hub").select(F.col("hub").alias("a"), F.col("uid").alias("b")).distinct()), "links1")
    labels = connected_components(first, scratch, "first")

    placed = buckets.drop("hub").join(labels, buckets["uid"] == labels["id"], "left").select("band", "uid", F.coalesce("component", "uid").alias("component"))
    split = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).filter("lo != hi").select("band", F.ceil(F.col("size") / PART).cast("int").alias("parts"))
    crossing = placed.join(split, "band").withColumn("part", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    crossing = crossing.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("band", "uid", "component", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    counts = sets.mapInArrow(_cell_counts, "uid bigint, n bigint, cells binary")
    tasks = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    crossing = crossing.join(counts, "uid").repartition(tasks, "band", "low", "high")
    pairs = crossing.groupBy("band", "low", "high").applyInArrow(_cross_pairs(percent), "a bigint, b bigint")
    second = scratch.save(confirm(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), "links2")
    scratch.drop("buckets")
    scratch.drop("sets")
    labels = connected_components(first.unionByName(second), scratch, "second")

    grouped = members.join(labels, members["rep"] == labels["id"], "left").select("key", "n", F.coalesce("component", "rep").alias("group"))
    names = grouped.groupBy("group").agg(F.min("key").alias("component_id"))
    out = grouped.join(names, "group")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(False)).alias("kept"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


OP3_SQL = rf"""
with recursive words as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'), []) as w from documents),
sh as (
  select distinct doc_id, unnest(case when len(w) >= {WIDTH} then list_transform(range(1, len(w) - {WIDTH} + 2), lambda i: array_to_string(w[i:i + {WIDTH - 1}], ' '))
                                      when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from words),
sizes as (select doc_id, count(*) as n from sh group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from sh a join sh b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
reach as (select a as id, b as seen from links union select r.id, l.b from reach r join links l on r.seen = l.a),
low as (select id, least(id, min(seen)) as component_id from reach group by id)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, coalesce(component_id, d.doc_id)::bigint as component_id, d.doc_id = coalesce(component_id, d.doc_id) as kept
from documents d left join sizes s on s.doc_id = d.doc_id left join low on low.id = d.doc_id
"""
