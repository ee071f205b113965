import math
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexispark.llm.common import CLEANUP, Scratch
from lexispark.llm.components import connected_components, spanning_stars
from lexispark.llm.epsilon_grid import embedding_near_duplicates, interval_join
from lexispark.llm.voronoi import _product, top_k
from tests.llm.fixtures import components

SCHEMA = "vec_id long, embedding array<float>, label int, id long, block int, cell int, far double, vector string"


def vectors():
    rng = random.Random(1)
    rows, centre = [], [rng.gauss(0, 1) for _ in range(8)]
    for i in range(200):
        if i % 3 == 0:
            v = [c + rng.gauss(0, 0.25) for c in centre]
        else:
            v = [rng.gauss(0, 1) for _ in range(8)]
        rows.append((i, [float(np.float32(x)) for x in v], i % 2))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, rows[0][1], 1), (203, None, 0), (204, [0.0] * 8, 0), (205, [1.0, None] + [0.0] * 6, 0)]
    rows += [(206, [math.nan] + [1.0] * 7, 0), (207, [math.inf] + [1.0] * 7, 0), (208, rows[3][1], None), (209, [1.0, 2.0], 0), (210, [1.0, 2.0], 0), (220, [], 0), (240, rows[3][1], 0), (260, [1e-30] * 8, 0)]
    return [(*r, 1, 2, 3, 0.5, "v") for r in rows]


def valid(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v)


def test_embedding_links_against_brute_force(spark):
    rows = vectors()
    got = embedding_near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    good = [(r[0], np.array(np.float32(r[1]), float), r[2]) for r in rows if r[2] is not None and valid(r[1]) and any(r[1])]
    links = []
    for i, (a, x, s) in enumerate(good):
        for b, y, t in good[:i]:
            if s == t and len(x) == len(y) and x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= 0.93:
                links.append((a, b))
    degree = Counter(i for link in links for i in link)
    comp = components([r[0] for r in rows], links)
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got} == {(r[0], degree[r[0]], comp[r[0]], comp[r[0]] == r[0]) for r in rows}
    assert len(got) == len(rows) and len(links) > 50
    assert embedding_near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_that_repeat_a_key(spark):
    x, y = [1.0, 0.0, 0.0], [0.0, 1.0, 0.2]
    rows = [(1, x, 0), (1, x, 0), (2, [1.0, 0.1, 0.0], 0), (3, y, 0), (3, None, 0), (3, x, 1), (20, y, 0), (20, x, 0), (None, x, 0)]
    made = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = Counter(map(tuple, embedding_near_duplicates(made).collect()))
    assert got == Counter([(1, 3, 1, True)] * 2 + [(2, 3, 1, False), (3, 1, 3, True), (3, 0, 3, True), (3, 0, 3, True), (20, 1, 3, False), (20, 3, 1, False), (None, 0, None, False)])
    lists = Counter(map(tuple, top_k(made, F.col("vec_id") % 20 == 0, 3).collect()))
    # floor(64 * 0.2) = 12, floor(64 * 0.1) = 6
    one = [(20, 1, 3, 4240), (20, 2, 2, 384), (20, 3, 1, 0)]
    two = [(20, 1, 1, 4096), (20, 2, 1, 4096), (20, 3, 2, 4096)]
    assert lists == Counter(one + two)


def test_products_beyond_64_bits():
    a = np.array([[2.0**40, -(2.0**40)], [3.0, 2.0**70]])
    assert _product(a, a).tolist() == [[(1 << 63) - 1, -(1 << 63) + 1], [-(1 << 63) + 1, (1 << 63) - 1]]
    assert _product(a[:1] / 2**15, a[:1] / 2**15).tolist() == [[2**51]]


def test_interval_join_skips_only_distant_blocks():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 6))
    x[150:] = x[:150] + rng.normal(size=(150, 6)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[np.lexsort(np.floor(x[:, :2] / 0.3).T)]
    i, j = interval_join(x, x, x[:, :3], x[:, :3], math.sqrt(0.14), 0.93, True)
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.93, 1)))}
    assert set(zip(i.tolist(), j.tolist())) == want and len(want) >= 150


@pytest.mark.parametrize("k", [3, 500])
def test_top_k_against_brute_force(spark, k):
    rows = [r for r in vectors() if r[0] != 209]
    got = top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 20 == 0, k).collect()
    whole = {r[0]: [math.floor(64 * x) for x in np.float32(r[1]).astype(float)] for r in rows if valid(r[1])}
    want = set()
    for q, x in whole.items():
        if q % 20 == 0:
            scores = sorted(((-sum(a * b for a, b in zip(x, y)), c) for c, y in whole.items() if c != q and len(y) == len(x)))[:k]
            want |= {(q, n + 1, c, -s) for n, (s, c) in enumerate(scores)}
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == want and len(got) == len(want)


def test_top_k_of_nothing(spark):
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0, 5).count() == 0


def test_components_of_paths_hubs_and_loops(spark):
    rng = random.Random(9)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 400)] + [(5, 5), (900, 901), (901, 902), (902, 900), (900, 901)]
    links += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)]
    rng.shuffle(links)
    made = connected_components(spark.createDataFrame(links, "a long, b long").repartition(5), Scratch(spark, "test")).collect()
    nodes = {i for link in links for i in link}
    want = {i: c for i, c in components(nodes, links).items() if i != c}
    assert {r["id"]: r["component"] for r in made} == want and len(made) == len(want)
    a, b = spanning_stars(np.array([3, 4, 9]), np.array([4, 8, 10]))
    assert dict(zip(a.tolist(), b.tolist())) == {4: 3, 8: 3, 10: 9}


def test_saved_tables_leave_no_shuffle_files(spark):
    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return set(re.findall(r"shuffle_\d+", files.mkString(" ")))

    before, setting = held(), spark.conf.get(CLEANUP, None)
    made = spark.range(1000).repartition(3, "id")
    saved = Scratch(spark, "test").save(made, "rows")
    for _ in range(50):  # they are removed in the background
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before
    assert saved.count() == made.count() == 1000 and spark.conf.get(CLEANUP, None) == setting
