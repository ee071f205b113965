"""Times the headline queries once warm and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Search queries run over
the raw table (scan_*) and over saved postings (index_*); building the postings is timed as well.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispark import queries as catalogue
from lexispark.operators.search import top_k
from lexispark.plans.view import View
from lexispark.sources import store


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    searches = ["term_text_bm25", "match_multi_should", "phrase_two", "bool_must_should", "match_all_topk", "range_long_gte_lt", "range_double", "sort_numeric_desc", "sort_string_missing_first", "sort_multi"]
    others = ["terms_agg_filtered", "value_count_keyword", "tokens_whitespace", "fetch_sources", "upsert_latest_wins"]
    timings: dict[str, float] = {}
    every = catalogue.queries()
    run(every["match_multi_should"](spark, folder))  # code is compiled and files are known from here on
    for name in searches + others:
        timings[f"scan_{name}" if name in searches else name] = run(every[name](spark, folder))

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    view = View.of_table(docs, "doc_id", {"text": "text", "lang": "keyword", "source": "keyword", "n_chars": "long"})
    saved, start = store.own_folder(spark), time.perf_counter()
    store.save(view, saved)
    timings["index_build"] = time.perf_counter() - start
    index = store.load(spark, saved)
    for name in ("term_text_bm25", "match_multi_should", "phrase_two", "bool_must_should"):
        hits = top_k(index, catalogue.SEARCHES[name].query()).select("_id", F.col("_score"))
        timings[f"index_{name}"] = run(hits)
    rows = docs.count()
    print(f"indexed {rows} documents, {rows / timings['index_build']:.0f} a second", file=sys.stderr)
    result = {"metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": {k: round(v, 3) for k, v in timings.items()}, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}
    print(json.dumps(result))
    store.Files(spark, saved).delete()
    spark.stop()


if __name__ == "__main__":
    main()
