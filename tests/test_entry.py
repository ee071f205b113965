import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
SMALL = Path("/root/testdata/sf0.001")


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_optional_subpackage():
    code = "import sys; import lexispark.queries; assert not any(m.startswith('lexispark.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    for path in (ROOT / "lexispark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "lexispark.llm" not in path.read_text(), path


@pytest.mark.skipif(not SMALL.exists(), reason="no test data")
def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["doc", "score"]


@pytest.mark.skipif(not SMALL.exists(), reason="no test data")
@pytest.mark.parametrize("name", ["match_duplicate_terms", "bool_nested", "multi_match_sum", "sort_multi", "terms_agg_filtered", "positions_for_hits", "upsert_latest_wins", "json_document_parse"])
def test_queries_equal_their_sql(spark, name):
    db = duckdb.connect()
    for path in SMALL.glob("*.parquet"):
        db.execute(f"create view {path.stem} as select * from '{path}'")
    found = entry.queries()[name](spark, str(SMALL))
    columns = sorted(found.columns)
    sql = db.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted(sql, key=str)
