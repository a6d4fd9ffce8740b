"""The driver's contract."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


def test_keys_and_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir(DATA):
        assert e.entry(spark).limit(1).count() == 1


def test_base_stands_alone(tmp_path):
    """Without the subpackage llm and the pipeline the entry module imports and keeps its own queries."""
    for name in ("tickloom", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "tickloom" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'ema' in q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}).returncode == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_some_queries_equal_their_sql(spark):
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")

    def plain(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    for name in ("bars_h1", "macd", "supertrend", "ma_cross", "fib_clusters", "news_risk", "level_stats", "trailing_stops"):
        got = e.queries()[name](spark, DATA)
        rows = sorted((tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()), key=str)
        cursor = con.execute(e.oracle_sql()[name])
        names = [d[0] for d in cursor.description]
        want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()), key=str)
        assert rows == want, name
