"""Swing queries on closes with plateaus, which their SQL does not count as swings, against that SQL."""

import datetime

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tickloom.operators import engine as eng


@pytest.fixture(scope="module")
def flat_events(tmp_path_factory):
    """One tick an hour for 90 days of two types, with few different values, so that many neighbours are equal; some plateaus cross a month."""
    folder, rng = tmp_path_factory.mktemp("flat"), np.random.default_rng(3)
    start, ts, kinds, values = datetime.datetime(2024, 1, 1), [], [], []
    for kind in ("click", "view"):
        x = rng.integers(0, 9, 2160).astype(float)
        x[740:746], x[739], x[746] = 20.0, 3.0, 2.0
        ts += [start + datetime.timedelta(hours=k, minutes=7) for k in range(2160)]
        kinds += [kind] * 2160
        values += x.tolist()
    n = len(ts)
    pq.write_table(pa.table({"event_id": pa.array(range(n), pa.int64()), "ts": pa.array(ts, pa.timestamp("us")), "user_id": pa.array([1] * n, pa.int64()), "event_type": kinds, "value": values, "props": ["{}"] * n}), folder / "events.parquet")
    return str(folder)


def same_as_sql(spark, folder, name):
    import duckdb

    import __spark_entry__ as e

    def plain(v):
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    con = duckdb.connect()
    con.sql(f"create view events as select * from '{folder}/events.parquet'")
    got = e.queries()[name](spark, folder)
    rows = sorted((tuple(plain(r[c]) for c in sorted(got.columns)) for r in got.collect()), key=str)
    cursor = con.execute(e.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()), key=str)
    assert rows and rows == want


def test_engine_clusters(spark, flat_events):
    same_as_sql(spark, flat_events, "engine_clusters")


def test_engine_vector(spark, flat_events):
    same_as_sql(spark, flat_events, "engine_vector")


def test_raw_levels(spark, flat_events):
    same_as_sql(spark, flat_events, "raw_levels")


def test_raw_levels_all(spark, flat_events):
    same_as_sql(spark, flat_events, "raw_levels_all")


def test_swings_all(spark, flat_events):
    same_as_sql(spark, flat_events, "swings_all")


def test_swings_peaks(spark, flat_events):
    same_as_sql(spark, flat_events, "swings_peaks")


def test_swings_peaks_blocks(spark, flat_events):
    same_as_sql(spark, flat_events, "swings_peaks_blocks")


def test_plateaus_stay_unless_left_out(spark):
    """By default a plateau is a swing in its middle; without plateaus single bars alone are, with prominences over all bars."""
    values = [1.0, 5.0, 5.0, 5.0, 2.0, 4.0, 0.0, 3.0, 1.0]
    rows = [("AAA", "H1", datetime.datetime(2025, 1, 1, k), x, x) for k, x in enumerate(values)]
    df = spark.createDataFrame(rows, "symbol string, tf string, ts timestamp_ntz, open double, close double")
    options = {"min_prominence": 0.5, "min_distance_bars": 1}
    all_of = {(r.idx, r.kind, r.prominence) for r in eng.swings(df, **options).collect()}
    single = {(r.idx, r.kind, r.prominence) for r in eng.swings(df, **options, plateaus=False).collect()}
    assert all_of == {(2, "peak", 4.0), (4, "valley", 2.0), (5, "peak", 2.0), (6, "valley", 3.0), (7, "peak", 2.0)}
    assert single == {s for s in all_of if s[0] != 2}


def test_blocks_leave_plateaus_out(spark):
    """Blocks of any size, plateaus across their borders included, give what whole series give."""
    values = np.random.default_rng(5).integers(0, 4, 120).astype(float).tolist()
    rows = [("AAA", "H1", datetime.datetime(2025, 1, 1) + datetime.timedelta(hours=k), x, x) for k, x in enumerate(values)]
    df = spark.createDataFrame(rows, "symbol string, tf string, ts timestamp_ntz, open double, close double")
    options = {"min_prominence": 0.5, "min_distance_bars": 1, "plateaus": False}
    whole = sorted(eng.swings(df, **options).collect())
    assert whole and {r.idx for r in whole} == {k for k in range(1, 119) if (values[k] - values[k - 1]) * (values[k] - values[k + 1]) > 0}
    for hours in (1, 5, 1000):
        assert sorted(eng.swings(df, **options, block=F.expr(f"unix_seconds(timestamp(ts)) div {3600 * hours}")).collect()) == whole
