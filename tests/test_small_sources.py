"""Exports, news files, context columns, weights and symbol tables that no query covers."""

import json

import pytest
from pyspark.sql import functions as F

from tickloom.operators import bars as bar_ops
from tickloom.operators import fibonacci as fib
from tickloom.operators import joins
from tickloom.operators import risk
from tickloom.operators import support as sup
from tickloom.sources import market
from tickloom.sources.storage import stored


@pytest.fixture(scope="module")
def levels(spark):
    rows = [("EURUSD", "H1", "retracement", 0.618, 1.2345), ("EURUSD", "H4", "retracement", 0.618, 1.2339), ("EURUSD", "D1", "extension", 0.5, 1.236), ("EURUSD", "D1", None, None, 9.0)]
    return spark.createDataFrame(rows, "symbol string, tf string, method string, ratio double, price double")


def test_levels_as_files(spark, levels, tmp_path):
    objects = [json.loads(r.json) for r in market.levels_as_json(levels).collect()]
    assert {"symbol": "EURUSD", "tf": "H1", "method": "retracement", "ratio": 0.618, "price": 1.2345} in objects and len(objects) == 4
    market.write_levels_json(levels, f"{tmp_path}/json")
    assert sorted(r.price for r in spark.read.schema(levels.schema).json(f"{tmp_path}/json").collect()) == [1.2339, 1.2345, 1.236, 9.0]
    market.write_levels_csv(levels, f"{tmp_path}/csv")
    back = spark.read.option("header", True).schema(levels.schema).csv(f"{tmp_path}/csv")
    assert sorted(back.collect(), key=str) == sorted(levels.collect(), key=str)


def test_news_file_weighs_on_bars(spark, bars, tmp_path):
    from tickloom.sources.market import NEWS

    columns = [c.strip().split()[0].strip("`") for c in NEWS.split(",")] if isinstance(NEWS, str) else [f.name for f in NEWS]
    values = {"ts": "2025-01-01 10:20:00", "impact": "high", "currency": "USD", "event": "CPI, core"}
    line = ",".join(f'"{values.get(c, "")}"' for c in columns)
    (tmp_path / "news.csv").write_text(",".join(columns) + "\n" + line + "\n")
    news = market.read_news(spark, f"{tmp_path}/news.csv")
    (row,) = news.collect()
    assert (row.impact, str(row.ts)) == ("high", "2025-01-01 10:20:00")
    got = joins.news_risk(bars[0].where("symbol = 'AAA'"), news, minutes=30).where("news_risk > 0").collect()
    assert [(str(r.ts), r.news_risk) for r in got] == [("2025-01-01 10:00:00", 3.0)]


def test_context_and_stored_tables(spark, bars):
    out = bar_ops.with_context(bars[0].limit(3), run="a", fold=2, share=0.5)
    assert {(r.run, r.fold, r.share) for r in out.collect()} == {("a", 2, 0.5)} and bar_ops.with_context(bars[0]).columns == bars[0].columns
    kept = stored(bars[0])
    assert kept.schema == bars[0].schema and kept.exceptAll(bars[0]).count() == 0


def test_weights_of_clusters_are_parameters(levels):
    params = fib.ClusterParams(rel_tolerance=0.002, min_hits=2, timeframe_weights={"H4": 3.0}, method_weights={"retracement": 2.0})
    plain, weighted = (fib.cluster_levels(levels.where("price < 5"), ["symbol"], p).collect() for p in (fib.ClusterParams(rel_tolerance=0.002), params))
    assert [r.hits for r in plain] == [r.hits for r in weighted] == [3]
    assert weighted[0].score > plain[0].score
    assert fib.cluster_levels(levels, ["symbol"], fib.ClusterParams(min_hits=4)).count() == 0


def test_symbol_table_comes_first(spark):
    df = spark.createDataFrame([("EURUSD.m",), ("USDJPY",), ("XAUUSD",), ("GBPUSD",)], "symbol string")
    infos = spark.createDataFrame([("EURUSD", 0.00001, 50_000), ("XAUUSD", 0.0, 10)], "symbol string, point double, trade_contract_size long")
    got = {r.symbol: r for r in risk.with_symbol_info(df, infos=infos).collect()}
    assert (got["EURUSD.m"].point, got["EURUSD.m"].contract_size, got["EURUSD.m"].pip) == (0.00001, 50_000.0, 0.0001)
    assert (got["XAUUSD"].point, got["XAUUSD"].contract_size) == (risk.METAL_POINT, 10.0)  # a point of 0 is none
    assert (got["USDJPY"].point, got["GBPUSD"].point) == (0.01, risk.DEFAULT_POINT)


def test_last_pivots_are_those_of_the_last_bar(bars):
    every, last = sup.pivots(bars[0], last_only=False), sup.pivots(bars[0]).collect()
    ends = {(r.symbol, r.ts) for r in bars[0].groupBy("symbol").agg(F.max("ts").alias("ts")).collect()}
    assert {(r.symbol, r.ts) for r in last} == ends
    want = {(r.symbol, r.ts): (r.pivot, r.r1, r.s2) for r in every.collect()}
    assert all(want[r.symbol, r.ts] == (r.pivot, r.r1, r.s2) for r in last)


def test_windows_hold_the_last_bars(bars):
    df, pdf = bars
    base = df.where("symbol = 'AAA' and hour(ts) % 7 = 3").select("symbol", F.expr("ts + interval 20 minutes").alias("ts"))
    got = {r.ts: r.window for r in joins.observation_windows(base, df, 4).collect()}
    x = pdf[pdf.symbol == "AAA"].reset_index(drop=True)
    assert len(got) == base.count()
    for ts, window in got.items():
        last = x[x.ts <= ts].tail(4)[["open", "high", "low", "close"]].to_numpy().ravel().tolist()
        assert window == [None] * (16 - len(last)) + last
