"""Joins, risk, simulator, sources and streams."""

import datetime as dt
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from tickloom.operators import bars as bar_ops
from tickloom.operators import indicators as ind
from tickloom.operators import joins, risk
from tickloom.operators import simulator as sim
from tickloom.sources import config, download, market
from tickloom.streaming import bars as stream
from tickloom.streaming import twins

T0 = dt.datetime(2025, 1, 1)


def ntz(df, *names):
    return df.withColumns({n: F.col(n).cast("timestamp_ntz") for n in names or ["ts"]})


def test_asof_never_looks_ahead(spark):
    left = ntz(spark.createDataFrame([("s", T0 + dt.timedelta(minutes=m), m) for m in (0, 7, 10, 25)], "symbol string, ts timestamp, m int"))
    right = ntz(spark.createDataFrame([("s", T0 + dt.timedelta(minutes=m), float(m)) for m in (5, 10, 20)], "symbol string, ts timestamp, v double"))
    got = {r.m: r.v for r in joins.asof_join(left, right, ["symbol"]).collect()}
    assert got == {0: None, 7: 5.0, 10: 10.0, 25: 20.0}
    got = {r.m: r.v for r in joins.asof_join(left, right, ["symbol"], clamp_first=True).collect()}
    assert got[0] == 5.0


def test_asof_over_days_and_ties(spark):
    rng = np.random.default_rng(3)
    at = lambda n: [T0 + dt.timedelta(minutes=int(m)) for m in rng.integers(0, 20 * 1440, n)]
    left_rows = [("s" if k % 3 else "t", t, k) for k, t in enumerate(at(400))] + [("none", T0, 1000), (None, T0, 1001), ("s", None, 1002)]
    right_rows = [("s" if k % 2 else "t", t, k) for k, t in enumerate(sorted(set(at(25))))] + [("s", None, 99), (None, T0 - dt.timedelta(days=40), 98)]
    left = ntz(spark.createDataFrame(left_rows, "symbol string, ts timestamp, m int"))
    right = ntz(spark.createDataFrame(right_rows, "symbol string, ts timestamp, v int"))

    def want(symbol, t, clamp):
        mine = sorted((u, v) for s, u, v in right_rows if s == symbol and u is not None)
        before = [v for u, v in mine if t is not None and u <= t]
        return before[-1] if before else (mine[0][1] if clamp and mine else None)

    for clamp in (False, True):
        got = {r.m: r.v for r in joins.asof_join(left, right, ["symbol"], clamp_first=clamp).collect()}
        assert got == {m: want(s, t, clamp) for s, t, m in left_rows}
    by_hour = joins.asof_join(left, right, ["symbol"], bucket=F.date_trunc("hour", "ts"))
    assert {r.m: r.v for r in by_hour.collect()} == {m: want(s, t, False) for s, t, m in left_rows}
    assert joins.asof_join(left.limit(0), right, ["symbol"]).count() == 0
    assert {r.v for r in joins.asof_join(left, right.limit(0), ["symbol"]).collect()} == {None}


def test_position_stops(spark, bars):
    df, pdf = bars
    day = pdf[pdf.symbol == "AAA"].reset_index(drop=True)
    row = lambda k, way, mode=None, n=None, mult=None, price=None: ("AAA", day.ts[k].to_pydatetime() + dt.timedelta(minutes=5), way, mode, n, mult, price, k)
    schema = "symbol string, ts timestamp, direction int, trailing_mode string, atr_period int, atr_mult double, current_price double, k int"
    held = ntz(spark.createDataFrame([row(50, 1), row(51, -1), row(60, 1, "atr", 5, 2.0), row(61, -1, "atr", None, None, 90.0)], schema))
    got = {r.k: r.new_sl for r in risk.TrailingStop().position_stops(held, df, [5]).collect()}
    before = day.close.shift()
    span = pd.concat([day.high - day.low, (day.high - before).abs(), (day.low - before).abs()], axis=1).max(axis=1)
    atr = {n: span.ewm(alpha=1 / n, adjust=False).mean() for n in (5, 14)}
    want = {50: day.high[29:51].max() - 3 * atr[14][50], 51: day.low[30:52].min() + 3 * atr[14][51], 60: day.close[60] - 2 * atr[5][60], 61: 90 + 1.5 * atr[14][61]}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9)
    with pytest.raises(Exception, match="atr_period not among"):
        risk.TrailingStop().position_stops(held, df).collect()


def test_news_windows(spark):
    news = ntz(spark.createDataFrame([(dt.datetime(2025, 8, 1, 10), "high"), (dt.datetime(2025, 8, 2, 14, 30), "medium")], "ts timestamp, impact string"))
    levels = spark.createDataFrame([(1.0,), (2.0,)], "price double")
    near = joins.filter_levels_by_news(levels, news, F.lit("2025-08-01 09:55:00").cast("timestamp_ntz"))
    assert {r.signal_strength for r in near.collect()} == {"weak"}
    assert {r.signal_strength for r in joins.filter_levels_by_news(levels, None, F.lit(None)).collect()} == {"strong"}
    rows = ntz(spark.createDataFrame([(dt.datetime(2025, 8, 1, 11),), (dt.datetime(2025, 8, 1, 11, 1),)], "ts timestamp"))
    assert sorted(r.news_risk for r in joins.news_risk(rows, news).collect()) == [0.0, 3.0]
    assert sum(r.near_news for r in joins.near_news(rows, news, before=61, after=0).collect()) == 2


def test_padded_windows(spark, bars):
    df, _ = bars
    out = bar_ops.padded(df, 400).where("symbol = 'AAA'").orderBy("slot").collect()
    assert len(out) == 400 and out[0].close is None and out[99].close is None and out[100].close is not None


def test_lots_of_the_fixtures(spark):
    rows = spark.createDataFrame([(100.0, 1.0, 50.0, 10.0), (100.0, 1.0, 12.0, 10.0), (10000.0, 1.0, 20.0, 10.0)], "equity double, risk_percent double, sl_pips double, pip_value double")
    got = sorted((r.lot, r.risk_amount) for r in risk.with_lot_by_risk(rows).collect())
    assert got == [(0.0, 0.0), (0.01, pytest.approx(1.2)), (0.5, pytest.approx(100.0))]
    info = risk.with_pip_value(risk.with_symbol_info(spark.createDataFrame([("EURUSD",), ("xauusd.m",), ("",)], "symbol string")))
    got = {r.symbol: (r.base, r.quote, round(r.pip, 6), round(r.pip_value, 6)) for r in info.collect()}
    assert got["EURUSD"] == ("EUR", "USD", 0.001, 100.0) and got["xauusd.m"] == ("XAU", "USD", 0.01, 1.0) and got[""][:2] == (None, None)
    bad = rows.withColumn("sl_pips", F.lit(0.0))
    with pytest.raises(Exception, match="sl_pips"):
        risk.with_lot_by_risk(bad).collect()
    with pytest.raises(ValueError):
        risk.round_lot(F.lit(1.0), 0.0)


def episode(spark, prices, actions, **extra):
    rows = [("s", "H1", T0 + dt.timedelta(hours=k), float(p), a) for k, (p, a) in enumerate(zip(prices, actions, strict=True))]
    df = ntz(spark.createDataFrame(rows, "symbol string, tf string, ts timestamp, price double, action int"))
    return df.withColumns({"volume": F.lit(1.0)} | {k: F.lit(v) for k, v in extra.items()})


def test_simulator_rules(spark):
    config_ = sim.SimulatorConfig(sl_tp_mode="pips", pip_size=1.0)
    run = lambda df, c=config_: sim.simulate(df, config=c).orderBy("ts").collect()
    out = run(episode(spark, [100, 103, 106], [1, 0, 0], sl=2.0, tp=5.0))
    assert [r.n_positions for r in out] == [1, 1, 0] and out[2].realized == 6.0 and out[2].balance == 10006.0
    out = run(episode(spark, [100, 97, 110], [1, 0, 0], sl=2.0, tp=5.0))
    assert out[1].realized == -3.0 and out[2].n_positions == 0
    out = run(episode(spark, [100, 101, 102, 103], [1, 2, 3, 3], sl=0.0, tp=0.0))
    assert [r.closed for r in out] == [0, 0, 1, 1] and [r.realized for r in out[2:]] == [-1.0, 3.0]
    trail = episode(spark, [100, 110, 108, 104], [1, 0, 0, 0], trailing=1).withColumn("stop_long", F.col("price") - 5).withColumn("stop_short", F.col("price") + 5)
    out = run(trail)
    assert [r.n_positions for r in out] == [1, 1, 1, 0] and out[3].realized == 4.0
    out = run(episode(spark, [100, 102, 100], [1, 0, 0], riskfree=1))
    assert out[2].n_positions == 0 and out[2].realized == 0.0
    out = run(episode(spark, [100, 90, 80], [1, 0, 1]), sim.SimulatorConfig(max_drawdown=5.0))
    assert [r.done for r in out] == [False, True, True] and out[2].opened == 0
    same = run(episode(spark, [100, 90], [1, 0]), sim.SimulatorConfig(reward="reference"))
    assert same[1].reward == 10.0


def test_sources_round_trip(spark, bars, tmp_path):
    df, pdf = bars
    path = str(tmp_path / "bars")
    market.write_bars(df, path)
    market.write_bars(df, path, skip_existing=True)
    assert market.read_bars(spark, path).count() == len(pdf)
    assert market.read_bars(spark, path, symbols=["AAA"], tfs=["H1"], last=5).count() == 5
    assert market.read_bars(spark, path, start="2025-01-01", end="2025-01-01 05:00:00").count() == 12
    empty = str(tmp_path / "none")
    market.write_bars(df.limit(0), empty)
    assert not (tmp_path / "none").exists()
    market.write_pair_csv(df, str(tmp_path / "csv"))
    text = next((tmp_path / "csv" / "symbol=AAA" / "tf=H1").glob("*.csv")).read_text()
    assert text.splitlines()[0] == "time,open,high,low,close,tick_volume,spread"
    assert market.write_range_csv(df, "ZZZ", "H1", "2025-01-01", "2025-01-02", str(tmp_path / "range")) is False
    (tmp_path / "pairs").mkdir()
    (tmp_path / "pairs" / "FAKEPAIR2_M1.csv").write_text("time,open,high,low,close,tick_volume,spread\n2025-01-01 00:00:00,1.0,1.2,0.9,1.05,10,1\n")
    row = market.read_pair_files(spark, str(tmp_path / "pairs")).first()
    assert (row.symbol, row.tf, row.open, row.tick_volume) == ("FAKEPAIR2", "M1", 1.0, 10)
    notes = market.plot_annotations(spark.createDataFrame([(None,), (2.0,)], "price double")).orderBy("price").collect()
    assert [tuple(r) for r in notes] == [(0.0, "fib", 0.0), (2.0, "fib", 0.0)]


def test_fetch_pairs_survives_failures(spark):
    def fetch(symbol, tf):
        if symbol == "BAD":
            raise OSError("down")
        if symbol == "EMPTY":
            return pd.DataFrame()
        return pd.DataFrame({"time": pd.to_datetime(["2025-01-01"]), "open": [1.0], "high": [1.2], "low": [0.9], "close": [1.05], "tick_volume": [10], "spread": [1]})

    got = market.fetch_pairs(spark, fetch, ["BAD", "EMPTY", "GOOD", "SKIP"], ["M1"], retries=1, backoff=0.0, skip_symbols=["SKIP"]).collect()
    assert [(r.symbol, r.close) for r in got] == [("GOOD", 1.05)]
    with pytest.raises(ValueError):
        market.fetch_pairs(spark, fetch, ["GOOD"], ["M7"])


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("a:\n  b: 1\n  c: [x]\nd: text\n")
    got = config.load(str(tmp_path / "c.yaml"), {"BOT_A_B": "2.5", "A_C": "p, q", "BOT_D": "true"})
    assert got == {"a": {"b": 2.5, "c": ["p", "q"]}, "d": True} and config.get(got, "a", "z", default=3) == 3
    (tmp_path / "bad.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "bad.yaml"), {})


def test_variables_of_a_file(tmp_path):
    (tmp_path / ".env").write_text("# secrets\nexport BOT_A_B=2 # two\nBOT_D='x = y'\n\nnonsense\nBOT_E=1\n")
    (tmp_path / "c.yaml").write_text("a:\n  b: 1\nd: text\ne: 0\n")
    got = config.load(str(tmp_path / "c.yaml"), {"BOT_E": "5"}, str(tmp_path / ".env"))
    assert got == {"a": {"b": 2}, "d": "x = y", "e": 5}
    assert config.load(str(tmp_path / "c.yaml"), {}, str(tmp_path / "none"))["e"] == 0


def fetched(symbol, tf, most):
    if symbol == "BAD":
        raise OSError("down")
    ts = pd.date_range("2025-01-01", periods=most, freq="h")
    return pd.DataFrame({"time": ts, "open": 1.0, "high": 2.0, "low": 0.5, "close": 1.5, "tick_volume": 3, "spread": 0})


def test_download_job(spark, tmp_path):
    fetch = fetched
    settings = {"symbols": ["A", "BAD", "SKIP"], "timeframes": ["H1", "H4"], "skip_symbols": ["SKIP"], "download_defaults": {"num_bars": 4, "retries": 0}}
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    for _ in range(2):
        download.download(spark, settings, fetch, str(tmp_path / "bars"), skip_existing=True)
    got = market.read_bars(spark, str(tmp_path / "bars")).groupBy("symbol", "tf").count().collect()
    assert {(r.symbol, r.tf, r["count"]) for r in got} == {("A", "H1", 4), ("A", "H4", 4)}


def drain(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


@pytest.fixture
def parts(spark, bars, tmp_path):
    """The bars as three files, read one a batch in order of time."""
    df, _ = bars
    times = sorted(r.ts for r in df.select("ts").distinct().collect())
    for k in range(3):
        lo, hi = times[k * 100], times[min(len(times) - 1, k * 100 + 99)]
        df.where(F.col("ts").between(F.lit(lo), F.lit(hi))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in"), df


def test_streams_equal_batches(spark, parts):
    folder, df = parts
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    key = lambda rows, c: {(r.symbol, r.ts): r[c] for r in rows}
    got = key(drain(twins.stream_ema(source, 12), "ema_stream").collect(), "ema_12")
    want = key(ind.ema(df, 12).collect(), "ema_12")
    assert got.keys() == want.keys()
    for k in want:
        assert (got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9)
    steps = lambda d: d.select("symbol", "tf", "ts", F.col("close").alias("price"), (F.hour("ts") % 4).alias("action"), F.lit(0.3).alias("volume"), F.lit(50.0).alias("sl"), F.lit(90.0).alias("tp"))
    got = key(drain(twins.stream_simulator(steps(source)), "sim_stream").collect(), "equity")
    want = key(sim.simulate(steps(df)).collect(), "equity")
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[k] for k in sorted(got)], [want[k] for k in sorted(want)])


def test_stream_indicators_equal_batches(spark, parts):
    folder, df = parts
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    cases = [(twins.stream_macd(source), ind.macd(df), ["macd_line", "macd_signal", "macd_hist"]), (twins.stream_rsi(source), ind.rsi(df), ["rsi_14"]), (twins.stream_atr_adx(source), ind.adx(ind.atr(df)), ["atr_14", "plus_di_14", "minus_di_14", "adx_14"])]
    for k, (stream_, batch, columns) in enumerate(cases):
        pick = lambda rows: {(r.symbol, r.ts): [np.nan if r[c] is None else r[c] for c in columns] for r in rows}
        got, want = pick(drain(stream_, f"twin_{k}").collect()), pick(batch.collect())
        assert got.keys() == want.keys()
        np.testing.assert_allclose([got[x] for x in sorted(got)], [want[x] for x in sorted(want)], atol=1e-9)
    got = {(r.symbol, r.ts): r.rma_9 for r in drain(twins.stream_rma(source, 9), "twin_rma").collect()}
    pdf = df.toPandas().sort_values(["symbol", "ts"])
    want = pdf.groupby("symbol").close.transform(lambda x: x.ewm(alpha=1 / 9, adjust=False, min_periods=9).mean())
    np.testing.assert_allclose([np.nan if got[x] is None else got[x] for x in sorted(got)], want, atol=1e-9)


def test_stream_lines_equal_batches(spark, parts):
    folder, df = parts
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    bands = lambda d: d.select("symbol", "tf", "ts", "close", (F.col("high") + 2).alias("upper"), (F.col("low") - 2).alias("lower"), F.when(F.col("tick_volume") % 4 == 0, 1.0).otherwise(0.0).alias("signal"))
    from tickloom.plans.kernels import Spacing, SuperTrend
    from tickloom.plans.scan import scan

    key = lambda rows, c: {(r.symbol, r.ts): r[c] for r in rows}
    want = scan(bands(df), ["symbol", "tf"], ["ts"], ["close", "upper", "lower"], "supertrend double, supertrend_dir double", SuperTrend).collect()
    got = drain(twins.stream_supertrend(bands(source)), "trend_stream").collect()
    assert key(got, "supertrend_dir") == key(want, "supertrend_dir") and {r.supertrend_dir for r in want} == {None, 1.0, -1.0}
    want = scan(bands(df), ["symbol", "tf"], ["ts"], ["signal"], "spaced double", lambda: Spacing(3)).collect()
    got = drain(twins.stream_spacing(bands(source), 3), "spacing_stream").collect()
    assert key(got, "spaced") == key(want, "spaced") and sum(r.spaced for r in want) > 10


def test_stream_bars_and_versions(spark, tmp_path):
    rows = [("s", T0 + dt.timedelta(minutes=m), float(m), m) for m in range(0, 300, 7)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, seq int")
    ticks.write.parquet(str(tmp_path / "ticks"))
    source = spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "ticks"))
    got = {r.ts: (r.open, r.high, r.low, r.close, r.tick_volume) for r in drain(stream.stream_bars(source, "H1"), "bar_stream").collect()}
    want = {r.ts: (r.open, r.high, r.low, r.close, r.tick_volume) for r in bar_ops.resample_ticks(ntz(ticks), "H1").collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) < len(want)
    bar = lambda close, seq: ("s", "H1", T0, 1.0, 2.0, 0.5, close, 3, 0, seq)
    schema = "symbol string, tf string, ts timestamp, open double, high double, low double, close double, tick_volume long, spread long, seq int"
    versions = ntz(spark.createDataFrame([bar(1.5, 1), bar(1.7, 3), bar(1.6, 2)], schema))
    versions.write.parquet(str(tmp_path / "versions_in"))
    source = spark.readStream.schema(versions.schema).parquet(str(tmp_path / "versions_in"))
    stream.append_versions(source, str(tmp_path / "versions"), str(tmp_path / "ck")).awaitTermination(60)
    assert [r.close for r in stream.read_current_bars(spark, str(tmp_path / "versions")).collect()] == [1.7]
