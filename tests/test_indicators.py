"""Indicators against pandas, and edge series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.schema import BARS, interval_of, normalize_bars
from tickloom.operators import indicators as ind
from tickloom.plans.kernels import Ewm
from tickloom.plans.pipeline import FeaturePipeline, IndicatorSpec, build_features, default_specs


def series_of(df, columns, symbol="AAA"):
    return df.where(F.col("symbol") == symbol).orderBy("ts").select(*columns).toPandas().astype(float)


def close_to(a, b):
    np.testing.assert_allclose(np.asarray(a, float), np.asarray(b, float), rtol=1e-9, atol=1e-9, equal_nan=True)


def make(spark, closes, high=None, low=None, symbol="S"):
    rows = []
    for k, c in enumerate(closes):
        h, lo = (high[k] if high else c), (low[k] if low else c)
        rows.append((symbol, "H1", (pd.Timestamp("2025-01-01") + pd.Timedelta(hours=k)).to_pydatetime(), c, h, lo, c, 10, 0))
    return spark.createDataFrame(rows, BARS.replace("timestamp_ntz", "timestamp")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_exponential_means_equal_pandas(bars):
    df, pdf = bars
    one = pdf[pdf.symbol == "AAA"].reset_index(drop=True)
    close_to(series_of(ind.ema(df, 12), ["ema_12"])["ema_12"], one.close.ewm(span=12, adjust=False, min_periods=12).mean())
    tr = pd.concat([one.high - one.low, (one.high - one.close.shift()).abs(), (one.low - one.close.shift()).abs()], axis=1).max(axis=1)
    close_to(series_of(ind.atr(df, 14), ["atr_14"])["atr_14"], tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean())
    delta = one.close.diff()
    gain, loss = delta.clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean(), (-delta).clip(lower=0).ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    close_to(series_of(ind.rsi(df), ["rsi_14"])["rsi_14"], 100 - 100 / (1 + gain / loss.replace(0, np.nan)))


def test_ewm_with_inner_gaps_equals_pandas():
    rng = np.random.default_rng(3)
    x = rng.normal(size=200)
    x[[0, 1, 40, 41, 90, 199]] = np.nan
    want = pd.Series(x).ewm(alpha=0.2, adjust=False, min_periods=5).mean()
    kernel = Ewm(0.2, 5)
    got = np.concatenate([kernel.push(part) for part in np.split(x, [1, 2, 41, 60, 61, 150])])
    close_to(got, want)


def test_short_flat_and_rising_series(spark):
    flat = make(spark, [5.0] * 40)
    out = ind.bollinger_bands(ind.stochastic(ind.cci(ind.rsi(flat))))
    last = out.orderBy(F.desc("ts")).first()
    assert last["rsi_14"] is None and last["cci_20"] is None and last["%k"] is None
    assert last["bb_width_20_2"] == 0.0
    rising = make(spark, [float(k) for k in range(1, 40)])
    assert ind.rsi(rising).where("rsi_14 is not null").count() == 0
    short = make(spark, [1.0, 2.0, 3.0])
    row = build_features(short, include_supertrend=True).orderBy(F.desc("ts")).first()
    assert row["ema_50"] is None and row["adx_14"] is None and row["supertrend_dir"] == -1.0 and row["supertrend"] is None


def test_strict_extrema_and_divergence_ignore_series_ends(spark):
    df = make(spark, [5.0, 4.0, 3.0, 2.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0])
    out = ind.detect_divergences_extrema(df.withColumn("i", F.col("close")), ["i"], order=2)
    assert out.where("i_bullish_divergence or i_bearish_divergence").count() == 0


def test_ma_cross_spacing_and_errors(bars):
    df, pdf = bars
    with pytest.raises(ValueError):
        ind.MovingAverageCross(fast=26, slow=12).add_to_df(df)
    with pytest.raises(ValueError):
        ind.moving_average_cross_simple(df, 50, 20)
    cross = ind.MovingAverageCross(fast=[3, 5], slow=[8, 13], min_bars_between_signals=6)
    got = series_of(cross.add_to_df(df), ["_ma_agg_diff", "ma_cross_signal"])
    sign = np.sign(got["_ma_agg_diff"]).to_numpy()
    want, last = np.zeros(len(sign)), -9999
    for k in range(1, len(sign)):
        s = 1.0 if sign[k - 1] <= 0 < sign[k] else -1.0 if sign[k - 1] >= 0 > sign[k] else 0.0
        if s and k - last > 6:
            want[k], last = s, k
    close_to(got["ma_cross_signal"], want)
    assert cross.to_spec()["name"] == "ma_cross"


def test_pipeline_equals_single_operators(bars):
    df, _ = bars
    out = build_features(df, default_specs(include_supertrend=True))
    single = ind.supertrend(ind.adx(ind.stoch_rsi(ind.macd(df))))
    columns = ["macd_hist", "stochrsi_d_14_3_3", "adx_14", "supertrend", "supertrend_dir"]
    close_to(series_of(out, columns, "BBB"), series_of(single, columns, "BBB"))
    with pytest.raises(AttributeError):
        FeaturePipeline([IndicatorSpec("nope")]).apply(df)
    with pytest.raises(TypeError):
        FeaturePipeline([IndicatorSpec("ema", {"wrong": 1})]).apply(df)


def test_normalize_bars(spark):
    raw = spark.createDataFrame([(0, 1.0, 2.0, 0.5, float("nan"), 7)], "Time long, Open double, H double, low double, Close double, Volume long")
    row = normalize_bars(raw, "X", "M1").first()
    assert row.close is None and row.tick_volume == 7 and row.high == 2.0 and row.ts.year == 1970
    with pytest.raises(ValueError):
        normalize_bars(raw.drop("Close"))
    with pytest.raises(ValueError):
        interval_of("M7")
