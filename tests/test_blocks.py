"""Block-parallel recurrences against the same recurrences walked in one piece."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.operators import indicators as ind
from tickloom.plans import blocks
from tickloom.plans.kernels import Clamp, Ewm, SuperTrend, sides

numbers = st.integers(0, 6).map(float)


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.lists(st.tuples(numbers, numbers), max_size=14), st.lists(st.integers(0, 2), max_size=3))
def test_shells_say_what_steps_make_of_any_value(steps, holes):
    p, u = (np.array([s[k] for s in steps]) for k in (0, 1))
    for n, k in enumerate(holes):
        if n < len(p):
            (p if k else u)[n] = np.nan
    summary = blocks.ClampSummary()
    summary.push(p[:3], u[:3])
    summary.push(p[3:], u[3:])
    shells = summary.result()
    for x in [np.nan, -1.0, *np.arange(0, 7, 0.5), 9.0]:
        clamp = Clamp()
        clamp.value = x
        clamp.push(p, u)
        np.testing.assert_equal(blocks.clamped(x, shells), clamp.value)


@settings(max_examples=200, deadline=None, derandomize=True)
@given(st.lists(st.lists(st.one_of(st.none(), numbers), max_size=6), max_size=5), st.sampled_from([0.1, 0.5, 1.0]))
def test_composed_means_equal_one_walk(parts, alpha):
    whole, state = Ewm(alpha, 1), (np.nan, 1.0, 0.0)
    for part in parts:
        x = np.array(part, dtype=float)
        summary = blocks.EwmSummary(alpha)
        for k in range(0, len(x), 2):
            summary.push(x[k : k + 2])
        state = blocks.after(alpha, state, dict(zip(summary.fields, summary.result(), strict=True)))
        whole.push(x)
        np.testing.assert_allclose([state[0], state[2]], [whole.y, whole.seen], rtol=1e-12)
        if not np.isnan(whole.y):
            np.testing.assert_allclose(state[1], whole.weight, rtol=1e-12)


@settings(max_examples=200, deadline=None, derandomize=True)
@given(st.lists(st.tuples(st.booleans(), st.booleans()), max_size=12), st.booleans())
def test_sides_by_turns(steps, side):
    want, now = [], side
    for falls, rises in steps:
        now = not falls if now else rises
        want.append(now)
    assert sides(np.array([s[0] for s in steps], dtype=bool), np.array([s[1] for s in steps], dtype=bool), side).tolist() == want


def plain_supertrend(close, upper, lower):
    """The recurrence bar by bar."""
    up, low, line, side = list(upper), list(lower), [np.nan], [np.nan]
    for k in range(1, len(close)):
        if close[k - 1] <= up[k - 1] < up[k]:
            up[k] = up[k - 1]
        if close[k - 1] >= low[k - 1] > low[k]:
            low[k] = low[k - 1]
        if side[-1] == 1.0 and not np.isnan(line[-1]):
            side.append(-1.0 if close[k] < low[k] else 1.0)
        else:
            side.append(1.0 if close[k] > up[k] else -1.0)
        line.append(low[k] if side[-1] > 0 else up[k])
    return line[: len(close)], side[: len(close)]


@pytest.mark.parametrize("seed", range(6))
def test_supertrend_in_any_batches(seed):
    rng = np.random.default_rng(seed)
    close = np.cumsum(rng.normal(0, 1, 300)).round(1)
    half = rng.uniform(0.2, 3, 300)
    half[: seed * 3] = np.nan
    half[100:102] = np.nan
    columns = {"close": close, "upper": close + rng.normal(0, 0.5, 300) + half, "lower": close - half}
    kernel, out = SuperTrend(), []
    cuts = [0, *np.sort(rng.integers(0, 300, 9)), 300]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out.append(kernel.push({k: v[a:b] for k, v in columns.items()}))
    line, side = plain_supertrend(close, columns["upper"], columns["lower"])
    np.testing.assert_array_equal(np.concatenate([o["supertrend"] for o in out]), line)
    np.testing.assert_array_equal(np.concatenate([o["supertrend_dir"] for o in out]), side)


def same(a, b, columns):
    a, b = (x.toPandas().sort_values(["symbol", "tf", "ts"]).reset_index(drop=True) for x in (a, b))
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    pd.testing.assert_frame_equal(a, b, check_exact=False, rtol=1e-9)
    assert a[columns].notna().any().all()


@pytest.mark.parametrize("block", ["date_trunc('day', ts)", "date_trunc('hour', ts)", "unix_seconds(timestamp(ts)) div 28800", "0"])
def test_blocks_equal_series(bars, block):
    df = bars[0].union(bars[0].limit(1).selectExpr("'ONE'", "tf", "ts", "open", "high", "low", "close", "tick_volume", "spread"))
    df = df.withColumn("high", F.when(F.expr("hour(ts) = 7 and symbol = 'BBB'"), None).otherwise(F.col("high")))
    b = F.expr(block)
    same(ind.ema(df, 9, block=b), ind.ema(df, 9), ["ema_9"])
    same(ind.macd(df, block=b), ind.macd(df), ["macd_signal"])
    same(ind.adx(df, 5, block=b), ind.adx(df, 5), ["adx_5"])
    same(ind.rsi(df, block=b), ind.rsi(df), ["rsi_14"])
    same(ind.supertrend(df, 4, 1.5, block=b), ind.supertrend(df, 4, 1.5), ["supertrend"])


def test_blocks_of_nothing(bars):
    none = bars[0].limit(0)
    assert ind.supertrend(none, block=F.to_date("ts")).count() == ind.macd(none, block=F.to_date("ts")).count() == 0
