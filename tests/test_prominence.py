"""Prominences by blocks against the walk of whole series and against brute force."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import engine as eng
from tickloom.operators.prominence import Higher, Records, blocked_extrema


START = datetime.datetime(2025, 1, 1)


def series(spark, shapes):
    rows = [(s, "M1", START + datetime.timedelta(minutes=k), float(x)) for s, values in shapes.items() for k, x in enumerate(values)]
    return spark.createDataFrame(rows, "symbol string, tf string, ts timestamp_ntz, close double").withColumn("open", F.col("close"))


def brute_force(x):
    """(bar, kind, prominence) of each extremum."""
    out = set()
    for sign, kind in ((1, "peak"), (-1, "valley")):
        v, k = [sign * y for y in x], 0
        while k < len(v):
            end = k
            while end + 1 < len(v) and v[end + 1] == v[k]:
                end += 1
            if 0 < k and end < len(v) - 1 and v[k - 1] < v[k] > v[end + 1]:
                low = []
                for step in (-1, 1):
                    j, least = k, v[k]
                    while 0 <= j < len(v) and v[j] <= v[k]:
                        least, j = min(least, v[j]), j + step
                    low.append(least)
                out.add(((k + end) // 2, kind, round(v[k] - max(low), 9)))
            k = end + 1
    return out


def test_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    shapes = {f"r{k}": rng.integers(0, 5 + 5 * k, 97).tolist() for k in range(4)} | {"walk": np.cumsum(rng.normal(0, 1, 150)).round(2).tolist()}
    shapes |= {"up": list(range(80)), "down": list(range(80, 0, -1)), "flat": [3] * 60, "steps": np.repeat([1, 2, 5, 5, 2, 3, 1], 11).tolist(), "one": [4], "two": [1, 2]}
    shapes |= {"zigzag_up": [k + 3 * (k % 2) for k in range(90)], "zigzag_down": [-k + 3 * (k % 2) for k in range(90)], "spike": [100, *rng.integers(0, 9, 70).tolist(), 99]}
    df = series(spark, shapes)
    for minutes in (1, 7, 40, 1000):
        found = blocked_extrema(df.selectExpr("symbol", "tf", "ts", "close price"), F.expr(f"unix_seconds(timestamp(ts)) div {60 * minutes}")).collect()
        for s, values in shapes.items():
            mine = [r for r in found if r.symbol == s]
            assert {(r.bar_idx, r.kind, round(r.prominence, 9)) for r in mine} == brute_force(values), (s, minutes)
            assert len(mine) == len(brute_force(values)) and all(values[r.bar_idx] == r.price and r.ts == START + datetime.timedelta(minutes=r.bar_idx) for r in mine)


@pytest.mark.parametrize("options", [{}, {"min_distance_bars": 1}, {"min_prominence": 0.5, "use_wicks": "bodies"}])
def test_swings_by_blocks_equal_swings(bars, options):
    one, two = (eng.swings(bars[0], **options, **more).toPandas().sort_values(["symbol", "ts", "kind"]).reset_index(drop=True) for more in ({}, {"block": F.to_date("ts")}))
    assert len(one)
    pd.testing.assert_frame_equal(one, two, check_dtype=False)
    assert eng.swings(bars[0].limit(0), block=F.to_date("ts")).count() == 0


def test_what_is_handed_on_is_bounded():
    """A monotone series leaves each block's records no larger than the block, and one entry or two a block along the blocks."""
    for step in (1.0, -1.0):
        size, tops = 50, []
        for b in range(40):
            kernel = Records()
            kernel.push({"v": step * np.arange(b * size, (b + 1) * size)})
            out = kernel.result()
            assert len(out["records"]) == len(out["after"]) <= size
            tops.append((out["top"], out["bottom"]))
        made = Higher().push({"top": np.array([t for t, _ in tops]), "bottom": np.array([b for _, b in tops]), "block": np.arange(40.0)})
        assert sum(map(len, made["tops"])) <= 80
