"""Support and resistance: fractals, swings, pivots, and clusters of their price levels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tickloom.functions.schema import KEYS
from tickloom.functions.windows import bar_idx, centred_extreme, islands, series
from tickloom.operators.bars import latest_bar

#: Clusters have settled once no centre moves by more than this share of the prices' standard deviation in a round.
TOLERANCE = 1e-6
#: Prices handled at once by the array kernel.
CHUNK = 1 << 15


def _marked(bars: DataFrame, high: Column, low: Column) -> DataFrame:
    """One row for each mark: kind, its price and its bar's position."""
    found = bars.withColumns({"bar_idx": bar_idx(), "__high": high, "__low": low}).where("__high or __low")
    marks = F.array_compact(F.array(F.when(F.col("__high"), F.struct(F.lit("high").alias("kind"), F.col("high").alias("price"))), F.when(F.col("__low"), F.struct(F.lit("low").alias("kind"), F.col("low").alias("price")))))
    return found.withColumn("mark", F.explode(marks)).select(*KEYS, "ts", "bar_idx", "mark.kind", "mark.price")


def fractals(bars: DataFrame, lookback: int = 5) -> DataFrame:
    """Bars whose high (low) is the extreme of lookback bars to both sides; ties all count, a bar may be both."""
    return _marked(bars, centred_extreme("high", lookback, F.max), centred_extreme("low", lookback, F.min))


def swing_points(bars: DataFrame) -> DataFrame:
    """Bars whose high (low) is strictly beyond both neighbours'."""

    def beyond(name: str, sign: int) -> Column:
        x, before, after = sign * F.col(name), sign * F.lag(name).over(series()), sign * F.lead(name).over(series())
        return F.coalesce((x > before) & (x > after), F.lit(False))

    return _marked(bars, beyond("high", 1), beyond("low", -1))


def pivots(bars: DataFrame, last_only: bool = True) -> DataFrame:
    """Classic pivot and two supports and resistances, of the last bar of each series or of every bar."""
    out = latest_bar(bars) if last_only else bars
    h, low, p = F.col("high"), F.col("low"), F.col("pivot")
    out = out.withColumn("pivot", (h + low + F.col("close")) / 3.0)
    return out.withColumns({"r1": 2.0 * p - low, "s1": 2.0 * p - h, "r2": p + (h - low), "s2": p - (h - low)})


def price_islands(levels: DataFrame, keys: list[str], eps: Column | float, price: str = "price") -> DataFrame:
    """Density clusters of prices on a line: column island, which ends where the next price lies more than eps away."""
    w = Window.partitionBy(*keys).orderBy(price)
    gap = F.col(price) - F.lag(price).over(w)
    return levels.withColumn("__gap", gap).withColumn("island", islands(keys, [price], F.col("__gap").isNull() | (F.col("__gap") > eps)).cast("long")).drop("__gap")


def density_clusters(levels: DataFrame, keys: list[str], eps: float, min_samples: int) -> DataFrame:
    """DBSCAN of prices on a line: levels with columns island (null for noise) and core.

    A price is a core if at least min_samples prices, itself included, lie within eps of it. Cores no more than eps apart share an
    island. Another price within eps of a core joins the nearest one's island, of two as near the lower one's. All of it is
    windows over one order of the prices.
    """
    line = Window.partitionBy(*keys).orderBy("price")
    upto, onward = line.rowsBetween(Window.unboundedPreceding, 0), line.rowsBetween(0, Window.unboundedFollowing)
    # the nearest min_samples - 1 prices on either side decide; a frame of prices would round its ends
    near = lambda lo, hi: F.size(F.filter(F.collect_list("price").over(line.rowsBetween(lo, hi)), lambda x: F.abs(F.col("price") - x) <= eps))
    reach = max(1, int(min_samples) - 1)
    out = levels.withColumn("core", near(-reach, -1) + near(1, reach) + 1 >= min_samples)
    core = F.when(F.col("core"), F.col("price"))
    before = F.last(core, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("__new", F.col("core") & F.coalesce(F.col("price") - before > eps, F.lit(True)))
    out = out.withColumn("__island", F.sum(F.col("__new").cast("long")).over(upto))
    held = F.when(F.col("core"), F.struct("price", F.col("__island").alias("island")))
    out = out.withColumns({"__low": F.last(held, ignorenulls=True).over(upto), "__high": F.first(held, ignorenulls=True).over(onward)})
    below, above = F.col("price") - F.col("__low.price"), F.col("__high.price") - F.col("price")
    nearest = F.when((below <= eps) & F.coalesce(below <= above, F.lit(True)), F.col("__low.island")).when(above <= eps, F.col("__high.island"))
    nearest = F.coalesce(nearest, F.when(below <= eps, F.col("__low.island")))
    return out.withColumn("island", nearest).drop("__new", "__island", "__low", "__high")


def best_partition(price: np.ndarray, times: np.ndarray, k: int) -> np.ndarray:
    """Centres of the k intervals of distinct sorted prices, standing so many times, with the least sum of squared distances to their means.

    A dynamic programme over the number of intervals: the best last cut never moves back as the prices grow in number, so each layer finds
    its cuts by halving, all ranges of one depth at once.
    """
    n, middle = len(price), np.average(price, weights=times)
    x = price - middle
    w, s, q = (np.concatenate(([0.0], np.cumsum(v))) for v in (times, times * x, times * x * x))

    def cost(j: np.ndarray, i: np.ndarray) -> np.ndarray:
        return q[i] - q[j] - (s[i] - s[j]) ** 2 / np.maximum(w[i] - w[j], 1e-300)

    best = cost(np.zeros(n + 1, dtype=int), np.arange(n + 1))
    layers = []
    for c in range(2, min(k, n) + 1):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        # ranges of ends still open, and of the cuts that they can have
        lo, hi, first, last = (np.array([v]) for v in (c, n, c - 1, n - 1))
        while len(lo):
            mid = (lo + hi) // 2
            size = np.minimum(last, mid - 1) - first + 1
            at = np.concatenate(([0], np.cumsum(size)))[:-1]
            j = np.arange(size.sum()) - np.repeat(at - first, size)
            total = best[j] + cost(j, np.repeat(mid, size))
            least = np.minimum.reduceat(total, at)
            hit = np.flatnonzero(total == np.repeat(least, size))
            chosen = j[hit[np.searchsorted(hit, at)]]
            new[mid], cut[mid] = least, chosen
            lo, hi, first, last = (np.concatenate(v) for v in ((lo, mid + 1), (mid - 1, hi), (first, chosen), (chosen, last)))
            open_ = lo <= hi
            lo, hi, first, last = lo[open_], hi[open_], first[open_], last[open_]
        best = new
        layers.append(cut)
    ends = [n]
    for cut in reversed(layers):
        ends.append(int(cut[ends[-1]]))
    ends = np.array([0, *reversed(ends)])
    return np.diff(s[ends]) / np.diff(w[ends]) + middle


def _settle(price: np.ndarray, times: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centres of a Gaussian mixture of distinct sorted prices that stand so many times.

    Starts from quantiles, so reruns agree, and ends once no centre moves by more than TOLERANCE standard deviations in a round;
    raises where that takes more than so many rounds.
    """
    upto = np.cumsum(times)
    at = (upto[-1] - 1) * (2 * np.arange(k) + 1) / (2 * k)
    low, high = (price[np.searchsorted(upto, f(at), side="right")] for f in (np.floor, np.ceil))
    mean = low + (high - low) * (at - np.floor(at))
    spread = price.var() or 1e-12
    var, share = np.full(k, spread / k), np.full(k, 1.0 / k)
    for _ in range(rounds):
        n, total, squares = np.zeros(k), np.zeros(k), np.zeros(k)
        for start in range(0, len(price), CHUNK):
            x, t = price[start : start + CHUNK, None], times[start : start + CHUNK, None]
            w = np.log(share) - 0.5 * np.log(var) - (x - mean) ** 2 / (2.0 * var)
            w = np.exp(w - w.max(axis=1, keepdims=True))
            w *= t / w.sum(axis=1, keepdims=True)
            d = x - mean
            n, total, squares = n + w.sum(axis=0), total + (w * d).sum(axis=0), squares + (w * d * d).sum(axis=0)
        full = np.where(n > 0, n, 1.0)
        move = np.where(n > 0, total / full, 0.0)
        mean, var, share = mean + move, np.maximum(np.where(n > 0, squares / full, 0.0) - move**2, 1e-12), np.maximum(n / n.sum(), 1e-12)
        if np.abs(move).max() <= TOLERANCE * np.sqrt(spread):
            return mean
    raise RuntimeError(f"a mixture of {len(price)} prices has not settled after {rounds} rounds")


def _centres(levels: DataFrame, keys: list[str], k: int, rounds: int, soft: bool) -> DataFrame:
    """The centres of each series. A series is one task, as in windows, which holds some numbers for each distinct price."""
    levels = levels.where("price is not null").groupBy(*keys, F.col("price").cast("double").alias("price")).agg(F.count("*").cast("double").alias("times"))

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        price, times = rows["price"].to_numpy(), rows["times"].to_numpy()
        order = np.argsort(price)
        centres = _settle(price[order], times[order], k, rounds) if soft else best_partition(price[order], times[order], k)
        return pa.table([*(pa.array([v.as_py()] * len(centres), v.type) for v in key), pa.array(centres)], names=[*keys, "price"])

    return levels.groupBy(*keys).applyInArrow(run, StructType([*(levels.schema[c] for c in keys), StructField("price", DoubleType())]))


def cluster_levels(levels: DataFrame, keys: list[str], method: str = "kmeans", n_clusters: int = 5, eps: float = 0.001, min_samples: int = 2, rounds: int = 100_000) -> DataFrame:
    """Prices of the clusters of levels(keys, price) by method: columns keys and price.

    kmeans and gmm give n_clusters centres (fewer where a series has fewer distinct prices, since equal centres are one): kmeans those of
    the least sum of squares there is, gmm those of a mixture, which raises where it has not settled after so many rounds;
    dbscan gives the means of density_clusters(), without noise; any other method returns the levels. Series of one level pass unchanged.
    """
    if method not in ("kmeans", "gmm", "dbscan"):
        return levels.select(*keys, "price")
    counted = levels.select(*keys, "price").withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    single, many = counted.where("__n < 2").select(*keys, "price"), counted.where("__n >= 2").select(*keys, "price")
    if method == "dbscan":
        inside = density_clusters(many, keys, eps, min_samples).where("island is not null")
        found = inside.groupBy(*keys, "island").agg(F.avg("price").alias("price")).select(*keys, "price")
    else:
        found = _centres(many, keys, n_clusters, rounds, method == "gmm").distinct()
    return found.unionByName(single)


def raw_levels(bars: DataFrame, lookback: int = 5) -> DataFrame:
    """Prices of all fractals and swings, repeated ones kept: keys, kind, source, price."""
    return fractals(bars, lookback).select(*KEYS, "kind", F.lit("fractal").alias("source"), "price").unionByName(swing_points(bars).select(*KEYS, "kind", F.lit("swing").alias("source"), "price"))


def levels_multi_tf(bars: DataFrame, lookback: int = 5, method: str = "kmeans", n_clusters: int = 5, prominence: float = 0.001, min_samples: int = 2) -> DataFrame:
    """Level clusters of each timeframe, and those of all timeframes' clusters together (tf NULL): symbol, tf, price."""
    own = cluster_levels(raw_levels(bars, lookback), KEYS, method, n_clusters, prominence, min_samples)
    together = cluster_levels(own.select("symbol", "price"), ["symbol"], method, n_clusters, prominence, min_samples)
    return own.unionByName(together.select("symbol", F.lit(None).cast("string").alias("tf"), "price"))
