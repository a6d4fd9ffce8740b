"""Levels, clusters and zones against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import engine as eng
from tickloom.operators import fibonacci as fib
from tickloom.operators import support as sup


def brute_peaks(x, distance, prominence):
    n, peaks, k = len(x), [], 1
    while k < n - 1:
        j = k
        while j + 1 < n and x[j + 1] == x[k]:
            j += 1
        if x[k - 1] < x[k] and j + 1 < n and x[j + 1] < x[k]:
            peaks.append((k + j) // 2)
        k = j + 1
    keep = {p: True for p in peaks}
    for p in sorted(peaks, key=lambda p: (x[p], p), reverse=True):
        if keep[p]:
            for q in peaks:
                if q != p and abs(q - p) < distance:
                    keep[q] = False
    out = {}
    for p in peaks:
        if not keep[p]:
            continue
        lows = []
        for step in (-1, 1):
            i, low = p, x[p]
            while 0 <= i < n and x[i] <= x[p]:
                low = min(low, x[i])
                i += step
            lows.append(low)
        if x[p] - max(lows) >= prominence:
            out[p] = x[p] - max(lows)
    return out


@pytest.mark.parametrize("digits", [0, 3])
def test_swings_equal_brute_force(bars, digits):
    df, pdf = bars
    df = df.withColumn("close", F.round("close", digits))
    for distance in (1, 3, 6):
        rows = eng.swings(df, min_distance_bars=distance).where("symbol = 'AAA'").collect()
        x = pdf[pdf.symbol == "AAA"].close.round(digits).to_numpy()
        floor = max(1e-8, x.std() / 2)
        for kind, y in (("peak", x), ("valley", -x)):
            want = brute_peaks(y, distance, floor)
            got = {r.idx: r.prominence for r in rows if r.kind == kind}
            assert got.keys() == want.keys()
            np.testing.assert_allclose([got[k] for k in sorted(got)], [want[k] for k in sorted(want)])


def test_swings_of_a_flat_series_are_none(spark, bars):
    df, _ = bars
    assert eng.swings(df.withColumn("close", F.lit(1.0))).count() == 0
    with pytest.raises(ValueError):
        eng.swings(df, use_wicks="other")


def test_golden_zones_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    levels = [("k", ["H1", "H4", "D1"][k % 3], float(r), float(p)) for k, (r, p) in enumerate(zip(rng.choice([0.5, 0.618, 0.786], 60), 100 + 30 * rng.random(60), strict=True))]
    got = fib.golden_zones(spark.createDataFrame(levels, "k string, tf string, ratio double, price double"), ["k"]).orderBy("rank").collect()
    touch = lambda a, b: max(a[0], b[0]) - min(a[1], b[1]) <= abs(a[0] + a[1]) / 2 * 0.0025
    zones = []
    for low, high, m in sorted(((p * 0.997, p * 1.003, (t, r, p)) for _, t, r, p in levels), key=lambda z: z[0]):
        for z in zones:
            if touch((low, high), z):
                z[0], z[1] = min(z[0], low), max(z[1], high)
                z[2].append(m)
                break
        else:
            zones.append([low, high, [m]])
    merged = []
    for z in sorted(zones, key=lambda z: z[0]):
        if merged and touch(merged[-1], z):
            merged[-1][0], merged[-1][1] = min(merged[-1][0], z[0]), max(merged[-1][1], z[1])
            merged[-1][2] += z[2]
        else:
            merged.append(z)
    want = []
    for low, high, members in merged:
        center, tfs = (low + high) / 2, len({m[0] for m in members})
        near = sum(1 / (1 + abs(m[2] - center) / max(1e-8, center) * 100) for m in members)
        gold = sum(max(0.0, 1 - abs(m[1] - 0.618) / 0.1) for m in members)
        if tfs >= 2:
            want.append((tfs * 2 + near + 0.5 * gold, low, high, len(members)))
    want.sort(reverse=True)
    assert len(got) == len(want) > 1
    for g, w in zip(got, want, strict=True):
        np.testing.assert_allclose((g.strength, g.low, g.high, len(g.members)), w)
    assert fib.top_zones(spark.createDataFrame(got), 1).count() == 1


def test_islands_are_density_clusters(spark):
    rng = np.random.default_rng(2)
    prices = np.round(rng.random(200) * 10, 2)
    df = spark.createDataFrame([("s", float(p)) for p in prices], "symbol string, price double")
    got = sorted(r.price for r in sup.cluster_levels(df, ["symbol"], "dbscan", eps=0.05, min_samples=2).collect())
    x, groups = np.sort(prices), []
    for p in x:
        if groups and p - groups[-1][-1] <= 0.05:
            groups[-1].append(p)
        else:
            groups.append([p])
    np.testing.assert_allclose(got, [np.mean(g) for g in groups if len(g) >= 2])


@pytest.mark.parametrize("method", ["kmeans", "gmm"])
def test_mixtures_find_separate_groups(spark, method):
    rng = np.random.default_rng(5)
    prices = np.concatenate([c + rng.normal(0, 0.05, 40) for c in (1.0, 5.0, 9.0)])
    df = spark.createDataFrame([("s", float(p)) for p in prices], "symbol string, price double")
    got = sorted(r.price for r in sup.cluster_levels(df, ["symbol"], method, n_clusters=3).collect())
    np.testing.assert_allclose(got, [1, 5, 9], atol=0.1)
    one = spark.createDataFrame([("s", 3.0)], "symbol string, price double")
    assert [r.price for r in sup.cluster_levels(one, ["symbol"], method).collect()] == [3.0]


@pytest.mark.parametrize("method", ["kmeans", "gmm"])
def test_mixtures_of_skewed_prices_settle(spark, method):
    rng, k = np.random.default_rng(11), 5
    series = {"skewed": np.exp(rng.normal(0, 1, 1500)).round(3), "walk": (100 + np.cumsum(rng.normal(0, 1, 1500))).round(2)}
    df = spark.createDataFrame([(s, float(p)) for s, x in series.items() for p in x], "symbol string, price double")
    rows = sup.cluster_levels(df, ["symbol"], method, n_clusters=k).collect()
    for s, x in series.items():
        mean = np.quantile(x, [(2 * j + 1) / (2 * k) for j in range(k)])
        var, share = np.full(k, np.unique(x).var() / k), np.full(k, 1 / k)
        for _ in range(30_000):
            if method == "gmm":
                w = share / np.sqrt(var) * np.exp(-((x[:, None] - mean) ** 2) / (2 * var))
                w /= w.sum(axis=1, keepdims=True)
            else:
                w = np.eye(k)[np.abs(x[:, None] - mean).argmin(axis=1)]
            n, last = w.sum(axis=0), mean
            mean = w.T @ x / n
            var, share = (w * (x[:, None] - mean) ** 2).sum(axis=0) / n, n / n.sum()
            if np.abs(mean - last).max() <= 1e-9 * x.std():
                break
        else:
            raise AssertionError("brute force has not settled")
        got = sorted(r.price for r in rows if r.symbol == s)
        if method == "gmm":
            np.testing.assert_allclose(got, np.sort(mean), atol=2e-3 * x.std())
        else:  # the best partition of all is a settled one, and none from the quantiles is better
            squares = lambda c: (np.abs(x[:, None] - np.array(c)).min(axis=1) ** 2).sum()
            nearest = np.abs(x[:, None] - np.array(got)).argmin(axis=1)
            np.testing.assert_allclose(got, [x[nearest == j].mean() for j in range(k)])
            assert squares(got) <= squares(mean) * (1 + 1e-9)


def test_unsettled_mixtures_raise():
    price = np.sort(np.random.default_rng(3).lognormal(size=500))
    with pytest.raises(RuntimeError, match="not settled after 8 rounds"):
        sup._settle(price, np.ones(500), 5, 8)


@pytest.mark.parametrize("seed", range(8))
def test_best_partition_of_all_cuts(seed):
    rng = np.random.default_rng(seed)
    price = np.unique((rng.random(12) * rng.choice([1.0, 1e5]) + rng.choice([0.0, 1e6])).round(2))
    times = rng.integers(1, 5, len(price)).astype(float)

    def squares(ends):
        parts = [slice(a, b) for a, b in zip((0, *ends), (*ends, len(price)), strict=True)]
        means = [np.average(price[p], weights=times[p]) for p in parts]
        return sum((times[p] * (price[p] - m) ** 2).sum() for p, m in zip(parts, means, strict=True)), means

    for k in range(1, 6):
        least, means = min((squares(c) for c in itertools.combinations(range(1, len(price)), k - 1)), key=lambda x: x[0])
        got = sup.best_partition(price, times, k)
        cuts = np.searchsorted(price, (got[1:] + got[:-1]) / 2)
        np.testing.assert_allclose(squares(tuple(cuts))[0], least, rtol=1e-6, atol=1e-9)
        np.testing.assert_allclose(got, means, rtol=1e-9)
    assert sup.best_partition(price, times, 99).tolist() == pytest.approx(price.tolist())


@pytest.mark.parametrize("least", [1, 2, 3, 4, 6, 11])
def test_density_clusters_by_brute_force(spark, least):
    rng = np.random.default_rng(least)
    rows = [(s, float(p)) for s in "ab" for p in np.round(rng.random(150) * 12, 2)] + [("c", 1.0)] * 5 + [("d", 2.0), ("d", 2.3), ("e", 7.0)]
    eps, want = 0.11, {}
    for s in "abcd":
        x = sorted(p for k, p in rows if k == s)
        core = [p for p in x if sum(abs(p - q) <= eps for q in x) >= least]
        island, place = {}, 0
        for before, p in zip([None, *core], core, strict=False):
            place += before is None or p - before > eps
            island[p] = place
        groups = {}
        for p in x:
            near = min((abs(p - q), q) for q in core) if core else (np.inf, 0)
            if near[0] <= eps:
                groups.setdefault(island[near[1]], []).append(p)
        want[s] = sorted(np.mean(g) for g in groups.values())
    want["e"] = [7.0]
    df = spark.createDataFrame(rows, "symbol string, price double").repartition(3)
    got = sup.cluster_levels(df, ["symbol"], "dbscan", eps=eps, min_samples=least).collect()
    for s, means in want.items():
        np.testing.assert_allclose(sorted(r.price for r in got if r.symbol == s), means)


def test_level_stats_equal_brute_force(bars):
    df, pdf = bars
    x = pdf[pdf.symbol == "AAA"].close.to_numpy()
    levels = df.where("symbol = 'AAA'").select("symbol", "tf", F.col("close").alias("price")).distinct()
    for tolerance in (0.0, 0.7):
        got = {r.price: r for r in eng.level_stats(levels, df, 50, tolerance).collect()}
        for price in x[::37]:
            touches = hits = bounce = 0
            for k in range(len(x) - 50):
                lo, hi = x[k : k + 50].min(), x[k : k + 50].max()
                if lo - tolerance <= price <= hi + tolerance:
                    touches, bounce = touches + 1, bounce + max(hi - price, price - lo, 0)
                    hits += lo <= price <= hi
            r = got[price]
            assert (r.touch_count, r.hit_count) == (touches, hits)
            np.testing.assert_allclose(r.avg_bounce, bounce / touches if touches else 0.0, atol=1e-7)


def test_fixed_examples(spark):
    legs = spark.createDataFrame([("H1", 1900.0, 2000.0)], "tf string, high double, low double")
    assert [round(r.price, 1) for r in fib.retracement(legs).orderBy("ratio").collect()] == [1976.4, 1961.8, 1950.0, 1938.2, 1921.4]
    assert [round(r.price, 1) for r in fib.extension(legs).orderBy("ratio").collect()] == [2027.2, 2061.8, 2100.0, 2161.8]
    points = spark.createDataFrame([(1900.0, 2000.0, 1950.0)], "a double, b double, c double")
    assert [round(r.price, 1) for r in fib.projection(points).orderBy("ratio").collect()] == [2011.8, 2050.0, 2111.8]
    price = spark.createDataFrame([(1960.0, 2000.0, 1900.0)], "price double, swing_high double, swing_low double")
    zone = fib.golden_zone_distance(price).first()
    assert (round(zone.g_low, 1), round(zone.g_high, 1), round(zone.distance_abs, 1), zone.in_zone, zone.nearest_ratio) == (1921.4, 1938.2, 21.8, False, 0.618)
    named = spark.createDataFrame([("R_0.618", None, 1940.0)], "level_name string, ratio double, price double").withColumn("k", F.lit(1))
    zone = fib.golden_zone_distance(price.withColumn("k", F.lit(1)), named, ["k"]).first()
    assert zone.g_high == 1940.0 and zone.members[0].source == "retracement" and zone.members[1].source == "calc"
    plans = spark.createDataFrame([(1950.0, 1940.0, 1975.0), (1.0, 1.0, 2.0)], "entry double, stop double, target double")
    assert [r.rr for r in fib.risk_reward(plans).orderBy("rr").collect()] == [2.5, float("inf")]
    assert fib.levels_from_swings(legs.withColumn("leg_id", F.lit("a")), "projection").count() == 0


def test_engine_composes(bars):
    df, _ = bars
    e = eng.FibonacciEngine(df)
    clusters = e.clusters().cache()
    assert clusters.where("strength < size(members)").count() == 0
    assert e.vector(3).first().vector.__len__() == 18
    assert e.plans(eng.OrderPlanner(pip_value=1.0)).where("lot_size < 0.01").count() == 0
    new = df.limit(1).withColumn("close", F.lit(1e6))
    assert e.with_bars(new).bars.where("close = 1e6").count() == 1 and e.with_bars(new).bars.count() == df.count()


@pytest.mark.parametrize("digits", [1, 3, 5])
def test_stretches_change_no_sweep(spark, monkeypatch, digits):
    """Sweeps by stretch against sweeps of whole keys, on prices with gaps, negative ones and zero among them."""
    monkeypatch.setattr(fib, "DIGITS", digits)
    rng = np.random.default_rng(8)
    rows = []
    for s, spread in (("a", 0.001), ("b", 0.02), ("c", 0.2), (None, 0.01)):
        price, sign = 1.0, -1.0 if s == "c" else 1.0
        for _ in range(150):
            price *= 1 + rng.exponential(spread)
            rows.append((s, str(rng.choice(["H1", "H4", "D1"])), "retracement", float(rng.choice([0.5, 0.618])), float(sign * price)))
    rows += [("d", "H1", "extension", 0.5, x) for x in (-1.0, -0.0005, 0.0, 0.0004, 0.0008, 1.0)]
    df = spark.createDataFrame(rows, "symbol string, tf string, method string, ratio double, price double").repartition(4)
    whole = lambda df, *_: df.withColumn(fib.STRETCH, F.lit(0))
    params = [fib.ClusterParams(rel_tolerance=0.003), fib.ClusterParams(rel_tolerance=0.05, min_hits=1), fib.ClusterParams(tolerance_mode="abs", abs_tolerance=0.01)]
    runs = [lambda p=p: fib.cluster_levels(df, ["symbol"], p) for p in params] + [lambda: fib.golden_zones(df.where("price > 0"), ["symbol"], min_members=1), lambda: fib.golden_zones(df, ["symbol"], 0.02, 0.01, 1)]
    for run in runs:
        by_stretch = sorted(run().collect(), key=str)
        with monkeypatch.context() as m:
            m.setattr(fib, "safe_cuts", whole)
            assert by_stretch == sorted(run().collect(), key=str)
    cut = fib.safe_cuts(df, ["symbol"], "price", "price", lambda a, b: b - a > 0.003 * F.greatest(F.abs(a), F.abs(b)))
    assert cut.count() == len(rows) and cut.where("symbol = 'c'").select(fib.STRETCH).distinct().count() > 20
