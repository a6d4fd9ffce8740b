"""Fibonacci levels of price legs, their clusters and golden zones. Ratios are fractions here."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.windows import bar_idx, centred_extreme, islands
from tickloom.operators.bars import resample_bars
from tickloom.operators.support import fractals
from tickloom.plans.kernels import FirstFitZones, MergedZones, RunningMeanClusters
from tickloom.plans.scan import scan

# The ratios of each kind of level.
RETRACE_RATIOS = (0.236, 0.382, 0.5, 0.618, 0.786)
EXTEND_RATIOS = (1.272, 1.618, 2.0, 2.618)
PROJECT_RATIOS = (0.618, 1.0, 1.618)
GOLDEN = 0.618


def _levels(legs: DataFrame, kept: list[str], prefix: str, kind: str, ratios: tuple[float, ...], price: Column) -> DataFrame:
    marks = F.array(*(F.struct(F.lit(f"{prefix}_{r}").alias("level_name"), F.lit(float(r)).alias("ratio")) for r in ratios))
    out = legs.withColumn("__m", F.explode(marks))
    return out.select(*kept, "__m.level_name", "__m.ratio", price.alias("price"), F.lit(kind).alias("type"))


def _ordered(legs: DataFrame) -> DataFrame:
    return legs.withColumns({"__hi": F.greatest("high", "low"), "__lo": F.least("high", "low")})


def retracement(legs: DataFrame, ratios: tuple[float, ...] = RETRACE_RATIOS) -> DataFrame:
    """Levels high - r (high - low) of legs(high, low, ...); other columns are kept, and high and low put in order."""
    kept = [c for c in legs.columns if c not in ("high", "low")]
    return _levels(_ordered(legs), kept, "R", "retracement", ratios, F.col("__hi") - F.col("__m.ratio") * (F.col("__hi") - F.col("__lo")))


def extension(legs: DataFrame, ratios: tuple[float, ...] = EXTEND_RATIOS) -> DataFrame:
    """Levels high + (r - 1)(high - low) of legs(high, low, ...)."""
    kept = [c for c in legs.columns if c not in ("high", "low")]
    return _levels(_ordered(legs), kept, "E", "extension", ratios, F.col("__hi") + (F.col("__m.ratio") - 1.0) * (F.col("__hi") - F.col("__lo")))


def projection(legs: DataFrame, ratios: tuple[float, ...] = PROJECT_RATIOS) -> DataFrame:
    """Levels c + r (b - a) of legs(a, b, c, ...)."""
    kept = [c for c in legs.columns if c not in ("a", "b", "c")]
    return _levels(legs, kept, "P", "projection", ratios, F.col("c") + F.col("__m.ratio") * (F.col("b") - F.col("a")))


def levels_from_swings(swings: DataFrame, method: str = "retracement", ratios: tuple[float, ...] | None = None) -> DataFrame:
    """tf, method, ratio, price, leg_id of swings(tf, high, low, leg_id). Extensions here are high + r (high - low); projections need three points and give no rows."""
    use = ratios or {"retracement": RETRACE_RATIOS, "extension": EXTEND_RATIOS, "projection": PROJECT_RATIOS}.get(method, ())
    if method not in ("retracement", "extension"):
        use, swings = (0.0,), swings.where(F.lit(False))
    out = swings.withColumn("ratio", F.explode(F.array(*(F.lit(float(r)) for r in use))))
    span = F.col("high") - F.col("low")
    price = F.col("high") - F.col("ratio") * span if method != "extension" else F.col("high") + F.col("ratio") * span
    keys = [c for c in swings.columns if c not in ("high", "low", "tf", "leg_id")]
    return out.select(*keys, "tf", F.lit(method).alias("method"), "ratio", price.alias("price"), "leg_id")


def detect_swings(bars: DataFrame, window: int = 3) -> DataFrame:
    """Swing highs and lows over window bars to both sides: symbol, tf, ts, bar_idx, kind, price."""
    return fractals(bars, window)


def extreme_legs(bars: DataFrame) -> DataFrame:
    """Highest high and lowest low of each series as one leg: symbol, tf, high, low."""
    return bars.groupBy("symbol", "tf").agg(F.max("high").alias("high"), F.min("low").alias("low"))


def auto_fibonacci(bars: DataFrame, timeframes: tuple[str, ...] = ("H1", "H4", "D1"), min_distance: int = 5) -> DataFrame:
    """Retracements between the highest swing high and the lowest swing low of each coarser timeframe.

    A bar that is both counts as a high. Timeframes with fewer than two swings give no levels.
    """
    frames = None
    for tf in timeframes:
        coarse = resample_bars(bars, tf)
        frames = coarse if frames is None else frames.unionByName(coarse)
    high = centred_extreme("high", min_distance, F.max)
    low = centred_extreme("low", min_distance, F.min)
    marked = frames.withColumn("bar_idx", bar_idx()).withColumns({"__h": high, "__l": low})
    swings = marked.where("__h or __l").groupBy("symbol", "tf").agg(F.count("*").alias("n"), F.max(F.when(F.col("__h"), F.col("high"))).alias("high"), F.min(F.when(~F.col("__h"), F.col("low"))).alias("low"))
    return retracement(swings.where("n >= 2 and high is not null and low is not null").drop("n"))


#: Weights of a cluster's score. Fixed values.
ZONE_WEIGHTS = {"count": 0.25, "timeframes": 0.25, "golden_ratio": 0.25, "density": 0.15, "extra_signals": 0.10}


def cluster_zones(levels: DataFrame, keys: list[str], tolerance: float = 0.002, signals: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """Chains of levels(keys, tf, ratio, price) whose neighbours lie within tolerance of the lower one, of two or more.

    Columns keys, cluster_id (from 1 by price), cluster_low, cluster_high, center, count, unique_timeframes, width, score
    (0 to 100), type. signals(keys, price) adds its weight to clusters that hold one: each signal is matched to the cluster that
    begins last at or below it.
    """
    w = weights or ZONE_WEIGHTS
    order = Window.partitionBy(*keys).orderBy("price")
    before = F.lag("price").over(order)
    chained = levels.withColumn("__gap", F.try_divide(F.abs(F.col("price") - before), before))
    chained = chained.withColumn("__run", islands(keys, ["price"], F.col("__gap") > tolerance))
    zones = chained.groupBy(*keys, "__run").agg(
        F.min("price").alias("cluster_low"),
        F.max("price").alias("cluster_high"),
        F.avg("price").alias("center"),
        F.count("*").alias("count"),
        F.count_distinct(F.when(F.col("tf") != "", F.col("tf"))).alias("unique_timeframes"),
        F.coalesce(F.min(F.abs(F.col("ratio") - GOLDEN)), F.lit(1.0)).alias("__far"),
    )
    zones = zones.where(F.col("count") >= 2).withColumn("width", F.col("cluster_high") - F.col("cluster_low"))
    zones = zones.withColumn("cluster_id", F.row_number().over(Window.partitionBy(*keys).orderBy("cluster_low")).cast("long"))
    extra = F.lit(0)
    if signals is not None:
        marks = zones.select(*keys, F.col("cluster_low").alias("at"), F.lit(0).alias("side"), "cluster_id", "cluster_high")
        marks = marks.unionByName(signals.select(*keys, F.col("price").alias("at"), F.lit(1).alias("side")), allowMissingColumns=True)
        upto = Window.partitionBy(*keys).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
        held = marks.withColumn("z", F.last(F.when(F.col("side") == 0, F.struct("cluster_id", "cluster_high")), ignorenulls=True).over(upto))
        held = held.where((F.col("side") == 1) & (F.col("at") <= F.col("z.cluster_high"))).select(*keys, F.col("z.cluster_id").alias("cluster_id")).distinct().withColumn("__extra", F.lit(1))
        zones = zones.join(held, [*keys, "cluster_id"], "left")
        extra = F.coalesce("__extra", F.lit(0))
    score = (
        w["count"] * F.least(F.col("count") / 10.0, F.lit(1.0))
        + w["timeframes"] * F.least(F.col("unique_timeframes") / 5.0, F.lit(1.0))
        + w["golden_ratio"] * (1.0 - F.col("__far"))
        + w["density"] * F.try_divide(F.lit(1.0), 1.0 + F.try_divide("width", "center"))
        + w["extra_signals"] * extra
    )
    return zones.select(*keys, "cluster_id", "cluster_low", "cluster_high", "center", "count", "unique_timeframes", "width", F.round(score * 100.0, 2).alias("score"), F.lit("cluster").alias("type"))


def golden_zone_distance(prices: DataFrame, levels: DataFrame | None = None, keys: list[str] | None = None, ratios: tuple[float, ...] = (0.618, 0.786), normalize: str = "relative", tol: float = 1e-3) -> DataFrame:
    """Distance of prices(price, swing_high, swing_low, ...) to the zone between the levels of ratios, and the nearest level.

    levels(keys, ratio, price, level_name) supplies prices of ratios within tol, by ratio or by the last number in the name, one row
    joined for each key; other ratios are computed from the swing. A ratio without a price makes the results NULL. Columns added:
    g_low, g_high, center, distance_abs, distance_rel, in_zone, nearest_level, nearest_ratio, nearest_dist_abs,
    nearest_dist_rel, members.
    """
    hi, lo = F.greatest("swing_high", "swing_low"), F.least("swing_high", "swing_low")
    out, given = prices, {}
    if levels is not None:
        number = F.try_element_at(F.regexp_extract_all(F.col("level_name"), F.lit(r"\d+\.?\d*"), F.lit(0)), F.lit(-1)).cast("double")
        ratio = F.coalesce(F.col("ratio"), number)
        found = levels.groupBy(*(keys or [])).agg(*(F.min(F.when(F.abs(ratio - r) <= tol, F.col("price"))).alias(f"__given{k}") for k, r in enumerate(ratios)))
        out = out.join(found, keys, "left")
        given = {k: F.col(f"__given{k}") for k in range(len(ratios))}
    members = [
        F.struct(
            F.lit(float(r)).alias("ratio"),
            (F.coalesce(given[k], hi - r * (hi - lo)) if k in given else hi - r * (hi - lo)).alias("price"),
            (F.when(given[k].isNotNull(), F.lit("retracement")).otherwise(F.lit("calc")) if k in given else F.lit("calc")).alias("source"),
        )
        for k, r in enumerate(ratios)
    ]
    out = out.withColumn("members", F.array(*members))
    levels_ = F.transform("members", lambda m: m["price"])
    known = ~F.exists(levels_, lambda x: x.isNull())
    out = out.withColumns({"g_low": F.when(known, F.array_min(levels_)), "g_high": F.when(known, F.array_max(levels_))})
    p, low, high = F.col("price"), F.col("g_low"), F.col("g_high")
    out = out.withColumn("center", (low + high) / 2.0).withColumn("distance_abs", F.when(p < low, low - p).when(p > high, p - high).when(known, F.lit(0.0)))
    nearest = F.array_min(F.transform("members", lambda m, k: F.struct(F.abs(m["price"] - p).alias("d"), k.alias("k"), m["price"].alias("price"), m["ratio"].alias("ratio"))))
    out = out.withColumns({"distance_rel": F.col("distance_abs") if normalize == "absolute" else F.try_divide("distance_abs", "center"), "in_zone": p.between(low, high), "__near": F.when(known, nearest)})
    out = out.withColumns({"nearest_level": F.col("__near.price"), "nearest_ratio": F.col("__near.ratio"), "nearest_dist_abs": F.col("__near.d"), "nearest_dist_rel": F.try_divide(F.col("__near.d"), F.col("__near.price"))})
    return out.drop("__near", *(f"__given{k}" for k in given))


def risk_reward(plans: DataFrame, entry: str = "entry", stop: str = "stop", target: str = "target") -> DataFrame:
    """rr: reward over risk, to four digits; infinite where the risk is 0."""
    risk, reward = F.abs(F.col(entry) - F.col(stop)), F.abs(F.col(target) - F.col(entry))
    return plans.withColumn("rr", F.when(risk == 0, F.lit(float("inf"))).otherwise(F.round(F.try_divide(reward, risk), 4)))


@dataclass
class ClusterParams:
    """Tolerance, least size and weights of level clusters. Fixed values of the weights."""

    tolerance_mode: str = "rel"
    rel_tolerance: float = 0.001
    abs_tolerance: float | None = None
    min_hits: int = 2
    use_timeframe_diversity: bool = True
    method_weights: dict[str, float] = field(default_factory=lambda: {"retracement": 1.0, "extension": 0.9, "projection": 0.8})
    ratio_weights: dict[float, float] = field(default_factory=lambda: {0.236: 0.7, 0.382: 0.9, 0.5: 1.0, 0.618: 1.2, 0.786: 1.1, 1.272: 1.0, 1.618: 1.2, 2.0: 0.9, 2.618: 0.8})
    timeframe_weights: dict[str, float] = field(default_factory=dict)


def _weight(x: Column, weights: dict) -> Column:
    if not weights:
        return F.lit(1.0)
    return F.coalesce(F.create_map(*(F.lit(v) for pair in weights.items() for v in pair))[x], F.lit(1.0))


#: Column that numbers the stretches of prices that a sweep cannot join, and the significant digits of a bucket of prices.
STRETCH, DIGITS = "__stretch", 3
#: What a reach is raised by, for the rounding of means.
ROUNDING = 1 + 1e-9


def safe_cuts(df: DataFrame, keys: list[str], low: str, high: str, apart: Callable[[Column, Column], Column]) -> DataFrame:
    """df(keys, low, high, ...) with STRETCH: rows of different stretches never meet in an ascending sweep, so each is swept by itself.

    apart(h, l) says whether everything up to a highest end h is out of reach of all that begins at l or above. Prices are cut into
    buckets of DIGITS significant digits; what is compared along a key are buckets, one row each, so that one key's rows are spread over
    tasks wherever there is such a gap. Rows without a price are a stretch of their own.
    """
    x = F.col(low)
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(x))) - (DIGITS - 1))
    bucketed = df.withColumn("__bucket", F.when(x == 0, F.lit(0.0)).otherwise(F.floor(x / unit) * unit))
    facts = bucketed.where("__bucket is not null").groupBy(*keys, "__bucket").agg(F.min(low).alias("__first"), F.max(high).alias("__most"))
    line = Window.partitionBy(*keys).orderBy("__first")
    before = F.max("__most").over(line.rowsBetween(Window.unboundedPreceding, -1))
    facts = facts.withColumn("__cut", F.coalesce(apart(before, F.col("__first")), F.lit(False)))
    facts = facts.select(*(F.col(k).alias(f"__key{n}") for n, k in enumerate(keys)), F.col("__bucket").alias("__of"), F.sum(F.col("__cut").cast("long")).over(line).alias(STRETCH))
    same = F.col("__bucket") == F.col("__of")
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{n}"))
    return bucketed.join(facts, same, "left").select(*df.columns, STRETCH)


def cluster_levels(levels: DataFrame, keys: list[str], params: ClusterParams | None = None, sort_by: str = "score") -> DataFrame:
    """Clusters of levels(keys, tf, method, ratio, price) around running means, in an ascending sweep.

    Columns keys, cluster_id (from 0 by price), price_min, price_max, center, width, hits, timeframes, methods, ratios, score, rank;
    rank orders each key's clusters by sort_by, descending for score and hits.
    """
    p = params or ClusterParams()
    relative, absolute = (p.rel_tolerance, None) if p.tolerance_mode == "rel" else (None, p.abs_tolerance or 0.0)
    # a gap that is wider than the tolerance of its ends also is for any mean below it
    reach = (lambda a, b: F.greatest(F.abs(a), F.abs(b)) * relative) if relative is not None else (lambda a, b: F.lit(absolute))
    cut = safe_cuts(levels, keys, "price", "price", lambda a, b: (b - a) > reach(a, b) * ROUNDING) if relative is None or relative < 1 else levels.withColumn(STRETCH, F.lit(0))
    swept = scan(cut, [*keys, STRETCH], ["price", "tf", "ratio"], ["price"], "cluster long", lambda: RunningMeanClusters(relative, absolute))
    score = _weight(F.lower("method"), p.method_weights) * _weight(F.col("ratio"), p.ratio_weights) * _weight(F.upper("tf"), p.timeframe_weights)
    out = swept.groupBy(*keys, STRETCH, "cluster").agg(
        F.min("price").alias("price_min"),
        F.max("price").alias("price_max"),
        F.avg("price").alias("center"),
        F.count("*").alias("hits"),
        F.sort_array(F.collect_set(F.when(F.col("tf") != "", F.upper("tf")))).alias("timeframes"),
        F.sort_array(F.collect_set(F.when(F.col("method") != "", F.lower("method")))).alias("methods"),
        F.sort_array(F.collect_set("ratio")).alias("ratios"),
        F.sum(score).alias("__score"),
    )
    out = out.where(F.col("hits") >= p.min_hits).withColumn("width", F.col("price_max") - F.col("price_min"))
    bonus = 1.0 + 0.1 * F.greatest(F.size("timeframes") - 1, F.lit(0)) if p.use_timeframe_diversity else F.lit(1.0)
    out = out.withColumn("score", F.round(F.col("__score") * bonus, 4)).withColumn("cluster_id", (F.row_number().over(Window.partitionBy(*keys).orderBy("price_min")) - 1).cast("long"))
    first = F.desc(sort_by) if sort_by in ("score", "hits") else F.asc(sort_by)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(first, "cluster_id")).cast("long"))
    return out.select(*keys, "cluster_id", "price_min", "price_max", "center", "width", "hits", "timeframes", "methods", "ratios", "score", "rank")


def golden_zones(levels: DataFrame, keys: list[str], zone_width_pct: float = 0.006, merge_gap_pct: float = 0.0025, min_members: int = 2) -> DataFrame:
    """Zones of levels(keys, tf, ratio, price): each level's band joins the first zone that it touches, and touching zones merge.

    Columns keys, low, high, center, timeframes (their number), members, strength, rank (by falling strength). Zones with fewer
    than min_members timeframes are left out. Two sorted scans keep only the zones that a later level can still touch, and walk each
    stretch of prices between gaps that nothing reaches over by itself.
    """
    half = F.col("price") * (zone_width_pct / 2.0)
    bands = levels.withColumns({"__low": F.col("price") - half, "__high": F.col("price") + half})
    # above a price of 0 the reach of a band grows less than its lower end
    bands = safe_cuts(bands, keys, "__low", "__high", lambda a, b: (a > 0) & (b - a > b / (1.0 - zone_width_pct / 2.0) * merge_gap_pct * ROUNDING)) if 0 <= zone_width_pct / 2.0 + merge_gap_pct < 1 else bands.withColumn(STRETCH, F.lit(0))
    keys, told = [*keys, STRETCH], keys
    first = scan(bands, keys, ["__low", "tf", "ratio"], ["__low", "__high"], "__zone long", lambda: FirstFitZones(merge_gap_pct))
    boxes = first.groupBy(*keys, "__zone").agg(F.min("__low").alias("__zlow"), F.max("__high").alias("__zhigh"))
    merged = scan(boxes, keys, ["__zlow", "__zone"], ["__zlow", "__zhigh"], "__merged long", lambda: MergedZones(merge_gap_pct))
    joined = first.join(merged.select(*keys, "__zone", "__merged", "__zlow", "__zhigh"), [*keys, "__zone"])
    zone = Window.partitionBy(*keys, "__merged")
    joined = joined.withColumns({"low": F.min("__zlow").over(zone), "high": F.max("__zhigh").over(zone)})
    center = (F.col("low") + F.col("high")) / 2.0
    near = F.try_divide(F.lit(1.0), 1.0 + F.abs(F.col("price") - center) / F.greatest(F.lit(1e-8), center) * 100.0)
    golden = F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("ratio") - GOLDEN) / 0.1)
    out = joined.groupBy(*keys, "__merged", "low", "high").agg(
        F.count_distinct("tf").alias("timeframes"),
        F.sum(near).alias("__near"),
        F.sum(golden).alias("__golden"),
        F.sort_array(F.collect_list(F.struct("price", "tf", "ratio"))).alias("members"),
    )
    out = out.withColumn("strength", F.col("timeframes") * 2.0 + F.col("__near") + 0.5 * F.col("__golden")).where(F.col("timeframes") >= min_members)
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*told).orderBy(F.desc("strength"), "low")).cast("long"))
    return out.select(*told, "low", "high", ((F.col("low") + F.col("high")) / 2.0).alias("center"), "timeframes", "members", "strength", "rank")


def top_zones(zones: DataFrame, n: int = 3) -> DataFrame:
    """The n strongest zones of each key."""
    return zones.where(F.col("rank") <= n)


def zones_from_retracement(legs: DataFrame, keys: list[str], ratios: tuple[float, ...] = RETRACE_RATIOS, **params) -> DataFrame:
    """golden_zones() of the retracements of legs(keys, tf, high, low)."""
    return golden_zones(retracement(legs, ratios), keys, **params)
