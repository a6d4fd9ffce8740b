"""Swing legs, percent-ratio levels, clusters with touch statistics, order plans and features. Ratios are percents here."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.schema import KEYS
from tickloom.functions.windows import bar_idx, islands, rows, trailing, true_range
from tickloom.operators.prominence import blocked_extrema
from tickloom.operators.support import price_islands
from tickloom.plans.kernels import Valleys
from tickloom.plans.scan import scan
from tickloom.sources.storage import stored

#: Percent ratios of the levels.
PERCENT_RATIOS = (23.6, 38.2, 50.0, 61.8, 78.6, 100.0, 127.2, 161.8)


def simple_atr(bars: DataFrame, window: int = 14) -> DataFrame:
    """atr_simple_{window}: plain mean of the true range over the last bars, from the first bar on."""
    out = bars.withColumn("__tr", true_range())
    return out.withColumn(f"atr_simple_{window}", F.avg("__tr").over(trailing(window))).drop("__tr")


# --- legs -------------------------------------------------------------------------------------------------------------


def _apart(places: list[int], heights: list[float], distance: int) -> list[bool]:
    """Which of a chain's extrema survive: from the highest down (of equal ones the later first), neighbours nearer than distance go."""
    keep = [True] * len(places)
    for k in sorted(range(len(places)), key=lambda i: (heights[i], i), reverse=True):
        if not keep[k]:
            continue
        for step in (-1, 1):
            j = k + step
            while 0 <= j < len(places) and abs(places[j] - places[k]) < distance:
                keep[j] = False
                j += step
    return keep


def _thinned(found: DataFrame, distance: int) -> DataFrame:
    """Extrema at least distance bars apart. Only a chain of extrema nearer than that to the next one meets in a row; many chains
    go to Python in one Arrow batch, and extrema without such a neighbour do not go there."""
    kind = Window.partitionBy(*KEYS, "kind").orderBy("bar_idx")
    gap = found.withColumn("gap", F.col("bar_idx") - F.lag("bar_idx").over(kind))
    near = gap.withColumn("chain", islands([*KEYS, "kind"], ["bar_idx"], F.col("gap").isNull() | (F.col("gap") >= distance))).drop("gap")
    rest = [c for c in found.columns if c not in (*KEYS, "kind", "bar_idx")]
    chains = near.groupBy(*KEYS, "kind", "chain").agg(F.array_sort(F.collect_list(F.struct("bar_idx", *rest))).alias("g"))

    @F.pandas_udf("array<boolean>")
    def survivors(places: pd.Series, heights: pd.Series) -> pd.Series:
        return pd.Series([_apart(list(p), list(h), distance) for p, h in zip(places, heights, strict=True)])

    single = chains.where(F.size("g") == 1).select(*KEYS, "kind", F.col("g")[0].alias("e"))
    several = chains.where(F.size("g") > 1).withColumn("keep", survivors(F.col("g.bar_idx"), F.col("g.x")))
    several = several.select(*KEYS, "kind", F.explode(F.arrays_zip("g", "keep")).alias("z")).where("z.keep").select(*KEYS, "kind", F.col("z.g").alias("e"))
    return single.unionByName(several).select(*KEYS, "kind", "e.*").select(*found.columns)


def _extrema(bars: DataFrame, plateaus: bool = True) -> DataFrame:
    """Local maxima and minima of the price (the middle of a plateau, or single bars only without plateaus) with their prominence:
    keys, ts, bar_idx, price, kind, x, prominence, floor.

    Plateaus and their neighbours are windows; the valley (hill) on either side back to the last higher (lower) value is one
    scan in each direction. x is the price, negative for minima, so that larger is more extreme.
    """
    w = Window.partitionBy(*KEYS).orderBy("bar_idx")
    flat = bars.withColumns({"before": F.lag("price").over(w), "after": F.lead("price").over(w), "middle": F.col("bar_idx")})
    if plateaus:
        flat = flat.withColumn("run", islands(KEYS, ["bar_idx"], F.col("price") != F.col("before")))
        run = Window.partitionBy(*KEYS, "run").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        flat = flat.withColumns({"before": F.first("before").over(run), "after": F.last("after").over(run), "middle": F.floor((F.min("bar_idx").over(run) + F.max("bar_idx").over(run)) / 2)}).drop("run")
    schema = "low_since double, high_since double"
    left = scan(flat, KEYS, ["bar_idx"], ["price"], schema, Valleys).withColumnsRenamed({"low_since": "low_left", "high_since": "high_left"})
    both = scan(left, KEYS, [F.desc("bar_idx")], ["price"], schema, Valleys)
    x = F.col("price")
    top, bottom = (x > F.col("before")) & (x > F.col("after")), (x < F.col("before")) & (x < F.col("after"))
    depth = F.when(top, x - F.greatest("low_left", "low_since")).otherwise(F.least("high_left", "high_since") - x)
    found = both.where((F.col("bar_idx") == F.col("middle")) & (top | bottom))
    return found.select(*KEYS, "ts", "bar_idx", "price", F.when(top, "peak").otherwise("valley").alias("kind"), F.when(top, x).otherwise(-x).alias("x"), depth.alias("prominence"), "floor")


def swings(bars: DataFrame, min_prominence: float | None = None, min_distance_bars: int = 3, use_wicks: str = "wicks", block: Column | None = None, plateaus: bool = True) -> DataFrame:
    """Peaks and valleys of each series: keys, ts, idx, price, kind, prominence, confidence.

    The price is the close, or the middle of the body for use_wicks="bodies". Without min_prominence it is half the population
    deviation of the series' prices, 1e-8 at least. Confidence is the prominence over the series' largest. A series without
    swings gives no rows. Only extrema nearer than min_distance_bars to each other meet in a group. With block (a value that does not fall as ts
    rises, such as the month of ts) the extrema and their prominences are found by block, not by series. A plateau counts once, in
    its middle; without plateaus only a bar above (below) both neighbours counts, as the queries' SQL says.
    """
    if use_wicks not in ("wicks", "close", "bodies"):
        raise ValueError(f"unknown price choice {use_wicks!r}: take wicks, close or bodies")
    price = (F.col("open") + F.col("close")) / 2.0 if use_wicks == "bodies" else F.col("close")
    everything = Window.partitionBy(*KEYS)
    base, distance = bars.select(*KEYS, "ts", price.alias("price")).where("price is not null"), max(1, int(min_distance_bars))
    if block is None:
        floor = F.greatest(F.lit(1e-8), F.stddev_pop("price").over(everything) * 0.5) if min_prominence is None else F.lit(float(min_prominence))
        found = _extrema(base.withColumn("bar_idx", bar_idx()).withColumn("floor", floor), plateaus)
    elif min_prominence is None:
        found = blocked_extrema(base, block, plateaus).join(base.groupBy(*KEYS).agg(F.greatest(F.lit(1e-8), F.stddev_pop("price") * 0.5).alias("floor")), KEYS)
    else:
        found = blocked_extrema(base, block, plateaus).withColumn("floor", F.lit(float(min_prominence)))
    if distance > 1:
        found = _thinned(found, distance)
    found = found.where(F.col("prominence") >= F.col("floor"))
    most = F.max("prominence").over(everything)
    return found.select(*KEYS, "ts", F.col("bar_idx").alias("idx"), "price", "kind", "prominence", (F.col("prominence") / (most + 1e-9)).alias("confidence"))


def _ratio_rows(df: DataFrame, ratios: tuple[float, ...]) -> DataFrame:
    return df.withColumn("__r", F.explode(F.array(*(F.struct(F.lit(k).alias("pos"), F.lit(float(r)).alias("ratio")) for k, r in enumerate(ratios)))))


def percent_retracement(moves: DataFrame, ratios: tuple[float, ...] = PERCENT_RATIOS) -> DataFrame:
    """Levels end + (start - end)(1 - r / 100) of moves(start, end, ...)."""
    kept = [c for c in moves.columns if c not in ("start", "end")]
    price = F.col("end") + (F.col("start") - F.col("end")) * (1.0 - F.col("__r.ratio") / 100.0)
    return _ratio_rows(moves, ratios).select(*kept, "__r.ratio", price.alias("price"), F.lit("retracement").alias("type"), F.col("__r.pos").alias("pos"))


def percent_extension(moves: DataFrame, ratios: tuple[float, ...] = PERCENT_RATIOS) -> DataFrame:
    """Levels end + (end - start) r / 100 of moves(start, end, ...)."""
    kept = [c for c in moves.columns if c not in ("start", "end")]
    price = F.col("end") + (F.col("end") - F.col("start")) * (F.col("__r.ratio") / 100.0)
    return _ratio_rows(moves, ratios).select(*kept, "__r.ratio", price.alias("price"), F.lit("extension").alias("type"), (F.col("__r.pos") + len(ratios)).alias("pos"))


def percent_projection(moves: DataFrame, ratios: tuple[float, ...] = PERCENT_RATIOS) -> DataFrame:
    """Levels c + (c - b) r / 100 of moves(a, b, c, ...)."""
    kept = [c for c in moves.columns if c not in ("a", "b", "c")]
    price = F.col("c") + (F.col("c") - F.col("b")) * (F.col("__r.ratio") / 100.0)
    return _ratio_rows(moves, ratios).select(*kept, "__r.ratio", price.alias("price"), F.lit("projection").alias("type"))


def levels_of_swings(found: DataFrame, ratios: tuple[float, ...] = PERCENT_RATIOS) -> DataFrame:
    """Retracements and extensions of each pair of consecutive swings: keys, ts, level_price, ratio, type.

    Of levels equal in price, ratio and type within a series the first made stays.
    """
    w = Window.partitionBy(*KEYS).orderBy("idx", "kind")
    moves = found.select(*KEYS, F.lead("ts").over(w).alias("ts"), "idx", "kind", F.col("price").alias("start"), F.lead("price").over(w).alias("end")).where(F.col("end").isNotNull())
    made = percent_retracement(moves, ratios).unionByName(percent_extension(moves, ratios))
    first = Window.partitionBy(*KEYS, "price", "ratio", "type").orderBy("idx", "kind", "pos")
    made = made.withColumn("__first", F.row_number().over(first)).where("__first = 1")
    return made.select(*KEYS, "ts", F.col("price").alias("level_price"), "ratio", "type")


def raw_levels(bars: DataFrame, ratios: tuple[float, ...] = PERCENT_RATIOS, **params) -> DataFrame:
    """Levels of the bars' swings."""
    return levels_of_swings(swings(bars, **params), ratios)


# --- clusters ---------------------------------------------------------------------------------------------------------


def cluster_levels(levels: DataFrame, bars: DataFrame, eps_atr_mult: float = 0.5, min_samples: int = 1, atr_window: int = 14) -> DataFrame:
    """Groups of a series' distinct level prices whose neighbours lie within eps_atr_mult mean ATRs: keys, cluster_id, price (their
    mean), members, strength (their number), timeframes. Groups under min_samples count as noise: cluster_id -1, strength 0."""
    eps = simple_atr(bars, atr_window).groupBy(*KEYS).agg(F.greatest(F.lit(1e-8), eps_atr_mult * F.avg(f"atr_simple_{atr_window}")).alias("__eps"))
    distinct = levels.select(*KEYS, F.col("level_price").alias("price")).distinct().join(eps, KEYS)
    grouped = price_islands(distinct, KEYS, F.col("__eps")).groupBy(*KEYS, "island").agg(F.avg("price").alias("price"), F.sort_array(F.collect_list("price")).alias("members"), F.count("*").alias("n"))
    dense = F.col("n") >= min_samples
    number = F.row_number().over(Window.partitionBy(*KEYS, dense).orderBy("island")) - 1
    return grouped.select(
        *KEYS,
        F.when(dense, number).otherwise(-1).cast("long").alias("cluster_id"),
        "price",
        "members",
        F.when(dense, F.col("n").cast("double")).otherwise(0.0).alias("strength"),
        F.create_map("tf", F.col("n").cast("int")).alias("timeframes"),
    )


def level_stats(levels: DataFrame, bars: DataFrame, lookahead: int = 50, tolerance: float = 0.0) -> DataFrame:
    """How often the close's ranges over the next bars reach each level: keys, price, touch_count, hit_count, hit_rate, avg_bounce.

    A range [lo, hi] of lookahead closes touches a level within tolerance, and hits it without; the bounce is the larger of
    hi - level and level - lo, over touches. Levels and range ends are laid on one price axis per series and swept with
    running sums: a range enters at lo, turns from counting hi - level to level - lo in its middle, and leaves at
    hi, so no level meets a range one by one. Bounces of touches outside the range are summed on the two margins.
    """
    frame = rows(0, lookahead - 1)
    n = F.count("*").over(Window.partitionBy(*KEYS))
    ranges = bars.withColumns({"lo": F.min("close").over(frame), "hi": F.max("close").over(frame), "idx": bar_idx(), "n": n}).where(F.col("idx") < F.col("n") - lookahead)
    lo, hi = F.col("lo"), F.col("hi")
    middle = (lo + hi) / 2.0

    def event(at: Column, order: int, touch: int, hit: int, slope: int, base: Column | float) -> Column:
        """At a price, changes of: ranges touching, ranges hit, and of the summed bounce as slope * level + base."""
        return F.struct(at.alias("at"), F.lit(order).alias("order"), F.lit(touch).alias("touch"), F.lit(hit).alias("hit"), F.lit(slope).alias("slope"), (base if isinstance(base, Column) else F.lit(base)).alias("base"))

    events = [event(lo - tolerance, 0, 1, 0, -1, hi), event(middle, 1, 0, 0, 2, -(hi + lo)), event(hi + tolerance, 3, -1, 0, -1, lo), event(lo, 0, 0, 1, 0, 0.0), event(hi, 3, 0, -1, 0, 0.0)]
    marks = ranges.select(*KEYS, F.explode(F.array(*events)).alias("e")).select(*KEYS, "e.*")
    wanted = levels.select(*KEYS, "price").distinct().select(*KEYS, F.col("price").alias("at"), F.lit(2).alias("order"), F.lit(True).alias("level"))
    swept = marks.unionByName(wanted, allowMissingColumns=True)
    w = Window.partitionBy(*KEYS).orderBy("at", "order").rowsBetween(Window.unboundedPreceding, 0)
    swept = swept.withColumns({c: F.coalesce(F.sum(c).over(w), F.lit(0)) for c in ("touch", "hit", "slope", "base")}).where("level")
    touches, hits = F.col("touch"), F.col("hit")
    bounce = F.col("slope") * F.col("at") + F.col("base")
    return swept.select(
        *KEYS,
        F.col("at").alias("price"),
        touches.cast("long").alias("touch_count"),
        hits.cast("long").alias("hit_count"),
        F.coalesce(F.try_divide(hits.cast("double"), touches), F.lit(0.0)).alias("hit_rate"),
        F.coalesce(F.try_divide(bounce, touches), F.lit(0.0)).alias("avg_bounce"),
    )


def scored_clusters(levels: DataFrame, bars: DataFrame, eps_atr_mult: float = 0.5, atr_window: int = 14, lookahead: int = 50) -> DataFrame:
    """Clusters of levels with their statistics; strength is the number of members times (1 + hit_rate). rank is by falling strength."""
    clusters = cluster_levels(levels, bars, eps_atr_mult, 1, atr_window)
    out = clusters.join(level_stats(clusters, bars, lookahead), [*KEYS, "price"], "left")
    out = out.withColumns({"hit_rate": F.coalesce("hit_rate", F.lit(0.0)), "avg_bounce": F.coalesce("avg_bounce", F.lit(0.0)), "touch_count": F.coalesce("touch_count", F.lit(0)), "hit_count": F.coalesce("hit_count", F.lit(0))})
    out = out.withColumn("strength", F.col("strength") * (1.0 + F.col("hit_rate")))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("strength"), "price")).cast("long"))


# --- plans and features -----------------------------------------------------------------------------------------------


@dataclass
class OrderPlanner:
    """Stops, targets and lots of orders at levels."""

    risk_pct: float = 0.5
    account_equity: float = 10_000.0
    sl_atr_mult: float = 1.0
    min_lot: float = 0.01
    pip_value: float | None = None

    def plans(self, levels: DataFrame, price: str = "price", side: str = "side", atr: str = "atr", tp_atr_mult: float = 2.0, sl_buffer: float = 0.0, order_type: str = "limit") -> DataFrame:
        """entry_price, stop_price, take_profit, lot_size, order_type for each level; a side other than buy and sell gives an error."""
        way = F.when(F.col(side) == "buy", 1.0).when(F.col(side) == "sell", -1.0).otherwise(F.raise_error(F.lit("side must be 'buy' or 'sell'")).cast("double"))
        gap = F.col(atr) * self.sl_atr_mult + sl_buffer
        entry = F.col(price).cast("double")
        stop = entry - way * gap
        if self.pip_value:
            lot = F.greatest(F.lit(float(self.min_lot)), F.try_divide(F.lit(self.risk_pct / 100.0 * self.account_equity), F.abs(entry - stop) * self.pip_value))
        else:
            lot = F.lit(float(self.min_lot))
        target = entry + way * gap * tp_atr_mult if tp_atr_mult else F.lit(None).cast("double")
        return levels.withColumns({"entry_price": entry, "stop_price": stop, "take_profit": target, "lot_size": lot, "order_type": F.lit(order_type)})


def current_state(bars: DataFrame, atr_window: int = 14) -> DataFrame:
    """Last close and last simple ATR of each series: keys, price_now, atr."""
    with_atr = simple_atr(bars, atr_window)
    return with_atr.groupBy(*KEYS).agg(F.max_by("close", "ts").alias("price_now"), F.max_by(f"atr_simple_{atr_window}", "ts").alias("atr"))


def entry_plans(clusters: DataFrame, bars: DataFrame, planner: OrderPlanner | None = None, atr_window: int = 14) -> DataFrame:
    """A plan for each cluster: sell above the last close, buy at or below it."""
    now = clusters.join(current_state(bars, atr_window), KEYS)
    return (planner or OrderPlanner()).plans(now.withColumn("side", F.when(F.col("price") > F.col("price_now"), "sell").otherwise("buy")))


def cluster_features(clusters: DataFrame, bars: DataFrame, atr_window: int = 14) -> DataFrame:
    """Distances to the last close, strength, statistics and widths of each cluster."""
    out = clusters.join(current_state(bars, atr_window), KEYS)
    gap, atr = F.col("price") - F.col("price_now"), F.col("atr")
    width = F.when(F.size("members") > 1, F.array_max("members") - F.array_min("members")).otherwise(0.0)
    per_atr = lambda x: F.when(F.coalesce(atr, F.lit(0.0)) != 0, x / atr).otherwise(x)
    return out.select(
        *KEYS,
        "price",
        gap.alias("abs_dist"),
        F.coalesce(F.try_divide(gap, F.col("price_now")), F.lit(0.0)).alias("pct_dist"),
        per_atr(gap).alias("atr_norm_dist"),
        "strength",
        F.coalesce("hit_rate", F.lit(0.0)).alias("hit_rate"),
        F.coalesce("avg_bounce", F.lit(0.0)).alias("avg_bounce"),
        F.size("members").cast("double").alias("members_count"),
        F.cardinality("timeframes").cast("double").alias("tf_count"),
        width.alias("width"),
        per_atr(width).alias("width_norm"),
    )


def feature_vector(features: DataFrame, top_k: int = 5) -> DataFrame:
    """Six features of each of a series' top_k strongest clusters as one array, with zeros where there are fewer."""
    names = ["atr_norm_dist", "strength", "hit_rate", "avg_bounce", "members_count", "width_norm"]
    w = Window.partitionBy(*KEYS).orderBy(F.desc("strength"), "price")
    top = features.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= top_k)
    parts = F.array_sort(F.collect_list(F.struct("__k", F.array(*(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names)).alias("v"))))
    joined = top.groupBy(*KEYS).agg(F.flatten(F.transform(parts, lambda p: p["v"])).alias("vector"))
    return joined.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0.0), F.lit(6 * top_k) - F.size("vector"))))


def atr_zones(clusters: DataFrame, bars: DataFrame, zone_width_atr_mult: float = 0.5, atr_window: int = 14) -> DataFrame:
    """Zone of some ATRs around each cluster: low, high, strength, rank by falling strength."""
    out = clusters.join(current_state(bars, atr_window), KEYS)
    half = zone_width_atr_mult * F.col("atr")
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("strength"), "price"))
    return out.select(*KEYS, "price", (F.col("price") - half).alias("low"), (F.col("price") + half).alias("high"), "strength", rank.cast("long").alias("rank"))


class FibonacciEngine:
    """From bars to levels, clusters, plans and features, lazily. The bars and levels are read several times, so they are kept in
    Spark's cache until release(), which leaving a with block calls; cached=False keeps nothing, and tables=True writes both to the
    shared folder when they are first needed, where they stay."""

    def __init__(self, bars: DataFrame, ratios: tuple[float, ...] = PERCENT_RATIOS, atr_window: int = 14, cluster_eps_atr_mult: float = 0.5, cached: bool = True, tables: bool = False, plateaus: bool = True) -> None:
        self.cached, self.tables, self.plateaus = cached and not tables, tables, plateaus
        self.bars, self.ratios, self.atr_window, self.eps = self._kept(bars), ratios, atr_window, cluster_eps_atr_mult
        self._levels: DataFrame | None = None

    def __enter__(self) -> FibonacciEngine:
        return self

    def __exit__(self, *_) -> None:
        self.release()

    def _kept(self, df: DataFrame) -> DataFrame:
        return stored(df, "engine") if self.tables else df.persist() if self.cached else df

    def release(self) -> None:
        """Drop what is cached."""
        if self.cached:
            self.bars.unpersist()
            if self._levels is not None:
                self._levels.unpersist()

    def swings(self) -> DataFrame:
        return swings(self.bars, plateaus=self.plateaus)

    def levels(self) -> DataFrame:
        if self._levels is None:
            self._levels = self._kept(levels_of_swings(self.swings(), self.ratios))
        return self._levels

    def clusters(self) -> DataFrame:
        return scored_clusters(self.levels(), self.bars, self.eps, self.atr_window)

    def plans(self, planner: OrderPlanner | None = None) -> DataFrame:
        return entry_plans(self.clusters(), self.bars, planner, self.atr_window)

    def features(self) -> DataFrame:
        return cluster_features(self.clusters(), self.bars, self.atr_window)

    def vector(self, top_k: int = 5) -> DataFrame:
        return feature_vector(self.features(), top_k)

    def zones(self, zone_width_atr_mult: float = 0.5) -> DataFrame:
        return atr_zones(self.clusters(), self.bars, zone_width_atr_mult, self.atr_window)

    def with_bars(self, new_bars: DataFrame) -> FibonacciEngine:
        """An engine over these bars with new ones put in: of bars at the same time the new one counts."""
        both = self.bars.withColumn("__new", F.lit(0)).unionByName(new_bars.withColumn("__new", F.lit(1)), allowMissingColumns=True)
        rest = [c for c in self.bars.columns if c not in (*KEYS, "ts")]
        merged = both.groupBy(*KEYS, "ts").agg(F.max_by(F.struct(*rest), "__new").alias("bar")).select(*KEYS, "ts", "bar.*")
        return FibonacciEngine(merged.select(*self.bars.columns), self.ratios, self.atr_window, self.eps, self.cached, plateaus=self.plateaus)

