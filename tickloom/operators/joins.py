"""Joins over time and price: as-of, news windows, tolerance lookups, observation windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight of a news event by impact; others weigh 1. Fixed values.
IMPACT_WEIGHTS = {"low": 1.0, "medium": 2.0, "high": 3.0}


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], on: str = "ts", columns: list[str] | None = None, prefix: str = "", clamp_first: bool = False, bucket: Column | None = None) -> DataFrame:
    """For each row of left the last row of right with the same keys at or before its time.

    Both sides are laid on one time axis and the last right row is carried forward, without pairing. The axis is cut into buckets
    (days, or any non-falling function of the time), so that one key's rows are spread over tasks; the last right row of the
    buckets before enters each bucket as its first row. A time before all of right gives NULLs, or with clamp_first the first row
    of right (which looks ahead). Right rows without a time count for nothing. columns of right are added, with prefix.
    """
    names = columns or [c for c in right.columns if c not in (*keys, on)]
    picked = F.struct(F.col(on).alias("__at"), *names)
    right = right.where(F.col(on).isNotNull())
    held = right.select(picked.alias("r")).schema["r"].dataType
    cut = F.to_date(on) if bucket is None else bucket
    a = left.select(*left.columns, F.lit(None).cast(held).alias("__r"), F.lit(1).alias("__side"), cut.alias("__bucket"))
    b = right.select(*(F.col(c) if c in keys or c == on else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), picked.alias("__r"), F.lit(0).alias("__side"), cut.alias("__bucket"))
    both = a.unionByName(b)

    at = F.when(F.col("__side") == 0, F.col(on))
    ends = both.groupBy(*keys, "__bucket").agg(F.max_by("__r", at).alias("__end"), F.min_by("__r", at).alias("__begin"))
    w = Window.partitionBy(*keys).orderBy("__bucket")  # one row a bucket
    before = F.last("__end", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    if clamp_first:
        before = F.coalesce(before, F.first("__begin", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    carried = ends.select(*keys, "__bucket", before.alias("__r"))
    carried = carried.select(*(F.col(c) if c in keys else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), "__r", F.lit(-1).alias("__side"), "__bucket")

    inside = Window.partitionBy(*keys, "__bucket").orderBy(on, "__side").rowsBetween(Window.unboundedPreceding, 0)
    last = both.unionByName(carried).withColumn("__last", F.last("__r", ignorenulls=True).over(inside))
    return last.where("__side = 1").select(*left.columns, *(F.col(f"__last.{n}").alias(f"{prefix}{n}") for n in names), F.col("__last.__at").alias(f"{prefix}asof_ts"))


def next_event(left: DataFrame, events: DataFrame, on: str = "ts", name: str = "next_ts") -> DataFrame:
    """Time of the first event at or after each row's time, by day buckets: events of a day meet rows of that day, and the first
    event after a day is carried back to it."""
    days = events.groupBy(F.to_date(on).alias("__day")).agg(F.min(on).alias("__first"), F.sort_array(F.collect_set(on)).alias("__times"))
    marked = left.withColumn("__day", F.to_date(on))
    axis = marked.select("__day").distinct().join(days, "__day", "full")
    later = Window.orderBy("__day").rowsBetween(1, Window.unboundedFollowing)  # one row a day
    axis = axis.withColumn("__after", F.first("__first", ignorenulls=True).over(later))
    out = marked.join(axis, "__day", "left")
    today = F.array_min(F.filter("__times", lambda t: t >= F.col(on)))
    return out.withColumn(name, F.coalesce(today, F.col("__after"))).drop("__day", "__first", "__times", "__after")


def _near(rows: DataFrame, news: DataFrame, on: str, before: int, after: int) -> DataFrame:
    """Pairs of rows(__row, on) and news whose time lies from `before` minutes before to `after` minutes after the row's time.

    Times are cut into buckets as wide as the window, and a row looks into the two or three buckets that its window touches,
    so that the join is by equality.
    """
    width = max(1, before + after) * 60
    second = lambda c: F.unix_timestamp(c.cast("timestamp"))
    at = second(F.col(on))
    span = F.sequence(F.floor((at - before * 60) / width), F.floor((at + after * 60) / width))
    spread = rows.withColumn("__bucket", F.explode(span))
    marked = news.withColumn("__bucket", F.floor(second(F.col("news_ts")) / width))
    hit = (F.col("news_ts") >= F.col(on) - F.make_dt_interval(mins=F.lit(before))) & (F.col("news_ts") <= F.col(on) + F.make_dt_interval(mins=F.lit(after)))
    return spread.join(marked, "__bucket").where(hit).drop("__bucket")


def news_risk(rows: DataFrame, news: DataFrame, on: str = "ts", minutes: int = 60) -> DataFrame:
    """news_risk: summed impact weights of the news within minutes of each row's time, 0 without any.

    News of equal time and impact are counted before the join; the risk is worked out once for each distinct time.
    """
    weight = F.coalesce(F.create_map(*(F.lit(x) for pair in IMPACT_WEIGHTS.items() for x in pair))[F.lower("impact")], F.lit(1.0))
    summed = news.groupBy(F.col("ts").alias("news_ts")).agg(F.sum(weight).alias("w"))
    times = rows.select(on).distinct()
    risk = _near(times, summed, on, minutes, minutes).groupBy(on).agg(F.sum("w").alias("news_risk"))
    return rows.join(risk, on, "left").withColumn("news_risk", F.coalesce("news_risk", F.lit(0.0)))


def near_news(rows: DataFrame, news: DataFrame, on: str = "ts", before: int = 30, after: int = 30, out: str = "near_news") -> DataFrame:
    """Whether any news lies from `before` minutes before to `after` minutes after each row's time."""
    times = rows.select(on).distinct()
    hit = _near(times, news.select(F.col("ts").alias("news_ts")).distinct(), on, before, after).select(on).distinct().withColumn("__hit", F.lit(True))
    return rows.join(hit, on, "left").withColumn(out, F.coalesce("__hit", F.lit(False))).drop("__hit")


def filter_levels_by_news(levels: DataFrame, news: DataFrame | None, current_time: Column, window_min: int = 30) -> DataFrame:
    """signal_strength: weak for all levels if any news lies within window_min minutes of current_time, else strong."""
    if news is None:
        return levels.withColumn("signal_strength", F.lit("strong"))
    gap = F.make_dt_interval(mins=F.lit(window_min))
    near = news.agg(F.coalesce(F.max((F.col("ts") >= current_time - gap) & (F.col("ts") <= current_time + gap)), F.lit(False)).alias("near"))
    near = F.broadcast(near.withColumn("__one", F.lit(1)))  # one row
    return levels.withColumn("__one", F.lit(1)).join(near, "__one").withColumn("signal_strength", F.when(F.col("near"), "weak").otherwise("strong")).drop("near", "__one")


def observation_windows(base: DataFrame, bars: DataFrame, n: int) -> DataFrame:
    """For each base time (symbol, ts) and timeframe of bars the last n bars up to it, flattened oldest first as open, high, low,
    close, NULL where there are fewer: symbol, ts, tf, window."""
    series = Window.partitionBy("symbol", "tf").orderBy("ts")
    numbered = bars.select("symbol", "tf", "ts", F.row_number().over(series).alias("__n"), F.collect_list(F.array("open", "high", "low", "close")).over(series.rowsBetween(-(n - 1), 0)).alias("__w"))
    # all timeframes, one array in one row, meet each time by a constant key
    frames_of_all = bars.agg(F.collect_set("tf").alias("tfs")).withColumn("__one", F.lit(1))
    times = base.select("symbol", "ts").distinct().withColumn("__one", F.lit(1)).join(F.broadcast(frames_of_all), "__one").select("symbol", "ts", F.explode("tfs").alias("tf"))
    # the as-of join carries the places of bars only; their windows come to the few that were met
    found = asof_join(times, numbered.select("symbol", "tf", "ts", "__n"), ["symbol", "tf"], columns=["__n"]).drop("asof_ts")
    found = found.join(numbered.select("symbol", "tf", "__n", "__w"), ["symbol", "tf", "__n"], "left")
    empty = F.lit(None).cast("double")
    flat = F.coalesce(F.flatten("__w"), F.array().cast("array<double>"))
    return found.select("symbol", "ts", "tf", F.concat(F.array_repeat(empty, F.lit(4 * n) - F.size(flat)), flat).alias("window"))
