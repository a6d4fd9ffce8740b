"""Observations: what an agent sees at each step, put together from account, time, price windows, divergences and levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators import indicators as ind
from tickloom.operators.joins import asof_join, observation_windows
from tickloom.operators.risk import time_features
from tickloom.operators.support import levels_multi_tf
from tickloom.plans.pipeline import build_features
from tickloom.sources.storage import stored

#: Indicators whose divergences an observation holds. Fixed values.
DIVERGENCES = ("rsi_14", "stochrsi_k_14_3", "macd_line", "cci_20", "mfi_14")
TIME_COLUMNS = ("hour_norm", "hour_sin", "hour_cos", "dow_norm", "dow_sin", "dow_cos", "min_norm", "is_london", "is_newyork", "is_asia")


def columns_like(df: DataFrame, part: str) -> list[str]:
    """Names of the columns that hold part."""
    return [c for c in df.columns if part in c]


def divergence_features(bars: DataFrame, order: int = 5) -> DataFrame:
    """Standard features and the divergences of DIVERGENCES."""
    return ind.detect_divergences_extrema(build_features(bars), list(DIVERGENCES), order=order)


def nearest_levels(steps: DataFrame, levels: DataFrame, price: str = "price") -> DataFrame:
    """Distance from each step's price to the nearest level below and above it (NULL without one): support_gap, resistance_gap.

    Steps and levels(symbol, price) are laid on one price axis per symbol, and the last level is carried up and down it.
    """
    axis = steps.select(*steps.columns, F.col(price).alias("__at"), F.lit(None).cast("double").alias("__level"), F.lit(1).alias("__step"))
    marks = levels.where("price is not null").select(*(F.col(c) if c == "symbol" else F.lit(None).cast(steps.schema[c].dataType).alias(c) for c in steps.columns), F.col("price").alias("__at"), F.col("price").alias("__level"), F.lit(0).alias("__step"))
    up = Window.partitionBy("symbol").orderBy("__at", "__step").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("symbol").orderBy(F.desc("__at"), "__step").rowsBetween(Window.unboundedPreceding, 0)
    both = axis.unionByName(marks).withColumns({"__low": F.last("__level", ignorenulls=True).over(up), "__high": F.last("__level", ignorenulls=True).over(down)})
    gaps = {"support_gap": F.col("__at") - F.col("__low"), "resistance_gap": F.col("__high") - F.col("__at")}
    return both.where("__step = 1").withColumns(gaps).select(*steps.columns, *gaps)


def observations(states: DataFrame, bars: DataFrame, n: int = 15, base_tf: str | None = None, prominence: float = 0.05) -> DataFrame:
    """One row for each state(symbol, tf, ts, price, balance, equity, n_positions, net_volume): the account, the time features, the
    divergences of the base timeframe as of the step, the gaps to the nearest support and resistance, and `windows`, a map from
    timeframe to its last n bars flattened (oldest first, NULL where there are fewer).

    bars holds all timeframes; base_tf is the states' own unless given. Levels come from all bars, as in the reference: they are
    context of an episode, not known at each step. States and bars are read several times and are written to the shared folder, where they stay.
    """
    states, bars = stored(states, "states"), stored(bars, "bars")
    out = time_features(states)
    base = bars.join(states.select("tf").distinct(), "tf", "left_semi") if base_tf is None else bars.where(F.col("tf") == base_tf)
    features = divergence_features(base)
    flags = columns_like(features, "divergence")
    out = asof_join(out, features.select("symbol", "ts", *flags), ["symbol"], columns=flags).drop("asof_ts")
    levels = levels_multi_tf(bars, method="dbscan", prominence=prominence).where("tf is null").select("symbol", "price")
    out = nearest_levels(out, levels)
    windows = observation_windows(states.select("symbol", "ts"), bars, n)
    maps = windows.groupBy("symbol", "ts").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tf", "window")))).alias("windows"))
    return out.join(maps, ["symbol", "ts"], "left")
