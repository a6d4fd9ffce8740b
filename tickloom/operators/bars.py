"""Bars: from ticks, from finer bars, and the last ones of each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.schema import BAR_COLUMNS, KEYS, interval_of
from tickloom.functions.windows import series

#: Shift of window starts that makes weekly buckets begin on Monday (the epoch is a Thursday).
WEEK_START = "4 days"


def bucket(ts: Column | str, tf: str) -> Column:
    """Start of the bucket of ts: left-closed, labelled by its start; weeks begin on Monday."""
    width = interval_of(tf)
    w = F.window(ts, width, width, WEEK_START) if tf == "W1" else F.window(ts, width)
    return w["start"].cast("timestamp_ntz")


def resample_ticks(ticks: DataFrame, tf: str = "H1", symbol: str = "symbol", price: str = "price", ts: str = "ts", tie: str = "seq") -> DataFrame:
    """OHLC bars of ticks: first and last price by (ts, tie), extremes, number of ticks. Empty buckets give no bar.

    Partial aggregates are merged per (symbol, bucket); nothing is sorted.
    """
    order = F.struct(F.col(ts), F.col(tie))
    return (
        ticks.where(F.col(price).isNotNull() & F.col(ts).isNotNull())
        .groupBy(F.col(symbol).alias("symbol"), bucket(F.col(ts), tf).alias("bar_ts"))
        .agg(
            F.min_by(price, order).cast("double").alias("open"),
            F.max(price).cast("double").alias("high"),
            F.min(price).cast("double").alias("low"),
            F.max_by(price, order).cast("double").alias("close"),
            F.count("*").alias("tick_volume"),
        )
        .select("symbol", F.lit(tf).alias("tf"), F.col("bar_ts").alias("ts"), "open", "high", "low", "close", "tick_volume", F.lit(0).cast("bigint").alias("spread"))
    )


def resample_bars(bars: DataFrame, tf: str) -> DataFrame:
    """Coarser bars of finer ones; a null price leaves the bar out, as an incomplete one."""
    return (
        bars.groupBy("symbol", bucket(F.col("ts"), tf).alias("bar_ts"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("tick_volume").alias("tick_volume"),
            F.max("spread").alias("spread"),
        )
        .withColumn("tf", F.lit(tf))
        .withColumnRenamed("bar_ts", "ts")
        .select(*BAR_COLUMNS)
        .dropna(subset=["open", "high", "low", "close"])
    )


def last_bars(bars: DataFrame, n: int) -> DataFrame:
    """The latest n bars of each series."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("ts"))
    return bars.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def closed_bars(bars: DataFrame, now: Column, n: int | None = None) -> DataFrame:
    """Bars whose period has ended by now, the latest n of each series if n is given."""
    ends = F.coalesce(*(F.when(F.col("tf") == tf, F.col("ts") + F.expr(f"interval {interval_of(tf)}")) for tf in ("M1", "M5", "M15", "M30", "H1", "H4", "D1", "W1")))
    done = bars.where(ends <= now)
    return done if n is None else last_bars(done, n)


def bars_between(bars: DataFrame, start, end) -> DataFrame:
    """Bars from start to end, both included."""
    return bars.where(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def latest_bar(bars: DataFrame) -> DataFrame:
    """The last bar of each series."""
    rest = [c for c in bars.columns if c not in KEYS]
    return bars.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), "ts").alias("bar")).select(*KEYS, "bar.*")


def padded(bars: DataFrame, n: int) -> DataFrame:
    """Exactly n slots a series, 1 to n: the latest bars at the end, slots before the first bar hold NULL."""
    ranked = last_bars(bars, n).withColumn("__back", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("ts"))))
    slots = bars.select(*KEYS).distinct().withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(n))))
    ranked = ranked.withColumn("slot", (F.lit(n + 1) - F.col("__back")).cast("int")).drop("__back")
    return slots.join(ranked, [*KEYS, "slot"], "left").withColumn("slot", F.col("slot").cast("bigint"))


def scaled_by_last_close(bars: DataFrame) -> DataFrame:
    """Prices divided by the series' last close, as norm_open, norm_high, norm_low, norm_close."""
    end = F.last("close").over(Window.partitionBy(*KEYS).orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return bars.withColumns({f"norm_{c}": F.try_divide(F.col(c), end) for c in ("open", "high", "low", "close")})


def log_return(bars: DataFrame) -> DataFrame:
    """Logarithm of the close over the close before."""
    before = F.lag("close").over(series())
    return bars.withColumn("log_return", F.when((F.col("close") > 0) & (before > 0), F.log(F.col("close") / before)))


def with_context(df: DataFrame, **values) -> DataFrame:
    """Constant columns."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def filled(df: DataFrame, columns: list[str], value: float = 0.0) -> DataFrame:
    """NULL and NaN features as value."""
    return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(value)) for c in columns})
