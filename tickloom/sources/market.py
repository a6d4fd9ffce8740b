"""Readers and writers of bars, levels and news."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.schema import BAR_COLUMNS, BARS, KEYS, NEWS, interval_of, normalize_bars
from tickloom.operators.bars import bars_between, last_bars


def read_bars(spark: SparkSession, path: str, symbols: list[str] | None = None, tfs: list[str] | None = None, start=None, end=None, last: int | None = None) -> DataFrame:
    """Bars of a Parquet table partitioned by symbol and tf; symbols, tfs, start and end reach the scan as partition and row filters."""
    bars = spark.read.schema(BARS).parquet(path)
    if symbols is not None:
        bars = bars.where(F.col("symbol").isin(symbols))
    if tfs is not None:
        for tf in tfs:
            interval_of(tf)
        bars = bars.where(F.col("tf").isin(tfs))
    if start is not None and end is not None:
        bars = bars_between(bars, start, end)
    return bars if last is None else last_bars(bars, last)


def write_bars(bars: DataFrame, path: str, skip_existing: bool = False, skip_symbols: list[str] | None = None, mode: str = "append") -> None:
    """Write bars as Parquet partitioned by symbol and tf. skip_existing leaves series alone that the table has; an empty frame writes nothing."""
    if skip_symbols:
        bars = bars.where(~F.col("symbol").isin(skip_symbols))
    if skip_existing and (known := _series_of(bars.sparkSession, path)) is not None:
        bars = bars.join(known, KEYS, "left_anti")
    if bars.isEmpty():
        return
    bars.select(*BAR_COLUMNS).repartition(*KEYS).sortWithinPartitions(*KEYS, "ts").write.mode(mode).partitionBy(*KEYS).parquet(path)


def _series_of(spark: SparkSession, path: str) -> DataFrame | None:
    """Series of a table, from its partitions; None where there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(BARS).parquet(path).select(*KEYS).distinct()
    except AnalysisException:
        return None


def read_pair_files(spark: SparkSession, folder: str) -> DataFrame:
    """Bars of CSV files named {symbol}_{tf}.csv with a header of time, open, high, low, close, tick_volume, spread."""
    raw = spark.read.option("header", True).schema("time string, open double, high double, low double, close double, tick_volume bigint, spread bigint").csv(f"{folder}/*_*.csv")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    pair = F.regexp_extract(name, r"^(.+)_([A-Z]+\d+)\.csv$", 1), F.regexp_extract(name, r"^(.+)_([A-Z]+\d+)\.csv$", 2)
    return normalize_bars(raw.select(pair[0].alias("symbol"), pair[1].alias("tf"), F.col("time").cast("timestamp_ntz").alias("ts"), "open", "high", "low", "close", "tick_volume", "spread"))


def write_pair_csv(bars: DataFrame, folder: str, mode: str = "overwrite") -> None:
    """CSV with header, a folder for each symbol and tf, rows in order of time; an empty frame writes nothing."""
    if bars.isEmpty():
        return
    out = bars.select(*KEYS, F.col("ts").alias("time"), "open", "high", "low", "close", "tick_volume", "spread")
    out.repartition(*KEYS).sortWithinPartitions(*KEYS, "time").write.mode(mode).option("header", True).partitionBy(*KEYS).csv(folder)


def write_range_csv(bars: DataFrame, symbol: str, tf: str, start, end, path: str) -> bool:
    """One series' bars from start to end as CSV; False, and no file, where there are none."""
    some = bars_between(bars.where((F.col("symbol") == symbol) & (F.col("tf") == tf)), start, end)
    if some.isEmpty():
        return False
    some.drop(*KEYS).withColumnRenamed("ts", "time").orderBy("time").write.mode("overwrite").option("header", True).csv(path)
    return True


def read_news(spark: SparkSession, path: str) -> DataFrame:
    """Calendar events of a CSV with a header."""
    return spark.read.option("header", True).schema(NEWS).csv(path)


def fetch_pairs(spark: SparkSession, fetch: Callable[[str, str], pd.DataFrame], symbols: list[str], tfs: list[str], retries: int = 2, backoff: float = 2.0, skip_symbols: list[str] | None = None) -> DataFrame:
    """Bars of every symbol and timeframe, each pair fetched in a task of its own by fetch(symbol, tf) -> frame of bars.

    A pair that fails is tried again after a pause that grows by backoff seconds; after that it gives no rows, and the others go
    on. Unknown timeframes raise ValueError.
    """
    for tf in tfs:
        interval_of(tf)
    pairs = [(s, t) for s in symbols if s not in (skip_symbols or []) for t in tfs]
    if not pairs:
        return spark.createDataFrame([], BARS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for symbol, tf in zip(batch["symbol"], batch["tf"], strict=True):
                for attempt in range(retries + 1):
                    try:
                        got = fetch(symbol, tf)
                    except Exception:  # noqa: BLE001 - whatever a source raises
                        if attempt < retries:
                            time.sleep(backoff * (attempt + 1))
                        continue
                    if got is not None and len(got):
                        out = got.rename(columns={"time": "ts"}).assign(symbol=symbol, tf=tf)
                        yield out.reindex(columns=BAR_COLUMNS)
                    break

    return spark.createDataFrame(pairs, "symbol string, tf string").repartition(len(pairs)).mapInPandas(run, BARS)


def levels_as_json(levels: DataFrame) -> DataFrame:
    """Each level as a JSON object in column json; dates are ISO."""
    return levels.select(F.to_json(F.struct(*levels.columns)).alias("json"))


def write_levels_json(levels: DataFrame, path: str) -> None:
    """Levels as JSON lines."""
    levels.write.mode("overwrite").json(path)


def write_levels_csv(levels: DataFrame, path: str) -> None:
    """Levels as CSV with a header."""
    levels.write.mode("overwrite").option("header", True).csv(path)


def plot_annotations(levels: DataFrame) -> DataFrame:
    """price, label and strength of levels, with 0, "fib" and 0 where they are missing."""

    def column(name: str, default: Column) -> Column:
        return (F.coalesce(F.col(name), default) if name in levels.columns else default).alias(name)

    return levels.select(column("price", F.lit(0.0)), column("label", F.lit("fib")), column("strength", F.lit(0.0)))
