"""Structured Streaming: bars of ticks, versions of bars, and the sequential kernels over streams.

The kernels are those of the batch scans, so that a stream in order of time gives what a batch gives.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.functions.schema import BAR_COLUMNS, KEYS, interval_of
from tickloom.operators.bars import WEEK_START
from tickloom.plans.scan import Kernel


def stream_bars(ticks: DataFrame, tf: str = "H1", delay: str = "10 minutes", symbol: str = "symbol", price: str = "price", ts: str = "ts", tie: str = "seq") -> DataFrame:
    """Bars of a stream of ticks. In append mode a bar comes out once its end lies behind the watermark, so only closed bars do.

    ts must be a timestamp with time zone, as watermarks are.
    """
    width, order = interval_of(tf), F.struct(F.col(ts), F.col(tie))
    window = F.window(ts, width, width, WEEK_START) if tf == "W1" else F.window(ts, width)
    grouped = ticks.where(F.col(price).isNotNull()).withWatermark(ts, delay).groupBy(F.col(symbol).alias("symbol"), window.alias("w"))
    made = grouped.agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.count("*").alias("tick_volume"))
    start = F.col("w.start").cast("timestamp_ntz")
    return made.select("symbol", F.lit(tf).alias("tf"), start.alias("ts"), "open", "high", "low", "close", "tick_volume", F.lit(0).cast("bigint").alias("spread"))


def append_versions(stream: DataFrame, path: str, checkpoint: str, seq: str = "seq") -> StreamingQuery:
    """Append bars, corrections among them, to a table of versions; seq orders the versions of a bar. The file sink is exactly-once."""
    return stream.select(*BAR_COLUMNS, F.col(seq).alias("seq")).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*KEYS).outputMode("append").trigger(availableNow=True).start()


def current_bars(versions: DataFrame) -> DataFrame:
    """The last version of each bar."""
    rest = [c for c in BAR_COLUMNS if c not in (*KEYS, "ts")]
    return versions.groupBy(*KEYS, "ts").agg(F.max_by(F.struct(*rest), "seq").alias("bar")).select(*KEYS, "ts", "bar.*")


def read_current_bars(spark: SparkSession, path: str) -> DataFrame:
    """The last version of each bar of a table of versions."""
    return current_bars(spark.read.parquet(path))


def _held(kernel: Kernel) -> bytes:
    """A kernel's state: all that it holds but its functions."""
    return pickle.dumps({k: v for k, v in vars(kernel).items() if k != "steps"})


def stream_scan(stream: DataFrame, keys: list[str], order: str, reads: list[str], makes: str, kernel: Callable[[], Kernel]) -> DataFrame:
    """The batch scan over a stream: each series' kernel state is kept between batches.

    Rows of a batch are taken in order of time. A row at or before the last one taken of its series comes too late for a
    recurrence and is left out; a source that may be out of order belongs behind stream_bars(), which emits in order.
    Output columns: keys, order, reads, then those of makes.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    made = [part.split()[0].strip("`") for part in makes.split(", ")]
    columns = list(dict.fromkeys([*keys, order, *reads]))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), makes])

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(frames)).sort_values(order, kind="stable")
        engine, last = kernel(), None
        if state.exists:
            held, last = state.get
            vars(engine).update(pickle.loads(held))
            last = pd.Timestamp(last)
            part = part[part[order] > last]
        if not len(part):
            return
        numbers = {c: part[c].to_numpy(dtype=np.float64, na_value=np.nan) if part[c].dtype.kind in "ifb" or pd.api.types.is_numeric_dtype(part[c]) else part[c].to_numpy() for c in reads}
        out = engine.push(numbers)
        state.update((_held(engine), part[order].iloc[-1].isoformat()))
        result = part[columns].reset_index(drop=True)
        for c in made:
            result[c] = out[c]
        yield result

    return stream.select(*columns).groupBy(*keys).applyInPandasWithState(run, schema, "held binary, last string", "append", GroupStateTimeout.NoTimeout)
