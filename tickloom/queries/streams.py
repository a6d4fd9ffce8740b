"""Queries that run a stream over the driver's tables to its end, into a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.queries import features
from tickloom.queries.base import bars, bars_sql, events, ewm_sql, indexed_sql, q6, r6, rounded
from tickloom.queries.risk import SIMULATED, steps
from tickloom.sources.storage import shared_folder
from tickloom.streaming import bars as stream
from tickloom.streaming import twins

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def to_table(made: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now, and read what it wrote."""
    spark, folder = made.sparkSession, shared_folder(made.sparkSession, name)
    run = made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/out")


def as_stream(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder, read as a stream."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).parquet(folder)


@query(f"WITH {bars_sql('H1')} SELECT * FROM bars WHERE ts + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = as_stream(events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "stream-ticks")
    return to_table(stream.stream_bars(ticks, "H1", "10 minutes"), "stream-bars")


@query("WITH RECURSIVE " + bars_sql("H1") + ", " + indexed_sql() + ", " + ewm_sql("a", "n", "close", 2 / 51, 50) + f" SELECT symbol, ts, {q6('a.y', 'ema_50')} FROM n JOIN a USING (symbol, rn)")
def stream_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = twins.stream_ema(as_stream(bars(spark, sf_dir), "stream-ema-in"), 50)
    return rounded(to_table(made, "stream-ema"), ["symbol", "ts"], ["ema_50"])


@query(features.ORACLE_SQL["macd"])
def stream_macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = twins.stream_macd(as_stream(bars(spark, sf_dir), "stream-macd-in"))
    return rounded(to_table(made, "stream-macd"), ["symbol", "ts"], ["macd_line", "macd_signal", "macd_hist"])


@query(f"{features.B}, {features.RSI} SELECT symbol, ts, {q6('rsi', 'rsi_14')} FROM x")
def stream_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = twins.stream_rsi(as_stream(bars(spark, sf_dir), "stream-rsi-in"))
    return rounded(to_table(made, "stream-rsi"), ["symbol", "ts"], ["rsi_14"])


@query(features.ORACLE_SQL["atr_and_adx"])
def stream_atr_adx(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = twins.stream_atr_adx(as_stream(bars(spark, sf_dir), "stream-adx-in"))
    return rounded(to_table(made, "stream-adx"), ["symbol", "ts"], ["atr_14", "plus_di_14", "minus_di_14", "adx_14"])


@query(f"""{SIMULATED} SELECT symbol, ts, price, {q6('balance')}, {q6('equity')}, {q6('reward')}, n_positions, done FROM sm""")
def stream_simulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = twins.stream_simulator(as_stream(steps(spark, sf_dir), "stream-sim-in"))
    return to_table(made, "stream-sim").select("symbol", "ts", "price", *(r6(c).alias(c) for c in ("balance", "equity", "reward")), "n_positions", "done")
