"""Bars of the driver's tables, and the SQL that says the same.

Ticks are events: symbol is event_type, price is value, ties go by event_id. Daily bars are also made of orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.bars import resample_ticks

FRAMES = {"H1": "date_trunc('hour', ts)", "H4": "time_bucket(INTERVAL 4 HOUR, ts)", "D1": "date_trunc('day', ts)", "W1": "date_trunc('week', ts)", "M30": "time_bucket(INTERVAL 30 MINUTE, ts)", "M5": "time_bucket(INTERVAL 5 MINUTE, ts)", "M1": "date_trunc('minute', ts)"}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks: symbol, ts, price, seq."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("value").alias("price"), F.col("event_id").alias("seq"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order prices as ticks: symbol is the priority."""
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("seq"))


def bars(spark: SparkSession, sf_dir: str, tf: str = "H1") -> DataFrame:
    return resample_ticks(events(spark, sf_dir), tf)


def bars_sql(tf: str = "H1", name: str = "bars", ticks: str = "SELECT event_type AS symbol, ts, value AS price, event_id AS seq FROM events") -> str:
    """CTE of the bars of one timeframe."""
    return f"""{name} AS (
  SELECT symbol, '{tf}' AS tf, {FRAMES[tf]} AS ts, first(price ORDER BY ts, seq) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY ts, seq) AS close, count(*)::BIGINT AS tick_volume, 0::BIGINT AS spread
  FROM ({ticks}) WHERE price IS NOT NULL AND ts IS NOT NULL GROUP BY symbol, {FRAMES[tf]})"""


def indexed_sql(columns: str = "", source: str = "bars", name: str = "n") -> str:
    """CTE of bars with their row number and further columns (window w is the series)."""
    return f"{name} AS MATERIALIZED (SELECT *, row_number() OVER w AS rn{', ' + columns if columns else ''} FROM {source} WINDOW w AS (PARTITION BY symbol ORDER BY ts))"


def ewm_sql(name: str, source: str, x: str, alpha: float, least: int) -> str:
    """CTE name(symbol, rn, y) of the exponential mean of column x of source(symbol, rn, ...)."""
    return f"""{name}_r AS (
  SELECT symbol, rn, {x}::DOUBLE AS raw, 1.0::DOUBLE AS wt, ({x} IS NOT NULL)::INT AS seen FROM {source} WHERE rn = 1
  UNION ALL
  SELECT s.symbol, s.rn,
         CASE WHEN r.raw IS NULL THEN s.{x} WHEN s.{x} IS NULL THEN r.raw
              ELSE (r.wt * (1 - {alpha!r}) * r.raw + {alpha!r} * s.{x}) / (r.wt * (1 - {alpha!r}) + {alpha!r}) END,
         CASE WHEN r.raw IS NULL OR s.{x} IS NOT NULL THEN 1.0 ELSE r.wt * (1 - {alpha!r}) END,
         r.seen + (s.{x} IS NOT NULL)::INT
  FROM {name}_r r JOIN {source} s ON s.symbol = r.symbol AND s.rn = r.rn + 1),
{name} AS MATERIALIZED (SELECT symbol, rn, CASE WHEN seen >= {least} THEN raw END AS y FROM {name}_r)"""


def r6(x: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; minus zero becomes zero."""
    return F.round(F.col(f"`{x}`") if isinstance(x, str) else x, digits) + F.lit(0.0)


def rounded(df: DataFrame, keys: list[str], columns: list[str], digits: int = 6) -> DataFrame:
    """Keys and rounded columns."""
    kinds = dict(df.dtypes)
    return df.select(*keys, *(r6(c, digits).alias(c) if kinds[c] == "double" else F.col(f"`{c}`") for c in columns))


def q6(x: str, name: str | None = None, digits: int = 6) -> str:
    """SQL of r6."""
    return f'round(({x})::DOUBLE, {digits}) + 0.0::DOUBLE AS "{name or x}"'


TRUE_RANGE = "greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w))"


def roll_sql(agg: str, x: str, n: int) -> str:
    """SQL of an aggregate over the last n values, NULL unless all are there (window p: partition and order)."""
    frame = f"OVER (PARTITION BY symbol ORDER BY rn ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {n} THEN {agg}({x}) {frame} END"
