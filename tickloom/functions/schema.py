"""Canonical schemas and the adapters that bring input to them.

Bars are one long table keyed by (symbol, tf) and ordered by ts. Missing numbers are NULL, never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["symbol", "tf"]
BARS = "symbol string, tf string, ts timestamp_ntz, open double, high double, low double, close double, tick_volume bigint, spread bigint"
BAR_COLUMNS = ["symbol", "tf", "ts", "open", "high", "low", "close", "tick_volume", "spread"]
NEWS = "ts timestamp_ntz, currency string, impact string, event string"
#: Timeframes that the market source knows, and their lengths; H1 is the analytics default beside them.
SOURCE_TIMEFRAMES = {"M1": "1 minute", "M5": "5 minutes", "M30": "30 minutes", "H4": "4 hours", "D1": "1 day", "W1": "7 days"}
TIMEFRAMES = {**SOURCE_TIMEFRAMES, "M15": "15 minutes", "H1": "1 hour"}
#: Names under which input may bring a canonical column. Fixed values of the input formats.
ALIASES = {
    "o": "open",
    "h": "high",
    "l": "low",
    "c": "close",
    "time": "ts",
    "timestamp": "ts",
    "volume": "tick_volume",
    "tickvolume": "tick_volume",
    "volume_traded": "tick_volume",
    "timeframe": "tf",
}


def interval_of(tf: str, source_only: bool = False) -> str:
    """Length of a timeframe; an unknown name raises ValueError."""
    known = SOURCE_TIMEFRAMES if source_only else TIMEFRAMES
    if tf not in known:
        raise ValueError(f"unknown timeframe {tf!r}; known: {', '.join(known)}")
    return known[tf]


def not_nan(x: Column) -> Column:
    """NULL in place of NaN."""
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def require_columns(df: DataFrame, *names: str) -> None:
    """Raise ValueError unless df has all the columns."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def normalize_bars(df: DataFrame, symbol: str | None = None, tf: str | None = None) -> DataFrame:
    """Bars in the canonical schema: names matched without case and by alias, types cast, NaN to NULL.

    Epoch seconds in ts become timestamps. symbol and tf fill those columns where the input has none. Without a volume or
    spread column these are NULL. Missing price columns raise ValueError.
    """
    names = {}
    for column in df.columns:
        low = column.strip().lower()
        names.setdefault(ALIASES.get(low, low), column)
    lost = [c for c in ("ts", "open", "high", "low", "close") if c not in names]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    kinds = dict(df.dtypes)

    def price(name: str) -> Column:
        return not_nan(F.col(f"`{names[name]}`").cast("double")).alias(name)

    def key(name: str, value: str | None) -> Column:
        return (F.col(f"`{names[name]}`").cast("string") if name in names else F.lit(value).cast("string")).alias(name)

    when = F.col(f"`{names['ts']}`")
    when = F.timestamp_seconds(when) if kinds[names["ts"]] in ("int", "bigint", "double", "float") else when
    return df.select(
        key("symbol", symbol),
        key("tf", tf),
        when.cast("timestamp_ntz").alias("ts"),
        *map(price, ("open", "high", "low", "close")),
        *((F.col(f"`{names[c]}`").cast("bigint") if c in names else F.lit(None).cast("bigint")).alias(c) for c in ("tick_volume", "spread")),
    )


def duplicate_bars(bars: DataFrame) -> DataFrame:
    """Bars that break the rule of one row for each (symbol, tf, ts), with a null ts among them: keys and their number."""
    return bars.groupBy(*KEYS, "ts").agg(F.count("*").alias("n")).where("n > 1 or ts is null")
