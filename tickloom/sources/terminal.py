"""Bars of a live terminal as a Spark data source, for batches and streams.

    register(spark)
    spark.read.format("terminal").option("fetch", "my.module:bars").option("symbols", "EURUSD,XAUUSD").option("timeframes", "H1,D1").load()

Each pair of a symbol and a timeframe is a partition. Conditions on symbol, tf and ts reach the terminal: pairs are left out, and times become
the range that is asked for. A stream keeps the time of the last bar of each pair as its offset, so that a restart neither loses nor
repeats a bar.
"""

from __future__ import annotations

import datetime
import importlib
import importlib.util
import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tickloom.functions.schema import BAR_COLUMNS, BARS, interval_of

#: Tries after the first one, and seconds by which the pause before each grows.
RETRIES, BACKOFF = 2, 2.0
EARLIEST, LATEST = datetime.datetime.min, datetime.datetime.max


def loaded(place: str) -> Callable:
    """The function at module:function, or in a file at path.py:function."""
    module, _, name = place.rpartition(":")
    if not module.endswith(".py"):
        return getattr(importlib.import_module(module), name)
    spec = importlib.util.spec_from_file_location("terminal_functions", module)
    found = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(found)
    return getattr(found, name)


@dataclass
class Span(InputPartition):
    """Bars of a pair from one time to another, the ends included unless they are open."""

    symbol: str
    tf: str
    first: datetime.datetime = EARLIEST
    last: datetime.datetime = LATEST
    open_first: bool = False
    open_last: bool = False


@dataclass(frozen=True)
class Settings:
    """Options of the source."""

    fetch: str
    pairs: tuple[tuple[str, str], ...]
    latest: str | None
    retries: int
    backoff: float

    @staticmethod
    def of(options: dict[str, str]) -> Settings:
        missing = [n for n in ("fetch", "symbols", "timeframes") if not options.get(n)]
        if missing:
            raise ValueError(f"the terminal needs the options {', '.join(missing)}")
        names = lambda key: [x.strip() for x in options.get(key, "").split(",") if x.strip()]
        for tf in names("timeframes"):
            interval_of(tf)
        pairs = tuple((s, t) for s in names("symbols") if s not in names("skip_symbols") for t in names("timeframes"))
        return Settings(options["fetch"], pairs, options.get("latest"), int(options.get("retries", RETRIES)), float(options.get("backoff", BACKOFF)))


def asked(settings: Settings, call: Callable, *arguments):
    """What the terminal answers, asked again after growing pauses where it fails; the last failure is the task's."""
    for attempt in range(settings.retries + 1):
        try:
            return call(*arguments)
        except Exception:
            if attempt == settings.retries:
                raise
            time.sleep(settings.backoff * (attempt + 1))


def bars_of(settings: Settings, span: Span, schema: StructType) -> Iterator[pa.RecordBatch]:
    """The terminal's bars of a span in the canonical schema, each time once; what it answers beyond the span is left out."""
    got = asked(settings, loaded(settings.fetch), span.symbol, span.tf, None if span.first == EARLIEST else span.first, None if span.last == LATEST else span.last)
    if got is None or not len(got):
        return
    frame = got.rename(columns={"time": "ts"}).assign(symbol=span.symbol, tf=span.tf)
    frame = frame.assign(ts=pd.to_datetime(frame["ts"])).drop_duplicates("ts", keep="last").sort_values("ts")
    ts = frame["ts"]
    inside = pd.Series(True, index=frame.index)
    if span.first != EARLIEST:
        inside &= (ts > span.first) if span.open_first else (ts >= span.first)
    if span.last != LATEST:
        inside &= (ts < span.last) if span.open_last else (ts <= span.last)
    frame = frame[inside].reindex(columns=BAR_COLUMNS)
    table = pa.Table.from_pandas(frame, schema=to_arrow_schema(schema), preserve_index=False)
    yield from table.to_batches(max_chunksize=10_000)


class TerminalReader(DataSourceReader):
    """A batch: one partition a pair. Filters on symbol, tf and ts are taken over; all others stay with Spark."""

    def __init__(self, settings: Settings, schema: StructType) -> None:
        self.settings, self.schema, self.pairs = settings, schema, list(settings.pairs)
        self.first, self.last, self.open_first, self.open_last = EARLIEST, LATEST, False, False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if not self._took(f):
                yield f

    def _took(self, f: Filter) -> bool:
        place = {"symbol": 0, "tf": 1}.get(getattr(f, "attribute", ("",))[0])
        if place is not None and isinstance(f, (EqualTo, In)):
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.pairs = [p for p in self.pairs if p[place] in wanted]
            return True
        if getattr(f, "attribute", None) != ("ts",) or not isinstance(getattr(f, "value", None), datetime.datetime):
            return False
        at = f.value.replace(tzinfo=None)
        if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
            self.first, self.open_first = max((self.first, self.open_first), (at, isinstance(f, GreaterThan)))
        if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
            self.last, self.open_last = min((self.last, not self.open_last), (at, not isinstance(f, LessThan)))
            self.open_last = not self.open_last
        return isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, EqualTo))

    def partitions(self) -> list[Span]:
        return [Span(s, t, self.first, self.last, self.open_first, self.open_last) for s, t in self.pairs] or [Span("", "", LATEST, EARLIEST)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if partition.symbol:
            yield from bars_of(self.settings, partition, self.schema)


class TerminalStream(DataSourceStreamReader):
    """A stream: the offset holds the time of the last bar of each pair that has any, as the function at option latest tells it."""

    def __init__(self, settings: Settings, schema: StructType) -> None:
        if not settings.latest:
            raise ValueError("a stream of the terminal needs the option latest")
        self.settings, self.schema = settings, schema

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        last, out = loaded(self.settings.latest), {}
        for symbol, tf in self.settings.pairs:
            at = asked(self.settings, last, symbol, tf)
            if at is not None:
                out[f"{symbol}|{tf}"] = pd.Timestamp(at).to_pydatetime().isoformat()
        return out

    def partitions(self, start: dict, end: dict) -> list[Span]:
        time_of = datetime.datetime.fromisoformat
        spans = []
        for pair, upto in sorted(end.items()):
            symbol, _, tf = pair.rpartition("|")
            after = start.get(pair)
            if after is None or time_of(after) < time_of(upto):
                spans.append(Span(symbol, tf, EARLIEST if after is None else time_of(after), time_of(upto), open_first=True))
        return spans

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        yield from bars_of(self.settings, partition, self.schema)


class Terminal(DataSource):
    """Options: fetch (module:function or path.py:function, called with symbol, tf, first and last time or None, giving a frame of bars),
    latest (such a function of symbol and tf, for streams), symbols, timeframes, skip_symbols, retries, backoff."""

    @classmethod
    def name(cls) -> str:
        return "terminal"

    def schema(self) -> str | StructType:
        return BARS

    def reader(self, schema: StructType) -> TerminalReader:
        return TerminalReader(Settings.of(self.options), schema)

    def streamReader(self, schema: StructType) -> TerminalStream:
        return TerminalStream(Settings.of(self.options), schema)


def register(spark: SparkSession) -> None:
    """Make format("terminal") known to the session, with filters handed on to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Terminal)
