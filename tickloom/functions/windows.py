"""Window primitives over bar series; all frames are in rows and ordered by ts within (symbol, tf)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.functions.schema import KEYS


def series() -> WindowSpec:
    """A series in order of time. Windows need a session, so they are made where they are used."""
    return Window.partitionBy(*KEYS).orderBy("ts")


def rows(first: int, last: int) -> WindowSpec:
    """Frame from first to last rows from the current one."""
    return series().rowsBetween(first, last)


def trailing(n: int) -> WindowSpec:
    """The last n rows, the current one included."""
    return rows(-(n - 1), 0)


def upto() -> WindowSpec:
    """Frame from the first row to the current one."""
    return rows(Window.unboundedPreceding, 0)


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def prev(x: Column | str, n: int = 1) -> Column:
    return F.lag(col(x), n).over(series())


def diff(x: Column | str) -> Column:
    return col(x) - prev(x)


def roll(x: Column | str, n: int, agg: Callable[[Column], Column], least: int | None = None) -> Column:
    """agg over the last n rows where at least `least` of them (all n by default) are not null, else NULL."""
    x, frame = col(x), trailing(n)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), agg(x).over(frame))


def sma(x: Column | str, n: int, least: int | None = None) -> Column:
    return roll(x, n, F.avg, least)


def running_sum(x: Column | str) -> Column:
    return F.sum(col(x)).over(upto())


def last_known(x: Column | str) -> Column:
    """Forward fill: the last value that is not null."""
    return F.last(col(x), ignorenulls=True).over(upto())


def bar_idx() -> Column:
    """Position of a bar in its series, from 0."""
    return (F.row_number().over(series()) - 1).cast("long")


def true_range() -> Column:
    """Largest of high - low and the distances of high and low to the close before; nulls are skipped."""
    before = prev("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def centred_extreme(x: Column | str, k: int, agg: Callable[[Column], Column]) -> Column:
    """Whether x equals agg (max or min) over k rows to both sides, ties included; false within k rows of either end."""
    x, frame = col(x), rows(-k, k)
    inside = F.count(F.lit(1)).over(frame) == 2 * k + 1
    return F.coalesce(inside & (x == agg(x).over(frame)), F.lit(False))


def strict_extreme(x: Column | str, order: int, low: bool) -> Column:
    """Whether x is strictly below (above) all of the order rows on each side that exist; a null among them, or an end point, gives false."""
    x, before, after = col(x), rows(-order, -1), rows(1, order)
    full = (F.count(x).over(before) == F.count(F.lit(1)).over(before)) & (F.count(x).over(after) == F.count(F.lit(1)).over(after))
    if low:
        beyond = (x < F.min(x).over(before)) & (x < F.min(x).over(after))
    else:
        beyond = (x > F.max(x).over(before)) & (x > F.max(x).over(after))
    return F.coalesce(full & beyond, F.lit(False))


def islands(partition: list[str], order: list[Column | str], breaks: Column) -> Column:
    """Number of the run that a row is in, from 1: rows begin a new run where breaks is true (null counts as a break)."""
    w = Window.partitionBy(*partition).orderBy(*order)
    return F.sum(F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
