"""Kernels of the sequential scans; each keeps the little state that its recurrence needs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd

from tickloom.plans.scan import Kernel


class Ewm:
    """Exponentially weighted mean without adjustment: y = (1 - a) y + a x from the first value on.

    Values count towards `least` when not missing; a missing value carries y and lets the old weight decay.
    """

    def __init__(self, alpha: float, least: int) -> None:
        self.alpha, self.least, self.y, self.weight, self.seen = alpha, least, np.nan, 1.0, 0

    def push(self, x: np.ndarray) -> np.ndarray:
        out, known = np.full(len(x), np.nan), ~np.isnan(x)
        count = self.seen + np.cumsum(known)
        first = 0
        if np.isnan(self.y):
            if not known.any():
                return out
            first = int(np.argmax(known))
        tail = x[first:]
        if known[first:].all() and self.weight == 1.0:
            head = [] if np.isnan(self.y) else [self.y]
            y = pd.Series(np.concatenate((head, tail))).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()[len(head) :]
            if len(y):
                self.y = float(y[-1])
        else:
            y = np.empty(len(tail))
            for k, value in enumerate(tail):
                if np.isnan(self.y):
                    self.y = value
                else:
                    self.weight *= 1 - self.alpha
                    if not np.isnan(value):
                        self.y = (self.weight * self.y + self.alpha * value) / (self.weight + self.alpha)
                        self.weight = 1.0
                y[k] = self.y
        out[first:] = y
        self.seen = int(count[-1]) if len(count) else self.seen
        return np.where(count >= self.least, out, np.nan)


@dataclass(frozen=True)
class Step:
    """One made column: an exponential mean of a column (alpha, least), or a function of columns made before."""

    out: str
    alpha: float = 0.0
    least: int = 1
    of: str = ""
    apply: Callable[[dict[str, np.ndarray]], np.ndarray] | None = None


class EwmPlan(Kernel):
    """Several exponential means and what follows from them, in one walk."""

    def __init__(self, steps: tuple[Step, ...]) -> None:
        self.steps, self.means = steps, {s.out: Ewm(s.alpha, s.least) for s in steps if s.apply is None}

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        made = dict(columns)
        with np.errstate(all="ignore"):
            for s in self.steps:
                made[s.out] = self.means[s.out].push(made[s.of]) if s.apply is None else s.apply(made)
        return made


class BarMoves(EwmPlan):
    """Exponential means of what a bar and the one before give: each column c as __c, its rises and falls as __up_c and __down_c,
    and of bars with high, low and close the true range __tr and the directional moves __plus and __minus.

    Batches take these from windows, which streams have not; the last bar is kept in their place.
    """

    def __init__(self, steps: tuple[Step, ...]) -> None:
        super().__init__(steps)
        self.bar: dict[str, float] = {}

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        before = {c: np.concatenate(([self.bar.get(c, np.nan)], v))[:-1] for c, v in columns.items()}
        self.bar |= {c: float(v[-1]) for c, v in columns.items() if len(v)}
        made = dict(columns)
        for c, v in columns.items():
            change = v - before[c]
            made |= {f"__{c}": v, f"__up_{c}": np.maximum(change, 0.0), f"__down_{c}": np.maximum(-change, 0.0)}
        if {"high", "low", "close"} <= columns.keys():
            high, low, close = columns["high"], columns["low"], before["close"]
            up, down = high - before["high"], before["low"] - low
            made["__tr"] = np.fmax(high - low, np.fmax(np.abs(high - close), np.abs(low - close)))
            made["__plus"], made["__minus"] = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
        return super().push(made)


class Clamp:
    """A value that a step (p, u) leaves as it is between p and u, and makes u otherwise. NaN limits, and no value yet (NaN), give u."""

    def __init__(self) -> None:
        self.value = np.nan

    def push(self, p: np.ndarray, u: np.ndarray) -> np.ndarray:
        out, x = [], self.value
        for lo, hi in zip(p.tolist(), u.tolist(), strict=True):
            if not lo <= x <= hi:
                x = hi
            out.append(x)
        self.value = x
        return np.array(out)


def sides(falls: np.ndarray, rises: np.ndarray, side: bool) -> np.ndarray:
    """Side after each row, true for up: a row ends a rise where falls, and begins one where rises.

    Where the side before makes no difference it is forgotten; between such rows only the number of turns counts.
    """
    if not len(rises):
        return np.empty(0, dtype=bool)
    at = np.maximum.accumulate(np.where(rises != falls, np.arange(len(rises)), -1))
    turns = np.concatenate(([0], np.cumsum(rises & falls)))
    base = np.where(at >= 0, rises[at], side)
    return base ^ ((turns[1:] - turns[at + 1]) % 2 == 1)


class SuperTrend(Kernel):
    """Bands that only tighten while the close before is inside them, and the side that the close has broken out to.

    The line is the lower band on the way up and the upper one on the way down. While the bands are not known the side is decided by
    the upper one alone. A series' first bar has no side. After a bar without a close the bands begin anew.
    """

    def __init__(self) -> None:
        self.upper, self.lower = Clamp(), Clamp()
        self.close, self.side, self.begun = np.nan, False, False

    def walk(self, falls: np.ndarray, rises: np.ndarray) -> np.ndarray:
        """Sides of all rows."""
        out = sides(falls, rises, self.side)
        self.side = bool(out[-1]) if len(out) else self.side
        return out

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        close = np.asarray(columns["close"], dtype=float)
        if not len(close):
            return {"supertrend": close, "supertrend_dir": close}
        before, lower_before = np.concatenate(([self.close], close[:-1])), -self.lower.value
        upper = self.upper.push(before, columns["upper"])
        lower = -self.lower.push(-before, -columns["lower"])
        rises = close > upper
        known = ~np.isnan(np.concatenate(([lower_before], lower[:-1])))
        falls = np.where(known, close < lower, ~rises)
        if not self.begun:  # the first bar decides nothing
            rises[0], falls[0] = False, False
        up = self.walk(falls, rises)
        line, side = np.where(up, lower, upper), np.where(up, 1.0, -1.0)
        if not self.begun:
            line[0] = side[0] = np.nan
        self.close, self.begun = float(close[-1]), True
        return {"supertrend": line, "supertrend_dir": side}


class Spacing(Kernel):
    """Keep a signal only if more than `least` bars lie between it and the last one kept."""

    def __init__(self, least: int) -> None:
        self.least, self.at, self.kept = least, 0, None

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        signal = columns["signal"]
        out = np.zeros(len(signal))
        for k in np.flatnonzero(np.nan_to_num(signal)):
            place = self.at + int(k)
            if self.kept is None or place - self.kept > self.least:
                self.kept, out[k] = place, signal[k]
        self.at += len(signal)
        return {"spaced": out}


class RunningMeanClusters(Kernel):
    """Number of the cluster of each price of an ascending sweep: a price joins while it is within tolerance of the cluster's mean."""

    def __init__(self, relative: float | None, absolute: float | None) -> None:
        self.relative, self.absolute, self.total, self.n, self.cluster = relative, absolute, 0.0, 0, 0

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = np.zeros(len(columns["price"]))
        for k, price in enumerate(columns["price"].tolist()):
            mean = self.total / self.n if self.n else 0.0
            within = max(abs(mean), abs(price)) * self.relative if self.relative is not None else (self.absolute or 0.0)
            if self.n and abs(mean - price) <= within:
                self.total, self.n = self.total + price, self.n + 1
            else:
                self.total, self.n, self.cluster = price, 1, self.cluster + (1 if self.n else 0)
            out[k] = self.cluster
        return {"cluster": out}


def _touch(low_a: float, high_a: float, low_b: float, high_b: float, gap: float) -> bool:
    """Whether two bands overlap, or lie apart by no more than gap times the middle of the first."""
    return max(low_a, low_b) - min(high_a, high_b) <= abs(high_a + low_a) / 2.0 * gap


class FirstFitZones(Kernel):
    """Zone of each band of an ascending sweep: the first made zone that it touches, which grows to hold it, else a new one.

    A zone that the current band is too far above is out of reach of all later ones and is let go.
    """

    def __init__(self, gap: float) -> None:
        self.gap, self.made, self.zones = gap, 0, []

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        lows, highs = columns["__low"].tolist(), columns["__high"].tolist()
        out = np.zeros(len(lows))
        for k, (low, high) in enumerate(zip(lows, highs, strict=True)):
            self.zones = [z for z in self.zones if _touch(low, high, z[1], z[2], self.gap)]
            if self.zones:
                zone = self.zones[0]
                zone[1], zone[2] = min(zone[1], low), max(zone[2], high)
            else:
                zone = [self.made, low, high]
                self.zones.append(zone)
                self.made += 1
            out[k] = zone[0]
        return {"__zone": out}


class MergedZones(Kernel):
    """Number of the merged zone of each zone in order of its lower end: a zone joins the last one while they touch."""

    def __init__(self, gap: float) -> None:
        self.gap, self.number, self.low, self.high = gap, -1, 0.0, 0.0

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        lows, highs = columns["__zlow"].tolist(), columns["__zhigh"].tolist()
        out = np.zeros(len(lows))
        for k, (low, high) in enumerate(zip(lows, highs, strict=True)):
            if self.number >= 0 and _touch(self.low, self.high, low, high, self.gap):
                self.low, self.high = min(self.low, low), max(self.high, high)
            else:
                self.number, self.low, self.high = self.number + 1, low, high
            out[k] = self.number
        return {"__merged": out}


class Valleys(Kernel):
    """For each value x the least value since the last one that is larger, and the largest since the last one that is smaller,
    itself included. Two stacks, of falling and of rising values, hold what later values can still reach back to."""

    def __init__(self) -> None:
        self.falling: list[tuple[float, float]] = []
        self.rising: list[tuple[float, float]] = []

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        low, high = np.zeros(len(columns["price"])), np.zeros(len(columns["price"]))
        for k, x in enumerate(columns["price"].tolist()):
            least = most = x
            while self.falling and self.falling[-1][0] <= x:
                least = min(least, self.falling.pop()[1])
            while self.rising and self.rising[-1][0] >= x:
                most = max(most, self.rising.pop()[1])
            self.falling.append((x, least))
            self.rising.append((x, most))
            low[k], high[k] = least, most
        return {"low_since": low, "high_since": high}
