"""Block-parallel recurrences: one long series spread over tasks.

A series is cut into blocks of time. Each block is folded into a summary that says what its rows make of any state that it could begin
with; summaries are composed along the series, one row a block, which gives each block the state it does begin with; then all blocks
are walked at once. An exponential mean maps its state by an affine function, a band that only tightens by a clamp, a side that flips by
one of four functions of two states; each kind is closed under composition. A recurrence over another's results takes a round more.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DatetimeType, NumericType

from tickloom.functions.schema import KEYS
from tickloom.functions.windows import prev
from tickloom.plans.kernels import Ewm, EwmPlan, Step, SuperTrend, sides
from tickloom.plans.scan import Kernel, fold, scan

#: Columns of a blocked frame: the block, the timeframe as it was, and whether a row is the bar before the block.
BLOCK, TF, HALO = "__block", "__tf_of", "__halo"


def blocked(bars: DataFrame, block: Column) -> DataFrame:
    """Bars with each block as a series of its own: tf names the timeframe and the block, and the bar before a block stands in it as HALO.

    block must not fall as ts rises within a series. Windows of the series then partition by block, and reach one bar back.
    """
    named = bars.withColumns({TF: F.col("tf"), BLOCK: block})
    # one value a column, so that the aggregate hashes and does not sort; what is no number or time is null in a halo
    plain = [f.name for f in bars.schema if isinstance(f.dataType, (NumericType, DatetimeType, BooleanType)) and f.name != "ts"]
    last = named.groupBy("symbol", TF, BLOCK).agg(F.max("ts").alias("ts"), *(F.max_by(F.col(f"`{c}`"), "ts").alias(c) for c in plain))
    line = Window.partitionBy("symbol", TF).orderBy(BLOCK)
    before = last.select("symbol", TF, BLOCK, *(F.lag(F.col(f"`{c}`")).over(line).alias(c) for c in ("ts", *plain))).where("ts is not null")
    halo = before.select(*(F.col(f"`{f.name}`") if f.name in ("symbol", "ts", *plain) else F.lit(None).cast(f.dataType).alias(f.name) for f in bars.schema), TF, BLOCK, F.lit(True).alias(HALO))
    both = named.withColumn(HALO, F.lit(False)).unionByName(halo)
    return both.withColumn("tf", F.concat(F.coalesce(TF, F.lit("")), F.lit("\1"), F.coalesce(F.col(BLOCK).cast("string"), F.lit(""))))


def unblocked(df: DataFrame) -> DataFrame:
    """The bars of a blocked frame under their own timeframe."""
    return df.withColumn("tf", F.col(TF)).drop(TF, BLOCK, HALO)


def started(ready: DataFrame, summaries: DataFrame, reads: list[str], makes: str, compose: Callable[[], Kernel]) -> DataFrame:
    """ready with what each block begins with: compose walks a series' summaries, one row a block, and gives the state before each."""
    starts = scan(summaries, ["symbol", TF], [BLOCK], reads, makes, compose)
    made = [m.split()[0].strip("`") for m in makes.split(", ")]
    return ready.join(starts.select("symbol", "tf", *(F.col(f"`{c}`") for c in made)), KEYS)


# --- exponential means ------------------------------------------------------------------------------------------------


class EwmSummary:
    """What a block makes of an exponential mean: y becomes a y' + b, where y' has met the block's first value.

    fields: rows, rows before the first value, that value, a, b, rows after the last value, values.
    """

    fields = ("rows", "lead", "first", "a", "b", "trail", "n")

    def __init__(self, alpha: float) -> None:
        self.alpha, self.mean = alpha, Ewm(alpha, 1)
        self.rows = self.lead = self.n = 0
        self.first, self.a, self.last = np.nan, 1.0, -1

    def push(self, x: np.ndarray) -> None:
        known = np.flatnonzero(~np.isnan(x))
        if len(known):
            if self.n == 0:
                self.lead, self.first = self.rows + int(known[0]), float(x[known[0]])
                gaps = np.diff(known)
            else:
                gaps = np.diff(np.concatenate(([self.last - self.rows], known)))
            weight = (1 - self.alpha) ** gaps
            self.a *= float(np.prod(weight / (weight + self.alpha)))
            self.n, self.last = self.n + len(known), self.rows + int(known[-1])
        self.mean.push(x)
        self.rows += len(x)

    def result(self) -> list[float]:
        b = self.mean.y - self.a * self.first
        return [float(self.rows), float(self.lead if self.n else self.rows), self.first, self.a, b, float(self.rows - 1 - self.last), float(self.n)]


def after(alpha: float, state: tuple[float, float, float], s: dict[str, float]) -> tuple[float, float, float]:
    """State (mean, weight, values seen) of an exponential mean after a block with summary s."""
    y, weight, seen = state
    if not s["n"]:
        return y, 1.0 if np.isnan(y) else weight * (1 - alpha) ** s["rows"], seen
    weight = weight * (1 - alpha) ** (s["lead"] + 1)
    met = s["first"] if np.isnan(y) else (weight * y + alpha * s["first"]) / (weight + alpha)
    return s["a"] * met + s["b"], (1 - alpha) ** s["trail"], seen + s["n"]


def levels(steps: tuple[Step, ...]) -> dict[str, int]:
    """Round in which each exponential mean can be folded: 1 over inputs, else after all means that stand before it."""
    out: dict[str, int] = {}
    made: set[str] = set()
    for s in steps:
        if s.apply is None:
            out[s.out] = 1 + (max(out.values(), default=0) if s.of in made else 0)
        made.add(s.out)
    return out


class SeededPlan(EwmPlan):
    """EwmPlan whose means begin with the states that the block's first row holds; means of no state yet are left out (NaN)."""

    def __init__(self, steps: tuple[Step, ...], seeded: set[str]) -> None:
        super().__init__(steps)
        self.seeded, self.begun = seeded, False

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        if not self.begun and len(next(iter(columns.values()))):
            for name in self.seeded:
                mean = self.means[name]
                y, mean.weight, seen = (float(columns[f"__{part}_{name}"][0]) for part in ("y", "w", "seen"))
                mean.y, mean.seen = y, int(seen)
            self.begun = True
        return super().push(columns)


class FoldPlan(SeededPlan):
    """Summaries of the means of one round, over the means of the rounds before."""

    def __init__(self, steps: tuple[Step, ...], seeded: set[str], folded: list[Step]) -> None:
        super().__init__(steps, seeded)
        self.folded = {s.out: (s.of, EwmSummary(s.alpha)) for s in folded}

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        made = super().push(columns)
        for of, summary in self.folded.values():
            summary.push(np.asarray(made[of], dtype=float))
        return made

    def result(self) -> dict[str, float]:
        return {f"{f}_{out}": v for out, (_, s) in self.folded.items() for f, v in zip(s.fields, s.result(), strict=True)}


class ComposeMeans(Kernel):
    """States of means before each block of a series, from the blocks' summaries."""

    def __init__(self, folded: list[Step]) -> None:
        self.folded, self.state = folded, {s.out: (np.nan, 1.0, 0.0) for s in folded}

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n = len(next(iter(columns.values())))
        out = {f"__{part}_{s.out}": np.empty(n) for s in self.folded for part in ("y", "w", "seen")}
        for k in range(n):
            for s in self.folded:
                for part, value in zip(("y", "w", "seen"), self.state[s.out], strict=True):
                    out[f"__{part}_{s.out}"][k] = value
                self.state[s.out] = after(s.alpha, self.state[s.out], {f: float(columns[f"{f}_{s.out}"][k]) for f in EwmSummary.fields})
        return out


def ewm_blocks(ready: DataFrame, reads: list[str], steps: tuple[Step, ...], outputs: list[str]) -> DataFrame:
    """outputs of steps over a blocked frame whose inputs (reads) are made; halo rows must be gone."""
    order, seeded = levels(steps), set()
    for round_ in range(1, max(order.values(), default=0) + 1):
        folded = [s for s in steps if order.get(s.out) == round_]
        have = frozenset(seeded)
        states = [f"__{part}_{n}" for n in sorted(have) for part in ("y", "w", "seen")]
        fields = [f"{f}_{s.out}" for s in folded for f in EwmSummary.fields]
        summaries = fold(ready, [*KEYS, TF, BLOCK], ["ts"], [*reads, *states], ", ".join(f"`{f}` double" for f in fields), lambda have=have, folded=folded: FoldPlan(steps, set(have), folded), KEYS)
        makes = ", ".join(f"`__{part}_{s.out}` double" for s in folded for part in ("y", "w", "seen"))
        ready = started(ready, summaries, fields, makes, lambda folded=folded: ComposeMeans(folded))
        seeded |= {s.out for s in folded}
    states = [f"__{part}_{n}" for n in sorted(seeded) for part in ("y", "w", "seen")]
    return scan(ready, KEYS, ["ts"], [*reads, *states], ", ".join(f"`{o}` double" for o in outputs), lambda: SeededPlan(steps, seeded)).drop(*states)


# --- bands and sides --------------------------------------------------------------------------------------------------


class ClampSummary:
    """What a block makes of a band: steps (p, u) leave a value between p and u as it is and make u of any other.

    Values that have left the identity are few at a time and ordered: each step lets go of those above u and below p, which become u.
    The values at which a block could begin fall into an interval that the block leaves as it is and shells around it, of one
    result each. Results are classes that merge (a forest), so a step costs what it lets go of.
    """

    def __init__(self) -> None:
        self.low, self.high, self.whole = -np.inf, np.inf, True
        # shells below by rising upper end (which they hold), shells above by falling lower end (which they do not hold), with their classes
        self.below: list[tuple[float, int]] = []
        self.above: list[tuple[float, int]] = []
        self.parent: list[int] = []
        self.value: list[float] = []
        self.alive: deque[int] = deque()

    def push(self, p: np.ndarray, u: np.ndarray) -> None:
        for lo, hi in zip(p.tolist(), u.tolist(), strict=True):
            self.step(lo, hi)

    def step(self, p: float, u: float) -> None:
        fixed = not p <= u  # the same for any value, NaN among them
        new = len(self.value)
        # the first class is also that of no state, of which any step makes u
        gone = []
        while self.alive and (fixed or not self.value[self.alive[-1]] < u):
            gone.append(self.alive.pop())
        while self.alive and self.value[self.alive[0]] < p:
            gone.append(self.alive.popleft())
        shells = []
        if self.whole:
            if fixed or p > self.high or u < self.low:
                self.whole = False
                shells = [(self.below, self.high)]
            else:
                shells = [(self.below, float(np.nextafter(p, -np.inf)))] * (p > self.low) + [(self.above, u)] * (u < self.high)
                self.low, self.high = max(self.low, p), min(self.high, u)
        if gone or shells or new == 0:
            self.value.append(u)
            self.parent.append(new)
            for k in gone:
                self.parent[k] = new
            for side, end in shells:
                side.append((end, new))
            self.alive.append(new)

    def _value(self, k: int) -> float:
        while self.parent[k] != k:
            self.parent[k] = self.parent[self.parent[k]]
            k = self.parent[k]
        return self.value[k]

    def result(self) -> list[list[float]]:
        """Ends of the shells in rising order (each holds its end), their values, the value made of no state, and the place of the interval left as it is (-1: none)."""
        above = [(end, self._value(k)) for end, k in reversed(self.above)]
        shells = [(end, self._value(k)) for end, k in self.below]
        inner = len(shells) if self.whole else -1
        shells += [(self.high, np.nan)] if self.whole else []
        shells += [(end, v) for (_, v), end in zip(above, [*(e for e, _ in above), np.inf][1:], strict=True)]
        kept: list[tuple[float, float]] = []
        place = -1.0
        for k, (end, v) in enumerate(shells):
            if kept and k != inner and len(kept) - 1 != place and kept[-1][1] == v:
                kept.pop()
            kept.append((end, v))
            if k == inner:
                place = float(len(kept) - 1)
        return [[e for e, _ in kept], [v for _, v in kept], [self._value(0) if self.value else np.nan], [place]]


def clamped(x: float, shells: list[list[float]]) -> float:
    """What a block with these shells makes of x."""
    ends, values, (fresh,), (inner,) = shells
    if np.isnan(x):
        return fresh
    k = int(np.searchsorted(np.asarray(ends, dtype=float), x))
    return x if k == inner or k >= len(ends) else values[k]


class FoldBands(Kernel):
    """Summaries of both bands of a block; the lower one is worked with its sign turned."""

    def __init__(self) -> None:
        self.upper, self.lower = ClampSummary(), ClampSummary()

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        self.upper.push(columns["__before"], columns["upper"])
        self.lower.push(-columns["__before"], -columns["lower"])
        return {}

    def result(self) -> dict[str, list[list[float]]]:
        return {"upper_map": self.upper.result(), "lower_map": self.lower.result()}


class ComposeBands(Kernel):
    """Bands before each block."""

    def __init__(self) -> None:
        self.upper = self.lower = np.nan

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = {"__upper_0": [], "__lower_0": []}
        for up, low in zip(columns["upper_map"], columns["lower_map"], strict=True):
            out["__upper_0"].append(self.upper)
            out["__lower_0"].append(-self.lower)
            self.upper, self.lower = clamped(self.upper, up), clamped(self.lower, low)
        return {k: np.array(v) for k, v in out.items()}


class SeededTrend(SuperTrend):
    """SuperTrend that begins with the state that the block's first row holds, or, as a fold, with either side."""

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        if len(columns["close"]) and not self.seeded:
            self.seeded, before = True, float(columns["__before_0"][0])
            self.begun = bool(columns["__later"][0])
            self.close, self.upper.value, self.lower.value = before, float(columns["__upper_0"][0]), -float(columns["__lower_0"][0])
            self.side = bool(columns["__side_0"][0] > 0) if "__side_0" in columns else False
        return super().push(columns)

    seeded = False


class FoldSide(SeededTrend):
    """What a block makes of either side: the sides at its end."""

    def __init__(self) -> None:
        super().__init__()
        self.ends = [False, True]

    def walk(self, falls: np.ndarray, rises: np.ndarray) -> np.ndarray:
        out = [sides(falls, rises, s) for s in self.ends]
        self.ends = [bool(s[-1]) if len(s) else e for s, e in zip(out, self.ends, strict=True)]
        return out[0]

    def result(self) -> dict[str, float]:
        return {"from_down": float(self.ends[0]), "from_up": float(self.ends[1])}


class ComposeSide(Kernel):
    """Side before each block, 1 for up."""

    def __init__(self) -> None:
        self.side = 0.0

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        out = []
        for down, up in zip(columns["from_down"].tolist(), columns["from_up"].tolist(), strict=True):
            out.append(self.side)
            self.side = up if self.side else down
        return {"__side_0": np.array(out)}


def before_block() -> dict[str, Column]:
    """What supertrend_blocks() needs of the halo: each bar's close before, and whether bars stand before the block."""
    return {"__before": prev("close"), "__later": F.max(HALO).over(Window.partitionBy(*KEYS))}


def supertrend_blocks(ready: DataFrame) -> DataFrame:
    """supertrend and supertrend_dir of a blocked frame with close, upper, lower and the columns of before_block(); halo rows must be gone."""
    first = F.first("__before").over(Window.partitionBy(*KEYS).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    ready = ready.withColumn("__before_0", first)
    keys = [*KEYS, TF, BLOCK]
    bands = fold(ready, keys, ["ts"], ["__before", "upper", "lower"], "upper_map array<array<double>>, lower_map array<array<double>>", FoldBands, KEYS)
    ready = started(ready, bands, ["upper_map", "lower_map"], "__upper_0 double, __lower_0 double", ComposeBands)
    reads = ["close", "upper", "lower", "__before_0", "__later", "__upper_0", "__lower_0"]
    side = fold(ready, keys, ["ts"], reads, "from_down double, from_up double", FoldSide, KEYS)
    ready = started(ready, side, ["from_down", "from_up"], "__side_0 double", ComposeSide)
    made = scan(ready, KEYS, ["ts"], [*reads, "__side_0"], "supertrend double, supertrend_dir double", SeededTrend)
    return made.drop("__before", "__before_0", "__later", "__upper_0", "__lower_0", "__side_0")

