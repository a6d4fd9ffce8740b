"""Streaming twins of the batch operators whose results depend on all bars before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.schema import KEYS
from tickloom.operators.simulator import ACTION_COLUMNS, STATE, Episode, SimulatorConfig
from tickloom.operators.indicators import EwmSpec
from tickloom.plans.kernels import BarMoves, EwmPlan, Spacing, Step, SuperTrend
from tickloom.plans.pipeline import FUSED
from tickloom.streaming.bars import stream_scan


def stream_ema(bars: DataFrame, period: int = 50, price_col: str = "close") -> DataFrame:
    """ema_{period} of a stream of bars."""
    name = f"ema_{period}"
    plan = (Step(name, 2.0 / (period + 1.0), period, price_col),)
    return stream_scan(bars, KEYS, "ts", [price_col], f"`{name}` double", lambda: EwmPlan(plan))


def stream_indicators(bars: DataFrame, specs: list[EwmSpec], reads: list[str]) -> DataFrame:
    """Columns of exponential indicators (plans.pipeline.FUSED) of a stream of bars, all in one walk over the columns `reads`."""
    steps = tuple({s.out: s for spec in specs for s in spec.steps}.values())
    outputs = dict.fromkeys(o for spec in specs for o in spec.outputs)
    return stream_scan(bars, KEYS, "ts", reads, ", ".join(f"`{o}` double" for o in outputs), lambda: BarMoves(steps))


def stream_rma(bars: DataFrame, period: int = 14, price_col: str = "close") -> DataFrame:
    """rma_{period}, the Wilder mean, of a stream of bars."""
    name = f"rma_{period}"
    return stream_indicators(bars, [EwmSpec(steps=[Step(name, 1.0 / period, period, price_col)], outputs=[name])], [price_col])


def stream_macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """macd_line, macd_signal and macd_hist of a stream of bars."""
    return stream_indicators(bars, [FUSED["macd"](fast, slow, signal)], ["close"])


def stream_rsi(bars: DataFrame, period: int = 14, price_col: str = "close") -> DataFrame:
    """rsi_{period} of a stream of bars."""
    return stream_indicators(bars, [FUSED["rsi"](period, price_col)], [price_col])


def stream_atr_adx(bars: DataFrame, period: int = 14) -> DataFrame:
    """atr_{period}, plus_di_{period}, minus_di_{period} and adx_{period} of a stream of bars."""
    return stream_indicators(bars, [FUSED["atr"](period), FUSED["adx"](period)], ["high", "low", "close"])


def stream_supertrend(bands: DataFrame) -> DataFrame:
    """supertrend of a stream with columns close, upper and lower (the basic bands)."""
    return stream_scan(bands, KEYS, "ts", ["close", "upper", "lower"], "supertrend double, supertrend_dir double", SuperTrend)


def stream_spacing(signals: DataFrame, least: int = 3) -> DataFrame:
    """Signals of a stream kept only with more than `least` bars between them."""
    return stream_scan(signals, KEYS, "ts", ["signal"], "spaced double", lambda: Spacing(least))


def stream_simulator(steps: DataFrame, config: SimulatorConfig | None = None) -> DataFrame:
    """The simulator over a stream of steps, positions and balance kept between batches."""
    rules = config or SimulatorConfig()
    full = steps.withColumns({c: F.lit(None).cast(t) for c, t in ACTION_COLUMNS.items() if c not in steps.columns})
    return stream_scan(full, KEYS, "ts", ["price", *ACTION_COLUMNS], STATE, lambda: Episode(rules))
