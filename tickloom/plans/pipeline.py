"""Feature pipelines: named operators with parameters, applied in order, their exponential columns fused into one scan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tickloom.operators import indicators as ind

#: Operators by name.
OPERATORS: dict[str, Callable[..., DataFrame]] = {
    f.__name__: f
    for f in (
        ind.ema,
        ind.macd,
        ind.supertrend,
        ind.stochastic,
        ind.parabolic_sar,
        ind.rsi,
        ind.stoch_rsi,
        ind.atr,
        ind.bollinger_bands,
        ind.obv,
        ind.mfi,
        ind.adx,
        ind.cci,
        ind.detect_divergences_extrema,
        ind.adl,
        ind.cmf,
        ind.chaikin_oscillator,
        ind.candlestick_patterns,
        ind.ma_cross,
    )
}
#: Specs of those that are exponential means of bar columns alone, so that one scan makes them together.
FUSED = {
    "ema": lambda period=50, price_col="close": ind._ema_spec(period, price_col),
    "macd": lambda fast=12, slow=26, signal=9: ind._macd_spec(fast, slow, signal),
    "rsi": lambda period=14, price_col="close": ind._rsi_spec(period, price_col),
    "atr": lambda period=14, least=None: ind._atr_spec(period, least),
    "adx": lambda period=14: ind._adx_spec(period),
}


@dataclass
class IndicatorSpec:
    """An operator's name and parameters."""

    name: str
    params: dict = field(default_factory=dict)


@dataclass
class FeaturePipeline:
    """Applies specs in order. Unknown names raise AttributeError, wrong parameters TypeError.

    The exponential indicators read bar columns only, so they may be made first, in one scan; all others follow, and their
    windows share the scan's partitioning by series.
    """

    specs: list[IndicatorSpec]

    def apply(self, bars: DataFrame) -> DataFrame:
        ind.require_bars(bars)
        for spec in self.specs:
            if spec.name not in OPERATORS:
                raise AttributeError(f"unknown indicator {spec.name!r}")
        fused = [FUSED[s.name](**s.params) for s in self.specs if s.name in FUSED]
        lines = [s for s in self.specs if s.name == "stoch_rsi"]
        made = {o for f in fused for o in f.outputs}
        for s in lines:  # the RSI under a stochastic RSI comes from the same scan
            spec = ind._rsi_spec(s.params.get("period", 14))
            if spec.outputs[0] not in made:
                fused.append(spec)
        out = ind.ewm_columns(bars, fused) if fused else bars
        for s in self.specs:
            if s.name in FUSED:
                continue
            if s.name == "stoch_rsi":
                p = {"period": 14, "k_period": 3, "d_period": 3} | s.params
                out = ind._stoch_of_rsi(out, f"rsi_{p['period']}", p["period"], p["k_period"], p["d_period"])
                continue
            out = OPERATORS[s.name](out, **s.params)
        extra = {f"rsi_{s.params.get('period', 14)}" for s in lines} - made
        return out.drop(*extra)


def default_specs(include_supertrend: bool = False, include_volume: bool = True) -> list[IndicatorSpec]:
    """The standard features."""
    return [
        IndicatorSpec("ema", {"period": 50}),
        IndicatorSpec("ema", {"period": 200}),
        IndicatorSpec("macd"),
        *([IndicatorSpec("supertrend")] if include_supertrend else []),
        IndicatorSpec("rsi", {"period": 14}),
        IndicatorSpec("stoch_rsi"),
        IndicatorSpec("atr", {"period": 14}),
        IndicatorSpec("bollinger_bands", {"period": 20, "n_std": 2.0}),
        *([IndicatorSpec("obv"), IndicatorSpec("mfi", {"period": 14})] if include_volume else []),
        IndicatorSpec("adx", {"period": 14}),
        IndicatorSpec("cci", {"period": 20}),
    ]


def build_features(bars: DataFrame, specs: list[IndicatorSpec] | None = None, include_supertrend: bool = False, include_volume: bool | None = None) -> DataFrame:
    """Bars with all features; volume features are left out where there is no volume column."""
    volume = "tick_volume" in bars.columns if include_volume is None else include_volume
    return FeaturePipeline(list(specs or default_specs(include_supertrend, volume))).apply(bars)
