"""Technical indicators: each takes bars and appends columns.

What row frames express is native windows over one partitioning by series; exponential means and the like are walks of a
sorted scan. A zero denominator gives NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.schema import KEYS, require_columns
from tickloom.functions.windows import diff, prev, roll, rows, running_sum, sma, strict_extreme, true_range, upto
from tickloom.plans.blocks import HALO, before_block, blocked, ewm_blocks, supertrend_blocks, unblocked
from tickloom.plans.kernels import EwmPlan, Spacing, Step, SuperTrend
from tickloom.plans.scan import scan

#: Columns that hold a scan's inputs and intermediate results; they go with the result.
TEMP = "__"


def _span(period: int) -> float:
    return 2.0 / (period + 1.0)


@dataclass
class EwmSpec:
    """What an exponential indicator adds: columns before the scan, its steps, columns after it."""

    inputs: dict[str, Column] = field(default_factory=dict)
    steps: list[Step] = field(default_factory=list)
    outputs: list[str] = field(default_factory=list)


def ewm_columns(bars: DataFrame, specs: list[EwmSpec], block: Column | None = None) -> DataFrame:
    """All exponential columns of several indicators in one scan; equal inputs and steps are made once.

    With block (a value that does not fall as ts rises, such as the month of ts), each block of a series is a task's work, not each
    series; see plans.blocks. Inputs may then reach one bar back.
    """
    inputs, steps, outputs = {}, {}, []
    for spec in specs:
        inputs |= spec.inputs
        steps |= {s.out: s for s in spec.steps if s.out not in steps}
        outputs += [o for o in spec.outputs if o not in outputs]
    kept = [c for c in bars.columns if c not in outputs]
    ready = bars.select(*kept) if block is None else blocked(bars.select(*kept), block)
    ready = ready.withColumns(inputs) if inputs else ready
    reads = sorted({s.of for s in steps.values() if s.apply is None and s.of not in steps} | {c for c in inputs})
    plan = tuple(steps.values())
    if block is not None:
        return unblocked(ewm_blocks(ready.where(~F.col(HALO)), reads, plan, outputs)).select(*kept, *outputs)
    return scan(ready, KEYS, ["ts"], reads, ", ".join(f"`{o}` double" for o in outputs), lambda: EwmPlan(plan)).drop(*inputs)


def _ema_spec(period: int, price_col: str) -> EwmSpec:
    x = f"{TEMP}{price_col}"
    return EwmSpec({x: F.col(price_col).cast("double")}, [Step(f"ema_{period}", _span(period), period, x)], [f"ema_{period}"])


def ema(bars: DataFrame, period: int = 50, price_col: str = "close", block: Column | None = None) -> DataFrame:
    """ema_{period}; NULL until period values are seen. block: see ewm_columns()."""
    return ewm_columns(bars, [_ema_spec(period, price_col)], block)


def _macd_spec(fast: int, slow: int, signal: int) -> EwmSpec:
    x = f"{TEMP}close"
    fast_step, slow_step = Step(f"{TEMP}ema_{fast}", _span(fast), fast, x), Step(f"{TEMP}ema_{slow}", _span(slow), slow, x)
    return EwmSpec(
        {x: F.col("close").cast("double")},
        [
            fast_step,
            slow_step,
            Step("macd_line", apply=lambda m: m[fast_step.out] - m[slow_step.out]),
            Step("macd_signal", _span(signal), signal, "macd_line"),
            Step("macd_hist", apply=lambda m: m["macd_line"] - m["macd_signal"]),
        ],
        ["macd_line", "macd_signal", "macd_hist"],
    )


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, block: Column | None = None) -> DataFrame:
    """macd_line, its mean macd_signal, and their difference macd_hist. block: see ewm_columns()."""
    return ewm_columns(bars, [_macd_spec(fast, slow, signal)], block)


def _rsi_spec(period: int, price_col: str = "close") -> EwmSpec:
    change = diff(F.col(price_col).cast("double"))
    up, down = f"{TEMP}up_{price_col}", f"{TEMP}down_{price_col}"
    gain, loss = Step(f"{TEMP}gain_{period}", 1.0 / period, period, up), Step(f"{TEMP}loss_{period}", 1.0 / period, period, down)

    def strength(m: dict[str, np.ndarray]) -> np.ndarray:
        low = np.where(m[loss.out] == 0, np.nan, m[loss.out])
        return 100.0 - 100.0 / (1.0 + m[gain.out] / low)

    return EwmSpec(
        {up: F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))), down: F.when(change.isNotNull(), F.greatest(-change, F.lit(0.0)))},
        [gain, loss, Step(f"rsi_{period}", apply=strength)],
        [f"rsi_{period}"],
    )


def rsi(bars: DataFrame, period: int = 14, price_col: str = "close", block: Column | None = None) -> DataFrame:
    """rsi_{period} by Wilder means; NULL where the mean loss is 0. block: see ewm_columns()."""
    return ewm_columns(bars, [_rsi_spec(period, price_col)], block)


def _stoch_of_rsi(bars: DataFrame, rsi_col: str, period: int, k_period: int, d_period: int) -> DataFrame:
    low, high = roll(rsi_col, period, F.min), roll(rsi_col, period, F.max)
    k, d = f"stochrsi_k_{period}_{k_period}", f"stochrsi_d_{period}_{k_period}_{d_period}"
    out = bars.withColumn(f"{TEMP}raw", F.try_divide(F.col(rsi_col) - low, high - low))
    out = out.withColumn(k, sma(f"{TEMP}raw", k_period) * 100.0)
    return out.withColumn(d, sma(k, d_period)).drop(f"{TEMP}raw")


def stoch_rsi(bars: DataFrame, period: int = 14, k_period: int = 3, d_period: int = 3) -> DataFrame:
    """Place of the RSI in its range over period bars, smoothed; the RSI itself is not added."""
    spec = _rsi_spec(period)
    hidden = f"{TEMP}rsi"
    spec.steps[-1] = Step(hidden, apply=spec.steps[-1].apply)
    spec.outputs = [hidden]
    return _stoch_of_rsi(ewm_columns(bars, [spec]), hidden, period, k_period, d_period).drop(hidden)


def _atr_spec(period: int, least: int | None = None) -> EwmSpec:
    tr = f"{TEMP}tr"
    return EwmSpec({tr: true_range()}, [Step(f"atr_{period}", 1.0 / period, period if least is None else least, tr)], [f"atr_{period}"])


def atr(bars: DataFrame, period: int = 14, least: int | None = None, block: Column | None = None) -> DataFrame:
    """atr_{period}: Wilder mean of the true range; NULL until `least` (period by default) values are seen. block: see ewm_columns()."""
    return ewm_columns(bars, [_atr_spec(period, least)], block)


def atrs(bars: DataFrame, periods: Sequence[int], least: int | None = None) -> DataFrame:
    """atr_{period} of several periods in one scan."""
    return ewm_columns(bars, [_atr_spec(n, least) for n in periods])


def _adx_spec(period: int) -> EwmSpec:
    up, down = diff("high"), -diff("low")
    plus, minus, tr = f"{TEMP}plus", f"{TEMP}minus", f"{TEMP}tr"
    names = {k: f"{TEMP}{k}_{period}" for k in ("p", "m", "t", "dx")}

    def share(of: str):
        return lambda m: 100.0 * m[names[of]] / np.where(m[names["t"]] == 0, np.nan, m[names["t"]])

    def index(m: dict[str, np.ndarray]) -> np.ndarray:
        a, b = m[f"plus_di_{period}"], m[f"minus_di_{period}"]
        return 100.0 * np.abs(a - b) / np.where(a + b == 0, np.nan, a + b)

    return EwmSpec(
        {
            plus: F.when((up > down) & (up > 0), up).otherwise(F.lit(0.0)),
            minus: F.when((down > up) & (down > 0), down).otherwise(F.lit(0.0)),
            tr: true_range(),
        },
        [
            Step(names["t"], 1.0 / period, period, tr),
            Step(names["p"], 1.0 / period, period, plus),
            Step(names["m"], 1.0 / period, period, minus),
            Step(f"plus_di_{period}", apply=share("p")),
            Step(f"minus_di_{period}", apply=share("m")),
            Step(names["dx"], apply=index),
            Step(f"adx_{period}", 1.0 / period, period, names["dx"]),
        ],
        [f"plus_di_{period}", f"minus_di_{period}", f"adx_{period}"],
    )


def adx(bars: DataFrame, period: int = 14, block: Column | None = None) -> DataFrame:
    """plus_di, minus_di and adx by Wilder means. block: see ewm_columns()."""
    return ewm_columns(bars, [_adx_spec(period)], block)


def supertrend(bars: DataFrame, period: int = 10, multiplier: float = 3.0, block: Column | None = None) -> DataFrame:
    """supertrend and supertrend_dir (1 up, -1 down); NULL in the first bar, the line also until the ATR is known. block: see ewm_columns()."""
    name = f"atr_{period}"
    had = name in bars.columns
    if block is None:
        out = bars if had else atr(bars, period)
    else:
        spec = _atr_spec(period)
        out = blocked(bars, block).withColumns({**({} if had else spec.inputs), **before_block()}).where(~F.col(HALO))
        out = out if had else ewm_blocks(out, list(spec.inputs), tuple(spec.steps), spec.outputs).drop(*spec.inputs)
    middle = (F.col("high") + F.col("low")) / 2.0
    out = out.withColumns({f"{TEMP}upper": middle + multiplier * F.col(name), f"{TEMP}lower": middle - multiplier * F.col(name)})
    out = out.withColumnsRenamed({f"{TEMP}upper": "upper", f"{TEMP}lower": "lower"})
    if block is None:
        out = scan(out, KEYS, ["ts"], ["close", "upper", "lower"], "supertrend double, supertrend_dir double", SuperTrend)
    else:
        kept = [c for c in bars.columns if c not in ("supertrend", "supertrend_dir")]
        out = unblocked(supertrend_blocks(out)).select(*kept, "upper", "lower", *([] if had else [name]), "supertrend", "supertrend_dir")
    return out.drop("upper", "lower", *([] if had else [name]))


def stochastic(bars: DataFrame, period: int = 14, smooth_k: int = 3, smooth_d: int = 3, price_col: str = "close") -> DataFrame:
    """%k, the raw place of the price in its range, and %d, its mean taken twice."""
    low, high = roll("low", period, F.min), roll("high", period, F.max)
    out = bars.withColumn("%k", F.try_divide(F.col(price_col) - low, high - low) * 100.0)
    out = out.withColumn(f"{TEMP}k", sma("`%k`", smooth_k))
    return out.withColumn("%d", sma(f"{TEMP}k", smooth_d)).drop(f"{TEMP}k")


def parabolic_sar(bars: DataFrame, acceleration: float = 0.02, max_acceleration: float = 0.2) -> DataFrame:
    """psar: the close before. The reference semantics are this stand-in; the parameters have no effect."""
    return bars.withColumn("psar", prev("close"))


def bollinger_bands(bars: DataFrame, period: int = 20, n_std: float = 2.0, price_col: str = "close") -> DataFrame:
    """Mean, bands of n_std population deviations, and width relative to the mean; names carry the whole part of n_std."""
    middle, spread = sma(price_col, period), roll(price_col, period, F.stddev_pop)
    tag = f"{period}_{int(n_std)}"
    out = bars.withColumn(f"bb_mid_{period}", middle)
    out = out.withColumns({f"bb_upper_{tag}": F.col(f"bb_mid_{period}") + n_std * spread, f"bb_lower_{tag}": F.col(f"bb_mid_{period}") - n_std * spread})
    return out.withColumn(f"bb_width_{tag}", F.try_divide(F.col(f"bb_upper_{tag}") - F.col(f"bb_lower_{tag}"), F.col(f"bb_mid_{period}")))


def obv(bars: DataFrame) -> DataFrame:
    """Running sum of the volume, signed by the change of the close; 0 in the first bar."""
    signed = F.coalesce(F.signum(diff("close")), F.lit(0.0)) * F.col("tick_volume")
    return bars.withColumn(f"{TEMP}v", signed).withColumn("obv", running_sum(f"{TEMP}v")).drop(f"{TEMP}v")


def _typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3.0


def mfi(bars: DataFrame, period: int = 14) -> DataFrame:
    """Money flow index: rising against falling money flow over period bars; NULL where nothing fell."""
    out = bars.withColumn(f"{TEMP}tp", _typical())
    flow, before = F.col(f"{TEMP}tp") * F.col("tick_volume"), prev(f"{TEMP}tp")
    out = out.withColumns({f"{TEMP}pos": F.when(F.col(f"{TEMP}tp") > before, flow).otherwise(F.lit(0.0)), f"{TEMP}neg": F.when(F.col(f"{TEMP}tp") < before, flow).otherwise(F.lit(0.0))})
    ratio = F.try_divide(roll(f"{TEMP}pos", period, F.sum), F.nullif(roll(f"{TEMP}neg", period, F.sum), F.lit(0.0)))
    return out.withColumn(f"mfi_{period}", 100.0 - 100.0 / (1.0 + ratio)).drop(f"{TEMP}tp", f"{TEMP}pos", f"{TEMP}neg")


def cci(bars: DataFrame, period: int = 20) -> DataFrame:
    """Distance of the typical price from its mean over 0.015 times the mean of such distances, each from its own bar's mean."""
    out = bars.withColumn(f"{TEMP}tp", _typical())
    out = out.withColumn(f"{TEMP}gap", F.col(f"{TEMP}tp") - sma(f"{TEMP}tp", period))
    mean = roll(F.abs(F.col(f"{TEMP}gap")), period, F.avg)
    return out.withColumn(f"cci_{period}", F.try_divide(F.col(f"{TEMP}gap"), 0.015 * mean)).drop(f"{TEMP}tp", f"{TEMP}gap")


def _flow_volume() -> Column:
    place = F.try_divide(2.0 * F.col("close") - F.col("high") - F.col("low"), F.col("high") - F.col("low"))
    return F.coalesce(place, F.lit(0.0)) * F.col("tick_volume")


def adl(bars: DataFrame) -> DataFrame:
    """Running sum of the volume weighted by the close's place in its bar."""
    return bars.withColumn(f"{TEMP}f", _flow_volume()).withColumn("adl", running_sum(f"{TEMP}f")).drop(f"{TEMP}f")


def cmf(bars: DataFrame, period: int = 20) -> DataFrame:
    """Chaikin money flow over period bars; 0 in the warm-up and without volume."""
    out = bars.withColumn(f"{TEMP}f", _flow_volume())
    ratio = F.try_divide(roll(f"{TEMP}f", period, F.sum), roll(F.col("tick_volume").cast("double"), period, F.sum))
    return out.withColumn(f"cmf_{period}", F.coalesce(ratio, F.lit(0.0))).drop(f"{TEMP}f")


def chaikin_oscillator(bars: DataFrame, fast: int = 3, slow: int = 10) -> DataFrame:
    """Difference of two exponential means of the accumulation line, which is added where it is missing."""
    out = bars if "adl" in bars.columns else adl(bars)
    a, b, name = Step(f"{TEMP}adl_{fast}", _span(fast), fast, f"{TEMP}adl"), Step(f"{TEMP}adl_{slow}", _span(slow), slow, f"{TEMP}adl"), f"chaikin_osc_{fast}_{slow}"
    return ewm_columns(out, [EwmSpec({f"{TEMP}adl": F.col("adl")}, [a, b, Step(name, apply=lambda m: m[a.out] - m[b.out])], [name])])


def detect_divergences_extrema(bars: DataFrame, indicator_columns: list[str], price_col: str = "close", order: int = 5, min_diff_ratio: float = 0.001) -> DataFrame:
    """{indicator}_bullish_divergence and {indicator}_bearish_divergence at the price's strict extrema.

    At a price minimum, against the last indicator minimum up to it: the price fell while the indicator rose by more than
    min_diff_ratio of itself (bullish); mirrored at maxima (bearish). Ratios keep the indicator's sign.
    """
    price = F.col(price_col)
    out = bars.withColumns({f"{TEMP}pmin": strict_extreme(price_col, order, True), f"{TEMP}pmax": strict_extreme(price_col, order, False)})
    for name in indicator_columns:
        value = F.col(name)
        out = out.withColumns({f"{TEMP}imin": strict_extreme(name, order, True), f"{TEMP}imax": strict_extreme(name, order, False)})
        point = F.struct(price.alias("p"), value.alias("i"))
        out = out.withColumns({f"{TEMP}{k}": F.last(F.when(F.col(f"{TEMP}{k}"), point), ignorenulls=True).over(upto()) for k in ("imin", "imax")})
        low, high = F.col(f"{TEMP}imin"), F.col(f"{TEMP}imax")
        bullish = (F.try_divide(low["p"] - price, low["p"]) > 0) & (F.try_divide(value - low["i"], low["i"]) > min_diff_ratio)
        bearish = (F.try_divide(price - high["p"], high["p"]) > 0) & (F.try_divide(high["i"] - value, high["i"]) > min_diff_ratio)
        out = out.withColumns(
            {
                f"{name}_bullish_divergence": F.coalesce(F.col(f"{TEMP}pmin") & bullish, F.lit(False)),
                f"{name}_bearish_divergence": F.coalesce(F.col(f"{TEMP}pmax") & bearish, F.lit(False)),
            }
        )
    return out.drop(*(f"{TEMP}{k}" for k in ("pmin", "pmax", "imin", "imax")))


def candlestick_patterns(bars: DataFrame, patterns: list[str] | None = None) -> DataFrame:
    """Doji, hammer, shooting star and engulfing patterns as booleans; `patterns` has no effect."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    body, upper, lower = F.abs(c - o), h - F.greatest(o, c), F.least(o, c) - low
    po, pc = prev("open"), prev("close")
    found = {
        "pattern_doji": F.try_divide(body, h - low) <= 0.1,
        "pattern_hammer": (lower >= 2.0 * body) & (upper <= 0.5 * body),
        "pattern_shooting_star": (upper >= 2.0 * body) & (lower <= 0.5 * body),
        "pattern_bull_engulf": (pc < po) & (c > o) & (c > po) & (o < pc),
        "pattern_bear_engulf": (pc > po) & (c < o) & (o > pc) & (c < po),
    }
    return bars.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in found.items()})


def moving_average_cross_simple(bars: DataFrame, fast_period: int = 20, slow_period: int = 50, ma_type: str = "EMA", price_col: str = "close") -> DataFrame:
    """fast_MA, slow_MA and MA_Cross_Signal: 1 where the fast mean rises above the slow one, -1 where it falls below, else 0."""
    if fast_period >= slow_period:
        raise ValueError("fast_period must be smaller than slow_period")
    if ma_type.upper() == "SMA":
        out = bars.withColumns({"fast_MA": sma(price_col, fast_period), "slow_MA": sma(price_col, slow_period)})
    elif ma_type.upper() == "EMA":
        x = f"{TEMP}x"
        out = ewm_columns(bars, [EwmSpec({x: F.col(price_col).cast("double")}, [Step("fast_MA", _span(fast_period), 1, x), Step("slow_MA", _span(slow_period), 1, x)], ["fast_MA", "slow_MA"])])
    else:
        raise ValueError(f"unknown ma_type {ma_type!r}")
    fast, slow = F.col("fast_MA"), F.col("slow_MA")
    signal = F.when((fast > slow) & (prev(fast) <= prev(slow)), 1).when((fast < slow) & (prev(fast) >= prev(slow)), -1).otherwise(0)
    return out.withColumn("MA_Cross_Signal", signal)


@dataclass
class MovingAverageCross:
    """Crossings of one or several pairs of moving averages, with confirmation, spacing and magnitude."""

    fast: int | list[int] = 12
    slow: int | list[int] = 26
    ma_type: str = "ema"
    signal_col: str = "ma_cross_signal"
    min_bars_between_signals: int = 3
    confirm_bars: int = 1
    magnitude: bool = False
    price_col: str = "close"

    def pairs(self) -> list[tuple[int, int]]:
        """Fast and slow periods, a single value repeated to the other's length."""
        fast = self.fast if isinstance(self.fast, list) else [self.fast]
        slow = self.slow if isinstance(self.slow, list) else [self.slow]
        n = max(len(fast), len(slow))
        fast, slow = fast * n if len(fast) == 1 else fast, slow * n if len(slow) == 1 else slow
        if len(fast) != len(slow):
            raise ValueError("fast and slow need as many periods")
        if any(f >= s for f, s in zip(fast, slow, strict=True)):
            raise ValueError("each fast period must be smaller than its slow one")
        return list(zip(fast, slow, strict=True))

    def add_to_df(self, bars: DataFrame) -> DataFrame:
        """Append the means, their differences, _ma_agg_diff and the signal."""
        pairs = self.pairs()
        names = {f"ma_fast_{f}": f for f, _ in pairs} | {f"ma_slow_{s}": s for _, s in pairs}
        if self.ma_type.lower() == "sma":
            out = bars.withColumns({n: F.avg(self.price_col).over(rows(-(p - 1), 0)) for n, p in names.items()})
        elif self.ma_type.lower() == "ema":
            x = f"{TEMP}x"
            out = ewm_columns(bars, [EwmSpec({x: F.col(self.price_col).cast("double")}, [Step(n, _span(p), 1, x) for n, p in names.items()], list(names))])
        else:
            raise ValueError(f"unknown ma_type {self.ma_type!r}")
        gaps = {f"ma_diff_{f}_{s}": F.col(f"ma_fast_{f}") - F.col(f"ma_slow_{s}") for f, s in pairs}
        out = out.withColumns(gaps)
        total = sum((F.col(g) for g in gaps), F.lit(0.0)) if len(gaps) > 1 else F.col(next(iter(gaps)))
        out = out.withColumn("_ma_agg_diff", total).withColumn(f"{TEMP}now", F.signum("_ma_agg_diff")).withColumn(f"{TEMP}was", prev(f"{TEMP}now"))
        now, was = F.col(f"{TEMP}now"), F.col(f"{TEMP}was")
        signal = F.when((was <= 0) & (now > 0), 1.0).when((was >= 0) & (now < 0), -1.0).otherwise(0.0)
        if self.confirm_bars > 1:
            ahead = rows(0, self.confirm_bars - 1)
            holds = F.when(signal > 0, F.min("_ma_agg_diff").over(ahead) > 0).when(signal < 0, F.max("_ma_agg_diff").over(ahead) < 0)
            signal = F.when(F.coalesce(holds, F.lit(False)), signal).otherwise(0.0)
        out = out.withColumn("signal", signal).drop(f"{TEMP}now", f"{TEMP}was")
        if self.min_bars_between_signals > 0:
            least = self.min_bars_between_signals
            out = scan(out, KEYS, ["ts"], ["signal"], "spaced double", lambda: Spacing(least)).drop("signal").withColumnRenamed("spaced", "signal")
        if self.magnitude:
            n = max(5, *(p for pair in pairs for p in pair))
            scale = F.try_divide(F.col("_ma_agg_diff"), F.nullif(roll("_ma_agg_diff", n, F.stddev_samp), F.lit(0.0)))
            out = out.withColumn("signal", F.col("signal") * F.coalesce(scale, F.lit(0.0)))
        return out.drop(self.signal_col).withColumnRenamed("signal", self.signal_col)

    def last_signal(self, signals: DataFrame) -> DataFrame:
        """Latest signal of each series, NULL as 0."""
        return signals.groupBy(*KEYS).agg(F.coalesce(F.max_by(self.signal_col, "ts"), F.lit(0.0)).alias(self.signal_col))

    def cross_points(self, signals: DataFrame) -> DataFrame:
        """Bars with a signal, their price and averages."""
        means = [c for c in signals.columns if c.startswith(("ma_fast_", "ma_slow_"))]
        return signals.where(F.col(self.signal_col) != 0).select(*KEYS, "ts", self.price_col, *means, self.signal_col)

    def as_binary_cols(self, signals: DataFrame, buy_col: str = "buy_signal", sell_col: str = "sell_signal") -> DataFrame:
        """Signals as two columns of 1 and 0."""
        s = F.coalesce(F.col(self.signal_col), F.lit(0.0))
        return signals.withColumns({buy_col: (s > 0).cast("int"), sell_col: (s < 0).cast("int")})

    def to_spec(self) -> dict:
        """Name and parameters, for a feature pipeline."""
        return {"name": "ma_cross", "params": asdict(self)}


def ma_cross(bars: DataFrame, **params) -> DataFrame:
    """MovingAverageCross(**params).add_to_df(bars)."""
    return MovingAverageCross(**params).add_to_df(bars)


#: Ratios of the levels in a lookback range. Fixed values.
RETRACEMENTS = (0.236, 0.382, 0.5, 0.618, 0.786)
EXTENSIONS = (1.272, 1.618, 2.0)


def _lookback(bars: DataFrame, lookback: int) -> DataFrame:
    """High and low of each series' last lookback bars; shorter series are left out."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("ts"))
    recent = bars.withColumn(f"{TEMP}n", F.row_number().over(w)).where(F.col(f"{TEMP}n") <= lookback)
    return recent.groupBy(*KEYS).agg(F.max("high").alias("hi"), F.min("low").alias("lo"), F.count("*").alias("n")).where(F.col("n") >= lookback)


def fibonacci_retracement(bars: DataFrame, lookback: int = 100, levels: tuple[float, ...] = RETRACEMENTS) -> DataFrame:
    """Level and Price of the retracements of each series' range; series with fewer bars than lookback give no rows."""
    out = _lookback(bars, lookback).withColumn("Level", F.explode(F.array(*map(F.lit, levels))))
    up = F.col("hi") > F.col("lo")
    span = F.col("hi") - F.col("lo")
    return out.select(*KEYS, "Level", F.when(up, F.col("hi") - span * F.col("Level")).otherwise(F.col("lo") + span * F.col("Level")).alias("Price"))


def fibonacci_levels(bars: DataFrame, lookback: int = 100, levels: tuple[float, ...] = RETRACEMENTS, include_extension: bool = True, extensions: tuple[float, ...] = EXTENSIONS) -> DataFrame:
    """Type, Level and Price of retracements and extensions, with their rank by falling price."""
    marks = [F.struct(F.lit("Retracement").alias("Type"), F.lit(x).alias("Level")) for x in levels]
    marks += [F.struct(F.lit("Extension").alias("Type"), F.lit(x).alias("Level")) for x in extensions] if include_extension else []
    out = _lookback(bars, lookback).withColumn("m", F.explode(F.array(*marks)))
    span, level = F.col("hi") - F.col("lo"), F.col("m.Level")
    price = F.when(F.col("m.Type") == "Retracement", F.col("hi") - span * level).otherwise(F.col("hi") + span * (level - 1.0))
    out = out.select(*KEYS, "m.Type", "m.Level", price.alias("Price"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("Price"), "Level")).cast("long"))


def rule_signal(bars: DataFrame, rsi_col: str, ema_col: str, low: float = 30.0, high: float = 70.0) -> DataFrame:
    """buy where the RSI is low and the close above its mean, sell where it is high and the close below, else hold."""
    r, c, e = F.col(rsi_col), F.col("close"), F.col(ema_col)
    return bars.withColumn("rule_signal", F.when((r < low) & (c > e), "buy").when((r > high) & (c < e), "sell").otherwise("hold"))


def weighted_vote(df: DataFrame, votes: dict[str, float], out: str = "vote") -> DataFrame:
    """Weighted sum of votes of -1, 0 and 1; NULL counts as 0."""
    return df.withColumn(out, sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in votes.items()), F.lit(0.0)))


def require_bars(bars: DataFrame) -> None:
    """Raise ValueError unless the frame holds bars."""
    require_columns(bars, *KEYS, "ts", "open", "high", "low", "close")

