"""Trading simulator: positions, stops and balance carried over the steps of an episode, and performance measures."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.schema import KEYS
from tickloom.plans.scan import Kernel, scan

HOLD, BUY, SELL, CLOSE_LAST = 0, 1, 2, 3
STATE = "balance double, equity double, n_positions long, net_volume double, realized double, opened long, closed long, reward double, done boolean"


@dataclass(frozen=True)
class SimulatorConfig:
    """Account and order rules. reward is "equity_change", or "reference" for the balance less the equity."""

    initial_balance: float = 10_000.0
    max_lot: float = 1.0
    sl_tp_mode: str = "pips"
    pip_size: float = 0.01
    riskfree_profit_threshold: float = 0.005
    trailing_trigger: float = 0.01
    trailing_distance: float = 0.005
    max_steps: int | None = None
    max_drawdown: float = 2_000.0
    reward: str = "equity_change"


class Account:
    """One episode's account, stepped price by price."""

    def __init__(self, config: SimulatorConfig) -> None:
        self.config, self.balance, self.equity, self.before = config, config.initial_balance, config.initial_balance, config.initial_balance
        self.positions: list[dict] = []
        self.steps, self.done = 0, False

    def act(self, kind: int, price: float, volume: float, sl: float, tp: float, trailing: bool, riskfree: bool) -> tuple[int, int, float]:
        """Open a position or close the last one: positions opened, closed, and what that realised."""
        if kind == CLOSE_LAST and self.positions:
            last = self.positions.pop()
            gain = last["way"] * (price - last["entry"]) * last["volume"]
            self.balance += gain
            return 0, 1, gain
        if kind not in (BUY, SELL):
            return 0, 0, 0.0
        way = 1 if kind == BUY else -1
        unit = self.config.pip_size if self.config.sl_tp_mode == "pips" else price
        self.positions.append(
            {
                "entry": price,
                "volume": max(0.0, min(1.0, volume)) * self.config.max_lot,
                "way": way,
                "sl": price - way * sl * unit if sl else None,
                "tp": price + way * tp * unit if tp else None,
                "trailing": trailing,
                "riskfree": riskfree,
            }
        )
        return 1, 0, 0.0

    def _tighten(self, position: dict, stop: float) -> None:
        held = position["sl"]
        if held is None or position["way"] * (stop - held) > 0:
            position["sl"] = stop

    def mark(self, price: float, stop_long: float, stop_short: float) -> tuple[int, float]:
        """Close what reached its target or stop, move the stops of the rest: positions closed, and what that realised."""
        left, closed, realized = [], 0, 0.0
        for p in self.positions:
            gain = p["way"] * (price - p["entry"]) * p["volume"]
            reached = p["tp"] is not None and p["way"] * (price - p["tp"]) >= 0
            stopped = p["sl"] is not None and p["way"] * (price - p["sl"]) <= 0
            if reached or stopped:
                closed, realized = closed + 1, realized + gain
                continue
            worth = p["entry"] * p["volume"]
            if p["riskfree"] and gain >= self.config.riskfree_profit_threshold * worth:
                self._tighten(p, p["entry"])
            if p["trailing"]:
                follow = stop_long if p["way"] == 1 else stop_short
                if not np.isnan(follow):
                    self._tighten(p, follow)
                elif gain >= self.config.trailing_trigger * worth:
                    self._tighten(p, price - p["way"] * self.config.trailing_distance * price)
            left.append(p)
        self.positions = left
        self.balance += realized
        self.equity = self.balance + sum(p["way"] * (price - p["entry"]) * p["volume"] for p in left)
        return closed, realized

    def finish_step(self) -> float:
        """Count the step, decide whether the episode is over, and return the reward."""
        self.steps += 1
        if self.config.reward == "reference":
            reward, self.equity = self.balance - self.equity, self.balance
        else:
            reward = self.equity - self.before
        self.before = self.equity
        c = self.config
        self.done = self.balance <= 0 or (c.max_steps is not None and self.steps >= c.max_steps) or c.initial_balance - self.equity > c.max_drawdown
        return reward


class Episode(Kernel):
    """Steps an account through a series; after the end nothing changes."""

    def __init__(self, config: SimulatorConfig) -> None:
        self.account = Account(config)

    def push(self, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n = len(columns["price"])
        out = {k: np.zeros(n) for k in ("balance", "equity", "n_positions", "net_volume", "realized", "opened", "closed", "reward")} | {"done": np.zeros(n, dtype=bool)}
        a = self.account
        rows = zip(*(columns[c].tolist() for c in ("price", "action", "volume", "sl", "tp", "trailing", "riskfree", "stop_long", "stop_short")), strict=True)
        for k, (price, action, volume, sl, tp, trailing, riskfree, stop_long, stop_short) in enumerate(rows):
            if not a.done and not np.isnan(price):
                kind = 0 if np.isnan(action) else int(action)
                zero = lambda x: 0.0 if np.isnan(x) else x
                opened, shut, gain = a.act(kind, price, zero(volume), zero(sl), zero(tp), zero(trailing) != 0, zero(riskfree) != 0)
                closed, realized = a.mark(price, stop_long, stop_short)
                out["opened"][k], out["closed"][k], out["realized"][k] = opened, shut + closed, gain + realized
                out["reward"][k] = a.finish_step()
            out["balance"][k], out["equity"][k] = a.balance, a.equity
            out["n_positions"][k], out["net_volume"][k], out["done"][k] = len(a.positions), sum(p["way"] * p["volume"] for p in a.positions), a.done
        return out


ACTION_COLUMNS = {"action": "int", "volume": "double", "sl": "double", "tp": "double", "trailing": "int", "riskfree": "int", "stop_long": "double", "stop_short": "double"}


def simulate(steps: DataFrame, keys: list[str] | None = None, order: str = "ts", config: SimulatorConfig | None = None) -> DataFrame:
    """Walk steps(keys, order, price, action, volume, sl, tp, trailing, riskfree, stop_long, stop_short) and add the columns of STATE.

    Actions: 0 hold, 1 buy, 2 sell, 3 close the last position. volume is a share of the most lots; sl and tp are fractions of the
    price, or pips; stop_long and stop_short are where trailing stops follow to. Missing columns count as NULL, NULLs as 0
    (stops: no trailing level, so the simple rule of trigger and distance holds). A NULL price changes nothing. Targets are
    looked at before stops, and stops only tighten.
    """
    rules = config or SimulatorConfig()
    full = steps.withColumns({c: F.lit(None).cast(t) for c, t in ACTION_COLUMNS.items() if c not in steps.columns})
    return scan(full, keys or KEYS, [order], ["price", *ACTION_COLUMNS], STATE, lambda: Episode(rules))


def performance(states: DataFrame, keys: list[str] | None = None, order: str = "ts", periods_per_year: float = 252.0, initial: float = 10_000.0) -> DataFrame:
    """Measures of each episode: net_profit, trades, win_rate, expectancy, sharpe, max_drawdown, cagr, and the mixed reward.

    Trades are the steps that realised something. The Sharpe ratio is the mean over the sample deviation of the steps' returns,
    scaled to a year.
    """
    keys = keys or KEYS
    w = Window.partitionBy(*keys).orderBy(order)
    seen = states.withColumn("__peak", F.greatest(F.lit(initial), F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    seen = seen.withColumn("__return", F.try_divide(F.col("equity"), F.coalesce(F.lag("equity").over(w), F.lit(initial))) - 1.0)
    out = seen.groupBy(*keys).agg(
        F.max_by("equity", order).alias("__end"),
        F.count("*").alias("steps"),
        F.sum("closed").alias("trades"),
        F.sum((F.col("realized") > 0).cast("long")).alias("__wins"),
        F.sum((F.col("realized") != 0).cast("long")).alias("__deals"),
        F.sum("realized").alias("__sum"),
        F.avg("__return").alias("__mean"),
        F.stddev_samp("__return").alias("__dev"),
        F.max(F.col("__peak") - F.col("equity")).alias("max_drawdown"),
        F.sum("reward").alias("total_reward"),
    )
    sharpe = F.coalesce(F.try_divide(F.col("__mean"), F.col("__dev")) * F.sqrt(F.lit(periods_per_year)), F.lit(0.0))
    growth = F.when(F.col("__end") > 0, F.pow(F.col("__end") / initial, F.lit(periods_per_year) / F.col("steps")) - 1.0)
    return out.select(
        *keys,
        "steps",
        (F.col("__end") - initial).alias("net_profit"),
        "trades",
        F.coalesce(F.try_divide("__wins", "__deals"), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.try_divide("__sum", "__deals"), F.lit(0.0)).alias("expectancy"),
        sharpe.alias("sharpe"),
        "max_drawdown",
        growth.alias("cagr"),
        "total_reward",
    )


def mixed_reward(measures: DataFrame, alpha: float = 1.0, beta: float = 1.0, gamma: float = 1.0) -> DataFrame:
    """mixed_reward: alpha times profit plus beta times Sharpe less gamma times drawdown."""
    return measures.withColumn("mixed_reward", alpha * F.col("net_profit") + beta * F.col("sharpe") - gamma * F.col("max_drawdown"))
