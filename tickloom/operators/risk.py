"""Symbol facts, lots, pip values, margins, order requests and stops, as column expressions over tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.windows import series, trailing
from tickloom.operators import indicators
from tickloom.operators.joins import asof_join

# Defaults of symbols, lots and orders.
DEFAULT_POINT, DEFAULT_CONTRACT = 0.0001, 100_000.0
METAL_POINT, METAL_CONTRACT = 0.01, 100.0
MIN_LOT, LOT_STEP = 0.01, 0.01
DEVIATION, MAGIC = 20, 123456
TRAILING = {"mode": "chandelier", "atr_period": 14, "atr_mult": 1.5, "chandelier_period": 22, "chandelier_atr_mult": 3.0}


def normal_symbol(symbol: Column) -> Column:
    """Leading letters of a symbol in upper case."""
    return F.upper(F.regexp_extract(F.trim(symbol), r"^([A-Za-z]+)", 1))


def with_symbol_info(df: DataFrame, symbol: str = "symbol", infos: DataFrame | None = None) -> DataFrame:
    """Add base, quote, point, pip and contract_size.

    Six letters or more split into three and three, five into two and three, others into none. Metals (XAU, GOLD) and yen quotes have
    their own defaults. A pip is ten points below 0.001, else one. infos(symbol, point, trade_contract_size), one row a symbol,
    takes precedence.
    """
    name = normal_symbol(F.col(symbol))
    out = df.withColumn("__sym", name)
    n = F.length("__sym")
    out = out.withColumns({"base": F.when(n >= 6, F.substring("__sym", 1, 3)).when(n == 5, F.substring("__sym", 1, 2)), "quote": F.when(n >= 6, F.substring("__sym", 4, 3)).when(n == 5, F.substring("__sym", 3, 3))})
    metal = F.col("__sym").contains("XAU") | F.col("__sym").startswith("GOLD")
    point = F.when(F.coalesce(F.col("quote") == "JPY", F.lit(False)) | metal, METAL_POINT).otherwise(DEFAULT_POINT)
    contract = F.when(metal, METAL_CONTRACT).otherwise(DEFAULT_CONTRACT)
    if infos is not None:
        known = infos.select(normal_symbol(F.col("symbol")).alias("__sym"), F.col("point").cast("double").alias("__point"), F.col("trade_contract_size").cast("double").alias("__size"))
        out = out.join(known, "__sym", "left")
        point, contract = F.coalesce(F.nullif("__point", F.lit(0.0)), point), F.coalesce(F.nullif("__size", F.lit(0.0)), contract)
    out = out.withColumns({"point": point, "contract_size": contract})
    return out.withColumn("pip", F.when(F.col("point") < 0.001, F.col("point") * 10.0).otherwise(F.col("point"))).drop("__sym", "__point", "__size")


def _steps(x: Column, step: float, up: bool = False) -> Column:
    n = x / F.lit(step)
    return F.round((F.ceil(n) if up else F.floor(n)) * F.lit(step), 8)


def round_lot(lot: Column, lot_step: float = LOT_STEP) -> Column:
    """Whole steps of lot, downwards."""
    if lot_step <= 0:
        raise ValueError("lot_step must be > 0")
    return _steps(lot, lot_step)


def validate_lot(lot: Column, min_lot: float = MIN_LOT, lot_step: float = LOT_STEP, max_lot: float | None = None) -> Column:
    """A lot that a broker takes: 0 below half the least lot, the least lot from there on, else whole steps up to the most."""
    least = _steps(F.lit(min_lot), lot_step, up=True)
    whole = _steps(lot, lot_step)
    whole = F.when(whole < min_lot, least).otherwise(whole)
    out = F.when(F.coalesce(lot, F.lit(0.0)) <= 0, 0.0).when(lot < min_lot / 2.0, 0.0).when(lot < min_lot, least).otherwise(whole)
    return out if max_lot is None else F.when(out > max_lot, _steps(F.lit(max_lot), lot_step)).otherwise(out)


def with_pip_value(df: DataFrame, lot: Column | float = 1.0, account_currency: str | None = None, rates: DataFrame | None = None) -> DataFrame:
    """Add pip_value of lot: pip times contract, converted to the account's currency by the direct rate, else by the inverse one.

    df has base, quote, pip and contract_size; rates(symbol, bid, ask) has one row a pair. Without a rate the value stays in the
    quote currency.
    """
    value = F.col("pip") * F.col("contract_size") * (F.lit(lot) if isinstance(lot, (int, float)) else lot)
    if account_currency is None or rates is None:
        return df.withColumn("pip_value", value)
    money = account_currency.upper()
    mid = F.when((F.col("bid") > 0) & (F.col("ask") > 0), (F.col("bid") + F.col("ask")) / 2.0).otherwise(F.coalesce("ask", "bid"))
    pairs = rates.select(normal_symbol(F.col("symbol")).alias("__pair"), F.nullif(mid, F.lit(0.0)).alias("__mid"))
    out = df.withColumns({"__direct": F.concat("quote", F.lit(money)), "__inverse": F.concat(F.lit(money), F.col("quote"))})
    out = out.join(pairs.withColumnsRenamed({"__pair": "__direct", "__mid": "__d"}), "__direct", "left").join(pairs.withColumnsRenamed({"__pair": "__inverse", "__mid": "__i"}), "__inverse", "left")
    rate = F.when(F.col("quote") == money, 1.0).otherwise(F.coalesce(F.col("__d"), F.try_divide(F.lit(1.0), F.col("__i")), F.lit(1.0)))
    return out.withColumn("pip_value", value * rate).drop("__direct", "__inverse", "__d", "__i")


def with_lot_by_risk(df: DataFrame, equity: str = "equity", risk_percent: str = "risk_percent", sl_pips: str = "sl_pips", pip_value: str = "pip_value", **limits) -> DataFrame:
    """Add lot, risk_amount and pip_value_used: the lot that risks the percentage of equity at the stop.

    A stop or pip value of 0 or less raises an error when the row is computed.
    """
    stop = F.when(F.col(sl_pips) > 0, F.col(sl_pips)).otherwise(F.raise_error(F.lit("sl_pips must be > 0")).cast("double"))
    pip = F.when(F.col(pip_value) > 0, F.col(pip_value)).otherwise(F.raise_error(F.lit("pip value must be > 0")).cast("double"))
    raw = F.col(equity) * F.col(risk_percent) / 100.0 / (stop * pip)
    out = df.withColumn("lot", validate_lot(raw, **limits))
    return out.withColumns({"risk_amount": F.col("lot") * F.col(sl_pips) * F.col(pip_value), "pip_value_used": F.col(pip_value)})


def required_margin(lot: Column, contract_size: Column, price: Column, leverage: Column | float = 100.0) -> Column:
    """Margin of a position."""
    return lot * contract_size * price / F.greatest(F.lit(1.0), F.lit(leverage) if isinstance(leverage, (int, float)) else leverage)


def margins(positions: DataFrame, accounts: DataFrame, by: list[str], leverage: float = 100.0) -> DataFrame:
    """used_margin of positions(by, volume, contract_size, price) and free_margin of accounts(by, balance), none below 0."""
    used = positions.groupBy(*by).agg(F.sum(required_margin(F.col("volume"), F.col("contract_size"), F.col("price"), leverage)).alias("used_margin"))
    out = accounts.join(used, by, "left").withColumn("used_margin", F.coalesce("used_margin", F.lit(0.0)))
    return out.withColumn("free_margin", F.greatest(F.lit(0.0), F.col("balance") - F.col("used_margin")))


def floating_profit(positions: DataFrame) -> DataFrame:
    """profit of open positions(type 0 buy or 1 sell, volume, price_open, bid, ask, contract_size): buys are valued at bid, sells at ask."""
    move = F.when(F.col("type") == 0, F.col("bid") - F.col("price_open")).otherwise(F.col("price_open") - F.col("ask"))
    return positions.withColumn("profit", move * F.col("volume") * F.col("contract_size"))


def account_equity(positions: DataFrame, accounts: DataFrame, by: list[str]) -> DataFrame:
    """profit, n_positions and equity (balance and profit) of accounts(by, balance) with positions as in floating_profit()."""
    held = floating_profit(positions).groupBy(*by).agg(F.sum("profit").alias("profit"), F.count("*").alias("n_positions"))
    out = accounts.join(held, by, "left").withColumns({"profit": F.coalesce("profit", F.lit(0.0)), "n_positions": F.coalesce("n_positions", F.lit(0).cast("long"))})
    return out.withColumn("equity", F.col("balance") + F.col("profit"))


def with_order_prices(orders: DataFrame) -> DataFrame:
    """entry_price, sl_price and tp_price of orders(side, bid, ask, pip, sl_pips, tp_pips): buys enter at ask, sells at bid."""
    buy = F.lower("side") == "buy"
    entry, way = F.when(buy, F.col("ask")).otherwise(F.col("bid")), F.when(buy, 1.0).otherwise(-1.0)
    return orders.withColumns({"entry_price": entry, "sl_price": entry - way * F.col("sl_pips") * F.col("pip"), "tp_price": entry + way * F.col("tp_pips") * F.col("pip")})


def order_requests(orders: DataFrame, deviation: int = DEVIATION, magic: int = MAGIC) -> DataFrame:
    """Requests for a broker of orders with prices and lots: action, type, price, stops, deviation, magic; lots of 0 are left out."""
    priced = with_order_prices(orders).where(F.col("lot") > 0)
    return priced.withColumns({"action": F.lit("deal"), "order_type": F.upper("side"), "price": F.col("entry_price"), "sl": F.col("sl_price"), "tp": F.col("tp_price"), "deviation": F.lit(deviation), "magic": F.lit(magic)})


def close_requests(positions: DataFrame, deviation: int = DEVIATION, magic: int = MAGIC) -> DataFrame:
    """Opposite deals that close positions(ticket, symbol, volume, type 0 buy or 1 sell, bid, ask).

    A column close_volume asks for a part: no more than the position's volume is closed, and all of it where it is null. Nothing is
    asked of a broker for a part of 0 or less.
    """
    buy, volume = F.col("type") == 0, F.col("volume")
    if "close_volume" in positions.columns:
        volume = F.least(F.col("volume"), F.coalesce("close_volume", F.col("volume")))
    return positions.where(volume > 0).select("ticket", "symbol", volume.alias("volume"), F.when(buy, "SELL").otherwise("BUY").alias("order_type"), F.when(buy, F.col("bid")).otherwise(F.col("ask")).alias("price"), F.lit("deal").alias("action"), F.lit(deviation).alias("deviation"), F.lit(magic).alias("magic"))


def time_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Hour, weekday and minute as fractions and on the circle, and the three market sessions."""
    hour, day, minute = F.hour(ts), F.weekday(F.col(ts)), F.minute(ts)
    turn = 2.0 * 3.141592653589793
    return df.withColumns(
        {
            "hour_norm": hour / 23.0,
            "hour_sin": F.sin(turn * hour / 24.0),
            "hour_cos": F.cos(turn * hour / 24.0),
            "dow_norm": day / 6.0,
            "dow_sin": F.sin(turn * day / 7.0),
            "dow_cos": F.cos(turn * day / 7.0),
            "min_norm": minute / 59.0,
            "is_london": ((hour >= 7) & (hour < 16)).cast("int").cast("double"),
            "is_newyork": ((hour >= 12) & (hour < 20)).cast("int").cast("double"),
            "is_asia": ((hour < 7) | (hour >= 16)).cast("int").cast("double"),
        }
    )


def calendar_flags(bars: DataFrame, ts: str = "ts") -> DataFrame:
    """Whether a bar is its series' last of the day, of the week, of the month."""
    after = F.lead(ts).over(series())
    differs = lambda unit: F.coalesce(F.date_trunc(unit, F.col(ts)) != F.date_trunc(unit, after), F.lit(True))
    return bars.withColumns({"is_eod": differs("day"), "is_eow": differs("week"), "is_eom": differs("month")})


@dataclass
class TrailingStop:
    """Stops that follow the market: from the extreme of the last bars (chandelier), or from the price (atr)."""

    mode: str = TRAILING["mode"]
    atr_period: int = TRAILING["atr_period"]
    atr_mult: float = TRAILING["atr_mult"]
    chandelier_period: int = TRAILING["chandelier_period"]
    chandelier_atr_mult: float = TRAILING["chandelier_atr_mult"]

    def add_to_bars(self, bars: DataFrame) -> DataFrame:
        """stop_long and stop_short of each bar, from the Wilder ATR (from the first bar on)."""
        name = f"atr_{self.atr_period}"
        had = name in bars.columns
        out = indicators.atr(bars.drop(name), self.atr_period, least=1)
        a = F.col(name)
        if self.mode == "chandelier":
            frame = trailing(self.chandelier_period)
            long, short = F.max("high").over(frame) - self.chandelier_atr_mult * a, F.min("low").over(frame) + self.chandelier_atr_mult * a
        else:
            long, short = F.col("close") - self.atr_mult * a, F.col("close") + self.atr_mult * a
        out = out.withColumns({"stop_long": long, "stop_short": short})
        return out if had else out.drop(name)

    def position_stops(self, positions: DataFrame, bars: DataFrame, atr_periods: Sequence[int] = (), chandelier_periods: Sequence[int] = ()) -> DataFrame:
        """new_sl of positions(symbol, ts, direction 1 or -1) at the last of bars (of one timeframe) up to ts.

        Columns trailing_mode, atr_period, atr_mult, chandelier_period and chandelier_atr_mult override this setting where they are
        not null; current_price stands for the bar's close in mode atr. Periods of positions must be this setting's or among those
        given, all of which are worked out in one scan; others raise an error. NULL before the first bar.
        """
        atrs, spans = sorted({self.atr_period, *atr_periods}), sorted({self.chandelier_period, *chandelier_periods})
        known = indicators.atrs(bars.select("symbol", "tf", "ts", "high", "low", "close"), atrs, least=1)
        known = known.withColumns({f"high_{n}": F.max("high").over(trailing(n)) for n in spans} | {f"low_{n}": F.min("low").over(trailing(n)) for n in spans})
        columns = ["close", *(f"atr_{n}" for n in atrs), *(f"{side}_{n}" for side in ("high", "low") for n in spans)]
        found = asof_join(positions, known, ["symbol"], columns=columns, prefix="__bar_")

        def setting(name: str) -> Column:
            default = F.lit(getattr(self, "mode" if name == "trailing_mode" else name))
            return F.coalesce(F.col(name), default) if name in positions.columns else default

        def of_period(kind: str, name: str, periods: list[int]) -> Column:
            chosen = F.raise_error(F.concat(F.lit(f"{name} not among the periods given: "), setting(name).cast("string"))).cast("double")
            for n in periods:
                chosen = F.when(setting(name) == n, F.col(f"__bar_{kind}_{n}")).otherwise(chosen)
            return chosen

        atr, way = of_period("atr", "atr_period", atrs), F.col("direction")
        extreme = F.when(way == 1, of_period("high", "chandelier_period", spans)).otherwise(of_period("low", "chandelier_period", spans))
        price = F.coalesce("current_price", "__bar_close") if "current_price" in positions.columns else F.col("__bar_close")
        hung = extreme - F.when(way == 1, 1.0).otherwise(-1.0) * setting("chandelier_atr_mult") * atr
        stop = F.when(setting("trailing_mode") == "chandelier", hung).otherwise(price - way * setting("atr_mult") * atr)
        return found.select(*positions.columns, stop.alias("new_sl"))


@dataclass
class RiskManager:
    """Defaults of an account, and the risk functions with them."""

    risk_percent: float = 1.0
    account_currency: str | None = "USD"
    leverage: float = 100.0
    min_lot: float = MIN_LOT
    lot_step: float = LOT_STEP
    max_lot: float | None = None

    def size(self, df: DataFrame, infos: DataFrame | None = None, rates: DataFrame | None = None) -> DataFrame:
        """Lots of df(symbol, equity, sl_pips) at the account's risk."""
        out = with_pip_value(with_symbol_info(df, infos=infos), 1.0, self.account_currency, rates).withColumn("risk_percent", F.lit(self.risk_percent))
        return with_lot_by_risk(out, min_lot=self.min_lot, lot_step=self.lot_step, max_lot=self.max_lot)
