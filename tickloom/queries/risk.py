"""Queries of risk, orders, stops, the simulator and streaming twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions import schema
from tickloom.functions.windows import bar_idx, prev
from tickloom.operators import indicators as ind
from tickloom.operators import observation as obs
from tickloom.operators import risk
from tickloom.operators import simulator as sim
from tickloom.queries import features
from tickloom.queries.base import TRUE_RANGE, bars, bars_sql, events, ewm_sql, indexed_sql, q6, r6, rounded
from tickloom.queries.levels import multi
from tickloom.sources import market

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


B = "WITH RECURSIVE " + bars_sql("H1") + ", " + indexed_sql()
#: Symbols that order lines are read as. Fixed values of these queries.
SYMBOLS = ["EURUSD", "GBPUSD", "USDJPY", "XAUUSD", "AUDUSDm", "GOLD", "usdchf"]
RATES = [("USDJPY", 149.0, 151.0), ("USDCHF", 0.88, 0.9), ("EURUSD", 1.0845, 1.0855)]

_SYM = "['EURUSD', 'GBPUSD', 'USDJPY', 'XAUUSD', 'AUDUSDm', 'GOLD', 'usdchf'][1 + l_orderkey % 7]"
LINES = f"""ln AS (SELECT l_orderkey, l_linenumber, {_SYM} AS symbol, l_quantity / 100 AS volume, l_extendedprice / l_quantity AS price, l_quantity AS sl_pips, upper(regexp_extract({_SYM}, '^([A-Za-z]+)', 1)) AS s FROM lineitem),
i0 AS (SELECT *, CASE WHEN length(s) >= 6 THEN substr(s, 1, 3) WHEN length(s) = 5 THEN substr(s, 1, 2) END AS base, CASE WHEN length(s) >= 6 THEN substr(s, 4, 3) WHEN length(s) = 5 THEN substr(s, 3, 3) END AS quote, s LIKE '%XAU%' OR s LIKE 'GOLD%' AS metal FROM ln),
i1 AS (SELECT *, CASE WHEN coalesce(quote = 'JPY', false) OR metal THEN 0.01::DOUBLE ELSE 0.0001::DOUBLE END AS point, CASE WHEN metal THEN 100.0::DOUBLE ELSE 100000.0::DOUBLE END AS contract_size FROM i0),
i AS (SELECT *, CASE WHEN point < 0.001 THEN point * 10 ELSE point END AS pip FROM i1)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as positions: symbol by order key, volume, price, a stop distance in pips."""
    table = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    symbol = F.element_at(F.array(*map(F.lit, SYMBOLS)), (F.col("l_orderkey") % 7 + 1).cast("int"))
    return table.select("l_orderkey", "l_linenumber", symbol.alias("symbol"), (F.col("l_quantity") / 100).cast("double").alias("volume"), (F.col("l_extendedprice") / F.col("l_quantity")).cast("double").alias("price"), F.col("l_quantity").cast("double").alias("sl_pips"))


@query(f"WITH {LINES} SELECT l_orderkey, l_linenumber, symbol, base, quote, point, contract_size, {q6('pip', 'pip', 8)} FROM i")
def symbol_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = risk.with_symbol_info(lines(spark, sf_dir))
    return out.select("l_orderkey", "l_linenumber", "symbol", "base", "quote", "point", "contract_size", r6("pip", 8).alias("pip"))


_LOT = "CASE WHEN raw <= 0 THEN 0 WHEN raw < 0.005 THEN 0 WHEN raw < 0.01 THEN 0.01 ELSE least(round(floor(raw / 0.01) * 0.01, 8), 50.0) END"


@query(f"""WITH {LINES}, r(p, mid) AS (VALUES ('USDJPY', 150.0::DOUBLE), ('USDCHF', 0.89::DOUBLE), ('EURUSD', 1.085::DOUBLE)),
v AS (SELECT i.*, pip * contract_size * CASE WHEN quote = 'USD' THEN 1.0 ELSE coalesce(d.mid, 1 / n.mid, 1.0) END AS pip_value FROM i LEFT JOIN r d ON d.p = quote || 'USD' LEFT JOIN r n ON n.p = 'USD' || quote),
l AS (SELECT *, 10000.0 * 1 / 100 / (sl_pips * pip_value) AS raw FROM v), z AS (SELECT *, ({_LOT})::DOUBLE AS lot FROM l)
SELECT l_orderkey, l_linenumber, {q6('pip_value')}, {q6('lot')}, {q6('lot * sl_pips * pip_value', 'risk_amount')} FROM z""")
def lot_by_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = spark.createDataFrame(RATES, "symbol string, bid double, ask double")
    out = risk.RiskManager(max_lot=50.0).size(lines(spark, sf_dir).withColumn("equity", F.lit(10_000.0)), rates=rates)
    return rounded(out, ["l_orderkey", "l_linenumber"], ["pip_value", "lot", "risk_amount"])


@query(f"""WITH {LINES}, m AS (SELECT l_orderkey, sum(volume * contract_size * price / 100) AS used FROM i GROUP BY l_orderkey)
SELECT o_orderkey AS l_orderkey, {q6('o_totalprice * 10', 'balance', 4)}, {q6('coalesce(used, 0)', 'used_margin', 4)}, {q6('greatest(0, o_totalprice * 10 - coalesce(used, 0))', 'free_margin', 4)} FROM orders LEFT JOIN m ON o_orderkey = l_orderkey""")
def margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") * 10).alias("balance"))
    out = risk.margins(risk.with_symbol_info(lines(spark, sf_dir)), accounts, ["l_orderkey"])
    return rounded(out, ["l_orderkey"], ["balance", "used_margin", "free_margin"], 4)


@query(f"""WITH {LINES}, o AS (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE -1 END AS way, price * 0.999 AS bid, price * 1.001 AS ask FROM i WHERE volume > 0)
SELECT l_orderkey, l_linenumber, CASE WHEN way = 1 THEN 'BUY' ELSE 'SELL' END AS order_type, {q6('CASE WHEN way = 1 THEN ask ELSE bid END', 'price', 9)}, {q6('CASE WHEN way = 1 THEN ask ELSE bid END - way * sl_pips * pip', 'sl', 9)}, {q6('CASE WHEN way = 1 THEN ask ELSE bid END + way * sl_pips * 2 * pip', 'tp', 9)}, 20 AS deviation, 123456 AS magic FROM o""")
def order_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = risk.with_symbol_info(lines(spark, sf_dir)).withColumns(
        {"side": F.when(F.col("l_linenumber") % 2 == 0, "buy").otherwise("sell"), "bid": F.col("price") * 0.999, "ask": F.col("price") * 1.001, "tp_pips": F.col("sl_pips") * 2, "lot": F.col("volume")}
    )
    return rounded(risk.order_requests(orders), ["l_orderkey", "l_linenumber"], ["order_type", "price", "sl", "tp", "deviation", "magic"], 9)


@query(f"""WITH {LINES} SELECT l_orderkey * 10 + l_linenumber AS ticket, symbol, volume, CASE WHEN l_linenumber % 2 = 0 THEN 'SELL' ELSE 'BUY' END AS order_type, {q6('CASE WHEN l_linenumber % 2 = 0 THEN price * 0.999 ELSE price * 1.001 END', 'price', 9)}, 'deal' AS action, 20 AS deviation, 123456 AS magic FROM i""")
def close_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = lines(spark, sf_dir).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("ticket"), "symbol", "volume", (F.col("l_linenumber") % 2).alias("type"), (F.col("price") * 0.999).alias("bid"), (F.col("price") * 1.001).alias("ask"))
    return risk.close_requests(held).withColumn("price", r6("price", 9))


def held_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as open positions: bought on even line numbers, a bid and an ask around the price."""
    kinds = {"type": F.col("l_linenumber") % 2, "price_open": F.col("price"), "bid": F.col("price") * 0.998, "ask": F.col("price") * 1.003}
    return lines(spark, sf_dir).withColumns(kinds)


@query(f"""WITH {LINES} SELECT l_orderkey * 10 + l_linenumber AS ticket, symbol, {q6("least(volume, CASE WHEN l_linenumber % 3 = 0 THEN volume ELSE 0.02 * (l_linenumber - 1) END)", 'volume', 9)}, CASE WHEN l_linenumber % 2 = 0 THEN 'SELL' ELSE 'BUY' END AS order_type
FROM i WHERE least(volume, CASE WHEN l_linenumber % 3 = 0 THEN volume ELSE 0.02 * (l_linenumber - 1) END) > 0""")
def partial_close_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("l_linenumber") % 3 != 0, (F.col("l_linenumber") - 1) * 0.02)
    held = held_lines(spark, sf_dir).withColumns({"ticket": (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long"), "close_volume": part})
    return rounded(risk.close_requests(held), ["ticket", "symbol"], ["volume", "order_type"], 9)


@query(f"""WITH {LINES}, p AS (SELECT l_orderkey, sum(CASE WHEN l_linenumber % 2 = 0 THEN price * 0.998 - price ELSE price - price * 1.003 END * volume * contract_size) AS profit, count(*) AS n FROM i GROUP BY l_orderkey)
SELECT o_orderkey AS l_orderkey, {q6('o_totalprice * 10', 'balance', 4)}, {q6('coalesce(profit, 0)', 'profit', 2)}, coalesce(n, 0) AS n_positions, {q6('o_totalprice * 10 + coalesce(profit, 0)', 'equity', 2)} FROM orders LEFT JOIN p ON o_orderkey = l_orderkey""")
def account_equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    accounts = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice") * 10).alias("balance"))
    out = risk.account_equity(risk.with_symbol_info(held_lines(spark, sf_dir)), accounts, ["l_orderkey"])
    return out.select("l_orderkey", r6("balance", 4).alias("balance"), r6("profit", 2).alias("profit"), "n_positions", r6("equity", 2).alias("equity"))


@query(f"""WITH {bars_sql('M30', 'b')}, h AS (SELECT symbol, ts, hour(ts) AS h, isodow(ts) - 1 AS d, minute(ts) AS m, lead(ts) OVER (PARTITION BY symbol ORDER BY ts) AS nx FROM b)
SELECT symbol, ts, {q6('h / 23', 'hour_norm')}, {q6('sin(2 * pi() * h / 24)', 'hour_sin')}, {q6('cos(2 * pi() * h / 24)', 'hour_cos')}, {q6('d / 6', 'dow_norm')}, {q6('sin(2 * pi() * d / 7)', 'dow_sin')}, {q6('cos(2 * pi() * d / 7)', 'dow_cos')}, {q6('m / 59', 'min_norm')},
 (h >= 7 AND h < 16)::INT::DOUBLE AS is_london, (h >= 12 AND h < 20)::INT::DOUBLE AS is_newyork, (h < 7 OR h >= 16)::INT::DOUBLE AS is_asia,
 coalesce(date_trunc('day', ts) <> date_trunc('day', nx), true) AS is_eod, coalesce(date_trunc('week', ts) <> date_trunc('week', nx), true) AS is_eow, coalesce(date_trunc('month', ts) <> date_trunc('month', nx), true) AS is_eom FROM h""")
def time_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = risk.calendar_flags(risk.time_features(bars(spark, sf_dir, "M30")))
    return rounded(out, ["symbol", "ts"], ["hour_norm", "hour_sin", "hour_cos", "dow_norm", "dow_sin", "dow_cos", "min_norm", "is_london", "is_newyork", "is_asia", "is_eod", "is_eow", "is_eom"])


@query(f"""{B}, m AS MATERIALIZED (SELECT *, {TRUE_RANGE} AS tr FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts)), {ewm_sql('t', 'm', 'tr', 1 / 14, 1)}
SELECT symbol, ts, {q6('max(high) OVER f - 3 * t.y', 'stop_long')}, {q6('min(low) OVER f + 3 * t.y', 'stop_short')}, {q6('close - 1.5 * t.y', 'atr_stop_long')}, {q6('close + 1.5 * t.y', 'atr_stop_short')} FROM m JOIN t USING (symbol, rn)
WINDOW f AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)""")
def trailing_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = risk.TrailingStop().add_to_bars(bars(spark, sf_dir))
    other = risk.TrailingStop(mode="atr").add_to_bars(out.withColumnsRenamed({"stop_long": "l", "stop_short": "s"}))
    other = other.withColumnsRenamed({"stop_long": "atr_stop_long", "stop_short": "atr_stop_short", "l": "stop_long", "s": "stop_short"})
    return rounded(other, ["symbol", "ts"], ["stop_long", "stop_short", "atr_stop_long", "atr_stop_short"])


@query(f"""{B}, m AS MATERIALIZED (SELECT *, {TRUE_RANGE} AS tr FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts)), {ewm_sql('t', 'm', 'tr', 1 / 14, 1)}, {ewm_sql('t7', 'm', 'tr', 1 / 7, 1)},
k AS (SELECT symbol, ts, close, t.y AS a14, t7.y AS a7, max(high) OVER f22 AS h22, min(low) OVER f22 AS l22, max(high) OVER f10 AS h10, min(low) OVER f10 AS l10 FROM m JOIN t USING (symbol, rn) JOIN t7 USING (symbol, rn)
WINDOW f22 AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 21 PRECEDING AND CURRENT ROW), f10 AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
p AS (SELECT event_id, event_type AS symbol, ts, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS way, event_id % 3 = 0 AS by_atr, event_id % 5 = 0 AS quick FROM events WHERE value IS NOT NULL)
SELECT p.event_id, {q6("CASE WHEN by_atr THEN close - way * 1.5 * CASE WHEN quick THEN a7 ELSE a14 END ELSE CASE WHEN way = 1 THEN CASE WHEN quick THEN h10 ELSE h22 END ELSE CASE WHEN quick THEN l10 ELSE l22 END END - way * CASE WHEN quick THEN 2.0 ELSE 3.0 END * CASE WHEN quick THEN a7 ELSE a14 END END", 'new_sl')}
FROM p ASOF LEFT JOIN k ON p.symbol = k.symbol AND p.ts >= k.ts""")
def position_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    quick = lambda value: F.when(n % 5 == 0, value)
    held = events(spark, sf_dir).where("price IS NOT NULL").select(F.col("seq").alias("event_id"), "symbol", "ts")
    held = held.withColumns({"direction": F.when(n % 2 == 0, 1).otherwise(-1), "trailing_mode": F.when(n % 3 == 0, "atr"), "atr_period": quick(7), "chandelier_period": quick(10), "chandelier_atr_mult": quick(2.0)})
    return rounded(risk.TrailingStop().position_stops(held, bars(spark, sf_dir), [7], [10]), ["event_id"], ["new_sl"])


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions from crossings: buy and sell with stops and targets, close the last position 12 bars after a crossing."""
    crossed = ind.ma_cross(bars(spark, sf_dir))
    crossed = risk.TrailingStop().add_to_bars(crossed)
    signal = F.col("ma_cross_signal")
    action = F.when(signal > 0, 1).when(signal < 0, 2).when(F.coalesce(prev("ma_cross_signal", 12), F.lit(0.0)) != 0, 3).otherwise(0)
    return crossed.select("symbol", "tf", "ts", F.col("close").alias("price"), action.alias("action"), F.lit(0.5).alias("volume"), F.lit(2000.0).alias("sl"), F.lit(4000.0).alias("tp"), (bar_idx() % 2).cast("int").alias("trailing"), (bar_idx() % 3 == 0).cast("int").alias("riskfree"), "stop_long", "stop_short")


#: One step of every series' account at a time, for SimulatorConfig's defaults: act, mark, move stops, count. A stop of a buy only
#: rises and one of a sell only falls, so the stop is the best of the old one and all new ones; greatest skips NULLs.
_HELD = "STRUCT(entry DOUBLE, volume DOUBLE, way INT, sl DOUBLE, tp DOUBLE, trails BOOLEAN, secure BOOLEAN)[]"
_STOP = """p.way * greatest(p.way * p.sl, CASE WHEN p.secure AND p.gain >= 0.005::DOUBLE * (p.entry * p.volume) THEN p.way * p.entry END,
    CASE WHEN p.trails THEN CASE WHEN CASE WHEN p.way = 1 THEN stop_long ELSE stop_short END IS NOT NULL THEN p.way * CASE WHEN p.way = 1 THEN stop_long ELSE stop_short END
      WHEN p.gain >= 0.01::DOUBLE * (p.entry * p.volume) THEN p.way * (price - p.way * 0.005::DOUBLE * price) END END)"""
SIMULATED = f"""{features.cross_sql(1, 3)}, m AS MATERIALIZED (SELECT *, {TRUE_RANGE} AS tr FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts)), {ewm_sql('t', 'm', 'tr', 1 / 14, 1)},
st AS MATERIALIZED (SELECT m.symbol, m.rn, m.ts, m.close AS price, CASE WHEN kept > 0 THEN 1 WHEN kept < 0 THEN 2 WHEN coalesce(lag(kept, 12) OVER (PARTITION BY m.symbol ORDER BY m.rn), 0) <> 0 THEN 3 ELSE 0 END AS action,
  (m.rn - 1) % 2 = 1 AS trails, (m.rn - 1) % 3 = 0 AS secure, max(high) OVER f - 3 * t.y AS stop_long, min(low) OVER f + 3 * t.y AS stop_short
  FROM m JOIN t USING (symbol, rn) JOIN k USING (symbol, rn) WINDOW f AS (PARTITION BY m.symbol ORDER BY m.rn ROWS BETWEEN 21 PRECEDING AND CURRENT ROW)),
ac AS (SELECT DISTINCT symbol, 0::BIGINT AS rn, 10000.0::DOUBLE AS balance, 10000.0::DOUBLE AS equity, 0.0::DOUBLE AS realized, 0::BIGINT AS opened, 0::BIGINT AS closed, 0.0::DOUBLE AS reward, false AS done, []::{_HELD} AS held FROM st
 UNION ALL
 SELECT symbol, rn, nb, ne, CASE WHEN ended THEN 0.0 ELSE gain + shut END, CASE WHEN NOT ended AND action IN (1, 2) THEN 1 ELSE 0 END, CASE WHEN ended THEN 0 ELSE popped + len(gone) END, CASE WHEN ended THEN 0.0 ELSE ne - equity END,
  ended OR nb <= 0 OR 10000 - ne > 2000, CASE WHEN ended THEN held ELSE list_transform(stay, lambda p: struct_pack(entry := p.entry, volume := p.volume, way := p.way, sl := {_STOP}, tp := p.tp, trails := p.trails, secure := p.secure))::{_HELD} END
 FROM (SELECT *, CASE WHEN ended THEN balance ELSE balance + gain + shut END AS nb, CASE WHEN ended THEN equity ELSE balance + gain + shut + coalesce(list_sum(list_transform(stay, lambda p: p.gain)), 0.0) END AS ne
 FROM (SELECT *, coalesce(list_sum(list_transform(gone, lambda p: p.gain)), 0.0) AS shut
 FROM (SELECT *, list_filter(seen, lambda p: p.leaves) AS gone, list_filter(seen, lambda p: NOT p.leaves) AS stay
 FROM (SELECT *, list_transform(mine, lambda p: struct_pack(entry := p.entry, volume := p.volume, way := p.way, sl := p.sl, tp := p.tp, trails := p.trails, secure := p.secure, gain := p.way * (price - p.entry) * p.volume,
    leaves := coalesce(p.way * (price - p.tp) >= 0, false) OR coalesce(p.way * (price - p.sl) <= 0, false))) AS seen
 FROM (SELECT *, CASE WHEN popped = 1 THEN held[-1].way * (price - held[-1].entry) * held[-1].volume ELSE 0.0 END AS gain,
   CASE WHEN popped = 1 THEN list_slice(held, 1, len(held) - 1) WHEN action IN (1, 2) THEN list_append(held, struct_pack(entry := price, volume := 0.5::DOUBLE, way := way, sl := price - way * 2000.0::DOUBLE * 0.01::DOUBLE, tp := price + way * 4000.0::DOUBLE * 0.01::DOUBLE, trails := trails, secure := secure))
    ELSE held END::{_HELD} AS mine
 FROM (SELECT st.*, CASE WHEN action = 1 THEN 1 ELSE -1 END AS way, balance, equity, ac.done AS ended, held, CASE WHEN NOT ac.done AND action = 3 AND len(held) > 0 THEN 1 ELSE 0 END AS popped
 FROM ac JOIN st ON st.symbol = ac.symbol AND st.rn = ac.rn + 1))))))),
sm AS MATERIALIZED (SELECT symbol, ts, st.rn, price, action, balance, equity, len(held)::BIGINT AS n_positions, coalesce(list_sum(list_transform(held, lambda p: p.way * p.volume)), 0.0) AS net_volume, realized, opened, closed, reward, done FROM ac JOIN st USING (symbol, rn))"""


@query(f"""{SIMULATED} SELECT symbol, 'H1' AS tf, ts, {q6('price')}, action, {q6('balance')}, {q6('equity')}, n_positions, {q6('net_volume')}, {q6('realized')}, opened, closed, {q6('reward')}, done FROM sm""")
def simulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sim.simulate(steps(spark, sf_dir)), ["symbol", "tf", "ts"], ["price", "action", "balance", "equity", "n_positions", "net_volume", "realized", "opened", "closed", "reward", "done"])


@query(f"""{SIMULATED}, pk AS (SELECT *, greatest(10000.0::DOUBLE, max(equity) OVER w) - equity AS dd, equity / coalesce(lag(equity) OVER w, 10000.0::DOUBLE) - 1 AS r FROM sm WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
pm AS (SELECT symbol, count(*) AS steps, last(equity ORDER BY ts) - 10000 AS net_profit, sum(closed)::BIGINT AS trades, coalesce(count(*) FILTER (realized > 0) / nullif(count(*) FILTER (realized <> 0), 0), 0.0) AS win_rate,
 coalesce(sum(realized) / nullif(count(*) FILTER (realized <> 0), 0), 0.0) AS expectancy, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252.0), 0.0) AS sharpe, max(dd) AS max_drawdown,
 CASE WHEN last(equity ORDER BY ts) > 0 THEN pow(last(equity ORDER BY ts) / 10000, 252.0::DOUBLE / count(*)) - 1 END AS cagr, sum(reward) AS total_reward FROM pk GROUP BY symbol)
SELECT symbol, 'H1' AS tf, steps, {q6('net_profit')}, trades, {q6('win_rate')}, {q6('expectancy')}, {q6('sharpe')}, {q6('max_drawdown')}, {q6('cagr')}, {q6('total_reward')}, {q6('net_profit + sharpe - max_drawdown', 'mixed_reward')} FROM pm""")
def simulator_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sim.mixed_reward(sim.performance(sim.simulate(steps(spark, sf_dir))))
    return rounded(out, ["symbol", "tf"], ["steps", "net_profit", "trades", "win_rate", "expectancy", "sharpe", "max_drawdown", "cagr", "total_reward", "mixed_reward"])


@query(f"""WITH {bars_sql('D1', 'd1')}, s AS (SELECT symbol, ts, close, row_number() OVER w AS n, greatest(10000.0, max(close * 100) OVER w) - close * 100 AS dd, close * 100 / coalesce(lag(close * 100) OVER w, 10000.0) - 1 AS r FROM d1 WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, count(*) AS steps, {q6('last(close ORDER BY ts) * 100 - 10000', 'net_profit')}, {q6('max(dd)', 'max_drawdown')}, {q6('avg(r) / stddev_samp(r) * sqrt(252)', 'sharpe')}, {q6('pow(last(close ORDER BY ts) * 100 / 10000, 252 / count(*)) - 1', 'cagr', 4)} FROM s GROUP BY symbol""")
def performance_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    equity = bars(spark, sf_dir, "D1").select("symbol", "tf", "ts", (F.col("close") * 100).alias("equity"), F.lit(0).alias("closed"), F.lit(0.0).alias("realized"), F.lit(0.0).alias("reward"))
    out = sim.performance(equity)
    return out.select("symbol", "steps", r6("net_profit").alias("net_profit"), r6("max_drawdown").alias("max_drawdown"), r6("sharpe").alias("sharpe"), r6("cagr", 4).alias("cagr"))


@query()
def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = multi(spark, sf_dir)
    states = sim.simulate(steps(spark, sf_dir)).select("symbol", "tf", "ts", "price", "balance", "equity", "n_positions", "net_volume")
    return obs.observations(states, frames, 15)


@query(f"""{B}, lv AS (SELECT symbol, last(close ORDER BY ts) AS price FROM bars GROUP BY symbol, date_trunc('day', ts))
SELECT symbol, ts, {q6('close - (SELECT max(price) FROM lv WHERE lv.symbol = bars.symbol AND price <= close)', 'support_gap')}, {q6('(SELECT min(price) FROM lv WHERE lv.symbol = bars.symbol AND price >= close) - close', 'resistance_gap')} FROM bars""")
def nearest_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = obs.nearest_levels(bars(spark, sf_dir).select("symbol", "ts", F.col("close").alias("price")), bars(spark, sf_dir, "D1").select("symbol", F.col("close").alias("price")))
    return rounded(out, ["symbol", "ts"], ["support_gap", "resistance_gap"])


@query(f"WITH {bars_sql('H1')}, t AS (SELECT * FROM bars UNION ALL SELECT * FROM bars WHERE tick_volume % 5 = 0) SELECT symbol, tf, ts, count(*) AS n FROM t GROUP BY symbol, tf, ts HAVING count(*) > 1")
def duplicate_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = bars(spark, sf_dir)
    return schema.duplicate_bars(once.unionByName(once.where("tick_volume % 5 = 0")))


@query(f"""WITH {bars_sql('D1')} SELECT coalesce(close, 0.0) AS price, 'fib' AS label, 0.0::DOUBLE AS strength FROM bars""")
def plot_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.plot_annotations(bars(spark, sf_dir, "D1").select(F.col("close").alias("price")))
