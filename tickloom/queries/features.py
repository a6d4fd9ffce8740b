"""Queries of bars, indicators and feature pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.windows import bar_idx, last_known
from tickloom.operators import bars as bar_ops
from tickloom.operators import indicators as ind
from tickloom.plans.pipeline import build_features, default_specs
from tickloom.queries.base import TRUE_RANGE, bars, bars_sql, ewm_sql, indexed_sql, orders, q6, r6, roll_sql, rounded

KEYS = ["symbol", "ts"]
B = "WITH RECURSIVE " + bars_sql("H1") + ", " + indexed_sql()
QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def _bars_query(tf: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return bars(spark, sf_dir, tf)

    run.__name__ = f"bars_{tf.lower()}"
    query(f"WITH {bars_sql(tf)} SELECT * FROM bars")(run)


for _tf in ("M5", "H1", "H4", "D1", "W1"):
    _bars_query(_tf)


@query(f"WITH {bars_sql('D1', ticks='SELECT o_orderpriority AS symbol, o_orderdate AS ts, o_totalprice AS price, o_orderkey AS seq FROM orders')} SELECT * FROM bars")
def bars_orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_ops.resample_ticks(orders(spark, sf_dir), "D1")


@query(f"""WITH {bars_sql('M5', 'm5')}
SELECT symbol, 'H4' AS tf, time_bucket(INTERVAL 4 HOUR, ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low,
       last(close ORDER BY ts) AS close, sum(tick_volume)::BIGINT AS tick_volume, max(spread) AS spread
FROM m5 GROUP BY symbol, time_bucket(INTERVAL 4 HOUR, ts)""")
def bars_from_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_ops.resample_bars(bars(spark, sf_dir, "M5"), "H4")


@query(f"WITH {bars_sql('H1')} SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100")
def last_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_ops.last_bars(bars(spark, sf_dir), 100)


@query(f"WITH {bars_sql('H1')} SELECT * FROM bars WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20 12:00:00'")
def candles_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_ops.bars_between(bars(spark, sf_dir), "2024-01-05", "2024-01-20 12:00:00")


@query(f"""WITH {bars_sql('D1')}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM bars),
s AS (SELECT symbol, tf, unnest(range(1, 41)) AS slot FROM (SELECT DISTINCT symbol, tf FROM bars))
SELECT s.symbol, s.tf, s.slot, r.ts, r.open, r.high, r.low, r.close, r.tick_volume, r.spread FROM s LEFT JOIN r ON r.symbol = s.symbol AND s.slot = 41 - r.back""")
def padded_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_ops.padded(bars(spark, sf_dir, "D1"), 40)


@query(f"WITH {bars_sql('H1')} SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1")
def latest_candle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_ops.latest_bar(bars(spark, sf_dir))


@query(f"WITH {bars_sql('H1')} SELECT * FROM bars WHERE ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-15 10:30:00' QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 50")
def closed_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bar_ops.closed_bars(bars(spark, sf_dir), F.lit("2024-01-15 10:30:00").cast("timestamp_ntz"), 50)


@query(f"""{B} SELECT symbol, ts, {q6("open / last(close) OVER v", "norm_open")}, {q6("high / last(close) OVER v", "norm_high")}, {q6("low / last(close) OVER v", "norm_low")}, {q6("close / last(close) OVER v", "norm_close")},
  {q6("CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END", "log_return")}, rn - 1 AS bar_idx
FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts), v AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def normalised_and_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bar_ops.log_return(bar_ops.scaled_by_last_close(bars(spark, sf_dir))).withColumn("bar_idx", bar_idx())
    return rounded(out, KEYS, ["norm_open", "norm_high", "norm_low", "norm_close", "log_return", "bar_idx"])


@query(f"""{B} SELECT symbol, ts, last_value(CASE WHEN tick_volume % 3 = 0 THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS filled,
  coalesce(CASE WHEN tick_volume % 3 = 0 THEN close END, 0.0) AS zeroed FROM n""")
def missing_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = bars(spark, sf_dir).withColumn("zeroed", F.when(F.col("tick_volume") % 3 == 0, F.col("close")))
    return bar_ops.filled(some.withColumn("filled", last_known("zeroed")), ["zeroed"]).select(*KEYS, "filled", "zeroed")


@query(f"""{B}, {indexed_sql(f"{roll_sql('avg', 'close', 20)} AS m, {roll_sql('stddev_pop', 'close', 20)} AS s", "(SELECT * EXCLUDE rn, rn FROM n)", "b").replace("row_number() OVER w AS rn, ", "").replace(" WINDOW w AS (PARTITION BY symbol ORDER BY ts)", "")}
SELECT symbol, ts, {q6("m", "bb_mid_20")}, {q6("m + 2 * s", "bb_upper_20_2")}, {q6("m - 2 * s", "bb_lower_20_2")}, {q6("CASE WHEN m <> 0 THEN (m + 2 * s - (m - 2 * s)) / m END", "bb_width_20_2")} FROM b""")
def bollinger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.bollinger_bands(bars(spark, sf_dir)), KEYS, ["bb_mid_20", "bb_upper_20_2", "bb_lower_20_2", "bb_width_20_2"])


@query(f"""{B}, k AS (SELECT *, {roll_sql('min', 'low', 14)} AS lo, {roll_sql('max', 'high', 14)} AS hi FROM n),
k1 AS (SELECT symbol, ts, rn, CASE WHEN hi <> lo THEN (close - lo) / (hi - lo) * 100 END AS k FROM k),
k2 AS (SELECT *, {roll_sql('avg', 'k', 3)} AS ks FROM k1), k3 AS (SELECT *, {roll_sql('avg', 'ks', 3)} AS d FROM k2)
SELECT symbol, ts, {q6("k", "stoch_k")}, {q6("d", "stoch_d")} FROM k3""")
def stochastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ind.stochastic(bars(spark, sf_dir))
    return out.select(*KEYS, r6("%k").alias("stoch_k"), r6("%d").alias("stoch_d"))


@query(f"{B} SELECT symbol, ts, lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS psar FROM n")
def parabolic_sar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.parabolic_sar(bars(spark, sf_dir)).select(*KEYS, "psar")


@query(f"""{B}, f AS (SELECT *, (high + low + close) / 3 AS tp, CASE WHEN high <> low THEN (2 * close - high - low) / (high - low) ELSE 0 END * tick_volume AS fv,
  coalesce(sign(close - lag(close) OVER w), 0) * tick_volume AS sv FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
g AS (SELECT *, CASE WHEN tp > lag(tp) OVER w THEN tp * tick_volume ELSE 0 END AS pos, CASE WHEN tp < lag(tp) OVER w THEN tp * tick_volume ELSE 0 END AS neg,
  sum(sv) OVER w AS obv, sum(fv) OVER w AS adl FROM f WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
h AS (SELECT *, {roll_sql('sum', 'pos', 14)} AS p, {roll_sql('sum', 'neg', 14)} AS q, {roll_sql('sum', 'fv', 20)} AS a, {roll_sql('sum', 'tick_volume', 20)} AS v FROM g)
SELECT symbol, ts, {q6("obv", "obv", 4)}, {q6("adl", "adl", 4)}, {q6("CASE WHEN q <> 0 THEN 100 - 100 / (1 + p / q) END", "mfi_14")}, {q6("coalesce(CASE WHEN v <> 0 THEN a / v END, 0)", "cmf_20")} FROM h""")
def volume_indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ind.cmf(ind.mfi(ind.adl(ind.obv(bars(spark, sf_dir)))))
    return out.select(*KEYS, r6("obv", 4).alias("obv"), r6("adl", 4).alias("adl"), r6("mfi_14").alias("mfi_14"), r6("cmf_20").alias("cmf_20"))


@query(f"""{B}, t AS (SELECT *, (high + low + close) / 3 AS tp FROM n), g AS (SELECT *, tp - {roll_sql('avg', 'tp', 20)} AS gap FROM t), h AS (SELECT *, abs(gap) AS ag FROM g),
m AS (SELECT *, {roll_sql('avg', 'ag', 20)} AS mad FROM h) SELECT symbol, ts, {q6("CASE WHEN mad <> 0 THEN gap / (0.015 * mad) END", "cci_20", 4)} FROM m""")
def cci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.cci(bars(spark, sf_dir)).select(*KEYS, r6("cci_20", 4).alias("cci_20"))


@query(f"""{B}, c AS (SELECT *, lag(open) OVER w AS po, lag(close) OVER w AS pc, abs(close - open) AS body, high - greatest(open, close) AS up, least(open, close) - low AS lo
  FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, coalesce(CASE WHEN high <> low THEN body / (high - low) END <= 0.1, false) AS pattern_doji, lo >= 2 * body AND up <= 0.5 * body AS pattern_hammer,
  up >= 2 * body AND lo <= 0.5 * body AS pattern_shooting_star, coalesce(pc < po AND close > open AND close > po AND open < pc, false) AS pattern_bull_engulf,
  coalesce(pc > po AND close < open AND open > pc AND close < po, false) AS pattern_bear_engulf FROM c""")
def candlestick_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ind.candlestick_patterns(bars(spark, sf_dir))
    return out.select(*KEYS, *(c for c in out.columns if c.startswith("pattern_")))


def _mean(name: str, x: str, period: int, least: int | None = None, source: str = "n") -> str:
    return ewm_sql(name, source, x, 2.0 / (period + 1.0), period if least is None else least)


@query(f"{B}, {_mean('a', 'close', 50)}, {_mean('b', 'close', 200)} SELECT symbol, ts, {q6('a.y', 'ema_50')}, {q6('b.y', 'ema_200')} FROM n JOIN a USING (symbol, rn) JOIN b USING (symbol, rn)")
def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.ema(ind.ema(bars(spark, sf_dir), 50), 200), KEYS, ["ema_50", "ema_200"])


@query(f"""{B}, {_mean('a', 'close', 12)}, {_mean('b', 'close', 26)}, l AS MATERIALIZED (SELECT symbol, rn, a.y - b.y AS line FROM a JOIN b USING (symbol, rn)), {_mean('s', 'line', 9, source='l')}
SELECT symbol, ts, {q6('line', 'macd_line')}, {q6('s.y', 'macd_signal')}, {q6('line - s.y', 'macd_hist')} FROM n JOIN l USING (symbol, rn) JOIN s USING (symbol, rn)""")
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.macd(bars(spark, sf_dir)), KEYS, ["macd_line", "macd_signal", "macd_hist"])


RSI = f"""d AS MATERIALIZED (SELECT symbol, ts, rn, greatest(close - lag(close) OVER w, 0) AS up, greatest(lag(close) OVER w - close, 0) AS down FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
d2 AS MATERIALIZED (SELECT symbol, ts, rn, CASE WHEN rn > 1 THEN up END AS up, CASE WHEN rn > 1 THEN down END AS down FROM d),
{ewm_sql('g', 'd2', 'up', 1 / 14, 14)}, {ewm_sql('l', 'd2', 'down', 1 / 14, 14)},
x AS MATERIALIZED (SELECT symbol, ts, rn, CASE WHEN l.y <> 0 THEN 100 - 100 / (1 + g.y / l.y) END AS rsi FROM d2 JOIN g USING (symbol, rn) JOIN l USING (symbol, rn))"""


@query(f"""{B}, {RSI}, y AS (SELECT *, {roll_sql('min', 'rsi', 14)} AS lo, {roll_sql('max', 'rsi', 14)} AS hi FROM x),
y1 AS (SELECT *, CASE WHEN hi <> lo THEN (rsi - lo) / (hi - lo) END AS raw FROM y), y2 AS (SELECT *, {roll_sql('avg', 'raw', 3)} * 100 AS k FROM y1), y3 AS (SELECT *, {roll_sql('avg', 'k', 3)} AS dd FROM y2)
SELECT symbol, ts, {q6('rsi', 'rsi_14')}, {q6('k', 'stochrsi_k_14_3')}, {q6('dd', 'stochrsi_d_14_3_3')} FROM y3""")
def rsi_and_stoch_rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.stoch_rsi(ind.rsi(bars(spark, sf_dir))), KEYS, ["rsi_14", "stochrsi_k_14_3", "stochrsi_d_14_3_3"])


ADX = f"""m AS MATERIALIZED (SELECT symbol, ts, rn, close, high, low, {TRUE_RANGE} AS tr, high - lag(high) OVER w AS u, lag(low) OVER w - low AS v FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
m2 AS MATERIALIZED (SELECT *, CASE WHEN u > v AND u > 0 THEN u ELSE 0 END AS pdm, CASE WHEN v > u AND v > 0 THEN v ELSE 0 END AS mdm FROM m),
{ewm_sql('t', 'm2', 'tr', 1 / 14, 14)}, {ewm_sql('p', 'm2', 'pdm', 1 / 14, 14)}, {ewm_sql('q', 'm2', 'mdm', 1 / 14, 14)},
di AS MATERIALIZED (SELECT symbol, rn, ts, t.y AS atr, CASE WHEN t.y <> 0 THEN 100 * p.y / t.y END AS pdi, CASE WHEN t.y <> 0 THEN 100 * q.y / t.y END AS mdi FROM m2 JOIN t USING (symbol, rn) JOIN p USING (symbol, rn) JOIN q USING (symbol, rn)),
dx AS MATERIALIZED (SELECT *, CASE WHEN pdi + mdi <> 0 THEN 100 * abs(pdi - mdi) / (pdi + mdi) END AS dx FROM di), {ewm_sql('ax', 'dx', 'dx', 1 / 14, 14)}"""


@query(f"{B}, {ADX} SELECT symbol, ts, {q6('atr', 'atr_14')}, {q6('pdi', 'plus_di_14')}, {q6('mdi', 'minus_di_14')}, {q6('ax.y', 'adx_14')} FROM dx JOIN ax USING (symbol, rn)")
def atr_and_adx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.adx(ind.atr(bars(spark, sf_dir))), KEYS, ["atr_14", "plus_di_14", "minus_di_14", "adx_14"])


@query(f"""{B}, f AS MATERIALIZED (SELECT *, sum(CASE WHEN high <> low THEN (2 * close - high - low) / (high - low) ELSE 0 END * tick_volume) OVER (PARTITION BY symbol ORDER BY ts) AS adl FROM n),
{_mean('a', 'adl', 3, source='f')}, {_mean('b', 'adl', 10, source='f')} SELECT symbol, ts, {q6('a.y - b.y', 'chaikin_osc_3_10', 4)} FROM n JOIN a USING (symbol, rn) JOIN b USING (symbol, rn)""")
def chaikin_oscillator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.chaikin_oscillator(bars(spark, sf_dir)).select(*KEYS, r6("chaikin_osc_3_10", 4).alias("chaikin_osc_3_10"))


@query(f"""{B}, m AS MATERIALIZED (SELECT *, {TRUE_RANGE} AS tr FROM n WINDOW w AS (PARTITION BY symbol ORDER BY ts)), {ewm_sql('t', 'm', 'tr', 1 / 10, 10)},
u AS MATERIALIZED (SELECT symbol, ts, rn, close, (high + low) / 2 + 3 * t.y AS ub, (high + low) / 2 - 3 * t.y AS lb FROM m JOIN t USING (symbol, rn)),
s AS (SELECT symbol, ts, rn, close, ub AS fu, lb AS fl, NULL::DOUBLE AS st, NULL::DOUBLE AS dir FROM u WHERE rn = 1
 UNION ALL
 SELECT symbol, ts, rn, close, fu, fl,
   CASE WHEN pst IS NULL OR pdir IS NULL THEN CASE WHEN coalesce(close > fu, false) THEN fl ELSE fu END
        WHEN pdir > 0 THEN CASE WHEN close < fl THEN fu ELSE greatest(fl, pst) END ELSE CASE WHEN close > fu THEN fl ELSE least(fu, pst) END END,
   CASE WHEN pst IS NULL OR pdir IS NULL THEN CASE WHEN coalesce(close > fu, false) THEN 1.0 ELSE -1.0 END
        WHEN pdir > 0 THEN CASE WHEN close < fl THEN -1.0 ELSE 1.0 END ELSE CASE WHEN close > fu THEN 1.0 ELSE -1.0 END END
 FROM (SELECT u.symbol, u.ts, u.rn, u.close, CASE WHEN s.close <= s.fu AND u.ub > s.fu THEN s.fu ELSE u.ub END AS fu, CASE WHEN s.close >= s.fl AND u.lb < s.fl THEN s.fl ELSE u.lb END AS fl, s.st AS pst, s.dir AS pdir
       FROM s JOIN u ON u.symbol = s.symbol AND u.rn = s.rn + 1))
SELECT symbol, ts, {q6('st', 'supertrend')}, dir AS supertrend_dir FROM s""")
def supertrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.supertrend(bars(spark, sf_dir)), KEYS, ["supertrend", "supertrend_dir"])


def _month() -> Column:
    """Blocks of a series: its months."""
    return F.date_trunc("month", "ts")


@query(ORACLE_SQL["ema"])
def ema_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ema with each month of a series a task's work."""
    return rounded(ind.ema(ind.ema(bars(spark, sf_dir), 50, block=_month()), 200, block=_month()), KEYS, ["ema_50", "ema_200"])


@query(ORACLE_SQL["macd"])
def macd_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """macd with each month of a series a task's work."""
    return rounded(ind.macd(bars(spark, sf_dir), block=_month()), KEYS, ["macd_line", "macd_signal", "macd_hist"])


@query(ORACLE_SQL["atr_and_adx"])
def atr_and_adx_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """atr_and_adx with each month of a series a task's work."""
    return rounded(ind.adx(ind.atr(bars(spark, sf_dir), block=_month()), block=_month()), KEYS, ["atr_14", "plus_di_14", "minus_di_14", "adx_14"])


@query(ORACLE_SQL["supertrend"])
def supertrend_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supertrend with each month of a series a task's work."""
    return rounded(ind.supertrend(bars(spark, sf_dir), block=_month()), KEYS, ["supertrend", "supertrend_dir"])


@query(f"""{B}, s AS (SELECT *, {roll_sql('avg', 'close', 20)} AS f, {roll_sql('avg', 'close', 50)} AS g FROM n),
z AS (SELECT symbol, ts, f, g, lag(f) OVER w AS pf, lag(g) OVER w AS pg FROM s WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, {q6('f', 'fast_MA')}, {q6('g', 'slow_MA')}, CASE WHEN f > g AND pf <= pg THEN 1 WHEN f < g AND pf >= pg THEN -1 ELSE 0 END::INT AS "MA_Cross_Signal" FROM z""")
def ma_cross_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.moving_average_cross_simple(bars(spark, sf_dir), 20, 50, "SMA"), KEYS, ["fast_MA", "slow_MA", "MA_Cross_Signal"])


def cross_sql(confirm: int, least: int) -> str:
    hold = f"CASE WHEN sig > 0 AND min(d) OVER f > 0 OR sig < 0 AND max(d) OVER f < 0 THEN sig ELSE 0 END" if confirm > 1 else "sig"
    return f"""{B}, {_mean('a', 'close', 12, 1)}, {_mean('b', 'close', 26, 1)}, c AS (SELECT symbol, ts, rn, a.y AS fa, b.y AS sl, a.y - b.y AS d FROM n JOIN a USING (symbol, rn) JOIN b USING (symbol, rn)),
e AS (SELECT *, CASE WHEN lag(sign(d)) OVER w <= 0 AND d > 0 THEN 1.0 WHEN lag(sign(d)) OVER w >= 0 AND d < 0 THEN -1.0 ELSE 0.0 END AS sig FROM c WINDOW w AS (PARTITION BY symbol ORDER BY rn)),
h AS MATERIALIZED (SELECT *, {hold} AS s2 FROM e WINDOW f AS (PARTITION BY symbol ORDER BY rn ROWS BETWEEN CURRENT ROW AND {confirm - 1} FOLLOWING)),
k AS (SELECT symbol, rn, 0.0::DOUBLE AS kept, -9999::BIGINT AS last FROM h WHERE rn = 1 UNION ALL
  SELECT h.symbol, h.rn, CASE WHEN h.s2 <> 0 AND h.rn - k.last > {least} THEN h.s2 ELSE 0.0 END, CASE WHEN h.s2 <> 0 AND h.rn - k.last > {least} THEN h.rn ELSE k.last END
  FROM k JOIN h ON h.symbol = k.symbol AND h.rn = k.rn + 1)"""


@query(f"{cross_sql(2, 3)} SELECT h.symbol, ts, {q6('fa', 'ma_fast_12')}, {q6('sl', 'ma_slow_26')}, {q6('d', 'ma_diff_12_26')}, kept AS ma_cross_signal, (kept > 0)::INT AS buy_signal, (kept < 0)::INT AS sell_signal FROM h JOIN k USING (symbol, rn)")
def ma_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    cross = ind.MovingAverageCross(confirm_bars=2)
    out = cross.as_binary_cols(cross.add_to_df(bars(spark, sf_dir)))
    return rounded(out, KEYS, ["ma_fast_12", "ma_slow_26", "ma_diff_12_26", "ma_cross_signal", "buy_signal", "sell_signal"])


@query(f"{cross_sql(1, 3)} SELECT h.symbol, 'H1' AS tf, ts, close, {q6('fa', 'ma_fast_12')}, {q6('sl', 'ma_slow_26')}, kept AS ma_cross_signal FROM h JOIN k USING (symbol, rn) JOIN n USING (symbol, rn, ts) WHERE kept <> 0")
def ma_cross_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    cross = ind.MovingAverageCross()
    return rounded(cross.cross_points(cross.add_to_df(bars(spark, sf_dir))), ["symbol", "tf", "ts"], ["close", "ma_fast_12", "ma_slow_26", "ma_cross_signal"])


@query(f"{cross_sql(1, 3)} SELECT symbol, 'H1' AS tf, arg_max(kept, rn) AS ma_cross_signal FROM k GROUP BY symbol")
def ma_cross_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    cross = ind.MovingAverageCross()
    return cross.last_signal(cross.add_to_df(bars(spark, sf_dir)))


@query(f"""{cross_sql(1, 3)}, sd AS (SELECT h.symbol, h.ts, kept, d, {roll_sql('stddev_samp', 'd', 26)} AS s FROM h JOIN k USING (symbol, rn))
SELECT symbol, ts, {q6("kept * coalesce(CASE WHEN s <> 0 THEN d / s END, 0)", "ma_cross_signal")} FROM sd""")
def ma_cross_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.ma_cross(bars(spark, sf_dir), magnitude=True), KEYS, ["ma_cross_signal"])


_EDGE = "(PARTITION BY symbol ORDER BY rn ROWS BETWEEN {})"


def _extreme_sql(x: str, low: bool, order: int = 5) -> str:
    a, b = _EDGE.format(f"{order} PRECEDING AND 1 PRECEDING"), _EDGE.format(f"1 FOLLOWING AND {order} FOLLOWING")
    f, s = ("min", "<") if low else ("max", ">")
    return f"coalesce({x} {s} {f}({x}) OVER {a} AND {x} {s} {f}({x}) OVER {b} AND count({x}) OVER {a} = count(*) OVER {a} AND count({x}) OVER {b} = count(*) OVER {b}, false)"


@query(f"""{B}, {RSI}, e AS (SELECT symbol, n.ts, rn, close, rsi, {_extreme_sql('close', True)} AS pmin, {_extreme_sql('close', False)} AS pmax, {_extreme_sql('rsi', True)} AS imin, {_extreme_sql('rsi', False)} AS imax FROM n JOIN x USING (symbol, rn)),
z AS (SELECT *, last_value(CASE WHEN imin THEN close END IGNORE NULLS) OVER w AS lp, last_value(CASE WHEN imin THEN rsi END IGNORE NULLS) OVER w AS li,
  last_value(CASE WHEN imax THEN close END IGNORE NULLS) OVER w AS hp, last_value(CASE WHEN imax THEN rsi END IGNORE NULLS) OVER w AS hi FROM e WINDOW w AS (PARTITION BY symbol ORDER BY rn))
SELECT symbol, ts, coalesce(pmin AND (lp - close) / lp > 0 AND (rsi - li) / li > 0.001, false) AS rsi_14_bullish_divergence, coalesce(pmax AND (close - hp) / hp > 0 AND (hi - rsi) / hi > 0.001, false) AS rsi_14_bearish_divergence FROM z""")
def divergences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ind.detect_divergences_extrema(ind.rsi(bars(spark, sf_dir)), ["rsi_14"])
    return out.select(*KEYS, *(c for c in out.columns if "divergence" in c))


_RANGE = f"WITH {bars_sql('H1')}, r AS (SELECT symbol, tf, max(high) AS hi, min(low) AS lo FROM (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 100) GROUP BY symbol, tf HAVING count(*) >= 100)"


@query(f'{_RANGE} SELECT symbol, tf, l::DOUBLE AS "Level", {q6("hi - (hi - lo) * l", "Price")} FROM r, unnest([0.236, 0.382, 0.5, 0.618, 0.786]) AS u(l)')
def fibonacci_retracement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.fibonacci_retracement(bars(spark, sf_dir)), ["symbol", "tf"], ["Level", "Price"])


@query(f"""{_RANGE}, a AS (SELECT symbol, tf, 'Retracement' AS "Type", l::DOUBLE AS "Level", hi - (hi - lo) * l AS p FROM r, unnest([0.236, 0.382, 0.5, 0.618, 0.786]) AS u(l)
UNION ALL SELECT symbol, tf, 'Extension', l::DOUBLE, hi + (hi - lo) * (l - 1) FROM r, unnest([1.272, 1.618, 2.0]) AS u(l))
SELECT symbol, tf, "Type", "Level", {q6("p", "Price")}, row_number() OVER (PARTITION BY symbol ORDER BY p DESC, "Level") AS rank FROM a""")
def fibonacci_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ind.fibonacci_levels(bars(spark, sf_dir)), ["symbol", "tf"], ["Type", "Level", "Price", "rank"])


@query(f"""{B}, {RSI}, {_mean('a', 'close', 50)}, v AS (SELECT symbol, n.ts, rsi, close, a.y AS ema,
  CASE WHEN rsi < 30 AND close > a.y THEN 'buy' WHEN rsi > 70 AND close < a.y THEN 'sell' ELSE 'hold' END AS rule_signal FROM n JOIN x USING (symbol, rn) JOIN a USING (symbol, rn))
SELECT symbol, ts, rule_signal, {q6("coalesce(sign(close - ema), 0) * 0.4 + coalesce(sign(rsi - 50), 0) * 0.3 + sign(50 - coalesce(rsi, 50)) * 0.3", "vote")} FROM v""")
def rules_and_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ind.rule_signal(ind.ema(ind.rsi(bars(spark, sf_dir)), 50), "rsi_14", "ema_50")
    out = out.withColumns({"trend": F.signum(F.col("close") - F.col("ema_50")), "momentum": F.signum(F.col("rsi_14") - 50), "revert": F.signum(50 - F.coalesce("rsi_14", F.lit(50.0)))})
    return rounded(ind.weighted_vote(out, {"trend": 0.4, "momentum": 0.3, "revert": 0.3}), KEYS, ["rule_signal", "vote"])


@query(f"""{B}, {_mean('e50', 'close', 50)}, {_mean('e200', 'close', 200)}, {RSI}, {ADX}, c AS (SELECT symbol, rn, {roll_sql('avg', 'close', 20)} AS mid FROM n)
SELECT symbol, n.ts, {q6('e50.y', 'ema_50')}, {q6('e200.y', 'ema_200')}, {q6('rsi', 'rsi_14')}, {q6('atr', 'atr_14')}, {q6('ax.y', 'adx_14')}, {q6('mid', 'bb_mid_20')}
FROM n JOIN e50 USING (symbol, rn) JOIN e200 USING (symbol, rn) JOIN x USING (symbol, rn) JOIN dx USING (symbol, rn) JOIN ax USING (symbol, rn) JOIN c USING (symbol, rn)""")
def feature_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = build_features(bars(spark, sf_dir), default_specs(include_supertrend=True))
    return rounded(out, KEYS, ["ema_50", "ema_200", "rsi_14", "atr_14", "adx_14", "bb_mid_20"])


#: Features and the digits to which they are compared, by the query whose SQL has them.
_ALL = {
    "ema": {"ema_50": 6, "ema_200": 6},
    "macd": {"macd_line": 6, "macd_signal": 6, "macd_hist": 6},
    "rsi_and_stoch_rsi": {"rsi_14": 6, "stochrsi_k_14_3": 6, "stochrsi_d_14_3_3": 6},
    "bollinger": {"bb_mid_20": 6, "bb_upper_20_2": 6, "bb_lower_20_2": 6, "bb_width_20_2": 6},
    "volume_indicators": {"obv": 4, "mfi_14": 6},
    "atr_and_adx": {"atr_14": 6, "plus_di_14": 6, "minus_di_14": 6, "adx_14": 6},
    "cci": {"cci_20": 4},
}


def _all_sql() -> str:
    parts = [f"({ORACLE_SQL[name]}) AS {name}_q" for name in (*_ALL, "supertrend")]
    joined = " ".join(f"JOIN {p} USING (symbol, ts)" for p in parts)
    return f"SELECT b.*, {', '.join(c for names in _ALL.values() for c in names)}, supertrend_q.* EXCLUDE (symbol, ts) FROM (WITH {bars_sql('H1')} SELECT * FROM bars) AS b {joined}"


@query(_all_sql())
def feature_pipeline_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = build_features(bars(spark, sf_dir), include_supertrend=True)
    digits = {c: d for names in _ALL.values() for c, d in names.items()}
    plain = {"open", "high", "low", "close"}
    return out.select(*((r6(c, digits.get(c, 6)).alias(c) if k == "double" and c not in plain else F.col(f"`{c}`")) for c, k in out.dtypes))
