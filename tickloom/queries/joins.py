"""Queries of as-of joins, news windows and observation windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import joins
from tickloom.queries.base import bars, bars_sql, events, r6

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


NEWS = "news AS (SELECT ts, CASE WHEN value >= 60 THEN 'high' WHEN value >= 30 THEN 'medium' WHEN value >= 10 THEN 'low' ELSE 'other' END AS impact FROM events WHERE event_type = 'error')"


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as news; impact by value."""
    value = F.col("price")
    impact = F.when(value >= 60, "high").when(value >= 30, "medium").when(value >= 10, "low").otherwise("other")
    return events(spark, sf_dir).where("symbol = 'error'").select("ts", impact.alias("impact"))


@query(f"""WITH {bars_sql('H1', 'h1')}, {bars_sql('D1', 'd1')}
SELECT h1.symbol, h1.ts, h1.close, d.close AS h4_close, d.ts AS h4_asof_ts FROM h1 ASOF LEFT JOIN (SELECT symbol, ts + INTERVAL 6 HOUR AS ts, close FROM d1) d ON h1.symbol = d.symbol AND h1.ts >= d.ts""")
def asof_timeframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = bars(spark, sf_dir, "D1").select("symbol", (F.col("ts") + F.expr("interval 6 hours")).alias("ts"), "close")
    return joins.asof_join(bars(spark, sf_dir).select("symbol", "ts", "close"), late, ["symbol"], columns=["close"], prefix="h4_")


@query(f"""WITH {bars_sql('H1', 'h1')}, e AS (SELECT event_id, event_type AS symbol, ts, value FROM events)
SELECT e.event_id, e.symbol, e.ts, e.value, h1.close AS bar_close, h1.ts AS bar_asof_ts FROM e ASOF LEFT JOIN h1 ON e.symbol = h1.symbol AND e.ts >= h1.ts""")
def asof_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = events(spark, sf_dir).select(F.col("seq").alias("event_id"), "symbol", "ts", F.col("price").alias("value"))
    return joins.asof_join(ticks, bars(spark, sf_dir), ["symbol"], columns=["close"], prefix="bar_")


@query(f"""WITH {bars_sql('H1', 'h1')}, {NEWS} SELECT h1.symbol, h1.ts, coalesce(sum(CASE n.impact WHEN 'low' THEN 1.0 WHEN 'medium' THEN 2.0 WHEN 'high' THEN 3.0 WHEN 'other' THEN 1.0 END), 0)::DOUBLE AS news_risk
FROM h1 LEFT JOIN news n ON n.ts BETWEEN h1.ts - INTERVAL 60 MINUTE AND h1.ts + INTERVAL 60 MINUTE GROUP BY h1.symbol, h1.ts""")
def news_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.news_risk(bars(spark, sf_dir).select("symbol", "ts"), news(spark, sf_dir))


@query(f"""WITH {bars_sql('H1', 'h1')}, {NEWS} SELECT h1.symbol, h1.ts, EXISTS (SELECT 1 FROM news n WHERE n.impact = 'high' AND n.ts BETWEEN h1.ts - INTERVAL 15 MINUTE AND h1.ts + INTERVAL 20 MINUTE) AS avoid FROM h1""")
def news_avoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.near_news(bars(spark, sf_dir).select("symbol", "ts"), news(spark, sf_dir).where("impact = 'high'"), before=15, after=20, out="avoid")


@query(f"""WITH {bars_sql('D1', 'd1')}, {NEWS} SELECT symbol, close AS price, CASE WHEN EXISTS (SELECT 1 FROM news WHERE ts BETWEEN TIMESTAMP '2024-01-10 09:25:00' AND TIMESTAMP '2024-01-10 10:25:00') THEN 'weak' ELSE 'strong' END AS signal_strength FROM d1""")
def levels_by_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = bars(spark, sf_dir, "D1").select("symbol", F.col("close").alias("price"))
    return joins.filter_levels_by_news(levels, news(spark, sf_dir), F.lit("2024-01-10 09:55:00").cast("timestamp_ntz"))


@query(f"""WITH {bars_sql('H4', 'h4')}, {NEWS} SELECT symbol, ts, (SELECT min(ts) FROM news n WHERE n.impact = 'high' AND n.ts >= h4.ts) AS next_news FROM h4""")
def time_to_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.next_event(bars(spark, sf_dir, "H4").select("symbol", "ts"), news(spark, sf_dir).where("impact = 'high'"), name="next_news")


@query(f"""WITH {bars_sql('H1', 'h1')}, {bars_sql('D1', 'd1')}, u AS (SELECT * FROM h1 UNION ALL SELECT * FROM d1), t AS (SELECT symbol, ts, tf FROM d1 JOIN (VALUES ('H1'), ('D1')) AS v(x) ON true),
b AS (SELECT d1.symbol, d1.ts, v.x AS tf FROM d1, (VALUES ('H1'), ('D1')) AS v(x)),
w AS (SELECT symbol, tf, ts, list(open) OVER q AS o, list(high) OVER q AS h, list(low) OVER q AS l, list(close) OVER q AS c FROM u WINDOW q AS (PARTITION BY symbol, tf ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
SELECT b.symbol, b.ts, b.tf, w.c[-1] AS last_close, list_sum(w.c) AS sum_close, list_sum(w.o) AS sum_open, list_sum(w.h) AS sum_high, list_sum(w.l) AS sum_low, len(w.c)::BIGINT AS n FROM b ASOF LEFT JOIN w ON b.symbol = w.symbol AND b.tf = w.tf AND b.ts >= w.ts""".replace("t AS (SELECT symbol, ts, tf FROM d1 JOIN (VALUES ('H1'), ('D1')) AS v(x) ON true),\n", "").replace("list_sum(w.c)", "round(list_sum(w.c), 6)").replace("list_sum(w.o)", "round(list_sum(w.o), 6)").replace("list_sum(w.h)", "round(list_sum(w.h), 6)").replace("list_sum(w.l)", "round(list_sum(w.l), 6)"))
def observation_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = bars(spark, sf_dir, "D1")
    out = joins.observation_windows(days, bars(spark, sf_dir).unionByName(days), 5)
    at = lambda k: F.filter("window", lambda x, i: (i % 4 == k) & x.isNotNull())
    total = lambda k: F.when(F.size(at(k)) > 0, r6(F.aggregate(at(k), F.lit(0.0), lambda a, x: a + x)))
    return out.select("symbol", "ts", "tf", F.element_at("window", -1).alias("last_close"), *(total(k).alias(f"sum_{n}") for k, n in enumerate(("open", "high", "low", "close"))), F.nullif(F.size(at(3)), F.lit(0)).cast("long").alias("n"))


