"""The terminal source against a fake terminal, whose bars and calls are files."""

import datetime

import pytest
from pyspark.sql import functions as F

from tickloom.sources import terminal

START = datetime.datetime(2025, 1, 1)

FAKE = '''
import datetime, json, os, uuid
import pandas as pd

HERE = os.path.dirname(__file__)
START = datetime.datetime(2025, 1, 1)


def held(symbol, tf):
    with open(os.path.join(HERE, "bars.json")) as f:
        return json.load(f).get(symbol + "|" + tf, 0)


def bars(symbol, tf, first, last):
    with open(os.path.join(HERE, f"call-{uuid.uuid4().hex}.json"), "w") as f:
        json.dump([symbol, tf, first and first.isoformat(), last and last.isoformat()], f)
    if symbol == "BROKEN" or symbol == "SHAKY" and len([n for n in os.listdir(HERE) if n.startswith("call-")]) % 2:
        raise ConnectionError("no answer")
    n = held(symbol, tf)
    rows = [(START + datetime.timedelta(hours=k), 1.0 + k, 2.0 + k, 0.5 + k, 1.5 + k, 10 + k) for k in range(n)]
    return pd.DataFrame(rows + rows[-1:], columns=["time", "open", "high", "low", "close", "tick_volume"])  # the last bar twice


def newest(symbol, tf):
    n = held(symbol, tf)
    return START + datetime.timedelta(hours=n - 1) if n else None
'''


@pytest.fixture()
def fake(spark, tmp_path):
    import json

    folder = tmp_path / "terminal"
    folder.mkdir()
    (folder / "fake.py").write_text(FAKE)
    terminal.register(spark)

    class Fake:
        options = {"fetch": f"{folder}/fake.py:bars", "latest": f"{folder}/fake.py:newest", "symbols": "EURUSD, XAUUSD", "timeframes": "H1,D1", "backoff": "0.01"}

        def hold(self, **bars):
            (folder / "bars.json").write_text(json.dumps({k.replace("_", "|"): v for k, v in bars.items()}))

        def calls(self):
            found = [tuple(json.loads(f.read_text())) for f in folder.glob("call-*.json")]
            for f in folder.glob("call-*.json"):
                f.unlink()
            return sorted(found, key=str)

        def read(self, **more):
            return spark.read.format("terminal").options(**{**self.options, **more}).load()

    return Fake()


def hours(rows):
    return {(r.symbol, r.tf, int((r.ts - START).total_seconds() // 3600)) for r in rows}


def test_batches_push_their_conditions(fake):
    fake.hold(EURUSD_H1=6, EURUSD_D1=2, XAUUSD_H1=3)
    rows = fake.read().collect()
    assert hours(rows) == {("EURUSD", "H1", k) for k in range(6)} | {("EURUSD", "D1", k) for k in range(2)} | {("XAUUSD", "H1", k) for k in range(3)} and len(rows) == 11
    assert all(r.open == 1.0 + (r.ts - START).total_seconds() / 3600 and r.spread is None for r in rows)
    assert len(fake.calls()) == 4
    at = lambda h: F.lit(START + datetime.timedelta(hours=h)).cast("timestamp_ntz")
    some = fake.read().where((F.col("symbol") == "EURUSD") & F.col("tf").isin("H1") & (F.col("ts") > at(1)) & (F.col("ts") <= at(4)))
    assert hours(some.collect()) == {("EURUSD", "H1", k) for k in (2, 3, 4)}
    assert fake.calls() == [("EURUSD", "H1", "2025-01-01T01:00:00", "2025-01-01T04:00:00")]
    exact = fake.read().where((F.col("ts") == at(2)) & (F.col("open") < 100) & (F.col("symbol") != "XAUUSD"))
    assert hours(exact.collect()) == {("EURUSD", "H1", 2)}
    assert fake.read().where("symbol = 'NONE'").count() == 0


def test_failures_are_asked_again(fake):
    fake.hold(SHAKY_H1=4)
    assert fake.read(symbols="SHAKY", timeframes="H1").count() == 4 and len(fake.calls()) == 2
    with pytest.raises(Exception, match="no answer"):
        fake.read(symbols="BROKEN", timeframes="H1", retries="1").collect()
    assert fake.read(symbols="SHAKY,BROKEN", skip_symbols="BROKEN", timeframes="H1").count() == 4
    for wrong in ({"timeframes": "H1,X9"}, {"fetch": ""}):
        with pytest.raises(Exception, match="timeframe|options"):
            fake.read(**wrong).collect()


def test_a_stream_neither_loses_nor_repeats(spark, fake, tmp_path):
    def run():
        stream = spark.readStream.format("terminal").options(**fake.options).load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.read.schema(stream.schema).parquet(f"{tmp_path}/out").collect()

    fake.hold(EURUSD_H1=5)
    assert hours(run()) == {("EURUSD", "H1", k) for k in range(5)}
    fake.calls()
    fake.hold(EURUSD_H1=8, XAUUSD_D1=2)
    rows = run()
    assert len(rows) == 10 and hours(rows) == {("EURUSD", "H1", k) for k in range(8)} | {("XAUUSD", "D1", k) for k in range(2)}
    assert ("EURUSD", "H1", "2025-01-01T04:00:00", "2025-01-01T07:00:00") in fake.calls()
    assert len(run()) == 10 and fake.calls() == []
