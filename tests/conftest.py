import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tickloom.session import local_session

    session = local_session(4, 4, "4g", "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bars(spark):
    """A random walk of two series, with volume."""
    import numpy as np
    import pandas as pd

    rng, frames = np.random.default_rng(7), []
    for symbol in ("AAA", "BBB"):
        close = 100 + np.cumsum(rng.normal(0, 1, 300)).round(3)
        open_ = np.roll(close, 1)
        open_[0] = close[0]
        high, low = np.maximum(open_, close) + rng.random(300).round(3), np.minimum(open_, close) - rng.random(300).round(3)
        ts = pd.date_range("2025-01-01", periods=300, freq="h")
        frames.append(pd.DataFrame({"symbol": symbol, "tf": "H1", "ts": ts, "open": open_, "high": high, "low": low, "close": close, "tick_volume": rng.integers(1, 100, 300), "spread": 0}))
    pdf = pd.concat(frames, ignore_index=True)
    df = spark.createDataFrame(pdf).selectExpr("symbol", "tf", "cast(ts as timestamp_ntz) ts", "open", "high", "low", "close", "tick_volume", "spread").cache()
    return df, pdf
