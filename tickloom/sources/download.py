"""The download job: bars of all pairs that the settings name, into a table or CSV files.

    spark-submit tickloom/sources/download.py SETTINGS.yaml MODULE:FUNCTION TABLE [--csv] [--skip-existing]

FUNCTION(symbol, tf, num_bars) gives a pair's frame of bars; it runs in the tasks.
"""

from __future__ import annotations

import argparse
import functools
import importlib
import sys
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import SparkSession

from tickloom.sources import config, market

NUM_BARS = 3000


def download(spark: SparkSession, settings: Mapping, fetch: Callable[[str, str, int], pd.DataFrame], path: str, as_csv: bool = False, skip_existing: bool = False) -> None:
    """Fetch every symbol and timeframe of the settings and append them to the table at path, or replace CSV files there.

    Settings: symbols, timeframes (else the defaults), skip_symbols, and num_bars and retries under download_defaults.
    """
    symbols = config.get(settings, "symbols", default=config.DEFAULT_SYMBOLS)
    tfs = config.get(settings, "timeframes", default=config.DEFAULT_TIMEFRAMES)
    most = int(config.get(settings, "download_defaults", "num_bars", default=NUM_BARS))
    tries = int(config.get(settings, "download_defaults", "retries", default=2))
    bars = market.fetch_pairs(spark, functools.partial(_fetched, fetch, most), symbols, tfs, tries, skip_symbols=config.get(settings, "skip_symbols", default=[]))
    bars = bars.persist()  # each pair is asked for once, though writing looks twice
    try:
        if as_csv:
            market.write_pair_csv(bars, path)
        else:
            market.write_bars(bars, path, skip_existing=skip_existing)
    finally:
        bars.unpersist()


def _fetched(fetch: Callable[[str, str, int], pd.DataFrame], most: int, symbol: str, tf: str) -> pd.DataFrame:
    return fetch(symbol, tf, most)


def main(arguments: list[str]) -> None:
    """Run the job with the arguments of the command line."""
    parser = argparse.ArgumentParser(description="Download bars")
    parser.add_argument("settings")
    parser.add_argument("fetch", help="module:function")
    parser.add_argument("path")
    parser.add_argument("--env-file")
    parser.add_argument("--csv", action="store_true")
    parser.add_argument("--skip-existing", action="store_true")
    given = parser.parse_args(arguments)
    module, _, function = given.fetch.partition(":")
    fetch = getattr(importlib.import_module(module), function)
    spark = SparkSession.builder.appName("download").getOrCreate()
    download(spark, config.load(given.settings, env_file=given.env_file), fetch, given.path, given.csv, given.skip_existing)


if __name__ == "__main__":
    main(sys.argv[1:])
