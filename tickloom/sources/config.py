"""Job settings: a YAML mapping, with environment variables over its leaves."""

from __future__ import annotations

import os
from collections.abc import Mapping
from typing import Any

PREFIX = "BOT_"
#: Symbols and timeframes of the download job where the settings name none. Fixed values.
DEFAULT_SYMBOLS = ["XAUUSD", "EURUSD", "GBPUSD", "USDJPY", "AUDUSD", "USDCAD", "USDCHF"]
DEFAULT_TIMEFRAMES = ["M1", "M5", "M30", "H4", "D1", "W1"]


def cast(text: str) -> Any:
    """A setting's text as a bool, an int, a float, a list of comma-separated parts, or itself."""
    text = text.strip()
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return [part.strip() for part in text.split(",") if part.strip()] if "," in text else text


def overridden(settings: Any, env: Mapping[str, str] | None = None, path: tuple[str, ...] = ()) -> Any:
    """Settings whose leaves named by BOT_A_B (or A_B) in env are replaced."""
    env = os.environ if env is None else env
    if isinstance(settings, dict):
        return {k: overridden(v, env, (*path, str(k).upper())) for k, v in settings.items()}
    name = "_".join(path)
    found = env.get(PREFIX + name, env.get(name) if path else None)
    return settings if found is None else cast(found)


def read_env_file(path: str) -> dict[str, str]:
    """Variables of a file of KEY=VALUE lines; blank lines and comments are skipped, quotes and a leading export go. {} without a file."""
    if not os.path.exists(path):
        return {}
    found = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, given, value = line.strip().removeprefix("export ").partition("=")
            if not given or name.startswith("#"):
                continue
            value = value.strip()
            quoted = len(value) > 1 and value[0] in "'\"" and value[-1] == value[0]
            found[name.strip()] = value[1:-1] if quoted else value.split(" #")[0].rstrip()
    return found


def load(path: str, env: Mapping[str, str] | None = None, env_file: str | None = None) -> dict:
    """Settings of a YAML file with overrides, by variables of env_file and, before those, of env. A file that is not a mapping
    raises ValueError."""
    import yaml

    env = os.environ if env is None else env
    if env_file is not None:
        env = {**read_env_file(env_file), **env}

    with open(path, encoding="utf-8") as f:
        try:
            settings = yaml.safe_load(f) or {}
        except yaml.YAMLError as e:
            raise ValueError(f"cannot parse {path}: {e}") from e
    if not isinstance(settings, dict):
        raise ValueError("settings must be a mapping")
    return overridden(settings, env)


def get(settings: Mapping, *path: str, default: Any = None) -> Any:
    """Nested value, or default where a step is missing or null."""
    for step in path:
        if not isinstance(settings, Mapping) or settings.get(step) is None:
            return default
        settings = settings[step]
    return settings
