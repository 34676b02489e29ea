"""Settings: a YAML file with ${VAR} and ${VAR:-default} placeholders, and its sections."""

from __future__ import annotations

import os
import re
from pathlib import Path
from typing import Any

_PLACEHOLDER = re.compile(r"\$\{([^}]+)\}")


class ConfigError(Exception):
    """A settings file that is missing, empty, malformed or lacks a section or key."""


def substitute(value: Any, env: dict[str, str] | None = None) -> Any:
    """Placeholders in strings, at any depth.  A variable that is unset or empty takes its default; without one the placeholder stays."""
    env = dict(os.environ) if env is None else env
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env) for v in value]
    if not isinstance(value, str):
        return value

    def filled(match: re.Match) -> str:
        name, has_default, default = match[1].partition(":-")
        return env.get(name.strip()) or (default.strip() if has_default else match[0])

    return _PLACEHOLDER.sub(filled, value)


def load_config(path: str | Path) -> dict:
    import yaml

    path = Path(path)
    if not path.is_file():
        raise ConfigError(f"no settings file at {path}")
    try:
        found = yaml.safe_load(path.read_text(encoding="utf-8"))
    except yaml.YAMLError as e:
        raise ConfigError(f"{path} is not YAML: {e}") from e
    if not found:
        raise ConfigError(f"{path} is empty")
    return substitute(found)


def section(config: dict, name: str) -> dict:
    """A section such as the store's, the embedder's, the generator's or retrieval's."""
    if not isinstance(config.get(name), dict):
        raise ConfigError(f"no section {name!r}")
    return config[name]
