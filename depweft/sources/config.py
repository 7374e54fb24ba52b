"""Settings: environment variable, then the TOML file, then the default."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path

FILE = "depweft.toml"


def find_file(start: str | None = None) -> Path | None:
    """The nearest settings file in the folder or above it."""
    here = Path(start or os.getcwd()).resolve()
    return next((p / FILE for p in (here, *here.parents) if (p / FILE).is_file()), None)


def setting(name: str, section: str, default: object = None, start: str | None = None) -> object:
    """DEPWEFT_<SECTION>_<NAME> or [section] name; an environment variable is read as the default's type."""
    raw = os.environ.get(f"DEPWEFT_{section}_{name}".upper())
    if raw is not None:
        if isinstance(default, bool):
            return raw.strip().lower() in ("1", "true", "yes", "on")
        return type(default)(raw) if isinstance(default, int | float) else raw
    path = find_file(start)
    if path:
        with path.open("rb") as f:
            return tomllib.load(f).get(section, {}).get(name, default)
    return default
