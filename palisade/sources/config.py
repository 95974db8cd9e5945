"""Configuration from dictionaries, JSON or TOML files, and the environment."""

from __future__ import annotations

import dataclasses
import json
import os
import tomllib
from pathlib import Path

from ..operators.policy import Config, ConfigError, Thresholds

#: Settings that the environment may replace, with their types.
ENVIRONMENT = {
    "RATE_LIMIT": int, "RATE_WINDOW_S": float, "MAX_CONTENT_LENGTH": int, "PROFILE_TTL_S": float,
    "INJECTION_BLOCK": float, "INJECTION_SANITIZE": float, "ANOMALY_BLOCK": float, "ANOMALY_QUARANTINE": float,
}


def from_dict(raw: dict) -> Config:
    """A validated configuration; unknown keys are refused, lists become sets where sets are meant."""
    names = {f.name: f for f in dataclasses.fields(Config)}
    unknown = sorted(set(raw) - set(names))
    if unknown:
        raise ConfigError(f"unknown settings: {', '.join(unknown)}")
    out = dict(raw)
    try:
        if isinstance(out.get("thresholds"), dict):
            out["thresholds"] = Thresholds(**out["thresholds"])
        for k in ("egress_tools", "write_tools", "secret_tools", "known_bad_destinations"):
            if k in out:
                out[k] = frozenset(out[k])
        for k in ("secret_patterns", "internal_domains"):
            if k in out:
                out[k] = tuple(out[k])
        if "role_tool_matrix" in out:
            out["role_tool_matrix"] = {r: set(t) for r, t in out["role_tool_matrix"].items()}
        if "tier_caps" in out:
            out["tier_caps"] = {t: (c["egress"], c["filesystem"], c["secret_access"], list(c.get("allow_destinations", ()))) if isinstance(c, dict) else tuple(c) for t, c in out["tier_caps"].items()}
        return Config(**out)
    except (TypeError, KeyError, AttributeError) as e:
        raise ConfigError(f"malformed settings: {e}") from e


def from_file(path: str | Path) -> Config:
    """A configuration from a .json or .toml file."""
    p = Path(path)
    try:
        if p.suffix.lower() == ".json":
            raw = json.loads(p.read_text())
        elif p.suffix.lower() == ".toml":
            raw = tomllib.loads(p.read_text())
        else:
            raise ConfigError(f"settings must be .json or .toml: {p.name}")
    except (OSError, ValueError) as e:
        if isinstance(e, ConfigError):
            raise
        raise ConfigError(f"cannot read settings {p}: {e}") from e
    return from_dict(raw)


def from_env(base: Config | None = None, prefix: str = "PALISADE_", environ=None) -> Config:
    """A configuration with scalars replaced from the environment."""
    base, environ = base or Config(), os.environ if environ is None else environ
    changes, limits = {}, {}
    for name, kind in ENVIRONMENT.items():
        if prefix + name in environ:
            try:
                v = kind(environ[prefix + name])
            except ValueError as e:
                raise ConfigError(f"{prefix}{name} must be {kind.__name__}") from e
            (limits if hasattr(base.thresholds, name.lower()) else changes)[name.lower()] = v
    if limits:
        changes["thresholds"] = dataclasses.replace(base.thresholds, **limits)
    return base.copy(**changes)
