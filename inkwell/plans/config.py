"""Settings in layers, on the driver: later layers lose, every value knows its layer, secrets and foreign endpoints are refused."""

from __future__ import annotations

import re
import tomllib
from dataclasses import dataclass
from urllib.parse import urlsplit

from inkwell.operators.ledger import LAYERS

#: Intensity of a rewrite (strength, hops, candidates) and the words of secrets.
INTENSITY = {"low": ("light", 1, 1), "medium": ("medium", 2, 2), "high": ("strong", 3, 3)}
SECRET = re.compile(r"(?i)(api_?key|token|secret|password)$")
LOCAL_HOSTS = frozenset(("localhost", "127.0.0.1", "::1"))
DEFAULTS = {"unicode.policy": "safe", "unicode.form": "NFC", "budget.max_chars": 1_000_000, "budget.runtime_ms": 30_000, "rewrite.strength": "medium", "rewrite.hops": 1}


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class Setting:
    value: object
    layer: str


def flatten(tree: dict, prefix: str = "") -> dict[str, object]:
    out: dict[str, object] = {}
    for k, v in tree.items():
        name = f"{prefix}{k}"
        if isinstance(v, dict):
            out |= flatten(v, name + ".")
        else:
            if SECRET.search(name) and not name.endswith("_env"):
                raise ConfigError(f"{name} holds a secret; name an environment variable instead")
            out[name] = v
    return out


def load_toml(text: str) -> dict[str, object]:
    try:
        return flatten(tomllib.loads(text))
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e


def resolve(layers: dict[str, dict[str, object]]) -> dict[str, Setting]:
    """Each key's value from its strongest layer."""
    unknown = set(layers) - set(LAYERS)
    if unknown:
        raise ConfigError(f"unknown layers {sorted(unknown)}")
    out = {k: Setting(v, "default") for k, v in DEFAULTS.items()}
    for layer in reversed(LAYERS):
        for k, v in layers.get(layer, {}).items():
            if k not in DEFAULTS:
                raise ConfigError(f"unknown key {k}")
            if type(v) is not type(DEFAULTS[k]):
                raise ConfigError(f"{k} takes a {type(DEFAULTS[k]).__name__}")
            out[k] = Setting(v, layer)
    return out


def check_endpoint(url: str, allowed: frozenset[str] = frozenset()) -> str:
    """An endpoint on this machine, or HTTPS on an allowed host."""
    u = urlsplit(url)
    host = (u.hostname or "").lower()
    if host in LOCAL_HOSTS and u.scheme in ("http", "https"):
        return url
    if u.scheme != "https" or host not in allowed or u.username or u.password:
        raise ConfigError(f"endpoint {host or url} is not allowed")
    return url


def literal_lock(phrase: str) -> str:
    """A phrase as a lock that matches it alone."""
    if not 0 < len(phrase) <= 500:
        raise ConfigError("a phrase has 1 to 500 characters")
    return re.escape(phrase)
