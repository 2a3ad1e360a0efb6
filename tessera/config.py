"""Configuration trees: JSON values read by key, with defaults and coercion; missing keys give a null node."""

from __future__ import annotations

import json
import re
from typing import Any

import numpy as np


class Config:
    """A node: null, string, integer, boolean, floating (32-bit), dictionary, array or token (id, string)."""

    def __init__(self, value: Any = None):
        self.value = value.value if isinstance(value, Config) else value

    @staticmethod
    def of(value: Any) -> Config:
        return value if isinstance(value, Config) else Config(value)

    @property
    def is_null(self) -> bool:
        return self.value is None

    def __getitem__(self, key: str | int) -> Config:
        v = self.value
        if isinstance(v, dict) and isinstance(key, str):
            return Config(v[key] if key in v else v.get(uncamel(key)))
        if isinstance(v, (list, tuple)) and isinstance(key, int) and 0 <= key < len(v):
            return Config(v[key])
        return Config()

    def __getattr__(self, key: str) -> Config:
        """The key itself, else its snake_case form."""
        if key.startswith("__"):
            raise AttributeError(key)
        return self[key]

    def string(self, default: str | None = None) -> str | None:
        return self.value if isinstance(self.value, str) else default

    def integer(self, default: int | None = None) -> int | None:
        v = self.value
        return v if isinstance(v, int) and not isinstance(v, bool) else default

    def boolean(self, default: bool | None = None) -> bool | None:
        """A boolean; of an integer, whether it is 1; of a string, true/t/1 or false/f/0 in any case."""
        v = self.value
        if isinstance(v, bool):
            return v
        if isinstance(v, int):
            return v == 1
        if isinstance(v, str):
            return True if v.lower() in ("true", "t", "1") else False if v.lower() in ("false", "f", "0") else default
        return default

    def floating(self, default: float | None = None) -> float | None:
        v = self.value
        return float(np.float32(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else default

    def array(self, default: list[Config] | None = None) -> list[Config]:
        return [Config(x) for x in self.value] if isinstance(self.value, list) else default or []

    def dictionary(self, default: dict[str, Config] | None = None) -> dict[str, Config]:
        return {k: Config(v) for k, v in self.value.items()} if isinstance(self.value, dict) else default or {}

    def token(self, default: tuple[int, str] | None = None) -> tuple[int, str] | None:
        """(id, string) of a pair of both, or of an array [string, id] or [id, string]."""
        v = self.value
        if isinstance(v, tuple) and len(v) == 2:
            return v
        if isinstance(v, list) and len(v) == 2:
            a, b = Config(v[0]), Config(v[1])
            if a.string() is not None and b.integer() is not None:
                return v[1], v[0]
            if (a.integer() if a.integer() is not None else -1) >= 0 and b.string() is not None:
                return v[0], v[1]
        return default

    def __eq__(self, other: object) -> bool:
        """Equal values; also if one side's kind can be read as the other's, within dictionaries and arrays too."""
        a, b = self, Config.of(other)
        if isinstance(a.value, dict) and isinstance(b.value, dict):
            return a.value.keys() == b.value.keys() and all(a[k] == b[k] for k in a.value)
        if isinstance(a.value, list) and isinstance(b.value, list):
            return len(a.value) == len(b.value) and all(Config(x) == Config(y) for x, y in zip(a.value, b.value, strict=True))
        if type(a.value) is type(b.value):
            return a.floating() == b.floating() if isinstance(a.value, float) else a.value == b.value
        for x, y in ((a, b), (b, a)):
            if isinstance(y.value, bool) and x.boolean() is not None:
                return x.boolean() == y.value
            if isinstance(y.value, float) and x.floating() is not None:
                return x.floating() == y.floating()
            if isinstance(y.value, tuple) and x.token() is not None:
                return x.token() == y.value
        return False

    def __hash__(self) -> int:
        v = self.value
        return hash((type(v).__name__, json.dumps(v, sort_keys=True, default=list)))

    def __repr__(self) -> str:
        return f"Config({self.value!r})"

    def native(self) -> Any:
        """Plain values, for templates and JSON."""
        return self.value

    def encode(self) -> str:
        return json.dumps(self.value, ensure_ascii=False)


def uncamel(key: str) -> str:
    """snake_case of camelCase; of consecutive capitals only the first gets an underscore."""
    return "".join(("_" if i and c.isupper() and not key[i - 1].isupper() else "") + c.lower() for i, c in enumerate(key))


def loads(text: str | bytes) -> Config:
    """JSON with a byte-order mark, trailing commas, NaN and Infinity allowed. Integers beyond 64 bits become floats."""
    if isinstance(text, bytes):
        text = text.decode("utf-8")
    text = text.removeprefix("﻿")
    text = re.sub(r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])', lambda m: m[1] or "", text)
    text = re.sub(r'("(?:[^"\\]|\\.)*")|\bInf\b', lambda m: m[1] or "Infinity", text)
    text = re.sub(r'("(?:[^"\\]|\\.)*")|\b(?:nan)\b', lambda m: m[1] or "NaN", text)
    return Config(json.loads(text, parse_int=lambda s: int(s) if -(1 << 63) <= int(s) < 1 << 63 else float(s)))


def merge(left: dict, right: dict, choose=lambda a, b: b) -> dict:
    """Both dictionaries' keys; where both have one, `choose` picks, the right side by default."""
    return {k: choose(left[k], right[k]) if k in left and k in right else right.get(k, left.get(k)) for k in [*left, *(k for k in right if k not in left)]}
