"""JSON that survives editing: key order and the spelling of numbers are kept.

Spark's VARIANT sorts keys and respells numbers, so records are only ever re-serialised
here.  Objects are dicts (a repeated key keeps its last value), arrays lists, numbers Num.
"""

from __future__ import annotations

import json
import re
from typing import Any

_INT = re.compile(r"-?(?:0|[1-9][0-9]*)\Z")


class Num:
    """A number as it is spelled."""

    __slots__ = ("raw",)

    def __init__(self, raw: str):
        self.raw = raw

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Num) and self.raw == other.raw

    def __hash__(self) -> int:
        return hash(self.raw)

    def __repr__(self) -> str:
        return f"Num({self.raw})"


def _constant(name: str) -> None:
    raise ValueError(name)


_decoder = json.JSONDecoder(parse_float=Num, parse_int=Num, parse_constant=_constant)


def loads(text: str) -> Any:
    """The value, or ValueError."""
    try:
        return _decoder.decode(text)
    except RecursionError as e:
        raise ValueError("too deep") from e


def dumps(value: Any, ascii_only: bool = False) -> str:
    """Compact JSON."""
    if isinstance(value, str):
        return json.dumps(value, ensure_ascii=ascii_only)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=ascii_only)}:{dumps(v, ascii_only)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(dumps(v, ascii_only) for v in value) + "]"
    if isinstance(value, Num):
        return value.raw
    return {None: "null", True: "true", False: "false"}[value] if value is None or isinstance(value, bool) else str(value)


def get(value: Any, *path: str) -> Any:
    """The value at a path of keys; None where it is absent or null."""
    for key in path:
        if not isinstance(value, dict):
            return None
        value = value.get(key)
    return value


def text(value: Any, *path: str) -> str | None:
    """The string at a path, None for any other type."""
    found = get(value, *path)
    return found if isinstance(found, str) else None


def integer(value: Any, *path: str) -> int | None:
    """A 32-bit integer spelled as one, else None."""
    found = get(value, *path)
    if isinstance(found, Num) and _INT.match(found.raw) and -(2**31) <= int(found.raw) < 2**31:
        return int(found.raw)
    return None


def items(value: Any, *path: str) -> list:
    found = get(value, *path)
    return found if isinstance(found, list) else []


def map_strings(value: Any, f) -> Any:
    """The value with every string leaf (keys are none) replaced by f of it."""
    if isinstance(value, str):
        return f(value)
    if isinstance(value, dict):
        return {k: map_strings(v, f) for k, v in value.items()}
    if isinstance(value, list):
        return [map_strings(v, f) for v in value]
    return value


def strings(value: Any):
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from strings(v)
    elif isinstance(value, list):
        for v in value:
            yield from strings(v)


def units(s: str) -> int:
    """Length in UTF-16 units, the measure of all character thresholds."""
    return len(s) + sum(c > "￿" for c in s) if not s.isascii() else len(s)


def utf8(s: str) -> int:
    return len(s) if s.isascii() else len(s.encode("utf-8", "surrogatepass"))
