"""A small declarative schema: a ``Spec`` lists its fields, reads a mapping, refuses unknown keys and is immutable."""

from __future__ import annotations

import keyword
from collections.abc import Callable, Mapping
from datetime import datetime
from pathlib import Path
from typing import Any

import pandas as pd

from ..errors import ConfigError

NEEDED = object()


def seconds(text: str) -> float:
    """Seconds of a duration such as '30s', '10min', '-15s'."""
    return pd.Timedelta(text).total_seconds()


def micros(text: str) -> int:
    """Microseconds of a duration."""
    return pd.Timedelta(text).value // 1000


class Field:
    """A reader (value, where) -> value, and what stands for a missing key."""

    def __init__(self, read: Callable[[Any, str], Any], default: Any = NEEDED, alias: str | None = None):
        self.read, self.default, self.alias = read, default, alias

    def get(self, data: dict, name: str, where: str) -> Any:
        keys = [k for k in (name, self.alias) if k is not None and k in data]
        if len(keys) > 1:
            raise ConfigError(f"{where}: give only one of {keys}")
        if keys:
            v = data.pop(keys[0])
            return None if v is None and self.default is None else self.read(v, where)
        if self.default is NEEDED:
            raise ConfigError(f"{where}: missing")
        return self.default() if callable(self.default) else self.default


def fail(where: str, what: str) -> None:
    raise ConfigError(f"{where}: {what}")


def number(default: Any = NEEDED, *, gt: float | None = None, ge: float | None = None, lt: float | None = None, le: float | None = None, whole: bool = False) -> Field:
    def read(v: Any, where: str) -> Any:
        if isinstance(v, bool) or not isinstance(v, (int, float)) or (whole and v != int(v)) or v != v:
            fail(where, f"{v!r} is not a {'whole ' * whole}number")
        for ok, sign, edge in ((gt is None or v > gt, ">", gt), (ge is None or v >= ge, ">=", ge), (lt is None or v < lt, "<", lt), (le is None or v <= le, "<=", le)):
            if not ok:
                fail(where, f"{v} must be {sign} {edge}")
        return int(v) if whole else float(v)

    return Field(read, default)


def text(default: Any = NEEDED, *, filled: bool = False, longest: int | None = None) -> Field:
    def read(v: Any, where: str) -> str:
        if not isinstance(v, str):
            fail(where, f"{v!r} is not text")
        if filled and not v.strip():
            fail(where, "must not be blank")
        if longest is not None and len(v) > longest:
            fail(where, f"longer than {longest}")
        return v

    return Field(read, default)


def flag(default: Any = NEEDED) -> Field:
    return Field(lambda v, where: v if isinstance(v, bool) else fail(where, f"{v!r} is not true or false"), default)


def choice(*options: str, default: Any = NEEDED) -> Field:
    return Field(lambda v, where: v if v in options else fail(where, f"{v!r} is not one of {list(options)}"), default)


def duration(default: Any = NEEDED, *, signed: bool = False) -> Field:
    def read(v: Any, where: str) -> str:
        try:
            t = pd.Timedelta(v) if isinstance(v, str) else None
        except ValueError:
            t = None
        if t is None or t is pd.NaT:
            fail(where, f"{v!r} is not a duration (like '30s', '10min')")
        if not signed and t <= pd.Timedelta(0):
            fail(where, f"duration {v!r} must be positive")
        return v

    return Field(read, default)


def stamp(default: Any = NEEDED) -> Field:
    """A time; zoned ones become UTC, others are UTC already."""

    def read(v: Any, where: str) -> datetime:
        try:
            t = pd.Timestamp(v)
        except (ValueError, TypeError):
            t = pd.NaT
        if t is pd.NaT:
            fail(where, f"{v!r} is not a time")
        return (t.tz_convert("UTC").tz_localize(None) if t.tzinfo else t).to_pydatetime()

    return Field(read, default)


def path(default: Any = NEEDED) -> Field:
    return Field(lambda v, where: Path(v) if isinstance(v, (str, Path)) else fail(where, f"{v!r} is not a path"), default)


def name(default: Any = NEEDED) -> Field:
    return Field(read_name, default)


def read_name(v: Any, where: str) -> str:
    """Names become columns and folders."""
    if not isinstance(v, str) or not v.isidentifier() or keyword.iskeyword(v):
        fail(where, f"{v!r} must be an identifier (letters, digits, underscores)")
    return v


def many(of: Field, default: Any = NEEDED, *, least: int = 0, single: bool = False, alias: str | None = None) -> Field:
    """A list, kept as a tuple; ``single``: one bare value stands for a list of it."""

    def read(v: Any, where: str) -> tuple:
        if single and not isinstance(v, (list, tuple)):
            v = [v]
        if not isinstance(v, (list, tuple)) or len(v) < least:
            fail(where, f"needs a list of at least {least}")
        return tuple(of.read(x, f"{where}[{i}]") for i, x in enumerate(v))

    return Field(read, default, alias)


def mapping(of: Field, default: Any = NEEDED, *, least: int = 0, names: bool = False) -> Field:
    def read(v: Any, where: str) -> dict:
        if not isinstance(v, Mapping) or len(v) < least:
            fail(where, f"needs a mapping of at least {least}")
        return {(read_name(k, where) if names else str(k)): of.read(x, f"{where}.{k}") for k, x in v.items()}

    return Field(read, default)


def anything(default: Any = NEEDED) -> Field:
    return Field(lambda v, where: v, default)


def sub(cls: type, default: Any = NEEDED) -> Field:
    return Field(lambda v, where: v if isinstance(v, cls) else cls.read(v, where), default)


def union(tag: str, default: Any = NEEDED, **kinds: type) -> Field:
    """One of several specs, told apart by the value of ``tag``."""

    def read(v: Any, where: str) -> Any:
        if isinstance(v, tuple(kinds.values())):
            return v
        if not isinstance(v, Mapping) or v.get(tag) not in kinds:
            fail(where, f"'{tag}' must be one of {list(kinds)}")
        return kinds[v[tag]].read({k: x for k, x in v.items() if k != tag}, where)

    return Field(read, default)


class Spec:
    """Subclasses declare fields as class attributes and cross-field rules in ``check``."""

    TAG: tuple[str, str] | None = None
    _fields: dict[str, Field] = {}

    def __init_subclass__(cls) -> None:
        own = {k: v for k, v in vars(cls).items() if isinstance(v, Field)}
        for k in own:
            delattr(cls, k)
        cls._fields = {**cls._fields, **own}

    def __init__(self, **data: Any):
        self._load(data, type(self).__name__)

    @classmethod
    def read(cls, data: Any, where: str | None = None) -> Any:
        if not isinstance(data, Mapping):
            fail(where or cls.__name__, "needs a mapping")
        out = cls.__new__(cls)
        out._load(dict(data), where or cls.__name__)
        return out

    def _load(self, data: dict, where: str) -> None:
        data = dict(data)
        if self.TAG and data.get(self.TAG[0]) == self.TAG[1]:
            del data[self.TAG[0]]
        values = {k: f.get(data, k, f"{where}.{k}") for k, f in self._fields.items()}
        if data:
            fail(where, f"unknown keys {sorted(map(str, data))}")
        vars(self).update(values)
        problem = self.check()
        if problem:
            fail(where, problem)

    def check(self) -> str | None:
        return None

    def __setattr__(self, key: str, value: Any) -> None:
        raise ConfigError(f"{type(self).__name__} is immutable")

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and vars(self) == vars(other)

    __hash__ = None  # type: ignore[assignment]

    def __repr__(self) -> str:
        return f"{type(self).__name__}({', '.join(f'{k}={v!r}' for k, v in vars(self).items())})"

    def replace(self, **changes: Any) -> Any:
        """A changed copy, checked anew."""
        return type(self).read({**vars(self), **changes})

    def plain(self) -> dict:
        """Mapping of plain values that ``read`` takes back."""

        def flat(v: Any) -> Any:
            if isinstance(v, Spec):
                return v.plain()
            if isinstance(v, dict):
                return {k: flat(x) for k, x in v.items()}
            if isinstance(v, tuple):
                return [flat(x) for x in v]
            return v.isoformat() if isinstance(v, datetime) else str(v) if isinstance(v, Path) else v

        return ({self.TAG[0]: self.TAG[1]} if self.TAG else {}) | {k: flat(v) for k, v in vars(self).items() if v is not None}
