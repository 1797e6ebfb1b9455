"""Parameters out of TOML: strict types, no unknown keys, checks across fields, one hash per content; and small documents beside them."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import tomllib
from collections.abc import Callable, Mapping, Sequence
from dataclasses import MISSING, dataclass, field, fields, is_dataclass
from typing import get_args, get_origin, get_type_hints

from tideline.functions.timeops import DAY_MS, HOUR_MS
from tideline.operators.selection import Limits

HASH_MAGIC = "params-1:"


class ConfigError(ValueError):
    """A document that does not say what it must."""


def date_ms(value: object) -> int:
    """Milliseconds of a ``YYYY-MM-DD`` text or a date; anything else is an error."""
    if isinstance(value, str):
        if len(value) != 10 or value[4] != "-" or value[7] != "-":
            raise ConfigError(f"no date: {value!r}")
        try:
            value = dt.date.fromisoformat(value)
        except ValueError as e:
            raise ConfigError(f"no date: {value!r}") from e
    if isinstance(value, dt.datetime) or not isinstance(value, dt.date):
        raise ConfigError(f"no date: {value!r}")
    return (value - dt.date(1970, 1, 1)).days * DAY_MS


def _typed(kind: object, value: object, at: str) -> object:
    if get_origin(kind) is tuple:
        if not isinstance(value, list):
            raise ConfigError(f"{at}: a list is needed")
        return tuple(_typed(get_args(kind)[0], v, f"{at}[{i}]") for i, v in enumerate(value))
    if is_dataclass(kind):
        return build(kind, value, at)
    if kind is dt.date:
        return date_ms(value)
    if isinstance(value, bool) != (kind is bool) or not isinstance(value, kind):
        raise ConfigError(f"{at}: {getattr(kind, '__name__', kind)} is needed, not {value!r}")
    return value


def build(kind: type, table: object, at: str = "") -> object:
    """An instance of a dataclass out of a table that has its fields, each of its very type, and no others."""
    if not isinstance(table, Mapping):
        raise ConfigError(f"{at or 'the document'}: a table is needed")
    hints, known = get_type_hints(kind), {f.name: f for f in fields(kind)}
    if unknown := sorted(set(table) - set(known)):
        raise ConfigError(f"{at or 'the document'}: unknown {unknown}")
    missing = sorted(n for n, f in known.items() if n not in table and f.default is MISSING and f.default_factory is MISSING)
    if missing:
        raise ConfigError(f"{at or 'the document'}: missing {missing}")
    return kind(**{n: _typed(hints[n], v, f"{at}.{n}".lstrip(".")) for n, v in table.items()})


@dataclass(frozen=True)
class Window:
    start: dt.date
    days: int

    @property
    def span(self) -> tuple[int, int]:
        return self.start, self.start + self.days * DAY_MS


@dataclass(frozen=True)
class Capital:
    unit: int
    least: int
    most: int
    grid: tuple[int, ...]
    groups: tuple[int, ...]
    primary: int

    def groups_for(self, capital: int) -> int:
        return max(self.least, min(self.most, capital // self.unit))

    def __post_init__(self) -> None:
        want = tuple(self.groups_for(c) for c in self.grid)
        if self.groups != want:
            raise ConfigError(f"capital.groups must be {want}")
        if self.primary not in self.grid:
            raise ConfigError("capital.primary must be in capital.grid")


@dataclass(frozen=True)
class Delays:
    primary_s: float
    grid_s: tuple[float, ...] = ()

    @property
    def grid_ms(self) -> tuple[int, ...]:
        return tuple(round(s * 1000) for s in self.grid_s)


@dataclass(frozen=True)
class Symbol:
    coin: str
    symbol: str


@dataclass(frozen=True)
class Archive:
    quote: str
    exceptions: tuple[Symbol, ...] = ()

    def __post_init__(self) -> None:
        coins = [e.coin for e in self.exceptions]
        if len(coins) != len(set(coins)):
            raise ConfigError("archive.exceptions lists a coin twice")


@dataclass(frozen=True)
class Filters:
    role: str
    account_value: float
    closed_episodes: int
    active_blocks: int
    shortest_h: float
    longest_days: float
    taker_pct: float
    open_coins: int
    universe_pct: float
    liquidated_fills: int
    max_fills: int
    tolerance_bps: float

    @property
    def limits(self) -> Limits:
        same = {n: getattr(self, n) for n in ("role", "account_value", "closed_episodes", "active_blocks", "taker_pct", "open_coins", "universe_pct", "liquidated_fills", "max_fills", "tolerance_bps")}
        return Limits(**same, shortest_ms=self.shortest_h * HOUR_MS, longest_ms=self.longest_days * DAY_MS)


@dataclass(frozen=True)
class Params:
    selection: Window
    evaluation: Window
    capital: Capital
    delays: Delays
    archive: Archive
    filters: Filters

    def __post_init__(self) -> None:
        if self.selection.span[1] > self.evaluation.span[0]:
            raise ConfigError("selection must end before evaluation begins")

    def hash(self) -> str:
        """SHA-256 of all values in one spelling; comments, order and layout of the document do not count."""
        plain = lambda v: {f.name: plain(getattr(v, f.name)) for f in fields(v)} if is_dataclass(v) else [plain(x) for x in v] if isinstance(v, tuple) else v
        return hashlib.sha256((HASH_MAGIC + json.dumps(plain(self), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)).encode()).hexdigest()


def _toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(f"no TOML: {e}") from e


def params(text: str) -> Params:
    return build(Params, _toml(text))


def assets(text: str, always: Sequence[str] = ()) -> tuple[str, ...]:
    """The list ``coins``: names, none twice, those of ``always`` among them."""
    table = _toml(text)
    if set(table) != {"coins"} or not isinstance(table["coins"], list) or not all(isinstance(c, str) and c for c in table["coins"]):
        raise ConfigError("only a list coins of names is needed")
    coins = tuple(table["coins"])
    if len(set(coins)) != len(coins):
        raise ConfigError("a coin is listed twice")
    if gone := [c for c in always if c not in coins]:
        raise ConfigError(f"missing {gone}")
    return coins


# -- costs: a document that only grows ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Cost:
    half_spread_bps: float
    measured_days: tuple[int, ...] = field(default=())


def _unique(pairs: list) -> dict:
    keys = [k for k, _ in pairs]
    if len(set(keys)) != len(keys):
        raise ConfigError("a key stands twice")
    return dict(pairs)


def parse_costs(text: str) -> dict[str, Cost]:
    try:
        table = json.loads(text, object_pairs_hook=_unique)
    except json.JSONDecodeError as e:
        raise ConfigError(f"no JSON: {e}") from e
    out = {c: build(Cost, v, c) for c, v in table.items()}
    if bad := [c for c, v in out.items() if not 0 <= v.half_spread_bps < float("inf")]:
        raise ConfigError(f"half spreads must be finite and not negative: {bad}")
    return out


def dump_costs(costs: Mapping[str, Cost]) -> str:
    """One spelling per content: keys in order, two blanks of indent, a line feed at the end."""
    return json.dumps({c: {"half_spread_bps": v.half_spread_bps, "measured_days": list(v.measured_days)} for c, v in costs.items()}, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n"


def add_costs(known: Mapping[str, Cost], measured: Mapping[str, Cost]) -> dict[str, Cost]:
    """``known`` with new coins added; another value for a known coin is an error."""
    if clash := sorted(c for c in measured if c in known and known[c] != measured[c]):
        raise ConfigError(f"costs that are there are never changed: {clash}")
    return dict(known) | dict(measured)


def settings(names: Mapping[str, Callable[[str], object]], env: Mapping[str, str] = os.environ) -> dict[str, object]:
    """Typed values of environment variables; a missing one is None, one that cannot be read an error."""
    out: dict[str, object] = {}
    for name, kind in names.items():
        try:
            out[name] = kind(env[name]) if env.get(name) else None
        except ValueError as e:
            raise ConfigError(f"{name}: {e}") from e
    return out
