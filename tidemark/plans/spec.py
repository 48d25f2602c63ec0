"""Feature and label specs: data, checked in full before anything runs."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from datetime import timedelta
from pathlib import Path
from typing import Any

from tidemark.functions.expressions import DERIVED_NODES, FILTER_NODES, literals_compared, names_in
from tidemark.functions.times import duration, micros
from tidemark.plans.contract import EventContract

OPS = ("count", "sum", "avg", "min", "max", "last_k", "approx_distinct")
UPDATE_POLICIES = ("append_only", "componentwise_monotonic", "window_replace")
FALLBACKS = ("omit", "default_value", "fail")
_NAME, _TABLE = re.compile(r"[a-z][a-z0-9_]*"), re.compile(r"[a-z][a-z0-9_]*\.[a-z][a-z0-9_]*")


def _demand(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _build(kind: type, data: Any, where: str):
    _demand(isinstance(data, dict), f"{where} must be a mapping")
    known = {f.name for f in fields(kind)}
    _demand(set(data) <= known, f"{where}: unknown fields {sorted(set(data) - known)}")
    try:
        return kind(**data)
    except TypeError as e:
        raise ValueError(f"{where}: {e}") from None


@dataclass(frozen=True)
class Aggregation:
    name: str
    op: str
    column: str | None = None
    filter: str | None = None
    k: int | None = None

    def __post_init__(self) -> None:
        _demand(bool(_NAME.fullmatch(self.name)), f"bad aggregation name {self.name!r}")
        _demand(self.op in OPS, f"{self.name}: unknown op {self.op!r}")
        _demand(self.op == "count" or bool(self.column), f"{self.name}: {self.op} needs a column")
        _demand((self.op == "last_k") == (self.k is not None), f"{self.name}: k belongs to last_k alone")
        _demand(self.k is None or (isinstance(self.k, int) and self.k >= 1), f"{self.name}: k must be at least 1")
        if self.filter:
            names_in(self.filter, FILTER_NODES)


@dataclass(frozen=True)
class Window:
    size: timedelta
    slide: timedelta
    boundary: str = "right_closed"

    def __post_init__(self) -> None:
        object.__setattr__(self, "size", duration(self.size))
        object.__setattr__(self, "slide", duration(self.slide))
        _demand(self.boundary == "right_closed", "the boundary must be right_closed")
        _demand(self.size > timedelta(0) and self.slide > timedelta(0), "window size and slide must be positive")
        _demand(self.size % self.slide == timedelta(0), "the slide must divide the size")


@dataclass(frozen=True)
class Fallback:
    policy: str = "omit"
    defaults: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Online:
    store: str
    ttl: timedelta
    update_policy: str
    fallback: Fallback = Fallback()

    def __post_init__(self) -> None:
        object.__setattr__(self, "ttl", duration(self.ttl))
        if isinstance(self.fallback, dict):
            object.__setattr__(self, "fallback", _build(Fallback, self.fallback, "fallback"))
        _demand(self.store in ("redis", "cassandra"), f"unknown online store {self.store!r}")
        _demand(self.update_policy in UPDATE_POLICIES, f"unknown update policy {self.update_policy!r}")
        _demand(self.fallback.policy in FALLBACKS, f"unknown fallback {self.fallback.policy!r}")


@dataclass(frozen=True)
class FeatureSpec:
    name: str
    version: int
    owner: str
    description: str
    entity: str | list[str]
    source: str
    aggregations: list
    window: Any
    lateness: dict
    dedupe: dict
    online: Any
    offline: dict
    freshness_slo: Any
    derived: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        put = object.__setattr__
        put(self, "aggregations", [a if isinstance(a, Aggregation) else _build(Aggregation, a, "aggregation") for a in self.aggregations])
        put(self, "window", self.window if isinstance(self.window, Window) else _build(Window, self.window, "window"))
        put(self, "online", self.online if isinstance(self.online, Online) else _build(Online, self.online, "online"))
        put(self, "freshness_slo", duration(self.freshness_slo))
        put(self, "lateness", {k: duration(self.lateness[k]) for k in ("watermark_delay", "allowed")})
        put(self, "dedupe", {"key": self.dedupe["key"], "ttl": duration(self.dedupe["ttl"])})
        _demand(bool(_NAME.fullmatch(self.name)), f"bad name {self.name!r}")
        _demand(isinstance(self.version, int) and self.version >= 1, "the version must be 1 or more")
        _demand(bool(self.aggregations), "a spec needs an aggregation")
        _demand(self.offline.get("store") == "iceberg" and bool(_TABLE.fullmatch(self.offline.get("table", ""))), "offline needs store iceberg and a namespace.table")
        own = [a.name for a in self.aggregations]
        _demand(len(set(own)) == len(own), "aggregation names must differ")
        _demand(not set(own) & set(self.derived), "derived names must differ from aggregations")
        for name, text in self.derived.items():
            odd = names_in(text, DERIVED_NODES) - set(own)
            _demand(not odd, f"derived {name}: unknown names {sorted(odd)}")
        _demand(self.dedupe["ttl"] >= self.window.size + self.lateness["allowed"], "dedupe.ttl must cover the window and the allowed lateness")
        _demand(self.online.ttl >= self.window.size, "online.ttl must cover the window")
        back = self.online.fallback
        if back.policy == "default_value":
            _demand(set(back.defaults) == {*own, *self.derived}, "defaults must name exactly the outputs")
        else:
            _demand(not back.defaults, "defaults belong to default_value")
        if self.online.update_policy != "window_replace":
            _demand(all(a.op == "count" for a in self.aggregations), f"{self.online.update_policy} orders counts only")
        if self.online.update_policy == "append_only":
            _demand(len(own) == 1, "append_only has one aggregation")

    @property
    def keys(self) -> list[str]:
        return [self.entity] if isinstance(self.entity, str) else list(self.entity)

    @property
    def outputs(self) -> list[str]:
        return [*(a.name for a in self.aggregations), *self.derived]

    @property
    def size_us(self) -> int:
        return micros(self.window.size)

    def check(self, contract: EventContract) -> FeatureSpec:
        """Every field the spec reads must be in the contract."""
        read = {*self.keys, self.dedupe["key"]}
        for a in self.aggregations:
            read |= ({a.column} if a.column else set()) | (names_in(a.filter, FILTER_NODES) if a.filter else set())
        _demand(read <= set(contract.columns), f"{self.name}: not in the event contract: {sorted(read - set(contract.columns))}")
        return self


@dataclass(frozen=True)
class LabelSpec:
    name: str
    version: int
    owner: str
    description: str
    entity: str | list[str]
    source: str
    outcome: dict
    horizon: Any
    dedupe: dict

    def __post_init__(self) -> None:
        object.__setattr__(self, "horizon", duration(self.horizon))
        _demand(bool(_NAME.fullmatch(self.name)), f"bad name {self.name!r}")
        _demand(self.version >= 1, "the version must be 1 or more")
        _demand(set(self.outcome) <= {"op", "filter"} and self.outcome.get("op") in ("exists", "count"), "the outcome op is exists or count")
        _demand(self.horizon > timedelta(0), "the horizon must be positive")
        _demand(len(set(self.keys)) == len(self.keys) > 0, "entity keys must differ")
        if self.outcome.get("filter"):
            names_in(self.outcome["filter"], FILTER_NODES)

    @property
    def keys(self) -> list[str]:
        return [self.entity] if isinstance(self.entity, str) else list(self.entity)

    def check(self, contract: EventContract) -> LabelSpec:
        """Fields and compared event types must be in the contract."""
        text = self.outcome.get("filter")
        read = {*self.keys, self.dedupe["key"]} | (names_in(text, FILTER_NODES) if text else set())
        _demand(read <= set(contract.columns), f"{self.name}: not in the event contract: {sorted(read - set(contract.columns))}")
        for column, allowed in contract.allowed.items():
            odd = literals_compared(text, column) - set(allowed) if text else set()
            _demand(not odd, f"{self.name}: {column} never is {sorted(map(str, odd))}")
        return self


def load(path: str, contract: EventContract | None = None) -> FeatureSpec | LabelSpec:
    """A spec from a YAML file; one with an ``outcome`` is a label spec."""
    import yaml

    data = yaml.safe_load(Path(path).read_text())
    spec = _build(LabelSpec if isinstance(data, dict) and "outcome" in data else FeatureSpec, data, path)
    return spec.check(contract) if contract else spec


def feature(name: str, entity, aggregations: list[dict], window: str, slide: str | None = None, derived: dict | None = None, **more) -> FeatureSpec:
    """A feature spec with the usual surroundings filled in."""
    size = duration(window)
    policy = more.pop("update_policy", "window_replace")
    online = {"store": "redis", "ttl": size + timedelta(hours=1), "update_policy": policy} | more.pop("online", {})
    base = {
        "version": 1, "owner": "tidemark", "description": name, "source": "events", "lateness": {"watermark_delay": "10m", "allowed": "30m"},
        "dedupe": {"key": "event_id", "ttl": size + timedelta(days=1)}, "offline": {"store": "iceberg", "table": f"features.{name}"}, "freshness_slo": "5m",
    }
    return FeatureSpec(name=name, entity=entity, aggregations=aggregations, window={"size": window, "slide": slide or window}, derived=derived or {}, online=online, **(base | more))


def label(name: str, entity, op: str, horizon: str, filter: str | None = None, **more) -> LabelSpec:
    outcome = {"op": op} | ({"filter": filter} if filter else {})
    base = {"version": 1, "owner": "tidemark", "description": name, "source": "events", "dedupe": {"key": "event_id"}}
    return LabelSpec(name=name, entity=entity, outcome=outcome, horizon=horizon, **(base | more))
