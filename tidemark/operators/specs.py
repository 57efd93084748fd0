"""Tables by name and kind, checked when they are named rather than when they run."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from . import sessions, tables, ttl, windows


def _named(name: str, keys: list[str]) -> None:
    if not name or not name.strip():
        raise ValueError("a table needs a name")
    if not keys or len(set(keys)) != len(keys):
        raise ValueError(f"{name}: keys must be given once each")


@dataclass(frozen=True)
class KeyValueTable:
    """Newest version of each key; with a time to live only what it still covers."""

    name: str
    keys: list[str]
    seq: str = "seq"
    value: str | None = None
    ttl: ttl.TimeToLive | None = None
    ms: str = "ms"

    def __post_init__(self):
        _named(self.name, self.keys)

    def of(self, feed: DataFrame, now: Column | int | None = None) -> DataFrame:
        table = tables.latest_by_key(feed, self.keys, self.seq, self.value)
        if self.ttl is None:
            return table
        if now is None:
            raise ValueError(f"{self.name}: a time to live needs the time")
        return ttl.expire(table, self.ms, now, self.ttl)


@dataclass(frozen=True)
class FactTable:
    """First version of each key: written once, never changed."""

    name: str
    keys: list[str]
    seq: str = "seq"

    def __post_init__(self):
        _named(self.name, self.keys)

    def of(self, feed: DataFrame) -> DataFrame:
        return tables.first_by_key(feed, self.keys, self.seq)


@dataclass(frozen=True)
class WindowTable:
    """Aggregates by key and window. Times are milliseconds."""

    name: str
    keys: list[str]
    size: int
    retention: int
    advance: int | None = None
    grace: int | None = None
    segments: int | None = None
    duplicates: bool = False
    aggregates: dict[str, Column] = field(default_factory=dict)

    def __post_init__(self):
        _named(self.name, self.keys)
        if self.size <= 0 or self.retention <= 0:
            raise ValueError(f"{self.name}: size and retention must be positive")
        if self.retention < self.size + (self.grace or 0):
            raise ValueError(f"{self.name}: retention must cover a window and its grace")
        if self.advance is not None and not 0 < self.advance <= self.size:
            raise ValueError(f"{self.name}: advance must be positive and at most the size")
        if self.grace is not None and self.grace < 0:
            raise ValueError(f"{self.name}: grace must not be negative")
        if self.duplicates and self.aggregates:
            raise ValueError(f"{self.name}: a table that keeps duplicates has no aggregates")

    @property
    def n_segments(self) -> int:
        return windows.with_segments(self.retention, self.size, self.segments)

    def of(self, rows: DataFrame, ms: str = "ms", clock: str = "stream_time") -> DataFrame:
        return windows.windowed(rows, self.keys, ms, self.size, self.advance, self.grace, clock, **self.aggregates)


@dataclass(frozen=True)
class SessionTable:
    """Aggregates by key and session: events at most ``gap`` apart."""

    name: str
    keys: list[str]
    gap: int
    retention: int | None = None
    aggregates: dict[str, Column] = field(default_factory=dict)

    def __post_init__(self):
        _named(self.name, self.keys)
        if self.gap <= 0:
            raise ValueError(f"{self.name}: the gap must be positive")
        if self.retention is not None and self.retention < self.gap:
            raise ValueError(f"{self.name}: retention must cover the gap")

    def of(self, rows: DataFrame, ms: str = "ms") -> DataFrame:
        return sessions.session_aggregate(rows, self.keys, ms, self.gap, **self.aggregates)


class Registry:
    """Tables of one application: a name stands for one table, and a change feed
    for the table restored from it."""

    def __init__(self):
        self.tables: dict[str, object] = {}
        self.feeds: dict[str, str] = {}

    def add(self, table, feed: str | None = None):
        if table.name in self.tables:
            raise ValueError(f"two tables are named {table.name}")
        if feed is not None and feed in self.feeds:
            raise ValueError(f"{feed} already feeds {self.feeds[feed]}")
        self.tables[table.name] = table
        if feed is not None:
            self.feeds[feed] = table.name
        return table
