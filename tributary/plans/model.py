"""Plans of sync rules: streams of queries, and what their text means."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from typing import Any


class RuleError(ValueError):
    """A rule that cannot be compiled."""


@dataclass(frozen=True)
class Column:
    name: str


@dataclass(frozen=True)
class Literal:
    value: str | int | bool | None


@dataclass(frozen=True)
class Binding:
    """A value of the request. kind: auth, user_id, claim, subscription, connection, request, array or lookup."""

    kind: str
    name: str = ""


Operand = Column | Literal | Binding


@dataclass(frozen=True)
class Compare:
    """op is '=' or 'IN'; IN has a list of literals or one operand on the right."""

    op: str
    left: Operand
    right: Operand | tuple[Literal, ...]


@dataclass(frozen=True)
class IsNull:
    operand: Operand
    negated: bool = False


@dataclass(frozen=True)
class Logic:
    """op is 'AND' or 'OR'."""

    op: str
    terms: tuple[Any, ...]


Predicate = Compare | IsNull | Logic


@dataclass(frozen=True)
class Output:
    """A column of the projection: an alias and the parts that are concatenated (one part: the column itself)."""

    alias: str
    parts: tuple[Column | Literal, ...]


@dataclass(frozen=True)
class Projection:
    star: bool
    outputs: tuple[Output, ...] = ()


@dataclass(frozen=True)
class Parameter:
    """A document belongs to the buckets whose value equals column, or is in it if it is an array."""

    column: str
    binding: Binding
    array: bool = False


@dataclass(frozen=True)
class Lookup:
    """Rows of a table: key columns matched to the request, a selected column, and a filter on the row."""

    table: str
    keys: tuple[tuple[str, Binding], ...]
    selected: str
    row_filter: tuple[tuple[str, str | None, bool], ...] = ()  # (column, text or null, equal)

    @property
    def lookup_id(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Query:
    source: str
    output: str
    projection: Projection
    parameters: tuple[Parameter, ...] = ()
    row_filter: Predicate | None = None
    request_filter: Predicate | None = None
    lookup: Lookup | None = None


@dataclass(frozen=True)
class Stream:
    name: str
    queries: tuple[Query, ...]
    auto_subscribe: bool = False

    def groups(self) -> list[list[Query]]:
        """Queries that share parameters and request filter, in order; a group's place is part of its bucket names."""
        out: dict[tuple, list[Query]] = {}
        for q in self.queries:
            out.setdefault((q.parameters, q.request_filter, q.lookup), []).append(q)
        return list(out.values())


@dataclass(frozen=True)
class Plan:
    streams: tuple[Stream, ...]
    tables: dict[str, list[str]] = field(default_factory=dict)

    def stream(self, name: str) -> Stream:
        for s in self.streams:
            if s.name == name:
                return s
        raise RuleError(f"unknown stream {name}")

    def lookups(self) -> list[Lookup]:
        return list(dict.fromkeys(q.lookup for s in self.streams for q in s.queries if q.lookup))

    def sources(self) -> list[str]:
        return list(dict.fromkeys(q.source for s in self.streams for q in s.queries))

    def route_columns(self, output: str) -> list[tuple[str, ...]]:
        """The distinct sets of route columns of a document type."""
        return list(dict.fromkeys(tuple(p.column for p in q.parameters) for s in self.streams for q in s.queries if q.output == output))

    def to_dict(self) -> dict:
        def plain(x: Any) -> Any:
            if isinstance(x, (Compare, IsNull, Logic, Column, Literal, Binding)):
                return {type(x).__name__.lower(): {k: plain(v) for k, v in vars(x).items()}}
            if hasattr(x, "__dataclass_fields__"):
                return {k: plain(v) for k, v in vars(x).items()}
            return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x

        return {"streams": [plain(s) for s in self.streams]}

    @property
    def contract_id(self) -> str:
        """Changes whenever stored state would have another layout or content."""
        return hashlib.sha256(json.dumps(self.to_dict(), sort_keys=True).encode()).hexdigest()[:16]
