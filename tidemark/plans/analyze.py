"""Validation against a measurement's schema; run on every path."""

from __future__ import annotations

from ..errors import QueryError
from ..functions import registry
from . import model as m
from .model import Query, to_ns


def _value_type(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    return {int: "bigint", float: "double", str: "string"}.get(type(value), "unknown")


def analyze(q: Query, fields: dict[str, str]) -> None:
    """Raise a ``QueryError`` with a stable code unless the query is sound for ``fields`` (name to Spark type)."""
    if not q.measurement:
        raise QueryError("invalid-measurement", "measurement is empty")
    if q.window < 0:
        raise QueryError("invalid-window", "window must not be negative")
    if q.limit < 0 or q.offset < 0:
        raise QueryError("invalid-pagination", "limit and offset must not be negative")
    if not fields:
        raise QueryError("measurement-not-found", f"{q.measurement} has no fields")
    for name in q.fields:
        if name not in fields:
            raise QueryError("field-not-found", f"no field {name!r}")
    for a in q.aggregates:
        for name in [a.field] if a.field else fields:
            if name not in fields:
                raise QueryError("field-not-found", f"no field {name!r}")
            registry.check(a.function, fields[name])
        if a.function in registry.TRANSFORMS and (q.window or q.group_tags):
            raise QueryError("unsupported-function", f"{a.function} goes with neither windows nor tag groups")
    for p in m.leaves(q.where):
        if p.kind == m.TIME_RANGE:
            start, end = (to_ns(x, q.precision) for x in p.values)
            if end and start > end:
                raise QueryError("invalid-time-range", "start is after end")
        elif p.kind.startswith("field"):
            _check_field(p, fields)
    if q.start is not None and q.end and q.start > q.end:
        raise QueryError("invalid-time-range", "start is after end")
    for t in (q.start, q.end):
        if t is not None:
            to_ns(t, q.precision)
    if q.window and not q.aggregates:
        raise QueryError("invalid-group", "a time group needs an aggregate")
    if q.group_tags and not q.aggregates:
        raise QueryError("invalid-group", "a tag group needs an aggregate")
    if q.precision not in m.NS:
        raise QueryError("invalid-precision", f"unknown precision {q.precision!r}")


def _check_field(p: m.Predicate, fields: dict[str, str]) -> None:
    if p.name not in fields:
        raise QueryError("field-not-found", f"no field {p.name!r}")
    have, given = fields[p.name], _value_type(p.value)
    numbers = have in m.NUMERIC and given in m.NUMERIC
    if not (numbers or (have == given and p.kind not in m.COMPARISONS)):
        raise QueryError("function-type-mismatch", f"{p.kind} of {p.name!r} ({have}) with a {given} value")
