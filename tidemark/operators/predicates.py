"""Boolean trees as Columns.

Under a NOT every leaf is true or false, never null. Elsewhere a null condition counts as false
to a filter anyway, and plain comparisons reach the scan.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans import model as m
from ..plans.model import Expr, Predicate, Query, to_ns


def _nothing(value: bool) -> Column:
    return F.lit(value)


def _known(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def literal(value: object, kind: str) -> Column:
    """A literal to compare with a field of type ``kind``; numbers keep their own type, so comparisons are exact."""
    return F.lit(value) if kind in m.NUMERIC else F.lit(value).cast(kind)


def leaf(p: Predicate, q: Query, tags: frozenset[str], fields: dict[str, str], ts: str = "ts", *, safe: bool = True) -> Column:
    known = _known if safe else lambda c: c
    if p.kind == m.TIME_RANGE:
        return between(F.col(ts), *bounds(p, q.precision))
    if p.kind in (m.TAG_EQ, m.TAG_NE, m.TAG_EXISTS, m.TAG_IN):
        if p.name not in tags:
            return _nothing(p.kind == m.TAG_NE)
        c = F.col(f"`{p.name}`")
        return {
            m.TAG_EQ: lambda: known(c == F.lit(p.value)),
            m.TAG_NE: lambda: c.isNull() | (c != F.lit(p.value)),
            m.TAG_EXISTS: lambda: c.isNotNull(),
            m.TAG_IN: lambda: known(c.isin(*p.values)) if p.values else _nothing(False),
        }[p.kind]()
    c, x = F.col(f"`{p.name}`"), literal(p.value, fields[p.name])
    return known({m.FIELD_EQ: c == x, m.FIELD_NE: c != x, m.FIELD_GT: c > x, m.FIELD_GTE: c >= x, m.FIELD_LT: c < x, m.FIELD_LTE: c <= x}[p.kind])


def tree(e: Expr, *context, safe: bool = False) -> Column:
    if e.op == "leaf":
        return leaf(e.leaf, *context, safe=safe)
    parts = [tree(c, *context, safe=safe or e.op == "not") for c in e.children]
    if e.op == "not":
        return ~parts[0] if parts else _nothing(False)
    return reduce(and_ if e.op == "and" else or_, parts) if parts else _nothing(e.op == "and")


def between(ts: Column, start: int | None, end: int | None) -> Column:
    parts = [ts >= F.lit(t) for t in (start,) if t is not None] + [ts <= F.lit(t) for t in (end,) if t is not None]
    return reduce(and_, parts) if parts else _nothing(True)


def bounds(p: Predicate, precision: str) -> tuple[int, int | None]:
    """Nanosecond bounds; an end of 0 is unbounded."""
    start, end = p.values
    return to_ns(start, precision), to_ns(end, precision) if end else None


def scan_bounds(q: Query) -> tuple[int | None, int | None]:
    """The intersection of all time bounds that must hold: the query's own and those under ANDs."""
    starts = [to_ns(t, q.precision) for t in (q.start,) if t is not None]
    ends = [to_ns(t, q.precision) for t in (q.end,) if t]

    def walk(e: Expr | None) -> None:
        if e is None:
            return
        if e.op == "leaf" and e.leaf.kind == m.TIME_RANGE:
            a, b = bounds(e.leaf, q.precision)
            starts.append(a)
            if b is not None:
                ends.append(b)
        elif e.op == "and":
            for c in e.children:
                walk(c)

    walk(q.where)
    return max(starts, default=None), min(ends, default=None)


def exact_tags(tags: dict[str, str], known: frozenset[str]) -> Column:
    """AND of equalities; a value of '' also matches an absent tag."""
    parts = [F.coalesce(F.col(f"`{k}`"), F.lit("")) == F.lit(v) if k in known else _nothing(v == "") for k, v in tags.items()]
    return reduce(and_, parts) if parts else _nothing(True)


def series_search(text: str, measurement: str, tags: list[str]) -> Column:
    """Case-insensitive substring of the measurement or of any present tag's key or value."""
    low = text.lower()
    parts = [_nothing(low in measurement.lower())]
    parts += [F.col(f"`{t}`").isNotNull() & (_nothing(low in t.lower()) | F.lower(F.col(f"`{t}`")).contains(low)) for t in tags]
    return reduce(or_, parts)
