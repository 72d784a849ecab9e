"""The fluent query builder."""

from __future__ import annotations

from dataclasses import replace
from datetime import UTC, datetime

from ..errors import QueryError
from .model import Aggregate, Budget, Expr, Predicate, Query, _tree, and_expr, normal_function, tag_eq, time_range


def _clean(names: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(n for n in (x.strip() for x in names) if n)


def as_ns(when: datetime) -> int:
    """A datetime, UTC where it has no zone, as nanoseconds."""
    when = when if when.tzinfo else when.replace(tzinfo=UTC)
    delta = when - datetime(1970, 1, 1, tzinfo=UTC)
    return (delta.days * 86_400 + delta.seconds) * 1_000_000_000 + delta.microseconds * 1_000


class QueryBuilder:
    """Collects a ``Query``; every method returns the builder, ``build`` checks and returns the query."""

    def __init__(self):
        self._q = Query()

    def _with(self, **changes) -> QueryBuilder:
        self._q = replace(self._q, **changes)
        return self

    def select(self, *fields: str) -> QueryBuilder:
        """Fields to return; none selects all."""
        return self._with(fields=_clean(fields))

    def from_(self, database: str, retention_policy: str, measurement: str) -> QueryBuilder:
        return self._with(database=database, retention_policy=retention_policy, measurement=measurement)

    def from_measurement(self, measurement: str) -> QueryBuilder:
        return self._with(measurement=measurement)

    def from_downsample_policy(self, policy) -> QueryBuilder:
        """Read a policy's target: its measurement, and only points that bear its tag."""
        return self.from_(policy.target_database, policy.target_retention, policy.target_measurement).where(tag_eq(policy.policy_tag, policy.name))

    def where(self, *predicates: Predicate) -> QueryBuilder:
        for p in predicates:
            self.where_expr(_tree(p))
        return self

    def where_expr(self, expr: Expr) -> QueryBuilder:
        """Successive conditions are joined by AND."""
        return self._with(where=expr if self._q.where is None else and_expr(self._q.where, expr))

    def tags(self, tags: dict[str, str]) -> QueryBuilder:
        """Exact tag values; an empty value also matches an absent tag."""
        return self._with(tags={**self._q.tags, **tags})

    def time_range(self, start: int, end: int) -> QueryBuilder:
        return self.where(time_range(start, end))

    def time_range_time(self, start: datetime, end: datetime) -> QueryBuilder:
        return self._with(precision="ns").where(time_range(as_ns(start), as_ns(end)))

    def precision(self, precision: str) -> QueryBuilder:
        return self._with(precision=precision)

    def aggregate(self, function: str, field: str) -> QueryBuilder:
        return self._with(aggregates=(*self._q.aggregates, Aggregate(normal_function(function), field.strip())))

    def group_by_tags(self, *tags: str) -> QueryBuilder:
        return self._with(group_tags=_clean(tags))

    def group_by_time(self, window: int) -> QueryBuilder:
        return self._with(window=window)

    def order_by_time_asc(self) -> QueryBuilder:
        return self._with(descending=False)

    def order_by_time_desc(self) -> QueryBuilder:
        return self._with(descending=True)

    def limit(self, limit: int) -> QueryBuilder:
        return self._with(limit=limit)

    def offset(self, offset: int) -> QueryBuilder:
        return self._with(offset=offset)

    def cursor(self, token: str) -> QueryBuilder:
        return self._with(cursor=token)

    def budget(self, max_shards: int = 0, max_parts: int = 0, max_samples: int = 0) -> QueryBuilder:
        return self._with(budget=Budget(max_shards, max_parts, max_samples))

    def strict(self, strict: bool = True) -> QueryBuilder:
        """Refuse groups too small for a counter function instead of leaving them out."""
        return self._with(strict=strict)

    def build(self) -> Query:
        if not self._q.measurement.strip():
            raise QueryError("invalid-measurement", "measurement is empty")
        if self._q.limit < 0 or self._q.offset < 0:
            raise QueryError("invalid-pagination", "limit and offset must not be negative")
        if self._q.window < 0:
            raise QueryError("invalid-window", "window must not be negative")
        return self._q


def new_query() -> QueryBuilder:
    return QueryBuilder()
