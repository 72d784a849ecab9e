"""What a query says: predicates, boolean trees, aggregates, grouping, order, budgets."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import QueryError

NS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000, "": 1}
MAX_TS, MIN_TS = (1 << 63) - 1, -(1 << 63)
TYPES = {"double": "float64", "bigint": "int64", "string": "string", "boolean": "bool"}
NUMERIC = ("double", "bigint")

#: Predicate kinds.
TIME_RANGE, TAG_EQ, TAG_NE, TAG_EXISTS, TAG_IN = "time_range", "tag_eq", "tag_ne", "tag_exists", "tag_in"
FIELD_EQ, FIELD_NE, FIELD_GT, FIELD_GTE, FIELD_LT, FIELD_LTE = "field_eq", "field_ne", "field_gt", "field_gte", "field_lt", "field_lte"
COMPARISONS = (FIELD_GT, FIELD_GTE, FIELD_LT, FIELD_LTE)


def to_ns(value: int, precision: str = "ns") -> int:
    """A timestamp in ``precision`` as nanoseconds; an overflow of 64 bits is refused."""
    if precision not in NS:
        raise QueryError("invalid-precision", f"unknown precision {precision!r}")
    if not MIN_TS <= value * NS[precision] <= MAX_TS:
        raise QueryError("invalid-precision", f"timestamp {value} overflows nanoseconds")
    return value * NS[precision]


@dataclass(frozen=True)
class Predicate:
    kind: str
    name: str = ""
    value: object = None
    values: tuple = ()


@dataclass(frozen=True)
class Expr:
    """``op`` is ``leaf``, ``and``, ``or`` or ``not``. AND of nothing is true, OR and NOT of nothing false."""

    op: str
    leaf: Predicate | None = None
    children: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Aggregate:
    function: str
    field: str = ""

    @property
    def output(self) -> str:
        return f"{self.function}({self.field})"


@dataclass(frozen=True)
class Budget:
    """Read limits; 0 is none."""

    max_shards: int = 0
    max_parts: int = 0
    max_samples: int = 0


@dataclass(frozen=True)
class Query:
    """A query over one measurement. Times are in ``precision``, windows in nanoseconds."""

    measurement: str = ""
    database: str = ""
    retention_policy: str = ""
    fields: tuple[str, ...] = ()
    tags: dict[str, str] = field(default_factory=dict)
    start: int | None = None
    end: int | None = None
    where: Expr | None = None
    aggregates: tuple[Aggregate, ...] = ()
    group_tags: tuple[str, ...] = ()
    window: int = 0
    descending: bool = False
    limit: int = 0
    offset: int = 0
    cursor: str = ""
    precision: str = "ns"
    budget: Budget = Budget()
    strict: bool = False


def normal_function(name: str) -> str:
    name = name.strip().lower()
    return "avg" if name == "mean" else name


def time_range(start: int, end: int) -> Predicate:
    """Inclusive at both ends; an end of 0 is unbounded."""
    return Predicate(TIME_RANGE, values=(start, end))


def tag_eq(name: str, value: str) -> Predicate:
    return Predicate(TAG_EQ, name, value)


def tag_ne(name: str, value: str) -> Predicate:
    """Also true where the tag is absent."""
    return Predicate(TAG_NE, name, value)


def tag_exists(name: str) -> Predicate:
    return Predicate(TAG_EXISTS, name)


def tag_in(name: str, *values: str) -> Predicate:
    return Predicate(TAG_IN, name, values=values)


def field_eq(name: str, value: object) -> Predicate:
    return Predicate(FIELD_EQ, name, value)


def field_ne(name: str, value: object) -> Predicate:
    """True only where the field is present."""
    return Predicate(FIELD_NE, name, value)


def field_gt(name: str, value: object) -> Predicate:
    return Predicate(FIELD_GT, name, value)


def field_gte(name: str, value: object) -> Predicate:
    return Predicate(FIELD_GTE, name, value)


def field_lt(name: str, value: object) -> Predicate:
    return Predicate(FIELD_LT, name, value)


def field_lte(name: str, value: object) -> Predicate:
    return Predicate(FIELD_LTE, name, value)


def predicate_expr(predicate: Predicate) -> Expr:
    return Expr("leaf", predicate)


def _tree(x: Expr | Predicate) -> Expr:
    return x if isinstance(x, Expr) else predicate_expr(x)


def and_expr(*children: Expr | Predicate) -> Expr:
    return Expr("and", children=tuple(map(_tree, children)))


def or_expr(*children: Expr | Predicate) -> Expr:
    return Expr("or", children=tuple(map(_tree, children)))


def not_expr(*child: Expr | Predicate) -> Expr:
    return Expr("not", children=tuple(map(_tree, child)))


def leaves(expr: Expr | None) -> list[Predicate]:
    if expr is None:
        return []
    return [expr.leaf] if expr.op == "leaf" else [p for c in expr.children for p in leaves(c)]
