"""The closed set of aggregate functions and their type rules."""

from __future__ import annotations

from ..errors import QueryError
from ..plans.model import NUMERIC

#: Functions that take any type, and those that take numbers only.
ANY_TYPE = frozenset({"count", "first", "last", "mode"})
NUMBERS = frozenset({"sum", "avg", "min", "max", "difference", "derivative", "rate", "irate", "increase", "delta", "spread", "median", "stddev", "stdvar", "top", "bottom"})
#: They return a value for each sample but the first, so they go with neither windows nor tag groups.
TRANSFORMS = frozenset({"difference", "derivative"})
#: They need the sample before.
COUNTERS = frozenset({"rate", "irate", "increase"})
#: They need two samples at least.
PAIRWISE = frozenset({"rate", "irate", "increase", "delta"})


def check(function: str, field_type: str) -> None:
    if function not in ANY_TYPE | NUMBERS:
        raise QueryError("unsupported-function", f"aggregate function {function!r} is not supported")
    if function in NUMBERS and field_type not in NUMERIC:
        raise QueryError("function-type-mismatch", f"{function} needs a numeric field")
