"""Errors with stable codes."""

from __future__ import annotations

#: The codes that callers match on.
CODES = frozenset({
    "measurement-not-found", "field-not-found", "unsupported-function", "function-type-mismatch", "invalid-window", "invalid-pagination", "invalid-group",
    "invalid-measurement", "invalid-time-range", "syntax", "invalid-precision", "invalid-cursor", "read-budget-exceeded", "field-type-conflict", "cardinality-limit",
    "not-found", "invalid-options", "invalid-point", "invalid-policy", "insufficient-samples",
})


class QueryError(ValueError):
    """A refused request; ``code`` is one of ``CODES``."""

    def __init__(self, code: str, message: str):
        assert code in CODES, code
        super().__init__(f"{code}: {message}")
        self.code = code
