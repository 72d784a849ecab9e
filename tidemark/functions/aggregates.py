"""Aggregate functions as native Columns.

``v`` is a field column (null: no sample), ``ts`` its timestamp in nanoseconds and ``o`` a
struct that orders samples. Counter functions read the sample before from columns that
``operators.previous`` has added. All combine partially before a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1e9


def seconds(ns: Column) -> Column:
    return ns.cast("double") / F.lit(SECOND)


def present(v: Column, x: Column) -> Column:
    """``x`` where there is a sample of ``v``."""
    return F.when(v.isNotNull(), x)


def increase_step(v: Column, before: Column) -> Column:
    """What a sample adds to a counter: after a drop the new value itself counts."""
    return F.when(before.isNotNull() & v.isNotNull(), F.when(v >= before, v - before).otherwise(v)).cast("double")


def plain(function: str, v: Column, ts: Column, o: Column) -> Column:
    first, last = F.min_by(v, present(v, o)), F.max_by(v, present(v, o))
    return {
        "count": lambda: F.nullif(F.count(v), F.lit(0)),
        "sum": lambda: F.sum(v),
        "avg": lambda: F.avg(v),
        "min": lambda: F.min(v),
        "bottom": lambda: F.min(v),
        "max": lambda: F.max(v),
        "top": lambda: F.max(v),
        "first": lambda: first,
        "last": lambda: last,
        "delta": lambda: F.when(F.count(v) > 1, last - first),
        "spread": lambda: F.max(v) - F.min(v),
        "median": lambda: F.median(v).cast("double"),
        "window_median": lambda: F.when(F.count(v) > 1, F.median(v).cast("double")),
        "window_derivative": lambda: (last - first) / F.nullif(seconds(F.max(present(v, ts)) - F.min(present(v, ts))), F.lit(0.0)),
        "stddev": lambda: F.stddev_pop(v),
        "stdvar": lambda: F.var_pop(v),
    }[function]()


def counter(function: str, v: Column, ts: Column, o: Column, before: Column, before_ts: Column) -> Column:
    step = increase_step(v, before)
    total = F.when(F.count(v) > 1, F.coalesce(F.sum(step), F.lit(0.0)))
    if function == "increase":
        return total
    if function == "rate":
        span = seconds(F.max(present(v, ts)) - F.min(present(v, ts)))
        return F.when(span > 0, total / span)
    pair = F.max_by(F.struct(step.alias("step"), seconds(ts - before_ts).alias("span")), present(v, o))
    return F.when(pair["span"] > 0, pair["step"] / pair["span"])
