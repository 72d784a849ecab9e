"""A DataFrame seen as a measurement: tags, a timestamp in nanoseconds, typed fields."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError

_EPOCH = datetime(1970, 1, 1)


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True)
class Measurement:
    """``df`` has the tag columns (string, null: absent), ``ts`` (bigint) and field columns (null: no sample).

    ``tie`` names further columns that order samples of equal timestamps. ``series`` names a
    bigint column of series ids, if there is one; else series go by their sorted tags. ``raw``
    is the stored timestamp column, on which time bounds are put so that they reach the scan;
    zone-less ones are UTC. ``ids`` is a table of series with lasting ids.
    """

    df: DataFrame
    name: str
    tags: tuple[str, ...]
    fields: dict[str, str]
    tie: tuple[str, ...] = ()
    series: str | None = None
    raw: str | None = None
    shard: int = 0
    ids: DataFrame | None = None

    @property
    def order_tags(self) -> list[str]:
        return [self.series] if self.series else sorted(self.tags)

    def scan(self, start: int | None, end: int | None) -> Measurement:
        """Bound the time on the stored column, before it is converted."""
        df = self.df
        if self.raw:
            for op, value in ((">=", start), ("<=", end)):
                lit = _bound(value, op == ">=", df.schema[self.raw].dataType)
                if lit is not None:
                    df = df.where(F.col(self.raw) >= lit if op == ">=" else F.col(self.raw) <= lit)
        if self.shard:
            # The partition column follows from ts, but the planner cannot know.
            if start is not None:
                df = df.where(F.col("shard_start") >= F.lit(start // self.shard * self.shard))
            if end is not None:
                df = df.where(F.col("shard_start") <= F.lit(end))
        if self.raw is None:
            if start is not None:
                df = df.where(F.col("ts") >= F.lit(start))
            if end is not None:
                df = df.where(F.col("ts") <= F.lit(end))
        return replace(self, df=df)

    def order(self) -> Column:
        """Orders samples: by time, then series, then tie columns."""
        return F.struct(F.col("ts"), *(_quoted(c) for c in (*self.order_tags, *self.tie)))


def _bound(ns: int | None, up: bool, kind: T.DataType) -> Column | None:
    """A bound as a literal of the stored column's type, whatever the session's time zone."""
    if ns is None:
        return None
    us = -(-ns // 1000) if up else ns // 1000
    if not isinstance(kind, T.TimestampNTZType):
        return F.timestamp_micros(F.lit(us))
    try:
        return F.lit((_EPOCH + timedelta(microseconds=us)).isoformat(sep=" ")).cast(kind)
    except OverflowError:
        return None


def micros(ts: Column, kind: str) -> Column:
    """Microseconds since the epoch of a timestamp column; a zone-less one is UTC, whatever the session's time zone."""
    if kind != "timestamp_ntz":
        return F.unix_micros(ts)
    # The difference of zone-less timestamps is exact, and so is its division.
    return F.call_function("div", ts - F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.expr("INTERVAL '0.000001' SECOND"))


def from_dataframe(df: DataFrame, name: str, *, tags: Sequence[str], fields: Sequence[str], ts: str, tie: Sequence[str] = (), unit: str = "ns") -> Measurement:
    """Adapt any table. ``ts`` is a timestamp column, or an integer one in ``unit``.

    Tags become strings; integers become bigint, decimals and floats double.
    """
    kinds = dict(df.dtypes)
    for c in (*tags, *fields, ts, *tie):
        if c not in kinds:
            raise QueryError("field-not-found", f"no column {c!r}")
    if kinds[ts].startswith("timestamp"):
        stamp, raw = micros(_quoted(ts), kinds[ts]) * F.lit(1000), "_raw_ts"
    else:
        stamp, raw = _quoted(ts).cast("bigint") * F.lit({"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000}[unit]), None

    def kind(c: str) -> str:
        t = kinds[c]
        if t in ("tinyint", "smallint", "int", "bigint"):
            return "bigint"
        if t.startswith(("float", "double", "decimal")):
            return "double"
        if t in ("string", "boolean"):
            return t
        raise QueryError("function-type-mismatch", f"column {c!r} of type {t} cannot be a field")

    types = {c: kind(c) for c in fields}
    hidden = [f"_tie{i}" for i in range(len(tie))]
    out = df.select(
        *(_quoted(t).cast("string").alias(t) for t in tags),
        stamp.alias("ts"),
        *(_quoted(c).cast(t).alias(c) for c, t in types.items()),
        *(_quoted(c).alias(h) for c, h in zip(tie, hidden, strict=True)),
        *([_quoted(ts).alias(raw)] if raw else []),
    )
    return Measurement(out, name, tuple(tags), types, tuple(hidden), raw=raw)
