"""Aggregation over series or tag groups, whole or by time window."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import aggregates, registry
from ..plans.model import Aggregate, Query
from ..sources.measurement import Measurement
from .previous import with_previous


@dataclass(frozen=True)
class Spec:
    """One aggregate of one field with its output name and Spark type."""

    function: str
    field: str
    output: str
    kind: str


def output_type(function: str, field_type: str) -> str:
    if function == "count":
        return "bigint"
    if function in ("avg", "rate", "irate", "increase", "median", "stddev", "stdvar", "derivative"):
        return "double"
    return field_type


def specs(aggregates_: tuple[Aggregate, ...], fields: dict[str, str]) -> list[Spec]:
    """An aggregate without a field is one for each field."""
    return [Spec(a.function, f, f"{a.function}({f})", output_type(a.function, fields[f])) for a in aggregates_ for f in ([a.field] if a.field else fields)]


def bucket(ts: Column, window: int) -> Column:
    """The start of a timestamp's window, aligned to the epoch; negative times go toward zero."""
    return ts - ts % F.lit(window)


def keyed(m: Measurement, q: Query) -> tuple[DataFrame, list[str]]:
    """Rows with group keys ``_g<i>``: listed tags (absent: '') or the whole series, and the window."""
    names = list(q.group_tags) if q.group_tags else list(m.tags)
    cols = {}
    for i, t in enumerate(names):
        tag = F.col(f"`{t}`") if t in m.tags else F.lit(None).cast("string")
        cols[f"_g{i}"] = F.coalesce(tag, F.lit("")) if q.group_tags else tag
    if q.window:
        cols["_w"] = bucket(F.col("ts"), q.window)
    return m.df.withColumns(cols), list(cols)


def long_form(m: Measurement, q: Query) -> tuple[DataFrame, list[str], list[Spec]]:
    """``(key columns, ts, spec, one value column for each type)``; one row for each output sample."""
    todo = specs(q.aggregates, m.fields)
    names = list(q.group_tags) if q.group_tags else list(m.tags)
    wide, kept = _grouped(m, q, [s for s in todo if s.function not in registry.TRANSFORMS])
    out = None
    if kept:
        samples = F.array(*(F.struct(F.lit(todo.index(s)).alias("spec"), F.col(f"_t{i}").alias("ts"), *_typed(s, F.col(f"_v{i}"), todo)) for i, s in enumerate(kept)))
        one = wide.select(*(F.col(f"_g{i}").alias(t) for i, t in enumerate(names)), F.explode(samples).alias("s")).select(*(f"`{t}`" for t in names), "s.*")
        out = one.where(_some(todo))
    moves = [s for s in todo if s.function in registry.TRANSFORMS]
    if moves:
        made = _transformed(m, moves, todo)
        out = made if out is None else out.unionByName(made)
    return out, names, todo


def _types(todo: list[Spec]) -> list[str]:
    return sorted({s.kind for s in todo})


def _typed(s: Spec, v: Column, todo: list[Spec]) -> list[Column]:
    return [(v if k == s.kind else F.lit(None)).cast(k).alias(f"value_{k}") for k in _types(todo)]


def _some(todo: list[Spec]) -> Column:
    out = F.lit(False)
    for k in _types(todo):
        out = out | F.col(f"value_{k}").isNotNull()
    return out


def _grouped(m: Measurement, q: Query, todo: list[Spec]) -> tuple[DataFrame, list[Spec]]:
    """``_g<i>``, values ``_v<i>`` and timestamps ``_t<i>`` of the groups."""
    df, keys = keyed(m, q)
    if not todo:
        return df, []
    order = m.order()
    need = sorted({s.field for s in todo if s.function in registry.COUNTERS})
    if need:
        df = with_previous(df, keys, need, order)
    plain = [s for s in todo if s.function != "mode"]
    aggs: list[Column] = []
    for i, s in enumerate(todo):
        if s.function == "mode":
            continue
        v = F.col(f"`{s.field}`")
        if s.function in registry.COUNTERS:
            before = F.col(f"_p_{s.field}")
            value = aggregates.counter(s.function, v, F.col("ts"), order, before["v"], before["t"])
        else:
            value = aggregates.plain(s.function, v, F.col("ts"), order)
        if q.strict and s.function in registry.PAIRWISE:
            value = F.when((F.count(v) > 0) & value.isNull(), F.raise_error(F.lit(f"insufficient-samples: {s.output}"))).otherwise(value)
        aggs.append(value.cast(s.kind).alias(f"_v{i}"))
        if not q.window:
            at = aggregates.present(v, F.col("ts"))
            aggs.append((F.max(at) if s.function == "last" else F.min(at)).alias(f"_t{i}"))
    out = df.groupBy(*keys).agg(*aggs) if plain else None
    for i, s in enumerate(todo):
        if s.function == "mode":
            got = _mode(df, keys, m, s, i)
            if out is None:
                out = got
            else:
                got = got.select(*(F.col(k).alias(f"_m{k}") for k in keys), f"_v{i}", f"_t{i}")
                same = [F.col(k).eqNullSafe(F.col(f"_m{k}")) for k in keys] or [F.lit(True)]
                on = same[0]
                for c in same[1:]:
                    on = on & c
                out = out.join(got, on, "left").drop(*(f"_m{k}" for k in keys))
    if q.window:
        out = out.withColumns({f"_t{i}": F.col("_w") for i in range(len(todo))})
    return out, todo


def _mode(df: DataFrame, keys: list[str], m: Measurement, s: Spec, i: int) -> DataFrame:
    """The value that first reaches the highest count, samples taken series by series.

    All values of the highest count reach it at their last sample, so the one whose last
    sample comes first wins: two plain aggregations, the first of which thins out hot groups.
    """
    v = F.col(f"`{s.field}`")
    series = F.struct(*(F.col(f"`{c}`") for c in m.order_tags), F.col("ts"), *(F.col(c) for c in m.tie))
    counts = df.where(v.isNotNull()).groupBy(*keys, v.alias("_x")).agg(F.count("*").alias("_n"), F.max(series).alias("_last"), F.min("ts").alias("_first"))
    return counts.groupBy(*keys).agg(F.min_by("_x", F.struct((-F.col("_n")).alias("n"), "_last")).cast(s.kind).alias(f"_v{i}"), F.min("_first").alias(f"_t{i}"))


def _transformed(m: Measurement, moves: list[Spec], todo: list[Spec]) -> DataFrame:
    """``difference`` and ``derivative``: a sample for each but a series' first."""
    keys = list(m.tags)
    fields = sorted({s.field for s in moves})
    df = with_previous(m.df, keys, fields, m.order())
    samples = []
    for s in moves:
        v, before = F.col(f"`{s.field}`"), F.col(f"_p_{s.field}")
        value = v - before["v"]
        if s.function == "derivative":
            span = aggregates.seconds(F.col("ts") - before["t"])
            value = F.when(span > 0, value / span)
        samples.append(F.struct(F.lit(todo.index(s)).alias("spec"), F.col("ts"), *_typed(s, value, todo)))
    out = df.select(*(F.col(f"`{t}`") for t in keys), F.explode(F.array(*samples)).alias("s")).select(*(f"`{t}`" for t in keys), "s.*")
    return out.where(_some(todo))


def wide_form(m: Measurement, q: Query) -> tuple[DataFrame, list[str], dict[str, str]]:
    """``(tags, ts, one column for each aggregate)``: the pivot of the long form.

    Where all outputs of a group share a timestamp (windows, or one field without ``last``
    beside others), the aggregation gives it directly.
    """
    todo = specs(q.aggregates, m.fields)
    names = list(q.group_tags) if q.group_tags else list(m.tags)
    kinds = {s.output: s.kind for s in todo}
    moves = any(s.function in registry.TRANSFORMS for s in todo)
    stamps = {(s.field, s.function == "last") for s in todo}
    if not moves and (q.window or len(stamps) == 1):
        wide, _ = _grouped(m, q, todo)
        out = wide.select(*(F.col(f"_g{i}").alias(t) for i, t in enumerate(names)), (F.col("_w") if q.window else F.col("_t0")).alias("ts"), *(F.col(f"_v{i}").alias(s.output) for i, s in enumerate(todo)))
        some = F.lit(False)
        for s in todo:
            some = some | F.col(f"`{s.output}`").isNotNull()
        return out.where(some), names, kinds
    long, _, _ = long_form(m, q)
    out = long.groupBy(*(f"`{t}`" for t in names), "ts").agg(*(F.max(F.when(F.col("spec") == i, F.col(f"value_{s.kind}"))).alias(s.output) for i, s in enumerate(todo)))
    return out, names, kinds
