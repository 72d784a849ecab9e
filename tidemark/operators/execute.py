"""Queries as DataFrames: scan, filter, aggregate or project, order, resume, page."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..plans import cursor as cursors
from ..plans import model as model_
from ..plans.analyze import analyze
from ..plans.model import Query
from ..sources.measurement import Measurement
from ..sources.series import with_series_ids
from . import predicates
from .aggregate import long_form, specs, wide_form


def filtered(m: Measurement, q: Query) -> Measurement:
    """The scan and all conditions, time bounds and tags first; no field is read that the query does not name."""
    tags = frozenset(m.tags)
    m = m.scan(*predicates.scan_bounds(q))
    df = m.df
    if q.tags:
        df = df.where(predicates.exact_tags(q.tags, tags))
    for part in conjuncts(q.where):
        df = df.where(predicates.tree(part, q, tags, m.fields))
    return replace(m, df=df)


def conjuncts(e: model_.Expr | None) -> list[model_.Expr]:
    if e is None:
        return []
    return [x for c in e.children for x in conjuncts(c)] if e.op == "and" and e.children else [e]


def _out_time(df: DataFrame, q: Query) -> DataFrame:
    factor = model_.NS[q.precision]
    return df if factor == 1 else df.withColumn("ts", F.expr(f"ts div {factor}"))


def _paged(df: DataFrame, q: Query) -> DataFrame:
    if q.offset:
        df = df.offset(q.offset)
    return df.limit(q.limit) if q.limit else df


def _within(df: DataFrame, q: Query) -> DataFrame:
    """Refuse a result of more samples than the budget; looks at one row more at most."""
    most = q.budget.max_samples
    if most and df.limit(most + 1).count() > most:
        raise QueryError("read-budget-exceeded", f"more than {most} samples")
    return df


def _ordered(df: DataFrame, q: Query, series: list[str], *inner: str, by_time: bool) -> DataFrame:
    """ASC is series-major; DESC is by time, then series. Pages are by time both ways."""
    by_series = [F.col(f"`{c}`") for c in series]
    if q.descending:
        return df.orderBy(F.desc("ts"), *by_series, *inner)
    if by_time:
        return df.orderBy("ts", *by_series, *inner)
    return df.orderBy(*by_series, *inner, "ts")


#: A row's place in the order of pages: (series id, timestamp).
Place = tuple[int, int]


def _cut(m: Measurement, q: Query, after: Place | None = None, first: Place | None = None, last: Place | None = None) -> Measurement:
    """What comes after ``after`` and from ``first`` to ``last`` in the order of pages; the times reach the scan."""
    for place, begins in ((after, True), (first, True), (last, False)):
        if place is None:
            continue
        s, t = place
        m = m.scan(*((t, None) if begins != q.descending else (None, t)))
        ts, series = F.col("ts"), F.col(m.series)
        further = ts < t if begins == q.descending else ts > t
        same = series > s if place is after else series >= s if begins else series <= s
        m = replace(m, df=m.df.where(further | ((ts == t) & same)))
    return m


def rows(m: Measurement, q: Query, *, keep_series: bool = False, first: Place | None = None, last: Place | None = None) -> DataFrame:
    """Row shape: ``(tags, ts, fields)``, a null where a row has no sample of a field.

    ``keep_series`` adds ``series_id`` and ``exact_ts``, which a cursor is made of; ``first`` and
    ``last`` are places between which the rows lie.
    """
    analyze(q, m.fields)
    if q.cursor or keep_series:
        m = with_series_ids(m)
    if q.cursor and q.aggregates:
        raise QueryError("invalid-cursor", "aggregates cannot be resumed")
    m = filtered(_cut(m, q, _cursor(q), first, last), q)
    if q.aggregates:
        df, names, _ = wide_form(m, q)
        series = sorted(names) if not q.group_tags else names
    else:
        fields = list(dict.fromkeys(q.fields or m.fields))
        keep = ([m.series] if m.series else []) + [t for t in m.tags]
        df = m.df.select(*(F.col(f"`{c}`") for c in keep), "ts", *(F.col(f"`{f}`") for f in fields), *m.tie)
        series, names = m.order_tags, keep
    df = _paged(_ordered(df, q, series, *(m.tie if not q.aggregates else ()), by_time=bool(q.cursor) or keep_series), q)
    df = _within(df, q).drop(*m.tie)
    if keep_series:
        df = df.withColumn("exact_ts", F.col("ts"))
    elif m.series and not q.aggregates:
        df = df.drop(m.series)
    return _out_time(df, q)


def _cursor(q: Query) -> Place | None:
    return cursors.decode(q.cursor, q.descending) if q.cursor else None


#: Pages of up to so many rows are looked for in the first series alone, before all series are read.
PAGE = 10_000
#: Into so many stretches rows are told apart at once to find the end of a longer page.
STRETCHES = 1_000


def first_series(m: Measurement, q: Query) -> DataFrame | None:
    """A page in series order from the first few series alone, if they fill it; None if they do not.

    Files are sorted by tags, so a condition on the tags of few series skips the rest of them. Rows are
    fetched at once: they are no more than the page.
    """
    if m.ids is None or not m.tags or not 0 < q.limit <= PAGE or q.offset > PAGE or q.descending or q.cursor or q.aggregates:
        return None
    analyze(q, m.fields)
    tags = sorted(m.tags)
    first = m.ids.orderBy(*(F.col(f"`{t}`") for t in tags)).limit(9).collect()
    for some in (first[:1], first[1:9]):
        if len(first) <= 1 or not some:
            return None
        known = first[: 1 if some[0] is first[0] else 9]
        these = reduce(or_, (reduce(and_, (F.col(f"`{t}`").eqNullSafe(F.lit(r[t])) for t in tags)) for r in known))
        page = rows(replace(m, df=m.df.where(these)), q)
        got = page.toArrow()
        if len(got) == q.limit:
            return m.df.sparkSession.createDataFrame(got, page.schema)
    return None


def next_cursor(page: pa.Table, q: Query) -> str | None:
    """The token that resumes after a page of ``rows(..., keep_series=True)``; None after the last page."""
    if not q.limit or len(page) < q.limit:
        return None
    return cursors.encode(page["series_id"][-1].as_py(), page["exact_ts"][-1].as_py(), q.descending)


def long_page(m: Measurement, q: Query) -> tuple[DataFrame, str | None]:
    """A page of any length and the token that resumes after it.

    The page is a plan over what lies between two places; its rows do not go through the driver
    and are sorted by many tasks. Rows of one series and instant, which only tables that are not
    stored have, are never parted.
    """
    analyze(q, m.fields)
    ids = with_series_ids(m)
    first = place_at(m, ids, q, q.offset + 1) if q.offset else None
    last = None if q.offset and first is None else place_at(m, ids, q, q.offset + q.limit)
    page = rows(ids, replace(q, limit=0, offset=0), keep_series=True, first=first, last=last).drop("series_id", "exact_ts")
    if q.offset and first is None:
        page = page.where(F.lit(False))
    return page, None if last is None else cursors.encode(*last, q.descending)


def place_at(m: Measurement, ids: Measurement, q: Query, n: int) -> Place | None:
    """The place of the ``n``-th row after the query's cursor, None if there are fewer rows; ``ids`` is ``m`` with series ids.

    Rows are counted by stretches of time, then those of the stretch in question by shorter ones,
    and those of one instant by stretches of series. Counts are fetched, and in the end the places
    of at most ``PAGE`` rows.
    """
    start = _cursor(q)
    if start:
        # Times are counted without series ids, so with the rows of the cursor's instant up to it.
        t = start[1]
        n += filtered(_cut(ids.scan(t, t), q, last=start), q).df.count()
        m, ids = (x.scan(*((None, t) if q.descending else (t, None))) for x in (m, ids))
    at = []
    for key, down in (("ts", q.descending), (ids.series, False)):
        df = filtered(m if key == "ts" else ids, q).df
        low, high = (0, 0) if key == "ts" and m.shard else df.agg(F.coalesce(F.min(key), F.lit(0)), F.coalesce(F.max(key), F.lit(0))).first()
        step = m.shard if key == "ts" and m.shard else max(1, (high - low) // STRETCHES)
        while True:
            part = F.expr(f"`{key}` div {step}") - (F.col(key) % step < 0).cast("bigint")
            for k, held in sorted(df.groupBy(part.alias("k")).count().collect(), reverse=down):
                if n <= held:
                    break
                n -= held
            else:
                return None
            low, high = max(k * step, model_.MIN_TS), min((k + 1) * step - 1, model_.MAX_TS)
            if key == "ts":
                m, ids = m.scan(low, high), ids.scan(low, high)
                df = filtered(m, q).df
            else:
                df = df.where(F.col(key).between(low, high))
            if held <= PAGE:
                places = (filtered(ids, q).df if key == "ts" else df).select("ts", ids.series).collect()
                ts, series = sorted((-t if q.descending else t, s) for t, s in places)[n - 1]
                return series, -ts if q.descending else ts
            if step == 1:
                break
            step = max(1, step // STRETCHES)
        at.append(low)
    return at[1], at[0]


def columns(m: Measurement, q: Query) -> DataFrame:
    """Column shape: ``(tags, field, ts, value_<type>...)``, a row for each sample, series by series and field by field.

    DESC turns the samples within each series and field. Limit and offset count samples.
    """
    analyze(q, m.fields)
    m = filtered(m, q)
    if q.aggregates:
        df, names, todo = long_form(m, q)
        labels = F.create_map(*(x for i, s in enumerate(todo) for x in (F.lit(i), F.lit(s.output))))
        df = df.withColumn("field", labels[F.col("spec")]).drop("spec")
    else:
        names = ([m.series] if m.series else []) + list(m.tags)
        fields = sorted(dict.fromkeys(q.fields or m.fields))
        kinds = sorted({m.fields[f] for f in fields})
        value = lambda f: [(F.col(f"`{f}`") if m.fields[f] == k else F.lit(None)).cast(k).alias(f"value_{k}") for k in kinds]
        sample = lambda f: F.when(F.col(f"`{f}`").isNotNull(), F.struct(F.lit(f).alias("field"), *value(f)))
        df = m.df.select(*(F.col(f"`{t}`") for t in names), "ts", F.explode(F.array_compact(F.array(*map(sample, fields)))).alias("s")).select(*(f"`{t}`" for t in names), "ts", "s.*")
    values = sorted(c for c in df.columns if c.startswith("value_"))
    series = m.order_tags if not q.group_tags else names
    at = F.desc("ts") if q.descending else F.col("ts")
    df = df.orderBy(*(F.col(f"`{c}`") for c in series if c in df.columns), "field", at)
    return _out_time(_within(_paged(df, q), q), q).select(*(f"`{t}`" for t in names), "field", "ts", *values)


def arrays(long: DataFrame, names: list[str]) -> DataFrame:
    """Column series as arrays: one row for each series and field with parallel ``timestamps`` and ``values`` by time."""
    values = [c for c in long.columns if c.startswith("value_")]
    got = long.groupBy(*(f"`{t}`" for t in names), "field").agg(F.array_sort(F.collect_list(F.struct("ts", *values))).alias("s"))
    return got.select(*(f"`{t}`" for t in names), "field", F.col("s.ts").alias("timestamps"), *(F.col(f"s.{v}").alias(v.replace("value_", "values_")) for v in values))


@dataclass(frozen=True)
class Cost:
    """What a stored query is expected to touch, from the catalog alone."""

    series: int
    fields: int
    candidate_shards: int
    matched_shards: int
    candidate_parts: int
    matched_parts: int
    part_rows: int
    samples: int
    plan_class: str


def plan_class(q: Query, empty: bool) -> str:
    """The coarse kind of a query by which its cost is judged."""
    if empty:
        return "empty"
    if q.group_tags or q.window:
        return "group_aggregate"
    return "aggregate" if q.aggregates else "bounded_scan" if q.limit or q.cursor else "scan"


@dataclass(frozen=True)
class Explained:
    """What a query will do, from its text and schema alone, and Spark's plan."""

    fields_read: tuple[str, ...]
    time_bounds: tuple[int | None, int | None]
    pushed: tuple[str, ...]
    post_filter: bool
    plan_class: str
    estimated_shards: int | None
    plan: str
    cost: Cost | None = None


def explain(m: Measurement, q: Query, shards: int | None = None) -> Explained:
    analyze(q, m.fields)
    found = model_.leaves(q.where)
    read = set(q.fields or (() if q.aggregates else m.fields)) | {s.field for s in specs(q.aggregates, m.fields)} | {p.name for p in found if p.kind.startswith("field")}
    start, end = predicates.scan_bounds(q)
    ops = {"and"} | ({e.op for e in _all(q.where)} if q.where else set())
    pure = not ops & {"or", "not"}
    pushed = [*(["time"] if (start, end) != (None, None) else []), *(["tags"] if q.tags or any(p.kind.startswith("tag") for p in found) and pure else []), *(["field-stats"] if pure and any(p.kind.startswith("field") for p in found) else []), "columns"]
    kind = "aggregate" if q.aggregates else "top-k" if q.descending and q.limit else "limit" if q.limit else "scan"
    df = rows(m, q)
    return Explained(tuple(sorted(read)), (start, end), tuple(pushed), bool(found), kind, shards, df._jdf.queryExecution().toString())


def _all(e: model_.Expr) -> list[model_.Expr]:
    return [e, *(x for c in e.children for x in _all(c))]


def as_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON text in ``line``, nulls written out."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("line"))


def json_lines(df: DataFrame):
    """Rows as JSON lines, made by the tasks and fetched partition by partition."""
    for r in as_json(df).toLocalIterator():
        yield r["line"]
