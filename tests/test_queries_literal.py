"""Small literal cases: input points, a query, the expected samples."""

import math

import pytest

from tidemark.engine import Engine
from tidemark.errors import QueryError
from tidemark.operators import execute
from tidemark.plans import cursor
from tidemark.plans.builder import QueryBuilder, as_ns, new_query
from tidemark.plans.model import Budget, Query, and_expr, field_eq, field_gt, field_gte, field_lte, field_ne, not_expr, or_expr, predicate_expr, tag_eq, tag_exists, tag_in, tag_ne, time_range, to_ns
from tidemark.sources.measurement import Measurement, from_dataframe

S = 1_000_000_000


def one(spark, values, kind="double", ts=None):
    """A measurement of one series ``host=a`` with a sample a second."""
    rows = [("a", (ts[i] if ts else i * S), float(v) if kind == "double" else v) for i, v in enumerate(values)]
    return Measurement(spark.createDataFrame(rows, f"host string, ts long, v {kind}"), "m", ("host",), {"v": {"double": "double", "long": "bigint"}.get(kind, kind)})


def q(**more):
    return QueryBuilder().from_measurement("m")


def value(m, fn, **more):
    rows = execute.rows(m, q().aggregate(fn, "v").build()).collect()
    return [(r.ts, r[f"{'avg' if fn == 'mean' else fn}(v)"]) for r in rows]


@pytest.mark.parametrize(
    "kind,values,want",
    [
        ("double", [10.0, 15, 3, 8], {"rate": 13 / 3, "irate": 5, "increase": 13, "delta": -2}),
        ("long", [10, 3, 8], {"increase": 8.0, "delta": -2, "top": 10, "bottom": 3, "sum": 21, "count": 3}),
        ("double", [1.0, 4, 2, 8], {"rate": 11 / 3, "irate": 6, "increase": 11, "delta": 7, "spread": 7}),
        ("double", [1.0, 2, 2, 5], {"spread": 4, "median": 2, "mode": 2, "stdvar": 2.25, "stddev": 1.5, "mean": 2.5}),
        ("double", [1.0, 2, 2, 1], {"mode": 2, "min": 1, "max": 2}),
        ("string", ["x", "y", "y"], {"count": 3, "first": "x", "last": "y", "mode": "y"}),
        ("boolean", [True, False, False], {"count": 3, "first": True, "last": False, "mode": False}),
    ],
)
def test_functions(spark, kind, values, want):
    m = one(spark, values, kind)
    for fn, x in want.items():
        ((ts, got),) = value(m, fn)
        assert ts == ((len(values) - 1) * S if fn == "last" else 0)
        assert math.isclose(got, x) if isinstance(x, float) else got == x, fn


def test_first_last_go_by_time(spark):
    m = one(spark, [3.0, 1, 2], ts=[30, 10, 20])
    assert value(m, "first") == [(10, 1)] and value(m, "last") == [(30, 3)]


def test_transforms(spark):
    m = one(spark, [1.0, 4, 10], ts=[0, S, 3 * S])
    assert sorted(value(m, "difference")) == [(S, 3), (3 * S, 6)]
    assert sorted(value(m, "derivative")) == [(S, 3), (3 * S, 3)]


def test_previous_sample_crosses_pieces(spark):
    day = 86_400 * S
    m = one(spark, [5.0, 7, 2, 3, 9], ts=[0, day, 3 * day, 3 * day + 1, 10 * day])
    assert value(m, "increase") == [(0, 2 + 2 + 1 + 6)]
    assert sorted(value(m, "difference")) == [(day, 2), (3 * day, -5), (3 * day + 1, 1), (10 * day, 6)]
    ((_, got),) = value(m, "irate")
    assert math.isclose(got, 6 / ((7 * day - 1) / S))


def test_window_edges(spark):
    m = one(spark, [1.0, 2, 3], ts=[0, S - 1, S])
    b = q().aggregate("sum", "v").aggregate("avg", "v").aggregate("count", "v").group_by_time(S)
    assert [tuple(r)[1:] for r in execute.rows(m, b.build()).collect()] == [(0, 3, 1.5, 2), (S, 3, 3, 1)]
    assert [tuple(r)[1:] for r in execute.rows(one(spark, [1.0, 2], ts=[-5, -15]), q().aggregate("sum", "v").group_by_time(10).build()).collect()] == [(-10, 2), (0, 1)]


REGION = [("east", "a", 1, 1.0), ("east", "a", 2, 2.0), ("east", "b", 1, 3.0), ("east", "b", 2, 4.0), (None, "c", 3, 5.0)]


def region(spark):
    return Measurement(spark.createDataFrame(REGION, "region string, host string, ts long, usage double"), "m", ("region", "host"), {"usage": "double"})


def test_group_by_tags(spark):
    got = execute.rows(region(spark), q().aggregate("sum", "usage").group_by_tags("region").build()).collect()
    assert [r.asDict() for r in got] == [{"region": "", "ts": 3, "sum(usage)": 5}, {"region": "east", "ts": 1, "sum(usage)": 10}]
    first, last = (execute.rows(region(spark), q().aggregate(f, "usage").group_by_tags("region").build()).collect()[1] for f in ("first", "last"))
    assert (first.ts, first["first(usage)"], last.ts, last["last(usage)"]) == (1, 1, 2, 4)


def test_group_windows(spark):
    rows = [("s1", 0, 1), ("s1", 3 * S // 2, 2), ("s2", S // 2, 3), ("s2", 5 * S // 2, 4)]
    m = Measurement(spark.createDataFrame(rows, "host string, ts long, v long"), "m", ("host",), {"v": "bigint"})
    got = execute.rows(m, q().aggregate("sum", "v").group_by_tags("region").group_by_time(S).build()).collect()
    assert [(r.ts, r["sum(v)"]) for r in got] == [(0, 4), (S, 2), (2 * S, 4)]


BUILDER = [("a", 1, 0.2, 40), ("a", 2, 0.8, 55), ("b", 3, 0.9, 60), (None, 4, None, 70)]


def builder(spark):
    return Measurement(spark.createDataFrame(BUILDER, "host string, ts long, usage double, temp long"), "m", ("host",), {"usage": "double", "temp": "bigint"})


def test_filters(spark):
    m = builder(spark)
    ts = lambda e: [r.ts for r in sorted(execute.rows(m, q().where_expr(e if hasattr(e, "op") else predicate_expr(e)).build()).collect(), key=lambda r: r.ts)]
    for e, want in [
        (tag_ne("host", "a"), [3, 4]), (not_expr(tag_eq("host", "a")), [3, 4]), (tag_exists("host"), [1, 2, 3]), (tag_in("host", "a", "b"), [1, 2, 3]), (tag_in("host"), []), (tag_eq("none", "x"), []), (tag_ne("none", "x"), [1, 2, 3, 4]),
        (field_ne("usage", 0.2), [2, 3]), (not_expr(field_eq("usage", 0.2)), [2, 3, 4]), (field_gt("temp", 54.5), [2, 3, 4]), (field_lte("usage", 1), [1, 2, 3]),
        (and_expr(), [1, 2, 3, 4]), (or_expr(), []), (not_expr(), []), (or_expr(tag_eq("host", "b"), field_eq("temp", 40)), [1, 3]), (time_range(2, 3), [2, 3]), (time_range(2, 0), [2, 3, 4]), (not_expr(time_range(2, 3)), [1, 4]),
    ]:
        assert ts(e) == want, e
    got = execute.rows(m, q().select("usage").where(field_gte("temp", 50)).tags({"host": "a"}).order_by_time_desc().build()).collect()
    assert [r.asDict() for r in got] == [{"host": "a", "ts": 2, "usage": 0.8}]
    assert execute.rows(m, q().tags({"host": ""}).build()).first().ts == 4
    both = q().where(time_range(1, 3)).where(time_range(2, 4)).build()
    assert [r.ts for r in execute.rows(m, both).collect()] == [2, 3]


def test_filter_before_aggregate(spark):
    m = Measurement(spark.createDataFrame([("a", 1, 1.0, 40), ("a", 2, 2.0, 55), ("a", 3, 3.0, 60)], "host string, ts long, usage double, temp long"), "m", ("host",), {"usage": "double", "temp": "bigint"})
    assert execute.rows(m, q().where(field_gte("temp", 50)).aggregate("sum", "usage").build()).first()["sum(usage)"] == 5


def test_cursor(spark):
    rows = [("a", 10), ("b", 10), ("c", 10), ("a", 9)]
    m = Measurement(spark.createDataFrame([(h, t, float(t)) for h, t in rows], "host string, ts long, usage double"), "m", ("host",), {"usage": "double"})
    e = Engine(spark)
    e.register(m)
    first, token = e.page(q().order_by_time_desc().limit(2).build())
    assert [(r.host, r.ts) for r in first.collect()] == [("a", 10), ("b", 10)]
    second, token = e.page(q().order_by_time_desc().limit(2).cursor(token).build())
    assert [(r.host, r.ts) for r in second.collect()] == [("c", 10), ("a", 9)]
    last, token = e.page(q().order_by_time_desc().limit(2).cursor(token).build())
    assert last.count() == 0 and token is None
    up, token = e.page(q().limit(3).cursor(cursor.encode(0, -1, False)).build())
    assert [(r.host, r.ts) for r in up.collect()] == [("a", 9), ("a", 10), ("b", 10)]
    for bad in ("", "x", "AAAA", cursor.encode(1, 1, True)):
        with pytest.raises(QueryError) as x:
            cursor.decode(bad, False)
        assert x.value.code == "invalid-cursor"
    assert cursor.decode(cursor.encode(2**64 - 1, -(2**63), True), True) == (2**64 - 1, -(2**63))


def test_column_shape(spark):
    m = builder(spark)
    got = [tuple(r) for r in execute.columns(m, q().build()).collect()]
    assert got == [(None, "temp", 4, 70, None), ("a", "temp", 1, 40, None), ("a", "temp", 2, 55, None), ("a", "usage", 1, None, 0.2), ("a", "usage", 2, None, 0.8), ("b", "temp", 3, 60, None), ("b", "usage", 3, None, 0.9)]
    assert [tuple(r)[1:3] for r in execute.columns(m, q().order_by_time_desc().offset(1).limit(3).build()).collect()] == [("temp", 2), ("temp", 1), ("usage", 2)]
    arrays = {(r.host, r.field): (r.timestamps, r.values_double) for r in execute.arrays(execute.columns(m, q().build()), ["host"]).collect()}
    assert arrays["a", "usage"] == ([1, 2], [0.2, 0.8])
    mixed = execute.rows(m, q().aggregate("sum", "temp").aggregate("last", "temp").build()).collect()
    assert {(r.host, r.ts): (r["sum(temp)"], r["last(temp)"]) for r in mixed}["a", 2] == (None, 55)


@pytest.mark.parametrize(
    "build,code",
    [
        (lambda b: b.select("nope"), "field-not-found"),
        (lambda b: b.where(field_eq("nope", 1)), "field-not-found"),
        (lambda b: b.where(field_gt("usage", "x")), "function-type-mismatch"),
        (lambda b: b.aggregate("difference", "usage").group_by_time(1), "unsupported-function"),
        (lambda b: b.aggregate("derivative", "usage").group_by_tags("host"), "unsupported-function"),
        *((lambda b, f=f: b.aggregate(f, "usage"), "unsupported-function") for f in ("fill", "interpolation", "align", "histogram", "approx_quantile", "moving_average", "moving_sum", "moving_stddev", "")),
        (lambda b: b.group_by_time(5), "invalid-group"),
        (lambda b: b.time_range(5, 2), "invalid-time-range"),
        (lambda b: b.precision("s").time_range(0, 2**62), "invalid-precision"),
        (lambda b: b.precision("h"), "invalid-precision"),
    ],
)
def test_refusals(spark, build, code):
    with pytest.raises(QueryError) as e:
        execute.rows(builder(spark), build(q()).build())
    assert e.value.code == code


def test_more_refusals(spark):
    for bad, code in ((lambda: q().limit(-1).build(), "invalid-pagination"), (lambda: q().offset(-1).build(), "invalid-pagination"), (lambda: new_query().build(), "invalid-measurement"), (lambda: q().group_by_time(-1).build(), "invalid-window")):
        with pytest.raises(QueryError) as e:
            bad()
        assert e.value.code == code
    strings = one(spark, ["x"], "string")
    with pytest.raises(QueryError) as e:
        execute.rows(strings, q().aggregate("sum", "v").build())
    assert e.value.code == "function-type-mismatch"
    with pytest.raises(QueryError) as e:
        execute.rows(Measurement(strings.df, "m", ("host",), {}), q().build())
    assert e.value.code == "measurement-not-found"


def test_small_groups(spark):
    m = one(spark, [1.0])
    for fn in ("rate", "irate", "increase", "delta"):
        assert value(m, fn) == []
        with pytest.raises(Exception, match="insufficient-samples"):
            execute.rows(m, q().aggregate(fn, "v").strict().build()).collect()


def test_precision(spark):
    m = one(spark, [1.0, 2, 3], ts=[1_500_000_000, 2_000_000_001, -1_500_000_000])
    got = execute.rows(m, q().precision("s").build()).collect()
    assert sorted(r.ts for r in got) == [-1, 1, 2]
    assert [r.v for r in execute.rows(m, q().precision("ms").time_range(1500, 2000).build()).collect()] == [1]
    assert to_ns(5, "us") == 5000
    from datetime import datetime

    assert as_ns(datetime(1970, 1, 2, microsecond=3)) == 86_400 * S + 3000


def test_guards(spark):
    e = Engine(spark, default_limit=2, max_limit=3, default_budget=Budget(max_samples=2))
    e.register(builder(spark))
    assert e.query_rows(Query("m")).count() == 2
    with pytest.raises(QueryError) as x:
        e.query_rows(Query("m", limit=9))
    assert x.value.code == "invalid-pagination"
    with pytest.raises(QueryError) as x:
        e.query_rows(Query("m", limit=3))
    assert x.value.code == "read-budget-exceeded"
    with pytest.raises(QueryError) as x:
        e.query_rows(Query("other"))
    assert x.value.code == "measurement-not-found"
    assert len(list(e.stream_json(Query("m", limit=1)))) == 1 and len(list(e.iterate_columns(Query("m", limit=2)))) == 2


def test_plans(spark):
    m = from_dataframe(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "m", tags=["event_type"], fields=["value"], ts="ts")
    query = q().where(time_range(1_704_499_200 * S, 1_704_931_200 * S), tag_eq("event_type", "click"), field_gt("value", 5.0)).aggregate("avg", "value").build()
    x = execute.explain(m, query)
    assert "PushedFilters: [IsNotNull(ts), " in x.plan and "GreaterThanOrEqual(ts," in x.plan and "EqualTo(event_type,click)" in x.plan and "GreaterThan(value,5.0)" in x.plan
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in x.plan and "Python" not in x.plan
    assert x.pushed == ("time", "tags", "field-stats", "columns") and x.plan_class == "aggregate"
    top = execute.explain(m, q().order_by_time_desc().limit(5).build())
    assert "TakeOrderedAndProject" in top.plan and top.plan_class == "top-k"


def test_stats_and_cancellation(spark):
    import threading

    from pyspark.sql import functions as F

    from tidemark.operators.guards import cancellable, with_stats

    got, stats = with_stats(execute.rows(builder(spark), q().build()), lambda df: df.collect())
    assert (stats.rows, stats.first_ts, stats.last_ts) == (len(got), 1, 4)
    with cancellable(spark) as cancel:
        timer = threading.Timer(1.5, cancel)
        timer.start()
        with pytest.raises(Exception, match="(?i)cancel"):
            spark.range(0, 10**13, 1, 4).select(F.sum(F.sqrt("id"))).collect()
