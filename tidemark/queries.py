"""The registered queries: each operator applied to the test tables, with SQL that says the same."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .errors import QueryError
from .functions import registry
from .operators import execute, predicates
from .plans import cursor as cursors
from .plans.builder import QueryBuilder
from .plans.model import Budget, and_expr, field_eq, field_gt, field_gte, field_lt, field_lte, field_ne, not_expr, or_expr, tag_eq, tag_exists, tag_in, tag_ne, time_range
from .sources.measurement import Measurement, from_dataframe
from .sources.series import number, series_table
from .sources.store import Store, anti_deleted, resolve_versions
from .streaming.downsample import Downsampler, Function, Policy, estimate, floor_to, normalized, rollup

Run = Callable[[SparkSession, str], DataFrame]
DAY, HOUR = 86_400_000_000_000, 3_600_000_000_000
#: 2024-01-01 and later bounds, in nanoseconds.
T0 = 1_704_067_200_000_000_000
T5, T10, T20 = T0 + 5 * DAY, T0 + 10 * DAY, T0 + 20 * DAY
RUNS: dict[str, Run] = {}
SQL: dict[str, str] = {}

EV = "ev AS (SELECT event_type, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) * 1000 AS ts, value, CAST(floor(value / 5) AS BIGINT) AS bin, event_id FROM events)"
LI = "li AS (SELECT l_returnflag, l_linestatus, epoch_us(l_shipdate) * 1000 AS ts, l_quantity, l_extendedprice, l_discount, l_orderkey, l_linenumber, l_partkey FROM lineitem)"
OD = "od AS (SELECT o_orderstatus, o_orderpriority, epoch_us(o_orderdate) * 1000 AS ts, o_totalprice, o_orderkey FROM orders)"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str, tags: tuple[str, ...] = ("event_type", "user_id")) -> Measurement:
    df = read(spark, sf_dir, "events").withColumn("bin", F.floor(F.col("value") / 5).cast("bigint"))
    return from_dataframe(df, "events", tags=tags, fields=("value", "bin", "event_id"), ts="ts", tie=("event_id",))


def lineitem(spark: SparkSession, sf_dir: str) -> Measurement:
    return from_dataframe(read(spark, sf_dir, "lineitem"), "lineitem", tags=("l_returnflag", "l_linestatus"), fields=("l_quantity", "l_extendedprice", "l_discount"), ts="l_shipdate", tie=("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))


def orders(spark: SparkSession, sf_dir: str) -> Measurement:
    return from_dataframe(read(spark, sf_dir, "orders"), "orders", tags=("o_orderstatus", "o_orderpriority"), fields=("o_totalprice", "o_orderkey"), ts="o_orderdate", tie=("o_orderkey",))


def named(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """``fn(field)`` columns as ``fn_field``, doubles rounded."""
    plain = {c: c.replace("(", "_").replace(")", "") for c in df.columns}
    kinds = dict(df.dtypes)
    return df.select(*((F.round(F.col(f"`{c}`"), digits) if kinds[c] == "double" and digits is not None else F.col(f"`{c}`")).alias(n) for c, n in plain.items()))


def long_values(m: Measurement, q) -> DataFrame:
    """The column shape with one double ``value``, so that no integer column has nulls."""
    df = execute.columns(m, q)
    values = [c for c in df.columns if c.startswith("value_")]
    return df.withColumn("value", F.coalesce(*(F.col(v).cast("double") for v in values))).drop(*values)


def counted_rows(m: Measurement, q) -> DataFrame:
    """Rows with -1 for an integer that is not there."""
    df = execute.rows(m, q)
    return df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit(-1)).cast(k).alias(c) if k == "bigint" else F.col(f"`{c}`") for c, k in df.dtypes))


def add(name: str, run: Run, sql: str | None) -> None:
    RUNS[name] = run
    if sql:
        SQL[name] = sql


def on_events(name: str, build: Callable[[QueryBuilder], QueryBuilder], sql: str | None, *, tags: tuple[str, ...] = ("event_type", "user_id"), shape=execute.rows, digits: int | None = None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return named(shape(events(spark, sf_dir, tags), build(QueryBuilder().from_measurement("events")).build()), digits)

    add(name, run, sql and f"WITH {EV}{sql if sql.startswith(',') else f' {sql}'}")


# --- scans, projections, filters

on_events("scan_select", lambda b: b.select("value"), "SELECT event_type, user_id, ts, value FROM ev")
on_events("scan_time_range", lambda b: b.select("value").time_range(T5, T10), f"SELECT event_type, user_id, ts, value FROM ev WHERE ts BETWEEN {T5} AND {T10}")
on_events("scan_tags_exact", lambda b: b.select("bin").tags({"event_type": "click", "absent": ""}), "SELECT event_type, user_id, ts, bin FROM ev WHERE event_type = 'click'")
for _name, _p, _sql in [
    ("tag_eq", tag_eq("event_type", "click"), "event_type = 'click'"),
    ("tag_ne", tag_ne("event_type", "click"), "event_type <> 'click'"),
    ("tag_ne_absent", tag_ne("nothing", "click"), "true"),
    ("tag_exists", tag_exists("user_id"), "user_id IS NOT NULL"),
    ("tag_in", tag_in("event_type", "click", "purchase"), "event_type IN ('click', 'purchase')"),
    ("tag_in_empty", tag_in("event_type"), "false"),
    ("field_eq", field_eq("bin", 3), "bin = 3"),
    ("field_ne", field_ne("bin", 3), "bin <> 3"),
    ("field_gt", field_gt("value", 50.0), "value > 50"),
    ("field_gte", field_gte("bin", 10), "bin >= 10"),
    ("field_lt", field_lt("value", 5), "value < 5"),
    ("field_lte", field_lte("value", 1.5), "value <= 1.5"),
    ("and", and_expr(tag_eq("event_type", "click"), field_gt("value", 20.0), time_range(T5, T20)), f"event_type = 'click' AND value > 20 AND ts BETWEEN {T5} AND {T20}"),
    ("or", or_expr(tag_eq("event_type", "click"), field_gt("value", 90.0)), "event_type = 'click' OR value > 90"),
    ("not", not_expr(or_expr(tag_in("event_type", "click", "view"), field_lt("value", 30.0))), "NOT (event_type IN ('click', 'view') OR value < 30)"),
    ("not_time", not_expr(time_range(T5, T20)), f"NOT ts BETWEEN {T5} AND {T20}"),
    ("empty_and", and_expr(), "true"),
    ("empty_or", or_expr(), "false"),
]:
    on_events(f"filter_{_name}", lambda b, p=_p: b.select("value").where(p) if not hasattr(p, "op") else b.select("value").where_expr(p), f"SELECT event_type, user_id, ts, value FROM ev WHERE {_sql}")
on_events("filter_implicit_and", lambda b: b.select("value").where(tag_in("event_type", "click", "view"), field_gt("value", 20.0)).where(field_lt("value", 80.0)), "SELECT event_type, user_id, ts, value FROM ev WHERE event_type IN ('click', 'view') AND value > 20 AND value < 80")
on_events("filter_other_field", lambda b: b.select("value").where(field_gt("bin", 5)), "SELECT event_type, user_id, ts, value FROM ev WHERE bin > 5")
on_events("filter_other_field_sum", lambda b: b.where(field_gte("bin", 5)).aggregate("sum", "value").group_by_tags("event_type"), "SELECT event_type, min(ts) AS ts, round(sum(value), 6) AS sum_value FROM ev WHERE bin >= 5 GROUP BY 1", digits=6)
on_events("columns_long", lambda b: b.select("value", "bin").time_range(T5, T10), f"SELECT event_type, user_id, 'value' AS field, ts, value FROM ev WHERE ts BETWEEN {T5} AND {T10} UNION ALL SELECT event_type, user_id, 'bin', ts, CAST(bin AS DOUBLE) FROM ev WHERE ts BETWEEN {T5} AND {T10}", shape=long_values)

# --- aggregates

_PLAIN = {
    "count": "count(v)", "sum": "sum(v)", "avg": "avg(v)", "min": "min(v)", "max": "max(v)", "top": "max(v)", "bottom": "min(v)", "spread": "max(v) - min(v)", "median": "median(v)", "stddev": "stddev_pop(v)", "stdvar": "var_pop(v)",
    "first": "first(v ORDER BY {o})", "last": "last(v ORDER BY {o})", "delta": "CASE WHEN count(v) > 1 THEN last(v ORDER BY {o}) - first(v ORDER BY {o}) END",
    "increase": "CASE WHEN count(v) > 1 THEN sum(inc) END", "rate": "CASE WHEN max(ts) > min(ts) THEN sum(inc) / ((max(ts) - min(ts)) / 1e9) END",
    "irate": "CASE WHEN last(ts - pts ORDER BY {o}) > 0 THEN last(inc ORDER BY {o}) / (last(ts - pts ORDER BY {o}) / 1e9) END", "mode": "first(v ORDER BY occ DESC, {s})",
}
_LONG = ("count", "mode")


def grouped_sql(source: str, cte: str, v: str, keys: list[str], fn: str, o: str, s: str, digits: int, *, window: int = 0, alias: str | None = None, where: str = "true") -> str:
    """SQL of one function over groups; ``o`` orders samples, ``s`` series and then samples."""
    if window:
        cte += f", w AS (SELECT *, (ts // {window}) * {window} AS wts FROM {source})"
        source, keys = "w", [*keys, "wts"]
    by = ", ".join(keys)
    lagged = f"b AS (SELECT *, {v} AS v, lag({v}) OVER k AS pv, lag(ts) OVER k AS pts, row_number() OVER (PARTITION BY {by}, {v} ORDER BY {s}) AS occ FROM {source} WHERE {where} WINDOW k AS (PARTITION BY {by} ORDER BY {o}))"
    inc = "i AS (SELECT *, CASE WHEN pv IS NULL THEN 0 WHEN v >= pv THEN v - pv ELSE v END AS inc FROM b)"
    value = _PLAIN[fn].format(o=o, s=s)
    value = f"CAST({value} AS BIGINT)" if fn in _LONG else f"round({value}, {digits})"
    stamp = "wts AS ts" if window else "max(ts) AS ts" if fn == "last" else "min(ts) AS ts"
    names = ", ".join(k for k in keys if k != "wts")
    return f"WITH {cte}, {lagged}, {inc}, a AS (SELECT {names}, {stamp}, {value} AS {alias or f'{fn}_{v}'} FROM i GROUP BY {by}) SELECT * FROM a WHERE {alias or f'{fn}_{v}'} IS NOT NULL"


for _fn in _PLAIN:
    _v = "bin" if _fn == "mode" else "value"
    for _name, _tags, _group, _window in (("agg_{}_series", ("event_type",), (), 0), ("agg_{}_window_1d", ("event_type",), (), DAY), ("group_tags_{}", ("event_type", "user_id"), ("event_type",), 0), ("group_tags_window_{}", ("event_type", "user_id"), ("user_id",), 7 * DAY)):
        _series_of = ", ".join(sorted(_tags))
        on_events(_name.format(_fn), lambda b, fn=_fn, v=_v, group=_group, window=_window: b.aggregate(fn, v).group_by_tags(*group).group_by_time(window), None, tags=_tags, digits=6)
        SQL[_name.format(_fn)] = grouped_sql("ev", EV, _v, list(_group or _tags), _fn, f"ts, {_series_of}, event_id", f"{_series_of}, ts, event_id", 6, window=_window)

on_events("agg_many_series", lambda b: b.aggregate("count", "value").aggregate("mean", "value").aggregate("last", "value"), """, a AS (SELECT event_type, min(ts) AS t0, max(ts) AS t1, count(*) AS c, avg(value) AS a, last(value ORDER BY ts, event_id) AS l FROM ev GROUP BY 1)
SELECT event_type, t0 AS ts, c AS count_value, round(a, 6) AS avg_value, CAST(NULL AS DOUBLE) AS last_value FROM a UNION ALL SELECT event_type, t1, -1, NULL, round(l, 6) FROM a""", tags=("event_type",), shape=counted_rows, digits=6)
on_events("agg_all_fields", lambda b: b.aggregate("max", "").group_by_time(DAY).group_by_tags("event_type"), f"SELECT event_type, (ts // {DAY}) * {DAY} AS ts, max(value) AS max_value, max(bin) AS max_bin, max(event_id) AS max_event_id FROM ev GROUP BY 1, 2", digits=None)
on_events("agg_columns_long", lambda b: b.aggregate("sum", "bin").aggregate("avg", "value").group_by_tags("event_type").group_by_time(DAY), f""", a AS (SELECT event_type, (ts // {DAY}) * {DAY} AS ts, CAST(sum(bin) AS BIGINT) AS s, round(avg(value), 6) AS a FROM ev GROUP BY 1, 2)
SELECT event_type, 'sum(bin)' AS field, ts, CAST(s AS DOUBLE) AS value FROM a UNION ALL SELECT event_type, 'avg(value)', ts, a FROM a""", shape=long_values, digits=6)
on_events("group_absent_tag", lambda b: b.aggregate("count", "value").group_by_tags("region"), "SELECT '' AS region, min(ts) AS ts, count(*) AS count_value FROM ev")
on_events("flagship", lambda b: b.where(tag_in("event_type", "click", "purchase"), field_gt("value", 1.0), time_range(T0, T20)).aggregate("mean", "value").group_by_tags("event_type").group_by_time(DAY), f"SELECT event_type, (ts // {DAY}) * {DAY} AS ts, round(avg(value), 6) AS avg_value FROM ev WHERE event_type IN ('click', 'purchase') AND value > 1 AND ts BETWEEN {T0} AND {T20} GROUP BY 1, 2", digits=6)
_b = "l AS (SELECT event_type, ts, value - lag(value) OVER k AS d, ts - lag(ts) OVER k AS dt FROM ev WINDOW k AS (PARTITION BY event_type ORDER BY ts, event_id))"
on_events("transform_difference", lambda b: b.aggregate("difference", "value"), f", {_b} SELECT event_type, ts, max(round(d, 6)) AS difference_value FROM l WHERE d IS NOT NULL GROUP BY event_type, ts", tags=("event_type",), digits=6)
on_events("transform_derivative", lambda b: b.aggregate("derivative", "value"), f", {_b} SELECT event_type, ts, max(round(d / (dt / 1e9), 6)) AS derivative_value FROM l WHERE dt > 0 GROUP BY event_type, ts", tags=("event_type",), digits=6)


def _fact(make: Callable[[SparkSession, str], Measurement], build: Callable[[QueryBuilder], QueryBuilder], digits: int) -> Run:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = make(spark, sf_dir)
        return named(execute.rows(m, build(QueryBuilder().from_measurement(m.name)).build()), digits)

    return run


add("lineitem_group_sum", _fact(lineitem, lambda b: b.aggregate("sum", "l_extendedprice").aggregate("avg", "l_quantity").aggregate("count", "l_discount").group_by_tags("l_returnflag", "l_linestatus").group_by_time(30 * DAY), 2),
    f"WITH {LI} SELECT l_returnflag, l_linestatus, (ts // {30 * DAY}) * {30 * DAY} AS ts, round(sum(l_extendedprice), 2) AS sum_l_extendedprice, round(avg(l_quantity), 2) AS avg_l_quantity, count(l_discount) AS count_l_discount FROM li GROUP BY 1, 2, 3")
for _fn, _v in (("increase", "l_quantity"), ("last", "l_extendedprice"), ("median", "l_quantity"), ("stddev", "l_discount")):
    add(f"lineitem_window_{_fn}", _fact(lineitem, lambda b, fn=_fn, v=_v: b.aggregate(fn, v).group_by_tags("l_returnflag").group_by_time(DAY), 4),
        grouped_sql("li", LI, _v, ["l_returnflag"], _fn, "ts, l_linestatus, l_returnflag, l_orderkey, l_linenumber, l_partkey, l_quantity", "l_linestatus, l_returnflag, ts, l_orderkey, l_linenumber", 4, window=DAY))
for _fn in ("first", "rate", "delta"):
    add(f"orders_series_{_fn}", _fact(orders, lambda b, fn=_fn: b.aggregate(fn, "o_totalprice"), 4),
        grouped_sql("od", OD, "o_totalprice", ["o_orderstatus", "o_orderpriority"], _fn, "ts, o_orderpriority, o_orderstatus, o_orderkey", "o_orderpriority, o_orderstatus, ts, o_orderkey", 4))

# --- order, limits, cursors

on_events("order_desc_topk", lambda b: b.select("value").order_by_time_desc().limit(50), "SELECT event_type, user_id, ts, value FROM ev ORDER BY ts DESC, event_type, user_id, event_id LIMIT 50")
on_events("order_asc_series_major", lambda b: b.select("value").limit(40), "SELECT event_type, user_id, ts, value FROM ev ORDER BY event_type, user_id, event_id, ts LIMIT 40")
on_events("limit_offset_rows", lambda b: b.select("value").order_by_time_desc().offset(30).limit(20), "SELECT event_type, user_id, ts, value FROM ev ORDER BY ts DESC, event_type, user_id, event_id LIMIT 20 OFFSET 30")
on_events("limit_offset_samples", lambda b: b.select("value", "bin").offset(25).limit(60), """, s AS (SELECT event_type, user_id, 'bin' AS field, ts, CAST(bin AS DOUBLE) AS value FROM ev UNION ALL SELECT event_type, user_id, 'value', ts, value FROM ev)
SELECT * FROM s ORDER BY event_type, user_id, field, ts LIMIT 60 OFFSET 25""", shape=long_values)
on_events("order_desc_samples", lambda b: b.select("value").order_by_time_desc().limit(45), "SELECT event_type, user_id, 'value' AS field, ts, value FROM ev ORDER BY event_type, user_id, ts DESC LIMIT 45", shape=long_values)


def _resumed(spark: SparkSession, sf_dir: str, descending: bool) -> DataFrame:
    q = QueryBuilder().from_measurement("events").select("value").limit(30)
    q = (q.order_by_time_desc() if descending else q.order_by_time_asc()).cursor(cursors.encode(3, T10, descending)).build()
    return execute.rows(events(spark, sf_dir), q)


for _d, _op, _dir in ((True, "<", "DESC"), (False, ">", "ASC")):
    add(f"cursor_resume_{_dir.lower()}", partial(lambda spark, sf_dir, descending: _resumed(spark, sf_dir, descending), descending=_d),
        f"WITH {EV}, n AS (SELECT *, dense_rank() OVER (ORDER BY event_type, user_id) AS series_id FROM ev) SELECT event_type, user_id, ts, value FROM n WHERE ts {_op} {T10} OR (ts = {T10} AND series_id > 3) ORDER BY ts {_dir}, series_id LIMIT 30")

# --- precision

for _p, _f in (("us", 1_000), ("ms", 1_000_000), ("s", 1_000_000_000)):
    on_events(f"precision_{_p}", lambda b, p=_p, f=_f: b.select("value").precision(p).time_range(T5 // f, T10 // f), f"SELECT event_type, user_id, ts // {_f} AS ts, value FROM ev WHERE ts BETWEEN {T5} AND {T10}")

# --- versions, deletes, retention


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event, and for every third a later version that carries ``value`` only."""
    m = events(spark, sf_dir)
    one = m.df.select("event_type", "user_id", "ts", "value", "bin", F.lit(1).cast("bigint").alias("write_seq"), F.col("event_id").alias("write_ord"))
    two = one.where(F.col("write_ord") % 3 == 0).select("event_type", "user_id", "ts", (F.col("value") * 2).alias("value"), F.lit(None).cast("bigint").alias("bin"), F.lit(2).cast("bigint").alias("write_seq"), "write_ord")
    return one.unionByName(two)


_VER = f"{EV}, ver AS (SELECT event_type, user_id, ts, value, bin, 1 AS write_seq, event_id AS write_ord FROM ev UNION ALL SELECT event_type, user_id, ts, value * 2, NULL, 2, event_id FROM ev WHERE event_id % 3 = 0)"
_NEWEST = "SELECT event_type, user_id, ts, arg_max(value, (write_seq, write_ord)) AS value, arg_max(bin, (write_seq, write_ord)) FILTER (WHERE bin IS NOT NULL) AS bin FROM {source} GROUP BY 1, 2, 3"
_KEYS = ["event_type", "user_id", "ts"]
add("lww_per_field", lambda spark, sf_dir: resolve_versions(_versions(spark, sf_dir), _KEYS, ["value", "bin"]), f"WITH {_VER} {_NEWEST.format(source='ver')}")
add("lww_then_filter", lambda spark, sf_dir: resolve_versions(_versions(spark, sf_dir), _KEYS, ["value", "bin"]).where(F.col("value") > 100), f"WITH {_VER}, n AS ({_NEWEST.format(source='ver')}) SELECT * FROM n WHERE value > 100")


def _stones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(None, None, T5, T5 + DAY, 1), ("click", None, T10, T20, 2)], "event_type string, user_id string, start_ts long, end_ts long, seq long")


_DEAD = f"((write_seq <= 1 AND ts BETWEEN {T5} AND {T5 + DAY}) OR (write_seq <= 2 AND event_type = 'click' AND ts BETWEEN {T10} AND {T20}))"
add("delete_tombstones", lambda spark, sf_dir: resolve_versions(anti_deleted(_versions(spark, sf_dir), _stones(spark), ["event_type", "user_id"], DAY), _KEYS, ["value", "bin"]).fillna(-1, ["bin"]), f"WITH {_VER}, live AS (SELECT * FROM ver WHERE NOT {_DEAD}), n AS ({_NEWEST.format(source='live')}) SELECT event_type, user_id, ts, value, coalesce(bin, -1) AS bin FROM n")


# --- the store: queries that change it write their measurements into a store of their own, others share one


def _engine(spark: SparkSession, **options) -> Engine:
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp()
    engine = Engine(spark, f"{base.rstrip('/')}/store-{uuid.uuid4().hex}", **{"shard": DAY, **options})
    atexit.register(_drop, engine.store)
    return engine


def _drop(store: Store) -> None:
    if store.spark.sparkContext._jsc is not None and not store.spark.sparkContext._jsc.sc().isStopped():
        store.files.delete(store.root)


_AT = ("d", "raw", "events")


def stored(spark: SparkSession, sf_dir: str, batches: int = 1, **options) -> Engine:
    """Events in a store, written in so many batches."""
    engine, df = _engine(spark, **options), events(spark, sf_dir).df.select("event_type", "user_id", "ts", "value", "bin", "event_id")
    for i in range(batches):
        engine.store.write(df.where(F.col("event_id") % batches == i), *_AT, tags=["event_type", "user_id"])
    return engine


def stored_rows(engine: Engine, build: Callable[[QueryBuilder], QueryBuilder] = lambda b: b.select("value")) -> DataFrame:
    return engine.query_rows(build(QueryBuilder().from_(*_AT)).build())


def _doubled(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    return events(spark, sf_dir).df.where(where).select("event_type", "user_id", "ts", (F.col("value") * 2).alias("value"))


_SHARED: dict[tuple, Engine] = {}


def shared(spark: SparkSession, sf_dir: str, batches: int = 1) -> Engine:
    """Events in a store that is only read, written once in an application."""
    key = spark.sparkContext.applicationId, sf_dir, batches
    if key not in _SHARED:
        _SHARED[key] = stored(spark, sf_dir, batches)
    return _SHARED[key]


_ROWS = "SELECT event_type, user_id, ts, value FROM ev"


def on_store(name: str, act: Callable[[Engine, SparkSession, str], DataFrame], sql: str, batches: int = 1, *, make=stored) -> None:
    add(name, lambda spark, sf_dir: act(make(spark, sf_dir, batches), spark, sf_dir), f"WITH {EV} {sql}")


def _overwritten(e: Engine, spark: SparkSession, sf_dir: str) -> DataFrame:
    e.store.write(_doubled(spark, sf_dir, "event_id % 3 = 0"), *_AT, tags=["event_type", "user_id"])
    return stored_rows(e, lambda b: b.select("value", "bin").where(field_gt("value", 20.0)))


def _deleted(e: Engine, **what) -> DataFrame:
    e.store.delete(*_AT, **what)
    return stored_rows(e)


def _rewritten(e: Engine, spark: SparkSession, sf_dir: str) -> DataFrame:
    e.store.delete(*_AT, start=T5, end=T20)
    e.store.write(_doubled(spark, sf_dir, f"event_type = 'click' AND ts BETWEEN {T10} AND {T20}"), *_AT, tags=["event_type", "user_id"])
    return stored_rows(e)


def _retained(e: Engine, policy: bool) -> DataFrame:
    if policy:
        e.store.create_retention_policy("d", "raw", 7 * DAY)
    e.store.apply_retention(T20, None if policy else 7 * DAY)
    e.store.vacuum(0)
    return stored_rows(e)


def _compacted(e: Engine, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overwrites and deletes, then every second shard compacted, then all the rest; replaced files go."""
    e.store.write(_doubled(spark, sf_dir, "event_id % 3 = 0"), *_AT, tags=["event_type", "user_id"])
    e.store.delete(*_AT, start=T5, end=T10, tags={"event_type": "view"})
    e.store.compact(*_AT, shards=e.store.shards(*_AT)[::2])
    e.store.compact(*_AT, min_parts=2)
    e.store.vacuum(0)
    held = e.store._table(*_AT)
    if held["tombstones"] or any(not p.get("unique") for p in held["parts"]):
        raise QueryError("internal", "compaction left versions or tombstones")
    return stored_rows(e)


on_store("store_write_read", lambda e, *_: stored_rows(e, lambda b: b.select("value", "bin", "event_id")), "SELECT event_type, user_id, ts, value, bin, event_id FROM ev", 3, make=shared)
on_store("store_time_range", lambda e, *_: stored_rows(e, lambda b: b.select("value").time_range(T5, T10)), f"{_ROWS} WHERE ts BETWEEN {T5} AND {T10}", make=shared)
on_store("store_limit_series_major", lambda e, *_: stored_rows(e, lambda b: b.select("value").time_range(T5, T20).limit(40)), f"{_ROWS} WHERE ts BETWEEN {T5} AND {T20} ORDER BY event_type, user_id, ts LIMIT 40", make=shared)
on_store("store_overwrite", _overwritten, "SELECT event_type, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value * 2 ELSE value END AS value, bin FROM ev WHERE CASE WHEN event_id % 3 = 0 THEN value * 2 ELSE value END > 20")
on_store("delete_range", lambda e, *_: _deleted(e, start=T5, end=T10), f"{_ROWS} WHERE NOT ts BETWEEN {T5} AND {T10}", 2)
on_store("delete_by_tag", lambda e, *_: _deleted(e, start=T5, end=T20, tags={"event_type": "view"}), f"{_ROWS} WHERE NOT (ts BETWEEN {T5} AND {T20} AND event_type = 'view')")
on_store("delete_absent_tag", lambda e, *_: _deleted(e, start=T5, end=T20, tags={"event_type": "click", "nothing": ""}), f"{_ROWS} WHERE NOT (ts BETWEEN {T5} AND {T20} AND event_type = 'click')")
on_store("delete_then_rewrite", _rewritten, f"SELECT event_type, user_id, ts, CASE WHEN ts BETWEEN {T5} AND {T20} THEN value * 2 ELSE value END AS value FROM ev WHERE NOT ts BETWEEN {T5} AND {T20} OR (event_type = 'click' AND ts BETWEEN {T10} AND {T20})")
on_store("retention_cutoff", lambda e, *_: _retained(e, False), f"{_ROWS} WHERE ts >= {T20 - 7 * DAY}")
on_store("retention_policy", lambda e, *_: _retained(e, True), f"{_ROWS} WHERE ts >= {T20 - 7 * DAY}", 2)
on_store("compaction", _compacted, f"SELECT event_type, user_id, ts, CASE WHEN event_id % 3 = 0 THEN value * 2 ELSE value END AS value FROM ev WHERE NOT (ts BETWEEN {T5} AND {T10} AND event_type = 'view')", 3)
on_store("store_aggregate", lambda e, *_: named(stored_rows(e, lambda b: b.aggregate("mean", "value").aggregate("count", "bin").group_by_tags("event_type").group_by_time(DAY))), f"SELECT event_type, (ts // {DAY}) * {DAY} AS ts, round(avg(value), 6) AS avg_value, count(bin) AS count_bin FROM ev GROUP BY 1, 2", 2, make=shared)
on_store("ndjson_stream", lambda e, *_: execute.as_json(stored_rows(e)).select(F.from_json("line", "event_type string, user_id string, ts long, value double").alias("r")).select("r.*"), _ROWS, make=shared)


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as points, one by one from the driver, in seconds."""
    engine = _engine(spark)
    engine.store.write_points(({"database": "d", "retention_policy": "raw", "measurement": "nation", "tags": {"name": r.n_name}, "ts": r.n_nationkey, "fields": {"region": r.n_regionkey}} for r in read(spark, sf_dir, "nation").toLocalIterator()), precision="s")
    return engine.query_rows(QueryBuilder().from_("d", "raw", "nation").build())


add("store_points", _points, "SELECT n_name AS name, CAST(n_nationkey AS BIGINT) * 1000000000 AS ts, CAST(n_regionkey AS BIGINT) AS region FROM nation")


def _walked(e: Engine, precision: str, descending: bool, limit: int) -> DataFrame:
    """All pages one after the other, the place of each row in the walk beside it; halfway a series is added that sorts first."""
    pages, token, at = [], "", 0
    while token is not None:
        b = QueryBuilder().from_(*_AT).select("value").precision(precision).limit(limit)
        b = b.order_by_time_desc() if descending else b.order_by_time_asc()
        page, token = e.page((b.cursor(token) if token else b).build())
        if not pages:
            e.store.write(e.spark.createDataFrame([("a", "0", 1, 1.0)], "event_type string, user_id string, ts long, value double"), *_AT, tags=["event_type", "user_id"])
        pages.append(page)
    return reduce(DataFrame.unionByName, pages).where("event_type <> 'a'")


for _p, _f in (("ns", 1), ("s", 1_000_000_000)):
    for _d in (True, False):
        on_store(f"cursor_walk_{'desc' if _d else 'asc'}_{_p}", lambda e, spark, sf_dir, p=_p, d=_d: _walked(e, p, d, max(64, events(spark, sf_dir).df.count() // 5)), f"SELECT event_type, user_id, ts // {_f} AS ts, value FROM ev")

# --- metadata


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = events(spark, sf_dir)
    return number(series_table(m), sorted(m.tags)).select("series_id", *m.tags)


def _catalog(spark: SparkSession, sf_dir: str) -> Store:
    """Events, orders and line items, each measurement with its fields."""
    store = _engine(spark, shard=10_000 * DAY).store
    for m in (events(spark, sf_dir), orders(spark, sf_dir), lineitem(spark, sf_dir)):
        store.write(m.df.select(*m.tags, "ts", *m.fields), "d", "raw", m.name, tags=m.tags)
    store.create_retention_policy("d", "hot", 7 * DAY)
    store.create_database("empty")
    return store


def _listed(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_SERIES_SQL = f"WITH {EV}, s AS (SELECT DISTINCT event_type, user_id FROM ev) SELECT row_number() OVER (ORDER BY event_type, user_id) AS series_id, event_type, user_id FROM s"
add("meta_series_numbered", _series, _SERIES_SQL)
add("meta_series", lambda spark, sf_dir: shared(spark, sf_dir).store.series(*_AT)[0], _SERIES_SQL)
add("meta_series_page", lambda spark, sf_dir: shared(spark, sf_dir).store.series(*_AT, offset=10, limit=25)[0], f"{_SERIES_SQL} ORDER BY series_id LIMIT 25 OFFSET 10")
add("meta_series_of_tag", lambda spark, sf_dir: shared(spark, sf_dir).store.series(*_AT, tags={"event_type": "view"})[0].select("event_type", "user_id"), f"WITH {EV} SELECT DISTINCT event_type, user_id FROM ev WHERE event_type = 'view'")
add("series_search", lambda spark, sf_dir: shared(spark, sf_dir).store.series(*_AT, search="CLI")[0].select("event_type", "user_id"), f"WITH {EV} SELECT DISTINCT event_type, user_id FROM ev WHERE contains(lower(event_type), 'cli') OR contains(lower(user_id), 'cli')")
add("meta_fields", lambda spark, sf_dir: (lambda s: _listed(spark, [(m, f, k) for m in s.list_measurements("d") for f, k in s.list_fields("d", m).items()], "measurement string, field string, type string"))(_catalog(spark, sf_dir)), "SELECT * FROM (VALUES ('events','value','double'),('events','bin','bigint'),('events','event_id','bigint'),('orders','o_totalprice','double'),('orders','o_orderkey','bigint'),('lineitem','l_quantity','double'),('lineitem','l_extendedprice','double'),('lineitem','l_discount','double')) t(measurement, field, type)")
add("meta_measurements", lambda spark, sf_dir: (lambda s: _listed(spark, [(m,) for m in s.list_measurements("d")], "measurement string"))(_catalog(spark, sf_dir)), "SELECT * FROM (VALUES ('events'),('orders'),('lineitem')) t(measurement)")
add("meta_policies", lambda spark, sf_dir: (lambda s: _listed(spark, [(d, p) for d in s.list_databases() for p in s.list_retention_policies(d) or [""]], "name string, policy string"))(_catalog(spark, sf_dir)), "SELECT * FROM (VALUES ('d','hot'),('d','raw'),('empty','')) t(name, policy)")


def _guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the engine refuses, by code."""
    e = stored(spark, sf_dir, 2, max_limit=100)
    q = lambda build: (lambda: e.query_rows(build(QueryBuilder().from_(*_AT)).build()))
    cases = {
        "samples": q(lambda b: b.select("value").budget(max_samples=10)),
        "shards": q(lambda b: b.budget(max_shards=2)),
        "parts": q(lambda b: b.budget(max_parts=1)),
        "server limit": q(lambda b: b.limit(101)),
        "negative limit": q(lambda b: b.limit(-1)),
        "foreign cursor": q(lambda b: b.select("value").order_by_time_desc().limit(5).cursor(cursors.encode(1, T5, False))),
        "no such field": q(lambda b: b.select("nothing")),
        "no such measurement": lambda: e.query_rows(QueryBuilder().from_("d", "raw", "nothing").build()),
        "default budget": lambda: Engine.query_rows(_limited(e), QueryBuilder().from_(*_AT).select("value").build()),
    }
    out = []
    for name, run in cases.items():
        try:
            run()
            out.append((name, "none"))
        except QueryError as x:
            out.append((name, x.code))
    return _listed(spark, out, "name string, code string")


def _costs(e: Engine, spark: SparkSession, sf_dir: str) -> DataFrame:
    q = QueryBuilder().from_(*_AT).where(tag_eq("event_type", "click")).select("value").time_range(T5, T10).build()
    whole = QueryBuilder().from_(*_AT).aggregate("mean", "value").group_by_time(DAY).build()
    out = [(name, c.plan_class, c.series, c.candidate_shards, c.matched_shards, c.matched_parts) for name, c in (("scan", e.explain(q).cost), ("windows", e.explain(whole).cost))]
    return _listed(spark, out, "name string, plan_class string, series long, candidate_shards long, matched_shards long, parts long")


on_store("explain_cost", _costs, f""", a AS (SELECT count(DISTINCT (event_type, user_id)) AS s, count(DISTINCT (event_type, user_id)) FILTER (WHERE event_type = 'click') AS c, count(DISTINCT ts // {DAY}) AS d, count(DISTINCT ts // {DAY}) FILTER (WHERE ts // {DAY} BETWEEN {T5 // DAY} AND {T10 // DAY}) AS m FROM ev)
SELECT 'scan' AS name, 'scan' AS plan_class, c AS series, d AS candidate_shards, m AS matched_shards, 2 AS parts FROM a UNION ALL SELECT 'windows', 'group_aggregate', s, d, d, 2 FROM a""", 2, make=shared)


def _stats(e: Engine, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, shards and parts of a measured query, and the rows its scan and its whole plan counted."""
    _, s = e.measured(QueryBuilder().from_(*_AT).select("value").time_range(T5, T10).build(), DataFrame.collect, profile=True)
    scans = sum(o.rows for o in s.operators if o.name.startswith("Scan"))
    return _listed(spark, [(s.rows, s.shards_scanned, s.shards_skipped, s.parts, scans >= s.rows and len(s.operators) > 3)], "out_rows long, scanned long, skipped long, parts long, profiled boolean")


on_store("query_stats", _stats, f"SELECT count(*) FILTER (WHERE ts BETWEEN {T5} AND {T10}) AS out_rows, count(DISTINCT ts // {DAY}) FILTER (WHERE ts // {DAY} BETWEEN {T5 // DAY} AND {T10 // DAY}) AS scanned, count(DISTINCT ts // {DAY}) FILTER (WHERE NOT ts // {DAY} BETWEEN {T5 // DAY} AND {T10 // DAY}) AS skipped, 1 AS parts, true AS profiled FROM ev", make=shared)


def _limited(e: Engine) -> Engine:
    return Engine(e.spark, e.store.root, default_budget=Budget(max_samples=10), shard=DAY)


add("guards", _guarded, "SELECT * FROM (VALUES ('samples','read-budget-exceeded'),('shards','read-budget-exceeded'),('parts','read-budget-exceeded'),('server limit','invalid-pagination'),('negative limit','invalid-pagination'),('foreign cursor','invalid-cursor'),('no such field','field-not-found'),('no such measurement','measurement-not-found'),('default budget','read-budget-exceeded')) t(name, code)")

# --- downsampling

_FUNCTIONS = ("avg", "min", "max", "count", "last", "first", "sum", "increase", "delta", "spread", "difference")


def policy(interval: int, functions: tuple[str, ...] = _FUNCTIONS, group: tuple[str, ...] = ("event_type",), **more) -> Policy:
    return normalized(Policy("p", "d", "raw", "events", "d", "rolled", "events_rolled", interval, tuple(Function(f, "value") for f in functions), group, **more))


def _rolled_sql(interval: int, where: str = "true") -> str:
    o = "ts, event_type, user_id, event_id"
    return f"""WITH {EV}, w AS (SELECT *, ts - ts % {interval} AS w FROM ev WHERE {where}),
l AS (SELECT *, lag(value) OVER (PARTITION BY event_type, w ORDER BY {o}) AS pv FROM w),
i AS (SELECT *, CASE WHEN pv IS NULL THEN 0 WHEN value >= pv THEN value - pv ELSE value END AS inc FROM l)
SELECT event_type, 'p' AS downsample_policy, w AS ts, round(avg(value), 6) AS avg_value, round(min(value), 6) AS min_value, round(max(value), 6) AS max_value, count(value) AS count_value,
round(last(value ORDER BY {o}), 6) AS last_value, round(first(value ORDER BY {o}), 6) AS first_value, round(sum(value), 6) AS sum_value,
round(CASE WHEN count(*) > 1 THEN sum(inc) END, 6) AS increase_value, round(CASE WHEN count(*) > 1 THEN last(value ORDER BY {o}) - first(value ORDER BY {o}) END, 6) AS delta_value,
round(max(value) - min(value), 6) AS spread_value, round(CASE WHEN count(*) > 1 THEN last(value ORDER BY {o}) - first(value ORDER BY {o}) END, 6) AS difference_value
FROM i GROUP BY 1, 2, 3"""


add("downsample_1h", lambda spark, sf_dir: named(rollup(events(spark, sf_dir), policy(HOUR))), _rolled_sql(HOUR))
add("downsample_1d_range", lambda spark, sf_dir: named(rollup(events(spark, sf_dir), policy(DAY), T5, T20)), _rolled_sql(DAY, f"ts >= {T5} AND ts < {T20}"))


def _late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rollup up to day 10, then late samples for day 8 (values doubled there); the refresh overwrites its windows."""
    m, p = events(spark, sf_dir), policy(DAY, ("avg", "count"), lookback=3 * DAY)
    first = rollup(m, p, T0, T10).withColumn("write_seq", F.lit(1))
    late = Measurement(m.df.withColumn("value", F.when(F.col("ts").between(T0 + 7 * DAY, T0 + 8 * DAY - 1), F.col("value") * 2).otherwise(F.col("value"))), m.name, m.tags, m.fields, m.tie, raw=m.raw)
    again = rollup(late, p, floor_to(T10 - p.lookback, p.interval), T10).withColumn("write_seq", F.lit(2))
    return named(resolve_versions(first.unionByName(again), ["event_type", p.policy_tag, "ts"], ["avg_value", "count_value"], ("write_seq",)))


add("downsample_refresh_late", _late, f"WITH {EV}, x AS (SELECT event_type, ts - ts % {DAY} AS w, CASE WHEN ts BETWEEN {T0 + 7 * DAY} AND {T0 + 8 * DAY - 1} THEN value * 2 ELSE value END AS v FROM ev WHERE ts >= {T0} AND ts < {T10}) SELECT event_type, 'p' AS downsample_policy, w AS ts, round(avg(v), 6) AS avg_value, count(*) AS count_value FROM x GROUP BY 1, 3")


def _query_rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = policy(DAY, ("avg", "max"))
    rolled = rollup(events(spark, sf_dir), p)
    m = Measurement(rolled, p.target_measurement, ("event_type", p.policy_tag), {"avg_value": "double", "max_value": "double"})
    q = QueryBuilder().from_downsample_policy(p).where(tag_eq("event_type", "view")).select("avg_value").order_by_time_desc().build()
    return named(execute.rows(m, q))


add("downsample_query", _query_rolled, f"WITH {EV} SELECT event_type, 'p' AS downsample_policy, ts - ts % {DAY} AS ts, round(avg(value), 6) AS avg_value FROM ev WHERE event_type = 'view' GROUP BY 1, 3")
add("downsample_dry_run", lambda spark, sf_dir: estimate(events(spark, sf_dir), policy(HOUR), T5, T10), f"WITH {EV} SELECT count(DISTINCT event_type) AS groups, CAST(count(value) AS BIGINT) AS samples FROM ev WHERE ts >= {T5} AND ts < {T10}")


def _downsampler(spark: SparkSession, sf_dir: str, **more) -> Downsampler:
    d = stored(spark, sf_dir, 2).downsample
    d.create(Policy("p", *_AT, "d", "rolled", "events_1d", DAY, tuple(Function(f, "value") for f in ("avg", "count")), ("event_type",), **more))
    return d


def _rolled(d: Downsampler) -> DataFrame:
    return named(d.store.read("d", "rolled", "events_1d").df.select("event_type", "downsample_policy", "ts", "avg_value", "count_value"))


def _run(d: Downsampler, act: Callable[[Downsampler], object]) -> DataFrame:
    act(d)
    return _rolled(d)


def _late_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run, late samples within the lookback (doubled values), and the next run."""
    d = _downsampler(spark, sf_dir, initial_start=T0, lookback=3 * DAY)
    d.run("p", T10)
    d.store.write(_doubled(spark, sf_dir, f"ts BETWEEN {T0 + 8 * DAY} AND {T0 + 9 * DAY - 1}"), *_AT, tags=["event_type", "user_id"])
    d.run("p", T10 + DAY)
    return _rolled(d)


_ROLLED = "SELECT event_type, 'p' AS downsample_policy, ts - ts % {day} AS ts, round(avg({v}), 6) AS avg_value, count(value) AS count_value FROM ev WHERE {where} GROUP BY 1, 3"
add("downsample_run", lambda spark, sf_dir: _run(_downsampler(spark, sf_dir, initial_start=T0), lambda d: (d.run("p", T5), d.run("p", T20))), f"WITH {EV} {_ROLLED.format(day=DAY, v='value', where=f'ts >= {T0} AND ts < {T20}')}")
add("downsample_run_range", lambda spark, sf_dir: _run(_downsampler(spark, sf_dir), lambda d: (d.run_range("p", T5, T10, advance=True), d.repair("p", T5, T5 + DAY))), f"WITH {EV} {_ROLLED.format(day=DAY, v='value', where=f'ts >= {T5} AND ts < {T10}')}")
add("downsample_run_late", _late_run, f"WITH {EV} {_ROLLED.format(day=DAY, v=f'CASE WHEN ts BETWEEN {T0 + 8 * DAY} AND {T0 + 9 * DAY - 1} THEN value * 2 ELSE value END', where=f'ts >= {T0} AND ts < {T10 + DAY}')}")
add("downsample_reset_cleanup", lambda spark, sf_dir: _run(_downsampler(spark, sf_dir, initial_start=T0), lambda d: (d.run("p", T10), d.reset("p", completed_until=T5, cleanup=True, start=T5, end=T10))), f"WITH {EV} {_ROLLED.format(day=DAY, v='value', where=f'ts >= {T0} AND ts < {T5}')}")
add("downsample_status", lambda spark, sf_dir: (lambda d: (d.run("p", T10), _listed(spark, [(s["policy"], s["completed_until"], s["windows"], s["lag_seconds"]) for s in d.statuses(T10 + DAY)], "name string, completed_until long, windows long, lag_seconds long"))[1])(_downsampler(spark, sf_dir, initial_start=T0)), f"SELECT 'p' AS name, {T10} AS completed_until, CAST(10 AS BIGINT) AS windows, CAST(86400 AS BIGINT) AS lag_seconds")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RUNS["flagship"](spark, sf_dir)


assert set(registry.NUMBERS | registry.ANY_TYPE) >= set(_PLAIN)
