"""The store: versions, deletes, retention, compaction, metadata, downsampling, streams."""

import pytest
from pyspark.sql import functions as F

from tidemark.engine import Engine
from tidemark.errors import QueryError
from tidemark.plans.builder import QueryBuilder
from tidemark.plans.model import Budget, field_gt
from tidemark.streaming.downsample import MINUTE, Function, Policy, plan
from tidemark.streaming.scheduler import Scheduler
from tidemark.streaming.stream import tumbling, upsert_rollup

HOUR = 60 * MINUTE


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "root"))


def point(ts, tags, m="cpu", db="metrics", rp="autogen", **fields):
    return {"database": db, "retention_policy": rp, "measurement": m, "tags": tags, "ts": ts, "fields": fields}


def rows(engine, m="cpu", db="metrics", rp="autogen", build=lambda b: b):
    got = engine.query_rows(build(QueryBuilder().from_(db, rp, m)).build())
    return sorted((r.asDict() for r in got.collect()), key=lambda r: (r["ts"], str(r)))


def test_versions_by_field(engine):
    a = {"host": "a"}
    engine.store.write_points([point(10, a, v=1.0), point(11, a, v=7.0), point(11, a, v=8.0)])
    engine.store.write_points([point(10, a, v=9.0)])
    engine.store.write_points([point(10, a, w=3)])
    assert rows(engine) == [{"host": "a", "ts": 10, "v": 9.0, "w": 3}, {"host": "a", "ts": 11, "v": 8.0, "w": None}]
    assert rows(engine, build=lambda b: b.where(field_gt("v", 8.5)).select("w")) == [{"host": "a", "ts": 10, "w": 3}]


def test_deletes(engine):
    engine.store.write_points([point(t, {"host": h}, v=float(t)) for t in (1, 2, 3) for h in "ab"])
    engine.store.delete("metrics", "autogen", "cpu", start=2, end=2, tags={"host": "a"})
    assert [(r["host"], r["ts"]) for r in rows(engine)] == [("a", 1), ("b", 1), ("b", 2), ("a", 3), ("b", 3)]
    engine.store.write_points([point(2, {"host": "a"}, v=5.0)])
    assert rows(engine)[2]["v"] == 5.0 and len(rows(engine)) == 6
    engine.store.compact("metrics", "autogen", "cpu")
    assert len(rows(engine)) == 6 and engine.store._table("metrics", "autogen", "cpu")["tombstones"] == []
    engine.store.delete("metrics", "autogen", "cpu", start=0, end=0)
    assert len(rows(engine)) == 6


def test_shards_retention_compaction(engine, spark):
    engine.store.write_points([point(i * HOUR + 5, {"host": f"h{i % 3}"}, v=float(i)) for i in range(-2, 8)])
    assert engine.store.shards("metrics", "autogen", "cpu") == [i * HOUR for i in range(-2, 8)]
    assert engine.store.shards("metrics", "autogen", "cpu", HOUR, 2 * HOUR) == [HOUR, 2 * HOUR]
    plan_ = engine.explain(QueryBuilder().from_("metrics", "autogen", "cpu").time_range(HOUR, 2 * HOUR).build())
    assert plan_.estimated_shards == 2 and "PartitionFilters: [isnotnull(shard_start" in plan_.plan
    with pytest.raises(QueryError) as e:
        engine.query_rows(QueryBuilder().from_("metrics", "autogen", "cpu").budget(max_shards=2).build())
    assert e.value.code == "read-budget-exceeded"
    assert engine.store.apply_retention(5 * HOUR + 6, 3 * HOUR) == 4
    assert [r["v"] for r in rows(engine)] == [3.0, 4.0, 5.0, 6.0, 7.0]
    engine.store.compact("metrics", "autogen", "cpu")
    assert [r["v"] for r in rows(engine)] == [3.0, 4.0, 5.0, 6.0, 7.0]
    pushed = engine.explain(QueryBuilder().from_("metrics", "autogen", "cpu").where(field_gt("v", 6.0)).build()).plan
    assert "GreaterThan(v,6.0)" in pushed
    again = Engine(spark, engine.store.root)
    assert len(rows(again)) == 5


def test_schema_and_limits(engine, spark):
    engine.store.write_points([point(1, {"host": "a"}, v=1.0)])
    for bad, code in ([point(1, {}, v="x")], "field-type-conflict"), ([point(1, {})], "invalid-point"), ([point(1, {}, m="", v=1)], "invalid-point"), ([point(1, {}, ts2=None)], "invalid-point"):
        with pytest.raises(QueryError) as e:
            engine.store.write_points(bad)
        assert e.value.code == code
    tight = Engine(spark, engine.store.root + "2", max_series=2, max_fields=2, max_tag_values=2)
    tight.store.write_points([point(1, {"host": h}, v=1.0) for h in "ab"])
    for bad in ([point(1, {"host": "c"}, v=1.0)], [point(1, {"host": "a"}, v=1.0, w=1, x=2)]):
        with pytest.raises(QueryError) as e:
            tight.store.write_points(bad)
        assert e.value.code == "cardinality-limit"
    with pytest.raises(Exception, match="invalid-precision"):
        engine.store.write_points([point(2**62, {}, v=1.0)], precision="s")
    engine.store.write_points([point(3, {"zone": "z"}, w=True)], precision="s")
    assert rows(engine)[-1] == {"host": None, "zone": "z", "ts": 3_000_000_000, "v": None, "w": True}


def test_metadata(engine):
    engine.store.create_database("metrics")
    engine.store.create_retention_policy("metrics", "hot", 7 * 24 * HOUR)
    engine.store.write_points([point(1, {"host": h, "region": "EAST" if h < "c" else "west"}, v=1.0) for h in "abcd"] + [point(1, {}, m="mem", used=3)])
    s = engine.store
    assert s.list_databases() == ["metrics"] and s.list_retention_policies("metrics") == ["autogen", "hot"]
    assert s.list_measurements("metrics") == ["cpu", "mem"] and s.list_fields("metrics", "mem") == {"used": "bigint"}
    page, total, more = s.series("metrics", "autogen", "cpu", search="east", limit=1, offset=1)
    assert [(r.series_id, r.host) for r in page.collect()] == [(2, "b")] and (total, more) == (2, False)
    assert s.series("metrics", "autogen", "cpu", tags={"region": "west"})[1] == 2
    s.drop_database("metrics")
    assert s.list_databases() == []
    with pytest.raises(QueryError):
        s.list_fields("metrics", "cpu")


def test_budget_of_parts(engine):
    for i in range(3):
        engine.store.write_points([point(i, {}, v=1.0)])
    with pytest.raises(QueryError):
        engine.query_rows(QueryBuilder().from_("metrics", "autogen", "cpu").budget(max_parts=2).build())
    assert Budget() == Budget(0, 0, 0)


# --- downsampling


def policy(**more):
    base = {"name": "p", "source_database": "metrics", "source_retention": "autogen", "source_measurement": "cpu", "target_database": "metrics", "target_retention": "rp_5m", "target_measurement": "cpu_5m", "interval": 5 * MINUTE, "functions": (Function("mean", "usage"),), "group_by_tags": ("host",)}
    return Policy(**base | more)


def minutes(engine, n=5):
    engine.store.write_points([point(i * MINUTE, {"host": "a", "region": "x"}, usage=float(i)) for i in range(n)])


def target(engine, m="cpu_5m", rp="rp_5m"):
    return rows(engine, m, rp=rp)


def test_average_of_five_minutes(engine, spark):
    minutes(engine)
    d = engine.downsample
    d.create(policy())
    assert d.run("p", 10 * MINUTE).completed_until == 10 * MINUTE  # without a start only the last window is due
    d.repair("p", 0, 5 * MINUTE)
    assert target(engine) == [{"host": "a", "downsample_policy": "p", "ts": 0, "avg_usage": 2.0}]
    got = engine.query_rows(QueryBuilder().from_downsample_policy(d.get("p")).build()).collect()
    assert got[0].avg_usage == 2.0
    again = Engine(spark, engine.store.root).downsample
    assert again.get("p") == d.get("p") and again.status("p", 10 * MINUTE)["completed_until"] == 10 * MINUTE


def test_functions_over_windows(engine):
    engine.store.write_points([point(t * 1_000_000_000, {"host": "a"}, usage=v) for t, v in ((0, 1.0), (60, 3.0), (90, 3.0))])
    names = ("rate", "difference", "mode", "stddev", "derivative", "median", "irate", "increase", "first", "count")
    engine.downsample.create(policy(interval=2 * MINUTE, functions=tuple(Function(n, "usage") for n in names)))
    engine.downsample.run_range("p", 0, 2 * MINUTE)
    (got,) = target(engine)
    assert (got["rate_usage"], got["difference_usage"], got["mode_usage"], got["median_usage"], got["irate_usage"], got["increase_usage"], got["first_usage"], got["count_usage"]) == (2 / 90, 2.0, 3.0, 3.0, 0.0, 2.0, 1.0, 3)
    assert abs(got["stddev_usage"] - (8 / 9) ** 0.5) < 1e-12 and abs(got["derivative_usage"] - 2 / 90) < 1e-12


def test_late_data(engine):
    minutes(engine)
    d = engine.downsample
    d.create(policy(interval=MINUTE, lookback=5 * MINUTE, initial_start=1, delay=0))
    d.run("p", 5 * MINUTE)
    assert [r["avg_usage"] for r in target(engine)] == [0, 1, 2, 3, 4]
    engine.store.write_points([point(2 * MINUTE, {"host": "a", "region": "x"}, usage=100.0)])
    state = d.run("p", 6 * MINUTE)
    assert [r["avg_usage"] for r in target(engine)] == [0, 1, 100, 3, 4] and state.completed_until == 6 * MINUTE
    assert d.status("p", 7 * MINUTE)["lag_seconds"] == 60


def test_window_plan():
    p = policy(interval=MINUTE, lookback=2 * MINUTE)
    got = plan(p, 5 * MINUTE, 7 * MINUTE)
    assert (got.start, got.advance, got.end, got.refresh_windows, got.windows) == (3 * MINUTE, 5 * MINUTE, 7 * MINUTE, 2, 4)
    assert plan(p, 7 * MINUTE, 7 * MINUTE).windows == 2 and plan(policy(), 0, MINUTE) is None
    assert plan(policy(interval=MINUTE), 0, 7 * MINUTE).start == 6 * MINUTE
    assert plan(policy(interval=MINUTE, delay=3 * MINUTE), 2 * MINUTE, 7 * MINUTE).end == 4 * MINUTE


def test_policy_management(engine):
    d = engine.downsample
    for bad in ({"interval": 0}, {"functions": ()}, {"functions": (Function("fill", "x"),)}, {"functions": (Function("avg", "x"), Function("mean", "x"))}, {"name": " "}, {"target_retention": "autogen", "target_measurement": "cpu"}, {"lookback": -1}, {"policy_tag": " "}):
        with pytest.raises(QueryError):
            d.create(policy(**bad))
    minutes(engine)
    d.create(policy())
    with pytest.raises(QueryError):
        d.create(policy(interval=MINUTE))
    d.create(policy(lookback=MINUTE))
    d.run_range("p", 0, 5 * MINUTE, advance=True)
    assert d.states["p"].completed_until == 5 * MINUTE and len(target(engine)) == 1
    with pytest.raises(QueryError):
        d.run_range("p", 20 * MINUTE, 30 * MINUTE, advance=True)
    dry = d.dry_run("p", 0, 10 * MINUTE)
    assert (dry.windows, dry.refresh_windows, dry.groups, dry.samples, dry.points) == (2, 1, 1, 5, 2)
    d.reset("p", allow_replace=True, cleanup=True)
    assert target(engine) == []
    d.create(policy(interval=MINUTE))
    d.disable("p")
    with pytest.raises(QueryError):
        d.run("p", HOUR)
    assert d.due(HOUR) == [] and [p.name for p in d.list()] == ["p"]
    d.enable("p")
    assert d.due(HOUR) == ["p"]
    d.drop("p", cleanup=True)
    assert d.list() == []


def test_failure_keeps_the_watermark(engine):
    minutes(engine)
    d = engine.downsample
    d.create(policy(functions=(Function("avg", "nothing"),), initial_start=1))
    with pytest.raises(QueryError):
        d.run("p", HOUR)
    assert d.states["p"].completed_until == 0 and "nothing" in d.states["p"].last_error


def test_scheduler(engine):
    minutes(engine)
    d = engine.downsample
    d.create(policy(initial_start=1))
    s = Scheduler(d)
    assert s.tick(10 * MINUTE) == ["p"]
    s.wait()
    assert s.tick(10 * MINUTE + 1) == [] and d.states["p"].completed_until == 10 * MINUTE
    s.stop()


def test_stream_upserts_late_points(engine, spark, tmp_path):
    d, path = engine.downsample, str(tmp_path / "in")
    d.create(policy(interval=MINUTE))
    schema = "host string, ts long, usage double"
    run = lambda: upsert_rollup(d, "p", spark.readStream.schema(schema).parquet(path), checkpoint=str(tmp_path / "check")).awaitTermination()
    spark.createDataFrame([("a", i * MINUTE // 2, float(i)) for i in range(6)], schema).write.parquet(path)
    run()
    assert [r["avg_usage"] for r in target(engine)] == [0.5, 2.5, 4.5]
    spark.createDataFrame([("a", MINUTE + 1, 100.0)], schema).write.mode("append").parquet(path)
    run()
    assert [r["avg_usage"] for r in target(engine)] == [0.5, 35.0, 4.5]


def test_tumbling_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001").withColumn("ts", F.col("ts").cast("timestamp"))
    out = tumbling(stream, ts="ts", tags=["event_type"], field="value", functions=["count", "avg", "first"], window="1 day", watermark="1 hour")
    query = out.writeStream.format("memory").queryName("rolled").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("rolled").groupBy().sum("count_value").first()[0]
    assert got == events.count()


# --- numbering


def test_ids_follow_the_tags_however_rows_are_dealt(engine, spark, monkeypatch):
    """Many series over partitions that are not joined again, so that a sample of them decides what goes where."""
    from tidemark.sources import series

    monkeypatch.setattr(series, "PIECE", 1_000, raising=False)
    conf, n = "spark.sql.adaptive.coalescePartitions.enabled", 20_000
    tags = [F.when(F.col("id") % 7 > 0, F.concat(F.lit("é"), (F.col("id") % 7).cast("string"))).alias("kind"), (F.col("id") * 7919 % n).cast("string").alias("host")]
    df = spark.range(n).select(*tags, F.lit(1).cast("bigint").alias("ts"), F.lit(1.0).alias("v"))
    want = sorted((r.kind or "", r.host) for r in df.collect())
    spark.conf.set(conf, "false")
    try:
        engine.store.write(df, "d", "a", "m", tags=["kind", "host"])
        for got in (engine.store.series("d", "a", "m")[0], series.number(df.select("kind", "host"), ["kind", "host"])):
            # Ids are by tags in the order of their names in the store.
            found = sorted(got.collect(), key=lambda r: r.series_id)
            assert [r.series_id for r in found] == list(range(1, n + 1))
            assert [(r.kind or "", r.host) for r in found] == (want if got.columns[0] == "kind" else sorted(want, key=lambda x: (x[1], x[0])))
    finally:
        spark.conf.unset(conf)


# --- pages, zones, pieces


@pytest.mark.parametrize("descending", [True, False])
def test_pages_meet_every_row_once(engine, descending):
    """At coarse precision, with ties of time, and with a series added between pages that sorts first."""
    engine.store.write_points([point(t * 100_000_000, {"host": h}, v=float(t)) for t in range(25) for h in "hij"])
    seen, token = [], ""
    while token is not None:
        b = QueryBuilder().from_("metrics", "autogen", "cpu").precision("s").limit(7)
        b = b.order_by_time_desc() if descending else b.order_by_time_asc()
        page, token = engine.page((b.cursor(token) if token else b).build())
        seen += [(r.host, r.v) for r in page.collect()]
        if len(seen) == 7:
            engine.store.write_points([point(1, {"host": "a"}, v=-1.0)])
    rest = [x for x in seen if x[0] != "a"]
    assert len(rest) == 75 == len(set(rest))
    ids = {r.host: r.series_id for r in engine.store.series_ids("metrics", "autogen", "cpu").collect()}
    assert ids == {"h": 1, "i": 2, "j": 3, "a": 4}


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("where", ["stored", "registered"])
def test_long_pages_are_not_fetched(engine, spark, monkeypatch, descending, where):
    """Pages above the bound have the rows and tokens of fetched ones: instants of many series, times before 1970, an offset."""
    from pyspark.sql import DataFrame

    from tidemark.operators import execute
    from tidemark.sources.measurement import from_dataframe

    data = [point(t, {"host": f"h{i:02}"}, v=float(t)) for i in range(15) for t in (-3 * HOUR - 7, -1, 0, 1, 5, 6, 7, HOUR, 40 * HOUR + i % 2)]
    if where == "stored":
        engine.store.write_points(data)
    else:
        df = spark.createDataFrame([(p["tags"]["host"], p["ts"], p["fields"]["v"]) for p in data], "host string, ts long, v double")
        engine.register(from_dataframe(df, "cpu", tags=("host",), fields=("v",), ts="ts"))

    def walk(limit, offset=0):
        got, token = [], ""
        while token is not None:
            b = QueryBuilder()
            b = (b.from_("metrics", "autogen", "cpu") if where == "stored" else b.from_measurement("cpu")).limit(limit).offset(offset)
            b = b.order_by_time_desc() if descending else b.order_by_time_asc()
            page, token = engine.page((b.cursor(token) if token else b).build())
            got.append(([(r.host, r.ts, r.v) for r in page.collect()], token))
        return got

    want = [walk(45), walk(40, 70)]
    assert len({r for rows_, _ in want[0] for r in rows_}) == 135 and [len(r) for r, _ in want[0]] == [45, 45, 45, 0]
    monkeypatch.setattr(execute, "PAGE", 4)
    monkeypatch.setattr(execute, "STRETCHES", 5, raising=False)
    monkeypatch.setattr(DataFrame, "toArrow", lambda df: pytest.fail("a page was fetched"))
    monkeypatch.setattr(type(spark.range(1)), "toArrow", lambda df: pytest.fail("a page was fetched"))
    assert [walk(45), walk(40, 70)] == want


def test_time_bounds_in_any_zone(spark):
    from tidemark import queries

    def both(kind):
        df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
        if kind == "timestamp":
            df = df.withColumn("ts", F.timestamp_micros(F.lit(queries.T0 // 1000) + F.col("event_id") * 3_600_000_000))
        m = queries.from_dataframe(df, "events", tags=("event_type",), fields=("value",), ts="ts")
        return sorted(r.ts for r in m.scan(queries.T5, queries.T10).df.collect())

    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        got = {}
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            got[zone] = both("timestamp_ntz"), both("timestamp")
        assert got["UTC"] == got["America/New_York"] == got["Asia/Kolkata"] and all(got["UTC"])
        assert all(queries.T5 <= t <= queries.T10 for t in got["UTC"][0])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_zoneless_times_become_numbers_without_decimals(spark):
    """Before 1970, with gaps and doubled hours of the session's zone; each row is written through this."""
    from datetime import datetime, timedelta

    from tidemark.sources.measurement import micros

    texts = ["0001-01-01 00:00:00", "1582-10-10 01:02:03.000004", "1969-12-31 23:59:59.999999", "2024-03-10 02:30:00.123456", "2024-11-03 01:30:00.1", "9999-12-31 23:59:59.999999"]
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", micros(F.col("t").cast("timestamp_ntz"), "timestamp_ntz").alias("us"))
            assert {r.t: r.us for r in df.collect()} == {t: (datetime.fromisoformat(t) - datetime(1970, 1, 1)) // timedelta(microseconds=1) for t in texts}
            assert "decimal" not in df._jdf.queryExecution().toString().lower() and df.dtypes[1] == ("us", "bigint")
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("fn", ["increase", "rate", "irate", "difference"])
def test_pieces_change_nothing(spark, monkeypatch, fn):
    from tidemark import queries
    from tidemark.operators import execute, previous

    def run():
        b = QueryBuilder().from_measurement("events").aggregate(fn, "value")
        if fn != "difference":
            b = b.group_by_tags("event_type").group_by_time(7 * 24 * HOUR)
        return sorted(map(str, queries.named(execute.rows(queries.events(spark, "/root/testdata/sf0.001"), b.build())).collect()))

    whole = run()
    monkeypatch.setattr(previous, "ROWS", 20)
    assert run() == whole and whole


def test_files_stay_until_vacuum(engine):
    for i in range(3):
        engine.store.write_points([point(i, {"host": "a"}, v=float(i)), point(HOUR + i, {"host": "b"}, v=1.0)])
    old = engine.query_rows(QueryBuilder().from_("metrics", "autogen", "cpu").build())
    assert engine.store.compaction_plan("metrics", "autogen", "cpu", min_parts=4) == []
    assert engine.store.compact("metrics", "autogen", "cpu", shards=[0]) == [0]
    assert len(rows(engine)) == 6 == old.count()
    assert engine.store.compaction_plan("metrics", "autogen", "cpu") == [HOUR]
    assert engine.store.vacuum() == 0 and engine.store.vacuum(0) == 3 and len(rows(engine)) == 6


def test_limit_reads_first_series_alone(engine):
    engine.store.write_points([point(t, {"host": f"h{i}"}, v=float(t)) for i in range(5) for t in range(20)])
    q = QueryBuilder().from_("metrics", "autogen", "cpu").time_range(1, 18).offset(2).limit(10).build()
    got = engine.query_rows(q)
    assert [(r.host, r.ts) for r in got.collect()] == [("h0", t) for t in range(3, 13)]
    assert "FileScan" not in got._jdf.queryExecution().toString()
    assert len(rows(engine, build=lambda b: b.where(field_gt("v", 18.5)).limit(4))) == 4
