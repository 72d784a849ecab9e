"""Headline queries, timed; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores (default 8).
Each query runs once to warm up and then ``BENCH_REPEATS`` times; the least time counts. The
``scale_*`` queries run on generated points in a store: 10 million points of 100 series, one a
second for each. ``scale_downsample_10m`` reads them from the store, rolls them up to one-minute
windows with five functions and writes the target; ``scale_rollup_query`` reads that target;
``scale_compact_10m`` rewrites two parts of 10 million points in all.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.engine import Engine
from tidemark.operators import execute
from tidemark.plans.builder import QueryBuilder
from tidemark.sources.measurement import Measurement
from tidemark.streaming.downsample import MINUTE, Function, Policy, normalized

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))
HEADLINE = ("flagship", "scan_time_range", "order_desc_topk", "filter_and", "agg_avg_window_1d", "group_tags_window_increase", "group_tags_rate", "agg_mode_series", "group_tags_median", "transform_difference", "lineitem_group_sum", "lineitem_window_increase", "lww_per_field", "delete_tombstones", "downsample_1h", "downsample_1d_range")


def points(spark: SparkSession, n: int = 10_000_000, series: int = 100) -> Measurement:
    at = F.floor(F.col("id") / series).cast("bigint") * 1_000_000_000
    df = spark.range(0, n, 1, 4 * CPUS).select(F.concat(F.lit("h"), (F.col("id") % series).cast("string")).alias("host"), at.alias("ts"), (F.col("id") % 100).cast("double").alias("usage"))
    return Measurement(df, "cpu", ("host",), {"usage": "double"})


def timed(run: Callable[[], DataFrame], repeats: int) -> float:
    best = float("inf")
    for i in range(repeats + 1):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        if i:
            best = min(best, time.perf_counter() - began)
    return round(best, 3)


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", str(CPUS)).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found = {name: timed(lambda n=name: queries.RUNS[n](spark, SF), REPEATS) for name in HEADLINE}

    root = tempfile.mkdtemp(prefix="bench-")
    try:
        p = normalized(Policy("p", "d", "a", "cpu", "d", "b", "cpu_1m", MINUTE, tuple(Function(f, "usage") for f in ("avg", "min", "max", "count", "last")), ("host",)))
        engine = Engine(spark, f"{root}/store", shard=24 * 60 * MINUTE)
        began = time.perf_counter()
        engine.store.write(points(spark).df, "d", "a", "cpu", tags=["host"])
        found["scale_write_10m"] = round(time.perf_counter() - began, 3)
        q = QueryBuilder().from_("d", "a", "cpu").time_range(3600 * 10**9, 7200 * 10**9).limit(2000).build()
        found["scale_range_limit_2000"] = timed(lambda: engine.query_rows(q), REPEATS)
        engine.downsample.create(p)
        for _ in range(2):  # the first run warms up
            engine.downsample.reset("p", allow_replace=True)
            began = time.perf_counter()
            engine.downsample.run_range("p", 0, 100_020 * 10**9)
            found["scale_downsample_10m"] = round(time.perf_counter() - began, 3)
        rolled = QueryBuilder().from_("d", "b", "cpu_1m").time_range(3600 * 10**9, 7200 * 10**9).limit(2000).build()
        found["scale_rollup_query"] = timed(lambda: engine.query_rows(rolled), REPEATS)
        for half in (0, 1):
            engine.store.write(points(spark).df.where(F.col("ts") / 10**9 % 2 == half), "d", "two", "cpu", tags=["host"])
        began = time.perf_counter()
        engine.store.compact("d", "two", "cpu")
        found["scale_compact_10m"] = round(time.perf_counter() - began, 3)
        whole = QueryBuilder().from_measurement("cpu").aggregate("avg", "usage").group_by_tags("host").group_by_time(60 * MINUTE).build()
        found["scale_window_avg_10m"] = timed(lambda: execute.rows(points(spark), whole), 1)
    finally:
        shutil.rmtree(root, ignore_errors=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
