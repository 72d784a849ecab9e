"""Statistics and cancellation of running queries."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stats:
    """Of one query: rows out, first and last timestamp, and seconds."""

    rows: int
    first_ts: int | None
    last_ts: int | None
    seconds: float


@dataclass(frozen=True)
class Operator:
    """One operator of an executed plan, the leaves last; -1 where it does not count."""

    name: str
    depth: int
    rows: int
    millis: int


@dataclass(frozen=True)
class QueryStats:
    """What a query took: shards and parts by the catalog, rows and seconds as measured."""

    rows: int = 0
    seconds: float = 0.0
    shards_scanned: int = 0
    shards_skipped: int = 0
    parts: int = 0
    errors: int = 0
    budget_errors: int = 0
    operators: tuple[Operator, ...] = ()


def operators(df: DataFrame, action: Callable[[DataFrame], object] = DataFrame.collect) -> tuple[Operator, ...]:
    """Run ``action`` on ``df`` and read the rows and times that the operators of its final plan have counted."""
    action(df)
    out: list[Operator] = []

    def walk(node, depth: int) -> None:
        name = node.nodeName()
        inner = {"AdaptiveSparkPlan": "executedPlan", "ResultQueryStage": "plan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "TableCacheQueryStage": "plan", "ReusedExchange": "child"}.get(name)
        if inner:
            return walk(getattr(node, inner)(), depth)
        counted = {}
        it = node.metrics().iterator()
        while it.hasNext():
            pair = it.next()
            counted[pair._1()] = pair._2().value()
        times = [v for k, v in counted.items() if k in ("pipelineTime", "scanTime", "sortTime", "aggTime", "buildTime")]
        out.append(Operator(name, depth, int(counted.get("numOutputRows", -1)), int(sum(times)) if times else -1))
        children = node.children().iterator()
        while children.hasNext():
            walk(children.next(), depth + 1)

    walk(df._jdf.queryExecution().executedPlan(), 0)
    return tuple(out)


def with_stats(df: DataFrame, action: Callable[[DataFrame], object]) -> tuple[object, Stats]:
    """Run ``action`` on ``df``; the figures are gathered on the way, without a second pass."""
    seen = Observation(f"query-{uuid.uuid4().hex[:8]}")
    began = time.perf_counter()
    out = action(df.observe(seen, F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last")))
    got = seen.get
    return out, Stats(got["rows"], got["first"], got["last"], time.perf_counter() - began)


@contextmanager
def cancellable(spark: SparkSession) -> Iterator[Callable[[], None]]:
    """Jobs started inside belong to one group; the function given cancels them, from any thread."""
    group = f"query-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "cancellable query", interruptOnCancel=True)
    try:
        yield lambda: spark.sparkContext.cancelJobGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
