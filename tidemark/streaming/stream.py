"""Rollups on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import aggregates
from ..operators import predicates
from ..sources.measurement import Measurement
from .downsample import Policy, floor_to, normalized, rollup


def tumbling(stream: DataFrame, *, ts: str, tags: list[str], field: str, functions: list[str], window: str, watermark: str) -> DataFrame:
    """Windowed aggregates of an unbounded stream; in append mode a window comes out once the watermark has passed it.

    Functions are those that need no sample before (no counters); ``ts`` is a timestamp column.
    Rows later than the watermark are dropped, which is what ``upsert_rollup`` is there to avoid.
    """
    v, at = F.col(field), F.col(ts)
    order = F.struct(at, *(F.col(t) for t in sorted(tags)))
    nanos = F.unix_micros(at.cast("timestamp")) * 1000
    return stream.withWatermark(ts, watermark).groupBy(F.window(ts, window), *(F.coalesce(F.col(t), F.lit("")).alias(t) for t in tags)).agg(*(aggregates.plain(f, v, nanos, order).alias(f"{f}_{field}") for f in functions))


def upsert_rollup(downsampler, name: str, source: DataFrame, *, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write a stream of points to a policy's source and recompute the windows they touch, late ones too.

    ``source`` has the source's tag columns, ``ts`` (bigint, nanoseconds) and fields. Each
    micro-batch is stored, then every window in the batch's span that has a new point is
    rolled up again from the store and written over the old target points.
    """
    p = downsampler.get(name)

    def each(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            span = batch.agg(F.min("ts"), F.max("ts")).first()
            if span[0] is None:
                return
            store = downsampler.store
            known = store.list_fields(p.source_database, p.source_measurement) if p.source_database in store.list_databases() else {}
            fields = [c for c, k in batch.dtypes if c != "ts" and (c in known or k != "string" or c in {f.field for f in p.functions})]
            tags = [c for c in batch.columns if c != "ts" and c not in fields]
            store.write(batch, *p.source, tags=tags)
            m = store.read(*p.source)
            touched = batch.select((F.col("ts") - F.pmod("ts", F.lit(p.interval))).alias("ts")).distinct()
            out = rollup(m, p, floor_to(span[0], p.interval), floor_to(span[1], p.interval) + p.interval).join(touched, "ts", "left_semi")
            store.write(out, *p.target, tags=[*p.group_by_tags, p.policy_tag])
        finally:
            batch.unpersist()

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def stream_rollup(m: Measurement, policy: Policy) -> DataFrame:
    """A policy's whole rollup as one batch DataFrame, the value a finished stream converges to."""
    return rollup(m, normalized(policy))


def filtered_stream(stream: DataFrame, expr, tags: list[str], fields: dict[str, str]) -> DataFrame:
    """A query's boolean tree on a stream of points (``ts`` in nanoseconds)."""
    from ..plans.model import Query

    return stream.where(predicates.tree(expr, Query(), frozenset(tags), fields))
