"""Helpers shared by the training-data operators: shared-folder tables, components, word rules."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Functions travel to executors by value, so executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__package__])

#: A word is a maximal run of anything but ASCII blanks.
BLANKS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a local session without one gets a temporary folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table of ``save``."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def save(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran, never the steps before.
    The path is appended to ``keep`` so that loops can delete what they have replaced; all
    tables go when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if keep is not None:
        keep.append(path)
    atexit.register(_forget, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        drop_path(spark, path)


def n_words(text: Column) -> Column:
    """Words of a text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def map_rows(df: DataFrame, fn, schema: str | T.StructType, setup: Callable | None = None) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes: long texts come a few at a time.

    ``fn`` takes a dict of column -> Python list and returns a dict of column -> list or array.
    With ``setup`` it also takes what that made, once for each task.
    """
    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = () if setup is None else (setup(),)
        for batch in batches:
            for at, n in _pieces(batch):
                got = fn(batch.slice(at, n).to_pydict(), *own)
                yield pa.RecordBatch.from_arrays([x if isinstance(x := got[f.name], pa.Array) else pa.array(x, f.type, from_pandas=False) for f in arrow], schema=arrow)

    return df.mapInArrow(run, out)


def _pieces(batch: pa.RecordBatch, rows: int = 512, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Slices of at most ``rows`` rows and, beyond one row, of about ``most`` bytes of text."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) or pa.types.is_binary(c.type):
            sizes += np.asarray(pc.fill_null(pc.binary_length(c), 0), np.int64)
    at, used = 0, 0
    for i, s in enumerate(sizes.tolist()):
        if i > at and (used + s > most or i - at >= rows):
            yield at, i - at
            at, used = i, 0
        used += s
    if at < batch.num_rows:
        yield at, batch.num_rows - at


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: rows ``(node, component)`` for linked nodes.

    The component is the smallest node reachable. Each round orders the nodes, and every node
    gives way to the first one among its neighbours and itself. Links between those are the next
    round's. The first round puts nodes of many links first, which ends stars at once; the others
    go by a new hash of the ids each: of linked nodes at most 3/4 remain on average, whatever the
    links and ids, and the last one of the order always goes, so rounds end without a limit.
    Rounds write to the shared folder. Self links and nulls are ignored, repeats do not matter.
    """
    spark, keep, steps = edges.sparkSession, [], []
    both = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = save(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), keep)
    while both.limit(1).count():
        # For one round the hash is a bijection of the id: no ties.
        order = lambda c: F.xxhash64(F.lit(len(steps)), F.col(c))  # noqa: B023, E731
        ranked = both.withColumn("many", F.lit(0))
        if not steps:
            degree = save(both.groupBy(F.col("a").alias("b")).agg((-F.count("*")).alias("many")))
            ranked = both.join(degree, "b")
        first = ranked.groupBy("a").agg(F.min(F.struct("many", order("b").alias("h"), "b")).alias("x"), F.count("*").alias("n"))
        own = F.struct((-F.col("n") if not steps else F.lit(0)).cast(first.schema["x"].dataType["many"].dataType).alias("many"), order("a").alias("h"), F.col("a").alias("b"))
        step = save(first.select(F.col("a").alias("node"), F.least(own, "x")["b"].alias("to")), keep)
        steps.append(step)
        side = lambda c: step.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}"))  # noqa: B023, E731
        left = both.join(side("a"), "a").join(side("b"), "b").where("to_a <> to_b")
        both = save(left.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")).distinct(), keep)
        drop_path(spark, keep.pop(-3))
    if not steps:
        return both.select(F.col("a").alias("node"), F.col("b").alias("component"))
    label = steps.pop()
    while steps:
        on = label.select(F.col("node").alias("to"), F.col("to").alias("on"))
        label = save(steps.pop().join(on, "to", "left").select("node", F.coalesce("on", "to").alias("to")), keep)
    low = save(label.groupBy("to").agg(F.min("node").alias("component")), keep)
    out = save(label.join(low, "to").select("node", "component"))
    for path in keep:
        drop_path(spark, path)
    return out
