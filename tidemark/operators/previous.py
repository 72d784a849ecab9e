"""The sample before, in each group, without putting a whole group into one task."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Groups with more samples than this are cut into pieces of time with about so many.
ROWS = 1_000_000


def piece_of(df: DataFrame, keys: list[str], most: int) -> int:
    """The length of time, in nanoseconds, in which the largest group has about ``most`` samples; 0 if no group has more.

    Counting groups combines before the shuffle and reads keys and timestamps only.
    """
    sizes = df.groupBy(*(f"`{k}`" for k in keys)).agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    top = sizes.agg(F.max(F.struct("n", "a", "b")).alias("x")).first()["x"]
    return 0 if top is None or top["n"] <= most else max(1, (top["b"] - top["a"] + 1) * most // top["n"])


def with_previous(df: DataFrame, keys: list[str], fields: list[str], order: Column, *, rows: int | None = None) -> DataFrame:
    """Add ``_p_<field>``, a struct (v, t) of the last earlier sample of the field in its group.

    Groups of up to ``rows`` samples are ordered whole. Else groups are cut into pieces of time;
    each piece is ordered by itself, and its first samples take the last one of the pieces
    before, of which there is one summary row each. So no task holds a hot group, be it a
    series, a tag or one window of a tag; only samples of one instant are never parted.
    """
    df, parts = df.withColumn("_o", order), list(keys)
    piece = piece_of(df, keys, ROWS if rows is None else rows)
    if piece:
        df = df.withColumn("_piece", F.floor(F.col("ts") / F.lit(piece)).cast("bigint"))
        parts.append("_piece")
    w = W.partitionBy(*(f"`{k}`" for k in parts)).orderBy("_o").rowsBetween(W.unboundedPreceding, -1)
    sample = lambda f: F.when(F.col(f"`{f}`").isNotNull(), F.struct(F.col(f"`{f}`").alias("v"), F.col("ts").alias("t")))
    out = df.withColumns({f"_p_{f}": F.last(sample(f), ignorenulls=True).over(w) for f in fields})
    if not piece:
        return out
    ends = df.groupBy(*(f"`{k}`" for k in parts)).agg(*(F.max_by(sample(f), F.when(F.col(f"`{f}`").isNotNull(), F.col("_o"))).alias(f"_e_{f}") for f in fields))
    chain = W.partitionBy(*(f"`{k}`" for k in keys)).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(parts)), *(F.last(f"_e_{f}", ignorenulls=True).over(chain).alias(f"_b_{f}") for f in fields))
    same = reduce(and_, (F.col(f"`{k}`").eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(parts)))
    out = out.join(ends, same)
    return out.withColumns({f"_p_{f}": F.coalesce(f"_p_{f}", f"_b_{f}") for f in fields}).drop(*(f"_k{i}" for i in range(len(parts))), *(f"_b_{f}" for f in fields))
