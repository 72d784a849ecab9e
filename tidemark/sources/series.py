"""Series: the distinct tag sets of a measurement, with dense ids in the order of their sorted tags."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import reduce
from itertools import accumulate
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .measurement import Measurement


def series_table(m: Measurement) -> DataFrame:
    """``(tags)``, one row for each series."""
    return m.df.select(*(f"`{t}`" for t in m.tags)).distinct()


#: Series are numbered in pieces of about so many, of which there are at most ``MAX_PIECES``.
PIECE, MAX_PIECES = 50_000, 1_000
BROADCAST = 20_000


def number(series: DataFrame, tags: list[str], start: int = 1) -> DataFrame:
    """Add ``series_id`` from ``start``, ascending with the tags.

    Series are cut at fixed tag sets, taken from a sample, into pieces that are numbered each by
    itself; the sizes of the pieces are summed up beside. A piece holds what lies between two
    constants, so counts and numbers agree however often rows are dealt anew. ``series`` should
    be cheap to compute several times (a table, or cached).
    """
    cols = [F.col(f"`{t}`") for t in tags]
    if not cols:
        return series.withColumn("series_id", F.lit(start).cast("bigint"))
    n = series.count()
    pieces = min(-(-n // PIECE), MAX_PIECES)
    if pieces <= 1:
        return series.withColumn("series_id", F.row_number().over(Window.orderBy(*cols)).cast("bigint") + F.lit(start - 1))
    drawn = series.select(*cols).sample(min(1.0, 100 * pieces / n), seed=0).orderBy(*cols).collect()
    kinds = [series.schema[t].dataType for t in tags]
    bounds = [F.struct(*(F.lit(v).cast(k).alias(f"t{i}") for i, (v, k) in enumerate(zip(r, kinds, strict=True)))) for r in (drawn[i * len(drawn) // pieces] for i in range(1, pieces) if drawn)]
    cut = series.withColumn("_p", _at_most(bounds, F.struct(*(c.alias(f"t{i}") for i, c in enumerate(cols)))) if bounds else F.lit(0))
    # A row for each piece: few enough to go through the driver whatever the number of series.
    sizes = sorted(cut.groupBy("_p").count().collect())
    before = accumulate((r["count"] for r in sizes), initial=start - 1)
    shifts = series.sparkSession.createDataFrame([(r["_p"], b) for r, b in zip(sizes, before, strict=False)], "_p int, _b bigint")
    return cut.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*cols))).join(F.broadcast(shifts), "_p").withColumn("series_id", F.col("_i") + F.col("_b")).drop("_p", "_i", "_b")


def _at_most(bounds: list[Column], key: Column) -> Column:
    """How many of the ascending bounds are not above the key, by binary search."""
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
    return F.reduce(steps, F.lit(0), lambda at, step: F.when(F.get(F.array(*bounds), at + step - 1) <= key, at + step).otherwise(at))


def same_tags(tags: Sequence[str]) -> Column:
    """Equality of tags with their copies ``_s<i>``, nulls equal."""
    return reduce(and_, (F.col(f"`{t}`").eqNullSafe(F.col(f"_s{i}")) for i, t in enumerate(tags)), F.lit(True))


def with_series_ids(m: Measurement) -> Measurement:
    """The measurement with a ``series_id`` column, by a join with its table of series.

    Stored measurements bring their table, whose ids never change; others are numbered anew,
    so their cursors hold while no series is added. A table of more than ``BROADCAST`` series is
    dealt out by tags, not sent through the driver.
    """
    if m.series:
        return m
    ids = m.ids if m.ids is not None else number(series_table(m), sorted(m.tags))
    ids = ids.select(*(F.col(f"`{t}`").alias(f"_s{i}") for i, t in enumerate(m.tags)), "series_id")
    if m.tags and ids.count() > BROADCAST:
        ids = ids.hint("shuffle_hash")
    df = m.df.join(ids, same_tags(m.tags)).drop(*(f"_s{i}" for i in range(len(m.tags))))
    return replace(m, df=df, series="series_id")
