"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target in words; a document's copies are ``target / source size``, a whole
part that every document of the source gets and a fraction in [0, 1) that is rounded at random.
Rounding pairs two fractional documents and moves words from one to the other, in a direction
drawn so that each keeps its expectation, until one fraction is 0 or 1. The words of a source
are so conserved but for one last document. Documents are paired within hash-salted chunks of
about ``CHUNK`` rows, each chunk leaves one residual, and residuals meet in a tree of fan-in
``FAN_IN`` until one per source is left. Large documents are settled first, so that what is
left at the end is small. A hot source is merely more chunks.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from math import ceil

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_words, save

CHUNK = 4096
FAN_IN = 64


def targets(sizes: DataFrame, weights: Sequence[int], cap: int = 3) -> DataFrame:
    """``sizes(source, size, ...)`` with ``s``, the source's place by code point (null last), and its ``target``.

    The sum of all sizes is shared by weight; no target is above ``cap`` times its size, the
    excess is reshared. The share of a weight only rises from round to round, so each round is
    one sum over the table, and what is capped stays so. Sources stay distributed; a row for
    each partition and the sums go to the driver.
    """
    order = F.asc_nulls_last("source")
    ranged = save(sizes.repartitionByRange(order).sortWithinPartitions(order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    parts = sorted((r["_p"], r["lo"], r["n"]) for r in ranged.groupBy("_p").agg(F.min("_i").alias("lo"), F.count("*").alias("n")).collect())
    before = accumulate((n for _, _, n in parts), initial=0)
    shifts = sizes.sparkSession.createDataFrame([(p, b - lo) for (p, lo, _), b in zip(parts, before, strict=False)], "_p int, _b long")
    table = ranged.join(F.broadcast(shifts), "_p").withColumn("s", F.col("_i") + F.col("_b")).drop("_p", "_i", "_b")
    table = table.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("s") % len(weights)).cast("int") + 1).cast("long"))
    wide = lambda x: x.cast("decimal(38,0)")
    capped, known = F.lit(False), None
    while True:
        got = table.agg(F.sum("size").alias("all"), F.sum(F.when(capped, cap * F.col("size")).otherwise(0)).alias("used"), F.sum(F.when(capped, 0).otherwise(F.col("w"))).alias("whole")).first()
        rest, whole = int(got["all"] or 0) - int(got["used"] or 0), int(got["whole"] or 0)
        if (rest, whole) == known or not whole:
            break
        known = rest, whole
        capped = wide(F.lit(rest)) * F.col("w") > wide(cap * F.col("size")) * F.lit(whole)
    share = F.lit(float(rest)) * F.col("w") / F.lit(float(max(whole, 1)))
    return table.withColumn("target", F.when(capped, (cap * F.col("size")).cast("double")).otherwise(share)).drop("w")


def pivot(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Round ``p`` in place order; conserves ``sum(size * p)``; at most one entry stays fractional."""
    size, p, u = size.tolist(), p.tolist(), u.tolist()
    held = -1
    for j, q in enumerate(p):
        if not 0.0 < q < 1.0:
            continue
        if held < 0:
            held = j
            continue
        i, a, b = held, size[held], size[j]
        up, down = min(a * (1 - p[i]), b * q), min(a * p[i], b * (1 - q))
        if u[j] * (up + down) < down:
            if a * (1 - p[i]) <= b * q:
                p[j], p[i] = q - up / b, 1.0
            else:
                p[i], p[j] = p[i] + up / a, 0.0
        elif a * p[i] <= b * (1 - q):
            p[j], p[i] = q + down / b, 0.0
        else:
            p[i], p[j] = p[i] - down / a, 1.0
        held = i if 0.0 < p[i] < 1.0 else j if 0.0 < p[j] < 1.0 else -1
    return np.asarray(p)


def _round(seed: int, level: int, last: bool):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["size", "h"], ascending=False, kind="stable").reset_index(drop=True)
        draw = np.random.Generator(np.random.Philox(key=xxhash.xxh64_intdigest(f"{seed}:{level}:{key[0]}:{key[1]}")))
        u = draw.random(len(rows) + 1)
        p = pivot(rows["size"].to_numpy(np.float64), rows["p"].to_numpy(), u)
        if last:
            p = np.where((p > 0) & (p < 1), (u[-1] < p).astype(float), p)
        return rows.assign(p=p)

    return run


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: int = 20) -> DataFrame:
    """Rows ``(doc_id, source, size, source_size, target, copies, taken)``, one per input row.

    Null text: size 0 and nothing taken. Null source: a source of its own, last in order. Null
    or repeated ids: each row is rounded by itself. Empty input: no rows. Other columns are not
    read, whatever their names. Equal input gives equal output in whatever order rows or
    partitions come: chunks and draws follow hashes of ids and texts, so rows without ids are
    spread too.
    """
    text, key = F.col(text_col), F.col(id_col)
    rows = save(docs.select(key.alias("doc_id"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"), F.xxhash64(key, text, F.lit(seed)).alias("h")))
    plan = save(targets(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), weights, cap))
    part = F.when(F.col("size") > 0, F.col("target") / F.col("size")).otherwise(0.0)
    plan = plan.select(F.col("source").alias("name"), "s", F.col("size").alias("source_size"), "target", F.floor(part).cast("int").alias("base"), (part - F.floor(part)).alias("p"), F.ceil(F.col("n") / CHUNK).alias("chunks"))
    rows = rows.join(plan, rows["source"].eqNullSafe(plan["name"])).drop("name")
    rows = rows.withColumns({"chunk": F.pmod("h", F.col("chunks")), "p": F.when(F.col("size") > 0, F.col("p")).otherwise(F.lit(0.0))}).drop("chunks")
    most = plan.agg(F.max("chunks")).first()[0]
    whole, open_ = rows.where("p = 0"), rows.where("p > 0")
    parts, left, level = [whole.drop("h", "chunk")], most or 1, 0
    while True:
        last = left <= 1
        got = save(open_.groupBy("s", "chunk").applyInPandas(_round(seed, level, last), open_.schema))
        parts.append(got.where("p = 0 or p = 1").drop("h", "chunk"))
        if last:
            break
        open_ = got.where("p > 0 and p < 1").withColumn("chunk", F.floor(F.col("chunk") / FAN_IN))
        left, level = ceil(left / FAN_IN), level + 1
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    copies = F.col("base") + F.col("p").cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
