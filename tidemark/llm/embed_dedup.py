"""Near-duplicate embeddings by collision-counting projections.

Vectors are projected on many random lines. On each line a pair collides when one lies in the
window centred on the other; near pairs collide on most lines, others on few. Pairs whose
collision count passes a limit calibrated on the binomial tail at the threshold are verified by
cosine in double precision.

Vectors meet in cells: in each of ``T`` tables a cell is a piece of ``g`` further lines jointly,
cut at random offsets, so that a near pair shares a cell in some table. A label of ``N`` vectors
takes the ``g`` of least work and the ``T`` that misses a pair at the threshold with probability
``MISS`` at most: few vectors make one cell (nothing is missed), many make small cells, and the
work grows like ``N**1.13``. A cell is sorted on its first line and windows slide over it; large
cells fall into pairs of blocks, a task each. A pair counts in the first table that brings it
together. Tasks send back link counts and one component root for each vector, never the pairs.
Equal vectors are collapsed before.
"""

from __future__ import annotations

from math import ceil, comb, erf, exp, log, log1p, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_rows, save
from .minhash import mixed

LINES = 16
#: Half a window, in standard deviations of the projected distance of a pair at the threshold.
REACH = 4.2
#: Chance that a pair at the threshold fails the count, and that no table brings it together.
MISS = 1e-6
BLOCK = 4096
#: Side of a cell, in the same unit as ``REACH``, and the most lines of a cell.
SIDE, MOST_JOINT = 5.0, 24
#: Sending a vector to a table costs as much as comparing so many pairs.
MOVE = 1000


def least_collisions(lines: int, reach: float, miss: float) -> int:
    """The largest count that a pair at the threshold misses with probability ``miss`` at most."""
    p, tail = erf(reach / sqrt(2)), 0.0
    for k in range(lines + 1):
        tail += comb(lines, k) * p**k * (1 - p) ** (lines - k)
        if tail > miss:
            return k
    return lines


def same_cell(side: float) -> float:
    """Chance that two points at a normal distance fall into one piece of ``side`` deviations at a random offset."""
    return erf(side / sqrt(2)) - sqrt(2 / pi) / side * (1 - exp(-side * side / 2))


def tables_for(joint: int) -> int:
    """Tables of ``joint`` lines that bring a pair at the threshold together but for a chance of ``MISS``."""
    return 1 if not joint else ceil(log(MISS) / log1p(-(same_cell(SIDE) ** joint)))


def joint_lines(n: int, chord: float) -> int:
    """The number of joint lines with least work for ``n`` vectors whose pairs lie as random directions do."""
    far = same_cell(SIDE * chord / sqrt(2))
    return min(range(MOST_JOINT + 1), key=lambda g: tables_for(g) * (MOVE * n + n * n * far**g / 2) - (g == 0) * MOVE * n)


def lines_of(dim: int, lines: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.Philox(key=[seed, dim])).standard_normal((dim, lines))


def cells_of(unit: np.ndarray, joint: int, chord: float, seed: int) -> np.ndarray:
    """``[vector, table, line]``: the pieces of each table's lines that unit vectors fall on."""
    t, dim = tables_for(joint), unit.shape[1]
    offsets = np.random.Generator(np.random.Philox(key=[seed + 2, joint])).random(t * joint)
    return np.floor(unit @ lines_of(dim, t * joint, seed + 1) / (SIDE * chord) + offsets).astype(np.int32).reshape(len(unit), t, joint)


def near_pairs(unit: np.ndarray, left: np.ndarray, right: np.ndarray | None, *, lines: int, half: float, limit: int, threshold: float, seed: int):
    """Pairs of rows (left, right; or any two of left) whose windows collide on ``limit`` lines at least and whose cosine is ``threshold`` at least, in parts."""
    on = (unit @ lines_of(unit.shape[1], lines, seed)).astype(np.float32)
    half = np.float32(half)
    left = left[np.argsort(on[left, 0], kind="stable")]
    other = left if right is None else right[np.argsort(on[right, 0], kind="stable")]
    first, lo0 = on[other, 0], on[left, 0]
    tile = 128
    # Pairs that miss the window of the sorted line have one miss already: they count if a wider window holds them.
    spare = lines - limit
    wide = half * np.float32(1.2) if spare else half
    for at in range(0, len(left), tile):
        rows = left[at : at + tile]
        begin = at if right is None else int(np.searchsorted(first, lo0[at] - wide))
        end = int(np.searchsorted(first, lo0[min(at + tile, len(left)) - 1] + wide, "right"))
        cols = other[begin:end]
        if not len(cols):
            continue
        x, y = on[rows], on[cols]
        miss = np.zeros((len(rows), len(cols)), np.int8)
        dense = min(6, lines)
        for j in range(dense):
            miss += np.abs(x[:, j, None] - y[None, :, j]) > half
        if right is None:
            miss[np.arange(len(cols))[None, :] <= np.arange(len(rows))[:, None]] = lines + 1
        a, b = np.nonzero(miss <= spare)
        miss = miss[a, b]
        for j in range(dense, lines):
            miss += np.abs(x[a, j] - y[b, j]) > half
            keep = miss <= spare
            if not keep.all():
                a, b, miss = a[keep], b[keep], miss[keep]
        a, b = rows[a], cols[b]
        for k in range(0, len(a), 65536):
            p, q = a[k : k + 65536], b[k : k + 65536]
            ok = np.einsum("ij,ij->i", unit[p], unit[q]) >= threshold
            yield p[ok], q[ok]


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, lines: int = LINES, seed: int = 6, block: int = BLOCK, joint: int | None = None) -> DataFrame:
    """Rows ``(vec_id, n_links, component_id, kept)``, one per input row.

    Vectors are compared when labels are equal and not null and dimensions are equal.
    ``n_links`` counts the other rows linked directly, copies included. Null, zero or
    non-finite vectors and null labels link with nothing. Vectors with null ids link with the
    others, but name no component. Repeated rows link with each other. Empty input: no rows.
    Other columns are not read. ``joint`` sets the lines of a cell, by itself it follows from
    the size of the label.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    chord, limit = sqrt(2 - 2 * threshold), least_collisions(lines, REACH, MISS)

    def prepare(rows: dict) -> dict:
        out = {"vec_id": rows["vec_id"], "label": rows["label"], "digest": [], "dim": [], "unit": []}
        for v, label in zip(rows["v"], rows["label"], strict=True):
            x = np.array([np.nan if e is None else e for e in v or ()], np.float64)
            big = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
            if label is None or not big > 0:
                for c in ("digest", "dim", "unit"):
                    out[c].append(None)
                continue
            unit = x / big
            unit /= np.sqrt(unit @ unit)
            out["digest"].append(xxhash.xxh3_128_digest(x.tobytes()))
            out["dim"].append(len(x))
            out["unit"].append(unit.tobytes())
        return out

    drawn = save(map_rows(rows, prepare, "vec_id long, label string, digest binary, dim int, unit binary"))
    copy = ["label", "dim", "digest"]
    one = save(drawn.where("digest is not null").groupBy(*copy).agg(F.count("*").alias("n"), F.min("vec_id").alias("rep"), F.first("unit").alias("unit")).withColumn("node", F.monotonically_increasing_id()))
    sizes = one.groupBy("label", "dim").agg(F.count("*").alias("size"))

    def plan(rows: dict) -> dict:
        found = {n: joint_lines(n, chord) if joint is None else joint for n in set(rows["size"])}
        return {"label": rows["label"], "dim": rows["dim"], "joint": [found[n] for n in rows["size"]]}

    plans = save(map_rows(sizes, plan, "label string, dim int, joint int"))

    def spread(rows: dict) -> dict:
        out: list = [None] * len(rows["unit"])
        groups: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(rows["dim"], rows["joint"], strict=True)):
            groups.setdefault(key, []).append(i)
        for (_, g), at in groups.items():
            cells = cells_of(np.frombuffer(b"".join(rows["unit"][i] for i in at), np.float64).reshape(len(at), -1), g, chord, seed)
            keys = np.zeros(cells.shape[:2], np.uint64)
            for j in range(g):
                keys = mixed(keys ^ cells[:, :, j].astype(np.int64).view(np.uint64))
            for i, k in zip(at, keys.view(np.int64).tolist(), strict=True):
                out[i] = k
        return {c: rows[c] for c in ("label", "dim", "node", "n", "unit", "joint")} | {"keys": out}

    placed = save(map_rows(one.join(plans, ["label", "dim"]), spread, "label string, dim int, node long, n long, unit binary, joint int, keys array<long>"))
    cell = ["label", "dim", "t", "key"]
    where = placed.select("label", "dim", F.posexplode("keys").alias("t", "key"))
    cells = save(where.groupBy(*cell).agg(F.count("*").alias("size")).where("size > 1").withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).drop("size"))
    near = placed.select("label", "dim", "node", "n", "unit", "joint", F.posexplode("keys").alias("t", "key")).join(cells, cell)
    near = near.withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    near = near.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")}).drop("blocks", "other")

    def compare(table: pa.Table) -> pa.Table:
        unit = np.frombuffer(b"".join(table["unit"].to_pylist()), np.float64).reshape(len(table), -1)
        n, mine = (table[c].to_numpy() for c in ("n", "mine"))
        t, g, lo, hi = (table[c][0].as_py() for c in ("t", "joint", "lo", "hi"))
        left, right = np.flatnonzero(mine == lo), np.flatnonzero(mine == hi) if lo != hi else None
        before = cells_of(unit, g, chord, seed)[:, :t] if t else None
        links, xs, ys = np.zeros(len(n), np.int64), [], []
        for x, y in near_pairs(unit, left, right, lines=lines, half=REACH * chord, limit=limit, threshold=threshold, seed=seed):
            if t and len(x):
                new = ~(before[x] == before[y]).all(axis=2).any(axis=1)
                x, y = x[new], y[new]
            np.add.at(links, x, n[y])
            np.add.at(links, y, n[x])
            xs.append(x)
            ys.append(y)
        x, y = (np.concatenate(v) if v else np.empty(0, np.int64) for v in (xs, ys))
        root = np.arange(len(n))
        while True:
            low = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        got = np.flatnonzero(links)
        node = table["node"].to_numpy()
        return pa.table({"node": node[got], "links": links[got], "root": node[root[got]]})

    found = save(near.groupBy(*cell, "lo", "hi").applyInArrow(compare, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = components(found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    each = one.select(*copy, "n", "rep", "node").join(links, "node", "left").join(reached, "node", "left")
    each = save(each.select(*copy, "rep", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    # Written before the joins, so that a large component or a common vector can be split there.
    low = save(each.groupBy("component").agg(F.min("rep").alias("low")))
    each = save(each.join(low, "component").select(*copy, "n_links", "low"))
    out = drawn.select("vec_id", *copy).join(each, copy, "left").withColumn("component_id", F.coalesce("low", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
