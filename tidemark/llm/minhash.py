"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A shingle falls on a slot of ``[0, D)``. Two permutations make the whole signature: ``sigma``
scatters the slots once, and coordinate ``k`` is the least ``pi[(sigma(slot) - k) mod D]``, the
same ``pi`` circularly shifted by ``k``. For one shingle all coordinates are so one contiguous
piece of ``pi``.

Steps: documents with equal shingle sets collapse to the least id; bands of signatures make
buckets; each member of a bucket is checked against the bucket's hubs, its least id and its
most popular member, the one that meets most others over all its buckets and so is likely what
the others were copied from; then, in buckets that still span several components, members of
different components are compared in blocks, by signature and then by full set, each pair in
the first of its buckets, so no pair that could join two components goes unseen. A block sends
back only links that join components, however many pairs it has to try. Every link is confirmed
on the full shingle sets.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, map_rows, save

SLOTS = 1 << 20
COORDS = 128
ROWS = 4
#: Signatures agreeing on fewer coordinates than this share are not verified. A pair of
#: similarity 0.8 is five standard deviations above it.
LEAST = 0.62
BLOCK = 256
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """64-bit hashes of words, remembered while they are few."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, k: int, words: Words) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; A-Z lower-cased, words cut at ASCII blanks.

    Fewer than ``k`` words make one shingle, no word makes none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = min(k, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for j in range(n):
        out = out * _MIX + h[j : len(h) - n + 1 + j]
    return np.unique(mixed(out))


class Circulant:
    """Signatures from two permutations, the second circularly shifted."""

    def __init__(self, seed: int):
        draw = np.random.Generator(np.random.Philox(key=seed))
        self.sigma = draw.permutation(SLOTS)
        pi = draw.permutation(SLOTS).astype(np.uint32)
        self.shifts = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[: COORDS - 1]]), COORDS)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """The low 16 bits of each coordinate's least value."""
        start = (self.sigma[(hashes % np.uint64(SLOTS)).astype(np.int64)] - (COORDS - 1)) % SLOTS
        least = np.full(COORDS, SLOTS, np.uint32)
        for at in range(0, len(start), 4096):
            np.minimum(least, self.shifts[start[at : at + 4096]].min(axis=0), out=least)
        return least.astype(np.uint16)


def _keys(values: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Bucket keys of a band's coordinates, taken as one 64-bit value."""
    return mixed(values + _MIX * (band.astype(np.uint64) + np.uint64(1))).view(np.int64)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets, neither empty, have ``100 * intersection >= percent * union``."""
    both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets have ``100 * intersection >= percent * union``."""

    def check(rows: dict) -> dict:
        a, b = [], []
        for i, j, x, y in zip(rows["a"], rows["b"], rows["x"], rows["y"], strict=True):
            if linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent):
                a.append(i)
                b.append(j)
        return {"a": a, "b": b}

    with_x = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("x")), "a")
    return save(map_rows(with_x.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("y")), "b"), check, "a long, b long"))


def _alike(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes allow a link and whose signatures agree enough."""

    def check(rows: dict) -> dict:
        x, y = (np.frombuffer(b"".join(rows[c]), np.uint16).reshape(-1, COORDS) for c in ("x", "y"))
        ok = ((x == y).mean(axis=1) >= LEAST).tolist()
        return {c: [v for v, k in zip(rows[c], ok, strict=True) if k] for c in ("a", "b")}

    side = lambda i, s, n: reps.select(F.col("doc_id").alias(i), F.col("sig").alias(s), F.col("n").alias(n))
    both = pairs.join(side("a", "x", "nx"), "a").join(side("b", "y", "ny"), "b")
    return map_rows(both.where(100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")).select("a", "b", "x", "y"), check, "a long, b long")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, seed: int = 8) -> DataFrame:
    """Rows ``(doc_id, n_shingles, component_id, kept)``, one per input row.

    ``component_id`` is the least id reachable over links of Jaccard similarity
    ``>= percent / 100``, ``kept`` says that it is the row's own. Null, empty or blank text: no
    shingles, linked with nothing. A null id links to others but names no component, unless
    its row is a copy of one with an id. Rows that repeat an id are judged one by one. Empty
    input: no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def sketch(rows: dict, own: tuple[Words, Circulant]) -> dict:
        (words, maker), n, digest, sig = own, [], [], []
        for text in rows["text"]:
            s = shingles(text, k, words)
            n.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sig.append(maker.signature(s).tobytes() if len(s) else None)
        return {"doc_id": rows["doc_id"], "n": n, "digest": digest, "sig": sig}

    drawn = save(map_rows(rows, sketch, "doc_id long, n long, digest binary, sig binary", lambda: (Words(), Circulant(seed))))
    named = drawn.where("doc_id is not null and digest is not null")
    reps = save(named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(named, ["digest", "doc_id"]).dropDuplicates(["digest"]).select("digest", "doc_id", "n", "sig"))

    def bands(rows: dict) -> dict:
        keys = np.frombuffer(b"".join(rows["sig"]), np.uint64).reshape(-1, COORDS // ROWS)
        keys = _keys(keys, np.arange(COORDS // ROWS))
        return {"key": keys.ravel(), "doc_id": np.repeat(np.asarray(rows["doc_id"], np.int64), COORDS // ROWS)}

    spread = map_rows(reps.select("doc_id", "sig"), bands, "key long, doc_id long")
    buckets = save(spread.groupBy("key").agg(F.count("*").alias("size"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high"))
    members = save(spread.join(buckets, "key").select("key", "doc_id", "size", "low"))
    met = members.groupBy("doc_id").agg(F.sum("size").alias("met"))
    # Written first, so that the join with the members can split a hot bucket.
    hubs = members.where("size > 2").join(met, "doc_id").groupBy("key").agg(F.max_by("doc_id", F.struct("met", -F.col("doc_id"))).alias("hub"))
    members = save(members.join(save(hubs), "key", "left").withColumn("hub", F.coalesce("hub", "low")))
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    stars = members.select(F.explode(F.array(pair("doc_id", "low"), pair("doc_id", "hub"))).alias("p")).select("p.*").where("a < b").distinct()
    stars = save(_alike(stars, reps, percent))
    wanted = reps.join(members.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("digest").alias("own"))

    def full(rows: dict, words: Words) -> dict:
        ids, sets = [], []
        for i, text, own in zip(rows["doc_id"], rows["text"], rows["own"], strict=True):
            s = shingles(text, k, words).tobytes()
            if xxhash.xxh3_128_digest(s) == own:
                ids.append(i)
                sets.append(s)
        return {"doc_id": ids, "set": sets}

    sets = save(map_rows(rows.join(wanted.hint("shuffle_hash"), "doc_id"), full, "doc_id long, set binary", Words).dropDuplicates(["doc_id"]))
    links = _verified(stars, sets, percent)
    found = components(links)
    more = _across(members, reps, sets, found, percent)
    if more.limit(1).count():
        found = components(links.unionByName(more))
    reached = reps.select("digest", F.col("doc_id").alias("node")).join(found, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = drawn.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(reached, "digest", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _across(members: DataFrame, reps: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links between bucket members of different components that the hubs have not tried; of those that join the same two, one for each block at least.

    Of two members of different components one at least is outside the bucket's largest one. So
    the outsiders are compared with all members, not all with all: both sides fall into blocks,
    and each pair of blocks is a task's work, whatever the bucket's size.
    """
    comp = members.where("size > 2").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    counts = comp.groupBy("key", "component").agg(F.count("*").alias("n"))
    open_ = counts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("size"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    open_ = save(open_.select("key", F.col("top.component").alias("main"), blocks(F.col("size") - F.col("top.n")).alias("outer"), blocks(F.col("size")).alias("whole")))
    comp = comp.where("doc_id <> low and doc_id <> hub").select("key", "doc_id", "component").join(open_, "key")
    comp = comp.withColumns({"out": F.col("component") != F.col("main"), "lo": F.pmod(F.xxhash64("doc_id"), "outer").cast("int"), "hi": F.pmod(F.xxhash64("doc_id"), "whole").cast("int")})
    comp = save(comp.join(reps.select("doc_id", "n", "sig"), "doc_id"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    kept = ["key", "doc_id", "component", "out", "n", "sig"]
    outside = comp.where("out").select(*kept, "lo", upto("whole").alias("hi"), F.lit(True).alias("left"))
    dealt = outside.unionByName(comp.select(*kept, upto("outer").alias("lo"), "hi", F.lit(False).alias("left")))

    def compare(table, verify: bool):
        import pyarrow as pa

        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, COORDS)
        rows = sig.view(np.uint64)
        doc, comp, n, out, side = (table[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "component", "n", "out", "left"))
        lo, hi, key = (table[c][0].as_py() for c in ("lo", "hi", "key"))
        full = [np.frombuffer(x, np.uint64) for x in table["set"].to_pylist()] if verify else None
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        comp, links, likely = comp.copy(), [], np.zeros(len(doc), bool)
        for i in left.tolist():
            # Two outsiders meet twice; the lesser one's turn counts.
            c = right[(comp[right] != comp[i]) & (~out[right] | (doc[right] > doc[i])) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))]
            c = c[(sig[c] == sig[i]).mean(axis=1) >= LEAST]
            first = (rows[c] == rows[i]).argmax(axis=1)
            c = c[_keys(rows[i][first], first) == key]
            if not verify:
                likely[c] = True
                likely[i] |= len(c) > 0
                continue
            for j in c.tolist():
                if comp[i] != comp[j] and linked(full[i], full[j], percent):
                    comp[comp == comp[j]] = comp[i]
                    links.append((min(doc[i], doc[j]), max(doc[i], doc[j])))
        if not verify:
            some = int(likely.sum())
            return pa.table({"key": pa.array([key] * some, pa.int64()), "lo": pa.array([lo] * some, pa.int32()), "hi": pa.array([hi] * some, pa.int32()), "left": side[likely], "doc_id": doc[likely]})
        return pa.table({c: pa.array([x[k] for x in links], pa.int64()) for k, c in enumerate("ab")})

    # By signatures alone first; full sets go only to blocks where they can meet a likely partner.
    likely = save(dealt.groupBy("key", "lo", "hi").applyInArrow(lambda t: compare(t, False), "key long, lo int, hi int, left boolean, doc_id long"))
    dealt = dealt.join(likely, ["key", "lo", "hi", "left", "doc_id"]).join(sets, "doc_id")
    return save(dealt.groupBy("key", "lo", "hi").applyInArrow(lambda t: compare(t, True), "a long, b long"))
