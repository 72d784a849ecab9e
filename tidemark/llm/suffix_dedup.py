"""Repeated byte strings by a hash-compared suffix sort.

A byte goes when a string of ``LENGTH`` bytes over it also starts anywhere else. Sorting every
suffix of a corpus is more than is needed:

1. Every window of ``LENGTH`` bytes picks the least-hashed of its ``GRAM``-byte grams. Equal
   windows pick the same gram at the same offset, so a window can repeat only where its gram
   does. A gram answers for a run of neighbouring windows; their union is its context.
2. Grams that occur once are done with. Of the others, contexts that occur twice are repeated
   throughout; contexts are the same when their cryptographic digests are (BLAKE2b, 128 bits).
3. For the rest the suffixes that start at their windows are sorted: prefix polynomial hashes
   and a binary search find how far two suffixes agree, so that a comparison takes
   ``log2(LENGTH)`` steps; a mergesort runs over all groups of a batch at once; neighbours that
   agree over ``LENGTH`` bytes repeat. Their bytes are compared, and a group with a collision is
   sorted by its bytes.
   A gram with very many distinct contexts is divided first: its windows go into blocks by the
   gram's offset in them, and as all windows of a block share more bytes than the gram, they are
   parted by a hash of these. Contexts cut to a block are settled as in step 2 or divided again;
   in a block of one offset the shared bytes are the window, so nothing is left to divide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, save
from .minhash import mixed

LENGTH = 400
GRAM = 200
#: A gram with more distinct contexts than this is divided, each time into so many blocks of offsets.
CROWD = 512
BLOCKS = 6
#: So many windows are sorted at a time.
WINDOWS = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class Powers:
    """Powers of the base and of its inverse modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 1 << 16, 2 * len(self.up))
            self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, b, np.uint64))]) for b in (_BASE, _INVERSE))


def prefix_hashes(data: np.ndarray, powers: Powers) -> np.ndarray:
    """``h[i]`` is the sum of ``(byte + 1) * base**position`` over the first ``i`` bytes."""
    powers.need(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.up[: len(data)], out=out[1:])
    return out


def grams(data: np.ndarray, powers: Powers, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Picked grams: position, first and last window start that picked it, hash."""
    n = len(data) - length + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    h = prefix_hashes(data, powers)
    g = mixed((h[gram:] - h[:-gram]) * powers.down[: len(h) - gram])
    # The least of a window is the leftmost least of the upper hash halves.
    c = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    w = length - gram + 1
    rows = -(-len(c) // w)
    pad = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    pad[: len(c)] = c
    pad = pad.reshape(rows, w)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    pick = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(np.diff(pick)) + 1])
    last = np.concatenate([first[1:] - 1, [n - 1]])
    return pick[first], first, last, g[pick[first]]


def suffix_sort(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int, powers: Powers, h: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes by group and then by their first ``length`` bytes.

    ``group`` ascends; ``h`` are the prefix hashes of ``data``, if they are known. Returns the
    order, and for each place whether the suffix there equals the one before it (of the same
    group) in all ``length`` bytes.
    """
    h = prefix_hashes(data, powers) if h is None else h
    n = len(starts)

    def agree(i: np.ndarray, j: np.ndarray, k: np.ndarray | int) -> np.ndarray:
        return (h[i + k] - h[i]) * powers.up[j] == (h[j + k] - h[j]) * powers.up[i]

    def less(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether the suffix at ``i`` is before that at ``j``, and whether they are equal."""
        same = agree(i, j, length)
        out = np.zeros(len(i), bool)
        at = np.flatnonzero(~same)
        a, b = i[at], j[at]
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), length - 1)
        while len(at) and (lo < hi).any():
            mid = (lo + hi + 1) // 2
            ok = agree(a, b, mid)
            lo, hi = np.where(ok, mid, lo), np.where(ok, hi, mid - 1)
        out[at] = data[a + lo] < data[b + lo]
        return out, same

    place = np.arange(n)
    head = np.concatenate([[True], group[1:] != group[:-1]]) if n else np.empty(0, bool)
    begin = np.maximum.accumulate(np.where(head, place, 0))
    size = np.bincount(np.cumsum(head) - 1)[np.cumsum(head) - 1] if n else np.empty(0, np.int64)
    order, width = place.copy(), 1
    while n and width < size.max():
        todo = np.flatnonzero(size > width)
        local = todo - begin[todo]
        run = local // width
        left = run % 2 == 0
        lo = begin[todo] + (run + np.where(left, 1, -1)) * width
        hi = np.minimum(lo + width, begin[todo] + size[todo])
        lo, first = np.minimum(lo, hi), np.minimum(lo, hi)
        mine = starts[order[todo]]
        # How many of the other run come before: equal ones do for the right run, so ties stay in order.
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            before, same = less(starts[order[mid]], mine[open_])
            before |= same & ~left[open_]
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        to = begin[todo] + (run // 2) * 2 * width + local % width + lo - first
        order[to] = order[todo].copy()
        width *= 2
    equal = np.zeros(n, bool)
    at = np.flatnonzero(~head)
    equal[at] = agree(starts[order[at - 1]], starts[order[at]], length)
    # Equal hashes are checked on the bytes; where they lied, the group is sorted by its bytes.
    view, at, wrong = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else None, np.flatnonzero(equal), []
    for k in range(0, len(at), 8192):
        part = at[k : k + 8192]
        wrong.append(part[(view[starts[order[part - 1]]] != view[starts[order[part]]]).any(axis=1)])
    for b in np.unique(begin[np.concatenate(wrong)]) if wrong else ():
        members = sorted(range(b, b + size[b]), key=lambda x: data[starts[x] : starts[x] + length].tobytes())
        order[b : b + size[b]] = members
        for x in range(b + 1, b + size[b]):
            equal[x] = bool((view[starts[order[x - 1]]] == view[starts[order[x]]]).all())
    return order, equal


def _windows(table: pa.Table, length: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of whole groups as (member, shift, group), about ``most`` at a time; those of one piece and offset stay together."""
    at, first, last, key = (table[c].to_numpy() for c in ("at", "first", "last", "key"))
    count = (last - first + 1).astype(np.int64)
    heads = np.concatenate([np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), [len(key)]]) if len(key) else np.zeros(1, np.int64)
    total = np.concatenate([[0], np.cumsum(count)])
    begin = 0
    while begin < len(heads) - 1:
        end = begin + 1
        while end < len(heads) - 1 and total[heads[end + 1]] - total[heads[begin]] <= most:
            end += 1
        rows = np.arange(heads[begin], heads[end])
        # Offsets of the gram in its windows run from at - last to at - first.
        low, high = int((at[rows] - last[rows]).min()), int((at[rows] - first[rows]).max())
        cuts = np.linspace(low, high + 1, -(-int(total[heads[end]] - total[heads[begin]]) // most) + 1).astype(np.int64)
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            a, b = np.maximum(first[rows], at[rows] - hi + 1), np.minimum(last[rows], at[rows] - lo)
            n = np.maximum(b - a + 1, 0).astype(np.int64)
            member = np.repeat(rows, n)
            shift = np.arange(len(member)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a - first[rows], n)
            offset = at[member] - first[member] - shift
            order = np.lexsort((offset, key[member]))
            member, shift, offset = member[order], shift[order], offset[order]
            if len(member):
                yield member, shift, np.cumsum(np.concatenate([[True], (key[member[1:]] != key[member[:-1]]) | (offset[1:] != offset[:-1])]))
        begin = end


def _repeats(table: pa.Table, length: int, powers: Powers, most: int = WINDOWS) -> Iterator[pa.RecordBatch]:
    """Runs of windows that some other member of their piece has too."""
    context = table["context"].to_pylist()
    data = np.frombuffer(b"".join(context), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(c) for c in context])])[:-1].astype(np.int64)
    del context
    first, once = (table[c].to_numpy() for c in ("first", "once"))
    h = prefix_hashes(data, powers)
    powers.need(len(h))
    for member, shift, group in _windows(table, length, most):
        sole = np.bincount(group)[group] == 1
        member, shift, group = member[~sole], shift[~sole], group[~sole]
        order, equal = suffix_sort(data, base[member] + shift, group, length, powers, h)
        who = order[equal | np.concatenate([equal[1:], [False]])] if len(equal) else order
        who = who[once[member[who]]]
        m, s = member[who], first[member[who]] + shift[who]
        by = np.lexsort((s, m))
        m, s = m[by], s[by]
        cut = np.flatnonzero(np.concatenate([[True], (m[1:] != m[:-1]) | (s[1:] != s[:-1] + 1)])) if len(m) else np.empty(0, np.int64)
        end = np.concatenate([cut[1:] - 1, [len(m) - 1]]) if len(m) else cut
        rid = pa.array(table["rid"].to_numpy()[m[cut]], pa.string())
        yield pa.RecordBatch.from_arrays([rid, pa.array(s[cut], pa.int32()), pa.array(s[end] + length, pa.int32())], names=["rid", "start", "end"])


#: A picked gram: its piece of the sort, whether that is to be divided, whether the context is the only one of its kind, its place and first and last window.
_MEMBER = ("piece", "crowded", "once", "at", "first", "last")
_MEMBER_TYPES = "piece:long,crowded:boolean,once:boolean,at:int,first:int,last:int"
_AROUND = f"rid string, {_MEMBER_TYPES.replace(':', ' ')}, context binary"


def _divided(rows: dict, length: int, width: int) -> dict:
    """Members cut to blocks of ``width`` offsets of the gram, in pieces by the bytes that all windows of a block share."""
    out = {c: [] for c in ("rid", "piece", "once", "at", "first", "last", "context", "digest")}
    for rid, piece, once, at, first, last, context in zip(*(rows[c] for c in ("rid", "piece", "once", "at", "first", "last", "context")), strict=True):
        for block in range((at - last) // width, (at - first) // width + 1):
            low, high = block * width, (block + 1) * width - 1
            a, b = max(first, at - high), min(last, at - low)
            core = context[at - low - first : at - high - first + length]
            name = hashlib.blake2b(b"%d:%d:" % (piece, block) + core, digest_size=8).digest()
            cut = context[a - first : b - first + length]
            new = (rid, int.from_bytes(name, "little", signed=True), once, at, a, b, cut, hashlib.blake2b(cut, digest_size=16).digest())
            for c, x in zip(out, new, strict=True):
                out[c].append(x)
    return out


def _grouped(batches: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.Table]:
    """Tables of whole pieces from batches ordered by ``piece``, of about ``most`` bytes each, with their number as ``key``."""
    held: list[pa.RecordBatch] = []
    size, number, last = 0, 0, None
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            piece = part["piece"].to_numpy()
            key = number + np.cumsum(np.concatenate([[last is None or last != piece[0]], piece[1:] != piece[:-1]]))
            number, last = int(key[-1]), piece[-1]
            held.append(part.append_column("key", pa.array(key)))
            size += part.nbytes
            if size > most:
                whole = pa.Table.from_batches(held)
                cut = int(np.searchsorted(whole["key"].to_numpy(), number))
                if cut:
                    yield whole.slice(0, cut).combine_chunks()
                    held = pa.Table.from_batches([b.slice(0) for b in whole.slice(cut).combine_chunks().to_batches()]).to_batches()
                    size = sum(b.nbytes for b in held)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def repeated_bytes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """Rows ``(doc_id, n_bytes, n_removed, n_spans, spans, kept_sha256)``, one per input row.

    ``spans`` are the maximal removed runs, byte positions with ends exclusive. Null text:
    empty. Texts shorter than ``length`` bytes lose nothing. Null ids are allowed; rows that
    repeat an id and text are copies of each other and lose all windows. Empty input: no rows.
    Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("rid", F.concat_ws(":", F.xxhash64("doc_id", "text"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))

    def sample(rows: dict) -> dict:
        powers, size, sha, parts, context = Powers(), [], [], [], []
        for text in rows["text"]:
            raw = text.encode("utf-8", "surrogatepass")
            size.append(len(raw))
            sha.append(hashlib.sha256(raw).hexdigest())
            got = grams(np.frombuffer(raw, np.uint8), powers, length, gram)
            view = memoryview(raw)
            context += [hashlib.blake2b(view[a : b + length], digest_size=16).digest() for a, b in zip(got[1].tolist(), got[2].tolist(), strict=True)]
            parts.append(got)
        at, first, last, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
        ends = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int32)
        fields = {"fp": fp.view(np.int64), "context": pa.array(context, pa.binary()), "at": at.astype(np.int32), "first": first.astype(np.int32), "last": last.astype(np.int32)}
        picked = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], names=list(fields)))
        return {"doc_id": rows["doc_id"], "rid": rows["rid"], "n_bytes": size, "sha": sha, "picked": picked}

    kind = dict(rows.dtypes)["doc_id"]
    drawn = save(map_rows(rows, sample, f"doc_id {kind}, rid string, n_bytes long, sha string, picked array<struct<fp:long,context:binary,at:int,first:int,last:int>>"))
    spread = drawn.select("rid", F.explode("picked").alias("p"))
    often = save(spread.select("p.fp").groupBy("fp").count().where("count > 1").select("fp"))
    again = save(spread.select("rid", "p.*").join(often, "fp"))
    kinds = save(again.groupBy("fp", "context").agg(F.count("*").alias("n"), F.min(F.struct("rid", "at", "first", "last")).alias("one")))
    settled = again.join(save(kinds.where("n > 1").select("fp", "context")), ["fp", "context"]).select("rid", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    settled = settled.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    # Written before their joins, so that a very frequent gram can be split there.
    sizes = save(kinds.groupBy("fp").agg(F.count("*").alias("members"), F.count(F.when(F.col("n") == 1, 1)).alias("open")).where("open > 0").select("fp", "members"))
    members = kinds.join(sizes, "fp").select(F.col("fp").alias("piece"), (F.col("members") > crowd).alias("crowded"), (F.col("n") == 1).alias("once"), "one.*")
    members = members.groupBy("rid").agg(F.collect_list(F.struct(*_MEMBER)).alias("members"))
    met = save(settled.join(members, "rid", "full"))
    # The texts move once; from here on only documents with some repeated gram.
    held = save(rows.join(met.hint("shuffle_hash"), "rid").select("rid", "text", F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"), F.coalesce("members", F.array().cast(f"array<struct<{_MEMBER_TYPES}>>")).alias("members")).dropDuplicates(["rid"]))

    def contexts(rows: dict) -> dict:
        out = {c: [] for c in ("rid", *_MEMBER, "context")}
        for rid, text, members in zip(rows["rid"], rows["text"], rows["members"], strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            for m in members:
                for c in _MEMBER:
                    out[c].append(m[c])
                out["rid"].append(rid)
                out["context"].append(raw[m["first"] : m["last"] + length])
        return out

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for table in _grouped(batches):
            yield from _repeats(table, length, powers)

    around = save(map_rows(held.where(F.size("members") > 0).select("rid", "text", "members"), contexts, _AROUND))
    pieces, runs, width = [], [], length - gram + 1
    while True:
        # In a block of one offset a piece has one context, or equal hashes: nothing is crowded there.
        pieces.append(around.where("not crowded") if width > 1 else around)
        crowds = around.where("crowded")
        if width == 1 or crowds.isEmpty():
            break
        width = -(-width // BLOCKS)
        parts = save(map_rows(crowds, partial(_divided, length=length, width=width), "rid string, piece long, once boolean, at int, first int, last int, context binary, digest binary"))
        kinds = save(parts.groupBy("piece", "digest").agg(F.count("*").alias("n"), F.min(F.struct("once", "rid", "at", "first", "last", "context")).alias("one")))
        runs.append(parts.where("once").join(kinds.where("n > 1").select("piece", "digest"), ["piece", "digest"]).select("rid", F.col("first").alias("start"), (F.col("last") + length).alias("end")))
        alone = (F.col("n") == 1) & F.col("one.once")
        sizes = save(kinds.groupBy("piece").agg(F.count("*").alias("members"), F.count(F.when(alone, 1)).alias("open")).where("open > 0 and members > 1").select("piece", "members"))
        around = save(kinds.join(sizes, "piece").select("piece", (F.col("members") > crowd).alias("crowded"), alone.alias("once"), *(f"one.{c}" for c in ("rid", "at", "first", "last", "context"))).select("rid", *_MEMBER, "context"))
    runs.append(reduce(DataFrame.unionByName, pieces).repartition("piece").sortWithinPartitions("piece").mapInArrow(sort, "rid string, start int, end int"))
    more = save(reduce(DataFrame.unionByName, runs)).groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("more"))

    def cut(rows: dict) -> dict:
        out = {"rid": rows["rid"], "n_removed": [], "spans": [], "kept": []}
        for text, spans, more in zip(rows["text"], rows["spans"], rows["more"], strict=True):
            raw, runs, keep, at = text.encode("utf-8", "surrogatepass"), [], [], 0
            for s in sorted((s["start"], s["end"]) for s in spans + (more or [])):
                if runs and s[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], s[1])
                else:
                    runs.append(list(s))
            for a, b in runs:
                keep.append(raw[at:a])
                at = b
            out["n_removed"].append(sum(b - a for a, b in runs))
            out["spans"].append([{"start": a, "end": b} for a, b in runs])
            out["kept"].append(hashlib.sha256(b"".join([*keep, raw[at:]])).hexdigest())
        return out

    done = map_rows(held.select("rid", "text", "spans").join(more.hint("shuffle_hash"), "rid", "left"), cut, "rid string, n_removed long, spans array<struct<start:long,end:long>>, kept string")
    out = drawn.select("doc_id", "rid", "n_bytes", "sha").join(done, "rid", "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"), F.coalesce("spans", none).alias("spans"), F.coalesce("kept", "sha").alias("kept_sha256"))
