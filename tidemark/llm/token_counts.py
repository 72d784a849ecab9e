"""Token counts by field or section, from one encoding of each whole document.

The fields of a document are joined and encoded once. Token byte lengths give each token's
span; a binary search of the spans in the ascending section boundaries is the interval join.
A token that crosses a boundary is allocated by an explicit rule: ``start`` and ``end`` give it
to the section of its first or last byte, ``share`` splits it by bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-splitting pattern of the public byte-level BPE vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("start", "end", "share")
SECTIONS = "array<struct<name:string,start:bigint,end:bigint,tokens:double>>"

Splitter = Callable[[str], Sequence[tuple[str, int]]]


def whole(text: str) -> list[tuple[str, int]]:
    """One section."""
    return [("text", 0)]


def lines(text: str) -> list[tuple[str, int]]:
    """The first line as ``head``, the last of several as ``tail``, what lies between as ``body``; line ends go with their line."""
    first, last = text.find("\n") + 1, text.rstrip("\n").rfind("\n") + 1
    out = [("head", 0)]
    if 0 < first < last:
        out.append(("body", first))
    if last:
        out.append(("tail", last))
    return out


def spans_of(ids: Sequence[int], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of tokens that follow one another."""
    n = lengths[np.asarray(ids, np.int64)]
    ends = np.cumsum(n)
    return ends - n, ends


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens of each section that begins at one of ``bounds`` (ascending, the first 0), and how many tokens cross a bound."""
    k = len(bounds)
    a, b = np.searchsorted(bounds, starts, "right") - 1, np.searchsorted(bounds, ends - 1, "right") - 1
    crossing = np.flatnonzero(a != b)
    if rule != "share":
        return np.bincount(a if rule == "start" else b, minlength=k).astype(float), len(crossing)
    out = np.bincount(a[a == b], minlength=k).astype(float)
    for t in crossing.tolist():
        for s in range(a[t], b[t] + 1):
            left, right = max(bounds[s], starts[t]), min(ends[t], bounds[s + 1] if s + 1 < k else ends[t])
            out[s] += (right - left) / (ends[t] - starts[t])
    return out, len(crossing)


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", fields: Sequence[str] = ("text",), split: Splitter = whole, joiner: str = "\n", rule: str = "start", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """Rows ``(doc_id, n_tokens, n_crossing, sections)``, one per input row.

    The fields are joined by ``joiner``, which belongs to the field before; ``split`` cuts a
    field into named sections by code point. ``sections`` has, in order, names (with several
    fields ``field.section``), code-point spans of the joined text, and tokens by ``rule``.
    They add up to ``n_tokens``. Null fields: empty; an empty document has no tokens and
    sections of none. Null or repeated ids: a row each. Empty input: no rows. Other columns
    are not read. The driver reads the vocabulary file and sends it.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    sent = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())
    fields = list(fields)
    rows = docs.select(F.col(id_col).alias("doc_id"), *(F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)))

    def coder() -> tuple:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        coder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for raw, i in ranks.items():
            lengths[i] = len(raw)
        return coder, lengths

    def count(rows: dict, own: tuple) -> dict:
        coder, lengths = own
        out = {"doc_id": rows["doc_id"], "n_tokens": [], "n_crossing": [], "sections": []}
        for texts in zip(*(rows[f"f{i}"] for i in range(len(fields))), strict=True):
            texts, at, names, begins = [t or "" for t in texts], 0, [], []
            for i, (field, text) in enumerate(zip(fields, texts, strict=True)):
                for name, begin in split(text):
                    names.append(name if len(fields) == 1 else f"{field}.{name}")
                    begins.append(at + begin)
                at += len(text) + len(joiner) * (i < len(fields) - 1)
            text = joiner.join(texts)
            starts, ends = spans_of(coder.encode_ordinary(text), lengths)
            cuts = [*begins, len(text)]
            bounds = np.concatenate([[0], np.cumsum([len(text[a:b].encode("utf-8", "surrogatepass")) for a, b in zip(cuts, cuts[1:], strict=False)])]).astype(np.int64)[:-1]
            tokens, crossing = allocate(starts, ends, bounds, rule)
            out["n_tokens"].append(len(starts))
            out["n_crossing"].append(crossing)
            out["sections"].append([{"name": n, "start": a, "end": b, "tokens": t} for n, a, b, t in zip(names, cuts, cuts[1:], tokens.tolist(), strict=False)])
        return out

    kind = dict(rows.dtypes)["doc_id"]
    return map_rows(rows, count, f"doc_id {kind}, n_tokens long, n_crossing long, sections {SECTIONS}", coder)
