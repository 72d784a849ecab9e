"""Secret scans over an incremental blob ledger.

Every historical version of every path is content-addressed by the SHA-256 of its text. The
ledger holds, for each scan of a blob, the ``rule:version`` pairs applied and the spans found,
a row also where nothing was found. A scan reads one copy of each blob for which the ledger lacks some pair, applies only the
lacking rules to it, and joins the findings back to all paths and versions that hold the blob.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, save

SPANS = "array<struct<kind:string,version:int,start:long,end:long>>"
LEDGER = f"blob string, scanned array<string>, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """A pattern, what a match must also satisfy, and words of which a matching text holds one (none: no such test)."""

    name: str
    version: int
    pattern: str
    accept: Callable[[re.Match], bool] = lambda m: True
    words: tuple[str, ...] = ()


#: The base rules, in the order their kinds are listed, then those that the scan adds.
#: A run of 32 hex digits or more is what remains of the runs `[0-9a-f]+` after the length test.
RULES: tuple[Rule, ...] = (
    Rule("assign", 1, r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", words=("private key",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", words=("eyj",)),
)


def find(text: str, rules: Sequence[tuple[Rule, re.Pattern]]) -> dict[str, list[dict]]:
    """Spans by rule: leftmost matches that do not overlap, failing ones dropped without a retry."""
    low = text.lower()
    return {r.name: [] if r.words and not any(w in low for w in r.words) else [{"kind": r.name, "version": r.version, "start": m.start(), "end": m.end()} for m in p.finditer(text) if r.accept(m)] for r, p in rules}


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """Scan what ``versions(path, version, text)`` adds to a ledger of earlier scans.

    Returns ``(paths, ledger)``: ``(path, version, blob)`` of each input row, and the ledger
    with the new pairs. Both are tables in the shared folder. Of a blob one copy is scanned, and
    only for the pairs of rule and version that the ledger lacks. Null text: the empty blob.
    Null or repeated paths and versions: a row each. Empty input: no paths, the ledger as it
    was. Extra columns are not read.
    """
    rules = tuple(rules)
    text = F.coalesce(F.col("text"), F.lit(""))
    held = versions.select("path", "version", text.alias("text"), F.sha2(text, 256).alias("blob"))
    paths = save(held.select("path", "version", "blob"))
    wanted = _pairs(rules)
    blobs = paths.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"))
    if ledger is not None:
        seen = ledger.select("blob", F.explode("scanned").alias("pair")).groupBy("blob").agg(F.collect_set("pair").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0)
    else:
        blobs = blobs.withColumn("todo", wanted)
    one = blobs.select(F.col("blob").alias("b"), F.col("at.path").alias("p"), F.col("at.version").alias("v"), "todo").hint("shuffle_hash")
    fresh = held.join(one, (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("p")) & F.col("version").eqNullSafe(F.col("v"))).select("blob", "text", "todo")

    def ready() -> dict:
        return {f"{r.name}:{r.version}": (r, re.compile(r.pattern)) for r in rules}

    def look(rows: dict, ready: dict) -> dict:
        spans = [[s for x in find(text, [ready[k] for k in todo]).values() for s in x] for text, todo in zip(rows["text"], rows["todo"], strict=True)]
        return {"blob": rows["blob"], "scanned": rows["todo"], "spans": spans}

    new = save(map_rows(fresh, look, LEDGER, ready).dropDuplicates(["blob"]))
    return paths, new if ledger is None else ledger.select(new.columns).unionByName(new)


def _pairs(rules: Sequence[Rule]) -> Column:
    return F.array(*(F.concat_ws(":", F.lit(r.name), F.lit(r.version)) for r in rules))


def findings(paths: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``(path, version, blob, spans)``, a row for each of ``paths``: spans of the rules as they are now, by start and then rule order.

    A blob that was never scanned has no spans. Empty input: no rows.
    """
    found = ledger.where(F.size("spans") > 0).select("blob", F.explode("spans").alias("s")).select("blob", "s.*")
    found = found.where(F.array_contains(_pairs(rules), F.concat_ws(":", "kind", "version")))
    order = F.array_position(F.array(*(F.lit(r.name) for r in rules)), F.col("kind"))
    found = found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("start", order.alias("at"), "kind", "end"))).alias("spans"))
    spans = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return paths.join(found, "blob", "left").select("path", "version", "blob", F.coalesce(spans, none).alias("spans"))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """``scan`` and the ``findings`` of its rows: ``(ledger, findings)``."""
    paths, ledger = scan(versions, ledger, rules)
    return ledger, findings(paths, ledger, rules)
