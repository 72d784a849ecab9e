"""The measurement store: Parquet parts under a manifest, versions, tombstones, retention, compaction.

Layout under the root: ``catalog.json`` (databases, retention policies, measurements with
fields, tags, parts with their live shards, tombstones and what awaits deletion),
``data/<db>/<rp>/<measurement>/write_seq=<n>/shard_start=<ns>/`` and
``series/<db>/<measurement>/from=<id>/`` (tag sets with ids that never change). A write adds a
part and then replaces the catalog, so a failed write leaves nothing visible. A later part
wins, within a part the later row, field by field. Replaced and expired files stay until
``vacuum``, so a DataFrame planned before can still read them. One process writes at a time;
its threads may write side by side.
"""

from __future__ import annotations

import threading
import time
from collections import Counter
from collections.abc import Iterable, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryError
from ..operators import predicates
from ..plans.model import MAX_TS, MIN_TS, NS, to_ns
from .files import Files
from .measurement import Measurement, from_dataframe
from .series import number, same_tags

HOUR = 3_600_000_000_000
_OWN = {"ts", "write_seq", "write_ord", "shard_start", "series_id"}


class Store:
    """``shard`` is the length of a time partition in nanoseconds; limits of 0 are none."""

    def __init__(self, spark: SparkSession, root: str, *, shard: int = HOUR, max_series: int = 0, max_fields: int = 0, max_tag_values: int = 0):
        if shard <= 0:
            raise QueryError("invalid-options", "shard must be positive")
        self.spark, self.root, self.shard = spark, root.rstrip("/"), shard
        self.max_series, self.max_fields, self.max_tag_values = max_series, max_fields, max_tag_values
        self.files, self.lock = Files(spark), threading.RLock()
        self.catalog = self.files.read_json(f"{self.root}/catalog.json", {"seq": 0, "databases": {}, "trash": []})

    def _commit(self) -> None:
        with self.lock:
            self.files.write_json(f"{self.root}/catalog.json", self.catalog)

    def _discard(self, paths: Iterable[str]) -> None:
        now = time.time()
        self.catalog["trash"] += [[p, now] for p in paths]

    def vacuum(self, older_than: float = 3600.0) -> int:
        """Delete files that were replaced or expired at least so many seconds ago; returns how many paths."""
        due = [p for p, t in self.catalog["trash"] if t <= time.time() - older_than]
        for p in due:
            self.files.delete(p)
        self.catalog["trash"] = [x for x in self.catalog["trash"] if x[0] not in set(due)]
        self._commit()
        return len(due)

    # --- namespaces

    def create_database(self, database: str) -> None:
        self.catalog["databases"].setdefault(database, {"policies": {}, "fields": {}, "tables": {}})
        self._commit()

    def list_databases(self) -> list[str]:
        return sorted(self.catalog["databases"])

    def drop_database(self, database: str) -> None:
        self._database(database)
        del self.catalog["databases"][database]
        self._discard([f"{self.root}/data/{database}", f"{self.root}/series/{database}"])
        self._commit()

    def create_retention_policy(self, database: str, policy: str, duration: int = 0) -> None:
        self.create_database(database)
        self.catalog["databases"][database]["policies"][policy] = {"duration": duration}
        self._commit()

    def list_retention_policies(self, database: str) -> list[str]:
        return sorted(self._database(database)["policies"])

    def _database(self, database: str) -> dict:
        if database not in self.catalog["databases"]:
            raise QueryError("not-found", f"no database {database!r}")
        return self.catalog["databases"][database]

    def _table(self, database: str, policy: str, measurement: str) -> dict:
        found = self._database(database)["tables"].get(f"{policy}/{measurement}")
        if found is None:
            raise QueryError("measurement-not-found", f"no measurement {measurement!r} in {database}/{policy}")
        return found

    def list_measurements(self, database: str) -> list[str]:
        return sorted({k.split("/", 1)[1] for k in self._database(database)["tables"]})

    def list_fields(self, database: str, measurement: str) -> dict[str, str]:
        return dict(self._database(database)["fields"].get(measurement, {}))

    # --- writing

    def write_points(self, points: Iterable[Mapping], *, precision: str = "ns") -> None:
        """Write points: mappings with database, retention_policy, measurement, tags, ts and fields."""
        groups: dict[tuple, list[Mapping]] = {}
        for p in points:
            if not p.get("measurement") or not p.get("fields"):
                raise QueryError("invalid-point", "measurement or fields are empty")
            groups.setdefault((p.get("database", "default"), p.get("retention_policy", "autogen"), p["measurement"]), []).append(p)
        for key, rows in groups.items():
            tags, fields = sorted({t for p in rows for t in p["tags"]}), {}
            for p in rows:
                for name, value in p["fields"].items():
                    kind = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}.get(type(value))
                    if kind is None:
                        raise QueryError("invalid-point", f"field {name!r} has no supported type")
                    if fields.setdefault(name, kind) != kind:
                        raise QueryError("field-type-conflict", f"field {name!r} has two types")
            schema = T.StructType([*(T.StructField(t, T.StringType()) for t in tags), T.StructField("ts", T.LongType()), *(T.StructField(f, k) for f, k in sorted(fields.items()))])
            data = [(*(p["tags"].get(t) for t in tags), p["ts"], *(p["fields"].get(f) for f in sorted(fields))) for p in rows]
            self.write(self.spark.createDataFrame(data, schema), *key, tags=tags, precision=precision)

    def write(self, df: DataFrame, database: str, policy: str, measurement: str, *, tags: Iterable[str], precision: str = "ns") -> None:
        """Write a typed batch: tag columns, ``ts`` and one column for each field."""
        tags = list(tags)
        if not measurement.strip():
            raise QueryError("invalid-measurement", "measurement is empty")
        m = from_dataframe(df, measurement, tags=tags, fields=[c for c in df.columns if c not in tags and c != "ts"], ts="ts", unit="ns")
        if not m.fields:
            raise QueryError("invalid-point", "a batch needs a field")
        if _OWN & (set(tags) | set(m.fields)) or set(tags) & set(m.fields):
            raise QueryError("invalid-point", "a column name is reserved or doubled")
        if precision not in NS:
            raise QueryError("invalid-precision", f"unknown precision {precision!r}")
        self.catalog["databases"].setdefault(database, {"policies": {}, "fields": {}, "tables": {}})
        base = self.catalog["databases"][database]
        known = dict(base["fields"].get(measurement, {}))
        for f, kind in m.fields.items():
            if known.setdefault(f, kind) != kind:
                raise QueryError("field-type-conflict", f"field {f!r} is {known[f]}, not {kind}")
        if self.max_fields and len(known) > self.max_fields:
            raise QueryError("cardinality-limit", f"more than {self.max_fields} fields")
        table = base["tables"].get(f"{policy}/{measurement}", {"tags": [], "parts": [], "tombstones": []})
        all_tags = list(dict.fromkeys([*table["tags"], *tags]))
        ts, factor = F.col("ts"), NS[precision]
        good = ts.between(-(-MIN_TS // factor), MAX_TS // factor)
        ts = F.when(good, ts * F.lit(factor)).otherwise(F.raise_error(F.lit("invalid-precision: a timestamp is null or overflows nanoseconds")).cast("bigint"))
        with self.lock:
            self.catalog["seq"] = seq = self.catalog["seq"] + 1
        rows = m.df.withColumn("ts", ts).withColumns({"write_ord": F.monotonically_increasing_id(), "shard_start": F.col("ts") - F.pmod("ts", F.lit(self.shard))})
        part = self._write_part(rows, database, policy, measurement, seq, tags, m.fields)
        # The files are written side by side; what follows is short and goes one write after the other.
        with self.lock:
            table = base["tables"].get(f"{policy}/{measurement}", table)
            all_tags = list(dict.fromkeys([*table["tags"], *tags]))
            base.setdefault("series", {})[measurement] = self._new_series(part, database, measurement, tags, all_tags, seq)
            base["policies"].setdefault(policy, {"duration": 0})
            base["fields"][measurement] = {**base["fields"].get(measurement, {}), **known}
            parts = sorted([*table["parts"], *[part] * bool(part["shards"])], key=lambda p: p["seq"])
            base["tables"][f"{policy}/{measurement}"] = table | {"tags": all_tags, "parts": parts}
            self._commit()

    def _write_part(self, rows: DataFrame, database: str, policy: str, measurement: str, seq: int, tags: list[str], fields: dict[str, str]) -> dict:
        path = f"{self.root}/data/{database}/{policy}/{measurement}/write_seq={seq}"
        seen = Observation(f"part-{seq}")
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
        # Rebalancing splits a hot shard over several files and joins the rows of a thin one.
        rows.hint("rebalance", "shard_start").sortWithinPartitions("shard_start", *(f"`{t}`" for t in sorted(tags)), "ts").write.mode("overwrite").partitionBy("shard_start").parquet(path)
        shards = sorted(int(c.rsplit("=", 1)[1]) for c in self.files.children(path) if "shard_start=" in c)
        return {"path": path, "seq": seq, "tags": tags, "fields": fields, "shards": shards, "rows": seen.get["rows"]}

    def _new_series(self, part: dict, database: str, measurement: str, tags: list[str], all_tags: list[str], seq: int) -> dict:
        """Give ids to the part's new tag sets, ascending with the tags, after those given before; a broken limit removes the part."""
        known = self.catalog["databases"][database].get("series", {}).get(measurement, {"next": 1, "parts": []})
        if not part["shards"]:
            return known
        pad = lambda df: df.select(*((F.col(f"`{t}`") if t in df.columns else F.lit(None).cast("string")).alias(t) for t in all_tags))
        schema = T.StructType([T.StructField(t, T.StringType()) for t in tags])
        new = pad(self.spark.read.schema(schema).parquet(*(f"{part['path']}/shard_start={x}" for x in part["shards"])).distinct())
        old = self._series_table(known, all_tags)
        if old is not None:
            new = new.join(old.select(*(F.col(f"`{t}`").alias(f"_s{i}") for i, t in enumerate(all_tags))), same_tags(all_tags), "left_anti")
        new = new.persist()
        try:
            n = new.count()
            if not n:
                return known
            total = known["next"] - 1 + n
            over = self.max_series and total > self.max_series
            if self.max_tag_values and not over:
                every = new if old is None else new.unionByName(old.drop("series_id"))
                counts = every.agg(*(F.countDistinct(F.col(f"`{t}`")).alias(f"_{i}") for i, t in enumerate(all_tags))).first() if all_tags else ()
                over = any(c > self.max_tag_values for c in counts)
            if over:
                self.files.delete(part["path"])
                raise QueryError("cardinality-limit", f"more than {self.max_series} series or {self.max_tag_values} values of a tag")
            path = f"{self.root}/series/{database}/{measurement}/from={known['next']}-{seq}"
            number(new, sorted(all_tags), known["next"]).select("series_id", *(f"`{t}`" for t in all_tags)).write.mode("overwrite").parquet(path)
            return {"next": known["next"] + n, "parts": [*known["parts"], path]}
        finally:
            new.unpersist()

    def _series_table(self, known: dict, tags: list[str]) -> DataFrame | None:
        if not known["parts"]:
            return None
        schema = T.StructType([T.StructField("series_id", T.LongType()), *(T.StructField(t, T.StringType()) for t in tags)])
        return self.spark.read.schema(schema).parquet(*known["parts"])

    def series_ids(self, database: str, policy: str, measurement: str) -> DataFrame:
        """``(series_id, tags)`` of all tag sets ever written; an id never changes."""
        table, base = self._table(database, policy, measurement), self._database(database)
        found = self._series_table(base.get("series", {}).get(measurement, {"parts": []}), table["tags"])
        if found is None:
            found = self.spark.createDataFrame([], T.StructType([T.StructField("series_id", T.LongType()), *(T.StructField(t, T.StringType()) for t in table["tags"])]))
        return found

    # --- reading

    def _live(self, part: dict, start: int | None, end: int | None) -> list[int]:
        return [s for s in part["shards"] if (start is None or s + self.shard > start) and (end is None or s <= end)]

    def _scan(self, database: str, policy: str, measurement: str, chosen: list[tuple[dict, list[int]]]) -> DataFrame:
        """All versions in the chosen shards of the chosen parts, by one scan, deletes taken out; absent tags and fields as nulls."""
        table, fields = self._table(database, policy, measurement), self.list_fields(database, measurement)
        schema = T.StructType([*(T.StructField(t, T.StringType()) for t in table["tags"]), T.StructField("ts", T.LongType()), *(T.StructField(f, T._parse_datatype_string(k)) for f, k in fields.items()), T.StructField("write_ord", T.LongType()), T.StructField("write_seq", T.LongType()), T.StructField("shard_start", T.LongType())])
        paths = [x for p, shards in chosen if shards for x in ([p["path"]] if len(shards) == len(p["shards"]) and not p.get("cut") else [f"{p['path']}/shard_start={s}" for s in shards])]
        if not paths:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).option("basePath", f"{self.root}/data/{database}/{policy}/{measurement}").parquet(*paths)
        starts = [s for _, shards in chosen for s in shards]
        low, high = min(starts), max(starts) + self.shard - 1
        dead = []
        for t in table["tombstones"]:
            a, b = low if t["start"] is None else max(low, t["start"]), high if t["end"] is None else min(high, t["end"])
            if a <= b and any(p["seq"] <= t["seq"] for p, shards in chosen if shards):
                # A tag that the measurement lacks is absent everywhere: '' matches, a value does not.
                if not any(v for k, v in t["tags"].items() if k not in table["tags"]):
                    dead.append({x: t["tags"].get(x) for x in table["tags"]} | {"start_ts": a, "end_ts": b, "seq": t["seq"]})
        if not dead:
            return df
        stones = pa.schema([*((t, pa.string()) for t in table["tags"]), *((c, pa.int64()) for c in ("start_ts", "end_ts", "seq"))])
        # From Arrow it is a local relation of known size, so Spark knows whether it may be broadcast.
        return anti_deleted(df, self.spark.createDataFrame(pa.Table.from_pylist(dead, stones)), table["tags"], self.shard, by="shard_start")

    def raw(self, database: str, policy: str, measurement: str, start: int | None = None, end: int | None = None) -> DataFrame:
        """All live versions in the shards that a time range touches, absent tags and fields as nulls."""
        parts = self._table(database, policy, measurement)["parts"]
        return self._scan(database, policy, measurement, [(p, self._live(p, start, end)) for p in parts])

    def read(self, database: str, policy: str, measurement: str, start: int | None = None, end: int | None = None) -> Measurement:
        """The measurement with versions and deletes resolved; a time range leaves out whole shards only.

        The key of a version is (series, ts, field). A shard with one part that compaction wrote
        has one version of each, so it is read as it is and field predicates reach its files.
        """
        table, fields = self._table(database, policy, measurement), self.list_fields(database, measurement)
        keys = [*table["tags"], "shard_start", "ts"]
        live = [(p, self._live(p, start, end)) for p in table["parts"]]
        held = Counter(s for _, shards in live for s in shards)
        take = lambda df: df.select(*(F.col(f"`{c}`") for c in [*keys, *fields]))
        kind = lambda p, s: "many" if held[s] > 1 else "sole" if p.get("unique") else "one"
        found = []
        # Shards of one part are told apart by the order in it alone, a plain number.
        for name, resolve in (("sole", take), ("one", lambda df: resolve_versions(df, keys, list(fields), ("write_ord",))), ("many", lambda df: resolve_versions(df, keys, list(fields)))):
            chosen = [(p, [s for s in shards if kind(p, s) == name]) for p, shards in live]
            if any(shards for _, shards in chosen):
                found.append(take(resolve(self._scan(database, policy, measurement, chosen))))
        df = reduce(DataFrame.unionByName, found) if found else take(self._scan(database, policy, measurement, []))
        return Measurement(df, measurement, tuple(table["tags"]), fields, shard=self.shard, ids=self.series_ids(database, policy, measurement))

    def shards(self, database: str, policy: str, measurement: str, start: int | None = None, end: int | None = None) -> list[int]:
        """Shard starts that a time range touches, from the catalog."""
        return sorted({s for p in self._table(database, policy, measurement)["parts"] for s in self._live(p, start, end)})

    def series(self, database: str, policy: str, measurement: str, *, tags: Mapping[str, str] | None = None, search: str = "", limit: int = 0, offset: int = 0) -> tuple[DataFrame, int, bool]:
        """``(series page, total, truncated)`` of series that have the tags and hold the text, from the table of series."""
        if limit < 0 or offset < 0:
            raise QueryError("invalid-pagination", "limit and offset must not be negative")
        known = self._table(database, policy, measurement)["tags"]
        found = self.series_ids(database, policy, measurement)
        if tags:
            found = found.where(predicates.exact_tags(dict(tags), frozenset(known)))
        if search:
            found = found.where(predicates.series_search(search, measurement, list(known)))
        total = found.count()
        page = found.orderBy("series_id").offset(offset)
        page = page.limit(limit) if limit else page
        return page, total, bool(limit) and offset + limit < total

    # --- deletes, retention, compaction

    def delete(self, database: str, policy: str, measurement: str, *, start: int, end: int, tags: Mapping[str, str] | None = None, precision: str = "ns") -> None:
        """Delete what has been written so far in an inclusive time range; later writes stay."""
        a, b = to_ns(start, precision), to_ns(end, precision)
        if a > b:
            raise QueryError("invalid-time-range", "start is after end")
        self._table(database, policy, measurement)["tombstones"].append({"tags": dict(tags or {}), "start": a, "end": b, "seq": self.catalog["seq"]})
        self._commit()

    def apply_retention(self, now: int, duration: int | None = None) -> int:
        """Drop shards that ended before ``now - duration`` and delete the expired head of the next one.

        Without a duration each retention policy's own holds; 0 keeps all. Returns the number of
        shard directories dropped.
        """
        dropped = 0
        for base in self.catalog["databases"].values():
            for key, table in base["tables"].items():
                length = duration if duration is not None else base["policies"][key.split("/", 1)[0]]["duration"]
                if not length:
                    continue
                cutoff = now - length
                for p in table["parts"]:
                    gone = [s for s in p["shards"] if s + self.shard <= cutoff]
                    dropped += len(gone)
                    self._cut(p, gone)
                table["parts"] = [p for p in table["parts"] if p["shards"]]
                table["tombstones"].append({"tags": {}, "start": None, "end": cutoff - 1, "seq": self.catalog["seq"]})
                self._settle(table)
        self._commit()
        return dropped

    def _cut(self, part: dict, shards: Iterable[int]) -> None:
        gone = set(shards)
        if gone:
            self._discard(f"{part['path']}/shard_start={s}" for s in sorted(gone))
            part["shards"], part["cut"] = [s for s in part["shards"] if s not in gone], True

    def _settle(self, table: dict) -> None:
        """Forget tombstones that no live shard written before them meets."""
        meets = lambda t: any(p["seq"] <= t["seq"] and self._live(p, t["start"], t["end"]) for p in table["parts"])
        table["tombstones"] = [t for t in table["tombstones"] if meets(t)]

    def compaction_plan(self, database: str, policy: str, measurement: str, *, min_parts: int = 1) -> list[int]:
        """Shards that compaction would rewrite: of ``min_parts`` parts at least, with versions or deletes to resolve."""
        table = self._table(database, policy, measurement)
        held = Counter(s for p in table["parts"] for s in p["shards"])
        clean = {s for p in table["parts"] if p.get("unique") for s in p["shards"] if held[s] == 1 and not any(p["seq"] <= t["seq"] and self._live({"shards": [s]}, t["start"], t["end"]) for t in table["tombstones"])}
        return sorted(s for s, n in held.items() if n >= min_parts and s not in clean)

    def compact(self, database: str, policy: str, measurement: str, *, min_parts: int = 1, shards: Iterable[int] | None = None) -> list[int]:
        """Rewrite shards, each as one part without old versions and deleted rows; returns them.

        By default those of ``compaction_plan``; other shards are not read. Shards that end up
        empty are dropped.
        """
        with self.lock:
            return self._compact(database, policy, measurement, min_parts, shards)

    def _compact(self, database: str, policy: str, measurement: str, min_parts: int, shards: Iterable[int] | None) -> list[int]:
        table = self._table(database, policy, measurement)
        todo = self.compaction_plan(database, policy, measurement, min_parts=min_parts) if shards is None else sorted(set(shards) & set(self.shards(database, policy, measurement)))
        if todo:
            fields, keys, chosen = self.list_fields(database, measurement), [*table["tags"], "shard_start", "ts"], set(todo)
            live = resolve_versions(self._scan(database, policy, measurement, [(p, [s for s in p["shards"] if s in chosen]) for p in table["parts"]]), keys, list(fields))
            seq = self.catalog["seq"] + 1  # the caller holds the catalog: one compaction, and no write, at a time
            part = self._write_part(live.withColumn("write_ord", F.lit(0).cast("bigint")), database, policy, measurement, seq, list(table["tags"]), fields)
            for p in table["parts"]:
                self._cut(p, chosen & set(p["shards"]))
            table["parts"] = [p for p in table["parts"] if p["shards"]] + [part | {"unique": True}] * bool(part["shards"])
            self.catalog["seq"] = seq
        self._settle(table)
        self._commit()
        return todo


def resolve_versions(df: DataFrame, keys: list[str], fields: list[str], version: tuple[str, ...] = ("write_seq", "write_ord")) -> DataFrame:
    """For each key and field the value of the greatest version that has one."""
    newest = F.struct(*version) if len(version) > 1 else F.col(version[0])
    return df.groupBy(*(f"`{k}`" for k in keys)).agg(*(F.max_by(F.col(f"`{f}`"), F.when(F.col(f"`{f}`").isNotNull(), newest)).alias(f) for f in fields))


def anti_deleted(df: DataFrame, tombstones: DataFrame, tags: list[str], shard: int, seq: str = "write_seq", by: str | None = None) -> DataFrame:
    """Rows not covered by ``tombstones(<tags> nullable, start_ts, end_ts, seq)``; a null tag covers all values, '' an absent one.

    Both sides meet by shard (``by``, or the shard of ``ts``), so it is an equi-join however
    many tombstones there are. Tombstones have both ends; the store cuts open ones to its
    shards.
    """
    spread = tombstones.withColumn("_s", F.explode(F.sequence(F.col("start_ts") - F.pmod("start_ts", F.lit(shard)), F.col("end_ts") - F.pmod("end_ts", F.lit(shard)), F.lit(shard))))
    spread = spread.select("_s", "start_ts", "end_ts", F.col("seq").alias("_seq"), *(F.col(f"`{t}`").alias(f"_t{i}") for i, t in enumerate(tags)))
    at = F.col(by) if by else F.col("ts") - F.pmod("ts", F.lit(shard))
    on = (at == F.col("_s")) & F.col("ts").between(F.col("start_ts"), F.col("end_ts")) & (F.col(seq) <= F.col("_seq"))
    for i, t in enumerate(tags):
        on = on & (F.col(f"_t{i}").isNull() | (F.coalesce(F.col(f"`{t}`"), F.lit("")) == F.col(f"_t{i}")))
    return df.join(spread, on, "left_anti")
