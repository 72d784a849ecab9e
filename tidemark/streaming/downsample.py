"""Downsampling policies: planning, batch runs, watermarks, late data."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions import registry
from ..operators.aggregate import Spec, _grouped, output_type
from ..plans.model import Query, normal_function
from ..sources.measurement import Measurement
from ..sources.store import Store

MINUTE = 60_000_000_000
#: Over one window a difference is last - first, a derivative that per second, and a median needs two samples.
OVER_WINDOW = {"difference": "delta", "derivative": "window_derivative", "median": "window_median"}


@dataclass(frozen=True)
class Function:
    function: str
    field: str
    as_: str = ""


@dataclass(frozen=True)
class Policy:
    """A rollup; all durations and times in nanoseconds."""

    name: str
    source_database: str
    source_retention: str
    source_measurement: str
    target_database: str
    target_retention: str
    target_measurement: str
    interval: int
    functions: tuple[Function, ...]
    group_by_tags: tuple[str, ...] = ()
    delay: int = 0
    refresh_interval: int = MINUTE
    lookback: int = 0
    initial_start: int = 0
    run_timeout: int = 5 * MINUTE
    batch_size: int = 100_000  # windows of one aggregation
    checkpoint_interval: int = 1
    policy_tag: str = "downsample_policy"
    enabled: bool = True

    @property
    def source(self) -> tuple[str, str, str]:
        return self.source_database, self.source_retention, self.source_measurement

    @property
    def target(self) -> tuple[str, str, str]:
        return self.target_database, self.target_retention, self.target_measurement


def normalized(p: Policy) -> Policy:
    """The policy with trimmed names and default output names, checked."""
    functions = []
    for f in p.functions:
        name, of = normal_function(f.function), f.field.strip()
        functions.append(Function(name, of, f.as_.strip() or f"{name}_{of}"))
    p = replace(p, name=p.name.strip(), policy_tag=p.policy_tag.strip(), functions=tuple(functions), group_by_tags=tuple(t.strip() for t in p.group_by_tags if t.strip()))
    wrong = [
        (not p.name, "name is empty"),
        (not all(p.source), "source is incomplete"),
        (not all(p.target), "target is incomplete"),
        (p.source == p.target, "source and target are the same"),
        (p.interval <= 0, "interval must be positive"),
        (p.refresh_interval <= 0, "refresh interval must be positive"),
        (min(p.delay, p.lookback, p.initial_start, p.run_timeout) < 0, "a duration is negative"),
        (p.batch_size <= 0 or p.checkpoint_interval <= 0, "batch size and checkpoint interval must be positive"),
        (not p.policy_tag, "policy tag is empty"),
        (not functions, "functions are empty"),
        (any(not f.field for f in functions), "a function has no field"),
        (any(f.function not in registry.ANY_TYPE | registry.NUMBERS for f in functions), "a function is not supported"),
        (len({f.as_ for f in functions}) < len(functions), "an output field is doubled"),
    ]
    for bad, why in wrong:
        if bad:
            raise QueryError("invalid-policy", f"downsample {why}")
    return p


def compatible(a: Policy, b: Policy) -> bool:
    """Whether a policy may be replaced without a reset."""
    same = ("name", "source", "target", "interval", "initial_start", "policy_tag", "functions", "group_by_tags")
    return all(getattr(a, s) == getattr(b, s) for s in same)


def floor_to(ts: int, interval: int) -> int:
    return ts - ts % interval


@dataclass(frozen=True)
class Plan:
    """Windows [start, end) of a run; those before ``advance`` are refreshed only."""

    start: int
    advance: int
    end: int
    interval: int

    @property
    def windows(self) -> int:
        return max(0, self.end - self.start) // self.interval

    @property
    def refresh_windows(self) -> int:
        return max(0, min(self.advance, self.end) - self.start) // self.interval


def plan(p: Policy, completed: int, now: int) -> Plan | None:
    """What is due at ``now``: windows up to ``now - delay``, from the watermark less the lookback."""
    until = floor_to(now - p.delay, p.interval)
    if until <= 0:
        return None
    begin = completed or p.initial_start or (until - p.lookback if p.lookback else until - p.interval)
    advance = floor_to(max(0, begin), p.interval)
    start = floor_to(max(0, completed - p.lookback), p.interval) if completed > 0 and p.lookback else advance
    start = min(start, advance)
    return Plan(start, advance, until, p.interval) if start < until else None


def plan_range(p: Policy, start: int, end: int, completed: int, advance: bool) -> Plan | None:
    if start < 0 or end < 0 or start >= end:
        raise QueryError("invalid-time-range", "a range needs 0 <= start < end")
    a, b = floor_to(start, p.interval), floor_to(end, p.interval)
    return Plan(a, max(a, min(b, completed)) if advance else b, b, p.interval) if a < b else None


def rollup(m: Measurement, p: Policy, start: int | None = None, end: int | None = None, *, floor: bool = True) -> DataFrame:
    """``(group tags, policy tag, ts, outputs)`` of all windows in [start, end), by one aggregation."""
    m = m.scan(start, None if end is None else end - 1)
    if start is not None:
        m = replace(m, df=m.df.where((F.col("ts") >= start) & (F.col("ts") < end)))
    todo = []
    for f in p.functions:
        if f.field not in m.fields:
            raise QueryError("field-not-found", f"no field {f.field!r}")
        registry.check(f.function, m.fields[f.field])
        kind = "double" if f.function == "derivative" else output_type(f.function, m.fields[f.field])
        todo.append(Spec(OVER_WINDOW.get(f.function, f.function), f.field, f.as_, kind))
    # No group tags collapse all series; a tag that no series has is the way to say so.
    q = Query(group_tags=p.group_by_tags or ("\0",), window=p.interval)
    wide, _ = _grouped(m, q, todo)
    some = F.lit(False)
    for i in range(len(todo)):
        some = some | F.col(f"_v{i}").isNotNull()
    return wide.where(some).select(*(F.col(f"_g{i}").alias(t) for i, t in enumerate(p.group_by_tags)), F.lit(p.name).alias(p.policy_tag), F.col("_w").alias("ts"), *(F.col(f"_v{i}").alias(s.output) for i, s in enumerate(todo)))


@dataclass(frozen=True)
class DryRun:
    policy: str
    start: int
    end: int
    windows: int
    refresh_windows: int
    advance_windows: int
    groups: int
    samples: int
    points: int


@dataclass
class State:
    completed_until: int = 0
    last_run: int = 0
    last_success: int = 0
    last_error: str = ""
    allow_replace: bool = False
    windows: int = 0
    points: int = 0


@dataclass
class Downsampler:
    """Policies over a store; policies and watermarks live beside its catalog."""

    store: Store
    clock: Callable[[], int] = time.time_ns
    policies: dict[str, Policy] = field(default_factory=dict)
    states: dict[str, State] = field(default_factory=dict)

    def __post_init__(self):
        saved = self.store.files.read_json(self._path, {})
        for name, x in saved.items():
            p = x["policy"] | {"functions": tuple(Function(**f) for f in x["policy"]["functions"]), "group_by_tags": tuple(x["policy"]["group_by_tags"])}
            self.policies[name], self.states[name] = Policy(**p), State(**x["state"])

    @property
    def _path(self) -> str:
        return f"{self.store.root}/downsample.json"

    def _save(self) -> None:
        with self.store.lock:
            self.store.files.write_json(self._path, {n: {"policy": asdict(p), "state": asdict(self.states[n])} for n, p in self.policies.items()})

    def _get(self, name: str) -> Policy:
        if name not in self.policies:
            raise QueryError("not-found", f"no policy {name!r}")
        return self.policies[name]

    def create(self, policy: Policy) -> Policy:
        p = normalized(policy)
        old = self.policies.get(p.name)
        if old and not compatible(old, p) and not self.states[p.name].allow_replace:
            raise QueryError("invalid-policy", f"policy {p.name!r} changes incompatibly; reset it before")
        self.policies[p.name] = p
        self.states.setdefault(p.name, State()).allow_replace = False
        self._save()
        return p

    def get(self, name: str) -> Policy:
        return self._get(name)

    def list(self) -> list[Policy]:
        return [self.policies[n] for n in sorted(self.policies)]

    def enable(self, name: str, enabled: bool = True) -> None:
        self.policies[name] = replace(self._get(name), enabled=enabled)
        self._save()

    def disable(self, name: str) -> None:
        self.enable(name, False)

    def drop(self, name: str, *, cleanup: bool = False, start: int = 0, end: int = 0) -> None:
        p = self._get(name)
        if cleanup:
            self._clean(p, start, end)
        del self.policies[name], self.states[name]
        self._save()

    def reset(self, name: str, *, completed_until: int = 0, allow_replace: bool = False, cleanup: bool = False, start: int = 0, end: int = 0) -> None:
        p, s = self._get(name), self.states[name]
        if cleanup:
            self._clean(p, start, end)
        s.completed_until, s.allow_replace, s.last_error = floor_to(completed_until, p.interval), allow_replace, ""
        self._save()

    def _clean(self, p: Policy, start: int, end: int) -> None:
        try:
            self.store.delete(*p.target, start=start, end=end or (1 << 63) - 1, tags={p.policy_tag: p.name})
        except QueryError as e:
            if e.code not in ("measurement-not-found", "not-found"):
                raise

    def status(self, name: str, now: int | None = None) -> dict:
        p, s, now = self._get(name), self.states[name], self.clock() if now is None else now
        lag = max(0, now - p.delay - s.completed_until) // 1_000_000_000
        return {"policy": name, "enabled": p.enabled, **asdict(s), "next_run": s.last_run + p.refresh_interval if s.last_run else now, "lag_seconds": lag}

    def statuses(self, now: int | None = None) -> list[dict]:
        return [self.status(n, now) for n in sorted(self.policies)]

    def due(self, now: int) -> list[str]:
        return [n for n, p in sorted(self.policies.items()) if p.enabled and now - self.states[n].last_run >= p.refresh_interval]

    def run(self, name: str, now: int | None = None) -> State:
        """Run what is due, then advance the watermark; a failure keeps the watermark and records the error."""
        p, s, now = self._get(name), self.states[name], self.clock() if now is None else now
        if not p.enabled:
            raise QueryError("invalid-policy", f"policy {name!r} is disabled")
        s.last_run = now
        return self._execute(p, s, plan(p, s.completed_until, now), now, advance=True)

    def run_range(self, name: str, start: int, end: int, *, advance: bool = False) -> State:
        p, s = self._get(name), self.states[name]
        got = plan_range(p, start, end, s.completed_until, advance)
        if advance and got and s.completed_until and got.start > s.completed_until:
            raise QueryError("invalid-time-range", "an advancing range must not start after the watermark")
        return self._execute(p, s, got, self.clock(), advance=advance)

    def repair(self, name: str, start: int, end: int) -> State:
        """Recompute a range without moving the watermark."""
        return self.run_range(name, start, end)

    def _execute(self, p: Policy, s: State, todo: Plan | None, now: int, *, advance: bool) -> State:
        """Windows in batches of ``batch_size``, the watermark moved and every ``checkpoint_interval`` batches saved, until all are done or the time is up."""
        s.windows = s.points = 0
        began = time.monotonic_ns()
        try:
            length = p.interval * p.batch_size
            for k, start in enumerate(range(todo.start, todo.end, length) if todo else ()):
                if k and p.run_timeout and time.monotonic_ns() - began > p.run_timeout:
                    raise QueryError("timeout", f"downsample run stopped after {s.windows} of {todo.windows} windows")
                end = min(start + length, todo.end)
                out = rollup(self.store.read(*p.source, start, end - 1), p, start, end).cache()
                n = out.count()
                if n:
                    self.store.write(out, *p.target, tags=[*p.group_by_tags, p.policy_tag])
                out.unpersist()
                s.points += n
                s.windows += (end - start) // p.interval
                if advance:
                    s.completed_until = max(s.completed_until, end)
                if (k + 1) % p.checkpoint_interval == 0:
                    self._save()
            s.last_success, s.last_error = now, ""
        except Exception as e:
            s.last_error = str(e)[:500]
            self._save()
            raise
        self._save()
        return s

    def dry_run(self, name: str, start: int, end: int) -> DryRun:
        p, s = self._get(name), self.states[name]
        got = plan_range(p, start, end, s.completed_until, True)
        if got is None:
            return DryRun(name, start, end, 0, 0, 0, 0, 0, 0)
        groups, samples = estimate(self.store.read(*p.source), p, got.start, got.end).first()
        return DryRun(name, got.start, got.end, got.windows, got.refresh_windows, got.windows - got.refresh_windows, groups, samples, groups * got.windows)


def estimate(m: Measurement, p: Policy, start: int, end: int) -> DataFrame:
    """``(groups, samples)`` of a range: distinct groups and samples of the fields read."""
    m = m.scan(start, end - 1)
    df = m.df.where((F.col("ts") >= start) & (F.col("ts") < end))
    fields = sorted({f.field for f in p.functions})
    samples = sum((F.col(f"`{f}`").isNotNull().cast("bigint") for f in fields[1:]), F.col(f"`{fields[0]}`").isNotNull().cast("bigint"))
    names = [F.coalesce(F.col(f"`{t}`") if t in m.tags else F.lit(None).cast("string"), F.lit("")).alias(f"_g{i}") for i, t in enumerate(p.group_by_tags)]
    one = df.select(*names, samples.alias("n")).where("n > 0").groupBy(*(f"_g{i}" for i in range(len(names)))).agg(F.sum("n").alias("n"))
    return one.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("samples"))
