"""Random points against a plain Python model of the semantics."""

import math
import random
from collections import Counter, defaultdict

import pytest

from tidemark.operators import execute
from tidemark.plans.builder import QueryBuilder
from tidemark.sources.measurement import Measurement

S = 1_000_000_000


def model(fn, samples):
    """``samples``: (ts, host, value) of one group; the function's value or None."""
    by_time = sorted(samples)
    v = [x for _, _, x in by_time]
    steps = [b - a if b >= a else b for a, b in zip(v, v[1:], strict=False)]
    span = (by_time[-1][0] - by_time[0][0]) / S
    if fn == "mode":
        seen, best, most = Counter(), None, 0
        for _, _, x in sorted(samples, key=lambda s: (s[1], s[0])):
            seen[x] += 1
            if seen[x] > most:
                best, most = x, seen[x]
        # the one that first reaches the highest count
        most, seen = max(seen.values()), Counter()
        for _, _, x in sorted(samples, key=lambda s: (s[1], s[0])):
            seen[x] += 1
            if seen[x] == most:
                return x
    mean = sum(v) / len(v)
    last = (by_time[-1][0] - by_time[-2][0]) / S if len(v) > 1 else 0
    return {
        "count": lambda: len(v), "sum": lambda: sum(v), "avg": lambda: mean, "min": lambda: min(v), "max": lambda: max(v), "first": lambda: v[0], "last": lambda: v[-1], "spread": lambda: max(v) - min(v),
        "median": lambda: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2, "stdvar": lambda: sum((x - mean) ** 2 for x in v) / len(v),
        "delta": lambda: v[-1] - v[0] if len(v) > 1 else None, "increase": lambda: sum(steps) if len(v) > 1 else None, "rate": lambda: sum(steps) / span if span > 0 else None, "irate": lambda: steps[-1] / last if last > 0 else None,
    }[fn]()


FUNCTIONS = ("count", "sum", "avg", "min", "max", "first", "last", "spread", "median", "stdvar", "delta", "increase", "rate", "irate", "mode")


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("window,tags", [(0, ()), (7 * S, ()), (0, ("zone",)), (11 * S, ("zone",))])
def test_aggregates_match_the_model(spark, seed, window, tags):
    r = random.Random(seed)
    points = {(r.choice("ab"), f"h{r.randrange(4)}", r.randrange(60) * S + r.randrange(3)): float(r.randrange(6)) for _ in range(150)}
    rows = [(z, h, t, v if r.random() < 0.9 else None) for (z, h, t), v in points.items()]
    m = Measurement(spark.createDataFrame(rows, "zone string, host string, ts long, v double"), "m", ("zone", "host"), {"v": "double"})
    b = QueryBuilder().from_measurement("m").group_by_tags(*tags).group_by_time(window)
    for fn in FUNCTIONS:
        b = b.aggregate(fn, "v")
    got = defaultdict(dict)
    for x in execute.columns(m, b.build()).collect():
        value = next(v for k, v in x.asDict().items() if k.startswith("value_") and v is not None)
        key = (x.zone, *(() if tags else (x.host,)), x.ts if window else None)
        got[key][x.field.split("(")[0]] = value
    groups = defaultdict(list)
    for z, h, t, v in rows:
        if v is not None:
            groups[z, *(() if tags else (h,)), t - t % window if window else None].append((t, (h, z), v))
    assert set(got) == set(groups)
    for key, samples in groups.items():
        for fn in FUNCTIONS:
            want = model(fn, samples)
            have = got[key].get(fn)
            assert (have is None) == (want is None) and (want is None or math.isclose(have, want, abs_tol=1e-9)), (fn, key)
