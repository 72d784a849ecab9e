"""The engine: queries by name over a store and registered tables, downsampling, guards."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from .errors import QueryError
from .operators import execute, predicates
from .operators.aggregate import specs
from .operators.guards import QueryStats, operators, with_stats
from .plans.model import Budget, Query, leaves
from .sources.measurement import Measurement
from .sources.store import Store
from .streaming.downsample import Downsampler


class Engine:
    """Reads and writes measurements. Tables registered with ``register`` take part beside stored ones.

    ``default_limit`` and ``default_budget`` hold where a query sets none; a limit above
    ``max_limit`` is refused. 0 is none.
    """

    def __init__(self, spark: SparkSession, root: str | None = None, *, default_limit: int = 0, max_limit: int = 0, default_budget: Budget | None = None, **store_options):
        self.spark = spark
        self.store = Store(spark, root, **store_options) if root else None
        self.downsample = Downsampler(self.store) if root else None
        self.default_limit, self.max_limit, self.default_budget = default_limit, max_limit, default_budget or Budget()
        self._tables: dict[str, Measurement] = {}
        self.last_stats = QueryStats()

    def register(self, m: Measurement) -> None:
        self._tables[m.name] = m

    def _resolve(self, q: Query) -> tuple[Measurement, Query]:
        if self.max_limit and q.limit > self.max_limit:
            raise QueryError("invalid-pagination", f"limit is above {self.max_limit}")
        if q.budget == Budget():
            q = replace(q, budget=self.default_budget)
        if not q.limit and self.default_limit:
            q = replace(q, limit=self.default_limit)
        if q.measurement in self._tables and not q.database:
            return self._tables[q.measurement], q
        if self.store is None:
            raise QueryError("measurement-not-found", f"no measurement {q.measurement!r}")
        name = (q.database or "default", q.retention_policy or "autogen", q.measurement)
        m = self.store.read(*name, *predicates.scan_bounds(q))
        if q.budget.max_shards or q.budget.max_parts:
            shards = self.store.shards(*name, *predicates.scan_bounds(q))
            parts = len(self.store._table(*name)["parts"])
            if 0 < q.budget.max_shards < len(shards) or 0 < q.budget.max_parts < parts:
                raise QueryError("read-budget-exceeded", f"{len(shards)} shards, {parts} parts")
        return m, q

    def query_rows(self, q: Query) -> DataFrame:
        m, q = self._resolve(q)
        early = execute.first_series(m, q)
        return execute.rows(m, q) if early is None else early

    def query_columns(self, q: Query) -> DataFrame:
        return execute.columns(*self._resolve(q))

    def iterate_rows(self, q: Query):
        return self.query_rows(q).toLocalIterator()

    def iterate_columns(self, q: Query):
        return self.query_columns(q).toLocalIterator()

    def stream_json(self, q: Query, *, columns: bool = False):
        return execute.json_lines(self.query_columns(q) if columns else self.query_rows(q))

    def page(self, q: Query) -> tuple[DataFrame, str | None]:
        """One page of rows and the cursor of the next; a page of over ``execute.PAGE`` rows is a plan, which no row has been fetched for."""
        m, q = self._resolve(q)
        if q.limit > execute.PAGE and not q.aggregates:
            return execute.long_page(m, q)
        got = execute.rows(m, q, keep_series=True)
        if not q.limit:
            return got.drop("series_id", "exact_ts"), None
        # At most ``limit`` rows, which the caller asked to hold.
        page = got.toArrow()
        token = execute.next_cursor(page, q)
        return self.spark.createDataFrame(page, got.schema).drop("series_id", "exact_ts"), token

    def explain(self, q: Query) -> execute.Explained:
        """Spark's plan, what is pushed down, and for stored measurements the cost by the catalog."""
        m, q = self._resolve(q)
        cost = self.cost(q) if self._stored(q) else None
        return replace(execute.explain(m, q, cost.matched_shards if cost else None), cost=cost)

    def _stored(self, q: Query) -> bool:
        return self.store is not None and (bool(q.database) or q.measurement not in self._tables)

    def cost(self, q: Query) -> execute.Cost:
        """Series, shards, parts and samples that a query is expected to touch; only the table of series is read."""
        name = (q.database or "default", q.retention_policy or "autogen", q.measurement)
        table, known = self.store._table(*name), self.store.list_fields(name[0], q.measurement)
        tags, ids = frozenset(table["tags"]), self.store.series_ids(*name)
        if q.tags:
            ids = ids.where(predicates.exact_tags(q.tags, tags))
        for part in execute.conjuncts(q.where):
            if all(p.kind.startswith("tag") for p in leaves(part)):
                ids = ids.where(predicates.tree(part, q, tags, known))
        bounds, every = predicates.scan_bounds(q), self.store.series_ids(*name).count()
        series, fields = ids.count(), len({s.field for s in specs(q.aggregates, known)} or set(q.fields or known))
        hit = [(p, self.store._live(p, *bounds)) for p in table["parts"]]
        hit = [(p, s) for p, s in hit if s]
        shards = len({x for _, s in hit for x in s})
        rows = sum(p.get("rows", 0) * len(s) // len(p["shards"]) for p, s in hit)
        samples = rows * fields * series // max(every, 1)
        samples = min(samples, q.limit) if q.limit else samples
        return execute.Cost(series, fields, len(self.store.shards(*name)), shards, len(table["parts"]), len(hit), rows, samples, execute.plan_class(q, not (series and fields and shards)))

    def measured(self, q: Query, action: Callable[[DataFrame], object], *, profile: bool = False) -> tuple[object, QueryStats]:
        """Run ``action`` on a query's rows; what it took is returned, and kept as ``last_stats`` also if it fails."""
        cost, began = self.cost(q) if self._stored(q) else None, time.perf_counter()
        skipped = cost.candidate_shards - cost.matched_shards if cost else 0
        base = QueryStats(shards_scanned=cost.matched_shards if cost else 0, shards_skipped=skipped, parts=cost.matched_parts if cost else 0)
        try:
            df = self.query_rows(q)
            out, stats = with_stats(df, action)
            self.last_stats = replace(base, rows=stats.rows, seconds=time.perf_counter() - began, operators=operators(df, action) if profile else ())
            return out, self.last_stats
        except Exception as e:
            budget = isinstance(e, QueryError) and e.code == "read-budget-exceeded"
            self.last_stats = replace(base, seconds=time.perf_counter() - began, errors=1, budget_errors=int(budget))
            raise
