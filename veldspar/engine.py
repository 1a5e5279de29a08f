"""The facade: SELECT statements over a declared schema, answered by Spark."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .errors import BindingError, ColumnError, EngineError, ExecutionError, GuardrailError, ParseError, QueryTimeout, RelationError
from .plans import dialect, guard, recursion
from .schema import Schema, ViewTools
from .sources import LOOKUP_BATCHES, LOOKUP_KEYS
from .validation import enforce

#: Settings of a query's own session; paths can't be queried, only declared relations.
CONF = {"spark.sql.runSQLOnFiles": "false", "spark.sql.parser.escapedStringLiterals": "true", "spark.sql.ansi.enabled": "false", "spark.sql.cteRecursionLevelLimit": "256"}
#: Settings that a query's session takes over from the caller's.
SHARED = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes")


@dataclass
class Explanation:
    sql: str
    spark_sql: str
    mode: str
    parsed: str
    analysed: str
    optimized: str
    physical: str
    fragments: list[tuple[str, str, str]]
    diagnostics: list[guard.Diagnostic] = field(default_factory=list)

    def __str__(self) -> str:
        parts = [("parsed", self.parsed), ("analysed", self.analysed), ("optimized", self.optimized), ("physical", self.physical)]
        return "\n".join(f"== {n} ==\n{t}" for n, t in parts)


class Engine:
    """One schema on one Spark session. ``query`` gives a lazy DataFrame; ``rows`` runs it under the guardrails."""

    def __init__(self, spark: SparkSession, schema: Schema, rails: guard.Guardrails | None = None, policy: guard.FallbackPolicy | None = None, constraints: str = "off"):
        if constraints not in ("off", "warn", "error"):
            raise BindingError(f"constraint validation is off, warn or error, not {constraints}")
        for t in schema.tables.values():
            if not callable(t.entity.loader):
                raise BindingError(f"{t.name}: its entity has no loader")
        self.spark, self.schema, self.rails, self.policy, self.constraints = spark, schema, rails or guard.Guardrails(), policy or guard.FallbackPolicy(), constraints

    # -- sessions of a request -------------------------------------------------------------------------------

    def _session(self, context: Any) -> SparkSession:
        child = self.spark.newSession()
        for k in SHARED:
            if (v := self.spark.conf.get(k, None)) is not None:
                child.conf.set(k, v)
        for k, v in CONF.items():
            child.conf.set(k, v)
        child.conf.set("spark.sql.cteRecursionLevelLimit", str(self.rails.max_recursion))
        child.conf.set(LOOKUP_KEYS, str(self.rails.max_lookup_keys))
        child.conf.set(LOOKUP_BATCHES, str(self.rails.max_lookup_batches))
        return child

    def _relations(self, child: SparkSession, context: Any, ts: list[dialect.Token], used: list) -> list[guard.Diagnostic]:
        """Temp views of the relations that the statement names, and of what views need."""
        made: dict[str, DataFrame] = {}
        notes: list[guard.Diagnostic] = []

        def relation(name: str) -> DataFrame:
            key = next((n for n in [*self.schema.tables, *self.schema.views] if n.lower() == name.lower()), None)
            if key is None:
                raise RelationError(f"unknown relation {name}")
            if key not in made:
                if key in self.schema.tables:
                    table = self.schema.tables[key]
                    made[key] = table.load(child, context)
                    used.append(table.entity)
                    notes.extend(enforce(made[key], table, self.schema, self.constraints))
                else:
                    view = self.schema.views[key]
                    rows = view.factory(ViewTools(child, context, relation))
                    made[key] = rows.select(*view.columns) if view.columns else rows
            return made[key]

        words = {dialect.name_of(t).lower() for t in ts if t.kind in ("word", "quoted")}
        for name in [*self.schema.tables, *self.schema.views]:
            if name.lower() in words:
                relation(name).createOrReplaceTempView(name)
        return notes

    # -- queries ---------------------------------------------------------------------------------------------

    def _prepare(self, sql: str, context: Any) -> tuple[SparkSession, str, list[guard.Diagnostic]]:
        ts = dialect.single(sql)
        guard.check_enums(ts, self.schema)
        child = self._session(context)
        used: list = []
        notes = self._relations(child, context, ts, used)
        allowed = {n.lower() for n in [*self.schema.tables, *self.schema.views]}
        ts = self._distinct_recursion(child, ts, allowed)
        ts = dialect.grouped(ts, lambda rows: guard.repeatable(child, rows, allowed))
        spark_sql = dialect.text(dialect.rewritten(ts))
        tree = guard.admitted(child, spark_sql, allowed)
        return child, spark_sql, guard.fallback(used, self.policy, spark_sql, tree) + notes

    def _distinct_recursion(self, child: SparkSession, ts: list[dialect.Token], allowed: set[str]) -> list[dialect.Token]:
        """Replace recursive CTEs joined by UNION with views that hold their fixpoint."""
        recursive, ctes, main = dialect.ctes(ts)
        if not recursive:
            return ts
        done: list[dialect.Cte] = []
        for cte in ctes:
            sides = dialect.split_union(cte.body)
            if not sides or not dialect.mentions(sides[1], cte.name):
                done.append(cte)
                continue
            if any(dialect.mentions(cte.body, c.name) for c in done):
                before = "WITH RECURSIVE " + ", ".join(_cte_sql(c) for c in done) + " "
            else:
                before = ""
            run = lambda body: before + dialect.text(dialect.rewritten(body))  # noqa: E731, B023
            name = cte.name
            guard.admitted(child, run(sides[0]), allowed)
            guard.admitted(child, run(sides[1]), allowed | {name.lower()})
            anchor = child.sql(run(sides[0]))
            if cte.columns:
                anchor = anchor.toDF(*cte.columns)

            def step(delta: DataFrame, body=sides[1]) -> DataFrame:
                delta.createOrReplaceTempView(name)  # noqa: B023
                return child.sql(run(body))  # noqa: B023

            recursion.fixpoint(anchor, step, self.rails.max_recursion).createOrReplaceTempView(name)
            allowed.add(name.lower())
        if len(done) == len(ctes):
            return ts
        if not done:
            return main
        return dialect.tokens("WITH RECURSIVE " + ", ".join(_cte_sql(c) for c in done)) + main

    def query(self, sql: str, context: Any = None) -> DataFrame:
        child, spark_sql, _ = self._prepare(sql, context)
        return self._analysed(child, spark_sql)

    def _analysed(self, child: SparkSession, spark_sql: str) -> DataFrame:
        try:
            df = child.sql(spark_sql)
        except AnalysisException as e:
            kind = ColumnError if "COLUMN" in (e.getCondition() or "") else RelationError if "TABLE_OR_VIEW" in (e.getCondition() or "") else ParseError
            raise kind(str(e).split("\n")[0]) from None
        guard.count_nodes(df._jdf.queryExecution().analyzed().treeString(), self.rails)
        return df

    def rows(self, sql: str, context: Any = None) -> list:
        """All rows, or an error beyond the guardrails' rows or time; the job is cancelled then."""
        df = self.query(sql, context)
        with self._timed(df.sparkSession) as late:
            try:
                out = df.limit(self.rails.max_rows + 1).collect()
            except Exception as e:
                if late.is_set():
                    raise QueryTimeout(f"more than {self.rails.timeout_ms} ms") from None
                raise e if isinstance(e, EngineError) else ExecutionError(str(e).split("\n")[0]) from e
        if len(out) > self.rails.max_rows:
            raise GuardrailError(f"more than {self.rails.max_rows} rows")
        return out

    @contextmanager
    def _timed(self, spark: SparkSession) -> Iterator[threading.Event]:
        sc, tag, late = spark.sparkContext, f"veldspar-{uuid.uuid4().hex}", threading.Event()

        def stop():
            late.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(self.rails.timeout_ms / 1000, stop)
        timer.daemon = True
        sc.addJobTag(tag)
        timer.start()
        try:
            yield late
        finally:
            timer.cancel()
            sc.removeJobTag(tag)

    def explain(self, sql: str, context: Any = None, mode: str = "basic") -> Explanation:
        """Plans at every stage; ``enriched`` has the formatted physical plan, with what each source was pushed."""
        child, spark_sql, notes = self._prepare(sql, context)
        df = self._analysed(child, spark_sql)
        q = df._jdf.queryExecution()
        physical = q.explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")) if mode == "enriched" else q.executedPlan().treeString()
        words = {dialect.name_of(t).lower() for t in dialect.single(sql) if t.kind in ("word", "quoted")}
        fragments = [(t.name, t.entity.provider, t.entity.name) for t in self.schema.tables.values() if t.name.lower() in words]
        return Explanation(sql, spark_sql, mode, q.logical().treeString(), q.analyzed().treeString(), q.optimizedPlan().treeString(), physical, fragments, notes)

    def session(self, sql: str, context: Any = None) -> QuerySession:
        """Steps of a query; one step only if one provider takes the whole statement."""
        words = {dialect.name_of(t).lower() for t in dialect.single(sql) if t.kind in ("word", "quoted")}
        used = [t.entity for t in self.schema.tables.values() if t.name.lower() in words]
        views = any(n.lower() in words for n in self.schema.views)
        if used and not views and len({e.provider for e in used}) == 1 and all(e.can_execute for e in used):
            tree = guard.parsed(self.spark, dialect.to_spark(sql)).treeString()
            if not guard.fallback(used, guard.FallbackPolicy(), sql, tree):
                return FragmentSession(self, sql, context, used[0].provider)
        return QuerySession(self, sql, context)


def _cte_sql(c: dialect.Cte) -> str:
    return c.name + (f"({', '.join(c.columns)})" if c.columns else "") + f" AS ({dialect.text(c.body)})"


@dataclass
class Step:
    id: str
    operator: str
    depends_on: list[str]
    state: str = "pending"
    rows: int | None = None
    ms: float | None = None


class QuerySession:
    """A query seen as steps: the plan's operators, children first.

    It runs once, on the first ``next``; finished steps are replayed in the plan's order, and the last has the row count.
    """

    def __init__(self, engine: Engine, sql: str, context: Any = None):
        self.engine, self.df = engine, engine.query(sql, context)
        self.steps: list[Step] = []
        self._walk(self.df._jdf.queryExecution().optimizedPlan())
        self._result: list | None = None
        self._at = 0

    def _walk(self, node) -> str:
        children = node.children()
        below = [self._walk(children.apply(i)) for i in range(children.size())]
        step = Step(f"step_{len(self.steps)}", node.nodeName(), below)
        self.steps.append(step)
        return step.id

    def plan(self) -> list[Step]:
        return list(self.steps)

    def _run(self) -> None:
        if self._result is not None:
            return
        began = time.monotonic()
        with self.engine._timed(self.df.sparkSession) as late:
            try:
                out = self.df.limit(self.engine.rails.max_rows + 1).collect()
            except Exception as e:
                self.steps[-1].state = "failed"
                if late.is_set():
                    raise QueryTimeout(f"more than {self.engine.rails.timeout_ms} ms") from None
                raise ExecutionError(str(e).split("\n")[0]) from e
        if len(out) > self.engine.rails.max_rows:
            self.steps[-1].state = "failed"
            raise GuardrailError(f"more than {self.engine.rails.max_rows} rows")
        self._result = out
        self.steps[-1].rows, self.steps[-1].ms = len(out), (time.monotonic() - began) * 1000

    def next(self) -> Step | None:
        """The next finished step; None after the last."""
        self._run()
        if self._at == len(self.steps):
            return None
        step = self.steps[self._at]
        step.state = "done"
        self._at += 1
        return step

    def run_to_completion(self) -> list:
        while self.next():
            pass
        return self._result

    def result(self) -> list | None:
        return self._result

    def step_state(self, id: str) -> Step:
        return next(s for s in self.steps if s.id == id)


class FragmentSession(QuerySession):
    """A query that one provider takes whole: a single step."""

    def __init__(self, engine: Engine, sql: str, context: Any, provider: str):
        self.provider = provider
        super().__init__(engine, sql, context)
        self.steps = [Step("step_0", f"Fragment({provider})", [])]
