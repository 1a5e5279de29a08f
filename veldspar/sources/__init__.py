"""Providers: who owns an entity and how its rows become a DataFrame."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..errors import LookupLimitError, PlanningError

Scope = Callable[[Any], Callable[[DataFrame], Column] | None]


@dataclass(frozen=True)
class Fragment:
    """What a provider is asked to run whole: the statement, its relations, and the operators of its parsed plan."""

    provider: str
    entity: str
    sql: str
    relations: tuple[str, ...]
    operators: frozenset[str]


@dataclass(frozen=True)
class Refusal:
    """Why a provider doesn't take a fragment, and what finishing it elsewhere is estimated to cost."""

    reason: str
    cost: float | None = None


@dataclass(frozen=True)
class ScanRequest:
    """A scan's terms, by number: filters (column, operator, value), sort terms (column, direction), limit and offset."""

    columns: tuple[str, ...]
    filters: tuple[tuple[str, str, Any], ...] = ()
    order_by: tuple[tuple[str, str], ...] = ()
    limit: int | None = None
    offset: int | None = None


@dataclass(frozen=True)
class ScanPlan:
    """A source's answer: its rows after the terms it took; ``filters`` and ``sorted`` say which, ``limited`` whether limit and offset are done.

    What it did not take is done by Spark. A limit counts only with all filters and the sort.
    """

    rows: DataFrame
    filters: frozenset[int] = frozenset()
    sorted: bool = False
    limited: bool = False


@dataclass(frozen=True)
class Entity:
    """A physical entity of a provider. ``scope(context)`` gives a row filter, applied before anything else."""

    provider: str
    name: str
    loader: Callable[[SparkSession, Any], DataFrame]
    scope: Scope | None = None
    can_execute: Callable[[Fragment], bool | Refusal] | None = None
    estimate: float | None = None

    plan_scan: Callable[[SparkSession, Any, ScanRequest], ScanPlan | None] | None = None

    def scan(self, spark: SparkSession, context: Any, request: ScanRequest) -> DataFrame:
        """Rows of a request: what the source takes by its ``plan_scan``, the rest as residuals. A scope is a filter that comes first."""
        from ..operators import clause, ordered

        plan = self.plan_scan(spark, context, request) if self.plan_scan and not self.scope else None
        plan = plan or ScanPlan(self.load(spark, context))
        rest = [f for i, f in enumerate(request.filters) if i not in plan.filters]
        counts = request.limit is not None or request.offset
        if plan.limited and (rest or request.order_by and not plan.sorted):
            raise PlanningError(f"{self.provider}.{self.name}: a limit was taken before filters or the sort")
        rows = plan.rows
        for f in rest:
            rows = rows.where(clause(*f))
        if request.order_by and not plan.sorted:
            rows = ordered(rows, list(request.order_by))
        if counts and not plan.limited:
            rows = rows.offset(request.offset or 0)
            rows = rows if request.limit is None else rows.limit(request.limit)
        return rows.select(*request.columns)

    def load(self, spark: SparkSession, context: Any) -> DataFrame:
        rows = self.loader(spark, context)
        predicate = self.scope(context) if self.scope else None
        return rows.where(predicate(rows)) if predicate is not None else rows


class Provider:
    """Base: entities by name, with an optional scope for each."""

    name = "provider"

    def entity(self, name: str, scope: Scope | None = None, **more) -> Entity:
        return Entity(self.name, name, lambda spark, context: self.read(spark, name, context), scope, **more)

    def read(self, spark: SparkSession, name: str, context: Any) -> DataFrame:
        raise NotImplementedError


class FileProvider(Provider):
    """Files below a folder: Parquet by default; filters and columns are pushed into the scan.

    An entity's schema is read from its files once, so a query doesn't start with a job for each of its relations.
    """

    def __init__(self, root: str, name: str = "files", format: str = "parquet", suffix: str | None = None, **options):
        self.root, self.name, self.format, self.suffix, self.options = root.rstrip("/"), name, format, f".{format}" if suffix is None else suffix, options
        self._schemas: dict[str, T.StructType] = {}

    def read(self, spark: SparkSession, name: str, context: Any) -> DataFrame:
        reader = spark.read.format(self.format).options(**self.options)
        if name in self._schemas:
            reader = reader.schema(self._schemas[name])
        rows = reader.load(f"{self.root}/{name}{self.suffix}")
        self._schemas.setdefault(name, rows.schema)
        return rows


class MemoryProvider(Provider):
    """Rows held by the application, for small tables and tests."""

    def __init__(self, tables: dict[str, tuple[list[tuple], str]], name: str = "memory"):
        self.tables, self.name = tables, name

    def read(self, spark: SparkSession, name: str, context: Any) -> DataFrame:
        rows, schema = self.tables[name]
        return spark.createDataFrame(rows, schema)


class FunctionProvider(Provider):
    """Tables backed by functions ``(spark, context) -> DataFrame``."""

    def __init__(self, tables: dict[str, Callable[[SparkSession, Any], DataFrame]], name: str = "functions"):
        self.tables, self.name = tables, name

    def read(self, spark: SparkSession, name: str, context: Any) -> DataFrame:
        return self.tables[name](spark, context)


class JdbcProvider(Provider):
    """Tables of a SQL database: Spark pushes predicates, aggregates, limits, offsets and top-N down."""

    def __init__(self, url: str, name: str = "jdbc", partition: dict[str, tuple[str, int, int, int]] | None = None, **options):
        self.url, self.name, self.partition, self.options = url, name, partition or {}, options

    def reader_options(self, name: str) -> dict[str, str]:
        out = {"url": self.url, "dbtable": name, "pushDownAggregate": "true", "pushDownLimit": "true", "pushDownOffset": "true", "fetchsize": "10000"} | self.options
        if name in self.partition:
            column, low, high, n = self.partition[name]
            out |= {"partitionColumn": column, "lowerBound": str(low), "upperBound": str(high), "numPartitions": str(n)}
        return out

    def read(self, spark: SparkSession, name: str, context: Any) -> DataFrame:
        return spark.read.format("jdbc").options(**self.reader_options(name)).load()


@dataclass
class _Keys(InputPartition):
    keys: tuple

    def __init__(self, keys):
        self.keys = tuple(keys)


def key_value_source(name: str, schema: T.StructType, key: str, fetch: Callable[[tuple], Iterable[dict]], batch: int = 1000, most: int = 100):
    """A Python data source over a store that only answers by key.

    Equality and IN on ``key`` are pushed and fetched in batches, one task for each; a scan without them is refused.
    ``fetch(keys)`` runs on executors and gives rows as dicts.
    """

    class Reader(DataSourceReader):
        def __init__(self):
            self.keys: set | None = None

        def pushFilters(self, filters):
            for f in filters:
                if isinstance(f, (EqualTo, In)) and f.attribute == (key,):
                    wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                    self.keys = wanted if self.keys is None else self.keys & wanted
                else:
                    yield f

        def partitions(self):
            if self.keys is None:
                raise ValueError(f"{name} can only be read by {key}: add an equality or IN on it")
            parts = [list(p) for p in itertools.batched(sorted(k for k in self.keys if k is not None), batch)]
            if len(parts) > most:
                raise ValueError(f"{name}: {len(parts)} lookup batches, at most {most}")
            return [_Keys(p) for p in parts]

        def read(self, partition):
            for row in fetch(partition.keys):
                yield Row(*[row.get(f.name) for f in schema.fields])

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    return Source


#: Settings by which a query's session tells its guardrails to sources.
LOOKUP_KEYS, LOOKUP_BATCHES = "veldspar.lookup.keys", "veldspar.lookup.batches"


class KeyValueProvider(Provider):
    """Hash records fetched by key: tables by name as (schema, key column, fetch).

    ``build_key(name, key)`` makes the store's key and ``decode(name, key, record)`` a row of what it returns; without
    them keys and records are used as they are.
    """

    def __init__(self, tables: dict[str, tuple[T.StructType, str, Callable[[tuple], Iterable[dict]]]], name: str = "kv", batch: int = 1000, most: int = 100, build_key: Callable[[str, Any], Any] | None = None, decode: Callable[[str, Any, dict], dict | None] | None = None):
        self.tables, self.name, self.batch, self.most, self.build_key, self.decode = tables, name, batch, most, build_key, decode

    def read(self, spark: SparkSession, name: str, context: Any) -> DataFrame:
        schema, key, fetch = self.tables[name]
        source = f"{self.name}_{name}"
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        batch, most = int(spark.conf.get(LOOKUP_KEYS, str(self.batch))), int(spark.conf.get(LOOKUP_BATCHES, str(self.most)))
        spark.dataSource.register(key_value_source(source, schema, key, self._fetch(name, fetch), batch, most))
        return spark.read.format(source).load()

    def _fetch(self, name: str, fetch: Callable[[tuple], Iterable[dict]]) -> Callable[[tuple], Iterable[dict]]:
        build, decode = self.build_key, self.decode
        if not build and not decode:
            return fetch

        def run(keys: tuple) -> Iterable[dict]:
            for k, record in zip(keys, fetch(tuple(build(name, k) if build else k for k in keys)), strict=True):
                row = decode(name, k, record) if decode and record else record
                if row:
                    yield row

        return run


def lookup_many(rows: DataFrame, key: str, keys: list, select: list[str] | None = None, where: Column | None = None, keyed: bool = False, rails: Any = None) -> DataFrame:
    """Rows whose key is among ``keys``: null keys match nothing, others count once.

    One scan: few keys are pushed as an IN list, more are joined (as many as the guardrails allow, so the side that is
    broadcast is bounded).  A source that only answers by key gets one IN list for each batch.
    """
    from ..plans.guard import Guardrails

    rails = rails or Guardrails()
    batch, most = rails.max_lookup_keys, rails.max_lookup_batches
    wanted = sorted({k for k in keys if k is not None})
    parts = list(itertools.batched(wanted, batch)) or [()]
    if len(parts) > most:
        raise LookupLimitError(f"{len(parts)} lookup batches, at most {most}")
    if len(parts) == 1:
        out = rows.where(F.col(key).isin(*parts[0]))
    elif keyed:
        out = reduce(DataFrame.union, (rows.where(F.col(key).isin(*p)) for p in parts))
    else:
        found = rows.sparkSession.createDataFrame([(k,) for k in wanted], T.StructType([T.StructField("__key", rows.schema[key].dataType)]))
        out = rows.join(F.broadcast(found), rows[key] == found["__key"], "left_semi")
    out = out.where(where) if where is not None else out
    return out.select(*select) if select else out
