"""Logical schemas: tables over provider entities, views over anything, checked as a whole when built."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import SchemaError
from .functions import TYPES, ColumnSpec
from .sources import Entity

DDL_TYPES = {"text": "TEXT", "integer": "INTEGER", "real": "REAL", "blob": "BLOB", "boolean": "INTEGER", "timestamp": "TEXT", "date": "TEXT", "datetime": "TEXT", "json": "TEXT"}


@dataclass(frozen=True)
class Constraints:
    """``names`` gives a constraint's name by its columns; a foreign key's fourth and fifth parts are its ON DELETE and ON UPDATE."""

    primary_key: tuple[str, ...] = ()
    unique: tuple[tuple[str, ...], ...] = ()
    foreign_keys: tuple[tuple, ...] = ()
    checks_in: tuple[tuple[str, tuple[Any, ...]], ...] = ()
    names: tuple[tuple[tuple[str, tuple[str, ...]], str], ...] = ()  # ((kind, columns), name); kinds as in DDL, lower case


@dataclass(frozen=True)
class Table:
    name: str
    entity: Entity
    columns: dict[str, ColumnSpec]
    constraints: Constraints = field(default_factory=Constraints)

    @property
    def key(self) -> tuple[str, ...]:
        return self.constraints.primary_key or tuple(n for n, c in self.columns.items() if c.primary_key)

    @property
    def uniques(self) -> list[tuple[str, ...]]:
        return [*self.constraints.unique, *((n,) for n, c in self.columns.items() if c.unique)]

    def load(self, spark: SparkSession, context: Any) -> DataFrame:
        """The declared columns and no others, over the rows in the entity's scope: one projection, so pruning and pushdown reach the source."""
        rows = self.entity.load(spark, context)
        return rows.select(*[self.column(n, rows).alias(n) for n in self.columns])

    def column(self, name: str, rows: DataFrame) -> Column:
        spec = self.columns[name]
        if spec.expr:
            return spec.expr(lambda other: self.column(other, rows)).cast(TYPES[spec.type])
        c = rows[spec.source or name]
        if spec.coerce:
            c = spec.coerce(c)
        if spec.enum_map:
            pairs = [F.lit(x) for pair in spec.enum_map for x in pair]
            c = F.create_map(*pairs)[c]
        return c if spec.type in ("timestamp", "date", "datetime", "json") else c.cast(TYPES[spec.type])


@dataclass(frozen=True)
class View:
    name: str
    factory: Callable[..., DataFrame]
    columns: tuple[str, ...] | None = None


class ViewTools:
    """What a view's factory gets: scans, joins and aggregates over tables, views and raw entities."""

    def __init__(self, spark: SparkSession, context: Any, relation: Callable[[str], DataFrame]):
        self.spark, self.context, self._relation = spark, context, relation

    def scan(self, source: str | Entity, columns: list[str] | None = None) -> DataFrame:
        rows = source.load(self.spark, self.context) if isinstance(source, Entity) else self._relation(source)
        return rows.select(*columns) if columns else rows

    @staticmethod
    def join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, kind: str = "inner") -> DataFrame:
        return left.join(right, left[left_on] == right[right_on], {"full": "full_outer"}.get(kind, kind))

    @staticmethod
    def aggregate(rows: DataFrame, group_by: list[str], **measures: Column) -> DataFrame:
        return rows.groupBy(*group_by).agg(*[m.alias(n) for n, m in measures.items()])

    count = staticmethod(lambda c=None: F.count(c if c is not None else F.lit(1)))
    count_distinct = staticmethod(F.count_distinct)
    sum, sum_distinct, avg, min, max = map(staticmethod, (F.sum, F.sum_distinct, F.avg, F.min, F.max))
    avg_distinct = staticmethod(lambda c: F.expr(f"avg(DISTINCT {c})") if isinstance(c, str) else F.sum_distinct(c) / F.count_distinct(c))


@dataclass(frozen=True)
class Schema:
    tables: dict[str, Table]
    views: dict[str, View]

    def enums(self) -> dict[tuple[str, str], tuple[str, ...]]:
        """Allowed values by (table, column), through ``enum_from`` links; a mapped enum has its logical values."""
        out = {}
        for t in self.tables.values():
            for n in t.columns:
                if values := self._enum(t.name, n, set()):
                    out[t.name, n] = values
        return out

    def _enum(self, table: str, column: str, seen: set) -> tuple[str, ...] | None:
        if (table, column) in seen or table not in self.tables or column not in self.tables[table].columns:
            return None
        spec = self.tables[table].columns[column]
        if spec.enum_from:
            return self._enum(*spec.enum_from, seen | {(table, column)})
        return spec.values()

    def to_sql_ddl(self, if_not_exists: bool = False) -> str:
        """CREATE TABLE statements of all tables; views have none."""
        out = []
        for t in self.tables.values():
            lines, named = [], dict(t.constraints.names)
            mark = lambda kind, cols: f'CONSTRAINT "{named[kind, tuple(cols)]}" ' if (kind, tuple(cols)) in named else ""  # noqa: B023, E731
            for n, c in t.columns.items():
                if c.expr:
                    continue
                note = f" /* {c.description.replace('*/', '* /')} */" if c.description else ""
                lines.append(f'"{n}" {c.physical_type or DDL_TYPES[c.type]}' + " NOT NULL" * (not c.nullable) + note)
                if c.enum and not c.enum_map:
                    lines.append(mark("check", (n,)) + f'CHECK ("{n}" IN ({", ".join(map(_literal, c.values()))}))')
                if c.references:
                    lines.append(mark("foreign key", (n,)) + _foreign((n,), c.references[0], (c.references[1],), c.on_delete, c.on_update))
            lines += [mark("primary key", t.key) + f"PRIMARY KEY ({_names(t.key)})"] * bool(t.key) + [mark("unique", u) + f"UNIQUE ({_names(u)})" for u in t.uniques]
            lines += [mark("foreign key", f[0]) + _foreign(*f) for f in t.constraints.foreign_keys]
            lines += [mark("check", (c,)) + f'CHECK ("{c}" IN ({", ".join(map(_literal, vs))}))' for c, vs in t.constraints.checks_in]
            lines.sort(key=lambda x: not x.startswith('"'))
            out.append(f'CREATE TABLE {"IF NOT EXISTS " * if_not_exists}"{t.name}" (\n  ' + ",\n  ".join(lines) + "\n);")
        return "\n\n".join(out)


def _names(names) -> str:
    return ", ".join(f'"{n}"' for n in names)


def _literal(v: Any) -> str:
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def _foreign(columns, table: str, to, on_delete: str | None = None, on_update: str | None = None) -> str:
    return f'FOREIGN KEY ({_names(columns)}) REFERENCES "{table}" ({_names(to)})' + (f" ON DELETE {on_delete}" if on_delete else "") + (f" ON UPDATE {on_update}" if on_update else "")


class SchemaBuilder:
    """``table()`` and ``view()`` declare, ``build()`` checks everything and reports all problems at once."""

    def __init__(self):
        self._tables: list[Table] = []
        self._views: list[View] = []

    def table(self, name: str, entity: Entity, columns: dict[str, ColumnSpec], constraints: Constraints | None = None) -> SchemaBuilder:
        self._tables.append(Table(name, entity, dict(columns), constraints or Constraints()))
        return self

    def view(self, name: str, factory: Callable[..., DataFrame], columns: list[str] | None = None) -> SchemaBuilder:
        self._views.append(View(name, factory, tuple(columns) if columns else None))
        return self

    def build(self) -> Schema:
        issues, seen = [], set()
        for x in [*self._tables, *self._views]:
            if not x.name.strip():
                issues.append("a table or view has no name")
            if x.name.lower() in seen:
                issues.append(f"{x.name}: declared twice")
            seen.add(x.name.lower())
        schema = Schema({t.name: t for t in self._tables}, {v.name: v for v in self._views})
        for t in self._tables:
            issues += self._issues(t, schema)
        if issues:
            raise SchemaError(issues)
        return schema

    @staticmethod
    def _issues(t: Table, schema: Schema) -> list[str]:
        out = []
        if not t.columns:
            out.append(f"{t.name}: no columns")
        for n, c in t.columns.items():
            if c.type not in TYPES:
                out.append(f"{t.name}.{n}: unknown type {c.type}")
            if c.primary_key and c.unique:
                out.append(f"{t.name}.{n}: primary key and unique at once")
            if c.enum is not None and not c.values():
                out.append(f"{t.name}.{n}: empty enum")
            if (c.enum or c.enum_from) and c.type != "text":
                out.append(f"{t.name}.{n}: only text has enums")
            if c.enum_from and schema._enum(t.name, n, set()) is None:
                out.append(f"{t.name}.{n}: enum_from names no enum")
            if c.enum_map and c.enum and {v for _, v in c.enum_map} - set(c.values()):
                out.append(f"{t.name}.{n}: enum_map leads outside the enum")
            if c.references and (c.references[0] not in schema.tables or c.references[1] not in schema.tables[c.references[0]].columns):
                out.append(f"{t.name}.{n}: references an unknown column")
            if c.expr:
                used: list[str] = []
                try:
                    c.expr(lambda other, used=used: (used.append(other), F.lit(1))[1])
                except Exception as e:
                    out.append(f"{t.name}.{n}: its expression fails: {e}")
                for other in used:
                    if other not in t.columns:
                        out.append(f"{t.name}.{n}: uses an unknown column {other}")
                    elif t.columns[other].expr:
                        out.append(f"{t.name}.{n}: uses the calculated column {other}")
        k = t.constraints
        if k.primary_key and any(c.primary_key for c in t.columns.values()):
            out.append(f"{t.name}: two primary keys")
        for names in [k.primary_key, *k.unique, *[f[0] for f in k.foreign_keys], *[(c,) for c, _ in k.checks_in]]:
            out += [f"{t.name}: a constraint names an unknown column {n}" for n in names if n not in t.columns]
        for _, table, to, *_ in k.foreign_keys:
            if table not in schema.tables or any(n not in schema.tables[table].columns for n in to):
                out.append(f"{t.name}: a foreign key names an unknown table or column")
        return out
