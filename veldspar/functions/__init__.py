"""Column declarations and the expressions that calculated columns are made of."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Logical types and their Spark types.
TYPES = {"text": "string", "integer": "bigint", "real": "double", "blob": "binary", "boolean": "boolean", "timestamp": "timestamp", "date": "date", "datetime": "timestamp", "json": "string"}


@dataclass(frozen=True)
class ColumnSpec:
    """One logical column: a source column, or an expression over the table's other source-backed columns."""

    type: str
    source: str | None = None
    nullable: bool = True
    primary_key: bool = False
    unique: bool = False
    enum: tuple[str, ...] | Callable[[], Iterable[str]] | None = None
    enum_from: tuple[str, str] | None = None
    enum_map: tuple[tuple[str, str], ...] | None = None
    references: tuple[str, str] | None = None
    on_delete: str | None = None
    on_update: str | None = None
    coerce: Callable[[Column], Column] | None = None
    expr: Callable[[Callable[[str], Column]], Column] | None = None
    physical_type: str | None = None
    description: str | None = None

    def values(self) -> tuple[str, ...] | None:
        """The enum's values; a resolver is asked each time."""
        return tuple(self.enum()) if callable(self.enum) else self.enum

    def with_(self, **changes) -> ColumnSpec:
        return replace(self, **changes)


def _of(kind: str):
    def make(source: str | None = None, **options) -> ColumnSpec:
        if "enum" in options and options["enum"] is not None and not callable(options["enum"]):
            options["enum"] = tuple(options["enum"])
        if "enum_map" in options and options["enum_map"] is not None:
            options["enum_map"] = tuple(dict(options["enum_map"]).items())
        return ColumnSpec(kind, source, **options)

    return make


class col:
    """Typed column builders: ``col.integer("o_orderkey")``; ``col.calc("real", lambda c: c("total") / 100)``."""

    string, integer, real, blob, boolean, timestamp, date, datetime, json = map(_of, ("text", "integer", "real", "blob", "boolean", "timestamp", "date", "datetime", "json"))

    @staticmethod
    def id(source: str | None = None, type: str = "text", **options) -> ColumnSpec:
        return _of(type)(source, nullable=False, primary_key=True, **options)

    @staticmethod
    def calc(type: str, expr: Callable[[Callable[[str], Column]], Column], **options) -> ColumnSpec:
        return ColumnSpec(type, None, expr=expr, **options)


class expr:
    """Helpers for calculated columns; each is the native Column operation."""

    literal = staticmethod(F.lit)
    eq = staticmethod(lambda a, b: a == b)
    neq = staticmethod(lambda a, b: a != b)
    gt = staticmethod(lambda a, b: a > b)
    gte = staticmethod(lambda a, b: a >= b)
    lt = staticmethod(lambda a, b: a < b)
    lte = staticmethod(lambda a, b: a <= b)
    add = staticmethod(lambda a, b: a + b)
    subtract = staticmethod(lambda a, b: a - b)
    multiply = staticmethod(lambda a, b: a * b)
    divide = staticmethod(lambda a, b: a / F.nullif(b, F.lit(0)))
    and_ = staticmethod(lambda *xs: reduce(and_, xs))
    or_ = staticmethod(lambda *xs: reduce(or_, xs))
    not_ = staticmethod(lambda a: ~a)


def iso_timestamp(c: Column) -> Column:
    """Coercion of a timestamp to ISO-8601 text in UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def distinct_over(kind: str, value: Column, window) -> Column:
    """count, sum or avg of distinct values over a window, which Spark has no function for; a sum has its values' type."""
    seen = F.collect_set(value).over(window)
    total = F.when(F.size(seen) > 0, F.aggregate(F.slice(seen, F.lit(2), F.greatest(F.size(seen), F.lit(1))), F.element_at(seen, 1), lambda a, x: a + x))
    return {"count": lambda: F.size(seen).cast("long"), "sum": lambda: total, "avg": lambda: total.cast("double") / F.size(seen)}[kind]()
