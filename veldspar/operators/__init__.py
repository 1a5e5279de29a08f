"""Relational operators as DataFrame functions, one for each of the engine's logical operators.

All are declarative: Catalyst prunes, pushes down and picks the physical join or aggregate.
"""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import LookupLimitError, UnsupportedError
from ..plans.guard import Guardrails
from ..plans.recursion import fixpoint as recursive_union  # noqa: F401
from ..sources import lookup_many  # noqa: F401


def clause(column: str | Column, op: str, value: Any = None) -> Column:
    """One scan filter, as SQL has it: a NULL entry of an IN list matches nothing, and one of a NOT IN list leaves nothing."""
    c = F.col(column) if isinstance(column, str) else column
    match op:
        case "eq":
            return c == value
        case "neq":
            return c != value
        case "gt":
            return c > value
        case "gte":
            return c >= value
        case "lt":
            return c < value
        case "lte":
            return c <= value
        case "in":
            return c.isin(*value)
        case "not_in":
            return ~c.isin(*value)
        case "like":
            return c.like(value.replace("\\", "\\\\"))
        case "not_like":
            return ~c.like(value.replace("\\", "\\\\"))
        case "is_distinct_from":
            return ~c.eqNullSafe(value)
        case "is_not_distinct_from":
            return c.eqNullSafe(value)
        case "is_null":
            return c.isNull()
        case "is_not_null":
            return c.isNotNull()
    raise UnsupportedError(f"no filter operator {op}")


def scan(rows: DataFrame, select: list[str] | None = None, where: list[tuple] = (), order_by: list[tuple[str, str]] = (), limit: int | None = None, offset: int | None = None) -> DataFrame:
    """Filter, sort, offset, limit, project, in this order."""
    out = filtered(rows, where)
    if order_by:
        out = ordered(out, order_by)
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*select) if select else out


def filtered(rows: DataFrame, where: list[tuple] = (), expr: Column | None = None) -> DataFrame:
    terms = [clause(*w) for w in where] + ([expr] if expr is not None else [])
    return rows.where(reduce(and_, terms)) if terms else rows


def project(rows: DataFrame, **columns: str | Column) -> DataFrame:
    return rows.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def ordered(rows: DataFrame, terms: list[tuple[str, str]]) -> DataFrame:
    """NULL is the smallest value: first ascending, last descending."""
    return rows.orderBy(*[F.col(c).asc_nulls_first() if d == "asc" else F.col(c).desc_nulls_last() for c, d in terms])


def top_k(rows: DataFrame, terms: list[tuple[str, str]], k: int) -> DataFrame:
    return ordered(rows, terms).limit(k)


KINDS = {"inner": "inner", "left": "left_outer", "right": "right_outer", "full": "full_outer", "semi": "left_semi", "anti": "left_anti"}


def join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, kind: str = "inner") -> DataFrame:
    """Equi-join; NULL keys never match."""
    return left.join(right, left[left_on] == right[right_on], KINDS[kind])


def lookup_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, kind: str = "inner", keyed: bool = False, rails: Guardrails = Guardrails()) -> DataFrame:
    """Join that needs only the right rows whose key occurs on the left.

    Files and databases are joined as they are: one scan of each side, which Spark prunes at run time.  A source that only
    answers by key (``keyed``) gets the distinct keys as IN lists, within the guardrails' number of keys and batches.
    """
    if kind not in ("inner", "left"):
        raise LookupLimitError("lookup joins are inner or left")
    if keyed:
        most = rails.max_lookup_keys * rails.max_lookup_batches
        found = [r[0] for r in left.where(F.col(left_on).isNotNull()).select(left_on).distinct().limit(most + 1).collect()]
        if len(found) > most:
            raise LookupLimitError(f"more than {most} lookup keys")
        right = lookup_many(right, right_on, found, keyed=True, rails=rails)
    return left.join(right, left[left_on] == right[right_on], KINDS[kind])


def metric(fn: str, column: str | None = None, distinct: bool = False) -> Column:
    if fn == "count" and column is None:
        return F.count(F.lit(1))
    c = F.col(column)
    if distinct:
        return {"count": F.count_distinct(c), "sum": F.sum_distinct(c), "avg": F.sum_distinct(c) / F.count_distinct(c), "min": F.min(c), "max": F.max(c)}[fn]
    return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[fn](c)


def aggregate(rows: DataFrame, group_by: list[str], metrics: dict[str, tuple], having: Column | None = None) -> DataFrame:
    """Partial and final aggregates; one row for no groups."""
    out = rows.groupBy(*group_by).agg(*[metric(*m).alias(n) for n, m in metrics.items()])
    return out.where(having) if having is not None else out


def window(rows: DataFrame, name: str, fn: str, args: tuple = (), partition_by: list[str] = (), order_by: list[tuple[str, str]] = (), frame: tuple[int | None, int | None] | None = None) -> DataFrame:
    """Add one window column; ``frame`` is in rows, None for unbounded."""
    w = Window.partitionBy(*partition_by)
    if order_by:
        w = w.orderBy(*[F.col(c).asc_nulls_first() if d == "asc" else F.col(c).desc_nulls_last() for c, d in order_by])
    if frame:
        w = w.rowsBetween(Window.unboundedPreceding if frame[0] is None else frame[0], Window.unboundedFollowing if frame[1] is None else frame[1])
    made = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "lead": F.lead, "lag": F.lag, "first_value": F.first_value, "count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}
    if fn not in made:
        raise UnsupportedError(f"no window function {fn}")
    return rows.withColumn(name, made[fn](*(args or (("*",) if fn == "count" else ()))).over(w))


def set_op(op: str, *parts: DataFrame) -> DataFrame:
    """Left-associative; columns align by position to the first part's names."""
    do = {"union_all": DataFrame.union, "union": lambda a, b: a.union(b).distinct(), "intersect": DataFrame.intersect, "except": DataFrame.subtract}[op]
    return reduce(lambda a, b: do(a, b.toDF(*a.columns)), parts)
