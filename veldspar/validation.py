"""Constraint checks over whole tables: counts of rows that break NOT NULL, keys, enums and CHECK IN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import ConstraintError
from .plans.guard import Diagnostic
from .schema import Schema, Table

KINDS = "constraint string, columns string, violations bigint"


def violations(rows: DataFrame, table: Table, schema: Schema) -> DataFrame:
    """(constraint, columns, violations), one row for each declared constraint."""
    enums = schema.enums()
    simple = [("not_null", n, F.col(n).isNull()) for n, c in table.columns.items() if not c.nullable or n in table.key]
    simple += [("enum", n, F.col(n).isNotNull() & ~F.col(n).isin(*enums[table.name, n])) for n in table.columns if (table.name, n) in enums]
    simple += [("check_in", n, F.col(n).isNotNull() & ~F.col(n).isin(*vs)) for n, vs in table.constraints.checks_in]
    parts = []
    if simple:
        # All row-wise checks in one pass without a shuffle of rows.
        counted = rows.agg(*[F.count_if(c).alias(f"v{i}") for i, (_, _, c) in enumerate(simple)])
        each = [F.struct(F.lit(kind).alias("constraint"), F.lit(n).alias("columns"), F.col(f"v{i}").alias("violations")) for i, (kind, n, _) in enumerate(simple)]
        parts.append(counted.select(F.inline(F.array(*each))))
    for kind, names in [("primary_key", table.key)] * bool(table.key) + [("unique", u) for u in table.uniques]:
        present = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
        twice = rows.where(present).groupBy(*names).agg(F.count("*").alias("n")).where("n > 1")
        parts.append(twice.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(F.lit(kind).alias("constraint"), F.lit(",".join(names)).alias("columns"), "violations"))
    return reduce(DataFrame.union, parts) if parts else rows.sparkSession.createDataFrame([], KINDS)


def enforce(rows: DataFrame, table: Table, schema: Schema, mode: str) -> list[Diagnostic]:
    """``off``, ``warn`` (diagnostics) or ``error``."""
    if mode == "off":
        return []
    broken = [(table.name, r[0], r[1].split(","), r[2]) for r in violations(rows, table, schema).where("violations > 0").collect()]
    if broken and mode == "error":
        raise ConstraintError(broken)
    return [Diagnostic("VELD_WARN_CONSTRAINT", f"{t}: {kind} on {', '.join(cols)} broken by {n} rows", sqlstate="23000") for t, kind, cols, n in broken]
