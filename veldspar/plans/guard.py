"""What may run: statement kinds, relations, and the guardrails' numbers."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import SparkSession

from ..errors import EnumError, FallbackError, GuardrailError, ParseError, RelationError, StatementError
from ..schema import Schema
from ..sources import Fragment, Refusal
from .dialect import Token, name_of


@dataclass(frozen=True)
class Guardrails:
    """Defaults are fixed values of the engine that this one stands in for."""

    max_plan_nodes: int = 50_000
    max_rows: int = 1_000_000
    max_lookup_keys: int = 1_000
    max_lookup_batches: int = 100
    timeout_ms: int = 30_000
    max_recursion: int = 256


@dataclass(frozen=True)
class FallbackPolicy:
    """What to do where a provider does not take a query whole."""

    allow: bool = True
    warn: bool = True
    reject_above_cost: float | None = None


@dataclass(frozen=True)
class Diagnostic:
    code: str
    message: str
    severity: str = "warning"
    sqlstate: str = "01000"


_COMMAND = re.compile(r"'?\b(InsertIntoStatement|DeleteFromTable|UpdateTable|MergeIntoTable|Create\w+|Drop\w+|Alter\w+|SetCommand|CacheTable\w*|TruncateTable\w*|LoadData|AddJar\w*|RunnableCommand)\b")


def parsed(spark: SparkSession, sql: str):
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except ParseException as e:
        raise ParseError(str(e).split("\n\nJVM")[0]) from None


def admitted(spark: SparkSession, sql: str, allowed: set[str]) -> str:
    """Parse, and refuse commands and every relation that is neither declared nor a CTE of the statement."""
    tree = parsed(spark, sql).treeString()
    plain = re.sub(r"'[^'\n]*'", "''", tree)
    if m := _COMMAND.search(plain):
        raise StatementError(f"only queries are allowed, not {m[1]}")
    named = {n.strip().lower() for m in re.finditer(r"CTE \[([^\]]*)\]", tree) for n in m[1].split(",")}
    for m in re.finditer(r"Unresolved(Relation|TableValuedFunction) \[([^\]]*)\]", tree):
        if m[1] != "Relation" or m[2].lower() not in allowed | named:
            raise RelationError(f"unknown relation {m[2]}")
    return tree


#: Operators that give the same rows each time, over sources that hold still.
_REPEATABLE = {"Project", "Filter", "Join", "Union", "SubqueryAlias", "View", "WithCTE", "CTERelationDef", "CTERelationRef", "Relation", "LocalRelation", "LogicalRDD"}


def repeatable(spark: SparkSession, sql: str, allowed: set[str]) -> bool:
    """Whether a SELECT can be read twice in one query: no limits, ties, sums of floats, stores or random values."""
    admitted(spark, sql, allowed)
    try:
        plan = spark.sql(sql)._jdf.queryExecution().analyzed()
    except AnalysisException:
        return False
    tree = plan.treeString()
    return plan.deterministic() and "JDBCRelation" not in tree and set(re.findall(r"^[\s:+-]*(\S+?)\b", tree, re.M)) <= _REPEATABLE


def check_enums(ts: list[Token], schema: Schema) -> None:
    """Literals held against enum columns by = or IN have to be values of the enum."""
    by_column: dict[str, set[str]] = {}
    names = {name_of(t).lower() for t in ts if t.kind in ("word", "quoted")}
    for (table, column), values in schema.enums().items():
        if table.lower() in names:
            by_column.setdefault(column.lower(), set()).update(values)
    for table in schema.tables.values():  # a column of the same name without an enum makes it unclear
        if table.name.lower() in names:
            for c, spec in table.columns.items():
                if c.lower() in by_column and (table.name, c) not in schema.enums():
                    by_column.pop(c.lower())
    for i, t in enumerate(ts):
        values = by_column.get(name_of(t).lower()) if t.kind in ("word", "quoted") else None
        if not values or i + 1 >= len(ts):
            continue
        found = []
        if ts[i + 1].text in ("=", "==", "<>", "!=") and i + 2 < len(ts):
            found = [ts[i + 2]]
        elif ts[i + 1].upper == "IN" or ts[i + 1].upper == "NOT" and i + 2 < len(ts) and ts[i + 2].upper == "IN":
            j = i + 2 + (ts[i + 1].upper == "NOT")
            while j < len(ts) and ts[j].text != ")":
                found.append(ts[j])
                j += 1
        for lit in found:
            if lit.kind == "string" and lit.text[1:-1].replace("''", "'") not in values:
                raise EnumError(f"{lit.text} is no value of {t.text}: {', '.join(sorted(values))}")


def count_nodes(tree: str, rails: Guardrails) -> int:
    n = tree.count("\n") + 1
    if n > rails.max_plan_nodes:
        raise GuardrailError(f"the plan has {n} nodes, at most {rails.max_plan_nodes}")
    return n


def fallback(entities: list, policy: FallbackPolicy, sql: str, tree: str) -> list[Diagnostic]:
    """Diagnostics for entities whose provider does not take the statement: Spark reads and finishes the work itself."""
    operators = frozenset(re.findall(r"^[\s:+-]*'?([A-Z]\w+)", tree, re.M))
    names, out = tuple(e.name for e in entities), []
    for entity in entities:
        if entity.can_execute is None:
            continue
        answer = entity.can_execute(Fragment(entity.provider, entity.name, sql, names, operators))
        if answer is True:
            continue
        why, cost = (answer.reason, answer.cost) if isinstance(answer, Refusal) else ("it can't run this query", None)
        cost = entity.estimate if cost is None else cost
        if not policy.allow:
            raise FallbackError(f"{entity.provider}.{entity.name}: {why}, and fallback is off")
        if policy.reject_above_cost is not None and (cost or 0) > policy.reject_above_cost:
            raise FallbackError(f"{entity.provider}.{entity.name}: {why}; cost {cost} is above {policy.reject_above_cost}")
        if policy.warn:
            out.append(Diagnostic("VELD_WARN_FALLBACK", f"{entity.provider}.{entity.name} is read and finished by Spark: {why}"))
    return out
