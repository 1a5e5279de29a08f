"""Everything that the engine raises, by the step at which it fails."""

from __future__ import annotations


class EngineError(Exception):
    """Base of all; ``code`` and ``sqlstate`` go into diagnostics."""

    code, sqlstate = "VELD_ERR", "58000"


class SchemaError(EngineError):
    """A declared schema is not valid; ``issues`` lists every problem found."""

    code, sqlstate = "VELD_ERR_SCHEMA", "42P16"

    def __init__(self, issues: list[str]):
        super().__init__("; ".join(issues))
        self.issues = issues


class BindingError(EngineError):
    code, sqlstate = "VELD_ERR_BINDING", "08001"


class ParseError(EngineError):
    code, sqlstate = "VELD_ERR_PARSE", "42601"


class StatementError(EngineError):
    """Anything but a single SELECT or WITH."""

    code, sqlstate = "VELD_ERR_STATEMENT", "25006"


class RelationError(EngineError):
    code, sqlstate = "VELD_ERR_RELATION", "42P01"


class ColumnError(EngineError):
    code, sqlstate = "VELD_ERR_COLUMN", "42703"


class EnumError(EngineError):
    code, sqlstate = "VELD_ERR_ENUM", "22023"


class UnsupportedError(EngineError):
    code, sqlstate = "VELD_ERR_UNSUPPORTED", "0A000"


class GuardrailError(EngineError):
    code, sqlstate = "VELD_ERR_GUARDRAIL", "54000"


class QueryTimeout(GuardrailError):
    code, sqlstate = "VELD_ERR_TIMEOUT", "57014"


class LookupLimitError(GuardrailError):
    code, sqlstate = "VELD_ERR_LOOKUP", "54001"


class RecursionLimitError(GuardrailError):
    code, sqlstate = "VELD_ERR_RECURSION", "54002"


class FallbackError(EngineError):
    code, sqlstate = "VELD_ERR_FALLBACK", "0A001"


class PlanningError(EngineError):
    """A source's answer to a request can't give the request's rows."""

    code, sqlstate = "VELD_ERR_PLANNING", "0A002"


class ConstraintError(EngineError):
    """``violations`` has (table, constraint, columns, rows)."""

    code, sqlstate = "VELD_ERR_CONSTRAINT", "23000"

    def __init__(self, violations: list[tuple]):
        super().__init__("; ".join(f"{t}: {kind} on {', '.join(cols)} broken by {n} rows" for t, kind, cols, n in violations))
        self.violations = violations


class ExecutionError(EngineError):
    code, sqlstate = "VELD_ERR_EXECUTION", "XX000"
