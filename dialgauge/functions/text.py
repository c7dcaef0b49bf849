"""SQL text helpers."""

from __future__ import annotations


def quoted(value: str) -> str:
    """A string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted_list(values) -> str:
    """Literals for an ``IN`` list."""
    return ", ".join(quoted(v) for v in values)


def named(column: str) -> str:
    """A column name as an identifier."""
    return "`" + column.replace("`", "``") + "`"
