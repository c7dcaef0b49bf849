"""Joining wide per-user tables.

Every table travels as one struct column, so each join copies a handful of fields and not hundreds;
the columns are laid out once, at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import named


def pack(table: DataFrame, name: str, key: str = "uid") -> DataFrame:
    """The key, and all other columns as one struct."""
    return table.select(key, F.struct(*[named(c) for c in table.columns if c != key]).alias(name))


def join_all(tables: list[DataFrame], how: str, key: str = "uid") -> DataFrame:
    return reduce(lambda left, right: left.join(right, key, how), tables)


def lay_out(packed: DataFrame) -> DataFrame:
    """Struct fields as columns, missing = 0; other columns as they are."""
    columns = []
    for field in packed.schema:
        if isinstance(field.dataType, T.StructType):
            columns += [f"coalesce({named(field.name)}.{named(c)}, 0) as {named(c)}" for c in field.dataType.names]
        else:
            columns.append(named(field.name))
    return packed.selectExpr(*columns)


def for_users(users: DataFrame, table: DataFrame, key: str = "uid") -> DataFrame:
    """Every row of ``users`` with the columns of its user, missing = 0.

    ``table`` has one row per user, so what is worked out there is done once, however many rows a user has here.
    """
    return lay_out(users.join(pack(table, "of_user", key), key, "left"))


def join_wide(tables: list[DataFrame], how: str, key: str = "uid", users: DataFrame | None = None) -> DataFrame:
    """Join tables of many numeric columns on the user, missing = 0.

    ``users`` (if given) is the left side of it all, and keeps its columns as they are.
    """
    packed = [pack(table, f"part{i}", key) for i, table in enumerate(tables)]
    return lay_out(join_all(packed if users is None else [users, *packed], how, key))
