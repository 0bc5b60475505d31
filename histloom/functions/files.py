"""Reading members of modified_files, so that the scan reads those members only.

Exploding an array of structs, or a lambda over it, makes Parquet read every member. Arrays of single members are pruned, so
the members wanted are zipped anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def members(*names: str) -> Column:
    """An array of structs of the named members; null where modified_files is null."""
    return F.arrays_zip(*[F.col(f"modified_files.{n}").alias(n) for n in names])


class Member:
    """Stands for one file in expressions, and notes which members they use."""

    def __init__(self, column: str):
        self.column, self.used = column, {}

    def __getitem__(self, name: str) -> Column:
        self.used[name] = None
        return F.col(self.column)[name]


def exploded(fields: dict[str, Callable[[Member], Column]], column: str = "m") -> tuple[Column, dict[str, Column]]:
    """The array to explode as ``column``, and the expressions over it."""
    m = Member(column)
    exprs = {n: f(m) for n, f in fields.items()}
    return members(*m.used), exprs
