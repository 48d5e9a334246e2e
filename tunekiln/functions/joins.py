"""Joins in which null keys meet, as they do in a group-by."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_on(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", hint: str | None = None) -> DataFrame:
    """Equi-join on the columns ``on``, null equal to null; the keys stand once in the result, as ``left`` has them.

    A slice, run or user without a name is a group of its own: a plain equi-join would lose its rows."""
    on = [on] if isinstance(on, str) else list(on)
    names = {c: f"_key_{i}" for i, c in enumerate(on)}
    right = right.select(*[F.col(c).alias(n) for c, n in names.items()], *[c for c in right.columns if c not in names])
    if hint:
        right = right.hint(hint)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return left.join(right, same, how).drop(*names.values())
