"""Evaluating costly expressions once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, keep: list[str], **costly: Column) -> DataFrame:
    """``keep`` columns plus the ``costly`` ones, each evaluated exactly once per row.

    The optimizer merges projections and pushes predicates through them, which repeats a parsed
    JSON or an HMAC for every later mention. A generator is never repeated, so the values pass
    through a one-row ``inline``.
    """
    values = F.struct(*[column.alias(name) for name, column in costly.items()])
    return df.select(*keep, F.inline(F.array(values)))
