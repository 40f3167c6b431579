"""Joins with few keys that many rows share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key's rows are dealt into this many groups; the other side is repeated for each.
SPREAD = 32


def dealt(df: DataFrame, leave: tuple[str, ...]) -> Column:
    """A group of 0..SPREAD - 1 by a row's values; ``leave`` (long texts) are not looked at."""
    return F.pmod(F.xxhash64(*[c for c in df.columns if c not in leave]), F.lit(SPREAD)).cast("int")


def spread_join(df: DataFrame, few: DataFrame, on: str, how: str = "left", leave: tuple[str, ...] = ("body",),
                group: str = "_group", stay: bool = False) -> DataFrame:
    """``df`` joined with ``few`` on ``on``, where one key may hold a large share of ``df``.

    Keys meet by (key, group), so a hot key is not one task's work whatever the planner knows of the sizes.
    ``few`` holds about one short row a key. The column ``group`` stays: a keyed cut can go on from it.
    With ``stay`` the groups are kept where nothing goes on from them, else the planner may find ``few`` small
    when the rows have moved, and let one task read all that one task wrote.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias(group)
    each = few.select("*", every)
    return df.withColumn(group, dealt(df, leave)).join(each.hint("shuffle_hash") if stay else each, [on, group], how)
