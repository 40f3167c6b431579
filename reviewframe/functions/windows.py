"""Keyed first-n and last-wins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64
# Sub-groups of the second cut.
FEWER = 4
# Largest literal rank for which the planner prunes rows before the exchange
# (spark.sql.optimizer.windowGroupLimitThreshold).
MAP_SIDE_LIMIT = 1000


def _ranked(df: DataFrame, keys: list, order: list, n, rank_col: str) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(window)).filter(F.col(rank_col) <= n)


def first_n(df: DataFrame, keys: list, order: list, n: int | Column,
            rank_col: str = "rank", group: str | None = None) -> DataFrame:
    """First ``n`` rows per key in ``order``; adds ``rank_col``.

    A literal ``n`` within the planner's limit is pruned to n rows per key and map task before the
    exchange. A per-row ``n`` cannot be, so each key is first cut within salted sub-groups (any
    row beyond rank n of its sub-group is beyond rank n of its key), then across ever fewer of
    them, so that no task but the last, of n rows by FEWER a key, reads more than a share of a key.
    ``group`` names a column of sub-groups (0 and up) that the rows meet by already; it is dropped.
    """
    if isinstance(n, int) and n <= MAP_SIDE_LIMIT:
        return _ranked(df, keys, order, n, rank_col)
    cut = df
    if group is None:
        group = "_salt"
        cut = df.withColumn(group, F.pmod(F.xxhash64(F.struct(*df.columns)), F.lit(SALTS)))
    cut = _ranked(cut, [*keys, group], order, n, rank_col).drop(rank_col)
    cut = _ranked(cut.withColumn(group, F.col(group) % FEWER), [*keys, group], order, n, rank_col)
    return _ranked(cut.drop(rank_col, group), keys, order, n, rank_col)


def first_by(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row per key."""
    return first_n(df, keys, order, 1, "_rn").drop("_rn")


def last_by(df: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """The last row per key: a later position wins."""
    return first_by(df, keys, [F.col(c).desc() for c in order])
