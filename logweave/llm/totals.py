"""Totals of groups brought back to their rows, however unevenly the rows are dealt over the groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group with more than one row in so many is heavy; there are never more heavy groups than this.
HEAVY_SHARE = 1000


def group_key(col) -> F.Column:
    """A short key of a value of any length; null is a value of its own."""
    return F.coalesce(F.md5(F.concat(F.lit("="), F.col(col).cast("string"))), F.lit(""))


def attach(rows: DataFrame, totals: DataFrame, key: str, count: str, share: int = HEAVY_SHARE) -> DataFrame:
    """``rows`` with the columns of ``totals`` of the same key (no nulls; one row a key, ``count`` its number of rows).

    Heavy groups, at most ``share`` of them, are sent to all tasks and their rows stay where they are;
    the others, each with at most one row in ``share``, meet by a shuffle.  ``rows`` is read twice.
    """
    whole = totals.agg(F.sum(count)).first()[0] or 0
    heavy = totals.where(F.col(count) * share > whole)
    light = totals.where(F.col(count) * share <= whole)
    there = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return there.unionByName(rest)
