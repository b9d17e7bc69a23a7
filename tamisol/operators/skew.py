"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The largest groups that are joined by broadcast, and the bytes of their rows; being the largest N, no group beyond them holds more than 1/N of the rows.
HOT_GROUPS, HOT_BYTES = 1000, 16 << 20


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of ``rows`` with ``groups`` (one row per key, with its number of rows in ``size``).

    The HOT_GROUPS largest groups, or as many of them as HOT_BYTES hold, are broadcast, which is bounded by these constants, so their rows stay
    where they are; the rest is an ordinary shuffled join in which, but for groups of very long rows, no key holds more than 1/HOT_GROUPS of the
    rows. ``rows`` is read twice: materialise it first.
    """
    largest = groups.orderBy(F.col(size).desc(), F.col(key)).limit(HOT_GROUPS)
    width = F.length(F.to_json(F.struct(*groups.columns)))
    before = F.sum(width).over(W.orderBy(F.col(size).desc(), F.col(key)))  # over HOT_GROUPS rows at most
    hot = F.broadcast(largest.withColumn("__bytes", before).filter(F.col("__bytes") <= HOT_BYTES).drop("__bytes"))
    keys = F.broadcast(hot.select(key))
    return rows.join(hot, key).unionByName(rows.join(keys, key, "left_anti").join(groups.join(keys, key, "left_anti"), key))
