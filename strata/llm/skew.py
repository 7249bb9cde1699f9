"""Joining rows back to an aggregate of their own key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_join(rows: DataFrame, groups: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``groups`` (one row a ``key``). Straight after the
    aggregation Spark would join on the aggregation's own partitions, where a
    hot key's rows stay in one task; a second key, made from the first, gives
    both sides an exchange whose large partitions AQE can split. One bit is
    enough for that, and hardly adds to what is shuffled."""
    name = "__more"
    while name in rows.columns or name in groups.columns:
        name += "_"
    more = F.pmod(F.hash(key), F.lit(2)).alias(name)
    return rows.select("*", more).join(groups.select("*", more), [key, name], how).drop(name)
