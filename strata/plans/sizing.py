"""Size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Without adaptive execution, a side is broadcast only when it has at most
# this many rows; otherwise the join stays a shuffle join.
MAX_BROADCAST_ROWS = 1_000_000


def _aqe_on(df: DataFrame) -> bool:
    return str(df.sparkSession.conf.get("spark.sql.adaptive.enabled", "true")).lower() == "true"


def bounded_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` as a join side to broadcast only behind a size check.

    With adaptive execution on (the default), no hint is added: AQE measures
    the materialised side at run time and turns the join into a broadcast
    join only when it is under ``spark.sql.adaptive.autoBroadcastJoinThreshold``,
    keeping the shuffle join otherwise. That check costs nothing extra, while
    counting a side derived from a large table up front would read it twice.

    Without AQE, the bound is proven by a bounded count
    (``limit(max_rows + 1)``) before the broadcast hint; beyond it the join
    stays a shuffle join.
    """
    if _aqe_on(df):
        return df
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
