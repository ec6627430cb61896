"""Broadcasts behind a check of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import settled

#: Rows of a narrow table (keys and a few values) that are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def narrow(df: DataFrame, name: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` computed once, with a broadcast hint if it has at most ``most`` rows."""
    done = settled(df, name)
    return F.broadcast(done) if done.count() <= most else done
