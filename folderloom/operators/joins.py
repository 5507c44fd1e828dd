"""Join sides whose size is checked before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of names and hashes, some hundred bytes each: a few tens of megabytes at most.
BROADCAST_ROWS = 100_000


def broadcast_if_small(side: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The side marked for broadcast where a count shows that it has at most ``rows`` rows.

    Beyond that it is left alone: the join shuffles, and adaptive execution splits skewed keys.
    Meant for ledger-sized sides of joins with data, where the count is cheap and the shuffle is not.
    """
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side
