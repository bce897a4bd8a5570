"""What the training-data operators share: the word rule, narrow key tables and column names that clash with none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word is a maximal run of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a table of two or three numbers a row up to which it may be broadcast: some 50 MB in memory.
BROADCAST_ROWS = 1_000_000


def keys_to_send(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast if its row count is within the bound; a
    larger one is joined by a shuffle."""
    return F.broadcast(table) if table.count() <= most else table


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like those wanted that `df` doesn't have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
