"""Array and map access that gives null where nothing is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def item_at(c: Column | str, key: Column | int) -> Column:
    """Element at a position from 1 (or from the end, below 0), or value of a key."""
    return F.try_element_at(F.col(c) if isinstance(c, str) else c, key if isinstance(key, Column) else F.lit(key))
