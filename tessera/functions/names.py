"""Column names that clash with none of a table's own."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spare(name: str, *frames: DataFrame) -> str:
    """``name``, with as many underscores behind it as it takes to be no column of any of the tables, whatever the case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
