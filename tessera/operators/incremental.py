"""Index maintenance by snapshots: changed and deleted rows, replace by key, totals of batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.names import spare
from tessera.operators.batching import batch_numbers  # noqa: F401


def changed(current: DataFrame, stored: DataFrame, key: str = "path", stamp: str = "mtime") -> DataFrame:
    """Rows of ``current`` that are newer than stored, or not stored; a null stamp, here or there, counts as changed.

    A null key is a key like any other. Of a key that is stored several times the newest row counts. Repeated rows stay
    repeated, and columns keep their names and order, whatever they are called.
    """
    own, old, known = (spare(n, current) for n in ("_key", "_old", "_known"))
    last = stored.groupBy(F.col(key).alias(own)).agg(F.max(stamp).alias(old)).withColumn(known, F.lit(True))
    joined = current.join(last, current[key].eqNullSafe(last[own]), "left")
    return joined.filter(F.col(known).isNull() | current[stamp].isNull() | F.col(old).isNull() | (current[stamp] > F.col(old))).select(*[current[c] for c in current.columns])


def deleted(current: DataFrame, stored: DataFrame, key: str = "path") -> DataFrame:
    """Rows of ``stored`` whose key ``current`` has no more; a null key is a key like any other."""
    return _without(stored, current.select(key), key)


def _without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    own = spare("_key", rows)
    gone = keys.select(F.col(key).alias(own)).distinct()
    return rows.join(gone, rows[key].eqNullSafe(gone[own]), "left_anti")


def replaced(table: DataFrame, fresh: DataFrame, gone: DataFrame, key: str = "source") -> DataFrame:
    """``table`` without the rows of keys in ``gone`` or ``fresh``, plus ``fresh``: delete, then insert, per key.

    A null key is replaced and deleted like any other; rows of one key that are repeated in ``fresh`` all stay.
    """
    return _without(table, gone.select(key).union(fresh.select(key)), key).unionByName(fresh)


def metadata_stats(stored: DataFrame) -> DataFrame:
    """Number of tracked files and the time of the last index run (null for none)."""
    return stored.agg(F.count("*").alias("total"), F.max("indexed_at").alias("last_indexed"))


def chunk_totals(batches: DataFrame) -> DataFrame:
    return batches.agg(F.count("*").alias("chunks"), F.coalesce(F.max("batch_no") + 1, F.lit(0)).alias("batches"))


def newest_state(states: DataFrame, key: str = "path") -> DataFrame:
    """The last row of each key of a state log (``indexed_at``, null first); a null key is one key, of equal times one row stays."""
    r = spare("_r", states)
    return states.withColumn(r, F.row_number().over(Window.partitionBy(key).orderBy(F.desc("indexed_at")))).filter(F.col(r) == 1).drop(r)
