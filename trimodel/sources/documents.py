"""Document collections: an append-only log of revisions, with tombstones, history and time travel.

All functions take the log and return a frame; none gathers rows. A log has `_id`, `_revision`, `_deleted`,
`_created_at`, `_updated_at` and the fields of the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYSTEM = ("_id", "_revision", "_deleted", "_created_at", "_updated_at")


def _newest(log: DataFrame, key: str, revision: str) -> DataFrame:
    """The row of the highest revision of each key: a hash aggregate of keys and revisions only, and a join back."""
    last = log.groupBy(F.col(key).alias("tm_key")).agg(F.max(revision).alias("tm_last"))
    return log.join(last, F.col(key).eqNullSafe(F.col("tm_key")) & (F.col(revision) == F.col("tm_last")), "left_semi")


def latest(log: DataFrame, key: str = "_id", revision: str = "_revision", deleted: str = "_deleted", with_deleted: bool = False) -> DataFrame:
    newest = _newest(log, key, revision)
    return newest if with_deleted else newest.filter(~F.coalesce(F.col(deleted), F.lit(False)))


def history(log: DataFrame, key_value: object, limit: int | None = None, key: str = "_id", revision: str = "_revision") -> DataFrame:
    """The revisions of a document, the newest first."""
    out = log.filter(F.col(key) == F.lit(key_value)).orderBy(F.col(revision).desc())
    return out if limit is None else out.limit(limit)


def at_revision(log: DataFrame, number: int, key: str = "_id", revision: str = "_revision") -> DataFrame:
    """Each document as of a revision: the newest that isn't above it."""
    return _newest(log.filter(F.col(revision) <= number), key, revision)


def exactly(log: DataFrame, key_value: object, number: int, key: str = "_id", revision: str = "_revision") -> DataFrame:
    return log.filter((F.col(key) == F.lit(key_value)) & (F.col(revision) == number))


def purged(log: DataFrame, before: object, key: str = "_id", revision: str = "_revision", deleted: str = "_deleted", updated: str = "_updated_at") -> DataFrame:
    """The log without documents whose last revision is a tombstone from before a time."""
    gone = _newest(log, key, revision).filter(F.coalesce(F.col(deleted), F.lit(False)) & (F.col(updated) < F.lit(before))).select(F.col(key).alias("tm_gone"))
    return log.join(gone, F.col(key).eqNullSafe(F.col("tm_gone")), "left_anti")


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Plain rows as a log: the rows of a key become its revisions in the order of a column."""
    from pyspark.sql import Window

    return rows.withColumn("_revision", F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("bigint"))
