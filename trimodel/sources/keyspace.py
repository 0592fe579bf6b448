"""Keyspaces: rows with a key and an expiry in milliseconds since the epoch; 0 never expires. Pure transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def now_ms() -> Column:
    return F.unix_millis(F.current_timestamp())


def live(df: DataFrame, now: Column | int | None = None, expires: str = "_expires_at") -> DataFrame:
    """Rows that haven't expired: a row lives up to and including its expiry."""
    at = now_ms() if now is None else F.lit(now)
    return df.filter((F.coalesce(F.col(expires), F.lit(0)) == 0) | (at <= F.col(expires)))


def expired(df: DataFrame, now: Column | int | None = None, expires: str = "_expires_at") -> DataFrame:
    at = now_ms() if now is None else F.lit(now)
    return df.filter((F.col(expires) > 0) & (at > F.col(expires)))


def ttl(df: DataFrame, now: Column | int | None = None, expires: str = "_expires_at") -> DataFrame:
    """With `ttl_ms`: what is left; NULL for rows that never expire."""
    at = now_ms() if now is None else F.lit(now)
    return df.withColumn("ttl_ms", F.when(F.col(expires) > 0, F.greatest(F.col(expires) - at, F.lit(0))))


def expire(df: DataFrame, condition: Column, ttl_ms: int, now: Column | int | None = None, expires: str = "_expires_at") -> DataFrame:
    at = now_ms() if now is None else F.lit(now)
    return df.withColumn(expires, F.when(condition, at + ttl_ms).otherwise(F.col(expires)))


def persist(df: DataFrame, condition: Column, expires: str = "_expires_at") -> DataFrame:
    return df.withColumn(expires, F.when(condition, F.lit(0)).otherwise(F.col(expires)))
