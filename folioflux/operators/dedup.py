"""First-wins deduplication, anti-joins against what is stored, empty-content filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def first_wins(df: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of every key by the order columns; rows with a null key are all kept.

    Ordered aggregation instead of a window: the winner of a key is found where its rows are read
    and again after the shuffle, so a key that holds most rows is not gathered in one task."""
    own = "__row"
    rows = df.select(key.alias("__key"), F.struct(*[F.col(c) for c in order], F.struct(*df.columns).alias("__all")).alias(own))
    best = rows.where("__key is not null").groupBy("__key").agg(F.min_by(own, F.struct(*[F.col(f"{own}.{c}") for c in order])).alias(own))
    return best.select(f"{own}.__all.*").unionByName(rows.where("__key is null").select(f"{own}.__all.*"))


def not_stored(df: DataFrame, key: Column, stored: DataFrame) -> DataFrame:
    """Rows whose key is not among the first column of `stored`; rows with a null key are kept."""
    name = stored.columns[0]
    known = stored.select(F.col(name).alias("__key")).where("__key is not null").distinct()
    return df.withColumn("__key", key).join(known, "__key", "left_anti").drop("__key")


def with_content(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a non-empty value in one of the columns."""
    return df.where(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns]).isNotNull())
