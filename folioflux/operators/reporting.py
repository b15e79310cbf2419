"""Counts, error policy, fixed-size row groups, source lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..shared import written


def failed(errors: Column, successes: Column, soft: bool = True, limit: float = 0.2) -> Column:
    """Whether a step counts as failed: any error, or (soft) errors without success or an error share of the limit."""
    if not soft:
        return errors > 0
    return ((errors > 0) & (successes == 0)) | ((errors + successes > 0) & (errors / F.greatest(errors + successes, F.lit(1)) >= limit))


def row_groups(rows: DataFrame, by: list[str], order: str, size: int = 50) -> DataFrame:
    """rows with group_no and place of fixed-size groups in order within `by`."""
    return numbered(rows, by, order).withColumnRenamed("n", "place").withColumn("group_no", F.floor(F.col("place") / size).cast("int"))


def first_ranks(rows: DataFrame, source: Column, rank: str) -> DataFrame:
    """(source, rank): every source with its first rank."""
    return rows.select(source.alias("source"), F.col(rank).alias("rank")).groupBy("source").agg(F.min("rank").alias("rank"))


def sorted_sources(rows: DataFrame, source: Column) -> DataFrame:
    """(source): every source once, sorted."""
    return rows.select(source.alias("source")).where("source is not null").distinct().orderBy("source")


def costs(usage: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """(model, prompt_tokens, completion_tokens, cost): totals of calls (model, prompt_tokens, completion_tokens) by prices a thousand tokens, in and out.

    A model without a price has a null cost."""
    table = F.create_map(*[x for m, (a, b) in prices.items() for x in (F.lit(m), F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")))])
    sums = usage.groupBy("model").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    price = table[F.col("model")]
    return sums.withColumn("cost", F.col("prompt_tokens") / 1000 * price["a"] + F.col("completion_tokens") / 1000 * price["b"])


def numbered(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """rows with n, their place from 0 by `order` within `by`, whatever rows a group has.

    Rows are put into ranges of (by, order); every range numbers its own, and the places of
    a group that goes on in later ranges are shifted by what the earlier ones hold. So no task gets a whole group."""
    keys = [F.col(c) for c in by]
    cut = written(rows.repartitionByRange(*keys, F.col(order)).withColumn("part", F.spark_partition_id()), "numbered")
    counts = cut.groupBy(*keys, "part").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(*[F.col(c).alias(f"own_{c}") for c in by], F.col("part").alias("own_part"), before.alias("shift"))
    own = F.row_number().over(Window.partitionBy("part", *by).orderBy(order)) - 1
    on = [cut[c].eqNullSafe(shifts[f"own_{c}"]) for c in by] + [cut["part"] == shifts["own_part"]]
    both = cut.withColumn("own", own).join(shifts, on)
    return both.withColumn("n", (F.col("own") + F.col("shift")).cast("long")).select(*rows.columns, "n")
