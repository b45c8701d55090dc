"""Ordered folds and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered_digest(df: DataFrame, keys: list[str], order: str, line: Column, sep: str, name: str = "digest") -> DataFrame:
    """Each group's lines in order, joined.  order: one column that orders as a struct."""
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), sep).alias(name))


def queue_balance(df: DataFrame, part: list[str], order: list[str], enqueue: Column, dequeue: Column) -> DataFrame:
    """n_ops, underflow (more taken than put at some point) and settled (empty at the end)."""
    step = F.when(enqueue, 1).when(dequeue, -1).otherwise(0)
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    run = df.filter(enqueue | dequeue).withColumn("_s", step).withColumn("_r", F.sum("_s").over(w))
    return run.groupBy(*part).agg(F.count(F.lit(1)).cast("long").alias("n_ops"), (F.min("_r") < 0).alias("underflow"), (F.sum("_s") == 0).alias("settled"))


def first_copies(df: DataFrame, text: Column, order: list[str]) -> DataFrame:
    """first: the order key of each text's first occurrence.  Texts meet by their sha-256, so
    they are not shuffled, and counts combine before the shuffle."""
    keyed = df.withColumn("_h", F.sha2(text, 256))
    first = keyed.groupBy("_h").agg(F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("copies"))
    return keyed.join(first.filter("copies > 1"), "_h").drop("_h")
