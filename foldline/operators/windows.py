"""Window-style operators: age clocks, keep-first and keep-last, segments, recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def age_clock(df: DataFrame, part: list[str], order: list[str], clocks: dict[str, Column]) -> DataFrame:
    """For each row, how many rows after it in its partition meet each condition."""
    after = Window.partitionBy(*part).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumns({name: F.coalesce(F.sum(F.when(c, 1).otherwise(0)).over(after), F.lit(0)).cast("long") for name, c in clocks.items()})


def keep_last(df: DataFrame, part: list[str], order: list[str]) -> DataFrame:
    """The last row of each group, by aggregation (a hot group is combined before the shuffle)."""
    return df.groupBy(*part).agg(F.max_by(F.struct(*[c for c in df.columns if c not in part]), F.struct(*order)).alias("_")).select(*part, "_.*")


def running_count(df: DataFrame, part: list[str], order: list[str], when: Column, name: str) -> DataFrame:
    """Turns and segments: how many rows up to and with this one meet the condition."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(when, 1).otherwise(0)).over(w).cast("long"))


def first_in_segment(df: DataFrame, part: list[str], order: list[str], boundary: Column, wanted: Column) -> DataFrame:
    """The first wanted row of each segment between boundaries."""
    cut = running_count(df, part, order, boundary, "segment_no").filter(wanted)
    return cut.groupBy(*part, "segment_no").agg(F.min_by(F.struct(*[c for c in df.columns if c not in part]), F.struct(*order)).alias("_")).select(*part, "segment_no", "_.*")


def all_but_newest(df: DataFrame, part: list[str], order: list[Column], n: int) -> DataFrame:
    """Rows older than the newest n of their group.  order: newest first."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") > n).drop("_n")


def nth_copy(df: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """copy_no: which copy of its identity each row is, from 1."""
    return df.withColumn("copy_no", F.row_number().over(Window.partitionBy(*identity).orderBy(*order)).cast("long"))


def middle(df: DataFrame, value: str, trim_percent: int) -> DataFrame:
    """How often each distinct value is among the rows left when trim_percent of the rows
    are cut off at either end of the order.  Ranks come from a histogram, summed over powers
    of two first, so no task orders the rows."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n")).withColumn("_b", F.floor(F.log2(F.abs(F.col(value)) + 1)) * F.signum(F.col(value)))
    blocks = counts.groupBy("_b").agg(F.sum("n").alias("_in"))
    total = blocks.agg(F.sum("_in").alias("_total"))
    before = blocks.alias("a").join(blocks.alias("b"), F.col("b._b") < F.col("a._b"), "left").groupBy("a._b").agg(F.coalesce(F.sum("b._in"), F.lit(0)).alias("_before"))
    w = Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.join(F.broadcast(before), "_b").withColumn("_lo", F.col("_before") + F.coalesce(F.sum("n").over(w), F.lit(0))).crossJoin(F.broadcast(total))
    cut = F.expr(f"_total * {trim_percent} div 100")
    kept = F.least(F.col("_lo") + F.col("n"), F.col("_total") - cut) - F.greatest(F.col("_lo"), cut)
    return ranked.withColumn("kept", kept).filter("kept > 0").select(value, "kept")
