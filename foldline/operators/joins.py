"""Join-style operators: as-of, interval containment, multiset anti-append, coverage."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import inf

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_backward(df: DataFrame, part: list[str], order: list[str], asks: Column, answers: Column, value: Column, name: str) -> DataFrame:
    """For each row that asks, the value of the nearest row before it that answers (null
    without one).  One sort of one table: nothing is joined, so no group multiplies."""
    before = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.when(answers, value), ignorenulls=True).over(before)).filter(asks)


def _contained(part: list[str], pos: list[str], lo: str, hi: str):
    """Keeps the rows, latest first within each part, whose interval a later row contains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = at = None
        starts, ends, same = [], [], []  # the later rows' intervals that lie in no other: both ascend; those of this row's position
        for b in batches:
            keep = []
            keys, places = (zip(*(b.column(c).to_pylist() for c in cols), strict=True) for cols in (part, pos))
            for key, place, x, y in zip(keys, places, b.column(lo).to_pylist(), b.column(hi).to_pylist(), strict=True):
                if key != now:
                    now, at, starts, ends, same = key, place, [], [], []
                if place != at:
                    for u, v in same:
                        if not (i := bisect_right(starts, u)) or ends[i - 1] < v:
                            i = bisect_left(starts, u)
                            j = max(i, bisect_right(ends, v))
                            starts[i:j], ends[i:j] = [u], [v]
                    at, same = place, []
                if x is None or None in key:
                    keep.append(False)
                    continue
                y = inf if y is None else y
                i = bisect_right(starts, x)  # of those that begin before, the last one ends last
                keep.append(i > 0 and ends[i - 1] >= y)
                same.append((x, y))
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def superseded(df: DataFrame, part: list[str], pos: list[str], lo: str, hi: str) -> DataFrame:
    """Rows whose interval a later row of the partition contains.  A null hi is unbounded; rows
    with a null lo or a null in the partition's key neither contain nor are contained.

    One sort and one pass over each partition, latest rows first, that holds only the
    intervals that lie in no other: no pairs are formed, however hot a key is."""
    rows = df.repartition(*part).sortWithinPartitions(*part, *[F.desc(c) for c in pos])
    return rows.mapInArrow(_contained(part, pos, lo, hi), df.schema)


def append_missing(new: DataFrame, archived: DataFrame, identity: list[str], order: list[str]) -> DataFrame:
    """Rows of new whose copy number exceeds the number of copies archived (a multiset
    difference that keeps the later copies).  Rows without an identity are appended."""
    have = archived.groupBy(*identity).agg(F.count(F.lit(1)).alias("_have"))
    w = Window.partitionBy(*identity).orderBy(*order)
    return new.withColumn("copy_no", F.row_number().over(w).cast("long")).join(have, identity, "left").filter("copy_no > coalesce(_have, 0)").drop("_have")


def multiset_max(a: DataFrame, b: DataFrame, identity: list[str]) -> DataFrame:
    """copies: the greater of the two tables' copy counts of each identity."""
    count = F.count(F.lit(1))
    x, y = a.groupBy(*identity).agg(count.alias("_a")), b.groupBy(*identity).agg(count.alias("_b"))
    return x.join(y, identity, "full_outer").select(*identity, F.greatest(F.coalesce("_a", F.lit(0)), F.coalesce("_b", F.lit(0))).cast("long").alias("copies"))


def missing(df: DataFrame, covered_by: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key the other table lacks (a coverage check passes if there are none)."""
    return df.join(covered_by.select(*keys).distinct(), keys, "left_anti")


def superseded_by_later(df: DataFrame, part: list[str], order: list[str], notice: Column, view: Column) -> DataFrame:
    """Notices with a full view of the same thing after them."""
    after = Window.partitionBy(*part).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return df.withColumn("_v", F.max(F.when(view, 1)).over(after)).filter(notice & F.col("_v").isNotNull()).drop("_v")


def unique_prefix(df: DataFrame, key: str, length: int) -> DataFrame:
    """Keys that a prefix of the given length names without another (case-insensitive)."""
    prefix = F.lower(F.substring(key, 1, length))
    return df.groupBy(prefix.alias("prefix")).agg(F.count_distinct(F.lower(key)).alias("_n"), F.min(key).alias(key)).filter("_n = 1").drop("_n")


def surviving_ancestor(edges: DataFrame, removed: str, node: str = "node", parent: str = "parent", part: list[str] | None = None, checkpoint=None, most: int = 40) -> DataFrame:
    """node, ancestor: the nearest ancestor that is not removed; null past the root.

    Pointers double each round: a pointer at a removed node moves to that node's pointer, so
    rounds grow with the logarithm of the longest removed run.  A cycle of removed nodes
    ends in null.  checkpoint: a function that cuts the lineage of a DataFrame."""
    part = part or []
    cut = checkpoint or (lambda d: d)
    walk = edges.select(*part, node, F.col(parent).alias("ancestor"), F.col(removed).alias("gone"))
    for _ in range(most):
        step = walk.filter("gone").select(*part, F.col(node).alias("ancestor"), F.col("ancestor").alias("_next"), F.lit(True).alias("_hop"))
        joined = walk.join(step, [*part, "ancestor"], "left")
        nxt = F.when(F.col("_hop"), F.when(F.col("_next") == F.col(node), None).otherwise(F.col("_next"))).otherwise(F.col("ancestor"))
        moved = cut(joined.select(*part, node, nxt.alias("ancestor"), "gone", F.col("_hop").isNotNull().alias("_m")))
        walk = moved.drop("_m")
        if not moved.filter("_m").limit(1).count():
            break
    else:
        walk = walk.join(walk.filter("gone").select(*part, F.col(node).alias("ancestor"), F.lit(True).alias("_hop")), [*part, "ancestor"], "left").withColumn("ancestor", F.when(F.col("_hop").isNull(), F.col("ancestor"))).drop("_hop")
    return walk.select(*part, node, "ancestor", "gone")
