"""Measures over a corpus of sessions: payload, census, savings, gates, latencies."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from foldline.functions.columns import percent_saved


def tokens(text: Column) -> Column:
    """About how many tokens a text has: a quarter of its bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


@lru_cache(4)
def _encoding(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def bpe_tokens(vocabulary: str, pattern: str):
    """A function of a text column: its tokens by a byte-pair vocabulary of ranks (a file that
    every executor has) and the pattern that splits texts into words; null for null."""

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(_encoding(vocabulary, pattern).encode_ordinary(t)), na_action="ignore").astype("Int64")

    return count


def savings(files: DataFrame, by: Column | None = None, before: str = "before", after: str = "after") -> DataFrame:
    """Files, sums and percent saved for each band (all files without one)."""
    g = files.withColumn("band", by if by is not None else F.lit("all")).groupBy("band")
    out = g.agg(F.count(F.lit(1)).alias("files"), F.sum(before).cast("long").alias("before"), F.sum(after).cast("long").alias("after"))
    return out.withColumn("saved_percent", percent_saved(F.col("before").cast("double"), F.col("after").cast("double")))


def compare(files: DataFrame, ours: str, theirs: str) -> DataFrame:
    """Wins, ties and losses by bytes left (fewer wins), and the median gap."""
    gap = F.col(theirs) - F.col(ours)
    return files.agg(F.count_if(gap > 0).alias("wins"), F.count_if(gap == 0).alias("ties"), F.count_if(gap < 0).alias("losses"), F.percentile(gap.cast("double"), F.lit(0.5)).alias("median_gap"))


def worst(files: DataFrame, ours: str, theirs: str, n: int = 5) -> DataFrame:
    """The n files with the largest losses."""
    return files.withColumn("loss", F.col(ours) - F.col(theirs)).filter("loss > 0").orderBy(F.desc("loss"), *files.columns[:1]).limit(n)


def rank_percentiles(df: DataFrame, part: list[str], value: str, shares: dict[str, float], cells: int = 64) -> DataFrame:
    """mean, median and max of each group, and the values at rank min(n - 1, floor(p n)),
    counted from 0.  Approximate quantiles deal a group's values to cells; counts tell which
    cell holds a rank, and only such cells are ordered, each in a task of its own."""
    rows = df.filter(F.col(value).isNotNull()).select(*part, F.col(value).alias("_v"))
    edges = F.percentile_approx("_v", F.array(*[F.lit(i / cells) for i in range(1, cells)]))
    whole = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("mean"), F.max("_v").alias("max"), edges.alias("_e"))
    placed = rows.join(whole.select(*part, "_e"), part).select(*part, "_v", F.size(F.filter("_e", lambda e: e < F.col("_v"))).alias("_c"))
    counts = placed.groupBy(*part, "_c").agg(F.count(F.lit(1)).alias("_in"))
    counts = counts.withColumn("_before", F.sum("_in").over(Window.partitionBy(*part).orderBy("_c")) - F.col("_in"))  # a row for each cell
    ranks = {"_low": F.expr("(_n - 1) div 2"), "_high": F.expr("_n div 2")} | {n: F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(p))) for n, p in shares.items()}
    wanted = whole.select(*part, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), r.cast("long").alias("rank")) for n, r in ranks.items()])).alias("w")).select(*part, "w.*")
    wanted = wanted.join(counts, part).filter("rank >= _before and rank < _before + _in").select(*part, "_c", "_before", "name", "rank")
    cell = placed.join(wanted.select(*part, "_c", "_before").distinct(), [*part, "_c"])
    cell = cell.withColumn("rank", F.col("_before") + F.row_number().over(Window.partitionBy(*part, "_c").orderBy("_v")) - 1)
    found = cell.join(wanted.select(*part, "name", "rank"), [*part, "rank"]).groupBy(*part).agg(*[F.max(F.when(F.col("name") == n, F.col("_v"))).alias(n) for n in ranks])
    return whole.select(*part, "mean", "max").join(found, part).select(*part, "mean", ((F.col("_low") + F.col("_high")) / 2).alias("median"), "max", *shares)


def size_tiers(files: DataFrame, size: str, tiers: int = 4) -> DataFrame:
    """The file at the middle of each tier of sizes.  Tier edges are quantiles of a sketch-free
    aggregate, so no task sorts all files."""
    edges = files.agg(F.percentile(size, F.array(*[F.lit((2 * i + 1) / (2 * tiers)) for i in range(tiers)])).alias("q")).select(F.posexplode("q").alias("tier", "at"))
    near = files.crossJoin(F.broadcast(edges)).withColumn("_d", F.abs(F.col(size) - F.col("at")))
    return near.groupBy("tier").agg(F.min_by(F.struct(*files.columns), F.struct("_d", *files.columns[:1])).alias("f")).select("tier", "f.*")


def model_visible(blocks: DataFrame, boundary: Column, preserved: Column, part: str = "file_id", pos: str = "pos") -> DataFrame:
    """Rows that a resumed session shows: those after the last boundary, and preserved ones."""
    last = F.max(F.when(boundary, F.col(pos))).over(Window.partitionBy(part))
    return blocks.withColumn("_cut", last).filter(F.col("_cut").isNull() | (F.col(pos) > F.col("_cut")) | preserved).drop("_cut")


def baseline(files: DataFrame) -> DataFrame:
    """Which original a file is measured against, or why it is not: the first that fits.
    files: marked, other_tool, covered (the archive has every live uuid), backup, bytes."""
    choice = (
        F.when(~F.col("marked") & ~F.col("other_tool"), "self")
        .when(F.col("marked") & ~F.col("other_tool") & F.col("covered"), "archive")
        .when(F.col("other_tool") & F.col("backup"), "backup")
    )
    reason = F.when(choice.isNull(), F.when(F.col("other_tool"), "no clean backup").otherwise("archive does not cover it")).when(F.col("bytes") < 1024, "too small")
    return files.withColumn("baseline", F.when(reason.isNull(), choice)).withColumn("reason", reason)
