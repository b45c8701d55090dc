"""Mixing sources to target weights: hierarchical budgets over a tree, in DataFrame and SQL
operations only.

The tree's levels are expressions (domain, language, source).  A node's capacity is the
tokens below it times ``max_epochs``.  From the root down, a node's budget is shared among
its children by weight; a child that cannot use its share is capped at its capacity and
its siblings share the rest, so a shortage is made up by siblings first.  As a node's
budget never exceeds its capacity, what a whole family cannot use has gone to the family's
siblings before: ancestors come after siblings.  Shares are whole tokens: floors, then one
each by largest remainder (ties: the name that sorts first).

A leaf's budget is whole epochs of its documents plus a prefix of one more epoch.  Each
epoch has an order of its own, by md5 of seed, epoch and id.  The prefix is found in two
steps, by sums over md5 buckets and then within the one bucket that the budget ends in, so
no task orders a whole leaf.  What comes back is one row for each leaf, the place that the
budget ends at, and every document is compared with its leaf's place where it stands: texts
are never shuffled.  The document that the budget ends in is taken in part.

Words are counted once for all budgets, into a narrow table (once more where texts are kept).
Leaves join by broadcast up to ``MOST_LEAVES`` of them, and by a shuffle beyond that.

Defined results: null levels are a node named ``(none)``; documents without tokens (null
and empty texts) are never taken; nodes of weight 0 or less get nothing; rows of one id are
ordered by their number of tokens, and of equal rows as many are taken as the budget has room
for; rows without an id are ordered by a hash of their text.  A budget above the root's
capacity is that capacity.  An empty table gives an empty mixture.  Other columns of the
input are not read, whatever their names, but for those in ``keep``.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldline.llm.shared import table

#: Leaves of a tree that are broadcast (some 100 bytes each).
MOST_LEAVES = 100_000
WORD = r"[^\x20\x09-\x0D]+"
#: One level's shares.  {nodes}: the level's nodes with cap and w; {up}: the parents with
#: budget; {keys}: the parents' columns; {name}: the level's own column; {div}: whole division.
SHARE = """
SELECT {keys}, {name}, cap, CAST(CASE WHEN full_ THEN cap ELSE base + CASE WHEN row_number() OVER (PARTITION BY {keys}, full_ ORDER BY part DESC, {name}) <= spare THEN 1 ELSE 0 END END AS BIGINT) AS budget
FROM (SELECT *, CAST(CASE WHEN full_ THEN 0 ELSE rest - sum(CASE WHEN full_ THEN 0 ELSE base END) OVER (PARTITION BY {keys}) END AS BIGINT) AS spare
  FROM (SELECT *, CASE WHEN full_ THEN cap ELSE (rest * w) {div} open_w END AS base, CASE WHEN full_ THEN 0 ELSE (rest * w) % open_w END AS part
    FROM (SELECT *, CAST(budget - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER (PARTITION BY {keys}) AS BIGINT) AS rest,
                 CAST(sum(CASE WHEN full_ THEN 0 ELSE w END) OVER (PARTITION BY {keys}) AS BIGINT) AS open_w
      FROM (SELECT *, cap * later_w <= (budget - earlier_cap) * w AS full_
        FROM (SELECT n.*, u.budget, CAST(coalesce(sum(n.cap) OVER (PARTITION BY {nkeys} ORDER BY n.cap * 1.0e0 / n.w, n.{name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS earlier_cap,
                     CAST(sum(n.w) OVER (PARTITION BY {nkeys} ORDER BY n.cap * 1.0e0 / n.w, n.{name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS later_w
              FROM {nodes} n JOIN {up} u ON {on} WHERE n.w > 0 AND n.cap > 0) a) b) c) d) e"""


def share_sql(nodes: str, up: str, keys: list[str], name: str, div: str) -> str:
    on = " AND ".join(f"n.{k} = u.{k}" for k in keys)
    return SHARE.format(nodes=nodes, up=up, keys=", ".join(keys), nkeys=", ".join(f"n.{k}" for k in keys), name=name, on=on, div=div)


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, str], budget: int, max_epochs: int) -> DataFrame:
    """levels, cap, budget of every leaf.  leaves: the levels and tokens."""
    spark = leaves.sparkSession
    nodes = leaves.withColumn("root", F.lit(0)).withColumn("cap", F.col("tokens") * max_epochs)
    nodes = nodes.withColumns({f"w_{c}": F.expr(weights.get(c, "1")).cast("bigint") for c in levels})
    for c in levels:  # what lies below a node without weight is out of reach
        nodes = nodes.filter(F.col(f"w_{c}") > 0)
    total = nodes.agg(F.coalesce(F.sum("cap"), F.lit(0)).alias("cap"))
    up = total.select(F.lit(0).alias("root"), F.least("cap", F.lit(int(budget)).cast("bigint")).alias("budget"))
    for i, name in enumerate(levels):
        keys = ["root", *levels[:i]]
        level = nodes.groupBy(*keys, name).agg(F.sum("cap").alias("cap"), F.max(f"w_{name}").alias("w"))
        up = spark.sql(share_sql("{nodes}", "{up}", keys, name, "div"), nodes=level, up=up)
    return up.select(*levels, "cap", "budget")


def _ends(rows: DataFrame, shares: DataFrame, names: list[str]) -> DataFrame:
    """The shares with ``end``, the place (place, id, n_tokens) of the last document that the
    rest of the leaf's budget reaches, and ``ahead``, the tokens before it; null without a rest."""
    within = rows.join(shares.filter("rest > 0"), names).withColumn("place", _place("whole")).withColumn("bucket", F.substring("place", 1, 3))
    sums = within.groupBy(*names, "bucket", "rest").agg(F.sum("n_tokens").alias("inside"))
    sums = sums.withColumn("before", F.sum("inside").over(Window.partitionBy(*names).orderBy("bucket")) - F.col("inside"))
    last = table(sums.filter("before < rest and before + inside >= rest").select(*names, "bucket", "before"), "buckets")  # one for each leaf
    near = within.join(_small(last), [*names, "bucket"]).groupBy(*names, "place", "id", "n_tokens", "rest", "before").agg(F.count(F.lit(1)).alias("rows"))
    at = Window.partitionBy(*names).orderBy("place", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("ahead", F.col("before") + F.coalesce(F.sum(F.col("n_tokens") * F.col("rows")).over(at), F.lit(0))).filter("ahead < rest")
    end = F.struct("place", "id", "n_tokens")
    ends = near.groupBy(*names).agg(F.max(end).alias("end"), F.max_by("ahead", end).alias("ahead"))
    return table(shares.join(ends, names, "left"), "ends")


def _place(epoch: str) -> Column:
    return F.md5(F.concat_ws(":", "seed", epoch, F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), "blank"))).cast("binary"))


def _small(leaves: DataFrame) -> DataFrame:
    """A written table of a row for each leaf, broadcast if it has MOST_LEAVES at most."""
    return F.broadcast(leaves) if leaves.count() <= MOST_LEAVES else leaves


def mix(documents: DataFrame, levels: dict[str, str], weights: dict[str, str], budget: float | int, max_epochs: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the levels, epoch, n_tokens, n_taken and the ``keep`` columns, for every epoch
    that takes a document.  budget: tokens, or below 1 a share of all tokens.  weights: SQL
    over the levels, by level (1 where none is given)."""
    names = list(levels)
    text, key = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    docs = documents.select(
        key.alias("doc_id"), *[F.coalesce(F.expr(e).cast("string"), F.lit("(none)")).alias(c) for c, e in levels.items()],
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("n_tokens"), F.when(key.isNull(), F.xxhash64(text)).alias("blank"), F.lit(str(seed)).alias("seed"),
        F.coalesce(key, F.lit(-(2**63))).alias("id"), *[F.col(c).alias(f"_{c}") for c in keep],
    )
    counted = table(docs.drop(*[f"_{c}" for c in keep]), "tokens").filter("n_tokens > 0")
    docs = docs.filter("n_tokens > 0") if keep else counted
    leaves = table(counted.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    if budget < 1:
        share = Fraction(str(budget))
        budget = (leaves.agg(F.sum("tokens")).first()[0] or 0) * share.numerator // share.denominator
    shares = leaf_budgets(leaves, names, weights, int(budget), max_epochs)
    shares = table(shares.select(*names, F.expr(f"budget div (cap div {max_epochs})").cast("int").alias("whole"), F.expr(f"budget % (cap div {max_epochs})").alias("rest")), "shares")

    placed = docs.join(_small(_ends(counted, _small(shares), names)), names).withColumn("place", F.when(F.col("end").isNotNull(), _place("whole")))
    here = F.struct("place", "id", "n_tokens")
    placed = placed.withColumn("whole_too", F.coalesce(here < F.col("end"), F.lit(False)))
    out = ["doc_id", *names, "epoch", "n_tokens", "n_taken", *[F.col(f"_{c}").alias(c) for c in keep]]
    epochs = F.col("whole") - 1 + F.col("whole_too").cast("int")
    all_ = placed.filter("whole > 0 or whole_too").withColumn("epoch", F.explode(F.sequence(F.lit(0), epochs))).withColumn("n_taken", F.col("n_tokens"))
    # The document that the budget ends in, and rows that equal it.
    edge = placed.filter(here == F.col("end")).withColumn("n", F.row_number().over(Window.partitionBy(*names).orderBy("place")) - 1)
    edge = edge.withColumn("n_taken", F.least("n_tokens", F.col("rest") - F.col("ahead") - F.col("n") * F.col("n_tokens"))).filter("n_taken > 0").withColumn("epoch", F.col("whole"))
    return all_.select(*out).unionByName(edge.select(*out))
