"""Queries on the driver's tables, one for each relational operator, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.functions import columns as fc
from foldline.operators import folds, joins, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.running_count(read(spark, d, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user", "turn_no")
    return rows.groupBy("conv_id", "turn_no").agg(F.count(F.lit(1)).cast("long").alias("n_rows"), F.sum(F.octet_length("text")).cast("long").alias("n_bytes"))


TURNS = """(SELECT conv_id, turn_no, count(*) AS n_rows, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes
 FROM (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS turn_no FROM conversations) GROUP BY conv_id, turn_no)"""


@query("""SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_id FROM documents WHERE octet_length(encode(text)) >= 1024) WHERE doc_id <> first_id""")
def document_dedup(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text").filter(F.octet_length("text") >= 1024)
    return folds.first_copies(docs, F.col("text"), ["doc_id"]).select("doc_id", F.col("first.doc_id").alias("first_id")).filter("doc_id <> first_id")


@query("""SELECT event_id, user_id, clicks_after, views_after, clicks_after >= 15 OR views_after >= 30 AS mid, clicks_after >= 40 OR views_after >= 100 AS old
FROM (SELECT event_id, user_id, CAST(coalesce(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS clicks_after,
 CAST(coalesce(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS views_after FROM events
 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))""")
def age_clock(spark, d):
    e = windows.age_clock(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], {"clicks_after": F.col("event_type") == "click", "views_after": F.col("event_type") == "view"})
    return e.select("event_id", "user_id", "clicks_after", "views_after", F.expr("clicks_after >= 15 or views_after >= 30").alias("mid"), F.expr("clicks_after >= 40 or views_after >= 100").alias("old"))


@query("""SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def keep_last(spark, d):
    return windows.keep_last(read(spark, d, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query(f"SELECT conv_id, turn_no, CAST(n_rows AS BIGINT) AS n_rows, n_bytes FROM {TURNS}")
def turn_segments(spark, d):
    return _turns(spark, d)


@query("""SELECT l_orderkey, l_linenumber FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND (b.l_orderkey, b.l_linenumber) > (a.l_orderkey, a.l_linenumber)
 AND b.l_linenumber <= a.l_linenumber AND b.l_linenumber + b.l_quantity >= a.l_linenumber + a.l_quantity)""")
def interval_supersession(spark, d):
    rows = read(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", (F.col("l_linenumber") + F.col("l_quantity")).alias("hi"))
    return joins.superseded(rows, ["l_partkey"], ["l_orderkey", "l_linenumber"], "l_linenumber", "hi").select("l_orderkey", "l_linenumber")


@query(r"""SELECT doc_id, left(text, h) || chr(10) || '[... ' || (b - 2048) || ' bytes trimmed by foldline]' || chr(10) || right(text, h) AS trimmed
FROM (SELECT doc_id, text, octet_length(encode(text)) AS b, least(924, length(text) // 2) AS h FROM documents) WHERE b > 2048""")
def head_tail_trim(spark, d):
    docs = read(spark, d, "documents").filter(F.octet_length("text") > 2048)
    return docs.select("doc_id", fc.head_tail(F.col("text"), 2048).alias("trimmed"))


@query("""SELECT event_id, click_id FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click_id FROM events) WHERE event_type = 'error'""")
def as_of_backward(spark, d):
    e = read(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return joins.as_of_backward(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "click", F.col("event_id"), "click_id").select("event_id", "click_id")


@query(r"""SELECT event_id, CASE WHEN json_type(props, '$.k') IN ('BIGINT', 'UBIGINT') THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def json_field(spark, d):
    raw = F.get_json_object("props", "$.k")
    return read(spark, d, "events").select("event_id", F.when(fc.is_json_number(raw), raw.try_cast("bigint")).alias("k"))


@query("""SELECT event_id, last_value(CASE WHEN event_type <> 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ancestor_id FROM events""")
def ancestor_walk(spark, d):
    from foldline.sources.scratch import Scratch

    from pyspark.sql import Window

    e = read(spark, d, "events").select("event_id", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("parent"), (F.col("event_type") == "view").alias("gone"))
    return joins.surviving_ancestor(e, "gone", "event_id", "parent", checkpoint=Scratch(spark).cut).select("event_id", F.col("ancestor").alias("ancestor_id"))


@query("""SELECT conv_id, string_agg(role || ':' || octet_length(encode(text)), ' ' ORDER BY turn) AS digest FROM conversations GROUP BY conv_id""")
def turn_digest(spark, d):
    return folds.ordered_digest(read(spark, d, "conversations"), ["conv_id"], "turn", F.concat("role", F.lit(":"), F.octet_length("text").cast("string")), " ")


@query(r"""SELECT doc_id, CAST(octet_length(encode(t)) AS BIGINT) AS n_bytes, md5(t) AS md5 FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS t FROM documents)""")
def newline_squeeze(spark, d):
    t = fc.squeeze(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.octet_length(t).cast("long").alias("n_bytes"), F.md5(t.cast("binary")).alias("md5"))


@query("""SELECT role, CAST(quantile_cont(octet_length(encode(text)), 0.5) AS DOUBLE) AS median_bytes, CAST(max(octet_length(encode(text))) AS BIGINT) AS max_bytes FROM conversations GROUP BY role""")
def median_bytes_by_role(spark, d):
    return read(spark, d, "conversations").groupBy("role").agg(F.percentile(F.octet_length("text"), F.lit(0.5)).alias("median_bytes"), F.max(F.octet_length("text")).cast("long").alias("max_bytes"))


@query("""SELECT user_id, event_type, CAST(greatest(coalesce(a, 0), coalesce(b, 0)) AS BIGINT) AS copies
FROM (SELECT user_id, event_type, count(*) AS a FROM events WHERE event_id % 2 = 0 GROUP BY ALL) FULL JOIN (SELECT user_id, event_type, count(*) AS b FROM events WHERE event_id % 2 = 1 GROUP BY ALL) USING (user_id, event_type)""")
def multiset_max(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "event_id")
    return joins.multiset_max(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), ["user_id", "event_type"])


@query("""SELECT event_id, copy_no FROM (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS copy_no FROM events WHERE event_id % 2 = 0) a
LEFT JOIN (SELECT user_id, event_type, count(*) AS have FROM events WHERE event_id % 3 = 0 GROUP BY ALL) b USING (user_id, event_type) WHERE copy_no > coalesce(have, 0)""")
def anti_append(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "event_id")
    return joins.append_missing(e.filter("event_id % 2 = 0"), e.filter("event_id % 3 = 0"), ["user_id", "event_type"], ["event_id"]).select("event_id", "copy_no")


@query("""WITH c AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders)
SELECT count(*) AS n_orders, CAST(sum(greatest(coalesce(a.size, b.size, c.cents) - c.cents // 2, 0)) AS BIGINT) AS removed FROM c
LEFT JOIN (SELECT o_orderkey, cents * 9 // 10 AS size FROM c WHERE o_orderkey % 2 = 0) a USING (o_orderkey) LEFT JOIN (SELECT o_orderkey, cents * 8 // 10 AS size FROM c WHERE o_orderkey % 3 = 0) b USING (o_orderkey)""")
def coalesce_pricing(spark, d):
    c = read(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    a = c.filter("o_orderkey % 2 = 0").selectExpr("o_orderkey", "cents * 9 div 10 as a")
    b = c.filter("o_orderkey % 3 = 0").selectExpr("o_orderkey", "cents * 8 div 10 as b")
    priced = c.join(a, "o_orderkey", "left").join(b, "o_orderkey", "left")
    return priced.agg(F.count(F.lit(1)).alias("n_orders"), F.sum(F.expr("greatest(coalesce(a, b, cents) - cents div 2, 0)")).cast("long").alias("removed"))


@query("""SELECT user_id, count(*) AS n_ops, min(r) < 0 AS underflow, sum(s) = 0 AS settled FROM (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r
 FROM (SELECT user_id, ts, event_id, CASE event_type WHEN 'signup' THEN 1 ELSE -1 END AS s FROM events WHERE event_type IN ('signup', 'purchase'))) GROUP BY user_id""")
def queue_balance(spark, d):
    return folds.queue_balance(read(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "purchase")


@query("""SELECT user_id, CAST(segment_no AS BIGINT) AS segment_no, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, segment_no ORDER BY ts, event_id) AS n
 FROM (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS segment_no FROM events) WHERE event_type = 'view') WHERE n = 1""")
def segment_first(spark, d):
    e = read(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return windows.first_in_segment(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", F.col("event_type") == "view").select("user_id", "segment_no", "event_id")


@query("""SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n > 6""")
def recency_keep(spark, d):
    return windows.all_but_newest(read(spark, d, "events").select("user_id", "ts", "event_id"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 6).select("event_id")


@query("""WITH l AS (SELECT doc_id, i AS line_no, ls[i + 1] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) x, unnest(range(0, len(ls))) u(i)),
f AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) AS n, first_value(doc_id) OVER (PARTITION BY line ORDER BY doc_id, line_no) AS first_id FROM l WHERE octet_length(encode(line)) >= 40)
SELECT doc_id, CAST(line_no AS BIGINT) AS line_no, first_id FROM f WHERE n > 1""")
def repeated_lines(spark, d):
    lines = read(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.octet_length("line") >= 40)
    found = folds.first_copies(lines, F.col("line"), ["doc_id", "line_no"])
    return found.filter(F.struct("doc_id", "line_no") > F.col("first")).select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("first.doc_id").alias("first_id"))


@query("""SELECT band, count(*) AS n, CAST(sum(b) AS BIGINT) AS before_bytes, CAST(sum(least(b, 2048)) AS BIGINT) AS after_bytes, round(100.0::DOUBLE * (1 - CAST(sum(least(b, 2048)) AS DOUBLE) / CAST(sum(b) AS DOUBLE)), 4) AS saved_percent
FROM (SELECT octet_length(encode(text)) AS b, CASE WHEN octet_length(encode(text)) < 1024 THEN 'small' WHEN octet_length(encode(text)) < 8192 THEN 'medium' ELSE 'large' END AS band FROM documents) GROUP BY band""")
def payload_bands(spark, d):
    b = read(spark, d, "documents").select(F.octet_length("text").cast("long").alias("b")).withColumn("band", F.expr("case when b < 1024 then 'small' when b < 8192 then 'medium' else 'large' end"))
    out = b.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("before_bytes"), F.sum(F.least("b", F.lit(2048))).alias("after_bytes"))
    return out.withColumn("saved_percent", fc.percent_saved(F.col("before_bytes").cast("double"), F.col("after_bytes").cast("double")))


@query("""SELECT lang, source, n, chars, round(CAST(chars AS DOUBLE) / CAST(sum(chars) OVER () AS DOUBLE), 6) AS share FROM (SELECT lang, source, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang, source)""")
def census(spark, d):
    g = read(spark, d, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))
    total = g.agg(F.sum("chars").alias("_total"))
    return g.crossJoin(F.broadcast(total)).select("lang", "source", "n", "chars", F.round(F.col("chars").cast("double") / F.col("_total").cast("double"), 6).alias("share"))


@query(f"""SELECT CAST(t AS INT) AS threshold, CAST(sum(CASE WHEN n_rows >= t THEN 1 ELSE 0 END) AS BIGINT) AS turns, CAST(sum(CASE WHEN n_rows >= t THEN n_bytes ELSE 0 END) AS BIGINT) AS n_bytes FROM {TURNS}, range(1, 11) r(t) GROUP BY t""")
def threshold_sweep(spark, d):
    by_n = _turns(spark, d).groupBy("n_rows").agg(F.count(F.lit(1)).alias("c"), F.sum("n_bytes").alias("b"))
    cells = by_n.withColumn("threshold", F.explode(F.sequence(F.lit(1), F.lit(10))))
    return cells.groupBy("threshold").agg(F.sum(F.expr("if(n_rows >= threshold, c, 0)")).cast("long").alias("turns"), F.sum(F.expr("if(n_rows >= threshold, b, 0)")).cast("long").alias("n_bytes"))


@query(f"""SELECT CAST(t AS INT) AS min_rows, CAST(sum(CASE WHEN n_rows >= t AND gain > 0 THEN gain ELSE 0 END) AS BIGINT) AS saved, CAST(sum(CASE WHEN n_rows >= t AND gain <= 0 THEN -gain ELSE 0 END) AS BIGINT) AS waste,
 CAST(sum(CASE WHEN n_rows < t AND gain > 0 THEN gain ELSE 0 END) AS BIGINT) AS missed FROM (SELECT *, n_bytes - (300 + 120 * n_rows) AS gain FROM {TURNS}), unnest([1, 2, 3, 5]) g(t) GROUP BY t""")
def gate_scoring(spark, d):
    t = _turns(spark, d).withColumn("gain", F.expr("n_bytes - (300 + 120 * n_rows)")).withColumn("min_rows", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 5)])))
    part = {"saved": "n_rows >= min_rows and gain > 0, gain", "waste": "n_rows >= min_rows and gain <= 0, -gain", "missed": "n_rows < min_rows and gain > 0, gain"}
    return t.groupBy("min_rows").agg(*[F.sum(F.expr(f"if({x}, 0)")).cast("long").alias(n) for n, x in part.items()])


@query("""SELECT event_id FROM events a WHERE event_type = 'view' AND EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND (b.ts, b.event_id) > (a.ts, a.event_id))""")
def latest_full_view(spark, d):
    e = read(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    return joins.superseded_by_later(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view", F.col("event_type") == "purchase").select("event_id")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def coverage_check(spark, d):
    done = read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return joins.missing(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), done, ["l_orderkey"])


@query("""SELECT prefix, min(k) AS id FROM (SELECT sha256(c_name) AS k, left(sha256(c_name), 3) AS prefix FROM customer) GROUP BY prefix HAVING count(DISTINCT k) = 1""")
def prefix_lookup(spark, d):
    return joins.unique_prefix(read(spark, d, "customer").select(F.sha2("c_name", 256).alias("id")), "id", 3)


@query("""SELECT doc_id, CAST(i AS BIGINT) AS line_no, ls[i + 1] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents) x, unnest(range(0, len(ls))) u(i) WHERE contains(lower(ls[i + 1]), 'tion')""")
def grep_lines(spark, d):
    docs = read(spark, d, "documents").filter(F.contains(F.lower("text"), F.lit("tion")))
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(F.contains(F.lower("line"), F.lit("tion"))).withColumn("line_no", F.col("line_no").cast("long"))


@query("""SELECT page_id, left(sha256(url), 8) AS ref FROM pages""")
def ref_projection(spark, d):
    return read(spark, d, "pages").select("page_id", fc.ref(F.col("url")).alias("ref"))


@query("""SELECT count(*) AS n, round(CAST(sum(v) AS DOUBLE) / count(*), 4) AS trimmed_mean FROM (SELECT length(text) AS v, row_number() OVER (ORDER BY length(text)) AS r, count(*) OVER () AS c FROM documents) WHERE r > c * 5 // 100 AND r <= c - c * 5 // 100""")
def trimmed_mean(spark, d):
    kept = windows.middle(read(spark, d, "documents").select(F.length("text").alias("v")), "v", 5)
    return kept.agg(F.sum("kept").cast("long").alias("n"), F.round(F.sum(F.col("v") * F.col("kept")).cast("double") / F.sum("kept"), 4).alias("trimmed_mean"))


@query("""SELECT event_id FROM events WHERE event_type IN ('signup', 'purchase') AND NOT coalesce(value >= 100, FALSE)""")
def class_filter(spark, d):
    return read(spark, d, "events").filter(F.col("event_type").isin("signup", "purchase") & ~F.coalesce(F.col("value") >= 100, F.lit(False))).select("event_id")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Turns of each conversation with their digest, and whether folding one would pay."""
    rows = windows.running_count(read(spark, d, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user", "turn_no")
    lines = folds.ordered_digest(rows, ["conv_id", "turn_no"], "turn", F.concat("role", F.lit(" "), F.octet_length("text").cast("string"), F.lit("b :: "), F.substring("text", 1, 80)), "\n")
    return lines.join(_turns(spark, d), ["conv_id", "turn_no"]).withColumn("pays", F.octet_length("digest") * 1.1 < F.col("n_bytes"))
