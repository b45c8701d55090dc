"""Queries that run the transcript engine on the driver's tables.

Each conversation stands for a session, each turn for a record of it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.functions.preview import minify, preview
from foldline.functions.shell import read_targets
from foldline.plans import compaction, housekeeping, metrics, verbs
from foldline.plans.catalog import query, read
from foldline.sources.transcripts import from_lines


#: Each line of session_lines(), and its bytes b.
LINES = """SELECT conv_id, turn, line, octet_length(encode(line)) AS b FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '{"type":"user",' || id || '"message":{"role":"user","content":' || to_json(text) || '}}'
 ELSE '{"type":"assistant",' || id || '"message":{"role":"' || role || '","content":[{"type":"text","text":' || to_json(text) || '}]}}' END AS line
FROM (SELECT *, '"uuid":"' || conv_id || '-' || turn || '",' || CASE WHEN turn > 0 THEN '"parentUuid":"' || conv_id || '-' || (turn - 1) || '",' ELSE '' END || '"sessionId":"' || conv_id || '",' AS id FROM conversations))"""


def session_lines(spark: SparkSession, d: str) -> DataFrame:
    """file_id, pos, line: conversations as transcripts."""
    uuid = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    parent = F.when(F.col("turn") > 0, uuid(F.col("turn") - 1))
    head = [F.lit("user").alias("type"), uuid(F.col("turn")).alias("uuid"), parent.alias("parentUuid"), F.col("conv_id").cast("string").alias("sessionId")]
    asks = F.to_json(F.struct(*head, F.struct(F.lit("user").alias("role"), F.col("text").alias("content")).alias("message")))
    block = F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    says = F.to_json(F.struct(F.lit("assistant").alias("type"), *head[1:], F.struct(F.col("role"), block.alias("content")).alias("message")))
    return read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file_id"), F.col("turn").cast("int").alias("pos"), F.when(F.col("role") == "user", asks).otherwise(says).alias("line"))


@query(f"SELECT CAST(conv_id AS VARCHAR) AS file_id, CAST(turn AS INT) AS pos, md5(line) AS md5, CAST(NULL AS VARCHAR) AS rule, CAST(NULL AS VARCHAR) AS refused FROM ({LINES})")
def compact_sessions(spark, d):
    """Sessions of words only, of which no rule may touch a byte; rule_queries has the others."""
    return compaction.compact_lines(session_lines(spark, d)).select("file_id", "pos", F.md5(F.col("line").cast("binary")).alias("md5"), "rule", "refused")


@query(f"""SELECT CAST(conv_id AS VARCHAR) AS file_id, CAST(sum(b + 1) AS BIGINT) AS bytes_before, CAST(sum(b + 1) AS BIGINT) AS bytes_after, CAST(0 AS BIGINT) AS removed, CAST(0 AS BIGINT) AS edited, CAST(NULL AS VARCHAR) AS refused FROM ({LINES}) GROUP BY conv_id""")
def compact_economics(spark, d):
    return compaction.economics(compaction.compact_lines(session_lines(spark, d)))


def _mirror(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    records = from_lines(session_lines(spark, d))
    every = compaction.missing_originals(records, spark.createDataFrame([], compaction.MIRROR))
    return records, every


@query("""SELECT CAST(conv_id AS VARCHAR) AS file_id, CAST(m + 1 + turn AS BIGINT) AS seq, 'u:' || conv_id || '-' || turn AS identity
FROM conversations JOIN (SELECT conv_id, max(turn) AS m FROM conversations WHERE turn % 2 = 0 GROUP BY conv_id) USING (conv_id) WHERE turn % 2 = 1""")
def archive_missing(spark, d):
    records, every = _mirror(spark, d)
    return compaction.missing_originals(records, every.filter("seq % 2 = 0")).select("file_id", "seq", "identity")


@query("""SELECT CAST(conv_id AS VARCHAR) AS file_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos, conv_id || '-' || turn AS uuid FROM conversations""")
def restore_order(spark, d):
    records, every = _mirror(spark, d)
    backwards = every.withColumn("seq", 1_000_000 - F.col("seq"))
    return verbs.restored(backwards, records, merged=True).select("file_id", "pos", F.get_json_object("line", "$.uuid").alias("uuid"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS file_id, CAST(turn AS BIGINT) AS seq, left(conv_id || '-' || turn, 8) AS ref, CAST(length(text) AS INT) AS chars, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS lines, CAST(length(text) // 4 AS BIGINT) AS tokens FROM conversations""")
def retrieve_info(spark, d):
    _, every = _mirror(spark, d)
    return verbs.measured(verbs.contents(every)).select("file_id", "seq", "ref", "chars", "lines", F.col("tokens").cast("long").alias("tokens"))


@query("""SELECT CAST(conv_id AS VARCHAR) AS file_id, CAST(sum(b) AS BIGINT) AS loaded_bytes, CAST(sum(b - b // 2) AS BIGINT) AS removed_bytes FROM (SELECT conv_id, octet_length(encode(text)) AS b FROM conversations) GROUP BY conv_id""")
def reclaimable_bytes(spark, d):
    rows = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("file_id"), F.concat_ws("-", "conv_id", "turn").alias("uuid"), F.octet_length("text").cast("long").alias("bytes"))
    _, every = _mirror(spark, d)
    return verbs.reclaimable(rows.withColumn("bytes", F.expr("bytes div 2")), every, rows, 200_000).select("file_id", "loaded_bytes", "removed_bytes")


def _targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [{"o_orderkey": k, "path": t.path, "lo": t.lo, "hi": t.hi} for k, c in zip(b.column("o_orderkey").to_pylist(), b.column("command").to_pylist(), strict=True) for t in read_targets(c)]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("o_orderkey", pa.int64()), ("path", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())]))


@query("""SELECT o_orderkey, 'src/' || o_custkey || '.py' AS path, CAST(o_orderkey % 50 + 1 AS INT) AS lo, CAST(o_orderkey % 50 + 40 AS INT) AS hi FROM orders WHERE o_orderstatus <> 'P'
UNION ALL SELECT o_orderkey, 'doc ' || o_custkey, 1, NULL FROM orders WHERE o_orderstatus = 'O'""")
def shell_reads(spark, d):
    o = read(spark, d, "orders")
    sed = F.format_string("sed -n '%d,%dp' src/%d.py", F.col("o_orderkey") % 50 + 1, F.col("o_orderkey") % 50 + 40, F.col("o_custkey"))
    command = F.when(F.col("o_orderstatus") == "F", sed).when(F.col("o_orderstatus") == "O", F.concat(sed, F.format_string("; echo and; /bin/cat 'doc %d'", "o_custkey"))).otherwise(F.concat(sed, F.lit(" | wc -l")))
    return o.select("o_orderkey", command.alias("command")).mapInArrow(_targets, "o_orderkey long, path string, lo int, hi int")


#: Calls by number modulo their count: tool, argument and output, KEY being the order's key; then
#: what the preview says, and the shortened output where it is not the output itself.
CALLS = [
    ("Bash", "make", "<persisted-output>\nFull output saved to: /tmp/KEY.txt\nmore", "output persisted to /tmp/KEY.txt", None),
    ("Bash", "pytest -q", "..\nFAILED tKEY::a - x\nFAILED tKEY::b - x\n=== 2 failed, KEY passed in 3s ===", "RESULT: 2 failed, KEY passed in 3s | first failures: tKEY::a, tKEY::b", None),
    ("Bash", "make", "ok\nerror: no KEY", "CONTAINS 'error:' :: error: no KEY", None),
    ("Edit", "src/KEY.py", "The file has been updated", "applied to src/KEY.py", None),
    ("Read", "a.py", "1\tdef fKEY():\n2\t  {\n3\tx", "3 lines :: def fKEY(): / x", None),
    ("Grep", "x", '[ { "b" :  KEY, "a" : 2 }, { } ]', "JSON array, 2 item(s) of objects with keys [a, b]", '[{"b":KEY,"a":2},{}]'),
    ("Grep", "x", '{ "z" : [ 1, 2, 3 ], "key" : "KEY" }', "JSON object, keys [key, z]", '{"z":[1,2,3],"key":"KEY"}'),
    ("Bash", "git status", "M KEY\nM b", "2 status line(s) :: M KEY / M b", None),
    ("Bash", "cat a b", "== one ==\nA KEY\n== two ==\n\nB", "2 sections | one: A KEY | two: B", None),
    ("Bash", "make | tail -3", "a\nb\nc\nKEY", "tail :: b / c / KEY", None),
    ("Bash", "make", " \n", "(no output)", None),
    ("Grep", "x", "KEY\n\nb\nc", "KEY / b", None),
    ("Grep", "x", "diff --git a b\n--- a\n+++ b\n@@ -1,5 +1,5 @@\n" + " one line that is the same\n" * 9 + "-KEY\n+y", "diff --git a b / --- a", "diff --git a b\n--- a\n+++ b\n@@ -1,5 +1,5 @@\n  [...9 unchanged lines...]\n-KEY\n+y"),
]


def _calls_sql() -> str:
    def cases(i: int) -> str:
        said = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'"
        return "replace(CASE o_orderkey % " + str(len(CALLS)) + "".join(f" WHEN {n} THEN {said(c[i] if c[i] is not None else c[2])}" for n, c in enumerate(CALLS)) + " END, 'KEY', CAST(o_orderkey AS VARCHAR))"

    return f"SELECT o_orderkey, {cases(3)} AS preview, {cases(4)} AS short FROM orders"


def _previews(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(c).to_pylist() for c in ("tool", "arg", "text")]
        yield pa.RecordBatch.from_arrays([b.column("o_orderkey"), pa.array([preview(*x) for x in zip(*cols, strict=True)], pa.string()), pa.array([minify(x) for x in cols[2]], pa.string())], names=["o_orderkey", "preview", "short"])


@query(_calls_sql())
def previews(spark, d):
    keys = read(spark, d, "orders").select("o_orderkey")
    call = F.get(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("tool", "arg", "text"), c, strict=False)]) for c in CALLS]), (F.col("o_orderkey") % len(CALLS)).cast("int"))
    own = lambda c: F.replace(call[c], F.lit("KEY"), F.col("o_orderkey").cast("string")).alias(c)
    return keys.select("o_orderkey", own("tool"), own("arg"), own("text")).mapInArrow(_previews, "o_orderkey long, preview string, short string")


@query(f"SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS uuid, CAST(b AS BIGINT) AS bytes FROM ({LINES})")
def record_sizes(spark, d):
    return housekeeping.record_sizes(session_lines(spark, d)).select("uuid", "bytes")


@query("""SELECT CAST(conv_id AS VARCHAR) AS file_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def refs_dump(spark, d):
    texts = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("ref"), F.col("turn").alias("seq"), F.lit(0).alias("n"), "text")
    return housekeeping.refs_dump(texts).withColumnRenamed("ref", "file_id")


@query("""SELECT band, count(*) AS files, CAST(sum(b) AS BIGINT) AS "before", CAST(sum(a) AS BIGINT) AS "after", round(100.0::DOUBLE * (1 - CAST(sum(a) AS DOUBLE) / CAST(sum(b) AS DOUBLE)), 4) AS saved_percent
FROM (SELECT conv_id, sum(octet_length(encode(text))) AS b, sum(least(octet_length(encode(text)), 400)) AS a, CASE WHEN sum(octet_length(encode(text))) < 2000 THEN 'short' ELSE 'long' END AS band FROM conversations GROUP BY conv_id) GROUP BY band""")
def savings_by_band(spark, d):
    size = F.octet_length("text").cast("long")
    files = read(spark, d, "conversations").groupBy("conv_id").agg(F.sum(size).alias("before"), F.sum(F.least(size, F.lit(400))).alias("after"))
    return metrics.savings(files, F.when(F.col("before") < 2000, "short").otherwise("long"))


@query("""SELECT count(CASE WHEN a < b THEN 1 END) AS wins, count(CASE WHEN a = b THEN 1 END) AS ties, count(CASE WHEN a > b THEN 1 END) AS losses, quantile_cont(CAST(b - a AS DOUBLE), 0.5) AS median_gap
FROM (SELECT conv_id, CAST(sum(CASE WHEN role = 'user' THEN octet_length(encode(text)) ELSE 0 END) AS BIGINT) AS a, CAST(sum(CASE WHEN role = 'assistant' THEN octet_length(encode(text)) ELSE 0 END) AS BIGINT) AS b FROM conversations GROUP BY conv_id)""")
def compare_sizes(spark, d):
    part = lambda r: F.sum(F.when(F.col("role") == r, F.octet_length("text")).otherwise(0)).cast("long")
    return metrics.compare(read(spark, d, "conversations").groupBy("conv_id").agg(part("user").alias("a"), part("assistant").alias("b")), "a", "b")


@query("""SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(max(value), 6) AS "max", round(max(CASE WHEN r = least(n - 1, floor(n * 0.9)) THEN value END), 6) AS p90, round(max(CASE WHEN r = least(n - 1, floor(n * 0.95)) THEN value END), 6) AS p95
FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type""")
def latency_report(spark, d):
    out = metrics.rank_percentiles(read(spark, d, "events"), ["event_type"], "value", {"p90": 0.9, "p95": 0.95})
    return out.select("event_type", *[F.round(c, 6).alias(c) for c in ("mean", "median", "max", "p90", "p95")])


@query("""SELECT conv_id, turn FROM (SELECT *, max(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id) AS cut FROM conversations) WHERE cut IS NULL OR turn > cut OR turn = 0""")
def model_visible(spark, d):
    return metrics.model_visible(read(spark, d, "conversations"), F.col("role") == "system", F.col("turn") == 0, "conv_id", "turn").select("conv_id", "turn")


@query("""SELECT doc_id, CASE WHEN reason IS NULL THEN choice END AS baseline, reason FROM (SELECT *, CASE WHEN choice IS NULL THEN CASE WHEN o THEN 'no clean backup' ELSE 'archive does not cover it' END WHEN n_chars < 1024 THEN 'too small' END AS reason
FROM (SELECT doc_id, n_chars, o, CASE WHEN NOT m AND NOT o THEN 'self' WHEN m AND NOT o AND c THEN 'archive' WHEN o AND b THEN 'backup' END AS choice
FROM (SELECT doc_id, n_chars, doc_id % 2 = 0 AS m, doc_id % 5 = 0 AS o, doc_id % 3 = 0 AS c, doc_id % 7 = 0 AS b FROM documents)))""")
def baseline_choice(spark, d):
    flags = {n: F.col("doc_id") % k == 0 for n, k in (("marked", 2), ("other_tool", 5), ("covered", 3), ("backup", 7))}
    return metrics.baseline(read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("bytes")).withColumns(flags)).select("doc_id", "baseline", "reason")


@query("""WITH RECURSIVE e AS (SELECT user_id, name, s, row_number() OVER (PARTITION BY user_id ORDER BY s, name) AS k FROM (SELECT user_id, floor(epoch(ts)) AS s,
 CASE event_type WHEN 'view' THEN 'Stop' WHEN 'click' THEN 'UserPromptSubmit' WHEN 'signup' THEN 'SessionStart' WHEN 'purchase' THEN 'SessionEnd' WHEN 'error' THEN 'PreCompact' END AS name FROM events)),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS name, CAST(NULL AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS last, FALSE AS ended, FALSE AS woke, CAST(NULL AS VARCHAR) AS action FROM e WHERE k = 1
 UNION ALL SELECT user_id, k, name, s, CASE WHEN skip THEN last ELSE s END, CASE WHEN skip THEN ended ELSE name = 'SessionEnd' END, woke, CASE WHEN skip THEN 'skip' ELSE 'compact' END
 FROM (SELECT *, name = 'Stop' AND NOT woke AND coalesce(s - last < 120, FALSE) AS skip FROM (SELECT e.user_id, e.k, e.name, e.s, r.last, r.ended, r.ended AND e.name IN ('UserPromptSubmit', 'Stop', 'SessionStart') AS woke FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)))
SELECT CAST(user_id AS VARCHAR) AS session_id, name AS hook_event_name, CAST(s AS DOUBLE) AS "at", action, woke FROM r WHERE k > 0""")
def route_events(spark, d):
    """Events routed one by one per user, as the stream does it, on a table."""
    from foldline.streaming import events

    names = F.create_map(*[F.lit(x) for kv in {"view": "Stop", "click": "UserPromptSubmit", "signup": "SessionStart", "purchase": "SessionEnd", "error": "PreCompact"}.items() for x in kv])
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id"), names[F.col("event_type")].alias("hook_event_name"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("at"))
    return events.route(e)
