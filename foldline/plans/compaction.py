"""The compaction plan: archive first, decide, rewrite, validate, commit what holds.

Records come from sources.transcripts, or straight from lines.  The rules that edit content
need all of a session's records and one another's edits, so a session's records meet in one
task, in one exchange on file_id; whatever else a record's fate depends on (kept uuids, age
clocks, removals) is read there from the parsed facts, in two passes over the session.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from foldline.functions import jsonpatch as jp
from foldline.plans.session import Session, compact_session
from foldline.sources.grouped import per_file
from foldline.sources.transcripts import from_lines, parsed

OUT = "file_id string, pos int, line string, rule string, refused string, bytes long"
MIRROR = "file_id string, seq long, identity string, uuid string, line string"


@F.pandas_udf(StringType())
def _without_leaf(lines: pd.Series) -> pd.Series:
    """Lines (nulls stay) as compact JSON without leafUuid, if they have one."""

    def short(line: str) -> str:
        try:
            root = jp.loads(line)
        except ValueError:
            return line
        return jp.dumps({k: v for k, v in root.items() if k != "leafUuid"}) if isinstance(root, dict) and root.get("leafUuid") is not None else line

    return lines.map(short, na_action="ignore")


def with_identity(lines: DataFrame) -> DataFrame:
    """identity of each line (uuid, line): its uuid, else a hash of it without leafUuid, which
    a rewrite may change.  Only such lines are parsed again."""
    odd = F.col("uuid").isNull() & F.contains("line", F.lit('"leafUuid"'))
    body = F.coalesce(_without_leaf(F.when(odd, F.col("line"))), F.col("line"))
    return lines.withColumn("identity", F.coalesce(F.concat(F.lit("u:"), "uuid"), F.concat(F.lit("h:"), F.upper(F.sha2(body, 256)))))


def missing_originals(records: DataFrame, mirror: DataFrame) -> DataFrame:
    """Rows to append to the mirror: originals it lacks.  A uuid is archived once, its first
    copy; a record without one as many times as it occurs.  Records that compaction wrote are no originals."""
    lines = records.filter("not marked").select("file_id", "pos", "uuid", F.regexp_replace("raw", "\r$", "").alias("line"))
    have = mirror.groupBy("file_id", "identity").agg(F.count(F.lit(1)).alias("_have"))
    copy = F.row_number().over(Window.partitionBy("file_id", "identity").orderBy("pos"))
    new = with_identity(lines).withColumn("_copy", copy).join(have, ["file_id", "identity"], "left")
    new = new.filter("if(uuid is null, _copy > coalesce(_have, 0), _copy = 1 and _have is null)")
    start = mirror.groupBy("file_id").agg(F.max("seq").alias("_s"))
    return new.join(start, "file_id", "left").select("file_id", (F.coalesce("_s", F.lit(-1)) + 1 + F.col("pos")).alias("seq"), "identity", "uuid", "line")


def annotate(rows: list[dict]) -> None:
    """Adds preserved, turns_after, results_after and drop_rule (12, 14 to 17 of the catalog) to
    each of a session's records, all read from the originals."""
    kept = {u for r in rows if r["boundary"] for u in r["keep"]}
    tools: dict[str, str] = {}
    newest: dict[str, int] = {}  # the last record of a class that only keeps its last
    shown: dict[str, int] = {}  # the last record that shows a file whole: a notice, a read or a write
    for at, r in enumerate(rows):
        tools.update((u["id"], u["name"]) for u in r["uses"] or ())
        if r["last_class"]:
            newest[r["last_class"]] = at
        if r["notice_file"]:
            shown[r["notice_file"]] = at
        if r["view_file"] and tools.get(r["view_id"]) == r["view_tool"]:
            shown[r["view_file"]] = at
    turns = results = 0
    for at in reversed(range(len(rows))):
        r = rows[at]
        r["turns_after"], r["results_after"] = turns, results
        turns, results = turns + r["prompt"], results + r["n_results"]
        r["preserved"] = r["uuid"] is not None and r["uuid"] in kept
        rule = None
        if not r["guarded"] and not r["preserved"]:
            if at < newest.get(r["last_class"], 0):
                rule = "task-reminder-keep-last" if r["last_class"] == "task_reminder" else "metadata-keep-last"
            elif at < shown.get(r["notice_file"], 0):
                rule = "edited-text-file-supersession"
            elif r["inert_rule"] and at < len(rows) - 1:
                rule = r["inert_rule"]
        r["drop_rule"] = rule


def _compacted(rows: list[dict], parents: dict[str, set[str]]) -> pa.Table:
    annotate(rows)
    s = Session(rows[0]["file_id"], rows, parents)
    lines, refused = compact_session(s)
    return pa.table({
        "file_id": [s.id] * len(rows), "pos": pa.array([r["pos"] for r in rows], pa.int32()), "line": pa.array([r["raw"] for r in rows] if refused else lines, pa.string()),
        "rule": pa.array([None if refused else r.rule for r in s.records], pa.string()), "refused": pa.array([refused] * len(rows), pa.string()),
        "bytes": pa.array([jp.utf8(r["raw"]) + 1 for r in rows], pa.int64()),
    })


def _rewrite(t: pa.Table) -> pa.Table:
    rows = t.sort_by("pos").to_pylist()
    parents: dict[str, set[str]] = {}
    for r in rows:
        for p in r["fork_of"] or ():
            parents.setdefault(p, set()).add(r["uuid"])
    return _compacted(rows, parents)


def rewrite(records: DataFrame, copies: DataFrame | None = None) -> DataFrame:
    """file_id, pos, line (null if the record goes), rule (what changed it), refused (why the
    whole file stays as it is, else null) and bytes (of the original, with its line end).
    copies (file_id, uuid, parent): records that a fork copied from its parent, whose archive
    the fork's has adopted."""
    if copies is None:
        rows = records.withColumn("fork_of", F.lit(None).cast("array<string>"))
    else:
        rows = records.join(copies.groupBy("file_id", "uuid").agg(F.collect_set(F.lower("parent")).alias("fork_of")), ["file_id", "uuid"], "left")
    return per_file(rows, _rewrite, OUT)


def _compact(t: pa.Table) -> pa.Table:
    rows = parsed(t)
    return _compacted(rows, {}) if rows else pa.table({f.name: pa.array([], f.type) for f in _OUT})


_OUT = pa.schema([("file_id", pa.string()), ("pos", pa.int32()), ("line", pa.string()), ("rule", pa.string()), ("refused", pa.string()), ("bytes", pa.int64())])


def compact_lines(lines: DataFrame) -> DataFrame:
    """The plan over a table of file_id, pos, line: parsed and rewritten in one task for each
    session, without an archive."""
    return per_file(lines.select("file_id", "pos", "line"), _compact, OUT)


def violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """file_id, reason: what a rewrite may never do, checked over the two tables of lines
    (file_id, pos, line) independently of the rewrite itself."""
    b, a = from_lines(before.select("file_id", "pos", "line")), from_lines(after.filter("line is not null").select("file_id", "pos", "line"))
    gone = b.filter("uuid is not null").select("file_id", "uuid").join(a.select("file_id", "uuid"), ["file_id", "uuid"], "left_anti")
    parents = a.select("file_id", F.col("parent").alias("uuid")).join(gone, ["file_id", "uuid"], "left_semi").select("file_id", F.lit("dangling-parent").alias("reason"))
    tail = lambda d: d.groupBy("file_id").agg(F.max_by(F.coalesce("uuid", "raw"), "pos").alias("tail"))
    tails = tail(b).join(tail(a).withColumnRenamed("tail", "new"), "file_id", "left").filter("new is null or new <> tail").select("file_id", F.lit("tail-uuid").alias("reason"))
    return parents.unionByName(tails).distinct()


def economics(result: DataFrame) -> DataFrame:
    """Bytes before and after, records removed and edited, for each file of a rewrite()."""
    return result.groupBy("file_id").agg(
        F.sum("bytes").cast("long").alias("bytes_before"), F.sum(F.coalesce(F.octet_length("line") + 1, F.lit(0))).cast("long").alias("bytes_after"),
        F.count_if(F.col("line").isNull()).alias("removed"), F.count_if(F.col("line").isNotNull() & F.col("rule").isNotNull()).alias("edited"), F.max("refused").alias("refused"),
    )
