"""Transcripts as tables: one row for each record, in file order.

A file is refused whole (it gives no rows) if it has a byte order mark, invalid UTF-8, a
blank line inside, a line that is no JSON object, or a uuid, parentUuid, type or kept uuid
of the wrong type.  Order is the line number ``pos``; it is never taken from Spark.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.functions import jsonpatch as jp
from foldline.sources.grouped import per_file

# Fixed values of the record format.
GUARDED = frozenset(["content-replacement", "marble-origami-commit", "marble-origami-snapshot", "worktree-state", "task-summary", "fork-context-ref"])
BOUNDARIES = frozenset(["compact_boundary", "microcompact_boundary"])
KEEP_LAST = frozenset(["last-prompt", "custom-title", "mode"])

SCHEMA = pa.schema([
    ("file_id", pa.string()), ("pos", pa.int32()), ("raw", pa.string()), ("ends_nl", pa.bool_()), ("type", pa.string()), ("uuid", pa.string()), ("parent", pa.string()),
    ("sidechain", pa.bool_()), ("guarded", pa.bool_()), ("boundary", pa.bool_()), ("keep", pa.list_(pa.string())), ("real_user", pa.bool_()), ("prompt", pa.bool_()), ("n_results", pa.int32()),
    ("last_class", pa.string()), ("inert_rule", pa.string()), ("notice_file", pa.string()), ("view_file", pa.string()), ("view_tool", pa.string()), ("view_id", pa.string()),
    ("uses", pa.list_(pa.struct([("id", pa.string()), ("name", pa.string())]))), ("marked", pa.bool_()),
])
SPARK_SCHEMA = "file_id string, pos int, raw string, ends_nl boolean, type string, uuid string, parent string, sidechain boolean, guarded boolean, boundary boolean, keep array<string>, real_user boolean, prompt boolean, n_results int, last_class string, inert_rule string, notice_file string, view_file string, view_tool string, view_id string, uses array<struct<id:string,name:string>>, marked boolean"


def blocks(root: dict, kind: str | None = None) -> list[dict]:
    """The object blocks of a record's content, of one type if asked."""
    return [b for b in jp.items(root, "message", "content") if isinstance(b, dict) and (kind is None or jp.text(b, "type") == kind)]


def _strict(root: dict, key: str) -> str | None:
    value = root.get(key)
    if value is not None and not isinstance(value, str):
        raise ValueError(key)
    return value


def parse(line: str) -> dict:
    """A record's object; ValueError if the line is none or its identity is malformed."""
    root = jp.loads(line)
    if not isinstance(root, dict):
        raise ValueError("not an object")
    for key in ("uuid", "parentUuid", "type"):
        _strict(root, key)
    return root


def _full_view(root: dict) -> tuple[str | None, str | None]:
    """The file that a result shows whole, and the tool that must have made it."""
    result = jp.get(root, "toolUseResult")
    if not isinstance(result, dict):
        return None, None
    if jp.text(result, "type") == "text" and jp.integer(result, "file", "startLine") == 1:
        lines = jp.integer(result, "file", "numLines")
        if lines is not None and lines == jp.integer(result, "file", "totalLines"):
            return jp.text(result, "file", "filePath") or None, "Read"
    if jp.text(result, "type") in ("create", "update"):
        return jp.text(result, "filePath") or None, "Write"
    return None, None


def _silent_stop(root: dict) -> bool:
    def empty(key: str) -> bool:
        value = root.get(key)
        return value is None or value == []

    return root.get("hasOutput") is not True and root.get("preventedContinuation") is not True and empty("hookErrors") and empty("hookAdditionalContext") and not jp.text(root, "stopReason")


def facts(root: dict) -> dict:
    """What the plan needs of a record besides its line."""
    kind, sub = _strict(root, "type"), jp.text(root, "subtype")
    content = jp.get(root, "message", "content")
    sidechain, summary = root.get("isSidechain") is True, root.get("isCompactSummary") is True
    boundary = kind == "system" and sub in BOUNDARIES
    keep = []
    if boundary:
        for u in jp.items(root, "compactMetadata", "preservedMessages", "allUuids"):
            if u is not None:
                if not isinstance(u, str):
                    raise ValueError("allUuids")
                keep.append(u)
    results = blocks(root, "tool_result")
    attached = jp.text(root, "attachment", "type") if kind == "attachment" else None
    inert = None
    if kind == "system" and sub == "stop_hook_summary" and _silent_stop(root):
        inert = "stop-hook-summary-strip"
    elif attached == "hook_success" and jp.text(root, "attachment", "hookEvent") in ("Stop", "PostToolUse") and not sidechain:
        inert = "hook-success-strip"
    view_file, view_tool = _full_view(root) if kind == "user" else (None, None)
    return {
        "type": kind, "uuid": _strict(root, "uuid"), "parent": _strict(root, "parentUuid"), "sidechain": sidechain, "boundary": boundary, "keep": keep,
        "guarded": kind in GUARDED or (kind == "user" and summary) or boundary or root.get("isVisibleInTranscriptOnly") is True,
        "real_user": kind == "user" and isinstance(content, str) and not summary, "prompt": kind == "user" and (isinstance(content, str) or (isinstance(content, list) and not results)), "n_results": len(results),
        "last_class": kind if kind in KEEP_LAST else "task_reminder" if attached == "task_reminder" and not sidechain else None, "inert_rule": inert,
        "notice_file": (jp.text(root, "attachment", "filename") or None) if attached == "edited_text_file" else None, "view_file": view_file, "view_tool": view_tool,
        "view_id": next((i for b in results if (i := jp.text(b, "tool_use_id"))), None) if view_file else None,
        "uses": [{"id": i, "name": n} for b in blocks(root, "tool_use") if (i := jp.text(b, "id")) and (n := jp.text(b, "name"))] if kind == "assistant" else [], "marked": "foldline" in root,
    }


def rows(file_id: str, data: bytes) -> list[dict]:
    """The rows of a file, none if it is refused."""
    try:
        if data.startswith(b"\xef\xbb\xbf"):
            return []
        lines = data.decode("utf-8").split("\n")
        ends = lines[-1] == ""
        if ends:
            lines.pop()
        return [{"file_id": file_id, "pos": i, "raw": x, "ends_nl": ends, **facts(parse(x.removesuffix("\r")))} for i, x in enumerate(lines)]
    except ValueError:
        return []


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            found = rows(posixpath.basename(path).removesuffix(".jsonl"), data)
            for i in range(0, len(found), 4096):
                yield pa.RecordBatch.from_pylist(found[i : i + 4096], SCHEMA)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """The files under a folder (``*.jsonl``, subfolders too) as they are now, to be read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").load(path)


def decoded(found: DataFrame) -> DataFrame:
    """The records of listed() files; file_id is the name."""
    return found.select("path", "content").mapInArrow(_decode, SPARK_SCHEMA)


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All transcripts under a folder."""
    return decoded(listed(spark, path))


def parsed(t: pa.Table) -> list[dict]:
    """The rows of one file (file_id, pos, line), none if it is refused."""
    t = t.sort_by("pos")
    return rows(t.column("file_id")[0].as_py(), "\n".join(t.column("line").to_pylist()).encode() + b"\n")


def _join(t: pa.Table) -> pa.Table:
    return pa.Table.from_pylist(parsed(t), SCHEMA)


def from_lines(lines: DataFrame) -> DataFrame:
    """The same from a table of file_id, pos and line (whole files, refused whole)."""
    return per_file(lines.select("file_id", "pos", "line"), _join, SPARK_SCHEMA)


def tolerant(spark: SparkSession, path: str) -> DataFrame:
    """file_id, line and node (VARIANT, null for a torn line) of every line that is not blank,
    for logs that may hold lines cut off by a crash."""
    text = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", "true").text(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl$", 1)
    line = F.regexp_replace("value", r"^\s+|\s+$", "")
    node = F.when(F.col("line").startswith("{"), F.try_parse_json("line"))
    return text.select(name.alias("file_id"), line.alias("line")).filter("line <> ''").withColumn("node", node)
