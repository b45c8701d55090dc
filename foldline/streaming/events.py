"""Lifecycle events of sessions as a stream.

Events (session_id, hook_event_name, at) are routed with a state for each session: when it
was last compacted and whether it has ended.  A stop within the throttle of the last pass
is skipped, unless the session had ended and woke up; the end is remembered once, by the
next prompt, stop or start.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foldline.plans import compaction
from foldline.sources import transcripts

PASSES = frozenset(["UserPromptSubmit", "Stop", "SessionEnd", "PreCompact", "SessionStart"])
THROTTLE_SECONDS = 120.0
EVENT = "session_id string, hook_event_name string, at double"
ACTION = "session_id string, hook_event_name string, at double, action string, woke boolean"


def decide(event: str, at: float, last: float | None, ended: bool) -> tuple[str, bool, float | None, bool]:
    """(action, woke, last pass, ended) after an event.  Actions: compact, compact-agent,
    skip (throttled), ignore."""
    if event == "SubagentStop":
        return "compact-agent", False, last, ended
    if event not in PASSES:
        return "ignore", False, last, ended
    woke = ended and event in ("UserPromptSubmit", "Stop", "SessionStart")
    if event == "Stop" and not woke and last is not None and at - last < THROTTLE_SECONDS:
        return "skip", False, last, ended
    return "compact", woke, at, event == "SessionEnd"


def _fold(session: str, rows: pd.DataFrame, last: float | None, ended: bool) -> tuple[pd.DataFrame, float | None, bool]:
    out = []
    for name, at in rows.sort_values(["at", "hook_event_name"], kind="stable")[["hook_event_name", "at"]].itertuples(index=False):
        action, woke, last, ended = decide(name, float(at), last, ended)
        out.append((session, name, float(at), action, woke))
    return pd.DataFrame(out, columns=["session_id", "hook_event_name", "at", "action", "woke"]), last, ended


def _route(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, ended = state.get if state.exists else (-1.0, False)
    out, last, ended = _fold(key[0], pd.concat(list(frames)), None if last < 0 else last, ended)
    state.update((-1.0 if last is None else last, ended))
    yield out


def _route_all(key: tuple[str], rows: pd.DataFrame) -> pd.DataFrame:
    return _fold(key[0], rows, None, False)[0]


def route(events: DataFrame) -> DataFrame:
    """What to do at each event, for a stream or a table of EVENT rows."""
    by_session = events.select("session_id", "hook_event_name", "at").filter("hook_event_name is not null and at is not null").groupBy("session_id")
    if events.isStreaming:
        return by_session.applyInPandasWithState(_route, ACTION, "last double, ended boolean", "update", GroupStateTimeout.NoTimeout)
    return by_session.applyInPandas(_route_all, ACTION)


def archive_into(mirror_path: str):
    """A foreachBatch function: appends each batch's records that the archive lacks.  A batch
    is rows of file_id, pos, line; a batch that is run again appends nothing twice."""

    def run(batch: DataFrame, _: int) -> None:
        from foldline.plans.verbs import read_mirror

        records = transcripts.from_lines(batch)
        compaction.missing_originals(records, read_mirror(batch.sparkSession, mirror_path)).write.mode("append").parquet(mirror_path)

    return run


def run_passes(path: str, mirror_path: str, out_path: str, stamps_path: str, state_path: str, swept=None):
    """A foreachBatch function over routed actions: stamps sessions that start before anything
    is rewritten, runs one pass over the sessions to compact (at a start, an end or a wake
    also over the agents' transcripts in the session's own folder), stamps sessions that end
    after it, and at such a boundary hands swept (if given) the archives to delete.  Sessions
    of one batch are one pass, so no session has two writers."""

    def run(batch: DataFrame, _: int) -> None:
        from foldline.plans import housekeeping, verbs
        from foldline.sources import jsonl

        spark = batch.sparkSession
        todo = batch.filter("action = 'compact'").groupBy(F.col("session_id").alias("file_id")).agg(
            F.bool_or(F.col("hook_event_name") == "SessionStart").alias("starts"), F.bool_or(F.col("hook_event_name") == "SessionEnd").alias("ends"), F.bool_or("woke").alias("wakes"),
        ).cache()
        if not todo.limit(1).count():
            return

        def stamp(which: str) -> None:
            lines = transcripts.scan(spark, path).join(todo.filter(which), "file_id", "left_semi").select("file_id", "pos", F.col("raw").alias("line"))
            housekeeping.write_stamps(lines, stamps_path)

        stamp("starts")
        boundary = todo.filter("starts or ends or wakes")
        agents = jsonl.files(spark, path).select(F.col("file_id").alias("agent"), F.explode(F.split("path", "/")).alias("file_id")).filter("file_id <> concat(agent, '.jsonl')")
        agents = agents.join(boundary, "file_id", "left_semi").select(F.col("agent").alias("file_id"))
        verbs.compact_in_place(spark, path, mirror_path, out_path, verbs.frozen_sessions(spark, state_path), todo.select("file_id").unionByName(agents).distinct())
        stamp("ends")
        if swept is not None and boundary.limit(1).count():
            swept(jsonl.files(spark, path))
        todo.unpersist()

    return run


def settled(records: DataFrame) -> DataFrame:
    """Records that a pass may touch: all but each file's last, which waits for the next."""
    last = records.groupBy("file_id").agg(F.max("pos").alias("_last"))
    return records.join(last, "file_id").filter("pos < _last").drop("_last")
