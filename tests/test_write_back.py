"""Transcripts replaced in place: atomic swap, frozen sessions, stamps, passes of a stream."""

import base64
import os

import pyarrow as pa
import pytest
from transcript import Builder, readable

from foldline.plans import housekeeping, metrics, payload, verbs
from foldline.sources import grouped, jsonl, scratch, transcripts
from foldline.streaming import events


def test_replace_checks_the_length_and_keeps_the_last_byte(tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_bytes(b"one\ntwo\n")
    assert jsonl.replace(f"file:{f}", ["1"], 8) == ("written", 2) and f.read_bytes() == b"1\n"
    f.write_bytes(b"one\ntwo")
    assert jsonl.replace(f"file:{f}", ["1", "2"], 7) == ("written", 3) and f.read_bytes() == b"1\n2"
    assert jsonl.replace(f"file:{f}", ["x"], 7) == ("changed", 3) and f.read_bytes() == b"1\n2"
    assert jsonl.replace(f"file:{tmp_path}/none.jsonl", ["x"], 0)[0] == "changed"
    assert [p.name for p in tmp_path.iterdir()] == ["a.jsonl"]


def test_append_makes_and_extends_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "two"), ("a", 0, "one"), ("b", 0, "é")], "file_id string, pos int, line string")
    assert {r.state for r in jsonl.append(rows, f"file://{tmp_path}/x").collect()} == {"written"}
    assert {r.state for r in jsonl.append(rows, f"file://{tmp_path}/x").collect()} == {"present"}
    jsonl.append(rows.filter("pos = 1"), f"file://{tmp_path}/x").collect()
    assert (tmp_path / "x/a.jsonl").read_text() in ("one\ntwo\n", "one\ntwo\ntwo\n") and (tmp_path / "x/b.jsonl").read_text() == "é\n"


@pytest.fixture
def places(tmp_path):
    src = tmp_path / "in"
    (src / "aaaa-session" / "subagents").mkdir(parents=True)
    a, agent = readable("aaaa-session"), Builder("agent-1", sidechain=True)
    agent.say("a note")
    agent.bare("last-prompt", lastPrompt="p")
    agent.bare("last-prompt", lastPrompt="q")
    agent.say("the report")
    (src / "aaaa-session.jsonl").write_text(a.text)
    (src / "aaaa-session" / "subagents" / "agent-1.jsonl").write_text(agent.text)
    return src, a, agent, [f"file://{tmp_path}/{n}" for n in ("in", "mirror", "out")]


def test_restore_puts_originals_back_and_freezes(spark, tmp_path, places):
    src, a, _, where = places
    state = f"file://{tmp_path}/state"
    only = spark.createDataFrame([("aaaa-session",)], "file_id string")
    assert [r.state for r in verbs.compact_in_place(spark, *where, only=only).collect()] == ["written"]
    small = (src / "aaaa-session.jsonl").stat().st_size
    assert small < len(a.text.encode())
    assert [r.state for r in verbs.restore_on(spark, where[0], where[1], state, ["aaaa-session"]).collect()] == ["written"]
    assert (src / "aaaa-session.jsonl").read_text() == a.text
    assert [r.file_id for r in verbs.frozen_sessions(spark, state).collect()] == ["aaaa-session"]
    assert verbs.compact_in_place(spark, *where, frozen=verbs.frozen_sessions(spark, state), only=only).count() == 0
    verbs.restore_off(spark, state, ["aaaa-session"])
    assert verbs.frozen_sessions(spark, state).count() == 0
    verbs.compact_in_place(spark, *where, only=only)
    assert (src / "aaaa-session.jsonl").stat().st_size == small


def test_a_verb_reads_each_transcript_once(spark, tmp_path, places, monkeypatch):
    src, a, agent, where = places
    log, was = tmp_path / "log", transcripts._decode

    def logged(batches):
        def seen():
            for b in batches:
                with log.open("a") as f:
                    f.write("".join(f"{p}\n" for p in b.column("path").to_pylist()))
                yield b

        return was(seen())

    monkeypatch.setattr(transcripts, "_decode", logged)
    once = sorted(f"file:{src}/{n}" for n in ("aaaa-session.jsonl", "aaaa-session/subagents/agent-1.jsonl"))
    read = lambda: sorted(log.read_text().splitlines())
    assert {r.state for r in verbs.compact_in_place(spark, *where).collect()} == {"written"}
    assert read() == once
    names = spark.createDataFrame([("aaaa-session",), ("agent-1",)], "file_id string")
    assert {r.state for r in verbs.restore_on(spark, where[0], where[1], f"file://{tmp_path}/state", names).collect()} == {"written"}
    assert read() == sorted(once * 2)
    assert (src / "aaaa-session.jsonl").read_text() == a.text and (src / "aaaa-session/subagents/agent-1.jsonl").read_text() == agent.text
    verbs.compact_in_place(spark, *where, frozen=verbs.frozen_sessions(spark, f"file://{tmp_path}/state"))
    assert read() == sorted(once * 3)


def test_many_small_files_are_few_tasks(spark, tmp_path):
    for i in range(400):
        (tmp_path / f"{i}.jsonl").write_text('{"type":"x"}\n')
    before = [spark.conf.get(k, None) for k in scratch.SMALL]
    with scratch.small_files(spark):
        assert transcripts.scan(spark, f"file://{tmp_path}").rdd.getNumPartitions() <= 5
    assert [spark.conf.get(k, None) for k in scratch.SMALL] == before
    with scratch.Scratch(spark).table(transcripts.scan(spark, f"file://{tmp_path}")) as t:
        path = t.inputFiles()[0].removeprefix("file:").rpartition("/")[0]
        assert t.count() == 400 and os.path.isdir(path)
    assert not os.path.exists(path)


def test_files_share_batches_and_span_them(spark):
    rows = [(f"f{i:02d}" if i else None, p, "x" * p) for i in range(40) for p in range(1 + 7 * (i % 3))]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "4")
    try:
        seen = grouped.per_file(spark.createDataFrame(rows, "file_id string, pos int, line string"), lambda t: pa.table({"file_id": t.column("file_id")[:1], "n": [t.num_rows], "last": pa.array([max(t.column("pos").to_pylist())], pa.int32())}), "file_id string, n long, last int")
        assert sorted((r.file_id or "", r.n, r["last"]) for r in seen.collect()) == sorted((f"f{i:02d}" if i else "", 1 + 7 * (i % 3), 7 * (i % 3)) for i in range(40))
    finally:
        spark.conf.set(key, before)
    batches = [pa.RecordBatch.from_pydict({"file_id": x}) for x in (["a", "a", "b"], ["b", "b"], ["c"])]
    assert [t.column("file_id").to_pylist() for t in grouped.tables(iter(batches))] == [["a", "a"], ["b", "b", "b"], ["c"]]
    assert list(grouped.tables(iter([]))) == []


def test_passes_of_a_batch_stamp_compact_and_sweep(spark, tmp_path, places):
    src, a, agent, where = places
    stamps, state, swept = f"file://{tmp_path}/stamps", f"file://{tmp_path}/state", []
    run = events.run_passes(*where, stamps, state, lambda files: swept.append({r.file_id for r in files.collect()}))
    batch = lambda *rows: spark.createDataFrame([(s, e, t, x, w) for s, e, t, x, w in rows], events.ACTION)
    run(batch(("aaaa-session", "Stop", 0.0, "skip", False)), 0)
    assert (src / "aaaa-session.jsonl").read_text() == a.text and not swept
    run(batch(("aaaa-session", "SessionStart", 1.0, "compact", False)), 1)
    assert len((src / "aaaa-session.jsonl").read_text()) < len(a.text) and swept == [{"aaaa-session", "agent-1"}]
    assert len((src / "aaaa-session/subagents/agent-1.jsonl").read_text().splitlines()) == len(agent.lines) - 1
    was = {r.uuid: r.bytes for r in housekeeping.newest_stamps(spark.read.schema(housekeeping.STAMPS).parquet(stamps)).collect()}
    assert sum(was.values()) == sum(len(x.encode()) for x in a.lines)  # as loaded, before the pass
    run(batch(("aaaa-session", "SessionEnd", 2.0, "compact", False)), 2)
    now = {r.uuid: r.bytes for r in housekeeping.newest_stamps(spark.read.schema(housekeeping.STAMPS).parquet(stamps)).collect()}
    assert sum(now.values()) < sum(was.values())


def test_torn_lines_are_kept_without_a_node(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"a":1}\r\n\n  \n{"b"\n[1]\n')
    got = sorted((r.file_id, r.line, r.torn) for r in transcripts.tolerant(spark, f"file://{tmp_path}").selectExpr("file_id", "line", "node is null as torn").collect())
    assert got == [("t", "[1]", True), ("t", '{"a":1}', False), ("t", '{"b"', True)]


def test_tokens_by_a_vocabulary(spark, tmp_path):
    pytest.importorskip("tiktoken")
    ranks = [bytes([i]) for i in range(256)] + [b"ab", b"abc", b" a"]
    (tmp_path / "v").write_bytes(b"".join(base64.b64encode(x) + b" %d\n" % i for i, x in enumerate(ranks)))
    df = spark.createDataFrame([("abc abc ab",), ("",), (None,), ("é",)], "t string")
    assert [r[0] for r in df.select(metrics.bpe_tokens(str(tmp_path / "v"), r" ?\w+")("t")).collect()] == [5, 0, None, 2]  # abc, " ", abc, " ", ab


def test_corpus_lines_and_names(spark):
    lines = spark.createDataFrame([("f", 0, '{"foldline":{"v":"1","mirrorOf":"x"}}'), ("f", 1, '{"foldline":{"v":1},"type":"user"}'), ("f", 2, '{"torn')], "file_id string, pos int, line string")
    assert [r.pos for r in payload.corpus_lines(lines).orderBy("pos").collect()] == [1, 2]
    names = spark.createDataFrame([("0a1b2c3d-0000-1111-2222-333344445555",), ("0A1b2c3d-0000-1111-2222-333344445555",), ("x",)], "n string")
    assert [r[0] for r in names.select(payload.is_session_id(names.n)).collect()] == [True, False, False]
