import base64
import json

import pytest
from transcript import Builder, readable

from foldline.functions import jsonpatch as jp
from foldline.plans import compaction, verbs
from foldline.plans import wording as wd
from foldline.sources import transcripts


def lines_of(spark, *builders):
    return spark.createDataFrame([(b.session, i, x) for b in builders for i, x in enumerate(b.lines)], "file_id string, pos int, line string")


def compacted(spark, *builders):
    rows = compaction.compact_lines(lines_of(spark, *builders)).collect()
    return {b.session: sorted((r for r in rows if r.file_id == b.session), key=lambda r: r.pos) for b in builders}


def again(spark, rows):
    """The second pass over a first pass's result."""
    kept = [r.line for r in rows if r.line is not None]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(kept)], "file_id string, pos int, line string")
    return kept, [r.line for r in sorted(compaction.compact_lines(df).collect(), key=lambda r: r.pos) if r.line is not None]


def texts(rows):
    return "\n".join(r.line for r in rows if r.line)


def test_reads_are_superseded_and_second_pass_changes_nothing(spark):
    b = readable("s")
    rows = compacted(spark, b)["s"]
    assert all(r.refused is None for r in rows)
    assert [r.rule for r in rows].count("bash-read-dedup") == 2
    assert "superseded by a later read of a.py:1-100" in rows[2].line
    assert rows[0].line == b.lines[0] and rows[-1].line == b.lines[-1]
    kept, second = again(spark, rows)
    assert kept == second


def test_partial_cover_and_failed_superseder(spark):
    b = Builder("s")
    b.user("go")
    for i in range(9):
        b.use(f"t{i}", "Read", file_path="f", offset=1 if i else 5, limit=10)
        b.result(f"t{i}", "y" * 450, error=i == 8)
    b.use("open", "Bash", command="make")  # keeps the turn unsettled
    b.say("end")
    rows = compacted(spark, b)["s"]
    gone = [r.pos for r in rows if r.rule == "read-dedup"]
    assert gone == [4, 6]  # the first asks for lines 5-14, which 1-10 does not cover


def folding(session="s", n=12):
    b = Builder(session)
    b.user("do it")
    for i in range(n):
        b.use(f"t{i}", "Bash", command=f"make {i}")
        b.result(f"t{i}", f"line {i}\n" * 200)
    b.say("a note")
    b.user("next")
    b.say("bye")
    return b


def test_chain_collapse(spark):
    b = folding()
    rows = compacted(spark, b)["s"]
    assert rows[0].refused is None
    kept = [r for r in rows if r.line is not None]
    assert len(kept) == 6
    digest = json.loads(kept[2].line)["message"]["content"][0]["content"]
    assert digest.startswith(wd.CARRIER + "12 separate tool calls") and digest.count("Bash(make ") == 12
    chain = [json.loads(r.line) for r in kept]
    assert [x["parentUuid"] for x in chain[1:]] == [x["uuid"] for x in chain[:-1]]
    first, second = again(spark, rows)
    assert first == second


@pytest.mark.parametrize("how", ["orphan", "unanswered", "two uses", "protected", "cheap"])
def test_a_turn_that_is_not_plain_stays(spark, how):
    b = Builder("s")
    b.user("do it")
    for i in range(6):
        b.call(f"t{i}", "Bash", "z" * (900 if how != "cheap" else 5), command=f"c{i}")
    if how == "orphan":
        b.result("nobody", "x")
    if how == "unanswered":
        b.use("late", "Bash", command="c")
    if how == "two uses":
        b.blocks({"type": "tool_use", "id": "p", "name": "X", "input": {}}, {"type": "tool_use", "id": "q", "name": "X", "input": {}})
    if how == "protected":
        b.add("worktree-state")
    b.user("next")
    b.say("bye")
    assert not any(r.rule == "chain-collapse" for r in compacted(spark, b)["s"])


def test_tail_call_is_left_out_of_the_fold(spark):
    b = Builder("s")
    b.user("go")
    for i in range(6):
        b.call(f"t{i}", "Bash", "w" * 900, command=f"c{i}")
    rows = compacted(spark, b)["s"]
    assert rows[-1].line == b.lines[-1]
    assert json.loads(rows[2].line)["message"]["content"][0]["content"].startswith(wd.CARRIER + "5 ")


def test_segment_headers_and_anchor_input(spark):
    b = Builder("s")
    for t in range(3):
        b.user(f"turn {t}")
        b.use(f"a{t}", "Write", file_path="f", content="q" * 900)
        b.result(f"a{t}", "ok")
        for i in range(4):
            b.call(f"t{t}{i}", "Bash", "w" * 900, command=f"c{i}")
    b.user("x")
    b.say("end")
    rows = compacted(spark, b)["s"]
    carriers = [json.loads(r.line)["message"]["content"][0]["content"] for r in rows if r.line and wd.CARRIER in r.line]
    assert [wd.FULL in c for c in carriers] == [True, False, False]
    inputs = [json.loads(r.line)["message"]["content"][0]["input"] for r in rows if r.rule == "anchor-input-stub"]
    assert len(inputs) == 3 and all(wd.TAG in i and i["preview"] == "f" for i in inputs)
    assert len(set(again(spark, rows)[0])) and again(spark, rows)[0] == again(spark, rows)[1]


def test_ages(spark):
    b = Builder("s")
    b.user("go")
    b.blocks({"type": "text", "text": "see"}, {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": "A" * 4000}}, kind="user")
    b.use("old", "Grep", pattern="needle")
    b.result("old", "hit\n" * 300)
    b.use("open1", "Bash", command="c")  # never answered, so the turn is not folded
    for i in range(20):
        b.user(f"p{i}")
    b.use("mid", "Bash", command="c")
    b.result("mid", "row\n" * 300)
    b.use("open2", "Bash", command="c")
    for i in range(22):
        b.user(f"q{i}")
    b.say("end")
    rows = compacted(spark, b)["s"]
    t = texts(rows)
    assert "[foldline: Grep needle — 301 lines, 1.2KB]" in t and "image/png, 2KB archived" in t
    assert f"lines {wd.TRIMMED}" in t
    kept, second = again(spark, rows)
    assert kept == second


def test_removals_and_protection(spark):
    b = Builder("s")
    for i in range(3):
        b.bare("last-prompt", lastPrompt=f"p{i}")
        b.bare("custom-title", customTitle=f"t{i}")
    for op, c in (("enqueue", "a"), ("enqueue", "b"), ("remove", "b"), ("dequeue", None)):
        b.bare("queue-operation", operation=op, **({"content": c} if c else {}))
    b.add("system", subtype="stop_hook_summary", hookErrors=[], hasOutput=False)
    b.add("system", subtype="stop_hook_summary", hookErrors=["e"], hasOutput=False)
    b.add("attachment", attachment={"type": "hook_success", "hookEvent": "Stop"})
    keep = b.add("attachment", attachment={"type": "task_reminder", "content": []})
    b.add("attachment", attachment={"type": "task_reminder", "content": [1]})
    b.add("attachment", attachment={"type": "edited_text_file", "filename": "f"})
    b.use("w", "Write", file_path="f")
    b.result("w", "ok", toolUseResult={"type": "create", "filePath": "f"})
    b.add("system", subtype="compact_boundary", compactMetadata={"preservedMessages": {"allUuids": [keep]}})
    b.say("end")
    rows = compacted(spark, b)["s"]
    gone = [r.rule for r in rows if r.line is None]
    assert sorted(gone) == sorted(["metadata-keep-last"] * 4 + ["queue-history-collapse"] * 4 + ["stop-hook-summary-strip", "hook-success-strip", "edited-text-file-supersession"])


def test_reminders_and_duplicates(spark):
    r = "<system-reminder>be nice</system-reminder>"
    b = Builder("s")
    b.user(f"a {r}")
    b.user(f"b\n\n{r}\n\nc")
    b.say("long " * 300)
    b.user("x")
    b.say("long " * 300)
    b.say("end")
    rows = compacted(spark, b)["s"]
    assert json.loads(rows[1].line)["message"]["content"] == "b\n\nc"
    assert "duplicate content removed" in rows[4].line and rows[2].line == b.lines[2]


@pytest.mark.parametrize("data", [b"\xef\xbb\xbf{}\n", b'{"a":1}\n\n{"b":1}\n', b'{"a":1\n', b"[1]\n", b'{"uuid":5}\n', b"\xff\n", b"", b'{"type":"system","subtype":"compact_boundary","compactMetadata":{"preservedMessages":{"allUuids":[1]}}}\n'])
def test_malformed_files_are_refused_whole(data):
    assert transcripts.rows("f", data) == []


def test_scan_archive_compact_restore(spark, tmp_path):
    src, mirror, out = tmp_path / "in", f"file://{tmp_path}/mirror", f"file://{tmp_path}/out"
    src.mkdir()
    a, b = folding("aaaa-session"), readable("bbbb-session")
    (src / "aaaa-session.jsonl").write_bytes(a.text.replace("\n", "\r\n").encode())
    (src / "bbbb-session.jsonl").write_text(b.text.rstrip("\n"))
    (src / "torn.jsonl").write_text('{"a":1}\n{"b"')
    path = f"file://{src}"
    result = verbs.compact(spark, path, mirror, out)
    assert {r.file_id for r in result.collect()} == {"aaaa-session", "bbbb-session"}
    assert all(r.line.endswith("\r") for r in result.filter("file_id = 'aaaa-session' and line is not null").collect())
    before = spark.read.parquet(mirror).count()
    assert before == len(a.lines) + len(b.lines)
    result = verbs.compact(spark, path, mirror, out)
    archive = verbs.read_mirror(spark, mirror)
    assert archive.count() == before  # nothing is archived twice
    live = transcripts.scan(spark, path)
    back = verbs.restored(archive, live).orderBy("file_id", "pos").collect()
    assert [r.line for r in back if r.file_id == "aaaa-session"] == a.lines and [r.line for r in back if r.file_id == "bbbb-session"] == b.lines
    lines = live.select("file_id", "pos", live.raw.alias("line"))
    assert compaction.violations(lines, result).count() == 0
    e = {r.file_id: r for r in compaction.economics(result).collect()}
    assert e["aaaa-session"].bytes_after < e["aaaa-session"].bytes_before / 2
    hits = verbs.retrieve(archive, "aaaa", grep="LINE 3", mode="grep").collect()
    assert len(hits) == 200 and {h.line for h in hits} == {"line 3"}
    ref = hits[0].ref
    assert verbs.retrieve(archive, "aaaa", ref=ref, mode="full").count() == 1
    assert verbs.retrieve(archive, "zzzz").count() == 0


def test_media_clone_order_and_price(spark):
    b = Builder("s1")
    b.user("hi")
    u = b.result("x", [{"type": "text", "text": "shot"}, {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": base64.b64encode(b"png").decode()}}])
    lines = lines_of(spark, b)
    recs = transcripts.from_lines(lines)
    mirror = compaction.missing_originals(recs, spark.createDataFrame([], compaction.MIRROR))
    assert [(r.name, bytes(r.bytes)) for r in verbs.media(mirror, "s1", u[:8]).collect()] == [(f"{u[:8]}-media-0.png", b"png")]
    copy = [jp.loads(r.line) for r in verbs.clone(lines, "s1", "s2").orderBy("pos").collect()]
    assert all(r["sessionId"] == "s2" for r in copy)
    shuffled = mirror.withColumn("seq", 1 - mirror.seq)
    back = verbs.restored(shuffled, recs, merged=True).orderBy("pos").collect()
    assert [r.line for r in back] == b.lines
    current = spark.createDataFrame([("s1", b.parent, 10)], "file_id string, uuid string, bytes long")
    stamp = spark.createDataFrame([("s1", b.parent, 1010)], "file_id string, uuid string, bytes long")
    r = verbs.reclaimable(current, mirror, stamp, 200_000).first()
    assert (r.removed_bytes, r.tokens) == (1000, 198019)


def test_uuid_less_copies_are_counted(spark):
    b = Builder("s")
    for _ in range(3):
        b.bare("last-prompt", lastPrompt="p", leafUuid="l")
    b.user("x")
    recs = transcripts.from_lines(lines_of(spark, b))
    none = spark.createDataFrame([], compaction.MIRROR)
    first = compaction.missing_originals(recs, none)
    assert first.count() == 4
    one = first.filter("seq in (0, 3)")
    assert compaction.missing_originals(recs, one).count() == 2


def write_session(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.jsonl").write_text("\n".join(lines) + "\n")


def test_a_fork_adopts_its_parent_and_names_itself(spark, tmp_path):
    mirror = f"file://{tmp_path}/mirror"
    parent = folding("parent-session")
    write_session(tmp_path / "one", "parent-session", parent.lines)
    first = verbs.compact(spark, f"file://{tmp_path}/one", mirror, f"file://{tmp_path}/out1")
    kept = [r.line for r in first.orderBy("pos").collect() if r.line is not None]
    assert any("retrieve('parent-session'" in x for x in kept)
    copied = [jp.dumps(jp.loads(x) | {"sessionId": "forked-session"}) for x in kept]
    own = {"type": "user", "uuid": "new-1", "parentUuid": json.loads(kept[-1])["uuid"], "sessionId": "forked-session", "message": {"role": "user", "content": "go on"}}
    quote = {"type": "assistant", "uuid": "new-2", "parentUuid": "new-1", "sessionId": "forked-session", "foldline": {"v": 1, "rule": "x", "origUuid": "new-2"}, "message": {"role": "assistant", "content": [{"type": "text", "text": "I ran retrieve('parent-session', ref='1')"}]}}
    last = own | {"uuid": "new-3"}
    fork = [*copied, *(json.dumps(x, separators=(",", ":")) for x in (own, quote, last))]
    write_session(tmp_path / "two", "forked-session", fork)
    src = f"file://{tmp_path}/two"
    result = [r for r in verbs.compact(spark, src, mirror, f"file://{tmp_path}/out2").orderBy("pos").collect() if r.line is not None]
    assert all(r.refused is None for r in result)
    assert ["parent-session" in r.line for r in result].count(True) == 1 and "parent-session" in next(r.line for r in result if '"new-2"' in r.line)  # a quotation stays
    assert any("retrieve('forked-session'" in r.line for r in result)
    archive = verbs.read_mirror(spark, mirror)
    have = archive.filter("file_id = 'forked-session'")
    assert {json.loads(x)["uuid"] for x in parent.lines} <= {r.uuid for r in have.collect()}
    ref = next(json.loads(r.line)["uuid"][:8] for r in result if "retrieve('forked-session'" in r.line)
    assert verbs.retrieve(archive, "forked-session", ref=ref).count() == verbs.retrieve(archive, "parent-session", ref=ref).count() > 0
    merged = [r.line for r in verbs.restored(archive, transcripts.scan(spark, src).filter("uuid <> 'new-2'"), merged=True).filter("file_id = 'forked-session'").orderBy("pos").collect()]
    assert merged == [x.replace("parent-session", "forked-session") for x in parent.lines] + [fork[-3], fork[-1]]
    before = archive.count()
    write_session(tmp_path / "two", "forked-session", [r.line for r in result])
    again = [r.line for r in verbs.compact(spark, src, mirror, f"file://{tmp_path}/out3").orderBy("pos").collect() if r.line is not None]
    assert again == [r.line for r in result] and verbs.read_mirror(spark, mirror).count() == before


def test_a_session_whose_archive_is_lost_is_left_alone(spark, tmp_path):
    write_session(tmp_path / "in", "lost-session", folding("lost-session").lines)
    src = f"file://{tmp_path}/in"
    first = verbs.compact(spark, src, f"file://{tmp_path}/mirror1", f"file://{tmp_path}/out1")
    write_session(tmp_path / "in", "lost-session", [r.line for r in first.orderBy("pos").collect() if r.line is not None])
    write_session(tmp_path / "in", "good-session", readable("good-session").lines)
    for _ in range(2):  # the first pass must not hide the loss from the second
        result = verbs.compact(spark, src, f"file://{tmp_path}/mirror2", f"file://{tmp_path}/out2")
        assert {r.file_id for r in result.collect()} == {"good-session"}
        assert {r.file_id for r in verbs.read_mirror(spark, f"file://{tmp_path}/mirror2").collect()} == {"good-session"}
