import json

import pandas as pd
from transcript import readable

from foldline.plans import verbs
from foldline.streaming import events


def test_decisions():
    d = events.decide
    assert d("Stop", 10, None, False) == ("compact", False, 10, False)
    assert d("Stop", 100, 10, False)[0] == "skip"
    assert d("Stop", 200, 10, False)[0] == "compact"
    assert d("SessionEnd", 20, 10, False) == ("compact", False, 20, True)
    assert d("Stop", 30, 20, True) == ("compact", True, 30, False)
    assert d("Other", 30, 20, True) == ("ignore", False, 20, True)
    assert d("SubagentStop", 30, 20, False)[0] == "compact-agent"


def test_route_as_a_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [("a", "SessionStart", 0.0), ("a", "Stop", 60.0), ("b", "Stop", 60.0), ("a", "SessionEnd", 300.0), ("a", "Stop", 310.0)]
    for i, part in enumerate((rows[:2], rows[2:])):
        (src / f"{i}.json").write_text("\n".join(json.dumps({"session_id": s, "hook_event_name": e, "at": t}) for s, e, t in part))
    stream = spark.readStream.schema(events.EVENT).option("maxFilesPerTrigger", 1).json(str(src))
    q = events.route(stream).writeStream.outputMode("update").format("memory").queryName("routed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.session_id, r.at): (r.action, r.woke) for r in spark.table("routed").collect()}
    table = spark.createDataFrame(rows, events.EVENT)
    assert {(r.session_id, r.at): (r.action, r.woke) for r in events.route(table).collect()} == got
    assert got == {("a", 0.0): ("compact", False), ("a", 60.0): ("skip", False), ("b", 60.0): ("compact", False), ("a", 300.0): ("compact", False), ("a", 310.0): ("compact", True)}


def test_archive_batches_equal_one_batch(spark, tmp_path):
    b = readable("s")
    path = f"file://{tmp_path}/mirror"
    df = spark.createDataFrame(pd.DataFrame({"file_id": "s", "pos": range(len(b.lines)), "line": b.lines})).selectExpr("file_id", "cast(pos as int) as pos", "line")
    run = events.archive_into(path)
    run(df.filter("pos < 9"), 0)
    run(df.filter("pos < 9"), 0)
    run(df, 1)
    got = [r.line for r in verbs.read_mirror(spark, path).orderBy("seq").collect()]
    assert sorted(got) == sorted(b.lines) and len(got) == len(b.lines)
