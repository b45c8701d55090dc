"""One query for each rule of the catalog, on sessions made of the driver's conversations.

A session is a run of equal units, one for each turn (or for each of a fixed number of
turns), and a closing word.  Each query returns the records that the rewrite removed or
edited, and what their edited part says; the SQL states the same from the conversations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldline.functions.shell import ReadTarget
from foldline.plans import compaction
from foldline.plans import wording as wd
from foldline.plans.catalog import query, read
from foldline.sources.transcripts import from_lines

UNITS = "SELECT 's' || lpad(CAST(conv_id AS VARCHAR), 7, '0') AS file_id, conv_id AS conv, turn AS t, count(*) OVER (PARTITION BY conv_id) AS n, text FROM conversations"
GONE, KEPT = "TRUE AS removed, CAST(NULL AS VARCHAR) AS said", "FALSE AS removed"


def units(spark: SparkSession, d: str, n: Column | None = None) -> DataFrame:
    """file_id, conv, t, n and text: a row for each turn of a conversation, or for each of n."""
    c = read(spark, d, "conversations")
    name = F.concat(F.lit("s"), F.lpad(F.col("conv_id").cast("string"), 7, "0")).alias("file_id")
    if n is None:
        return c.select(name, F.col("conv_id").alias("conv"), F.col("turn").alias("t"), F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n"), "text")
    return c.select(name, F.col("conv_id").alias("conv")).distinct().withColumn("n", n.cast("long")).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("text", F.lit(""))


def made(n: str) -> str:
    """The SQL of units() with n."""
    return f"SELECT file_id, conv, t, n FROM (SELECT DISTINCT 's' || lpad(CAST(conv_id AS VARCHAR), 7, '0') AS file_id, conv_id AS conv, {n} AS n FROM (SELECT *, conv_id AS conv FROM conversations)), unnest(range(0, n)) r(t)"


def _uuid(pos: Column) -> Column:
    return F.concat(F.col("file_id"), F.lit("-"), F.lpad(pos.cast("string"), 6, "0"))


def _fields(**fields: Column | str) -> list[Column]:
    return [(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]


def obj(**fields: Column | str) -> Column:
    return F.struct(*_fields(**fields))


def message(role: str, content: Column | str) -> Column:
    return obj(role=role, content=content)


def user(content: Column | str) -> dict:
    return {"type": "user", "message": message("user", content)}


def says(text: Column | str) -> dict:
    return {"type": "assistant", "message": message("assistant", F.array(obj(type="text", text=text)))}


def use(name: str, given: Column) -> dict:
    return {"type": "assistant", "message": message("assistant", F.array(obj(type="tool_use", id=F.concat(F.lit("i"), F.col("t").cast("string")), name=name, input=given)))}


def result(content: Column | str) -> dict:
    return user(F.array(obj(type="tool_result", tool_use_id=F.concat(F.lit("i"), F.col("t").cast("string")), content=content)))


def attachment(**fields: Column | str) -> dict:
    return {"type": "attachment", "attachment": obj(**fields)}


def bare(kind: str, **fields: Column | str) -> dict:
    return {"type": kind, "bare": True, **fields}


def sessions(rows: DataFrame, *slots: dict) -> DataFrame:
    """file_id, pos, line.  Records that are not bare are chained, each to the one before."""
    chained = [j for j, s in enumerate(slots) if "bare" not in s]
    out = []
    for j, slot in enumerate(slots):
        pos = F.col("t") * len(slots) + j
        head = {"type": slot["type"], "sessionId": F.col("file_id")}
        if "bare" not in slot:
            earlier = [i for i in chained if i < j]
            up = pos - j + earlier[-1] if earlier else F.when(F.col("t") > 0, pos - j - len(slots) + chained[-1])
            head |= {"uuid": _uuid(pos), "parentUuid": _uuid(up)}
        out.append(rows.select("file_id", pos.cast("int").alias("pos"), F.to_json(F.struct(*_fields(**head, **{k: v for k, v in slot.items() if k not in ("type", "bare")}))).alias("line")))
    end = F.col("n") * len(slots)
    last = end - len(slots) + chained[-1] if chained else F.lit(None).cast("long")
    closing = F.struct(*_fields(type="assistant", sessionId=F.col("file_id"), uuid=_uuid(end), parentUuid=_uuid(last), message=message("assistant", F.array(obj(type="text", text="done")))))
    out.append(rows.filter("t = n - 1").select("file_id", end.cast("int").alias("pos"), F.to_json(closing).alias("line")))
    lines = out[0]
    for x in out[1:]:
        lines = lines.unionByName(x)
    return lines


def changed(rewritten: DataFrame, path: str = "$") -> DataFrame:
    """file_id, pos, rule, removed and what the line says at a path, of removed and edited records."""
    return rewritten.filter("rule is not null").select("file_id", "pos", "rule", F.col("line").isNull().alias("removed"), F.get_json_object("line", path).alias("said"))


def _changed(lines: DataFrame, path: str = "$") -> DataFrame:
    return changed(compaction.compact_lines(lines), path)


RESULT, TEXT = "$.message.content[0].content", "$.message.content[0].text"


@query(f"SELECT file_id, CAST(t * 2 + 1 AS INT) AS pos, 'metadata-keep-last' AS rule, {GONE} FROM ({UNITS}) WHERE t < n - 1")
def rule_metadata_keep_last(spark, d):
    return _changed(sessions(units(spark, d), user(F.col("text")), bare("last-prompt", lastPrompt=F.col("text"))))


def _stops(spark, d) -> DataFrame:
    errors = F.when(F.col("t") % 2 == 1, F.array(F.lit("e"))).otherwise(F.array().cast("array<string>"))
    return sessions(units(spark, d), user(F.col("text")), {"type": "system", "subtype": "stop_hook_summary", "hookErrors": errors, "hasOutput": F.lit(False)})


@query(f"SELECT file_id, CAST(t * 2 + 1 AS INT) AS pos, 'stop-hook-summary-strip' AS rule, {GONE} FROM ({UNITS}) WHERE t % 2 = 0")
def rule_stop_hook(spark, d):
    return _changed(_stops(spark, d))


@query(f"""WITH p AS (SELECT file_id, t * 2 AS pos, CASE WHEN t > 0 THEN CASE WHEN t % 2 = 1 THEN t * 2 - 2 ELSE t * 2 - 1 END END AS up FROM ({UNITS}) UNION ALL SELECT file_id, t * 2 + 1, t * 2 FROM ({UNITS}) WHERE t % 2 = 1
UNION ALL SELECT file_id, n * 2, CASE WHEN t % 2 = 0 THEN t * 2 ELSE t * 2 + 1 END FROM ({UNITS}) WHERE t = n - 1)
SELECT file_id, CAST(pos AS INT) AS pos, file_id || '-' || lpad(CAST(up AS VARCHAR), 6, '0') AS parent FROM p""")
def rechained(spark, d):
    """The parents of what is left once records in between have gone."""
    return compaction.compact_lines(_stops(spark, d)).filter("line is not null").select("file_id", "pos", F.get_json_object("line", "$.parentUuid").alias("parent"))


@query(f"SELECT file_id, CAST(t AS INT) AS pos, 'edited-text-file-supersession' AS rule, {GONE} FROM ({UNITS}) WHERE t + 2 < n")
def rule_edited_file(spark, d):
    return _changed(sessions(units(spark, d), attachment(type="edited_text_file", filename=F.concat(F.lit("f"), (F.col("t") % 2).cast("string")), snippet=F.col("text"))))


@query(f"SELECT file_id, CAST(t AS INT) AS pos, 'task-reminder-keep-last' AS rule, {GONE} FROM ({UNITS}) WHERE t < n - 1")
def rule_task_reminder(spark, d):
    return _changed(sessions(units(spark, d), attachment(type="task_reminder", content=F.col("text"))))


@query(f"SELECT file_id, CAST(t AS INT) AS pos, 'hook-success-strip' AS rule, {GONE} FROM ({UNITS}) WHERE t % 3 < 2")
def rule_hook_success(spark, d):
    return _changed(sessions(units(spark, d), attachment(type="hook_success", hookEvent=F.when(F.col("t") % 3 == 0, "Stop").when(F.col("t") % 3 == 1, "PostToolUse").otherwise("PreToolUse"), stdout=F.col("text"))))


@query(f"SELECT file_id, CAST(t * 2 + j AS INT) AS pos, 'queue-history-collapse' AS rule, {GONE} FROM ({UNITS}), unnest([0, 1]) r(j) WHERE conv % 2 = 0")
def rule_queue_history(spark, d):
    """Queues of odd conversations keep a prompt at the end, so their history stays."""
    left = (F.col("conv") % 2 == 1) & (F.col("t") == F.col("n") - 1)
    name = F.concat(F.lit("q"), F.col("t").cast("string"))
    second = bare("queue-operation", operation=F.when(left, "enqueue").otherwise("dequeue"), content=F.when(left, name))
    return _changed(sessions(units(spark, d), bare("queue-operation", operation="enqueue", content=name), second))


@query(f"SELECT file_id, CAST(t AS INT) AS pos, 'system-reminder-dedup' AS rule, {KEPT}, 'q' || t || ' end' AS said FROM ({UNITS}) WHERE t > 1")
def rule_system_reminder(spark, d):
    content = F.concat(F.lit("q"), F.col("t").cast("string"), F.lit("<system-reminder>r"), (F.col("t") % 2).cast("string"), F.lit("\n</system-reminder> end"))
    return _changed(sessions(units(spark, d), user(content)), "$.message.content")


@query(f"SELECT file_id, CAST(t AS INT) AS pos, 'document-dedup' AS rule, {KEPT}, '{wd.STUB}: duplicate content removed — first seen earlier: ' || left(repeat('abc ', 300), 80) || '...]' AS said FROM ({UNITS}) WHERE t > 1")
def rule_document_dedup(spark, d):
    return _changed(sessions(units(spark, d), says(F.concat(F.repeat(F.lit("abc "), 300), (F.col("t") % 2).cast("string")))), TEXT)


@query(f"SELECT file_id, CAST(t * 2 + 1 AS INT) AS pos, 'bash-read-dedup' AS rule, {KEPT}, '{wd.STUB}: file read superseded by a later read of {ReadTarget('a.py', 1, 100)}]' AS said FROM ({made('9 + conv % 4')}) WHERE t < n - 6")
def rule_bash_read(spark, d):
    rows = units(spark, d, 9 + F.col("conv") % 4)
    return _changed(sessions(rows, use("Bash", obj(command="sed -n '1,100p' a.py")), result(F.concat(F.col("t").cast("string"), F.repeat(F.lit("x"), 500)))), RESULT)


@query(f"""SELECT file_id, CAST(t * 2 + 1 AS INT) AS pos, 'read-dedup' AS rule, {KEPT}, replace('{wd.STUB}: file read superseded by a later read of {ReadTarget('NAME.py', 11, 30)}]', 'NAME', 'f' || t % 2) AS said
FROM ({made('9 + conv % 4')}) WHERE t < n - 6 AND NOT (t % 3 = 0)""")
def rule_read(spark, d):
    """Every third read is of other lines each time, which no later read shows."""
    rows = units(spark, d, 9 + F.col("conv") % 4)
    start = F.when(F.col("t") % 3 == 0, (1000 * (F.col("t") + 1)).cast("int")).otherwise(11)
    given = obj(file_path=F.concat(F.lit("f"), (F.col("t") % 2).cast("string"), F.lit(".py")), offset=start, limit=F.lit(20))
    return _changed(sessions(rows, use("Read", given), result(F.concat(F.col("t").cast("string"), F.repeat(F.lit("x"), 500)))), RESULT)


def _turns(spark, d, command: Column) -> DataFrame:
    """Turns of one call each; every third one says too little to be folded."""
    output = F.when(F.col("t") % 3 == 2, "ok").otherwise(F.concat(F.lit("t"), F.col("t").cast("string"), F.repeat(F.lit("y"), 3000)))
    return sessions(units(spark, d, 3 + F.col("conv") % 3), user("go"), use("Bash", obj(command=command)), result(output))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query(f"""SELECT file_id, CAST(t * 3 + 2 AS INT) AS pos, 'chain-collapse' AS rule, {KEPT},
 CASE WHEN t = 0 THEN replace({_quoted(wd.header(1, 'SESSION'))}, 'SESSION', file_id) ELSE {_quoted(wd.short_header(1))} END || '[' || file_id || '] Bash(make ' || t || ') -> ' || (3001 + length(CAST(t AS VARCHAR))) || 'b :: ' || left('t' || t || repeat('y', 3000), 200) AS said
FROM ({made('3 + conv % 3')}) WHERE t % 3 < 2""")
def rule_chain_collapse(spark, d):
    """Digests, the full header once for each session, and turns whose digest does not pay."""
    return _changed(_turns(spark, d, F.concat(F.lit("make "), F.col("t").cast("string"))), RESULT)


@query(f"""SELECT file_id, CAST(t * 3 + 1 AS INT) AS pos, 'anchor-input-stub' AS rule, {KEPT}, left('echo ' || t || repeat('z', 400), 90) AS said FROM ({made('3 + conv % 3')}) WHERE t % 3 < 2""")
def rule_anchor_input(spark, d):
    command = F.concat(F.lit("echo "), F.col("t").cast("string"), F.repeat(F.lit("z"), 400))
    return _changed(_turns(spark, d, command), "$.message.content[0].input.preview").filter("rule = 'anchor-input-stub'")


@query(f"""SELECT file_id, CAST(t * 2 + 1 AS INT) AS pos, 'tool-result-age' AS rule, {KEPT},
 CASE WHEN n - 1 - t >= 100 THEN '{wd.STUB}: Bash make ' || t || ' — 1 lines, ' || CASE WHEN t % 2 = 1 THEN '0.1' ELSE '0.3' END || 'KB]' ELSE '{{"a":' || t || '}}' END AS said
FROM ({made('101 + conv % 5')}) WHERE n - 1 - t >= 100 OR n - 1 - t >= 30 AND t % 2 = 1""")
def rule_result_age(spark, d):
    """Old results become one line; of those of middle age, JSON loses its white space."""
    text = F.when(F.col("t") % 2 == 1, F.concat(F.lit("{"), F.repeat(F.lit(" "), 100), F.lit('"a": '), F.col("t").cast("string"), F.lit("}"))).otherwise(F.repeat(F.lit("k"), 300))
    return _changed(sessions(units(spark, d, 101 + F.col("conv") % 5), use("Bash", obj(command=F.concat(F.lit("make "), F.col("t").cast("string")))), result(text)), RESULT)


@query(f"""SELECT file_id, CAST(0 AS INT) AS pos, 'mega-block-trim' AS rule, {KEPT}, repeat('m', 16284) || chr(10) || '... [' || (40000 - 32768) || ' bytes {wd.TRIMMED} ...' || chr(10) || repeat('m', 16283) || 'e' AS said FROM ({made('32')}) WHERE t = 0""")
def rule_mega_block(spark, d):
    text = F.when(F.col("t") == 0, F.concat(F.repeat(F.lit("m"), 39_999), F.lit("e"))).otherwise("small")
    return _changed(sessions(units(spark, d, F.lit(32)), says(text), use("Bash", obj(command="ls")), result("ok")), TEXT)


@query(f"""SELECT file_id, CAST(t * 2 AS INT) AS pos, 'image-strip' AS rule, {KEPT}, '{wd.STUB}: image/png, 1KB archived — media(''' || file_id || ''', ref=''' || file_id || ''') decodes it]' AS said FROM ({made('8')}) WHERE t <= n - 3""")
def rule_image_strip(spark, d):
    image = F.array(obj(type="image", source=obj(type="base64", media_type="image/png", data=F.repeat(F.lit("QUJD"), 500))))
    return _changed(sessions(units(spark, d, F.lit(8)), user(image), user("next")), TEXT)


@query(f"SELECT file_id, CAST(t AS INT) AS pos, 'chain-collapse' AS rule, {KEPT}, 'see retrieve(''' || file_id || ''', ref=''1'')' AS said FROM ({UNITS}) WHERE t % 2 = 0")
def rule_fork_heal(spark, d):
    """Records copied from a parent whose archive holds them (the even ones) name this session."""
    parent = F.concat(F.lit("p"), F.substring(F.col("file_id"), 2, 7))
    slot = says(F.concat(F.lit("see retrieve('"), parent, F.lit("', ref='1')"))) | {wd.TAG: obj(v=F.lit(1), rule="chain-collapse", origUuid=_uuid(F.col("t")))}
    rows = units(spark, d)
    copies = rows.filter("t % 2 = 0").select("file_id", _uuid(F.col("t")).alias("uuid"), parent.alias("parent"))
    return changed(compaction.rewrite(from_lines(sessions(rows, slot)), copies), TEXT)


@query(f"SELECT DISTINCT file_id, CASE WHEN conv % 2 = 1 THEN 'dangling-source' END AS refused FROM ({UNITS})")
def refused_sessions(spark, d):
    """A rewrite that would leave a record without the one it came from is refused whole."""
    stop = {"type": "system", "subtype": "stop_hook_summary", "hasOutput": F.lit(False)}
    source = user("answer") | {"sourceToolAssistantUUID": F.when(F.col("conv") % 2 == 1, _uuid(F.col("t") * 3 + 1))}
    return compaction.compact_lines(sessions(units(spark, d), user("go"), stop, source)).select("file_id", "refused").distinct()


def _written(spark, d, rows: DataFrame, *slots: dict):
    """Sessions as files in the shared folder; where they, their archive and the result are."""
    import uuid

    from foldline.sources import jsonl
    from foldline.sources.scratch import Scratch

    cut = Scratch(spark).cut
    top = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    cut(jsonl.append(sessions(rows, *slots), f"{top}/in"))
    return cut, top


@query(f"""SELECT file_id, CASE WHEN n > 1 THEN 'written' END AS state, CAST(2 * n + 1 AS BIGINT) AS before, CAST(n + 2 AS BIGINT) AS rewritten, CAST(2 * n + 1 AS BIGINT) AS restored FROM ({UNITS}) WHERE t = 0""")
def write_back(spark, d):
    """Lines of each file at first, after a pass that replaces files, and after the originals
    are put back (which freezes the session: the pass after that changes nothing)."""
    from foldline.plans import verbs
    from foldline.sources.scratch import small_files

    cut, top = _written(spark, d, units(spark, d), user(F.col("text")), bare("last-prompt", lastPrompt=F.col("text")))
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl$", 1).alias("file_id")

    def count(c: str) -> DataFrame:
        with small_files(spark):
            return cut(spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.jsonl").text(f"{top}/in").groupBy(name).agg(F.count(F.lit(1)).alias(c)))

    places = [f"{top}/in", f"{top}/mirror", f"{top}/out"]
    before = count("before")
    state = verbs.compact_in_place(spark, *places).select("file_id", "state")
    rewritten = count("rewritten")
    verbs.restore_on(spark, places[0], places[1], f"{top}/state", before)
    verbs.compact_in_place(spark, *places, frozen=verbs.frozen_sessions(spark, f"{top}/state"))
    return before.join(state, "file_id", "left").join(rewritten, "file_id").join(count("restored"), "file_id").select("file_id", "state", "before", "rewritten", "restored")


@query(f"""WITH b AS (SELECT 'user' AS role, 'text' AS kind, 'go' AS said, t FROM ({made('3 + conv % 3')}) UNION ALL SELECT 'assistant', 'tool_use', '{{"command":"make ' || t || '"}}', t FROM ({made('3 + conv % 3')})
UNION ALL SELECT 'user', 'tool_result', CASE WHEN t % 3 = 2 THEN 'ok' ELSE 't' || t || repeat('y', 3000) END, t FROM ({made('3 + conv % 3')}) UNION ALL SELECT 'assistant', 'text', 'done', t FROM ({made('3 + conv % 3')}) WHERE t = n - 1)
SELECT role, kind, count(*) AS blocks, CAST(sum(length(said)) AS BIGINT) AS bytes, CAST(sum(ceil(length(said) / 4)) AS BIGINT) AS tokens FROM b GROUP BY role, kind""")
def block_census(spark, d):
    from foldline.plans import payload

    return payload.census(_turns(spark, d, F.concat(F.lit("make "), F.col("t").cast("string"))))


@query(f"""SELECT file_id, string_agg(said, chr(10) ORDER BY pos) AS payload FROM (SELECT file_id, t AS pos, text AS said FROM ({UNITS}) WHERE t <> n // 2 AND (t > n // 2 OR t = 0) UNION ALL SELECT file_id, n, 'done' FROM ({UNITS}) WHERE t = n - 1) GROUP BY file_id""")
def model_payload(spark, d):
    """What a session that was cut in its middle, but for its first record, shows."""
    from foldline.plans import payload

    middle = F.col("t") == F.floor(F.col("n") / 2)
    slot = {"type": F.when(middle, "system").otherwise("user"), "subtype": F.when(middle, "compact_boundary"), "compactMetadata": F.when(middle, obj(preservedMessages=obj(allUuids=F.array(_uuid(F.lit(0)))))), "message": F.when(~middle, message("user", F.col("text")))}
    return payload.payload(sessions(units(spark, d), slot))


@query(f"""SELECT file_id, CASE WHEN conv % 2 = 1 THEN 'agent' ELSE 'main' END AS kind, CASE WHEN conv % 3 = 0 THEN CASE WHEN conv % 5 = 0 THEN 'both' ELSE 'own' END WHEN conv % 5 = 0 THEN 'other' ELSE 'raw' END AS tool, conv % 7 = 0 AS app_compacted FROM ({made('2')}) WHERE t = 0""")
def file_kinds(spark, d):
    from foldline.plans import payload

    conv = F.col("conv")
    slot = {"type": "user", "subtype": F.when(conv % 7 == 0, "compact_boundary"), "isSidechain": F.when(conv % 2 == 1, F.lit(True)), wd.TAG: F.when(conv % 3 == 0, obj(v="1", rule="x")), "message": message("user", F.when(conv % 5 == 0, "trimmed by other").otherwise("plain"))}
    lines = sessions(units(spark, d, F.lit(2)), slot).filter("pos < 2")
    return payload.file_kinds(lines, ("trimmed by other",))


@query(f"""SELECT file_id, 'foldline · ~' || (80 + conv % 10) || 'k tokens reclaimable · ' || CASE WHEN conv % 2 = 0 THEN 50 ELSE 75 END || '% of context · /exit + resume' AS text FROM ({made('1')})""")
def status_line(spark, d):
    from foldline.plans import payload

    rows = units(spark, d, F.lit(1)).select("file_id", ((80 + F.col("conv") % 10) * 1000 + 100).cast("long").alias("tokens"), F.lit(1000).cast("long").alias("loaded_bytes"), F.when(F.col("conv") % 2 == 0, 500).otherwise(750).cast("long").alias("removed_bytes"))
    quiet = rows.select(F.concat(F.lit("q"), "file_id").alias("file_id"), F.lit(None).cast("long").alias("tokens"), "loaded_bytes", "removed_bytes")
    return payload.status_text(rows.unionByName(quiet))


@query("""WITH f AS (SELECT doc_id, n_chars, CASE WHEN lang = 'en' THEN 'main' ELSE 'agent' END AS kind, doc_id % 2 = 0 AS m, doc_id % 5 = 0 AS o, doc_id % 3 = 0 AS c, doc_id % 7 = 0 AS b FROM documents),
g AS (SELECT kind, n_chars, CASE WHEN NOT m AND NOT o THEN 'self' WHEN m AND NOT o AND c THEN 'archive' WHEN o AND b THEN 'backup' END AS choice, o FROM f),
h AS (SELECT kind, n_chars, choice, CASE WHEN choice IS NULL THEN CASE WHEN o THEN 'no clean backup' ELSE 'archive does not cover it' END WHEN n_chars < 1024 THEN 'too small' END AS reason FROM g),
v AS (SELECT 'kind' AS by_, kind AS value, n_chars FROM h UNION ALL SELECT 'baseline', choice, n_chars FROM h WHERE reason IS NULL UNION ALL SELECT 'reason', reason, n_chars FROM h WHERE reason IS NOT NULL)
SELECT by_ AS "by", value, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS bytes, CAST(sum(n_chars // 4) AS BIGINT) AS tokens FROM v GROUP BY by_, value""")
def decision_summary(spark, d):
    from foldline.plans import metrics, payload

    flags = {n: F.col("doc_id") % k == 0 for n, k in (("marked", 2), ("other_tool", 5), ("covered", 3), ("backup", 7))}
    rows = read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("bytes"), F.expr("n_chars div 4").alias("tokens"), F.when(F.col("lang") == "en", "main").otherwise("agent").alias("kind")).withColumns(flags)
    return payload.decisions(metrics.baseline(rows))
