"""What a user asks of transcripts and their archive: compact, retrieve, media, restore,
clone, reclaimable."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldline.functions import jsonpatch as jp
from foldline.plans import compaction, housekeeping, session
from foldline.plans import wording as wd
from foldline.sources import jsonl, transcripts
from foldline.sources.scratch import Scratch, small_files
from foldline.sources.transcripts import blocks

EXTENSIONS = {"image/png": ".png", "image/jpeg": ".jpg", "image/webp": ".webp", "image/gif": ".gif", "application/pdf": ".pdf"}


def compact(spark: SparkSession, path: str, mirror_path: str, out_path: str, frozen: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """Archive, then rewrite all transcripts under a folder.  The archive's append is done
    before anything is rewritten; frozen sessions (file_id) are only archived.  Sessions with
    rewritten records whose archive is lost are left alone: a fresh archive would hide the
    loss.  A fork's archive adopts its parents' records before its records name it (if it had
    an archive, restore it with merged=True).  only: the sessions (file_id) to look at, all if
    there is none.  The result (file_id, pos, line, rule, refused, bytes) is written to out_path."""
    records = transcripts.scan(spark, path)
    if only is not None:
        records = records.join(only.select("file_id").distinct(), "file_id", "left_semi")
    with Scratch(spark).table(records) as once:
        return _compact(spark, once, mirror_path, out_path, frozen)


def _compact(spark: SparkSession, records: DataFrame, mirror_path: str, out_path: str, frozen: DataFrame | None) -> DataFrame:
    cut = Scratch(spark).cut
    mirror = read_mirror(spark, mirror_path)
    marked = cut(housekeeping.marks(records))
    records = records.join(cut(housekeeping.left_alone(marked, mirror)), "file_id", "left_anti")
    live = records if frozen is None else records.join(frozen.select("file_id").distinct(), "file_id", "left_anti")
    copies = cut(housekeeping.fork_copies(marked, mirror).join(live.select("file_id").distinct(), "file_id", "left_semi"))
    # Before the fork's own lines, of which the parent's pass may have changed parentUuid.
    housekeeping.adopt_parents(mirror, copies).write.mode("append").parquet(mirror_path)
    compaction.missing_originals(records, read_mirror(spark, mirror_path)).write.mode("append").parquet(mirror_path)
    compaction.rewrite(live, copies).write.mode("overwrite").parquet(out_path)
    return spark.read.parquet(out_path)


def compact_in_place(spark: SparkSession, path: str, mirror_path: str, out_path: str, frozen: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """compact(), and every transcript that it changed is replaced, unless it has grown since
    it was listed (its next pass will see what was added).  file_id, path, state, bytes."""
    cut = Scratch(spark).cut
    with small_files(spark):
        where = cut(jsonl.files(spark, path))  # before anything is read
    result = compact(spark, path, mirror_path, out_path, frozen, only)
    changed = result.groupBy("file_id").agg(F.bool_or(F.col("rule").isNotNull()).alias("c")).filter("c").select("file_id")
    return cut(jsonl.swap(result, where.join(changed, "file_id", "left_semi")))


FROZEN = "file_id string, frozen boolean, at timestamp"


def _named(spark: SparkSession, names: list[str] | DataFrame) -> DataFrame:
    return names.select("file_id") if isinstance(names, DataFrame) else spark.createDataFrame([(n,) for n in names], "file_id string")


def freeze(spark: SparkSession, state_path: str, names: list[str] | DataFrame, frozen: bool = True) -> None:
    """Marks sessions (names, or a table's file_id) as frozen (archived, never rewritten), or
    as free again."""
    rows = _named(spark, names).withColumn("frozen", F.lit(frozen))
    rows.withColumn("at", F.current_timestamp()).write.mode("append").parquet(state_path)


def frozen_sessions(spark: SparkSession, state_path: str) -> DataFrame:
    """file_id of the sessions whose last mark is a frozen one."""
    return _read(spark, state_path, FROZEN).groupBy("file_id").agg(F.max_by("frozen", "at").alias("f")).filter("f").select("file_id")


def restore_on(spark: SparkSession, path: str, mirror_path: str, state_path: str, names: list[str] | DataFrame, merged: bool = False) -> DataFrame:
    """Puts the originals of sessions back in their files and freezes those sessions.  Sessions
    whose archive lacks a live record, and files that grow meanwhile, stay as they are and
    are not frozen.  names: a list, or a table's file_id.  file_id, path, state, bytes."""
    scratch = Scratch(spark)
    wanted = scratch.cut(_named(spark, names))
    with small_files(spark):
        where = scratch.cut(jsonl.files(spark, path).join(wanted, "file_id", "left_semi"))
    with scratch.table(transcripts.scan(spark, path).join(wanted, "file_id", "left_semi")) as live:
        mirror = read_mirror(spark, mirror_path).join(wanted, "file_id", "left_semi")
        # What came since the last pass is archived first.
        compaction.missing_originals(live, mirror).write.mode("append").parquet(mirror_path)
        mirror = read_mirror(spark, mirror_path).join(wanted, "file_id", "left_semi")
        report = scratch.cut(jsonl.swap(restored(mirror, live, merged), where))
    done = report.filter("state = 'written'")
    if not done.isEmpty():
        freeze(spark, state_path, done)
    return report


def restore_off(spark: SparkSession, state_path: str, names: list[str] | DataFrame) -> None:
    """Lets later passes rewrite the sessions again."""
    freeze(spark, state_path, names, False)


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def read_mirror(spark: SparkSession, path: str) -> DataFrame:
    """The archive, empty if there is none yet."""
    return _read(spark, path, compaction.MIRROR)


def resolve(sessions: DataFrame, name: str) -> DataFrame:
    """The session of that id, else the one whose id begins so, if just one does."""
    begun = sessions.select("file_id").filter(F.lower("file_id").startswith(name.lower()))
    found = begun.agg(F.count_distinct(F.lower("file_id")).alias("n"), F.min("file_id").alias("one"), F.max(F.when(F.col("file_id") == name, name)).alias("exact"))
    return found.select(F.coalesce("exact", F.when(F.col("n") == 1, F.col("one"))).alias("file_id")).filter("file_id is not null")


def _texts(with_inputs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for file_id, seq, uuid, line in zip(*(b.column(c).to_pylist() for c in ("file_id", "seq", "uuid", "line")), strict=True):
                try:
                    root = jp.loads(line)
                except ValueError:
                    continue
                content = jp.get(root, "message", "content")
                found = [content] if isinstance(content, str) else [t for k in blocks(root) if (t := session.block_text(k))] if isinstance(root, dict) else []
                if with_inputs and isinstance(root, dict):
                    found += [jp.dumps(u["input"]) for u in blocks(root, "tool_use") if u.get("input") is not None]
                out += [{"file_id": file_id, "seq": seq, "ref": (uuid or "")[:8], "n": n, "text": t} for n, t in enumerate(found)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("file_id", pa.string()), ("seq", pa.int64()), ("ref", pa.string()), ("n", pa.int32()), ("text", pa.string())]))

    return run


def contents(rows: DataFrame, with_inputs: bool = False) -> DataFrame:
    """file_id, seq, ref, n and text of every text in archive rows; a uuid that is archived
    twice counts once, its first copy."""
    once = rows.withColumn("_n", F.row_number().over(Window.partitionBy("file_id", "identity").orderBy("seq"))).filter("_n = 1 or uuid is null")
    return once.select("file_id", "seq", "uuid", "line").mapInArrow(_texts(with_inputs), "file_id string, seq long, ref string, n int, text string")


def measured(texts: DataFrame) -> DataFrame:
    """How long each text is, in characters, lines and about how many tokens."""
    return texts.select("file_id", "seq", "ref", "n", F.length("text").alias("chars"), F.size(F.split("text", "\n")).alias("lines"), F.expr("length(text) div 4").alias("tokens"))


def retrieve(mirror: DataFrame, name: str, ref: str | None = None, grep: str | None = None, mode: str = "info") -> DataFrame:
    """What the archive holds of a session, narrowed by the beginning of a ref and by a
    substring (any case).  mode: info (ref, chars, lines, about how many tokens), grep
    (matching lines) or full (texts).  A uuid archived twice counts once, its first copy."""
    rows = mirror.join(resolve(mirror, name), "file_id", "left_semi")
    if ref is not None:
        rows = rows.filter(F.lower("uuid").startswith(ref.lower()))
    if grep is not None:
        rows = rows.filter(F.lower("line").contains(grep.lower()) | F.lit(re.search(r"[\"\\\n/]|[^\x20-\x7e]", grep) is not None))
    texts = contents(rows, ref is not None)
    if grep is not None:
        texts = texts.filter(F.contains(F.lower("text"), F.lit(grep.lower())))
    texts = texts if mode == "info" else texts.drop("file_id")
    if mode == "full":
        return texts
    if mode == "grep" or (grep is not None and mode != "info"):
        lines = texts.select("seq", "ref", "n", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        return lines.filter(F.contains(F.lower("line"), F.lit((grep or "").lower())))
    return measured(texts).drop("file_id")


def _media(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for seq, uuid, line in zip(*(b.column(c).to_pylist() for c in ("seq", "uuid", "line")), strict=True):
            root = jp.loads(line)
            for k in blocks(root):
                for p in [k] if jp.text(k, "type") in ("image", "document") else session.media(k):
                    out.append({"seq": seq, "ref": uuid[:8], "media_type": jp.text(p, "source", "media_type"), "data": jp.text(p, "source", "data")})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("seq", pa.int64()), ("ref", pa.string()), ("media_type", pa.string()), ("data", pa.string())]))


def media(mirror: DataFrame, name: str, ref: str) -> DataFrame:
    """name and bytes (null if they are not valid base64) of a ref's images and documents."""
    rows = mirror.join(resolve(mirror, name), "file_id", "left_semi").filter(F.lower("uuid").startswith(ref.lower())).dropDuplicates(["identity"])
    found = rows.select("seq", "uuid", "line").mapInArrow(_media, "seq long, ref string, media_type string, data string")
    numbered = found.withColumn("n", F.row_number().over(Window.partitionBy("ref").orderBy("seq")) - 1)
    ext = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), F.col("media_type")), F.lit(".bin"))
    return numbered.select(F.concat("ref", F.lit("-media-"), F.col("n").cast("string"), ext).alias("name"), F.try_to_binary("data", F.lit("base64")).alias("bytes"))


def restored(mirror: DataFrame, live: DataFrame, merged: bool = False) -> DataFrame:
    """file_id, pos, line of the originals, from the archive.  Files with a live uuid that the
    archive lacks are left out (restoring them would lose it).  merged: a parent's records
    were added, so each record follows its parent (a stable order; cycles keep theirs)."""
    once = mirror.withColumn("_n", F.row_number().over(Window.partitionBy("file_id", "identity").orderBy("seq"))).filter("_n = 1 or uuid is null")
    lost = live.filter("uuid is not null").select("file_id", "uuid").join(mirror.select("file_id", "uuid"), ["file_id", "uuid"], "left_anti").select("file_id").distinct()
    rows = once.join(lost, "file_id", "left_anti").select("file_id", "seq", "uuid", "line")
    if merged:
        return rows.groupBy("file_id").applyInArrow(parents_first, "file_id string, pos int, line string")
    w = Window.partitionBy("file_id").orderBy("seq")
    return rows.select("file_id", (F.row_number().over(w) - 1).alias("pos"), "line")


def parents_first(t: pa.Table) -> pa.Table:
    """Records of one file so that each follows its parent, else in their order."""
    rows = t.sort_by("seq").to_pylist()
    place = {}
    for i, r in enumerate(rows):
        if r["uuid"]:
            place.setdefault(r["uuid"], i)
    parent = [place.get(jp.text(jp.loads(r["line"]), "parentUuid") or "") for r in rows]
    done, order = [False] * len(rows), []
    waiting: dict[int, list[int]] = {}
    for i, p in enumerate(parent):
        if p is not None and not done[p] and p != i:
            waiting.setdefault(p, []).append(i)
            continue
        stack = [i]
        while stack:
            j = stack.pop()
            done[j] = True
            order.append(j)
            stack += reversed(waiting.pop(j, []))
    order += [i for i in range(len(rows)) if not done[i]]
    return pa.table({"file_id": [rows[0]["file_id"]] * len(rows), "pos": pa.array(range(len(rows)), pa.int32()), "line": [rows[i]["line"] for i in order]})


def _rekey(old: str, new: str):
    swap = re.compile(rf"((?:retrieve|media)\('){re.escape(old)}(')", re.I)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for line in b.column("line").to_pylist():
                root = jp.loads(line.removesuffix("\r"))
                if "sessionId" in root:
                    root["sessionId"] = new
                if wd.TAG in root:
                    root = jp.map_strings(root, lambda t: swap.sub(rf"\g<1>{new}\g<2>", t))
                if root.get("type") == "custom-title" and isinstance(root.get("customTitle"), str):
                    root["customTitle"] += " (clone)"
                out.append(jp.dumps(root) + ("\r" if line.endswith("\r") else ""))
            yield pa.RecordBatch.from_arrays([pa.array([new] * len(out), pa.string()), b.column("pos"), pa.array(out, pa.string())], names=["file_id", "pos", "line"])

    return run


def clone(lines: DataFrame, old: str, new: str) -> DataFrame:
    """A session's lines (file_id, pos, line) under a new id."""
    return lines.filter(F.col("file_id") == old).select("pos", "line").mapInArrow(_rekey(old, new), "file_id string, pos int, line string")


def reclaimable(current: DataFrame, mirror: DataFrame, stamp: DataFrame, live_tokens: Column | int, least: int = 50_000) -> DataFrame:
    """removed_bytes and tokens that a restart would free, for each file: what records
    weighed when loaded (the stamp, else the archive, else now) less what they weigh now, at
    the session's tokens for each live byte.  tokens is null below ``least`` and where it
    is not less than what is live.  current and stamp: file_id, uuid, bytes."""
    archived = mirror.filter("uuid is not null").groupBy("file_id", "uuid").agg(F.max(F.octet_length("line")).alias("_m"))
    loaded = stamp.groupBy("file_id", "uuid").agg(F.max("bytes").alias("_s"))
    priced = current.join(loaded, ["file_id", "uuid"], "left").join(archived, ["file_id", "uuid"], "left")
    was = F.coalesce("_s", "_m", "bytes")
    live = live_tokens if isinstance(live_tokens, Column) else F.lit(live_tokens)
    out = priced.groupBy("file_id").agg(F.sum(was).cast("long").alias("loaded_bytes"), F.sum(F.greatest(was - F.col("bytes"), F.lit(0))).cast("long").alias("removed_bytes"))
    tokens = F.floor(F.col("removed_bytes") * live / F.col("loaded_bytes")).cast("long")
    return out.withColumn("tokens", F.when((tokens >= least) & (tokens < live), tokens))


def sweep(mirrors: DataFrame, live: DataFrame, grace_hours: int = 24, now: Column | None = None) -> DataFrame:
    """Archives to delete: their transcript is gone and nothing changed within the grace.
    mirrors: file_id, path, modified; live: file_id."""
    now = now if now is not None else F.current_timestamp()
    old = mirrors.groupBy("file_id").agg(F.max("modified").alias("newest"), F.collect_set("path").alias("paths"))
    return old.join(live.select("file_id"), "file_id", "left_anti").filter(F.col("newest") < now - F.expr(f"interval {grace_hours} hours"))
