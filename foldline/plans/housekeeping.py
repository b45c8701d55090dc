"""Stamps, dumps and tripwires around the archive."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldline.functions import jsonpatch as jp
from foldline.plans.session import NAMED


def record_sizes(lines: DataFrame) -> DataFrame:
    """uuid and bytes of each line, by the first uuid in it; no JSON is parsed."""
    uuid = F.nullif(F.regexp_extract("line", '"uuid":"([^"]+)"', 1), F.lit(""))
    return lines.select("file_id", uuid.alias("uuid"), F.octet_length("line").cast("long").alias("bytes")).filter("uuid is not null")


def load_stamp(lines: DataFrame) -> DataFrame:
    """What each record weighed when its session was loaded; of a repeated uuid, the last."""
    uuid = F.nullif(F.regexp_extract("line", '"uuid":"([^"]+)"', 1), F.lit(""))
    return lines.withColumn("uuid", uuid).filter("uuid is not null").groupBy("file_id", "uuid").agg(F.max_by(F.octet_length("line"), "pos").cast("long").alias("bytes"))


STAMPS = "file_id string, uuid string, bytes long, at timestamp"


def write_stamps(lines: DataFrame, path: str) -> None:
    """Appends the load stamps of sessions (file_id, pos, line), all with one time."""
    load_stamp(lines).withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def newest_stamps(stamps: DataFrame) -> DataFrame:
    """Of STAMPS rows those of each session's newest stamp."""
    newest = stamps.groupBy("file_id").agg(F.max("at").alias("at"))
    return stamps.join(newest, ["file_id", "at"]).select("file_id", "uuid", "bytes")


def refs_dump(texts: DataFrame) -> DataFrame:
    """One text for each ref: its texts joined by newlines in archive order."""
    rows = F.array_sort(F.collect_list(F.struct("seq", "n", "text")))
    return texts.groupBy("ref").agg(F.array_join(F.transform(rows, lambda x: x["text"]), "\n").alias("text"))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        named = [sorted({m.lower() for t in jp.strings(jp.loads(x.removesuffix("\r"))) for m in NAMED.findall(t)}) for x in b.column("raw").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("uuid"), b.column("marked"), pa.array(named, pa.list_(pa.string()))], names=["file_id", "uuid", "marked", "named"])


def marks(records: DataFrame) -> DataFrame:
    """file_id, uuid and marked of each marked record, and the sessions that its retrieval
    commands name, in lower case."""
    return records.filter("marked").select("file_id", "uuid", "marked", "raw").mapInArrow(_marks, "file_id string, uuid string, marked boolean, named array<string>")


def mirror_lost(records: DataFrame, mirror: DataFrame) -> DataFrame:
    """Sessions with rewritten records whose archive is gone: they must be left alone."""
    return records.filter("marked").select("file_id").distinct().join(mirror.select("file_id").distinct(), "file_id", "left_anti")


def left_alone(marked: DataFrame, mirror: DataFrame) -> DataFrame:
    """The lost sessions out of marks(): a fork has no archive before its first pass, so one
    whose marked records are in another archive is not lost unless it names itself."""
    own = marked.filter(F.array_contains("named", F.lower("file_id"))).select("file_id").distinct()
    forks = fork_parents(marked, mirror).select("file_id").distinct().join(own, "file_id", "left_anti")
    return mirror_lost(marked, mirror).join(forks, "file_id", "left_anti")


def _held_elsewhere(records: DataFrame, mirror: DataFrame) -> DataFrame:
    other = mirror.select(F.col("file_id").alias("parent"), "uuid").filter("uuid is not null")
    return records.filter("marked and uuid is not null").join(other, "uuid").filter("parent <> file_id")


def fork_parents(records: DataFrame, mirror: DataFrame) -> DataFrame:
    """file_id, parent: sessions whose marked records another session's archive holds."""
    return _held_elsewhere(records, mirror).select("file_id", "parent").distinct()


def fork_copies(marked: DataFrame, mirror: DataFrame) -> DataFrame:
    """file_id, uuid, parent: records out of marks() that name a session whose archive holds
    them.  One that the named archive lacks only quotes its commands."""
    held = _held_elsewhere(marked, mirror).filter(F.array_contains("named", F.lower("parent")) & (F.lower("parent") != F.lower("file_id")))
    return held.select("file_id", "uuid", "parent").distinct()


def _rebind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for file_id, line in zip(b.column("file_id").to_pylist(), b.column("line").to_pylist(), strict=True):
            try:
                root = jp.loads(line)
            except ValueError:
                root = None
            if isinstance(root, dict) and root.get("sessionId") is not None:
                line = jp.dumps(root | {"sessionId": file_id})
            out.append(line)
        at = b.schema.get_field_index("line")
        yield b.set_column(at, b.schema.field(at), pa.array(out, pa.string()))


def adopt_parents(mirror: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows that give each session's archive the records of its parents (file_id, parent)
    that it lacks, after its own and under its id."""
    pairs = pairs.select("file_id", "parent").distinct()
    theirs = mirror.filter("uuid is not null").withColumnRenamed("file_id", "parent").join(pairs, "parent")
    more = theirs.join(mirror.select("file_id", "identity"), ["file_id", "identity"], "left_anti")
    once = more.withColumn("_c", F.row_number().over(Window.partitionBy("file_id", "identity").orderBy("parent", "seq"))).filter("_c = 1")
    last = mirror.groupBy("file_id").agg(F.max("seq").alias("_s"))
    numbered = once.withColumn("_n", F.row_number().over(Window.partitionBy("file_id").orderBy("parent", "seq"))).join(last, "file_id", "left")
    rows = numbered.select("file_id", (F.coalesce("_s", F.lit(-1)) + F.col("_n")).cast("long").alias("seq"), "identity", "uuid", "line")
    return rows.mapInArrow(_rebind, "file_id string, seq long, identity string, uuid string, line string")


def adopt_parent(mirror: DataFrame, file_id: str, parent: str) -> DataFrame:
    """adopt_parents for one session and parent."""
    return adopt_parents(mirror, mirror.sparkSession.range(1).select(F.lit(file_id).alias("file_id"), F.lit(parent).alias("parent")))


def largest(files: DataFrame) -> DataFrame:
    """Each session's largest archive file."""
    return files.groupBy("file_id").agg(F.max_by("path", F.struct("length", "path")).alias("path"), F.max("length").alias("length"))
