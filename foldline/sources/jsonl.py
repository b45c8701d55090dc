"""Transcripts written back as JSON Lines, one file for each session.

Tasks write through the file system that a file's URI names.  A file is replaced by a rename
of a finished sibling, and only if it still is as long as when it was read; what its last
byte was (a line end or not) it is again.
"""

from __future__ import annotations

import os
import re
import uuid
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.sources.grouped import per_file
from foldline.sources.transcripts import listed

REPORT = "file_id string, path string, state string, bytes long"
_SCHEMA = pa.schema([("file_id", pa.string()), ("path", pa.string()), ("state", pa.string()), ("bytes", pa.int64())])


def files(spark: SparkSession, path: str) -> DataFrame:
    """file_id, path and length of the transcripts under a folder."""
    return lengths(listed(spark, path))


def lengths(found: DataFrame) -> DataFrame:
    """The same of files that are listed."""
    return found.select(F.regexp_extract("path", r"([^/]+)\.jsonl$", 1).alias("file_id"), "path", "length")


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _finish(fs: pafs.FileSystem, out: BinaryIO, name: str) -> None:
    out.close()
    if isinstance(fs, pafs.LocalFileSystem):  # others keep what is closed
        fd = os.open(name, os.O_RDONLY)
        try:
            os.fsync(fd)
        finally:
            os.close(fd)


def replace(path: str, lines: list[str], length: int) -> tuple[str, int]:
    """"written" and the new length, or "changed" and the length found if the file is not as
    long as it was, or gone."""
    fs, name = _at(path)
    found = fs.get_file_info(name)
    if found.type != pafs.FileType.File or found.size != length:
        return "changed", max(found.size or 0, 0)
    with fs.open_input_file(name) as f:
        f.seek(max(length - 1, 0))
        ends = f.read(1) == b"\n"
    data = "\n".join(lines).encode() + (b"\n" if ends and lines else b"")
    beside = f"{name}.{uuid.uuid4().hex}.tmp"
    out = fs.open_output_stream(beside)
    out.write(data)
    _finish(fs, out, beside)
    if fs.get_file_info(name).size != length:  # it grew while the sibling was written
        fs.delete_file(beside)
        return "changed", fs.get_file_info(name).size
    fs.move(beside, name)
    return "written", len(data)


def _swap(t: pa.Table) -> pa.Table:
    t = t.sort_by("pos")
    file_id, path, length = (t.column(c)[0].as_py() for c in ("file_id", "path", "length"))
    return pa.Table.from_pylist([{"file_id": file_id, "path": path} | dict(zip(("state", "bytes"), replace(path, [x for x in t.column("line").to_pylist() if x is not None], length), strict=True))], _SCHEMA)


def swap(lines: DataFrame, where: DataFrame) -> DataFrame:
    """Replaces each file (where: file_id, path, length as read) by its lines (file_id, pos,
    line; null lines go).  An action per row of the report: write it once."""
    rows = lines.select("file_id", "pos", "line").join(where.select("file_id", "path", "length"), "file_id")
    return per_file(rows, _swap, REPORT)


def _append(folder: str):
    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        file_id = t.column("file_id")[0].as_py()
        path = f"{folder.rstrip('/')}/{file_id}.jsonl"
        fs, name = _at(path)
        fs.create_dir(name.rpartition("/")[0], recursive=True)
        data = "".join(x + "\n" for x in t.column("line").to_pylist()).encode()
        old = b""
        if fs.get_file_info(name).type == pafs.FileType.File:
            with fs.open_input_stream(name) as f:
                old = f.read()
            if old.endswith(data):  # a task that runs again appends nothing twice
                return pa.Table.from_pylist([{"file_id": file_id, "path": path, "state": "present", "bytes": len(old)}], _SCHEMA)
        beside = f"{name}.{uuid.uuid4().hex}.tmp"
        out = fs.open_output_stream(beside)
        out.write(old + data)
        _finish(fs, out, beside)
        fs.move(beside, name)
        return pa.Table.from_pylist([{"file_id": file_id, "path": path, "state": "written", "bytes": len(old) + len(data)}], _SCHEMA)

    return run


def append(lines: DataFrame, folder: str) -> DataFrame:
    """Adds lines (file_id, pos, line) to each session's file under a folder, made if it is not
    there.  An action per row of the report: write it once."""
    return per_file(lines.select("file_id", "pos", "line"), _append(folder), REPORT)
