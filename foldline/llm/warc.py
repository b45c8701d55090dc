"""WARC records in seekable Zstandard bundles, written and read back.

A bundle is a run of independent Zstandard frames, each holding whole records, and a seek
table in a skippable frame at its end (each frame's compressed and decompressed size, then
a footer), so standard readers can decompress it whole and others can seek.  A record is
addressed by bundle, frame and offset in that frame; the index is a table of these.

Payloads that occur more than once are kept in one response record, that of the largest
id; the others are revisit records that name it.  Digests meet by shuffle, with map-side
aggregation, so a hot payload costs one row for each task.  The digests that occur again are
written as a table, so that Spark can split the join that brings copies to them.

Tasks write through the file system that the folder's URI names.  A bundle is written under
the name of its task attempt and then renamed to a name that is the same for all attempts;
only bundles in the written manifest count.

Defined results: a null payload is empty.  Every row is a record of its own, also rows that
repeat an id: among equal payloads all rows of the largest id are responses.  A row without
an id is a record that is named by its payload's digest; it is a revisit if an equal payload
has an id, and a response if none has.  A null address is ``about:blank``.  Empty input gives
no bundle and an empty result.  Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm.shared import scratch, table

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: The date of all records: results do not depend on when they are made.
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "bundle string, frame int, offset long, size long, record_id string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324  the format's digest


def urn(page_id: int | None, sha: str) -> str:
    return f"urn:page:{page_id}" if page_id is not None else f"urn:sha1:{sha}"


def record(page_id: int | None, url: str | None, payload: bytes, sha: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record.  A revisit has no payload but says how long it is."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{urn(page_id, sha)}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {' '.join((url or 'about:blank').split())}", f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{digest(block)}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """The header and the block of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    header = dict(x.split(": ", 1) for x in lines[1:])
    return header, rest[: int(header["Content-Length"])]


class BundleWriter:
    """Groups records into frames; close() appends the seek table."""

    def __init__(self, out, frame_bytes: int, level: int = 6):
        self.out, self.frame_bytes = out, frame_bytes
        self.coder = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.held_bytes = self.written = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and offset of the record."""
        if self.held and self.held_bytes + len(data) > self.frame_bytes:
            self.flush()
        at = len(self.frames), self.held_bytes
        self.held.append(data)
        self.held_bytes += len(data)
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.coder.compress(b"".join(self.held))
            self.out.write(packed)
            self.frames.append((len(packed), self.held_bytes))
            self.written += len(packed)
            self.held, self.held_bytes = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", c, d) for c, d in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)


class BundleReader:
    """Random access by frame; reads the seek table and the frames asked for, nothing else."""

    def __init__(self, file):
        self.file = file
        file.seek(0, io.SEEK_END)
        end = file.tell()
        file.seek(end - 9)
        count, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        entry = 12 if flags & 0x80 else 8
        file.seek(end - 9 - count * entry)
        table_ = file.read(count * entry)
        self.frames, at = [], 0
        for i in range(count):
            c, d = struct.unpack_from("<II", table_, i * entry)
            self.frames.append((at, c, d))
            at += c

    def frame(self, i: int) -> bytes:
        at, packed, size = self.frames[i]
        self.file.seek(at)
        return zstandard.ZstdDecompressor().decompress(self.file.read(packed), max_output_size=max(size, 1))


def _write(folder: str, frame_bytes: int, bundle_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        state: dict = {"n": 0, "writer": None, "rows": []}

        def finish() -> pa.RecordBatch:
            state["writer"].close()
            state["out"].close()
            fs.move(f"{root}/{state['name']}.{attempt}.tmp", f"{root}/{state['name']}")
            rows, state["rows"], state["writer"] = state["rows"], [], None
            state["n"] += 1
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["bundle", "frame", "offset", "size", "record_id"])

        for b in batches:
            for page_id, url, html, sha, refers in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "sha", "refers_to")), strict=True):
                if state["writer"] is None:
                    state["name"] = f"part-{part:05d}-{state['n']:04d}.warc.zst"
                    state["out"] = fs.open_output_stream(f"{root}/{state['name']}.{attempt}.tmp")
                    state["writer"] = BundleWriter(state["out"], frame_bytes)
                sha = base64.b32encode(bytes.fromhex(sha)).decode()
                data = record(page_id, url, (html or "").encode(), sha, refers)
                frame, offset = state["writer"].add(data)
                state["rows"].append((state["name"], frame, offset, len(data), urn(page_id, sha)))
                if state["writer"].written >= bundle_bytes:
                    yield finish()
        if state["writer"] is not None:
            yield finish()

    return run


def write_bundles(pages: DataFrame, folder: str, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", dedup_from: int = 0) -> DataFrame:
    """Write all rows under ``folder``; returns the index: bundle, frame, offset, size,
    record_id.  Equal payloads of at least ``dedup_from`` bytes are kept once."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.sha1(F.encode("html", "UTF-8")), "n": F.octet_length("html")})
    again = rows.select("sha", "page_id", "n").filter(F.col("n") >= dedup_from).groupBy("sha", "n").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("copies"))
    again = table(again.filter("copies > 1 and holder is not null").select("sha", "n", "holder"), "payloads")
    rows = rows.join(again, ["sha", "n"], "left").select("page_id", "url", "html", "sha", F.when(~F.col("holder").eqNullSafe(F.col("page_id")), F.col("holder")).alias("refers_to"))
    return table(rows.mapInArrow(_write(folder, frame_bytes, bundle_bytes), MANIFEST), "warc-index")


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        open_: dict = {}
        for b in batches:
            out = []
            for name, frame, offset, size, rid in sorted(zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)):
                if open_.get("name") != name:
                    open_ = {"name": name, "reader": BundleReader(fs.open_input_file(f"{root}/{name}")), "frame": None}
                if open_["frame"] != frame:
                    open_["data"], open_["frame"] = open_["reader"].frame(frame), frame
                header, block = parse(open_["data"][offset : offset + size])
                if header["WARC-Record-ID"] != f"<{rid}>":
                    raise ValueError(f"{name}: the index does not match")
                http, _, payload = block.partition(b"\r\n\r\n")
                told = int(http.rpartition(b"Content-Length: ")[2])
                sha = header["WARC-Payload-Digest"].removeprefix("sha1:")
                if header["WARC-Type"] == "response" and (len(payload) != told or digest(payload) != sha):
                    raise ValueError(f"{name}: {rid} is damaged")
                refers = header.get("WARC-Refers-To")
                out.append((int(rid.rpartition(":")[2]) if rid.startswith("urn:page:") else None, header["WARC-Target-URI"], told, sha, header["WARC-Type"], refers and int(refers[1:-1].rpartition(":")[2])))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """Every record that the index names: page_id, url, payload_bytes and payload_digest (of
    the whole payload, also of a revisit), record_type, refers_to.  Responses are checked
    against their digests."""
    return index.select("bundle", "frame", "offset", "size", "record_id").mapInArrow(_read(folder), READ)


def archive(pages: DataFrame, **options) -> DataFrame:
    """write_bundles() into a new folder of the shared one, then read_bundles()."""
    folder = scratch(pages.sparkSession, "warc")
    return read_bundles(write_bundles(pages, folder, **options), folder)
