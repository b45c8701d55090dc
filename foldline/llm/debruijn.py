"""Removal of long passages that repeat, by compaction of a token de Bruijn graph.

Edges are the windows of ``window`` words; the nodes are the words that two windows
following one another share.  An edge is repeated if its word sequence starts at two
places at least.

Each window has an anchor: of the ``k``-word runs inside it, the one of least hash, the
leftmost of equals.  Windows of equal words have equal anchors at equal distance.  A document
is a walk through the graph; its windows of one anchor are a step of it, a path of edges
that is written as one row (anchor, hash of all its words, coordinates).  Then:

1. Anchors that occur once hold no repeated edge; a join takes their steps away.
2. Equal steps are one path of the graph, with a multiplicity and with its degrees: how many
   different steps come before and after it (a document's begin or end counts as one).
3. Where a path of several copies has one successor and that one has one predecessor, the
   node between them does not branch.  Such links are compacted by joins, pointers doubling
   each round, so that every path knows the first one of its chain and its distance from it:
   a unitig, whose edges all have one multiplicity.
4. A join takes the first paths back to their source coordinates.  The words of every unitig
   are read there and compared, word for word, with those of its other occurrences.  Should
   any differ, hashes have met, and all begins again with other ones.
5. Inside paths that occur once the graph branches, if anything is repeated at all.  Their
   edges, and those of the paths that share their anchor, are read at the coordinates of one
   occurrence and counted with the paths' multiplicities, one by one.

Identity: a path is known by its anchor and a hash of all its words (64 bits each) until its
unitig's words are compared; an edge of step 5 by its anchor and the hash of its words (64
bits each), compared only between paths of one anchor; coordinates tell occurrences apart.

Every stage is a table in the shared folder.  Joins of hot paths read tables on both sides,
so Spark can split them; copies of a path cost one row for each task.

Defined results: a null, empty or short text has no window and keeps its words.  Windows
are judged on the input, so repeats inside one document count.  Rows that repeat a
document are occurrences of their own, equal ids or null ids included; what is removed is
found once for all equal rows.  An empty table gives an empty result.  Other columns of the
input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm import text as tx
from foldline.llm.shared import drop, table

U = np.uint64
_POS = U((1 << 26) - 1)
#: A row: its id, and a hash of its text for ids that more than one row has.
KEY = ["row_key", "row_tag"]
#: Stands for a null id while rows are joined.
NO_ID = -(2**63) + 1


def _runs(words: tx.Words, window: int, k: int):
    """Paths: row, anchor hash, first window, number of windows; all in words of the chunk."""
    h = words.hash
    if len(h) < window:
        z = np.zeros(0, np.int64)
        return z, np.zeros(0, U), z, z
    anchors = tx.grams(h, k)
    at = np.arange(len(anchors), dtype=U)
    key = (anchors & ~_POS) | at
    least = tx.sliding(key, window - k + 1, np.minimum)
    row = words.row_of()
    whole = row[: len(least)] == row[window - 1 : window - 1 + len(least)]
    place = (least & _POS).astype(np.int64)
    first = whole.copy()
    first[1:] &= ~(whole[:-1] & (place[1:] == place[:-1]) & (row[1 : len(least)] == row[: len(least) - 1]))
    start = np.flatnonzero(first)
    edge = np.append(start, len(least))
    inside = np.concatenate([[0], np.cumsum(whole)])
    count = inside[edge[1:]] - inside[edge[:-1]]
    return row[start], anchors[place[start]], start, count


STEPS = "row_key long, row_tag long, anchors array<long>, paths array<long>, starts array<int>, counts array<int>"


def _steps(window: int, k: int, salt: int):
    """Each document's walk: anchor, hash of all words, first window and number of windows of
    its steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.chunked(batches, "text"):
            words = tx.Words(b.column("text"))
            row, anchor, start, count = _runs(words, window, k)
            if not len(row):
                continue
            h = tx.mix(words.hash ^ U(0x5851F42D4C957F2D + salt))
            total = np.zeros(len(h) + 1, U)
            np.cumsum(h * tx.powers(tx._GRAM_INV, len(h)), out=total[1:])
            end = start + count + window - 1
            path = tx.mix((total[end] - total[start]) * tx.powers(tx._GRAM, len(h))[end - 1] + (end - start).astype(U))
            path[path == 0] = U(1)  # 0 stands for a document's begin or end
            size = np.bincount(row, minlength=b.num_rows)
            some = np.flatnonzero(size)
            cols = [tx.lists(v, size[some], t) for v, t in ((tx.signed(anchor), pa.int64()), (tx.signed(path), pa.int64()), ((start - words.ptr[row]).astype(np.int32), pa.int32()), (count.astype(np.int32), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(some)) for c in KEY), *cols], names=[*KEY, "anchors", "paths", "starts", "counts"])

    return run


SPAN = "struct<start:int,n:int,path:long,anchor:long,copies:long>"
READ = "row_key long, row_tag long, start int, path long, anchor long, copies long, words string, edges array<long>"


def _read(window: int):
    """For each wanted span of a document: the words of a unitig (anchor is null), or the
    hashes of a path's edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.chunked(batches, "text"):
            words = tx.Words(b.column("text"))
            edges = tx.signed(tx.grams(words.hash, window))
            keys = list(zip(*(b.column(c).to_pylist() for c in KEY), strict=True))
            held, size = [], 0
            for i, spans in enumerate(b.column("spans").to_pylist()):
                for x in spans:
                    a = int(words.ptr[i]) + x["start"]
                    out = {"row_key": keys[i][0], "row_tag": keys[i][1], "start": x["start"], "path": x["path"], "anchor": x["anchor"], "copies": x["copies"]}
                    if x["anchor"] is None:
                        z = a + x["n"] + window - 1
                        out["words"] = words.joined(a, z).decode("utf-8", "replace")
                        size += len(out["words"])
                    else:
                        out["edges"] = edges[a : a + x["n"]].tolist()
                        size += 8 * x["n"]
                    held.append(out)
                    if size > 2 * tx.CHUNK_BYTES:
                        yield pa.RecordBatch.from_pylist(held, READ_SCHEMA)
                        held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, READ_SCHEMA)

    return run


READ_SCHEMA = pa.schema([("row_key", pa.int64()), ("row_tag", pa.int64()), ("start", pa.int32()), ("path", pa.int64()), ("anchor", pa.int64()), ("copies", pa.int64()), ("words", pa.string()), ("edges", pa.list_(pa.int64()))])


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.chunked(batches, "text"):
            words = tx.Words(b.column("text"))
            ids = b.column("doc_id")
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": []}
            for i, spans in enumerate(b.column("spans").to_pylist()):
                first, last = int(words.ptr[i]), int(words.ptr[i + 1])
                n = last - first
                delta = np.zeros(n + 1, np.int64)
                for s in spans or ():
                    if s["mask"] is None:  # all of them
                        delta[s["start"]] += 1
                        delta[s["start"] + s["n"] - 1 + window] -= 1
                        continue
                    for j in range(s["n"]):
                        if s["mask"] >> j & 1:
                            delta[s["start"] + j] += 1
                            delta[s["start"] + j + window] -= 1
                here = np.cumsum(delta[:-1]) == 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], here, [False]]).astype(np.int8)))  # of the runs of kept words
                kept = b" ".join(words.joined(first + a, first + b) for a, b in edge.reshape(-1, 2).tolist())
                out["n_words"].append(n)
                out["n_removed"].append(n - int(here.sum()))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string())], names=["doc_id", *out])

    return run


def walks(docs: DataFrame, window: int, k: int, salt: int = 0) -> DataFrame:
    """A table of the steps whose anchor occurs again: anchor, path, KEY, start, n, and the
    paths before and after in the document (0 at its begin and end)."""
    steps = table(docs.mapInArrow(_steps(window, k, salt), STEPS), "steps")
    again = table(steps.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "anchors")
    each = steps.select("*", F.posexplode("anchors").alias("i", "anchor")).select(
        "anchor", F.expr("paths[i]").alias("path"), *KEY, F.expr("starts[i]").alias("start"), F.expr("counts[i]").alias("n"),
        F.expr("if(i > 0 and get(starts, i - 1) + get(counts, i - 1) = starts[i], get(paths, i - 1), 0L)").alias("before"),
        F.expr("if(get(starts, i + 1) = starts[i] + counts[i], get(paths, i + 1), 0L)").alias("after"),
    )
    out = table(each.join(again, "anchor", "left_semi"), "walk")
    drop(steps, again)
    return out


def path_graph(walk: DataFrame) -> DataFrame:
    """A table of the distinct paths: anchor, path, n, copies, ``before`` and ``after`` where
    there is one neighbour only (else null), and the coordinates of one occurrence."""
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c))
    return table(walk.groupBy("anchor", "path").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("copies"), one("before").alias("before"), one("after").alias("after"), *[F.first(c).alias(c) for c in (*KEY, "start")]), "paths")


def unitigs(paths: DataFrame, most: int = 64) -> DataFrame:
    """A table of maximal nonbranching chains of paths that occur more than once: the first
    path and n, the number of windows of all its paths."""
    many = paths.filter("copies > 1")
    link = many.filter("after <> 0").select(F.col("path").alias("to"), F.col("after").alias("path"), F.col("n").alias("off"))
    link = link.join(many.filter("before <> 0").select("path", F.col("before").alias("to")), ["path", "to"])
    link = table(link.select("path", "to", F.col("off").cast("long").alias("off")), "links")
    for _ in range(most):  # to: a path further up the chain each round, off: the windows between
        up = link.select(F.col("path").alias("to"), F.col("to").alias("to2"), F.col("off").alias("off2"))
        doubled = link.join(up, "to", "left")
        moved = table(doubled.select("path", F.coalesce("to2", "to").alias("to"), (F.col("off") + F.coalesce("off2", F.lit(0))).alias("off"), F.col("to2").isNotNull().alias("moved")), "links")
        drop(link)
        link = moved
        if not moved.filter("moved").limit(1).count():
            break
    else:
        raise RuntimeError("chains did not settle")
    last = link.join(many.select("path", "n"), "path").groupBy(F.col("to").alias("path")).agg(F.max(F.col("off") + F.col("n")).alias("whole"))
    first = many.join(link.select("path"), "path", "left_anti").join(last, "path", "left")
    out = table(first.select("anchor", "path", F.coalesce("whole", "n").cast("int").alias("n"), "copies"), "unitigs")
    drop(link)
    return out


def repeated_spans(docs: DataFrame, window: int, k: int, salt: int = 0) -> DataFrame:
    """A table of KEY, spans: for each row with repeated windows, where they are (first window,
    number of windows, mask of those that are repeated, null for all).  docs: KEY, text."""
    walk = walks(docs, window, k, salt)
    paths = path_graph(walk)
    units = unitigs(paths)
    found = table(walk.select("anchor", "path", *KEY, "start").join(units, ["anchor", "path"]).select(*KEY, "start", "n", "path"), "occurrences")
    drop(walk, units)

    # What is read at source coordinates: the unitigs' words, and the edges where paths branch.
    split = paths.join(paths.filter("copies = 1").select("anchor"), "anchor", "left_semi")
    wanted = found.select(*KEY, F.struct("start", "n", "path", F.lit(None).cast("long").alias("anchor"), F.lit(None).cast("long").alias("copies")).cast(SPAN).alias("span"))
    wanted = wanted.unionByName(split.select(*KEY, F.struct("start", "n", "path", "anchor", "copies").cast(SPAN).alias("span")))
    wanted = table(wanted.groupBy(*KEY).agg(F.collect_set("span").alias("spans")), "wanted")
    read = table(docs.join(wanted, KEY).select(*KEY, "text", "spans").mapInArrow(_read(window), READ), "read")

    # A unitig's occurrences agree word for word.
    said = read.filter("anchor is null").groupBy("path", "words").agg(F.count(F.lit(1)).alias("n"))
    if said.groupBy("path").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").limit(1).count():
        drop(paths, found, wanted, read)
        if salt == 3:
            raise RuntimeError("different words have equal hashes, whatever the salt")
        return repeated_spans(docs, window, k, salt + 1)
    sure = found.select(*KEY, "start", "n", F.lit(None).cast("long").alias("mask"))

    # An edge of one occurrence names the one path it is on, so no join leads back to it.
    edges = read.filter("anchor is not null").select("anchor", "path", "copies", "edges").distinct().select("anchor", "path", "copies", F.posexplode("edges").alias("at", "edge"))
    alone = edges.groupBy("anchor", "edge").agg(F.sum("copies").alias("total"), F.min("path").alias("path"), F.min("at").alias("at")).filter("total = 1")
    masks = alone.groupBy("anchor", "path").agg(F.expr("bit_or(shiftleft(1L, at))").alias("alone"))
    once = paths.filter("copies = 1").join(masks, ["anchor", "path"], "left").withColumn("mask", F.expr("shiftleft(1L, n) - 1 & ~coalesce(alone, 0L)")).filter("mask <> 0")
    both = sure.unionByName(once.select(*KEY, "start", "n", "mask"))
    out = table(both.groupBy(*KEY).agg(F.collect_set(F.struct("start", "n", "mask")).alias("spans")), "spans")
    drop(paths, found, wanted, read)
    return out


def remove_repeats(documents: DataFrame, window: int = 35, k: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row (see the module's text).

    ``window`` - ``k`` may be 62 at most (a path's mask is one long)."""
    if not 0 < k <= window or window - k > 62:
        raise ValueError("need 0 < k <= window <= k + 62")
    key, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    docs = documents.select(F.coalesce(key, F.lit(NO_ID)).alias("row_key"), F.xxhash64(text).alias("row_tag"), text.alias("text"))
    joined = docs.join(repeated_spans(docs, window, k), KEY, "left").select(F.expr(f"nullif(row_key, {NO_ID}L)").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), "spans")
    return joined.mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
