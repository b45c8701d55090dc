"""Benchmark decontamination: containment search of short items inside documents.

An item is contaminated by a document if the document has at least ``percent`` of the
item's distinct shingles (``k`` words, A-Z in lower case; an item of fewer words is one
shingle of all its words).  Items are partitioned by size (powers of two).  An item's sketch
is its MinHash with as many least hashes as the partition's largest size needs: with n
shingles and m that may be missing, the 2 m + 2 least hashes hold at least m + 2 shared
ones, so a document below that count cannot contain the item.  A document has a sketch for
each partition: its shingles of hash up to the greatest in the partition's sketches, so that
short items are not lost in a long document.  No containment is missed by chance.
Candidates are verified on the whole shingle set, word for word.

The sketches of a block of items are held by every task; a block has at most
``block_bytes`` of text (measured first).  A larger benchmark takes several blocks, one
pass over the documents each.

Defined results: null or empty items match nothing; null or empty documents contain
nothing.  Repeated items and documents are judged row by row.  An empty table on either side
matches nothing.  Other columns of the inputs are not read, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm import text as tx

U = np.uint64
LUT_BITS = 20


class Index:
    """Sketches and whole shingle sets of a bounded block of items."""

    def __init__(self, items: list[tuple[int, str]], k: int, percent: int):
        self.k, self.ids, self.grams, self.need, self.least = k, [], [], [], []
        holders: dict[tuple[int, int], dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = tx.Words(pa.array([text or ""]), lower=True)
            n = len(words.hash)
            if not n:
                continue
            m = min(k, n)
            spelled = words.text(0)
            hashes = tx.grams(words.hash, m, m)
            grams = {h: tuple(spelled[i : i + m]) for i, h in enumerate(hashes.tolist())}
            size = len(grams)
            top = 1 << (size - 1).bit_length()  # the partition's largest size
            sketch = sorted(grams)[: 2 * (top * (100 - percent) // 100) + 2]
            wanted = -(-size * percent // 100)
            at = len(self.ids)
            self.ids.append(item_id)
            self.grams.append((m, grams))
            self.need.append(wanted)
            self.least.append(max(1, len(sketch) - (size - wanted)))
            for h in sketch:
                holders[m, top][h].append(at)
        self.partitions = []
        for (m, _), by_hash in sorted(holders.items()):
            keys = np.array(sorted(by_hash), U)
            lut = np.zeros(1 << LUT_BITS, bool)
            lut[(keys & U((1 << LUT_BITS) - 1)).astype(np.int64)] = True
            self.partitions.append((m, keys[-1], lut, keys, [by_hash[h] for h in keys.tolist()]))

    def matches(self, col: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) of every containment in a column of texts."""
        words = tx.Words(col, lower=True)
        row = words.row_of()
        out = []
        grams: dict[int, np.ndarray] = {}
        for m, greatest, lut, keys, holders in self.partitions:
            if m not in grams:
                grams[m] = tx.grams(words.hash, m, m)
            g = grams[m]
            sketch = np.flatnonzero(g <= greatest)
            sketch = sketch[row[sketch] == row[sketch + m - 1]]
            maybe = sketch[lut[(g[sketch] & U((1 << LUT_BITS) - 1)).astype(np.int64)]]
            place = np.searchsorted(keys, g[maybe])
            hit = (place < len(keys)) & (keys[np.minimum(place, len(keys) - 1)] == g[maybe])
            seen: dict[tuple[int, int], set[int]] = defaultdict(set)
            for r, p in zip(row[maybe[hit]].tolist(), place[hit].tolist(), strict=True):
                for item in holders[p]:
                    seen[r, item].add(p)
            for (r, item), found in seen.items():
                if len(found) >= self.least[item]:
                    a, b = words.ptr[r], words.ptr[r + 1] - m + 1
                    wanted = self.grams[item][1]
                    mine = g[a:b]
                    shared = 0
                    for h in np.intersect1d(mine, np.fromiter(wanted, U, len(wanted))).tolist():
                        i = a + int(np.flatnonzero(mine == U(h))[0])
                        shared += wanted[h] == tuple(words.data[words.start[j] : words.end[j]].tobytes() for j in range(i, i + m))
                    if shared >= self.need[item]:
                        out.append((r, item, shared))
        return out


def _pairs(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.chunked(batches, "text"):
            found = index.matches(b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array([r for r, _, _ in found], pa.int64())), pa.array([index.ids[i] for _, i, _ in found], pa.int64()), pa.array([len(index.grams[i][1]) for _, i, _ in found], pa.int64()), pa.array([s for _, _, s in found], pa.int64())],
                names=["doc_id", "item_id", "n_item", "n_shared"],
            )

    return run


def _clean(index: Index, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.chunked(batches, text_col, tx.LEAN_BYTES):
            keep = np.ones(b.num_rows, bool)
            keep[[r for r, _, _ in index.matches(b.column(b.schema.get_field_index(text_col)))]] = False
            yield b.filter(pa.array(keep))

    return tx.tidy(run)


def _blocks(benchmark: DataFrame, k: int, percent: int, block_bytes: int, item_col: str, text_col: str) -> Iterator[Index]:
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = -(-size // block_bytes)
    for i in range(n):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else items
        yield Index([tuple(r) for r in part.collect()], k, percent)


def contained_items(documents: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, block_bytes: int = 8 << 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_item (its distinct shingles), n_shared, for each contained item."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shape = "doc_id long, item_id long, n_item long, n_shared long"
    parts = [docs.mapInArrow(_pairs(x), shape) for x in _blocks(benchmark, k, percent, block_bytes, item_col, item_text)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], shape)


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, block_bytes: int = 8 << 20, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that contain no item, all columns as they were."""
    out = documents
    for x in _blocks(benchmark, k, percent, block_bytes, item_col, item_text):
        out = out.mapInArrow(_clean(x, text_col), out.schema)
    return out
