"""Similarity self-join on word shingles with adaptive multi-match prefixes.

Shingles have one global order: those whose bucket in a count sketch of all documents
stands out come last, by how far it stands out, the rest by hash.  If |x ^ y| >= a, the
first |x| - a + l shingles of x and the first |y| - a + l of y share l at least, for every
l up to a (the l-prefix).  A document's least a is ceil(t |x|); each takes the l of least
estimated cost: the postings its prefix meets plus what it costs to verify the candidates
that share l of them.  A pair has an a of its own, ceil(t (|x| + |y|) / (1 + t)), so its
prefixes are shorter than what either document has posted: two documents are candidates
if they share min(lx, ly) shingles within the pair's prefixes.  Candidates are verified on
their whole shingle sets.

Hot groups: documents of one shingle set compact into a class first (map side first).
Then hubs and neighbours in each shingle's postings, two for each posting at most, are
verified and joined into components.  After that only postings of more than one component
matter, and there only pairs of different components: a large group of near copies, by
then one component, is never expanded into pairs.  Documents that resemble a large group
but do not link with its hub hold shingles of their own, which come first in the order.
With n posted shingles that nobody else posts, |x| - n bounds the overlap with partners that
leave no more shingles unposted (a longer partner's excess adds to the bound: what it shares
with x unposted stands behind as many posted ones that both have).  The place of the first
shingle that a pair shares bounds it too.  Documents that can share enough with nobody go at
once, and for that each posts a third more than the longest prefix needs.  For the others,
postings meet by size band within those bounds only, at shingles that are early enough to be
the pair's first (l = 1) and do not follow another shared one at once; then the pair's whole prefixes are counted against its l.  All
that pass are verified, so no link between different components is lost.

Defined results: without words (null and empty texts too) a set is empty, and the
document is linked with nothing; with 1 to k-1 words the whole sequence is the one
shingle.  Rows without an id link nothing, and get the component of their equals (null
without any).  Rows of one id count as one document: they are in one component.  Other
columns of the input are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldline.llm import text as tx
from foldline.llm.components import components
from foldline.llm.shared import drop, table

U = np.uint64
SKETCH_BITS, SLICES, LEVEL_BITS = 18, 16, 5
#: Postings of one shingle that are ordered in one task; more are dealt to several.
LIST = 50_000
#: Size bands between a size and the least that can link with it.
BANDS = 4


def shingle_sets(words: tx.Words, k: int, order: Callable[[np.ndarray], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all rows, each row's in ascending order, and where each row's
    begin (one more entry than rows).  order turns hashes into the keys to sort by."""
    h, ptr = words.hash, words.ptr
    size = np.diff(ptr)
    count = np.where(size < k, np.minimum(size, 1), size - k + 1)
    edge = np.append(0, np.cumsum(count))
    flat = np.empty(edge[-1], U)
    g = tx.grams(h, k, 0)
    if len(g):
        row = words.row_of()
        long = size >= k
        flat[np.repeat(long, count)] = g[row[: len(g)] == row[k - 1 :]]
    for m in range(1, k):
        short = np.flatnonzero(size == m)
        if len(short):
            flat[edge[short]] = tx.grams(h, m, 0x51ED27 * m)[ptr[short]]
    if order is not None:
        flat = order(flat)
    many = np.flatnonzero(count > 1)
    for a, b in zip(edge[many].tolist(), edge[many + 1].tolist(), strict=True):
        flat[a:b].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[edge[:-1][count > 0]] = True
    return flat[new], np.append(0, np.cumsum(new))[edge]


def _bucket(s: np.ndarray) -> np.ndarray:
    return (s & U((1 << SKETCH_BITS) - 1)).astype(np.int64)


def _total(values: np.ndarray, edge: np.ndarray, salt: int) -> np.ndarray:
    """For each row the sum of its values' mixed hashes: the same for equal sets."""
    total = np.append(U(0), np.cumsum(tx.mix(values ^ U(salt)), dtype=U))
    return total[edge[1:]] - total[edge[:-1]]


SIGNED = "doc_id long, size long, c1 long, c2 long, part int, counts binary"


def _signatures(k: int):
    """One row for each document, and its task's sketch in SLICES rows at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "size", "c1", "c2", "part", "counts"]
        for b in tx.chunked(batches, "text", tx.LEAN_BYTES):
            s, edge = shingle_sets(tx.Words(b.column("text"), lower=True), k)
            total += np.bincount(_bucket(s), minlength=len(total))
            c1, c2 = (pa.array(tx.signed(_total(s, edge, x))) for x in (0x243F6A8885A308D3, 0x13198A2E03707344))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(edge)), c1, c2, pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())], names=names)
        if total.any():
            none = pa.nulls(SLICES, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in np.split(total, SLICES)], pa.binary())], names=names)

    return tx.tidy(run)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, counts in zip(b.column("part").to_pylist(), b.column("counts").to_pylist(), strict=True):
            total[part] = total.get(part, 0) + np.frombuffer(counts, np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["part", "counts"])


def frequency_levels(sketches: DataFrame) -> np.ndarray:
    """A level for each bucket of the sketch (fixed size: 256 KB): 0 for all that do not
    stand out, else one more for each doubling.  The sketch counts all documents; 2 MB for
    each task are shuffled, added up as they stream in, and 2 MB reach the driver."""
    parts = sketches.repartition(SLICES, "part").mapInArrow(_add, "part int, counts binary").collect()
    total = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.int64)
    for r in parts:
        total[r["part"]] += np.frombuffer(r["counts"], np.int64)
    total = total.ravel()
    mean = total.mean()
    over = (total - mean) / (4 * np.sqrt(mean) + 2)
    return np.where(over > 1, np.floor(np.log2(np.maximum(over, 1))) + 1, 0).clip(0, 31).astype(np.uint8)


def _prefixes(k: int, percent: int, most: int, levels: bytes):
    """The postings of each document's longest prefix; equal sets once for each chunk."""
    level = np.frombuffer(levels, np.uint8)

    def order(s: np.ndarray) -> np.ndarray:
        return (level[_bucket(s)].astype(U) << U(64 - LEVEL_BITS)) | (s >> U(LEVEL_BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.chunked(batches, "text", tx.LEAN_BYTES):
            token, edge = shingle_sets(tx.Words(b.column("text"), lower=True), k, order)
            size = np.diff(edge)
            _, first = np.unique(_total(token, edge, 0x452821E638D01377), return_index=True)
            once = np.zeros(len(size), bool)
            once[first] = True
            spare = size - (size * percent + 99) // 100
            count = np.where(once, np.minimum(size, spare + np.maximum(most, spare // 3)), 0)
            row = np.repeat(np.arange(len(size)), count)
            if not len(row):
                continue
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            yield pa.RecordBatch.from_arrays([pa.array(tx.signed(token[edge[row] + place])), b.column("doc_id").take(pa.array(row)), pa.array(size[row].astype(np.int32)), pa.array(place.astype(np.int32))], names=["token", "doc_id", "size", "place"])

    return tx.tidy(run)


def _linked(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.chunked(batches, "text_x", tx.LEAN_BYTES):
            sx, ex = shingle_sets(tx.Words(b.column("text_x"), lower=True), k)
            sy, ey = shingle_sets(tx.Words(b.column("text_y"), lower=True), k)
            ok = np.zeros(b.num_rows, bool)
            for i, (a, c, d, e) in enumerate(zip(ex[:-1].tolist(), ex[1:].tolist(), ey[:-1].tolist(), ey[1:].tolist(), strict=True)):
                both = np.concatenate([sx[a:c], sy[d:e]])
                both.sort()
                n = int((both[1:] == both[:-1]).sum())
                ok[i] = len(both) > n and 100 * n >= percent * (len(both) - n)
            yield b.select(["x", "y"]).filter(pa.array(ok))

    return tx.tidy(run)


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    x = texts.select(F.col("rep").alias("x"), F.col("text").alias("text_x"))
    y = texts.select(F.col("rep").alias("y"), F.col("text").alias("text_y"))
    return pairs.select("x", "y").join(x, "x").join(y, "y").mapInArrow(_linked(k, percent), "x long, y long").distinct()


#: Of ``size`` shingles ``rest`` are not posted, and of those posted ``alone`` are posted by no
#: other class; ``scheme`` is the l chosen.
POSTING = ["rep", "size", "place", "scheme", "alone", "rest"]


def _least(percent: int) -> str:
    """The least overlap of a pair that links."""
    return f"(({percent}L * (size + size2) + {99 + percent}L) div {100 + percent}L)"


def _room(percent: int) -> str:
    """Whether shingles that one of a pair has alone leave room for the least overlap."""
    return f"greatest(alone - greatest(rest2 - rest, 0) - size, alone2 - greatest(rest - rest2, 0) - size2) + {_least(percent)} <= 0"


def _candidates(met: DataFrame, percent: int) -> DataFrame:
    """x, y that share enough.  met: a row for each shingle that the postings of two
    documents (POSTING, and the same names with a 2) have in common."""
    met = met.filter(f"100L * least(size, size2) >= {percent}L * greatest(size, size2) and greatest(place - size, place2 - size2) + {_least(percent)} < least(scheme, scheme2) and {_room(percent)}")
    return met.groupBy(F.least("rep", "rep2").alias("x"), F.greatest("rep", "rep2").alias("y")).agg(F.count(F.lit(1)).alias("n"), F.min(F.least("scheme", "scheme2")).alias("l")).filter("n >= l").select("x", "y")


def _other(c: str) -> Column:
    return F.col(c).alias(f"{c}2")


def _meeting(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs (POSTING without place, and the same names with a 2) of different components that
    share a shingle early enough: the longer document's posting is dealt to the size bands of
    its possible partners, the shorter one's to that of its own size.  Two of a shingle's
    largest component never meet."""
    band = lambda size: F.floor(F.log(size.cast("double")) * (BANDS / np.log(100 / min(percent, 99)))).cast("int")
    # Two that share the posting before as well have met there, earlier.
    mixed = mixed.withColumn("before", F.lag("token").over(Window.partitionBy("rep").orderBy("place")))
    size, reach = F.col("size"), F.expr("size - greatest(place, alone - 1)")
    least = F.floor((size * percent + 99) / 100)
    most = F.least(F.floor(reach * (100 + percent) / percent) - size, size)
    longer = mixed.withColumns({"least": least, "most": most}).filter("least <= most").withColumn("band", F.explode(F.sequence(band(F.col("least")), band(F.col("most")))))
    longer = longer.select("token", "band", "comp", "major", "before", *POSTING)
    shorter = mixed.filter(f"place - size + (2L * {percent} * size + {99 + percent}L) div {100 + percent}L <= 0").select("token", band(size).alias("band"), _other("comp"), _other("before"), F.col("major").alias("_m"), *map(_other, POSTING))
    left = longer.filter("comp <> major").join(shorter.drop("_m"), ["token", "band"])
    right = longer.filter("comp = major").join(shorter.filter("comp2 <> _m").drop("_m"), ["token", "band"])
    early = f"coalesce(before <> before2, true) and greatest(place - size, place2 - size2) + {_least(percent)} <= 0 and {_room(percent)}"
    met = left.unionByName(right).filter(f"comp <> comp2 and size2 <= size and (size2 < size or rep2 < rep) and 100L * size2 >= {percent}L * size and {early}")
    return met.groupBy("rep", "size", "rep2", "size2").agg(F.min(F.least("scheme", "scheme2")).alias("l"))


def _sharing(pairs: DataFrame, mixed: DataFrame, percent: int) -> DataFrame:
    """x, y of those _meeting() pairs that share l shingles within their l-prefixes."""
    prefix = table(mixed.groupBy("rep").agg(F.collect_list(F.struct("token", "place")).alias("prefix")), "whole-prefixes")
    both = pairs.filter("l > 1").join(prefix, "rep").join(prefix.select(_other("rep"), _other("prefix")), "rep2")
    tokens = lambda n: f"transform(filter(prefix{n}, t -> t.place < size{n} - {_least(percent)} + l), t -> t.token)"
    enough = both.filter(f"size(array_intersect({tokens('')}, {tokens('2')})) >= l")
    return pairs.filter("l = 1").select("rep", "rep2").unionByName(enough.select("rep", "rep2")).select(F.least("rep", "rep2").alias("x"), F.greatest("rep", "rep2").alias("y"))


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80, max_level: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row.  Linked: 100 |x ^ y| >= percent |x v y|
    on distinct k-word shingles of the text with A-Z in lower case."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = table(docs.mapInArrow(_signatures(k), SIGNED), "signatures")
    levels = frequency_levels(signed.filter("part is not null").select("part", "counts")).tobytes()

    # Joins of a hot class or component read tables on both sides, so Spark can split them.
    mine = signed.filter("part is null")
    reps = table(mine.filter("size > 0").groupBy("c1", "c2", "size").agg(F.min("doc_id").alias("rep")), "reps")
    classes = table(mine.join(reps, ["c1", "c2", "size"], "left").select("doc_id", "size", "rep"), "classes")
    drop(signed, reps)

    # Postings of shingles that more than one class has.
    posted = table(docs.filter("doc_id is not null").mapInArrow(_prefixes(k, percent, max_level, levels), "token long, doc_id long, size int, place int"), "posted")
    twice = posted.groupBy("token").count().filter("count > 1").select("token")
    member = classes.filter("rep is not null and doc_id is not null").select("doc_id", F.col("size").cast("int").alias("size"), "rep").distinct()
    postings = table(posted.join(twice, "token", "left_semi").join(member, ["doc_id", "size"]).groupBy("token", "rep", "size").agg(F.min("place").alias("place")), "postings")
    drop(posted)

    # Each document's prefix: the cheapest of the schemes 1 .. max_level.
    need = F.floor((F.col("size") * percent + 99) / 100).cast("int")
    spare = F.col("size") - need
    posted_ = F.least(F.col("size"), spare + F.greatest(F.lit(max_level), F.floor(spare / 3))).cast("int")
    often = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    scored = postings.join(often, "token").withColumn("level", F.greatest(F.lit(1), F.col("place") - F.col("size") + need + 1))
    meets = [F.sum(F.when(F.col("level") <= n, F.col("df") - 1).otherwise(0)).alias(f"f{n}") for n in range(1, max_level + 1)]
    cost = F.array_min(F.array(*[F.when(F.lit(n) <= need, F.struct((F.col(f"f{n}") * (1 + 2.0 * F.col("size") / n)).alias("cost"), F.lit(n).alias("scheme"))) for n in range(1, max_level + 1)]))
    schemes = scored.groupBy("rep", "size").agg(*meets, F.count(F.lit(1)).cast("int").alias("shared")).select("rep", "size", cost["scheme"].alias("scheme"), F.col("f1").alias("met"), (posted_ - F.col("shared")).alias("alone"), (F.col("size") - posted_).alias("rest"))
    chosen = table(scored.join(schemes, ["rep", "size"]).filter(F.col("alone") <= spare + 1).filter("level <= scheme").select("token", *POSTING, "met", "df"), "prefixes")
    drop(postings)

    # Texts are read for pairs only, straight from the input; one exchange of them serves
    # both ends of the pairs.
    texts = docs.filter("doc_id is not null").withColumnRenamed("doc_id", "rep")

    # First links: in each posting list with its hub (the document whose prefix meets most),
    # which a group's original tends to be, and with the neighbour by that order.
    this = F.struct(*POSTING)
    hubs = table(chosen.groupBy("token").agg(F.min(F.struct((-F.col("met")).alias("met"), "size", "rep", this.alias("o"))).alias("hub")).select("token", "hub.o"), "hubs")
    list_ = Window.partitionBy("token", F.when(F.col("df") > LIST, F.pmod(F.xxhash64("rep"), F.ceil(F.col("df") / LIST))).otherwise(0)).orderBy(F.desc("met"), "size", "rep")
    near = chosen.join(hubs, "token").select(*POSTING, "o").unionByName(chosen.select(*POSTING, F.lag(this).over(list_).alias("o"), "df", F.row_number().over(list_).alias("n")).filter(f"n > 2 or n = 2 and df > {LIST}").drop("df", "n"))
    near = near.select(*POSTING, *[F.col(f"o.{c}").alias(f"{c}2") for c in POSTING]).filter("rep2 <> rep")
    tried = table(_candidates(near, percent), "neighbours")
    links = table(_verified(tried, texts, k, percent), "links1")
    comp = components(links)

    # All other candidates: pairs of different components.
    placed = chosen.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    largest = placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("token").agg(F.max_by("comp", F.struct("n", "comp")).alias("major"), F.count(F.lit(1)).alias("comps")).filter("comps > 1").select("token", "major")
    mixed = table(placed.join(largest, "token").select("token", "comp", "major", *POSTING), "mixed")
    pairs = _sharing(table(_meeting(mixed, percent), "pairs"), mixed, percent)
    more = _verified(pairs.join(tried, ["x", "y"], "left_anti"), texts, k, percent)
    final = table(components(links.unionByName(more)), "components")  # all links have been read then
    drop(chosen, hubs, tried, links, mixed)
    return classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))
