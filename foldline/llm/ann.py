"""Nearest neighbours by cosine with randomly rotated one-bit codes.

Every vector is scaled to unit length, embedded by a random orthonormal map (fixed seed)
into ``bits`` dimensions, and kept as its signs, packed, with one correction scalar: the
inner product f of the embedded vector with its signs vector.  For a query, the inner
product with the signs comes from popcounts between the packed code and the bit planes of
the query's quantised coordinates; divided by f it estimates the cosine, with an error
below epsilon * sqrt((1 - f^2) / f^2 / (bits - 1)) with high probability.  Vectors whose
upper bound reaches the k-th best exact cosine found so far are reranked in double
precision on the original components.

All queries meet all vectors, in blocks: vectors are dealt to blocks by hash of id, queries
likewise, and each pair of a vector block and a query block is one bounded group.  A block
returns k rows for each of its queries.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
take no part, neither do rows without an id.  Only vectors of equal dimension meet.  A row
never finds rows of its own id.  Rows that repeat an id are one neighbour and one query: equal
rows count once (before vectors are dealt to blocks, so a hot id is one row), and of different
vectors of one id the nearest counts.  Equal cosines are ordered by smaller id.  An empty
table gives an empty result.  Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PLANES = 6


def embedding(dim: int, bits: int, seed: int) -> np.ndarray:
    """A (bits', dim) matrix of orthonormal columns; bits' is a multiple of 64, dim at least."""
    size = -(-max(bits, dim) // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, dim)))
    return q * np.sign(np.diag(r))


def encode(x: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed signs (uint64 words) and the correction scalar of each unit vector."""
    y = x @ basis.T
    code = np.packbits(y > 0, axis=1, bitorder="little").view(np.uint64)
    return code, np.abs(y).sum(axis=1) / np.sqrt(y.shape[1])


class Planes:
    """Queries' quantised coordinates as bit planes."""

    def __init__(self, q: np.ndarray, basis: np.ndarray):
        y = q @ basis.T
        self.size = y.shape[1]
        self.low = y.min(axis=1)
        self.step = np.maximum((y.max(axis=1) - self.low) / ((1 << PLANES) - 1), 1e-12)
        u = np.rint((y - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.bits = np.stack([np.packbits(u >> j & 1, axis=1, bitorder="little").view(np.uint64) for j in range(PLANES)])
        self.total = self.low * self.size + self.step * u.sum(axis=1, dtype=np.int64)

    def estimate(self, i: int, code: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Inner products of query i with the signs vectors."""
        got = np.zeros(len(code), np.int64)
        for j in range(PLANES):
            plane = self.bits[j, i]
            part = np.bitwise_count(code[:, 0] & plane[0]).astype(np.int64)
            for w in range(1, code.shape[1]):
                part += np.bitwise_count(code[:, w] & plane[w])
            got += part << j
        return (2 * (self.step[i] * got + self.low[i] * ones) - self.total[i]) / np.sqrt(self.size)


def _floats(col: pa.Array, n: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _index(bits: int, seed: int):
    def run(batches):
        bases: dict[int, np.ndarray] = {}
        for b in batches:
            dims = b.column("dim").to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                x = _floats(part.column("vector"), part.num_rows)
                x /= np.sqrt(np.square(x).sum(axis=1))[:, None]
                basis = bases.setdefault(int(d), embedding(int(d), bits, seed))
                code, f = encode(x, basis)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("vec_id", "dim", "vector")), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(f)], names=["vec_id", "dim", "vector", "code", "f"])

    return run


def _best(ids: np.ndarray, score: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n ids of best score, each once with its best."""
    order = np.lexsort((ids, -score))
    _, first = np.unique(ids[order], return_index=True)
    order = order[np.sort(first)[:n]]
    return ids[order], score[order]


SHAPE = "query_id long, vec_id long, score double"


def _block(bits: int, seed: int, k: int, epsilon: float):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if vectors.num_rows and queries.num_rows:
            ids = vectors.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            vectors, ids = vectors.take(pa.array(order)), ids[order]
            x, q = _floats(vectors.column("vector"), vectors.num_rows), _floats(queries.column("q_vector"), queries.num_rows)
            code = np.frombuffer(b"".join(vectors.column("code").to_pylist()), np.uint64).reshape(len(ids), -1)
            f = vectors.column("f").to_numpy()
            norm, qnorm = np.sqrt(np.square(x).sum(axis=1)), np.sqrt(np.square(q).sum(axis=1))
            planes = Planes(q / qnorm[:, None], embedding(x.shape[1], bits, seed))
            ones = np.bitwise_count(code).sum(axis=1).astype(np.int64)
            error = epsilon * np.sqrt(np.maximum(1 - f * f, 0) / (f * f) / (planes.size - 1))
            new = np.append(True, ids[1:] != ids[:-1])  # equal ids stand together
            of_query: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for i, qid in enumerate(queries.column("q_vec_id").to_pylist()):
                est = planes.estimate(i, code, ones) / f
                upper = est + error + 3 * planes.step[i] / np.sqrt(12) / f
                other = ids != qid
                upper[~other] = -np.inf
                n = min(k, int((new & other).sum()))
                if not n:
                    continue
                lead = min(len(ids), max(8 * k, 64))
                first = np.argpartition(-upper, lead - 1)[:lead]
                first = first[other[first]]
                top = _best(ids[first], (x[first] * q[i]).sum(axis=1) / (norm[first] * qnorm[i]), n)[1]
                pick = np.flatnonzero((upper >= (top[-1] if len(top) == n else -np.inf) - 1e-12) & other)
                of_query.setdefault(qid, []).append(_best(ids[pick], (x[pick] * q[i]).sum(axis=1) / (norm[pick] * qnorm[i]), n))
            for qid, found in of_query.items():
                v, score = found[0] if len(found) == 1 else _best(*map(np.concatenate, zip(*found, strict=True)), k)
                out_q += [qid] * len(v)
                out_v += v.tolist()
                out_s += score.tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    return run


def nearest(vectors: DataFrame, is_query, k: int = 5, bits: int = 256, seed: int = 11, epsilon: float = 3.0, vector_block: int = 16384, query_block: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query row's k nearest found.
    is_query: a condition on the column vec_id."""
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("vector"))
    usable = F.expr("vec_id is not null and vector is not null and size(vector) > 0 and forall(vector, v -> v is not null and not isnan(v) and abs(double(v)) < double('infinity')) and exists(vector, v -> v <> 0)")
    rows = rows.filter(usable).distinct().withColumn("dim", F.size("vector"))
    index = rows.mapInArrow(_index(bits, seed), f"vec_id long, dim int, vector {kind}, code binary, f double")
    size = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_query).alias("q"))
    size = size.select("dim", F.ceil(F.col("n") / vector_block).cast("int").alias("nv"), F.greatest(F.lit(1), F.ceil(F.col("q") / query_block)).cast("int").alias("nq"))
    index = index.join(size, "dim")
    left = index.withColumn("v", F.pmod(F.xxhash64("vec_id"), "nv").cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("nq") - 1)))
    right = index.filter(is_query).withColumn("q", F.pmod(F.xxhash64("vec_id", F.lit(1)), "nq").cast("int")).withColumn("v", F.explode(F.sequence(F.lit(0), F.col("nv") - 1)))
    right = right.select(*[F.col(c).alias(f"q_{c}") for c in ("dim", "v", "q", "vec_id", "vector")])
    found = left.select("dim", "v", "q", "vec_id", "vector", "code", "f").groupBy("dim", "v", "q").cogroup(right.groupBy("q_dim", "q_v", "q_q")).applyInArrow(_block(bits, seed, k, epsilon), SHAPE)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
