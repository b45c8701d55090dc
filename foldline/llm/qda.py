"""Quality scores by regularised quadratic discriminant analysis.

A document's statistics (lengths, shares of kinds of characters, repetition) are
transformed by logarithms and logits, then standardised.  Each class has a mean and a
covariance shrunk twice: towards the pooled one by d / (d + n), then towards a multiple of
the identity by ``ridge``.  The score is the logistic function of the difference of the
classes' log densities (half Mahalanobis distances and log determinants, from Cholesky
factors computed once) plus that of the log priors.

All labelled rows are used.  Only sums of d * d values for each class reach the driver.

Defined results: null and empty texts have statistics of zero counts and are scored like
any other.  Labels other than 0 and 1 (nulls too) teach nothing; a document labelled twice
counts twice.  Without a row of either class every score is (n1 + 1) / (n0 + n1 + 2).  Rows
that repeat an id are scored one by one; an empty table gives an empty result.  Columns
besides the text, the label and the named keys are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm import text as tx

U = np.uint64
NAMES = ("words", "word length", "length spread", "distinct words", "distinct triples", "top word", "same as before", "upper case", "symbols", "digits", "stops", "exclamations", "line ends", "beyond ASCII", "short words", "distinct lines")
#: Shares of ordinary prose, in the order of NAMES from the fourth on.  Each text's shares are
#: (and its words' lengths, 5 with a mean square of 35) are taken together with WEIGHT of these, so a short text is ordinary unless what
#: it has says otherwise.
USUAL = (0.8, 0.98, 0.05, 0.002, 0.03, 0.002, 0.002, 0.03, 0.001, 0.005, 0.02, 0.4, 0.97)
WEIGHT = 8.0
_KIND = np.zeros(256, np.uint8)
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 4
_KIND[ord("!")] = 5
_KIND[[ord(c) for c in "#$%&*@^~|<>{}[]\\_=+/`"]] = 6
_KIND[10] = 7
_KIND[128:] = 8


def _per_row(flag: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flag))
    return (total[ptr[1:]] - total[ptr[:-1]]).astype(float)


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and the count of the most frequent one, of each row."""
    order = np.lexsort((h, row))
    r, s = row[order], h[order]
    at = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (s[1:] != s[:-1]))) if len(r) else np.zeros(0, int)
    size, top = np.diff(np.append(at, len(r))), np.zeros(n)
    np.maximum.at(top, r[at], size)
    return np.bincount(r[at], minlength=n).astype(float), top


def statistics(col: pa.Array) -> np.ndarray:
    """One transformed row of numbers for each text."""
    words = tx.Words(col)
    n, row, h = len(words.ptr) - 1, words.row_of(), words.hash
    count = np.diff(words.ptr).astype(float)
    length = (words.end - words.start).astype(float)
    mean = (np.bincount(row, weights=length, minlength=n) + WEIGHT * 5) / (count + WEIGHT)
    square = (np.bincount(row, weights=length * length, minlength=n) + WEIGHT * 35) / (count + WEIGHT)
    distinct, top = _distinct(row, h, n)
    g = tx.grams(h, 3)
    whole = row[: len(g)] == row[2:] if len(g) else np.zeros(0, bool)
    triples = np.bincount(row[: len(g)][whole], minlength=n).astype(float)
    distinct3, _ = _distinct(row[: len(g)][whole], g[whole], n)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    kind = _KIND[words.data]
    size = np.diff(words.offsets).astype(float)
    shares = {k: _per_row(kind == k, words.offsets) for k in range(1, 9)}
    letters = shares[1] + shares[2]
    line = np.zeros(len(h), np.int64)  # the line each word is on
    newline = np.append(0, np.cumsum(words.data == 10))
    line = newline[words.start]
    first = np.append(True, (line[1:] != line[:-1]) | (row[1:] != row[:-1])) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    place = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))  # in its line
    total = np.append(U(0), np.cumsum(tx.mix(h + U(1)) * tx.powers(tx._GRAM, len(h) + 1)[place], dtype=U))
    lines = tx.mix(total[np.append(at[1:], len(h))] - total[at]) if len(h) else h
    dl, _ = _distinct(row[at], lines, n)

    def logit(part, whole, usual):
        p = (part + WEIGHT * usual) / (whole + WEIGHT)
        return np.log(p / (1 - p))

    seen = [
        (distinct, count), (distinct3, triples), (top, count), (_per_row(same, words.ptr), count), (shares[2], letters), (shares[6], size), (shares[3], size), (shares[4], size), (shares[5], size), (shares[7], size), (shares[8], size),
        (_per_row(length <= 3, words.ptr), count), (dl, np.bincount(row[at], minlength=n).astype(float)),
    ]
    return np.column_stack([np.log(count + 4 * WEIGHT), np.log1p(mean), np.log1p(np.sqrt(np.maximum(square - mean**2, 0))), *(logit(x, y, u) for (x, y), u in zip(seen, USUAL, strict=True))])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in tx.chunked(batches, "text"):
        x = statistics(b.column("text"))
        keep = [i for i, f in enumerate(b.schema) if f.name != "text"]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), tx.lists(x.ravel(), np.full(len(x), x.shape[1]), pa.float64())], names=[*(b.schema[i].name for i in keep), "x"])


def with_statistics(documents: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The ``keys`` columns and x, the transformed statistics, of every row."""
    docs = documents.select(*keys, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    return docs.mapInArrow(_statistics, f"{shape}x array<double>")


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    d = len(NAMES) + 1
    total = np.zeros((2, d, d))
    for b in batches:
        if b.num_rows:
            x = np.column_stack([np.ones(b.num_rows), _matrix(b)])
            y = b.column("label").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
    c, i, j = np.indices(total.shape)
    yield pa.RecordBatch.from_arrays([pa.array(v.ravel().astype(np.int32)) for v in (c, i, j)] + [pa.array(total.ravel())], names=["c", "i", "j", "v"])


def fit(rows: DataFrame, ridge: float = 0.02) -> dict:
    """A model from x and label (0 or 1)."""
    d = len(NAMES)
    m = np.zeros((2, d + 1, d + 1))
    for c, i, j, v in rows.select("x", F.col("label").cast("int").alias("label")).filter("label in (0, 1)").mapInArrow(_moments, "c int, i int, j int, v double").groupBy("c", "i", "j").agg(F.sum("v")).collect():
        m[c, i, j] = v
    n = m[:, 0, 0]
    if not n.all():
        return {"constant": float((n[1] + 1) / (n.sum() + 2))}
    both = m.sum(axis=0)
    center = both[0, 1:] / n.sum()
    scale = np.sqrt(np.maximum(np.diag(both)[1:] / n.sum() - center**2, 0)) + 1e-6
    mean = m[:, 0, 1:] / n[:, None]
    cov = np.stack([(m[c, 1:, 1:] / n[c] - np.outer(mean[c], mean[c])) / np.outer(scale, scale) for c in (0, 1)])
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    model = {"center": center, "scale": scale, "mean": (mean - center) / scale, "factor": [], "constant_term": np.log(n / n.sum())}
    for c in (0, 1):
        a = d / (d + n[c])
        s = (1 - a) * cov[c] + a * pooled
        s = (1 - ridge) * s + ridge * max(np.trace(s) / d, 1e-6) * np.eye(d)
        low = np.linalg.cholesky(s)
        model["factor"].append(np.linalg.inv(low).T)
        model["constant_term"][c] -= np.log(np.diag(low)).sum()
    return model


def scores(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    z = (x - model["center"]) / model["scale"]
    log = [model["constant_term"][c] - 0.5 * np.square((z - model["mean"][c]) @ model["factor"][c]).sum(axis=1) for c in (0, 1)]
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def _score(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [i for i, f in enumerate(b.schema) if f.name != "x"]
            s = scores(model, _matrix(b)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(s)], names=[*(b.schema[i].name for i in keep), "score"])

    return run


def predict(stats: DataFrame, model: dict) -> DataFrame:
    """The rows of with_statistics() with score in place of x."""
    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in stats.schema if f.name != "x")
    return stats.mapInArrow(_score(model), f"{shape}score double")
