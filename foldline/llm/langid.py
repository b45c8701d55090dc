"""Language identification with segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  A text is
its words: maximal runs of letters, in lower case, each led by the word mark.  A word's
probability in a language is the sum over all its segmentations into pieces of the product
of the pieces' probabilities, by the forward algorithm; a text's is the product over its
words.  Probabilities are fitted by expectation maximisation over all segmentations
(forward and backward) of a bounded sample of labelled rows.

The lattice of all distinct words of a chunk of texts is built at once and the recurrence
runs over word offsets, so the work for a word is paid once for each chunk; a task remembers
the sums of up to ``KNOWN`` words.  Words of up to ``SHORT`` letters are summed as they are
(each letter's share is scaled, and no such product leaves a double's range), longer ones in
logarithms, so a word of any length counts whole and tells languages apart.

Defined results: ``und`` with score 0 for null, empty and letterless texts, and for all if
there are no labelled rows.  Ties go to the language that sorts first.  Rows that repeat an id
are judged one by one.  An empty table gives an empty result.  Columns besides the text and
the named keys are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldline.llm import text as tx
from foldline.llm.shared import drop, table

U = np.uint64
MARK = 0x2581
#: Letters of a word whose sum stays within a double's range, words that a task remembers, and letters of one lattice.
SHORT, KNOWN, LETTERS = 30, 400_000, 100_000
_BASE = U(0x9E3779B97F4A7C15)
_GAIN = 2.0  # each letter's share is scaled by e**_GAIN


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pieces(path: str | None = None) -> list[str]:
    """The vocabulary's distinct pieces of letters in lower case, led by a word mark or not."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path())
    out = {}
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)):
            body = p[1:] if p[:1] == chr(MARK) else p
            if (body.isalpha() and len(body) <= 24) or p == chr(MARK):
                out[p.lower()] = None
    return list(out)


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point: itself in lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _substring_hash(cps: np.ndarray, idx: np.ndarray, m: int, before: np.ndarray | None) -> np.ndarray:
    c = tx.mix(cps[idx + m - 1].astype(U) + U(1))
    return c if before is None else before * _BASE + c


class Pieces:
    """The vocabulary as sorted hashes for each length; piece 0 stands for unknown letters."""

    def __init__(self, names: list[str]):
        self.size = len(names) + 1
        by: dict[int, list[int]] = {}
        for i, p in enumerate(names):
            by.setdefault(len(p), []).append(i)
        self.by = {}
        for m, found in by.items():
            cps = np.frombuffer("".join(names[i] for i in found).encode("utf-32-le"), np.uint32)
            first, h = np.arange(len(found)) * m, None
            for j in range(1, m + 1):
                h = _substring_hash(cps, first, j, h)
            order = np.argsort(h)
            self.by[m] = (h[order], np.array(found)[order] + 1)
        self.longest = max(self.by, default=1)

    def lookup(self, m: int, h: np.ndarray) -> np.ndarray:
        """Piece of each hash; -1 where there is none."""
        if m not in self.by:
            return np.full(len(h), -1)
        keys, ids = self.by[m]
        at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[at] == h, ids[at], -1)


class Lattice:
    """All edges (piece, start, end) of a list of words laid end to end in ``cps``."""

    def __init__(self, cps: np.ndarray, start: np.ndarray, vocab: Pieces):
        n = len(cps)
        self.start, self.end = start, np.append(start[1:], n)
        word = np.zeros(n, np.int64)
        word[start[1:]] = 1
        self.word = np.cumsum(word)
        stop = self.end[self.word]
        idx, h, parts = np.arange(n), None, []
        for m in range(1, vocab.longest + 1):
            fits = idx + m <= stop[idx]
            idx, h = idx[fits], (None if h is None else h[fits])
            if not len(idx):
                break
            h = _substring_hash(cps, idx, m, h)
            p = vocab.lookup(m, h)
            if m == 1:
                p = np.maximum(p, 0)
            ok = p >= 0
            parts.append((idx[ok], np.full(ok.sum(), m), p[ok]))
        self.a = np.concatenate([x[0] for x in parts])
        self.m = np.concatenate([x[1] for x in parts])
        self.p = np.concatenate([x[2] for x in parts])
        self.b = self.a + self.m  # the node after the edge; a word's nodes are shifted by its number
        first = self.start[self.word[self.a]]
        self.node_a, self.node_b = self.a + self.word[self.a], self.b + self.word[self.a]
        self.off_a, self.off_b = self.a - first, self.b - first
        self.first, self.last = start + np.arange(len(start)), self.end + np.arange(len(start))
        self.nodes = n + len(start)

    def _log_sweep(self, value: np.ndarray, into: np.ndarray, out_of: np.ndarray, off: np.ndarray, log_weight: np.ndarray, steps) -> None:
        order = np.lexsort((into, off))
        bound = np.searchsorted(off[order], np.arange(off.max() + 2))
        for t in steps(int(off.max())):
            e = order[bound[t] : bound[t + 1]]
            if len(e):
                node = into[e]
                new = np.append(True, node[1:] != node[:-1])
                at = np.flatnonzero(new)
                x = value[out_of[e]] + log_weight[e]
                most = np.maximum.reduceat(x, at, axis=0)
                value[node[at]] = most + np.log(np.add.reduceat(np.exp(x - most[np.cumsum(new) - 1]), at, axis=0))

    def log_forward(self, log_weight: np.ndarray) -> np.ndarray:
        v = np.full((self.nodes, log_weight.shape[1]), -np.inf)
        v[self.first] = 0
        self._log_sweep(v, self.node_b, self.node_a, self.off_b, log_weight, lambda top: range(1, top + 1))
        return v

    def log_backward(self, log_weight: np.ndarray) -> np.ndarray:
        v = np.full((self.nodes, log_weight.shape[1]), -np.inf)
        v[self.last] = 0
        self._log_sweep(v, self.node_a, self.node_b, self.off_a, log_weight, lambda top: range(top, -1, -1))
        return v

    def _sweep(self, value: np.ndarray, into: np.ndarray, out_of: np.ndarray, off: np.ndarray, weight: np.ndarray, steps) -> None:
        order = np.lexsort((into, off))
        bound = np.searchsorted(off[order], np.arange(off.max() + 2))
        for t in steps(int(off.max())):
            e = order[bound[t] : bound[t + 1]]
            if len(e):
                node = into[e]
                at = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
                value[node[at]] += np.add.reduceat(value[out_of[e]] * weight[e], at, axis=0)

    def forward(self, weight: np.ndarray) -> np.ndarray:
        v = np.zeros((self.nodes, weight.shape[1]))
        v[self.first] = 1
        self._sweep(v, self.node_b, self.node_a, self.off_b, weight, lambda top: range(1, top + 1))
        return v

    def backward(self, weight: np.ndarray) -> np.ndarray:
        v = np.zeros((self.nodes, weight.shape[1]))
        v[self.last] = 1
        self._sweep(v, self.node_a, self.node_b, self.off_a, weight, lambda top: range(top, -1, -1))
        return v

    def weights(self, prob: np.ndarray) -> np.ndarray:
        return prob[self.p] * np.exp(_GAIN * self.m)[:, None]

    def log_weights(self, prob: np.ndarray) -> np.ndarray:
        return np.log(prob)[self.p]

    def log_sums(self, prob: np.ndarray, short: bool) -> np.ndarray:
        """The logarithm of each word's probability."""
        if short:
            return np.log(self.forward(self.weights(prob))[self.last]) - _GAIN * (self.end - self.start)[:, None]
        return self.log_forward(self.log_weights(prob))[self.last]


def _words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row and number (among the distinct words) of each word; the distinct words' code
    points, marks included, where each begins, and their hashes."""
    data, _ = tx.string_buffers(col)
    cps = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    lengths = pc.utf8_length(col.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64)
    off = np.append(0, np.cumsum(lengths))
    low = _letters()[cps]
    inside = low > 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = off[(off > 0) & (off < len(cps))]
    first[edge] = inside[edge]
    start = np.flatnonzero(first)
    stop = np.flatnonzero(np.append(~inside, True))
    end = stop[np.searchsorted(stop, start)] if len(start) else start
    if len(start):
        end = np.minimum(end, np.append(start[1:], len(cps)))
    row = np.searchsorted(off, start, side="right") - 1
    total = np.zeros(len(cps) + 1, U)
    np.cumsum(tx.mix(low.astype(U)) * tx.powers(tx._MULT_INV, len(cps)), out=total[1:])
    h = tx.mix((total[end] - total[start]) * tx.powers(tx._MULT, len(cps) + 1)[end]) if len(start) else total[:0]
    hashes, where, number = np.unique(h, return_index=True, return_inverse=True)
    s, size = start[where], (end - start)[where] + 1
    begin = np.append(0, np.cumsum(size))
    out = np.full(begin[-1], MARK, np.uint32)
    inner = np.ones(len(out), bool)
    inner[begin[:-1]] = False
    pick = np.repeat(s - begin[:-1] - 1, size) + np.arange(len(out))
    out[inner] = low[pick[inner]]
    return row, number, out, begin[:-1], hashes


def _groups(cps: np.ndarray, start: np.ndarray, wanted: np.ndarray | None = None, most: int = LETTERS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """The wanted words in groups of about ``most`` letters (one word at least): their code
    points, where each begins, their numbers, and whether they are short."""
    size = np.diff(np.append(start, len(cps)))
    for short in (True, False):
        of_kind = np.flatnonzero((size <= SHORT + 1) == short)
        if wanted is not None:
            of_kind = of_kind[wanted[of_kind]]
        total, i = np.cumsum(size[of_kind]), 0
        while i < len(of_kind):
            j = max(i + 1, int(np.searchsorted(total, total[i] + most)))
            part = of_kind[i:j]
            begin = np.append(0, np.cumsum(size[part]))
            yield cps[np.repeat(start[part] - begin[:-1], size[part]) + np.arange(begin[-1])], begin[:-1], part, short
            i = j


def _expect(names: list[str], langs: list[str], prob: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, total = Pieces(names), np.zeros(prob.shape)
        for b in tx.chunked(batches, "text", tx.LEAN_BYTES):
            row, number, cps, start, _ = _words(b.column("text"))
            if not len(row):
                continue
            lang = np.array([langs.index(x) for x in b.column("lang").to_pylist()])
            count = np.zeros((len(start), len(langs)))
            np.add.at(count, (number, lang[row]), 1)
            for c, s, part, short in _groups(cps, start):
                lat = Lattice(c, s, vocab)
                times = count[part][lat.word[lat.a]]
                if short:
                    w = lat.weights(prob)
                    f, back = lat.forward(w), lat.backward(w)
                    share = f[lat.node_a] * w * back[lat.node_b] / f[lat.last][lat.word[lat.a]] * times
                else:
                    w = lat.log_weights(prob)
                    f, back = lat.log_forward(w), lat.log_backward(w)
                    share = np.exp(f[lat.node_a] + w + back[lat.node_b] - f[lat.last][lat.word[lat.a]]) * times
                for j in range(len(langs)):
                    total[:, j] += np.bincount(lat.p, weights=share[:, j], minlength=vocab.size)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    return tx.tidy(run)


def fit(rows: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = 400, rounds: int = 3, vocabulary: str | None = None) -> dict:
    """A model from labelled rows: ``per_language`` ids of each language at most (those of
    least hash), one whole text of each (of different texts that of least hash).  Only sums of
    vocabulary size reach the driver.  Ids of a hash beyond some four times that many are left
    out before any are ordered, so what one task orders does not grow with the rows."""
    spark = rows.sparkSession
    names = pieces(vocabulary)
    r = rows.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang is not null and text is not null")
    ids = table(r.select("id", "lang", F.xxhash64("id").alias("h")).groupBy("id", "lang", "h").agg(F.count(F.lit(1)).alias("rows")), "ids")
    share = ids.groupBy("lang").agg((F.lit(4.0 * per_language) / F.count(F.lit(1))).alias("share"))
    below = F.when(F.col("share") >= 1, F.lit(2**63 - 1)).otherwise((F.col("share") * 2.0**64 - 2.0**63).cast("long"))
    near = ids.join(share, "lang").filter(F.col("h") <= below)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "id"))
    pick = table(near.withColumn("n", place).filter(F.col("n") <= per_language).select("id", "lang"), "sample-ids")
    drop(ids)
    if pick.count() <= 200_000:
        pick = F.broadcast(pick)
    chosen = r.join(pick, ["id", "lang"], "left_semi").groupBy("id", "lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    sample = table(chosen.select("lang", "text").repartition(16), "sample")
    langs = sorted(x[0] for x in sample.select("lang").distinct().collect())
    prob = np.full((len(names) + 1, len(langs)), 1.0 / (len(names) + 1))
    for _ in range(rounds if langs else 0):
        total = sum((np.frombuffer(x[0]) for x in sample.mapInArrow(_expect(names, langs, prob), "counts binary").toLocalIterator()), np.zeros(prob.size)).reshape(prob.shape) + 0.05
        prob = total / total.sum(axis=0)
    return {"pieces": names, "langs": langs, "prob": prob.astype(np.float32)}


class Classifier:
    """A model's vocabulary, and the words that it has met with the logarithm of their
    probability in each language."""

    def __init__(self, model: dict):
        self.vocab, self.prob = Pieces(model["pieces"]), model["prob"].astype(np.float64)
        self.forget()

    def forget(self) -> None:
        self.known, self.logs = np.zeros(0, U), np.zeros((0, self.prob.shape[1]))

    def words(self, cps: np.ndarray, start: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The logarithms of distinct words (hashes in ascending order)."""
        log = np.empty((len(hashes), self.prob.shape[1]))
        at = np.searchsorted(self.known, hashes)
        old = at < len(self.known)
        old[old] = self.known[at[old]] == hashes[old]
        log[old] = self.logs[at[old]]
        for c, s, part, short in _groups(cps, start, ~old):
            log[part] = Lattice(c, s, self.vocab).log_sums(self.prob, short)
        new = ~old
        if len(self.known) + new.sum() > KNOWN:
            self.forget()
            at, new = np.zeros_like(at), np.ones_like(new)
        if new.sum() <= KNOWN:
            self.known, self.logs = np.insert(self.known, at[new], hashes[new]), np.insert(self.logs, at[new], log[new], axis=0)
        return log

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text the number of its language (that of ``und`` is the last) and the score."""
        n, langs = len(col), self.prob.shape[1]
        row, number, cps, start, hashes = _words(col)
        best, score = np.full(n, langs), np.zeros(n)
        if len(row) and langs:
            log = self.words(cps, start, hashes)
            total = np.stack([np.bincount(row, weights=log[number, j], minlength=n) for j in range(langs)], axis=1)
            some = np.bincount(row, minlength=n) > 0
            share = np.exp(total - total.max(axis=1, keepdims=True))
            best = np.where(some, total.argmax(axis=1), best)
            score = np.where(some, share.max(axis=1) / share.sum(axis=1), 0.0)
        return best, score


def _predict(model: dict):
    langs = pa.array([*model["langs"], "und"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(model)
        for b in tx.chunked(batches, "text", tx.LEAN_BYTES):
            best, score = classify(b.column("text"))
            keep = [b.column(i) for i, f in enumerate(b.schema) if f.name != "text"]
            yield pa.RecordBatch.from_arrays([*keep, langs.take(pa.array(best)), pa.array(score)], names=[*(f.name for f in b.schema if f.name != "text"), "lang_pred", "score"])

    return tx.tidy(run)


def _identified(model: dict, text_col: str, lang_col: str, least: float):
    langs = pa.array([*model["langs"], "und"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classify = Classifier(model)
        for b in tx.chunked(batches, text_col, tx.LEAN_BYTES):
            best, score = classify(b.column(b.schema.get_field_index(text_col)))
            at = b.schema.get_field_index(lang_col)
            b = b.set_column(at, b.schema.field(at), langs.take(pa.array(best)).cast(b.schema.field(at).type))
            yield b.filter(pa.array((best < len(langs) - 1) & (score >= least)))

    return tx.tidy(run)


def keep_identified(documents: DataFrame, model: dict, least: float = 0.5, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows with a language of score ``least`` or more, all columns; lang is the one found.
    Rejected are texts without a letter, and those of which no language has a posterior of
    ``least`` (by default more likely than all the others together)."""
    return documents.mapInArrow(_identified(model, text_col, lang_col, least), documents.schema)


def predict(documents: DataFrame, model: dict, keys: list[str], text_col: str = "text") -> DataFrame:
    """The ``keys`` columns, lang_pred and score (its posterior at equal priors) of every row."""
    docs = documents.select(*keys, F.col(text_col).cast("string").alias("text")).withColumn("text", F.coalesce("text", F.lit("")))
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(_predict(model), f"{shape}, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    """Rows that nothing is learned from: crc32 of the id as text is 2 modulo 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
