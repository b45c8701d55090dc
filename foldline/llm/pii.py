"""Personal data: base patterns, and more spans by a skip-chain conditional random field.

The field's nodes are a document's words that hold a digit or an ``@``; all others are
outside any entity.  A word that a base match covers is observed with that label.  The
others have a unary potential by shape (number of digits, signs), learned from how often
words of that shape are covered, never above that of the label "outside" (shape alone
adds nothing) and never below RARE (decisions do not depend on the number of documents).  Words that stand side by side share a chain potential, learned from the
labels of neighbours.  Distant words that are equal, or end in the same seven digits (alone or with
the group beside them), or have the same local part before an ``@``, share a skip potential that favours equal labels.
Each is linked with every such observed word: those are fixed, so their links are summed
into its unary potential by counts for each key.  Unobserved ones are linked with the next
unobserved one.  Work and links are linear in words.  Loopy sum-product
message passing, damped, with a fixed number of rounds, gives each word's marginals; a word
whose entity label has ``accept`` or more is added, and added neighbours of one label are
one span.

Labels follow evidence only: a word that no path of chain and skip potentials connects with
an observed word is outside.  So a document without a base match has no entity, and no
messages are sent there.

Defined results: null and empty texts have no spans.  Offsets are code points, ends
exclusive.  Added spans never overlap base ones.  Rows that repeat an id are judged one by
one; an empty table gives an empty result.  Columns besides the text and the named keys are
not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldline.llm import text as tx

# The kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_MARK = re.compile("[0-9@]")
_WHITE = re.compile(r"[\x20\x09-\x0D]")
_NOT_DIGIT = re.compile("[^0-9]")
_EDGE = " .,;:!?()[]<>{}\"'"
LABELS = len(KINDS) + 1  # the last one is "outside"
#: The unary potential of a shape that was never covered, however often it was seen.
RARE = -2.0


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in _LOCAL:
            left -= 1
        m = EMAIL.match(text, left) if left < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every base match, ordered."""
    out = [(a, 0, b) for a, b in _emails(text)]
    first = _MARK.search(text)
    if first:
        p = max(0, first.start() - 1)
        for m in IP.finditer(text, p):
            if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text, p):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def words(text: str) -> list[tuple[int, int]]:
    """The words that hold a digit or an @."""
    out, at = [], 0
    while m := _MARK.search(text, at):
        a = m.start()
        while a > at and not _WHITE.match(text, a - 1):
            a -= 1
        end = _WHITE.search(text, m.end())
        at = end.start() if end else len(text)
        out.append((a, at))
    return out


def shape(word: str) -> str:
    """A shape out of a bounded set."""
    n = len(_NOT_DIGIT.sub("", word))
    return f"{min(n, 20)}{'@' if '@' in word else ''}{'+' if '+' in word else ''}{'.' if '.' in word.strip(_EDGE) else ''}{'-' if '-' in word else ''}{'a' if any(c.isalpha() for c in word) else ''}"


def observed(ws: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> np.ndarray:
    """The label of each word that a base match touches, -1 for the others."""
    out, j, reach = np.full(len(ws), -1), 0, []
    for i, (a, b) in enumerate(ws):
        while j < len(base) and base[j][0] < b:
            reach.append(base[j])
            j += 1
        reach = [s for s in reach if s[2] > a]
        if reach:
            out[i] = reach[0][1]
    return out


def _beside(text: str, ws: list[tuple[int, int]]) -> np.ndarray:
    """Words whose next word is the next candidate."""
    return np.array([i for i in range(len(ws) - 1) if ws[i + 1][0] - ws[i][1] <= 2], np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for b in batches:
        for text in b.column("text").to_pylist():
            if text and (ws := words(text)):
                label = observed(ws, base_spans(text))
                label[label < 0] = LABELS - 1
                for (a, c), y in zip(ws, label.tolist(), strict=True):
                    total["s" + shape(text[a:c]), y] += 1
                for i in _beside(text, ws).tolist():
                    total[f"t{label[i]}", int(label[i + 1])] += 1
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in total], pa.string()), pa.array([y for _, y in total], pa.int32()), pa.array(list(total.values()), pa.int64())], names=["what", "label", "n"])


def fit(documents: DataFrame, text_col: str = "text", skip: float = 5.0, accept: float = 0.8, rounds: int = 12) -> dict:
    """Potentials from base matches in all documents.  Shapes are a bounded set; only their
    counts reach the driver."""
    docs = documents.select(F.col(text_col).cast("string").alias("text"))
    got = docs.mapInArrow(_counts, "what string, label int, n long").groupBy("what", "label").agg(F.sum("n").alias("n")).collect()
    unary: dict[str, np.ndarray] = {}
    chain = np.ones((LABELS, LABELS)) + np.eye(LABELS)
    for what, y, n in got:
        if what[0] == "s":
            unary.setdefault(what[1:], np.full(LABELS, 0.5))[y] += n
        else:
            chain[int(what[1:]), y] += n
    logs = {}
    for s, n in unary.items():
        u = np.log(n / n.sum())
        logs[s] = np.clip(u - u[-1], RARE, -1.0)
        logs[s][-1] = 0.0
    pair = np.log(chain / np.sqrt(np.outer(chain.sum(axis=1), chain.sum(axis=0))))
    return {"unary": logs, "chain": np.clip(pair - pair.mean(), -3, 3), "skip": skip * np.eye(LABELS), "accept": accept, "rounds": rounds}


def _keys(text: str, ws: list[tuple[int, int]]) -> list[list[tuple]]:
    """What each word links by.  Short groups of digits count only together with the group
    beside them, and then both link: with a whole word each, with two groups in their order."""
    out: list[list[tuple]] = [[] for _ in ws]
    before, stop = "", -9
    for i, (a, b) in enumerate(ws):
        word = text[a:b].strip(_EDGE).lower()
        digits = _NOT_DIGIT.sub("", word)
        if len(word) >= (6 if digits == word else 4):
            out[i].append(("w", word))
        if len(digits) >= 7:
            out[i] += [("d", digits[-7:]), ("e", digits[-7:])]
        elif digits and a - stop <= 2 and len(before) + len(digits) >= 7:
            whole = (before + digits)[-7:]
            out[i].append(("d", whole))
            out[i - 1].append(("e", whole))
        if "@" in word and len(word.split("@")[0]) >= 3:
            out[i].append(("l", word.split("@")[0]))
        before, stop = digits, b
    return [list(dict.fromkeys(k)) for k in out]


def _subsets(keys: list[tuple]) -> list[tuple[tuple, int]]:
    """Each non-empty subset with its sign for inclusion and exclusion."""
    return [(tuple(sorted(c)), 1 if n % 2 else -1) for n in range(1, len(keys) + 1) for c in combinations(keys, n)]


def _seen_links(keys: list[list[tuple]], label: np.ndarray) -> np.ndarray:
    """How many observed words of each label share a key with each unobserved word, each
    pair once; linear in words."""
    total: dict[tuple, np.ndarray] = {}
    for k, y in zip(keys, label.tolist(), strict=True):
        if y >= 0:
            for s, _ in _subsets(k):
                total.setdefault(s, np.zeros(LABELS))[y] += 1
    out = np.zeros((len(keys), LABELS))
    for i in np.flatnonzero(label < 0).tolist():
        if any((k,) in total for k in keys[i]):
            for s, sign in _subsets(keys[i]):
                if s in total:
                    out[i] += sign * total[s]
    return out


def _links(keys: list[list[tuple]], label: np.ndarray) -> list[tuple[int, int]]:
    """Each unobserved word with the last unobserved one before it of an equal key."""
    last: dict[tuple, int] = {}
    out = set()
    for i in np.flatnonzero(label < 0).tolist():
        for k in keys[i]:
            if k in last:
                out.add((last[k], i))
            last[k] = i
    return sorted(out)


def marginals(unary: np.ndarray, edges: np.ndarray, potential: np.ndarray, rounds: int) -> np.ndarray:
    """Damped loopy sum-product: unary (n, L) logs, edges (e, 2), potential (e, L, L) logs."""
    n, k = unary.shape
    if not len(edges):
        b = unary
    else:
        a, c = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pot = np.exp(np.concatenate([potential, potential.transpose(0, 2, 1)]))
        half, msg = len(edges), np.zeros((2 * len(edges), k))
        back = np.concatenate([np.arange(half) + half, np.arange(half)])
        for _ in range(rounds):
            into = np.stack([np.bincount(c, weights=msg[:, j], minlength=n) for j in range(k)], axis=1)
            m = (unary + into)[a] - msg[back]
            m = np.exp(m - m.max(axis=1, keepdims=True))
            new = np.log(np.maximum(np.einsum("ei,eij->ej", m, pot), 1e-30))
            msg = 0.5 * msg + 0.5 * (new - new.max(axis=1, keepdims=True))
        b = unary + np.stack([np.bincount(c, weights=msg[:, j], minlength=n) for j in range(k)], axis=1)
    b = np.exp(b - b.max(axis=1, keepdims=True))
    return b / b.sum(axis=1, keepdims=True)


def _reached(n: int, edges: list[tuple[int, int]], begin: np.ndarray) -> np.ndarray:
    """The words that edges connect with those to begin at."""
    beside: list[list[int]] = [[] for _ in range(n)]
    for a, b in edges:
        beside[a].append(b)
        beside[b].append(a)
    out, stack = begin.copy(), np.flatnonzero(begin).tolist()
    while stack:
        for i in beside[stack.pop()]:
            if not out[i]:
                out[i] = True
                stack.append(i)
    return out


def added_spans(text: str, base: list[tuple[int, int, int]], model: dict) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the spans that the field adds to the base ones."""
    if not base:
        return []
    ws = words(text)
    label = observed(ws, base)
    if (label >= 0).all():
        return []
    rare = np.array([RARE] * (LABELS - 1) + [0.0])
    unary = np.stack([model["unary"].get(shape(text[a:b]), rare) for a, b in ws])
    seen = np.flatnonzero(label >= 0)
    unary[seen] = -20.0
    unary[seen, label[seen]] = 0.0
    keys = _keys(text, ws)
    linked = _seen_links(keys, label)
    unary = unary + linked @ model["skip"]
    beside, links = _beside(text, ws), np.array(_links(keys, label), np.int64).reshape(-1, 2)
    edges = np.concatenate([np.column_stack([beside, beside + 1]), links])
    potential = np.concatenate([np.broadcast_to(model["chain"], (len(beside), LABELS, LABELS)), np.broadcast_to(model["skip"], (len(links), LABELS, LABELS))])
    p = marginals(unary, edges, potential, model["rounds"])
    best = np.where(_reached(len(ws), edges.tolist(), (label >= 0) | linked.any(axis=1)), p.argmax(axis=1), LABELS - 1)
    out: list[list[int]] = []
    previous = -2
    for i in np.flatnonzero((label < 0) & (best < LABELS - 1) & (p.max(axis=1) >= model["accept"])).tolist():
        a, b = ws[i]
        word = text[a:b]
        a, b = a + len(word) - len(word.lstrip(_EDGE)), b - len(word) + len(word.rstrip(_EDGE))
        if a >= b:
            continue
        if out and previous == i - 1 and out[-1][1] == best[i] and ws[i][0] - ws[i - 1][1] == 1:
            out[-1][2] = b
        else:
            out.append([a, int(best[i]), b])
        previous = i
    return [tuple(s) for s in out]


def _spelled(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _find(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, spans = [[], [], [], []], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text) if text else []
                more = added_spans(text, base, model) if base else []
                for k in range(len(KINDS)):
                    counts[k].append(sum(s[1] == k for s in base))
                shas.append(hashlib.sha256(_spelled(base).encode()).hexdigest())
                spans.append(_spelled(sorted(base + more)))
            keep = [i for i, f in enumerate(batch.schema) if f.name != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string())], names=[*(batch.schema[i].name for i in keep), *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    return run


def find(documents: DataFrame, model: dict, keys: list[str], text_col: str = "text") -> DataFrame:
    """The ``keys`` columns, base matches by kind (n_email ...), base_sha256 of the base
    spans, and all spans, as kind:start:end ordered by start, then kind."""
    docs = documents.select(*keys, F.col(text_col).cast("string").alias("text"))
    shape_ = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name != "text")
    return docs.mapInArrow(_find(model), f"{shape_}{', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones joined) replaced by its kind in brackets."""
    out, at, i = [], 0, 0
    spans = sorted(spans)
    while i < len(spans):
        a, k, b = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] < b:
            i += 1
            b = max(b, spans[i][2])
        out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at, i = b, i + 1
    return "".join([*out, text[at:]])


def _redact(model: dict, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tx.chunked(batches, column, tx.LEAN_BYTES):
            at = b.schema.get_field_index(column)
            texts = []
            for text in b.column(at).to_pylist():
                base = base_spans(text) if text else []
                texts.append(redacted(text, base + added_spans(text, base, model)) if base else text)
            yield b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return tx.tidy(run)


def redact(documents: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """All rows and columns, personal data in the text replaced by its kind."""
    return documents.mapInArrow(_redact(model, text_col), documents.schema)
