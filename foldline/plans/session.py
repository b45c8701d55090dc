"""The rules that edit content, for one session.

A session is one file's records in order; the rules need all of it and one another's
edits, in a fixed order.  What needs no edits (age clocks, kept uuids, removals) is decided
before, in DataFrame operations, and comes in as columns.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable
from math import inf
from typing import NamedTuple

from foldline.functions import jsonpatch as jp
from foldline.functions import preview as pv
from foldline.functions.shell import ReadTarget, read_targets
from foldline.plans import wording as wd
from foldline.sources.transcripts import BOUNDARIES, blocks, parse

# Fixed thresholds.
READ_MIN, READ_KEEP, READ_LIMIT = 400, 6, 2000
DUPLICATE_BYTES, GAIN, INPUT_MIN = 1024, 1.1, 300
RESULT_MIN, TRIM_BYTES, TRIM_LINES, MEGA_BYTES = 100, 8192, 100, 32768
MID, OLD, MEDIA = (15, 30), (40, 100), (5, 15)  # turns or results after

_REMINDER = re.compile(r"<system-reminder>.*?</system-reminder>", re.S)
_SQUEEZE = re.compile(r"\n{3,}")
#: The session that a retrieval command names.
NAMED = re.compile(r"(?:retrieve|media)\('([A-Za-z0-9][A-Za-z0-9-]{6,})'")


class Record:
    """One record: its line, its original object, and its edited one, if any."""

    def __init__(self, row: dict, at: int):
        self.at, self.pos, self.raw, self.row = at, row["pos"], row["raw"], row
        self.type, self.uuid, self.parent = row["type"], row["uuid"], row["parent"]
        self.protected = row["guarded"] or row["preserved"]
        self.removed = self.dropped = row["drop_rule"] is not None
        self.rule = row["drop_rule"]
        self.edited: dict | None = None
        self._root: dict | None = None

    @property
    def root(self) -> dict:
        if self._root is None:
            self._root = parse(self.raw.removesuffix("\r"))
        return self._root

    @property
    def view(self) -> dict:
        return self.root if self.edited is None else self.edited

    def edit(self, rule: str) -> dict:
        """A copy to write to, marked with the rule."""
        if self.edited is None:
            self.edited = parse(self.raw.removesuffix("\r"))
        self.edited.pop(wd.TAG, None)
        self.edited[wd.TAG] = {"v": jp.Num("1"), "rule": rule, "origUuid": self.uuid}
        self.rule = rule
        return self.edited

    def aged(self, limit: tuple[int, int]) -> bool:
        return self.row["turns_after"] >= limit[0] or self.row["results_after"] >= limit[1]


class Session:
    def __init__(self, file_id: str, rows: list[dict], parents: dict[str, set[str]] | None = None):
        self.id, self.parents = file_id, parents or {}
        self.records = [Record(r, at) for at, r in enumerate(rows)]
        self.sidechain = all(r["sidechain"] or r["type"] == "fork-context-ref" for r in rows)

    @property
    def tail(self) -> Record:
        return self.records[-1]

    def open(self) -> list[Record]:
        return [r for r in self.records if not r.protected]


def result_text(block: dict) -> str:
    content = block.get("content")
    if isinstance(content, list):
        return "".join(jp.text(p, "text") or "" for p in content if isinstance(p, dict))
    return content if isinstance(content, str) else ""


def block_text(block: dict) -> str:
    for key in ("text", "thinking", "content"):
        value = block.get(key)
        if isinstance(value, list):
            return " ".join(t for p in value if isinstance(p, dict) and (t := jp.text(p, "text")) is not None)
        if isinstance(value, str) and value:
            return value
    return ""


def main_argument(use: dict) -> str:
    given = use.get("input")
    if not isinstance(given, dict):
        return ""
    named = [jp.text(given, k) for k in ("command", "file_path", "path", "pattern", "url", "query", "prompt")]
    found = next((x for x in [*named, *given.values()] if isinstance(x, str) and x), "")
    return re.sub(r"\r\n|[\n\r\f\x85  ]", " ", found)


def media(block: dict) -> list[dict]:
    return [p for p in jp.items(block, "content") if isinstance(p, dict) and jp.text(p, "type") in ("image", "document")]


def media_label(block: dict) -> str:
    kinds = Counter(jp.text(p, "source", "media_type") or "media" for p in media(block))
    return "+".join(k if n == 1 else f"{k} x{n}" for k, n in kinds.items())


def ref(uuid: str) -> str:
    return uuid[:8]


def trim_bytes(text: str, limit: int) -> str:
    size = jp.utf8(text)
    if size <= limit:
        return text
    half = min(limit // 2 - 100, len(text) // 2)
    return f"{text[:half]}\n... [{size - limit} bytes {wd.TRIMMED} ...\n{text[len(text) - half :]}"


# 1 ------------------------------------------------------------------------------------
def fork_heal(s: Session) -> None:
    """A copied record that names its parent session, whose archive holds it, names this one."""
    for r in s.open():
        if r.removed or r is s.tail or wd.TAG not in r.view:
            continue
        named = {m for t in jp.strings(r.view) for m in NAMED.findall(t)}
        foreign = [i for i in named if i.lower() != s.id.lower() and r.uuid in s.parents.get(i.lower(), ())]
        if foreign:
            kept = jp.text(r.view, wd.TAG, "rule") or "fork-heal"
            swap = re.compile("|".join(map(re.escape, sorted(foreign, key=len, reverse=True))), re.I)
            r.edit(kept)
            r.edited = jp.map_strings(r.edited, lambda t: swap.sub(lambda _: s.id, t))


# 2, 3 ---------------------------------------------------------------------------------
def bash_targets(use: dict) -> list[ReadTarget]:
    return read_targets(jp.text(use, "input", "command"))


def read_tool_targets(use: dict) -> list[ReadTarget]:
    given = use.get("input")
    if not isinstance(given, dict) or not jp.text(given, "file_path") or set(given) - {"file_path", "offset", "limit"}:
        return []
    start, size = 1, READ_LIMIT
    if given.get("offset") is not None:
        start = jp.integer(given, "offset")
        if start is None or start < 0:
            return []
    if given.get("limit") is not None:
        size = jp.integer(given, "limit")
        if size is None or size <= 0:
            return []
    start = max(start, 1)
    return [ReadTarget(given["file_path"], start, start + size - 1)]


class Shown:
    """The ranges of lines of each file that later reads show; only those inside no other."""

    def __init__(self):
        self.of: dict[str, tuple[list[int], list[float]]] = {}

    def covers(self, t: ReadTarget) -> bool:
        starts, ends = self.of.get(t.path, ([], []))
        i = bisect_right(starts, t.lo) - 1  # of the ranges that begin before, the last one ends last
        return i >= 0 and ends[i] >= (inf if t.hi is None else t.hi)

    def add(self, t: ReadTarget) -> None:
        if self.covers(t):
            return
        starts, ends = self.of.setdefault(t.path, ([], []))
        end = inf if t.hi is None else t.hi
        i, j = bisect_left(starts, t.lo), bisect_right(ends, end)
        starts[i : max(i, j)], ends[i : max(i, j)] = [t.lo], [end]


def _supersede(rule: str, tools: tuple[str, ...], targets_of: Callable[[dict], list[ReadTarget]]) -> Callable[[Session], None]:
    def apply(s: Session) -> None:
        failed = {jp.text(b, "tool_use_id") for r in s.records for b in blocks(r.view, "tool_result") if b.get("is_error") is True}
        reads = [(i, t) for r in s.open() for b in blocks(r.view, "tool_use") if jp.text(b, "name") in tools and (t := targets_of(b)) and (i := jp.text(b, "id"))]
        later = Shown()
        gone: dict[str, list[ReadTarget]] = {}
        for n, (use_id, targets) in enumerate(reversed(reads)):
            if n >= READ_KEEP and all(map(later.covers, targets)):
                gone[use_id] = targets
            if use_id not in failed:
                for t in targets:
                    later.add(t)
        for r in s.open() if gone else ():
            ids = {i for b in blocks(r.view, "tool_result") if (i := jp.text(b, "tool_use_id")) in gone and jp.units(x := result_text(b)) >= READ_MIN and not x.startswith(wd.STUB)}
            for b in blocks(r.edit(rule)) if ids else ():
                if (i := jp.text(b, "tool_use_id")) in ids:
                    b["content"] = f"{wd.STUB}: file read superseded by a later read of {', '.join(map(str, gone[i]))}]"

    return apply


# 4 ------------------------------------------------------------------------------------
def reminder_dedup(s: Session) -> None:
    """Repeats of a reminder go; its first occurrence in the session stays."""
    seen: set[str] = set()

    def clean(text: str) -> str | None:
        cuts = []
        for m in _REMINDER.finditer(text):
            if m[0] in seen:
                cuts.append(m.span())
            seen.add(m[0])
        if not cuts:
            return None
        edges = [0, *(x for c in cuts for x in c), len(text)]
        return _SQUEEZE.sub("\n\n", "".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))).strip()

    for r in s.open():
        if r is s.tail:
            continue
        content = jp.get(r.view, "message", "content")
        if isinstance(content, str):
            if (short := clean(content)) is not None:
                r.edit("system-reminder-dedup")["message"]["content"] = short
            continue
        for n, b in enumerate(jp.items(r.view, "message", "content")):
            field = {"text": "text", "tool_result": "content"}.get(jp.text(b, "type") or "")
            value = jp.text(b, field) if field else None
            if value and (short := clean(value)) is not None:
                r.edit("system-reminder-dedup")["message"]["content"][n][field] = short


# 5 ------------------------------------------------------------------------------------
def document_dedup(s: Session) -> None:
    """Later copies of a long block name the first one."""
    found: dict[str, list[tuple[Record, int]]] = {}
    for r in s.open():
        if r is not s.tail:
            for n, b in enumerate(jp.items(r.view, "message", "content")):
                if isinstance(b, dict) and jp.utf8(t := block_text(b)) >= DUPLICATE_BYTES:
                    found.setdefault(t, []).append((r, n))
    for text, places in found.items():
        for r, n in places[1:]:
            b = r.view["message"]["content"][n]
            field = "text" if jp.text(b, "type") == "text" else "content" if jp.text(b, "type") == "tool_result" and isinstance(b.get("content"), str) else None
            if field and block_text(b) == text:
                r.edit("document-dedup")["message"]["content"][n][field] = f"{wd.STUB}: duplicate content removed — first seen earlier: {text[:80].replace(chr(10), ' ')}...]"


# 6 ------------------------------------------------------------------------------------
class Call(NamedTuple):
    """A use and its result: where they stand in the session, and the blocks."""

    use_at: int
    result_at: int
    use: dict
    result: dict

    @property
    def outside(self) -> int:
        """Bytes of the result that a digest line stands for."""
        return jp.utf8(result_text(self.result)) + sum(len(jp.text(p, "source", "data") or "") for p in media(self.result))

    @property
    def asked(self) -> int:
        return 0 if self.use.get("input") is None else len(jp.dumps(self.use["input"], True))

    def line(self, uuid: str) -> str:
        tool, arg, text = jp.text(self.use, "name") or "?", main_argument(self.use), result_text(self.result)
        kinds = media_label(self.result)
        said = pv.preview(tool, arg, text, self.result.get("is_error") is True)[:300]
        return f"[{ref(uuid)}] {tool}({arg[:90]}) -> {jp.utf8(text)}b :: {said}{f' [+media {kinds} — media() decodes it]' if kinds else ''}\n"


def _single(found: list[tuple[int, list[dict]]], key: str) -> dict[str, list[tuple[int, dict]]] | None:
    """The blocks by the id under ``key``, in order; None if a record has two or one lacks an id."""
    out: dict[str, list[tuple[int, dict]]] = {}
    for at, some in found:
        if len(some) != 1 or not jp.text(some[0], key):
            return None
        out.setdefault(some[0][key], []).append((at, some[0]))
    return out


def settled_calls(s: Session, span: range) -> list[Call]:
    """The turn's calls, by result; none if anything about the turn is not plain."""
    records = [(i, s.records[i]) for i in span]
    if any(r.protected or r.row["sidechain"] and not s.sidechain for _, r in records):
        return []
    uses = _single([(i, found) for i, r in records if r.type == "assistant" and (found := blocks(r.view, "tool_use"))], "id")
    answers = [(i, r, found) for i, r in records if r.type == "user" and (found := blocks(r.view, "tool_result"))]
    results = _single([(i, found) for i, _, found in answers], "tool_use_id")
    if uses is None or results is None or any(r.uuid is None or len(blocks(r.view)) > 1 for _, r, _ in answers):
        return []
    if {k: len(x) for k, x in uses.items()} != {k: len(x) for k, x in results.items()}:
        return []
    calls = [Call(i, j, u, b) for k in uses for (i, u), (j, b) in zip(uses[k], results[k], strict=True)]
    return sorted(calls, key=lambda c: c.result_at) if all(c.use_at < c.result_at for c in calls) else []


class Entry(NamedTuple):
    """What a folded record leaves in the digest, and the bytes that its removal saves."""

    record: Record
    text: str
    saved: int
    own_words: bool = False


def _entries(s: Session, calls: list[Call]) -> list[Entry]:
    """An entry for each record after the first use that the calls or their prose make up."""
    asks, answers = {c.use_at: c for c in calls}, {c.result_at: c for c in calls}
    out = []
    for r in s.records[min(c.use_at for c in calls) + 1 : max(answers) + 1]:
        at = r.at
        if at in answers:
            out.append(Entry(r, answers[at].line(r.uuid), answers[at].outside))
        elif r.type == "assistant" and (at in asks or is_prose(r)):
            said = [t for b in blocks(r.view, "text") if (t := (jp.text(b, "text") or "").strip())]
            notes = "".join(f"    (note) {t.replace(chr(10), chr(10) + '    ')}\n" for t in said)
            out.append(Entry(r, notes, asks[at].asked if at in asks else 0, True))
    return out


def is_prose(r: Record) -> bool:
    kinds = {jp.text(b, "type") for b in blocks(r.view)}
    return bool(kinds) and kinds <= {"text", "thinking"}


def _fold_turn(s: Session, span: range, discount: int) -> None:
    """The first use and its result stay; the result's text becomes the digest of the turn,
    if that is GAIN times smaller than what goes (notes and what a later rule takes off the
    header are not counted)."""
    every = settled_calls(s, span)
    calls = [c for c in every if s.records[c.result_at] is not s.tail]  # the tail stays as it is
    first = min(every, key=lambda c: c.use_at, default=None)
    if first not in calls or any(result_text(c.result).startswith(wd.CARRIER) for c in every):
        return
    entries = _entries(s, calls)
    digest = (wd.header(len(calls), s.id) + "".join(e.text for e in entries)).rstrip("\n")
    cost = jp.utf8(digest) - sum(jp.utf8(e.text) for e in entries if e.own_words) - discount
    if cost * GAIN >= sum(e.saved for e in entries):
        return
    carrier = s.records[first.result_at]
    for e in entries:
        if e.record is not carrier:
            e.record.removed, e.record.rule = True, "chain-collapse"
    for b in blocks(carrier.edit("chain-collapse")):
        if jp.text(b, "tool_use_id") == first.use["id"]:
            b["content"] = digest


def chain_collapse(s: Session) -> None:
    """Settled turns whose digest pays become one use and one result that holds the digest."""
    discount = jp.utf8(wd.header(99, s.id)) - jp.utf8(wd.short_header(99))
    starts = [i for i, r in enumerate(s.records) if r.row["real_user"]]
    for a, b in zip(starts, [*starts, len(s.records)][1:], strict=True):
        _fold_turn(s, range(a + 1, b), discount)


# 7 ------------------------------------------------------------------------------------
def header_dedup(s: Session) -> None:
    """The first digest of a segment keeps the full header, with current commands; others
    get the short one."""
    count = re.compile(re.escape(wd.CARRIER) + r"([0-9]+)")
    seen = False
    for r in s.records:
        if r.removed:
            continue
        if r.type == "system" and jp.text(r.root, "subtype") in BOUNDARIES:
            seen = False
            continue
        for b in blocks(r.view, "tool_result") if r.type == "user" else ():
            text = jp.text(b, "content") or ""
            n = count.match(text)
            if n is None or wd.FULL not in text:
                continue
            cut = text.find(wd.HEADER_END)
            if seen:
                new = wd.short_header(n[1]) + text[cut + len(wd.HEADER_END) :] if cut >= 0 else text
            else:
                seen, new = True, text
                a, z = text.find(wd.COMMANDS), text.find(wd.COMMANDS_END)
                if 0 <= a < z and r is not s.tail:
                    new = text[: a + len(wd.COMMANDS)] + wd.command_lines(s.id) + text[z:]
            if new != text:
                for c in blocks(r.edit(jp.text(r.view, wd.TAG, "rule") or "chain-collapse"), "tool_result"):
                    c["content"] = new


# 8 ------------------------------------------------------------------------------------
def anchor_input(s: Session) -> None:
    """The input of a folded turn's remaining use becomes a pointer."""
    uses = {i: r for r in s.records if not r.removed and r.type == "assistant" for b in blocks(r.view, "tool_use") if (i := jp.text(b, "id"))}
    carriers = [jp.text(b, "tool_use_id") for r in s.records if not r.removed and r.type == "user" for b in blocks(r.view, "tool_result") if (jp.text(b, "content") or "").startswith(wd.CARRIER)]
    for i in carriers:
        r = uses.get(i or "")
        use = next((b for b in blocks(r.view, "tool_use") if jp.text(b, "id") == i), None) if r else None
        given = use and use.get("input")
        if not isinstance(given, dict) or wd.TAG in given or r.uuid is None or len(jp.dumps(given, True)) < INPUT_MIN:
            continue
        short = {wd.TAG: f"input archived; original: ref {ref(r.uuid)}", "preview": main_argument(use)[:90]}
        for b in blocks(r.edit("anchor-input-stub"), "tool_use"):
            if jp.text(b, "id") == i:
                b["input"] = short


# 9 ------------------------------------------------------------------------------------
def _origins(s: Session) -> dict[int, dict[str | None, tuple[str, str]]]:
    """For each record with results: tool and object of the nearest use before it, within its
    turn, by the results' ids."""
    out: dict[int, dict[str | None, tuple[str, str]]] = {}
    uses: dict[str, dict] = {}
    for r in s.records:
        if wanted := [jp.text(b, "tool_use_id") for b in blocks(r.view, "tool_result")]:
            out[r.at] = {i: _said(uses[i]) for i in wanted if i in uses}
        if r.row["real_user"]:
            uses = {}
        for u in blocks(r.root, "tool_use"):
            if i := jp.text(u, "id"):
                uses[i] = u
    return out


def _said(use: dict) -> tuple[str, str]:
    given = use.get("input") if isinstance(use.get("input"), dict) else {}
    found = next((x for k in ("file_path", "path", "pattern") if (x := jp.text(given, k))), None)
    return jp.text(use, "name") or "", found or (jp.text(given, "command") or "")[:80]


def _shorter(r: Record, origin: tuple[str, str], text: str) -> str | None:
    old, saved = r.aged(OLD), pv.persisted_path(text)
    if jp.units(text) < RESULT_MIN or text.startswith(wd.STUB) or (not old and (wd.TRIMMED in text or saved is not None)):
        return None
    if old:
        tool, what = origin
        new = f"{wd.STUB}{f': {tool}' if tool else ''}{f' {what}' if what else ''} — {text.count(chr(10)) + 1} lines, {jp.utf8(text) / 1024:.1f}KB{f'; full output: {saved}' if saved else ''}]"
    else:
        new = pv.minify(text)
        lines = new.split("\n")
        if len(lines) > TRIM_LINES:
            keep = TRIM_LINES // 2 - 1
            new = "\n".join([*lines[:keep], f"... [{len(lines) - 2 * keep} lines {wd.TRIMMED} ...", *lines[-keep:]])
        else:
            new = trim_bytes(new, TRIM_BYTES)
    return new if len(new) < len(text) else None


def result_age(s: Session) -> None:
    """Results of middle age are shortened, old ones become one line."""
    aged = [r for r in s.open() if r.aged(MID)]
    origins = _origins(s) if any(r.aged(OLD) for r in aged) else {}
    for r in aged:
        for n, b in enumerate(jp.items(r.view, "message", "content")):
            if jp.text(b, "type") != "tool_result":
                continue
            origin = origins.get(r.at, {}).get(jp.text(b, "tool_use_id"), ("", ""))
            if isinstance(b.get("content"), str):
                if (new := _shorter(r, origin, b["content"])) is not None:
                    r.edit("tool-result-age")["message"]["content"][n]["content"] = new
            for m, p in enumerate(jp.items(b, "content")):
                if jp.text(p, "type") == "text" and (t := jp.text(p, "text")) is not None and (new := _shorter(r, origin, t)) is not None:
                    r.edit("tool-result-age")["message"]["content"][n]["content"][m]["text"] = new


# 10 -----------------------------------------------------------------------------------
def mega_trim(s: Session) -> None:
    """Very long blocks of middle age keep their head and tail."""
    for r in s.open():
        if r.type in ("summary", "queue-operation") or not r.aged(MID):
            continue
        for n, b in enumerate(jp.items(r.view, "message", "content")):
            field = {"text": "text", "tool_result": "content"}.get(jp.text(b, "type") or "")
            t = jp.text(b, field) if field else None
            if t is not None and jp.utf8(t) > MEGA_BYTES and wd.TRIMMED not in t:
                r.edit("mega-block-trim")["message"]["content"][n][field] = trim_bytes(t, MEGA_BYTES)


# 11 -----------------------------------------------------------------------------------
def _media_stub(s: Session, r: Record, block: dict) -> dict:
    source = jp.get(block, "source") or {}
    label = jp.text(source, "media_type") or jp.text(block, "type") or "image"
    if data := jp.text(source, "data"):
        label += f", {max(1, len(data) * 3 // 4 // 1024)}KB"
    elif jp.text(source, "type") == "url":
        label += ", url source"
    where = f"{label} archived — media({s.id!r}, ref={ref(r.uuid)!r}) decodes it" if r.uuid else f"old {label} removed — re-request if needed"
    return {"type": "text", "text": f"{wd.STUB}: {where}]"}


def image_strip(s: Session) -> None:
    """Aged images, and documents that hold their bytes, become pointers to the archive."""
    for r in s.open():
        if not r.aged(MEDIA):
            continue
        for n, b in enumerate(jp.items(r.view, "message", "content")):
            kind = jp.text(b, "type")
            if kind == "image" or (kind == "document" and jp.text(b, "source", "type") == "base64"):
                r.edit("image-strip")["message"]["content"][n] = _media_stub(s, r, b)
            for m, p in enumerate(jp.items(b, "content") if kind == "tool_result" else ()):
                if jp.text(p, "type") == "image":
                    r.edit("image-strip")["message"]["content"][n]["content"][m] = _media_stub(s, r, p)


# 13 -----------------------------------------------------------------------------------
def queue_history(s: Session) -> None:
    """All queue operations go if every queue replays to empty."""
    if s.tail.type == "queue-operation":
        return
    queues: dict[str, list[str]] = {}
    ops = [r for r in s.records if r.type == "queue-operation"]
    for r in ops:
        q, op, content = queues.setdefault(jp.text(r.root, "sessionId") or "", []), jp.text(r.root, "operation"), jp.text(r.root, "content")
        if r.protected:
            return
        if op == "enqueue" and content is not None:
            q.append(content)
        elif op == "dequeue" and q:
            q.pop(0)
        elif op == "remove" and content in q:
            q.remove(content)
        else:
            return
    if not any(queues.values()):
        for r in ops:
            r.removed, r.rule = True, "queue-history-collapse"


#: The order matters: each rule reads what those before it wrote.  The removals that are
#: decided outside (12 and 14 to 17) read the original records.
CATALOG: list[tuple[str, Callable[[Session], None]]] = [
    ("fork-heal", fork_heal),
    ("bash-read-dedup", _supersede("bash-read-dedup", ("Bash", "bash"), bash_targets)),
    ("read-dedup", _supersede("read-dedup", ("Read", "read"), read_tool_targets)),
    ("system-reminder-dedup", reminder_dedup),
    ("document-dedup", document_dedup),
    ("chain-collapse", chain_collapse),
    ("carrier-header-dedup", header_dedup),
    ("anchor-input-stub", anchor_input),
    ("tool-result-age", result_age),
    ("mega-block-trim", mega_trim),
    ("image-strip", image_strip),
    ("queue-history-collapse", queue_history),
]


def _reachable(chain: list[tuple[str | None, str | None]]) -> set[str]:
    up: dict[str, str | None] = {}
    for uuid, parent in chain:
        if uuid is not None:
            up.setdefault(uuid, parent)
    at, out = chain[-1][0], set()
    while at is not None and at in up and at not in out:
        out.add(at)
        at = up[at]
    return out


def rewritten(s: Session) -> tuple[list[str | None], str | None]:
    """Each record's new line (None if it goes), and why the rewrite is refused, if it is."""
    if s.tail.removed or s.tail.edited is not None:
        return [], "tail-touched"
    up: dict[str, str | None] = {}
    for r in s.records:
        if r.uuid is not None:
            up.setdefault(r.uuid, r.parent)
    gone = {r.uuid for r in s.records if r.removed and r.uuid is not None}

    def survivor(uuid: str | None) -> str | None:
        seen = set()
        while uuid in gone:
            if uuid in seen:
                return None
            seen.add(uuid)
            uuid = up[uuid]
        return uuid

    out: list[str | None] = []
    chain: list[tuple[str | None, str | None]] = []
    for r in s.records:
        if r.removed:
            out.append(None)
            continue
        leaf = jp.text(r.view, "leafUuid")
        parent, new_leaf = survivor(r.parent), survivor(leaf)
        line = r.raw
        if r.edited is not None or parent != r.parent or new_leaf != leaf:
            node = dict(r.view)
            if parent != r.parent:
                node["parentUuid"] = parent
            if new_leaf != leaf:
                node["leafUuid"] = new_leaf
            line = jp.dumps(node)
            if "\n" in line:
                return [], "embedded-newline"
            try:
                again = parse(line)
            except ValueError:
                return [], "reparse"
            if again.get("uuid") != r.uuid or again.get("parentUuid") != parent:
                return [], "chain-mismatch"
            line += "\r" if r.raw.endswith("\r") else ""
        if parent in gone:
            return [], "dangling-parent"
        if new_leaf in gone:
            return [], "dangling-leaf"
        if jp.text(r.view, "sourceToolAssistantUUID") in gone:
            return [], "dangling-source"
        out.append(line)
        chain.append((r.uuid, parent))
    if not chain:
        return [], "empty"
    if chain[-1][0] != s.tail.uuid:
        return [], "tail-uuid"
    lost = (_reachable([(r.uuid, r.parent) for r in s.records]) & {u for u, _ in chain}) - _reachable(chain)
    return ([], f"unreachable:{min(lost)}") if lost else (out, None)


def compact_session(s: Session) -> tuple[list[str | None], str | None]:
    for _, rule in CATALOG:
        rule(s)
    return rewritten(s)
