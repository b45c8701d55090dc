"""Which files, and which of their lines, a shell command provably only reads."""

from __future__ import annotations

import re
from typing import NamedTuple

_UNSAFE = re.compile(r"[>&`]|\$\(|<\(")
_SPECIAL = frozenset('"\\$`')


class ReadTarget(NamedTuple):
    """Lines lo to hi of a path; hi None is the end of the file."""

    path: str
    lo: int
    hi: int | None

    def covers(self, other: ReadTarget) -> bool:
        return self.path == other.path and self.lo <= other.lo and (self.hi is None or (other.hi is not None and self.hi >= other.hi))

    def __str__(self) -> str:
        return f"{self.path}:{self.lo}-{'EOF' if self.hi is None else self.hi}"


# A word piece: blank, operator, single-quoted, double-quoted, escaped, or plain.
_PIECE = re.compile(r"(?P<blank>\s+)|(?P<op>\|\||[;|])|'(?P<single>[^']*)'|\"(?P<double>(?:[^\"\\]|\\.)*)\"|\\(?P<escaped>.)|(?P<plain>[^\s;|'\"\\]+)", re.S)


def split(command: str) -> list[tuple[str, bool]] | None:
    """(word, is operator) pairs; None for an unclosed quote or a trailing backslash."""
    out: list[tuple[str, bool]] = []
    word: list[str] | None = None
    at = 0
    while at < len(command):
        m = _PIECE.match(command, at)
        if m is None:
            return None
        at = m.end()
        kind = m.lastgroup
        if kind in ("blank", "op"):
            if word is not None:
                out.append(("".join(word), False))
                word = None
            if kind == "op":
                out.append((m["op"], True))
            continue
        piece = m[kind]
        if kind == "double":
            piece = re.sub(r"\\(.)", lambda x: x[1] if x[1] in _SPECIAL else x[0], piece, flags=re.S)
        word = [*(word or []), piece]
    if word is not None:
        out.append(("".join(word), False))
    return out


def _number(s: str) -> int | None:
    return int(s) if re.fullmatch(r"[+-]?[0-9]+", s) and abs(int(s)) < 2**31 else None


def _cat(args: list[str]) -> list[ReadTarget] | None:
    return [ReadTarget(a, 1, None) for a in args] if args and all(a and a[0] != "-" for a in args) else None


def _head(args: list[str]) -> list[ReadTarget] | None:
    count, paths, rest = None, [], iter(args)
    for a in rest:
        if a in ("-n", "--lines"):
            count = _number(next(rest, "").lstrip("+"))
            if count is None:
                return None
        elif m := re.fullmatch(r"-([0-9]{1,9})", a):
            count = int(m[1])
        elif a and a[0] != "-":
            paths.append(a)
        else:
            return None
    return [ReadTarget(paths[0], 1, count)] if len(paths) == 1 and count is not None else None


def _sed(args: list[str]) -> list[ReadTarget] | None:
    if len(args) != 3 or args[0] != "-n" or not args[2] or args[2][0] == "-":
        return None
    out = []
    for part in args[1].split(";"):
        m = re.fullmatch(r"([0-9]{1,9})(?:,([0-9]{1,9}))?p", part)
        if m is None or int(m[1]) > int(m[2] or m[1]):
            return None
        out.append(ReadTarget(args[2], int(m[1]), int(m[2] or m[1])))
    return out


# tail reads from an end that moves, so it is not among them.
_VERBS = {"cat": _cat, "head": _head, "sed": _sed}


def read_targets(command: str | None) -> list[ReadTarget]:
    """The targets of a command made only of reads and literal echoes; else none at all."""
    if not command or _UNSAFE.search(command):
        return []
    words = split(command)
    if not words:
        return []
    segments: list[list[str]] = [[]]
    for word, operator in words:
        if not operator:
            segments[-1].append(word)
        elif word == ";":
            segments.append([])
        else:
            return []
    out: list[ReadTarget] = []
    for seg in filter(None, segments):
        if seg[0] == "echo" and not any(a.startswith("-") or "$" in a for a in seg[1:]):
            continue
        verb = _VERBS.get(seg[0].rpartition("/")[2])
        found = verb(seg[1:]) if verb else None
        if not found:
            return []
        out += found
    return out
