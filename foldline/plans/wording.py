"""The sentences that compaction writes, and reads again to stay idempotent."""

from __future__ import annotations

TAG = "foldline"
STUB = f"[{TAG}"
CARRIER = f"[{TAG}: this turn originally ran "
TRIMMED = f"trimmed by {TAG}]"
FULL = "Full outputs live in the archive; each [ref] line is one real call, in order, with a preview."
COMMANDS = "RETRIEVAL (a targeted form costs least):\n"
COMMANDS_END = "If the file discussed still exists, read it instead.\n\n"
HEADER_END = "[ref] lines report past actions; if a detail matters, retrieve it.]\n\n"


def calls(n: str) -> str:
    return "1 tool call" if n == "1" else f"{n} separate tool calls"


def command_lines(session: str) -> str:
    return (
        f"  retrieve({session!r}, ref=REF, grep=PATTERN)   # matching lines\n"
        f"  retrieve({session!r}, grep=PATTERN)            # all archived outputs\n"
        f"  retrieve({session!r}, ref=REF, mode='info')    # size first\n"
        f"  retrieve({session!r}, ref=REF, mode='full')    # whole output\n"
        f"  media({session!r}, ref=REF)                    # archived images and documents\n"
        "  REF is the id in [brackets]\n\n"
    )


def header(n: int | str, session: str) -> str:
    return f"{CARRIER}{calls(str(n))}. {FULL}\n\n{COMMANDS}{command_lines(session)}{COMMANDS_END}{HEADER_END}"


def short_header(n: int | str) -> str:
    return f"{CARRIER}{calls(str(n))}. Retrieval as in the nearest earlier folded turn. {HEADER_END}"
