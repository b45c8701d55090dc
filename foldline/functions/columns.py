"""Column functions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\n\x0B\f\r]"
NUMBER = r"^-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?$"


def squeeze(text: Column) -> Column:
    """Runs of three or more newlines become two; white space at both ends goes."""
    return F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), f"^{BLANK}+|{BLANK}+$", "")


def head_tail(text: Column, limit: int, tag: str = "foldline") -> Column:
    """Texts of more than ``limit`` bytes: head and tail, and how many bytes over they were."""
    half = F.least(F.lit(limit // 2 - 100), F.floor(F.length(text) / 2).cast("int"))
    note = F.concat(F.lit("\n[... "), (F.octet_length(text) - limit).cast("string"), F.lit(f" bytes trimmed by {tag}]\n"))
    return F.when(F.octet_length(text) > limit, F.concat(F.substring(text, F.lit(1), half), note, F.right(text, half))).otherwise(text)


def is_json_number(text: Column) -> Column:
    return text.rlike(NUMBER)


def percent_saved(before: Column, after: Column, digits: int = 4) -> Column:
    return F.when(before > 0, F.round(100.0 * (1 - after / before), digits)).otherwise(F.lit(0.0))


def ref(identity: Column) -> Column:
    """The first eight hexadecimal digits of the identity's sha-256."""
    return F.substring(F.sha2(identity, 256), 1, 8)


def line_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1)
