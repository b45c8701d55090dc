"""What a model reads of transcripts, and what kind of transcripts they are.

Lines are read as VARIANT, so all of this stays in the JVM; payloads are for measures, which
do not depend on the order of keys in a call's input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.plans import metrics
from foldline.plans import wording as wd
from foldline.sources.transcripts import BOUNDARIES

SESSION_ID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def is_session_id(name: Column) -> Column:
    """Whether a folder's name is a session's: a UUID in lower case."""
    return name.rlike(SESSION_ID)


def humanized(tokens: Column) -> Column:
    return F.when(tokens >= 1000, F.concat(F.round(tokens / 1000.0).cast("long").cast("string"), F.lit("k tokens"))).otherwise(F.concat(tokens.cast("string"), F.lit(" tokens")))


def status_text(reclaimable: DataFrame) -> DataFrame:
    """file_id and text of the status line, for sessions whose reclaim is worth one (rows of
    verbs.reclaimable())."""
    share = F.round(F.col("removed_bytes") / F.col("loaded_bytes") * 100).cast("long").cast("string")
    text = F.concat(F.lit(f"{wd.TAG} · ~"), humanized(F.col("tokens")), F.lit(" reclaimable · "), share, F.lit("% of context · /exit + resume"))
    return reclaimable.filter("tokens is not null").select("file_id", text.alias("text"))


def _is(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v) == kind


def _text(v: Column, path: str) -> Column:
    part = F.try_variant_get(v, path, "variant")
    return F.when(_is(part, "STRING"), F.try_variant_get(part, "$", "string"))


def kind(block: Column) -> Column:
    """text, thinking, tool_use, tool_result, media or other."""
    name = _text(block, "$.type")
    return F.when(_is(block, "STRING"), "text").when(name.isin("text", "thinking", "tool_use", "tool_result"), name).when(name.isin("image", "document"), "media").otherwise("other")


def _said(block: Column, name: Column) -> Column:
    return F.when(_is(block, "STRING"), F.try_variant_get(block, "$", "string")).when(name == "text", _text(block, "$.text")).when(name == "thinking", _text(block, "$.thinking")).when(name == "tool_use", F.coalesce(F.to_json(F.try_variant_get(block, "$.input", "variant")), F.lit('""')))


def _parts(content: Column) -> Column:
    """A content's blocks: one for a string."""
    return F.when(_is(content, "STRING"), F.array(content)).otherwise(F.try_variant_get(content, "$", "array<variant>"))


def blocks(lines: DataFrame) -> DataFrame:
    """file_id, pos, n, role, kind and said (what a model reads of it) of every block; a
    result's own blocks count as texts of the result."""
    v = F.try_parse_json("line")
    rows = lines.select("file_id", "pos", _text(v, "$.message.role").alias("role"), F.try_variant_get(v, "$.message.content", "variant").alias("content"))
    rows = rows.select("file_id", "pos", "role", F.posexplode(_parts(F.col("content"))).alias("n", "block")).withColumn("kind", kind(F.col("block")))
    inner = F.transform(_parts(F.try_variant_get("block", "$.content", "variant")), lambda b: _said(b, kind(b)))
    said = F.when(F.col("kind") == "tool_result", F.array_join(inner, "\n")).otherwise(_said(F.col("block"), F.col("kind")))
    return rows.select("file_id", "pos", "n", "role", "kind", said.alias("said"))


def census(lines: DataFrame) -> DataFrame:
    """Blocks, bytes and tokens by role and kind."""
    size = F.octet_length("said")
    return blocks(lines).groupBy("role", "kind").agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.sum(metrics.tokens(F.col("said"))), F.lit(0)).cast("long").alias("tokens"))


def visible(lines: DataFrame) -> DataFrame:
    """The lines that a resumed session shows: after the last boundary, and those it keeps."""
    v = F.try_parse_json("line")
    rows = lines.select("file_id", "pos", "line", _text(v, "$.uuid").alias("uuid"), ((_text(v, "$.type") == "system") & _text(v, "$.subtype").isin(*BOUNDARIES)).alias("boundary"), F.try_variant_get(v, "$.compactMetadata.preservedMessages.allUuids", "array<string>").alias("keep"))
    kept = rows.filter("boundary").select("file_id", F.explode("keep").alias("uuid")).distinct().withColumn("preserved", F.lit(True))
    rows = rows.join(kept, ["file_id", "uuid"], "left")
    return metrics.model_visible(rows, F.col("boundary"), F.coalesce("preserved", F.lit(False))).select("file_id", "pos", "line")


def payload(lines: DataFrame) -> DataFrame:
    """file_id and the text that a model reads of a resumed session."""
    said = blocks(visible(lines)).filter("said is not null")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "n", "said")))
    return said.groupBy("file_id").agg(F.array_join(F.transform(ordered, lambda x: x["said"]), "\n").alias("payload"))


def file_kinds(lines: DataFrame, other_marks: tuple[str, ...] = ()) -> DataFrame:
    """For each file: agent (all records but bookkeeping are side-chain ones) or main; which
    tools wrote in it (this one by its records or digests, another by its marks): raw, own,
    other or both; and whether the application compacted it."""
    v = F.try_parse_json("line")
    entry = F.map_keys(F.from_json("line", "map<string,string>"))
    rows = lines.withColumns({"_book": entry == F.array(F.lit(wd.TAG)), "_side": F.coalesce(F.try_variant_get(v, "$.isSidechain", "boolean"), F.lit(False))})
    own = F.array_contains(entry, wd.TAG) | F.col("line").contains(wd.CARRIER)
    other = F.lit(False)
    for mark in other_marks:
        other = other | F.col("line").contains(mark)
    rows = rows.withColumns({"_own": own, "_other": other, "_cut": _text(v, "$.subtype") == "compact_boundary"})
    tools = F.when(F.bool_or("_own") & F.bool_or("_other"), "both").when(F.bool_or("_own"), "own").when(F.bool_or("_other"), "other").otherwise("raw")
    agent = F.coalesce(F.bool_and(F.when(~F.col("_book"), F.col("_side"))), F.lit(False))
    return rows.groupBy("file_id").agg(F.when(agent, "agent").otherwise("main").alias("kind"), tools.alias("tool"), F.coalesce(F.bool_or("_cut"), F.lit(False)).alias("app_compacted"))


def decisions(chosen: DataFrame) -> DataFrame:
    """Files, bytes and tokens by kind, baseline and reason (rows of metrics.baseline() with
    kind and tokens); a row with only kind, only baseline and only reason for each value."""
    g = chosen.select("kind", "baseline", "reason", "bytes", "tokens")
    one = lambda c: g.filter(F.col(c).isNotNull()).groupBy(F.lit(c).alias("by"), F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").cast("long").alias("bytes"), F.sum("tokens").cast("long").alias("tokens"))
    return one("kind").unionByName(one("baseline")).unionByName(one("reason"))


def corpus_lines(lines: DataFrame) -> DataFrame:
    """What goes into a corpus: lines that hold more than this tool's bookkeeping, torn ones as
    they stand; and for each its sha-256, for the manifest."""
    entry = F.map_keys(F.from_json("line", "map<string,string>"))
    return lines.filter(~F.coalesce(entry == F.array(F.lit(wd.TAG)), F.lit(False))).withColumn("sha256", F.sha2("line", 256))
