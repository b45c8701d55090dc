"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldline.llm.warc import archive

    return archive(_read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldline.llm.debruijn import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldline.llm.jaccard import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"), k=4, percent=85)


def op1_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from foldline.llm.ann import nearest

    return nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from foldline.llm import langid

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.filter("not held_out"))
    return langid.predict(docs, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", F.col("score"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldline.llm.html_extract import extract

    return extract(_read(spark, sf_dir, "pages"), ["page_id", "url"])


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldline.llm.decontam import contained_items

    return contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from foldline.llm import langid, qda
    from foldline.llm.shared import table

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", langid.held_out())
    stats = table(qda.with_statistics(docs, ["doc_id", "held_out"]), "statistics")
    labels = _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = qda.fit(stats.filter("not held_out").join(labels, "doc_id"))
    return qda.predict(stats, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


#: The tree of op6 and of the pipeline: domains are the sources' numbers modulo 3.
MIX_LEVELS = {"domain": "concat('d', try_cast(regexp_extract(source, '[0-9]+$', 0) AS INT) % 3)", "lang": "lang", "source": "source"}
MIX_WEIGHTS = {"domain": "CASE domain WHEN 'd0' THEN 5 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END", "lang": "CASE lang WHEN 'en' THEN 4 WHEN '(none)' THEN 1 ELSE 2 END"}
MIX_BUDGET, MIX_EPOCHS, MIX_SEED = 0.6, 2, 7


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldline.llm.mixing import mix

    return mix(_read(spark, sf_dir, "documents"), MIX_LEVELS, MIX_WEIGHTS, MIX_BUDGET, MIX_EPOCHS, MIX_SEED)


def _mix_sql() -> str:
    from foldline.llm.mixing import share_sql

    names, out = list(MIX_LEVELS), []
    for i, name in enumerate(names):
        keys = ["root", *names[:i]]
        out.append(f"l{i} AS (SELECT {', '.join(keys)}, {name}, CAST(sum(cap) AS BIGINT) AS cap, CAST(max(w_{name}) AS BIGINT) AS w FROM leaf GROUP BY {', '.join(keys)}, {name})")
        out.append(f"b{i} AS ({share_sql(f'l{i}', f'b{i - 1}' if i else 'top', keys, name, '//')})")
    weights = ", ".join(f"{MIX_WEIGHTS.get(n, '1')} AS w_{n}" for n in names)
    part = Fraction(str(MIX_BUDGET))
    return rf"""
WITH d AS (SELECT doc_id, coalesce('d' || (TRY_CAST(regexp_extract(source, '[0-9]+$', 0) AS INT) % 3), '(none)') AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS BIGINT) AS n_tokens FROM documents),
doc AS (SELECT * FROM d WHERE n_tokens > 0),
leaf AS (SELECT *, tokens * {MIX_EPOCHS} AS cap, {weights} FROM (SELECT 0 AS root, domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM doc GROUP BY domain, lang, source)),
top AS (SELECT 0 AS root, least(CAST(sum(cap) AS BIGINT), CAST(sum(tokens) AS BIGINT) * {part.numerator} // {part.denominator}) AS budget FROM leaf),
{", ".join(out)},
share AS (SELECT domain, lang, source, CAST(budget // (cap // {MIX_EPOCHS}) AS INT) AS whole, budget % (cap // {MIX_EPOCHS}) AS rest FROM b{len(names) - 1}),
placed AS (SELECT doc.*, whole, rest, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{MIX_SEED}:' || whole || ':' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
           FROM doc JOIN share USING (domain, lang, source))
SELECT doc_id, domain, lang, source, CAST(whole AS INT) AS epoch, n_tokens, CAST(least(n_tokens, rest - ahead) AS BIGINT) AS n_taken FROM placed WHERE ahead < rest
UNION ALL SELECT doc_id, domain, lang, source, CAST(e AS INT), n_tokens, n_tokens FROM placed, unnest(range(0, whole)) r(e)"""


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foldline.llm import pii

    docs = _read(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs), ["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_rotated_codes": op1_rotated_codes,
    "op2_language_id": op2_language_id,
    "op3_warc": op3_warc,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_html_text": op8_html_text,
    "op9_decontamination": op9_decontamination,
    "op10_pii": op10_pii,
}

SQL: dict[str, str] = {
    "op4_substring_dedup": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS g FROM starts),
bad AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM grams) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM bad, range(0, 35) r(j)),
kept AS (SELECT w.doc_id, p, ws[p] AS word FROM w, unnest(range(1, len(ws) + 1)) u(p)
         WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = w.doc_id AND gone.p = u.p)),
joined AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM kept GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN joined USING (doc_id)""",
    "op7_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 4 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 3], ' ') END AS g
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
ov AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT x, y FROM ov JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 85 * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION SELECT y, x FROM link),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, edge.y FROM reach JOIN edge ON edge.x = reach.r)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id)""",
    "op9_decontamination": r"""
WITH lowered AS (SELECT 'd' AS k, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
                 UNION ALL SELECT 'i', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
w AS (SELECT k, id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM lowered),
item AS (SELECT DISTINCT id, least(len(ws), 5) AS m, array_to_string(ws[i:i + least(len(ws), 5) - 1], ' ') AS g
         FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE k = 'i' AND len(ws) > 0)),
doc AS (SELECT DISTINCT id, m, array_to_string(ws[i:i + m - 1], ' ') AS g
        FROM (SELECT id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT DISTINCT m FROM item) WHERE k = 'd' AND len(ws) >= m)),
n AS (SELECT id, count(*) AS n FROM item GROUP BY id),
hit AS (SELECT doc.id AS doc_id, item.id AS item_id, count(*) AS c FROM doc JOIN item USING (m, g) GROUP BY doc.id, item.id)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS n_item, CAST(c AS BIGINT) AS n_shared FROM hit JOIN n ON n.id = item_id WHERE 100 * c >= 80 * n""",
    "op6_mixing": _mix_sql(),
    "op3_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1) for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM top AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM d""",
}
