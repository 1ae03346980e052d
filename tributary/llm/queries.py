"""Queries over the whole intended tables, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, html, langid, linededup, mixing, quality, simhash, tokens, warc
from .common import read_table, scratch_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a test item within its edit budget, with the item and the place."""
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with later occurrences of repeated three-line windows removed."""
    return linededup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose texts hold control strings; digests of what is read back."""
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(probe)
    return chat.digests(chat.rows_by_turn(rows)).withColumnRenamed("tree", "conv_id").drop("rank")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    scored = quality.score(read_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op5_token_counts(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Tokens of every document under byte_bpe_50k.json (or the tokenizer file at path)."""
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("byte_bpe_50k.json"))
    return tokens.token_counts(read_table(spark, sf_dir, "documents"), path)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all pages and documents."""
    return langid.identify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "pages"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.extract(read_table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to a WARC archive in the shared folder, and what is read back from it."""
    pages = read_table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("key"), "url", F.col("html").cast("binary").alias("payload"))
    base = scratch_path(spark, "warc")
    warc.write(pages, base, least=0)
    return warc.read(spark, base, payloads=False).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that the mix takes of each."""
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_dups(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_decontamination, op2_line_dedup, op3_chat_format, op4_quality_rules, op5_token_counts, op6_language_id, op7_html_extraction, op8_warc, op9_mixing, op10_simhash)}


LINE_DEDUP_SQL = r"""
WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
windows AS (
  SELECT doc_id, unnest(range(0, len(l) - 2)) AS pos, l FROM lines WHERE len(l) >= 3),
keyed AS (
  SELECT DISTINCT doc_id, pos, {'a': l[pos + 1], 'b': l[pos + 2], 'c': l[pos + 3]} AS w FROM windows
  WHERE trim(l[pos + 1] || l[pos + 2] || l[pos + 3], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
numbered AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS n FROM keyed),
gone AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM numbered WHERE n > 1),
removed AS (SELECT doc_id, list(pos) AS ps FROM gone GROUP BY doc_id)
SELECT d.doc_id,
       CASE WHEN ps IS NULL THEN d.text
            ELSE array_to_string(list_transform(list_filter(range(0, len(d.l)), lambda i: NOT list_contains(ps, i)), lambda i: d.l[i + 1]), chr(10)) END AS text,
       coalesce(len(ps), 0)::BIGINT AS lines_removed
FROM lines d LEFT JOIN removed r USING (doc_id)
"""

CHAT_SQL = r"""
WITH rows AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&#10;')) + length(replace(replace(text, '&', '&amp;'), '<', '&lt;')) + 15 AS chars FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

MIXING_SQL = r"""
WITH docs AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ' ' || md5(coalesce(text, ''))), 1, 12))::BIGINT AS h
  FROM documents),
sources AS (
  SELECT k, sum(size)::BIGINT AS s, [5, 2, 1][((row_number() OVER (ORDER BY k) - 1) % 3)::INT + 1]::BIGINT AS w FROM docs GROUP BY k),
ordered AS (
  SELECT k, s, w, 2 * s AS cap, row_number() OVER o AS r,
         ((sum(s) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(2 * s) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
           / ((sum(w) OVER ())::DOUBLE - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) AS level
  FROM sources WINDOW o AS (ORDER BY (2 * s)::DOUBLE / w::DOUBLE, k)),
chosen AS (SELECT r, level FROM ordered WHERE level <= cap::DOUBLE / w::DOUBLE ORDER BY r LIMIT 1),
targets AS (
  SELECT k, s, CASE WHEN c.r IS NULL OR o.r < c.r THEN cap::DOUBLE ELSE least(cap::DOUBLE, c.level * w) END AS t
  FROM ordered o LEFT JOIN chosen c ON true),
budgets AS (
  SELECT k, s, t, CASE WHEN s > 0 THEN least(1, floor(t / s)) ELSE 0 END::BIGINT AS whole FROM targets),
units AS (SELECT k, h, sum(size)::BIGINT AS size FROM docs GROUP BY k, h),
walked AS (
  SELECT u.k, h, size, t - whole * s AS b, sum(size) OVER (PARTITION BY u.k ORDER BY h) AS upto FROM units u JOIN budgets USING (k)),
cuts AS (
  SELECT k, coalesce(min(h) FILTER (WHERE upto > b), 1::BIGINT << 48) AS edge,
         floor(any_value(b) - coalesce(max(upto) FILTER (WHERE upto <= b), 0))::BIGINT AS room,
         coalesce(arg_min(size, h) FILTER (WHERE upto > b), 1)::BIGINT AS unit
  FROM walked GROUP BY k)
SELECT d.doc_id, d.size, b.s AS source_size, b.t AS target,
       (d.size * b.whole + CASE WHEN d.h < c.edge THEN d.size WHEN d.h = c.edge THEN floor((d.size * c.room)::DOUBLE / c.unit::DOUBLE) ELSE 0 END)::BIGINT AS taken
FROM docs d JOIN budgets b USING (k) JOIN cuts c USING (k)
"""


#: Base32 takes the digest's 160 bits in eights of 20 bits (five hexadecimal digits), each four characters.
WARC_SQL = r"""
WITH own AS (SELECT page_id::BIGINT AS page_id, url, coalesce(html, '') AS html FROM pages),
hashed AS (
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS h,
         row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST, url) AS n, min(page_id) OVER (PARTITION BY html) AS first FROM own),
digits AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, (i * 5 + 1)::INT, 5))::BIGINT) AS eights FROM hashed)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(eights, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> b) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN n = 1 OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN n > 1 THEN first END AS refers_to
FROM digits
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINE_DEDUP_SQL, "op3_chat_format": CHAT_SQL, "op8_warc": WARC_SQL, "op9_mixing": MIXING_SQL}
