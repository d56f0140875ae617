"""Registered queries: chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.config import ChunkerConfig
from marginalia.operators import chunking
from marginalia.plans import corpus
from marginalia.plans.registry import query
from marginalia.sources.layout import spread

# The documents hold no front matter, fence, heading or blank line, so the SQL packs sentences and
# cuts long ones, with $$ blocks hidden meanwhile.
_CHUNKS = r"""
WITH RECURSIVE found AS (
  SELECT doc_id, text, regexp_extract_all(text, '\$\$[\s\S]*?\$\$') AS blocks,
         regexp_split_to_array(text, '\$\$[\s\S]*?\$\$') AS gaps FROM documents
), hidden AS (
  SELECT doc_id, text, blocks, trim(array_to_string(list_transform(range(1, len(gaps) + 1),
    lambda i: gaps[i] || CASE WHEN i <= len(blocks) THEN chr(57344) || (i - 1) || chr(57345) ELSE '' END), ''),
    chr(32) || chr(9) || chr(10)) AS body
  FROM found
), cut AS (
  SELECT doc_id, body, length(body) <= 1000 AS whole,
    string_split(regexp_replace(body, '([.!?])\s+([A-ZÀ-ſ])', '\1' || chr(57346) || '\2', 'g'), chr(57346)) AS parts
  FROM hidden
), sentences AS (
  SELECT doc_id, u.i, u.s, n FROM (
    SELECT doc_id, len(parts) AS n, unnest(list_transform(range(1, len(parts) + 1),
      lambda i: {'i': i, 's': parts[i]})) AS u FROM cut WHERE NOT whole)
), pieces AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) AS p, piece, hard FROM (
    SELECT doc_id, i, 0 AS k, s AS piece, FALSE AS hard FROM sentences WHERE length(s) <= 1000
    UNION ALL
    SELECT doc_id, i, k, substr(s, CAST(k * 1000 + 1 AS BIGINT), 1000), TRUE FROM (
      SELECT doc_id, i, s, unnest(range(0, CAST(ceil(length(s) / 1000.0) AS BIGINT))) AS k FROM sentences WHERE length(s) > 1000))
), packed AS (
  SELECT doc_id, p, piece, hard, length(piece) + 1 AS used, 0 AS c FROM pieces WHERE p = 1
  UNION ALL
  SELECT n.doc_id, n.p, n.piece, n.hard,
    CASE WHEN NOT n.hard AND NOT k.hard AND k.used + length(n.piece) + 1 <= 1000 THEN k.used + length(n.piece) + 1
         ELSE length(n.piece) + 1 END,
    CASE WHEN NOT n.hard AND NOT k.hard AND k.used + length(n.piece) + 1 <= 1000 THEN k.c ELSE k.c + 1 END
  FROM packed k JOIN pieces n ON n.doc_id = k.doc_id AND n.p = k.p + 1
), bodies AS (
  SELECT doc_id, c, string_agg(piece, ' ' ORDER BY p) AS body FROM packed GROUP BY 1, 2
  UNION ALL
  SELECT doc_id, 0, body FROM cut WHERE whole
), shown AS (
  SELECT b.doc_id, c, h.text, h.blocks, regexp_split_to_array(b.body, '\x{E000}\d+\x{E001}') AS gaps,
         regexp_extract_all(b.body, '\x{E000}(\d+)\x{E001}', 1) AS marks
  FROM bodies b JOIN hidden h USING (doc_id)
), restored AS (
  SELECT doc_id, c, text, trim(array_to_string(list_transform(range(1, len(gaps) + 1),
    lambda i: gaps[i] || coalesce(blocks[CAST(marks[i] AS INTEGER) + 1], '')), ''), chr(32) || chr(9) || chr(10)) AS content
  FROM shown
), kept AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1 AS chunk_index,
         instr(text, content) AS spot FROM restored WHERE length(content) >= 50
)
SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, content,
       substr(sha256(chr(10) || chr(10) || content), 1, 32) AS content_hash,
       CASE WHEN spot = 0 THEN 0 ELSE len(string_split(substr(text, 1, spot - 1), chr(10))) END AS start_line,
       CASE WHEN spot = 0 THEN 0 ELSE len(string_split(substr(text, 1, spot - 1), chr(10)))
         + len(string_split(content, chr(10))) - 1 END AS end_line
FROM kept
"""


@query(_CHUNKS)
def chunk_documents(spark, sf_dir):
    docs = spread(corpus.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return chunking.chunk_rows(docs, ["doc_id"], "text").drop("heading", "heading_level")


# Turns become sections and every line a paragraph: level-3 headings stay inside, level-2 ones split.
_MARKDOWN = """
WITH t AS (
  SELECT conv_id, turn, role, replace(text, chr(10), chr(10) || chr(10)) AS body FROM conversations
)
SELECT conv_id, turn, role AS heading, 2 AS heading_level, '### said' || chr(10) || body AS content,
       substr(sha256(role || chr(10) || chr(10) || '### said' || chr(10) || body), 1, 32) AS content_hash,
       6 AS start_line, 6 + len(string_split(body, chr(10))) AS end_line
FROM t
"""


@query(_MARKDOWN)
def chunk_headings(spark, sf_dir):
    turns = corpus.table(spark, sf_dir, "conversations")
    body = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    page = F.concat(F.lit("---\nkind: turn\n---\n\n## "), "role", F.lit("  \n### said\n"), body, F.lit("\n"))
    config = ChunkerConfig(chunk_size=1_000_000, heading_split_depth=2, min_chunk_chars=1)
    rows = spread(turns.select("conv_id", "turn", page.alias("page")))
    return chunking.chunk_rows(rows, ["conv_id", "turn"], "page", config).drop("chunk_index")
