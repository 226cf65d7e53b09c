"""DuckDB SQL for the queries of this package that SQL can express in reasonable time on small tables."""

from __future__ import annotations

import re

from . import chat

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: All pairs of documents that share a shingle, joined on the shingle, and the closure of the links among them.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, hash(x) AS x FROM (SELECT doc_id, s, unnest(s) AS x FROM sets)
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.seen = links.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(seen) AS component_id, min(seen) = s.doc_id AS kept
FROM sets s JOIN reach r ON s.doc_id = r.doc_id GROUP BY s.doc_id, s.s"""


def _frame(role: str) -> int:
    return len(chat.OPEN[role]) + len(chat.CLOSE[role])


_CONTROL = "|".join([re.escape(c) for c in chat.CONTROL] + [r"\\"])
_OTHER = len(chat.OTHER_ROLE) + len(chat.OTHER_OPEN) + len(chat.OTHER_CLOSE)

#: What reading back the formatted conversations has to give, from the turns themselves.
REPLY_TREES = rf"""
WITH talks AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROL}'))
         + CASE role {" ".join(f"WHEN '{r}' THEN {_frame(r)}" for r in chat.OPEN)}
           ELSE {_OTHER} + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) END AS chars
  FROM talks
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""
